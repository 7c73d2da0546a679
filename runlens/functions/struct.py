"""Schema-level helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def flatten(df: DataFrame, separator: str = "_") -> DataFrame:
    """Nested struct fields become top-level columns ``parent_child``.

    Only structs recurse (arrays and maps stay as they are), like the
    reference's dict-only recursion.  A pure projection: no data moves.
    """
    cols = []

    def walk(prefix_path: list[str], name: str | None, dtype):
        for f in dtype.fields:
            path = prefix_path + [f.name]
            flat = f.name if name is None else f"{name}{separator}{f.name}"
            if isinstance(f.dataType, StructType):
                walk(path, flat, f.dataType)
            else:
                cols.append(F.col(".".join(f"`{p}`" for p in path)).alias(flat))

    walk([], None, df.schema)
    return df.select(*cols)
