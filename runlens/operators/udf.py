"""User functions per row with error capture (X1) and bounded retries.

The reference runs one Python function per job and turns an exception into a
FAIL result.  ``guarded_map`` does that inside ``mapInArrow``: the function gets plain
Python values (``None`` for NULL, exact integers), kept columns pass through
untouched, one output row per input row, ``status``/``error`` columns added.  Use it
only for work that is Python by nature; everything expressible with Spark
functions belongs in the other operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from runlens.session import ship_package


def guarded_map(df: DataFrame, fn: Callable[[dict], dict], out_schema: StructType,
                keep: list[str] | None = None, attempts: int = 1) -> DataFrame:
    """``fn(row_dict) -> dict`` per row; up to ``attempts`` tries; failures become FAIL rows.

    Output columns: ``keep`` (copied from the input), the fields of
    ``out_schema`` (NULL on failure), ``status`` ('SUCCESS' | 'FAIL') and
    ``error`` (``str(exception)`` of the last attempt).
    """
    keep = list(keep or [])
    if attempts < 1:
        raise ValueError("attempts must be >= 1")
    in_fields = {f.name: f for f in df.schema.fields}
    schema = StructType([in_fields[k] for k in keep] + list(out_schema.fields)
                        + [StructField("status", StringType()), StructField("error", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        fields = list(to_arrow_schema(out_schema))
        for batch in batches:
            results, errors = [], []
            for rec in batch.to_pylist():
                for _ in range(attempts):
                    try:
                        res = fn(rec) or {}
                        # Converted here, so that a value of the wrong type is this row's failure.
                        values, err = [pa.array([res.get(f.name)], type=f.type)[0].as_py() for f in fields], None
                        break
                    except Exception as e:  # noqa: BLE001 - the point is to capture any failure
                        values, err = [None] * len(fields), str(e)
                results.append(values)
                errors.append(err)
            columns = [batch.column(k) for k in keep]
            columns += [pa.array([r[i] for r in results], type=f.type) for i, f in enumerate(fields)]
            columns += [pa.array(["SUCCESS" if e is None else "FAIL" for e in errors], type=pa.string()), pa.array(errors, type=pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)
