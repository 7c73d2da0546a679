"""Registry of driver queries: name -> (Spark builder, DuckDB oracle SQL).

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
driver tables (through the row-local bridges).  The oracle SQL computes the
same answer from the source columns.  Queries register themselves from the
``runlens.plans.q_*`` modules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Builder] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn
    return deco


def oracle_of(name: str) -> str:
    """The SQL of a query registered before."""
    return _ORACLES[name]


def _load_all() -> None:
    # Import for side effects (registration); order defines listing order.
    from runlens.plans import (  # noqa: F401
        q_builds, q_text, q_agentlog, q_coverage, q_descriptor, q_patch, q_corpus, q_io,
    )


def queries() -> dict[str, Builder]:
    _load_all()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load_all()
    return dict(_ORACLES)
