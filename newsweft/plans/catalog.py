"""The catalogue of queries: each a function of ``Relations`` with, where SQL can say it, its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsweft.plans.dialect import with_relations
from newsweft.plans.relations import Relations

_QUERIES: dict[str, Callable[[Relations], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query under ``name``."""

    def wrap(f: Callable[[Relations], DataFrame]) -> Callable[[Relations], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = f
        if oracle is not None:
            _ORACLES[name] = oracle
        return f

    return wrap


def _load() -> None:
    import newsweft.operators.archive
    import newsweft.operators.candidates
    import newsweft.operators.content
    import newsweft.operators.edits
    import newsweft.operators.evidence
    import newsweft.operators.gates
    import newsweft.operators.health
    import newsweft.operators.hubs
    import newsweft.operators.imports
    import newsweft.operators.manifests
    import newsweft.operators.policies
    import newsweft.operators.reads
    import newsweft.operators.scope
    import newsweft.operators.state
    import newsweft.streaming.folds  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, f=f: f(Relations(spark, sf_dir))) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: with_relations(sql) for name, sql in _ORACLES.items()}
