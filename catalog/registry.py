"""Query registry: a name, a Spark builder over a Source, and an optional DuckDB text."""

from __future__ import annotations

from .fixtures import Source, with_fixtures

BUILDERS: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        assert name not in BUILDERS, name
        BUILDERS[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def queries() -> dict:
    return {n: (lambda spark, sf_dir, fn=fn: fn(Source(spark, sf_dir))) for n, fn in BUILDERS.items()}


def oracle_sql() -> dict[str, str]:
    return {n: with_fixtures(t) for n, t in ORACLES.items()}
