"""Imports every group so that its queries are registered."""

from . import convert, headings, refs, sources, tables, text  # noqa: F401
from .registry import BUILDERS, oracle_sql, queries  # noqa: F401
from .fixtures import Source


def flagship(spark, sf_dir):
    return BUILDERS["permalink_flow"](Source(spark, sf_dir))
