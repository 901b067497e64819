"""Evaluate derived columns once.

Catalyst substitutes projected expressions into the filters, joins and aggregates above
them, so a regex-heavy column used five times is evaluated (and compiled) five times.
Routing such columns through a one-row generator keeps them as plain attributes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Like ``withColumns``, evaluated once per row."""
    keep = [c for c in df.columns if c not in cols]
    # A projection below the generator shares what the expressions have in common; the generator itself would work out each part again.
    df = df.select(*keep, *[c.alias(f"_bound_{n}") for n, c in cols.items()])
    return df.select(*keep, F.inline(F.array(F.struct(*[F.col(f"_bound_{n}").alias(n) for n in cols]))))
