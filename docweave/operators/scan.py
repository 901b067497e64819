"""Ordered scans that split long groups.

A plain window over ``doc_id`` puts a whole document into one task. A document may hold a
large share of the corpus, so ordered work is done in two levels here: rows are windowed
inside fixed position ranges ("chunks") of a group, one small summary row per chunk is
windowed over the group, and the carried state is joined back on (group, chunk). Groups of
one chunk pass through with an empty carry; the largest task holds one chunk plus, on the
summary side, one row per chunk.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .binding import bind

# Positions per chunk. Positions are document offsets, so this bounds rows per task.
CHUNK = 1 << 18


@dataclass(frozen=True)
class Spec:
    kind: str
    value: Column
    reset: Column | None = None
    inclusive: bool = True


def running_sum(value) -> Spec:
    """Sum of ``value`` up to and including the row."""
    return Spec("since", value, F.lit(False))


def count_since(cond, reset) -> Spec:
    """Rows meeting ``cond`` after the last row meeting ``reset`` (that row counts 0)."""
    return Spec("since", F.when(cond, 1).otherwise(0), reset)


def row_number() -> Spec:
    return running_sum(F.lit(1))


def last_value(value, inclusive: bool = True) -> Spec:
    """Last non-null ``value`` at or before (or strictly before) the row."""
    return Spec("last", value, None, inclusive)


def running_max(value, inclusive: bool = True) -> Spec:
    return Spec("max", value, None, inclusive)


def _hashable(df: DataFrame, name: str) -> Column:
    return F.size(name) if df.schema[name].dataType.typeName() == "map" else F.col(name)


def scan(df: DataFrame, keys: list[str], order: list[str], specs: dict[str, Spec],
         chunk: Column | None = None, descending: bool = False) -> DataFrame:
    """Add one column per spec. ``order[0]`` must be an integer position unless ``chunk``
    (any non-null value that grows with the order) is given."""
    chunk = F.floor(F.col(order[0]) / F.lit(CHUNK)).cast("long") if chunk is None else chunk
    df = df.withColumn("_chunk", chunk)
    names = df.columns
    given = {f"_v_{n}": s.value for n, s in specs.items()}
    given |= {f"_w_{n}": s.reset for n, s in specs.items() if s.reset is not None}
    df = bind(df, given)
    specs = {n: replace(s, value=F.col(f"_v_{n}"), reset=None if s.reset is None else F.col(f"_w_{n}"))
             for n, s in specs.items()}
    ordering = [F.col(o).desc() if descending else F.col(o).asc() for o in order]
    # One exchange feeds the rows and the summary. Null keys are marked apart, so that plain equality joins them back.
    marks = {}
    for i, k in enumerate(keys):
        kind = df.schema[k].dataType
        zero = F.lit("") if kind.typeName() in ("string", "binary") else F.lit(0)
        marks |= {f"_k{i}": F.coalesce(F.col(k), zero.cast(kind)), f"_n{i}": F.col(k).isNull()}
    df = df.withColumns(marks)
    group, part = list(marks), [*marks, "_chunk"]
    # The optimizer may not push this filter, which always holds, below the exchange; as it reads every column, both sides keep
    # the same ones and share the exchange.
    held = F.when(F.rand(0) < 2, F.xxhash64(*[_hashable(df, c) for c in df.columns])) >= F.lit(-(1 << 63)).cast("long")
    df = df.repartition(*part).where(held)
    w = Window.partitionBy(*part).orderBy(*ordering)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    frame = lambda s: upto if s.inclusive else before

    local, second, summary = {}, {}, []
    for name, s in specs.items():
        if s.kind == "since":
            local[f"_l_{name}"] = F.sum(s.value).over(upto)
            local[f"_r_{name}"] = s.reset
            second[f"_b_{name}"] = F.max(F.when(F.col(f"_r_{name}"), F.col(f"_l_{name}"))).over(upto)
            summary += [F.sum(s.value).alias(f"_s_{name}"), F.max(s.reset).alias(f"_h_{name}")]
        elif s.kind == "last":
            local[f"_l_{name}"] = F.last(s.value, ignorenulls=True).over(frame(s))
            latest = F.min_by if descending else F.max_by
            at = F.struct(*order)
            summary.append(latest(F.when(s.value.isNotNull(), F.struct(s.value.alias("v"))),
                                  F.when(s.value.isNotNull(), at)).alias(f"_s_{name}"))
        else:
            local[f"_l_{name}"] = F.max(s.value).over(frame(s))
            summary.append(F.max(s.value).alias(f"_s_{name}"))

    rows = df.withColumns(local)
    if second:
        rows = rows.withColumns(second)
    # Tail of a chunk = its total minus the cumulated value at its last reset.
    tails = [F.max(F.col(f"_b_{n}")).alias(f"_t_{n}") for n, s in specs.items() if s.kind == "since"]
    chunks = (rows if tails else df).groupBy(*part).agg(*summary, *tails)

    cw = Window.partitionBy(*group).orderBy(F.col("_chunk").desc() if descending else F.col("_chunk").asc())
    prior = cw.rowsBetween(Window.unboundedPreceding, -1)
    carry, carry2 = {}, {}
    for name, s in specs.items():
        if s.kind == "since":
            carry[f"_cum_{name}"] = F.sum(f"_s_{name}").over(prior)
            carry2[f"_cb_{name}"] = F.max(F.when(
                F.col(f"_h_{name}"), F.coalesce(F.col(f"_cum_{name}"), F.lit(0)) + F.coalesce(F.col(f"_t_{name}"), F.lit(0)))
            ).over(prior)
        elif s.kind == "last":
            carry[f"_c_{name}"] = F.last(f"_s_{name}", ignorenulls=True).over(prior)
        else:
            carry[f"_c_{name}"] = F.max(f"_s_{name}").over(prior)
    chunks = chunks.withColumns(carry)
    if carry2:
        chunks = chunks.withColumns(carry2)
    keep = []
    for name, s in specs.items():
        if s.kind == "since":
            keep.append((F.col(f"_cum_{name}") - F.coalesce(F.col(f"_cb_{name}"), F.lit(0))).alias(f"_c_{name}"))
        else:
            keep.append(F.col(f"_c_{name}"))
    # Only chunks that follow another one carry anything.
    first = F.row_number().over(cw) > 1
    chunks = chunks.withColumn("_later", first).where("_later").select(*part, *keep)

    # The rows lie as a merge join needs them, so nothing is gained by a copy of the carries in the driver.
    out = rows.alias("_x").join(chunks.alias("_y").hint("merge"), [F.col(f"_x.{c}") == F.col(f"_y.{c}") for c in part], "left").select(
        "_x.*", *[F.col(f"_y._c_{n}").alias(f"_c_{n}") for n in specs])
    final = {}
    for name, s in specs.items():
        l, c = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if s.kind == "since":
            b = F.col(f"_b_{name}")
            final[name] = F.when(b.isNull(), l + F.coalesce(c, F.lit(0))).otherwise(l - b)
        elif s.kind == "last":
            final[name] = F.when(l.isNotNull(), l).otherwise(c["v"])
        else:
            final[name] = F.greatest(l, c)
    out = out.withColumns(final)
    keep_cols = [c for c in names if c != "_chunk"] + [n for n in specs if n not in names]
    return out.select(*keep_cols)
