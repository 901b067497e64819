"""List operators: typed paragraph runs, list styles, kind order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..session import durable
from .binding import bind
from .scan import last_value, running_sum, scan


def list_runs(children: DataFrame) -> DataFrame:
    """Consecutive typed paragraphs of one container form a list.

    children(doc_id, child_idx, tag, text); tag is null for bare text. Any other child,
    even whitespace text, ends the run.
    """
    m = L.list_marker("text")
    df = children.withColumn("_m", F.when(F.col("tag") == "p", m))
    # Texts are not ordered, only what their markers say.
    df = df.select("doc_id", "child_idx", "_m", F.col("_m.type").alias("_type"))
    df = durable(scan(df, ["doc_id"], ["child_idx"], {
        "_prev": last_value(F.struct(F.col("_type").alias("t")), inclusive=False)}))
    start = F.col("_type").isNotNull() & ~F.col("_type").eqNullSafe(F.col("_prev")["t"])
    df = scan(df.withColumn("_start", start).where("_type IS NOT NULL"), ["doc_id"], ["child_idx"], {"run_id": running_sum(F.when(F.col("_start"), 1).otherwise(0))})
    return df.select(
        "doc_id", "child_idx", F.col("run_id").cast("long").alias("run_id"), F.col("_m.kind").alias("kind"),
        F.col("_m.value").alias("value"), F.col("_type").alias("type"))


def list_run_summary(runs: DataFrame) -> DataFrame:
    """One row per list: type, items, start number when it is above 1."""
    out = runs.groupBy("doc_id", "run_id", "type").agg(
        F.count("*").alias("items"), F.min("child_idx").alias("first_child"), F.min_by("value", "child_idx").alias("_v"))
    return out.select("doc_id", "run_id", "type", "items", "first_child", F.when(F.col("_v") > 1, F.col("_v")).alias("start"),
                      L.list_class("type").alias("class"))


def list_kind_order(lists: DataFrame) -> DataFrame:
    """Rank of decimal, alpha, roman per document from the parent-to-child nesting of its
    lists (topological, ties by the default order; default when the nesting is cyclic).

    lists(doc_id, list_idx, parent_list_idx, type)
    """
    kind = F.when(F.col("type").isin("a", "A"), "a").when(F.col("type").isin("i", "I"), "r").otherwise("d")
    l = lists.select("doc_id", "list_idx", "parent_list_idx", kind.alias("k"))
    p = l.select("doc_id", F.col("list_idx").alias("parent_list_idx"), F.col("k").alias("pk"))
    e = l.join(p, ["doc_id", "parent_list_idx"]).where("k <> pk").withColumn("e", F.concat("pk", "k"))
    g = e.groupBy("doc_id").agg(*[F.max(F.when(F.col("e") == x, 1).otherwise(0)).alias(x)
                                  for x in ("da", "dr", "ad", "ar", "rd", "ra")])
    has = lambda x: F.col(x) == 1
    # Preferred orders in tie-breaking sequence; the first one that no edge contradicts.
    orders = [("d", "a", "r"), ("d", "r", "a"), ("a", "d", "r"), ("a", "r", "d"), ("r", "d", "a"), ("r", "a", "d")]
    pick = F.lit("dar")
    for o in reversed(orders):
        bad = has(o[1] + o[0]) | has(o[2] + o[0]) | has(o[2] + o[1])
        pick = F.when(~bad, "".join(o)).otherwise(pick)
    docs = lists.select("doc_id").distinct()
    out = docs.join(g, "doc_id", "left").withColumn("_o", F.coalesce(F.when(F.col("da").isNotNull(), pick), F.lit("dar")))
    return out.select("doc_id", *[(F.locate(c, F.col("_o")) - 1).alias(n)
                                  for n, c in (("decimal", "d"), ("alpha", "a"), ("roman", "r"))])


def own_list_style(classes, type_attr, style):
    has = lambda c: F.array_contains(classes, c)
    inline = F.lower(L.strip(F.regexp_extract(F.coalesce(style, F.lit("")), r"(?iU)list-style-type\s*:\s*([^;]+)", 1)))
    by_class = (F.when(has("list-alpha-lower"), "lower-alpha").when(has("list-alpha-upper"), "upper-alpha")
                .when(has("list-roman-lower"), "lower-roman").when(has("list-roman-upper"), "upper-roman")
                .when(has("list-decimal"), "decimal"))
    by_type = (F.when(type_attr == "a", "lower-alpha").when(type_attr == "A", "upper-alpha")
               .when(type_attr == "i", "lower-roman").when(type_attr == "I", "upper-roman").when(type_attr == "1", "decimal"))
    return F.coalesce(by_class, by_type, F.nullif(inline, F.lit("")))


def _info(style):
    case = F.when(style.contains("lower"), "lower").otherwise("upper")
    return (F.when(style.contains("alpha"), F.struct(F.lit("alpha").alias("kind"), case.alias("case")))
            .when(style.contains("roman"), F.struct(F.lit("roman").alias("kind"), case.alias("case")))
            .when(style.contains("decimal"), F.struct(F.lit("decimal").alias("kind"), F.lit(None).cast("string").alias("case"))))


def list_styles(lists: DataFrame) -> DataFrame:
    """Marker style of every ordered list: its own class, type or inline style; else that
    of the list before it at the same depth; else the kind after its parent's.

    Resolved one nesting depth at a time (a handful of passes), each pass an ordered scan
    whose result is written once and read by the next depth.
    lists(doc_id, list_idx, parent_list_idx, depth, type, classes, style)
    """
    ranks = durable(list_kind_order(lists))
    df = bind(lists, {"_style": own_list_style(F.col("classes"), F.col("type"), F.col("style"))})
    df = durable(bind(df, {"own": _info(F.col("_style"))}).drop("_style"))
    top = df.agg(F.max("depth")).first()[0]
    done, parents = None, None
    for d in range((top if top is not None else -1) + 1):
        cur = df.where(F.col("depth") == d)
        if parents is None:
            cur = cur.withColumn("derived", F.lit(None).cast("struct<kind:string,case:string>"))
        else:
            p = parents.select("doc_id", F.col("list_idx").alias("parent_list_idx"), F.col("shown").alias("_p")).join(ranks, "doc_id")
            rank_of = F.when(F.col("_p.kind") == "alpha", F.col("alpha")).when(F.col("_p.kind") == "roman", F.col("roman")).otherwise(F.col("decimal"))
            nxt = (rank_of + 1) % 3
            kind = F.when(F.col("decimal") == nxt, "decimal").when(F.col("alpha") == nxt, "alpha").otherwise("roman")
            p = p.where("_p IS NOT NULL").select("doc_id", "parent_list_idx", F.struct(
                kind.alias("kind"), F.coalesce("_p.case", F.lit("lower")).alias("case")).alias("derived"))
            cur = cur.join(p, ["doc_id", "parent_list_idx"], "left")
        cur = scan(cur, ["doc_id"], ["list_idx"], {"_own": last_value(F.col("own"))})
        # Before any own style, the first parent-derived style holds for the rest.
        cur = scan(cur, ["doc_id"], ["list_idx"], {"_n": running_sum(F.when(F.col("derived").isNotNull(), 1).otherwise(0))})
        cur = scan(cur, ["doc_id"], ["list_idx"], {"_first": last_value(
            F.when(F.col("derived").isNotNull() & (F.col("_n") == 1), F.col("derived")))})
        cur = bind(cur, {"info": F.coalesce("_own", "_first")})
        info = F.col("info")
        # A parent is later read by its class: an explicit type attribute decides the class it got.
        cls_style = F.when(info.isNotNull(), own_list_style(
            F.array_union(F.col("classes"), F.array(L.list_class(F.when(
                F.coalesce("type", F.lit("")) != "", F.col("type")).otherwise(_type_of(info))))),
            F.col("type"), F.lit(""))).otherwise(own_list_style(F.col("classes"), F.col("type"), F.lit("")))
        cur = bind(bind(cur, {"_cls": cls_style}), {"shown": _info(F.col("_cls"))})
        cur = durable(cur.select(*lists.columns, "info", "shown"))
        parents = cur
        done = cur if done is None else done.unionByName(cur)
    if done is None:
        return lists.withColumn("list_style", F.lit(None).cast("string"))
    style = (F.when(F.col("info.kind") == "decimal", "decimal")
             .when(F.col("info").isNotNull(), F.concat(F.when(F.col("info.case") == "lower", "lower-").otherwise("upper-"), F.col("info.kind"))))
    return done.select("doc_id", "list_idx", "depth", style.alias("list_style"))


def _type_of(info):
    low = info["case"] == "lower"
    return (F.when(info["kind"] == "alpha", F.when(low, "a").otherwise("A"))
            .when(info["kind"] == "roman", F.when(low, "i").otherwise("I")).otherwise("1"))
