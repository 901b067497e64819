"""Word list numbering and style definitions as table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..session import durable
from .binding import bind
from .scan import count_since, row_number, scan

# Token type per Word number format.
FORMAT_TYPES = {
    "decimal": "decimal", "decimalzero": "decimal", "upperroman": "roman_upper", "lowerroman": "roman_lower",
    "upperletter": "alpha_upper", "lowerletter": "alpha_lower", "upperalpha": "alpha_upper", "loweralpha": "alpha_lower",
}


def format_type(fmt) -> Column:
    m = F.create_map(*[F.lit(x) for kv in FORMAT_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.lower(F.replace(F.coalesce(L._c(fmt), F.lit("")), F.lit(" "), F.lit("")))), F.lit(""))


def numbered_paragraphs(paragraphs: DataFrame, nums: DataFrame, levels: DataFrame, heading_fallback: bool = True) -> DataFrame:
    """Paragraphs that take part in a numbering scheme, with scheme and level. A missing
    level is the one whose linked style is the paragraph's style, then heading level - 1."""
    p = paragraphs.where("num_id IS NOT NULL").join(nums.select("doc_id", "num_id", "abs_id"), ["doc_id", "num_id"])
    p = p.join(levels.select("doc_id", "abs_id").distinct(), ["doc_id", "abs_id"], "left_semi")
    linked = (levels.where("p_style IS NOT NULL").groupBy("doc_id", "abs_id", F.lower("p_style").alias("_st"))
              .agg(F.min("ilvl").alias("_linked")))
    p = p.withColumn("_st", F.lower("style_id")).join(linked, ["doc_id", "abs_id", "_st"], "left")
    hl = F.col("heading_level")
    fallback = F.when(hl > 0, hl - 1) if heading_fallback else F.lit(None).cast("int")
    linked_ok = F.col("_linked") if not heading_fallback else F.when(hl > 0, F.col("_linked"))
    return (p.withColumn("ilvl", F.coalesce("ilvl", linked_ok, fallback).cast("int"))
            .where("ilvl IS NOT NULL").drop("_st", "_linked"))


def _scheme(levels: DataFrame) -> DataFrame:
    """One row per scheme with its (at most nine) level definitions as a map."""
    return levels.groupBy("doc_id", "abs_id").agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("ilvl").alias("k"), F.struct("num_fmt", "lvl_text", "start").alias("v")))).alias("defs"))


def _expand(template: Column, values: list[Column]) -> Column:
    out = F.regexp_replace(template, r"%(?:0+|\d{2,})(?!\d)", "")
    for i, v in enumerate(values):
        out = F.replace(out, F.lit(f"%{i + 1}"), F.coalesce(v, F.lit("")))
    return out


def list_numbers(numbered: DataFrame, levels: DataFrame) -> DataFrame:
    """Number text of every numbered paragraph. A counter per numbering id starts at its
    level's start value; a shallower item clears the deeper counters."""
    lv = F.col("ilvl")
    df = scan(numbered, ["doc_id", "num_id"], ["para_idx"], {f"_c{k}": count_since(lv == k, lv < k) for k in range(9)})
    df = df.join(_scheme(levels), ["doc_id", "abs_id"], "left")
    d = lambda k: F.try_element_at("defs", F.lit(k) if isinstance(k, int) else k)
    value = lambda k: F.when(F.col(f"_c{k}") > 0, F.col(f"_c{k}") - 1 + F.coalesce(d(k)["start"], F.lit(1)))
    values = [L.format_number(value(k), F.coalesce(d(k)["num_fmt"], F.lit("decimal"))) for k in range(9)]
    own = d(lv)
    text = F.when(F.coalesce(own["lvl_text"], F.lit("")) != "", L.strip(_expand(own["lvl_text"], values)))
    df = bind(df, {"num_text": F.coalesce(text, F.lit(""))})
    t = L.strip(F.coalesce("text", F.lit("")))
    add = ((F.col("num_text") != "") & (F.col("heading_level") > 0) & (t != "") & ~L.has_number_prefix("text")
           & ~F.lower(t).startswith(F.lower("num_text")))
    return df.select("doc_id", "para_idx", "num_id", "ilvl", "num_text",
                     F.when(add, F.concat("num_text", F.lit(" "), "text")).otherwise(F.col("text")).alias("text"))


def level_sequences(levels: DataFrame) -> DataFrame:
    """Token type sequence of every level: types of the levels its text refers to, else its
    own type."""
    df = levels.join(_scheme(levels), ["doc_id", "abs_id"])
    idx = F.transform(F.regexp_extract_all(F.coalesce("lvl_text", F.lit("")), F.lit(r"%(\d+)"), F.lit(1)), lambda x: x.try_cast("int") - 1)
    types = F.filter(F.transform(idx, lambda i: format_type(F.try_element_at("defs", i)["num_fmt"])), lambda x: x != "")
    own = format_type("num_fmt")
    seq = F.when(F.size(types) > 0, F.array_join(types, ">")).otherwise(own)
    return df.select("doc_id", "abs_id", "ilvl", seq.alias("sequence"), own.alias("own_type"))


def sequence_map_from_numbering(numbered: DataFrame, levels: DataFrame) -> DataFrame:
    """Heading level of the first numbered heading per sequence."""
    j = numbered.where("heading_level > 0").join(level_sequences(levels), ["doc_id", "abs_id", "ilvl"]).where("sequence <> ''")
    return j.groupBy("doc_id", "sequence").agg(F.min_by("heading_level", "para_idx").alias("level"))


def levels_from_numbering(numbered: DataFrame, levels: DataFrame, sequence_map: DataFrame, style_map: DataFrame) -> DataFrame:
    """Heading level by numbering: full sequence first, then last token type; 1-6 only."""
    j = numbered.where("heading_level > 0").join(level_sequences(levels), ["doc_id", "abs_id", "ilvl"], "left")
    j = j.withColumn("sequence", F.coalesce("sequence", F.lit("")))
    token = F.when(F.col("sequence") != "", F.element_at(F.split("sequence", ">"), -1)).otherwise(F.coalesce("own_type", F.lit("")))
    j = j.withColumn("token", token)
    j = j.join(sequence_map.select("doc_id", "sequence", F.col("level").alias("_sl")), ["doc_id", "sequence"], "left")
    j = j.join(style_map.select("doc_id", F.col("key").alias("token"), F.col("level").alias("_tl")), ["doc_id", "token"], "left")
    target = F.coalesce(F.nullif("_sl", F.lit(0)), F.nullif("_tl", F.lit(0)))
    return j.select("doc_id", "para_idx", "heading_level",
                    F.when(target.between(1, 6), target).otherwise(F.col("heading_level")).alias("new_level"))


def bullet_type(text) -> Column:
    t = F.coalesce(L._c(text), F.lit(""))
    return (F.when(t == "", "disc").when(t.rlike("[◦○o]"), "circle")
            .when(t.rlike("[▪■□▫◼◽]"), "square")
            .when(t.rlike("[–—-]"), "dash").otherwise("disc"))


def list_formats(numbered: DataFrame, levels: DataFrame) -> DataFrame:
    """First ordered and first bulleted format per level; missing levels up to 5 are filled
    from the default sequence of the first ordered format."""
    j = numbered.join(levels.select("doc_id", "abs_id", "ilvl", "num_fmt", "lvl_text", "start"), ["doc_id", "abs_id", "ilvl"])
    kind = F.when(F.coalesce("num_fmt", F.lit("decimal")) == "bullet", "unordered").otherwise("ordered")
    first = j.withColumn("kind", kind).groupBy("doc_id", "kind", "ilvl").agg(
        F.min_by(F.struct("num_fmt", "lvl_text", "start"), "para_idx").alias("f"))
    base = first.where("kind = 'ordered'").groupBy("doc_id").agg(F.min_by("f.num_fmt", "ilvl").alias("lead"))
    docs = numbered.select("doc_id").distinct().join(base, "doc_id", "left")
    lead = F.coalesce("lead", F.lit("decimal"))
    seq = (F.when(lead == "lowerLetter", F.array(F.lit("lowerLetter"), F.lit("lowerRoman"), F.lit("decimal")))
           .when(lead == "upperLetter", F.array(F.lit("upperLetter"), F.lit("upperRoman"), F.lit("decimal")))
           .when(lead == "lowerRoman", F.array(F.lit("lowerRoman"), F.lit("decimal"), F.lit("lowerLetter")))
           .when(lead == "upperRoman", F.array(F.lit("upperRoman"), F.lit("decimal"), F.lit("upperLetter")))
           .when(lead == "decimalZero", F.array(F.lit("decimalZero"), F.lit("lowerLetter"), F.lit("lowerRoman")))
           .otherwise(F.array(F.lit("decimal"), F.lit("lowerLetter"), F.lit("lowerRoman"))))
    grid = docs.select("doc_id", seq.alias("seq"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("ilvl"))
    o = first.where("kind = 'ordered'").select("doc_id", F.col("ilvl").cast("int").alias("ilvl"), "f")
    fill = F.get("seq", F.col("ilvl") % 3)
    default_text = F.concat(F.lit("%"), (F.col("ilvl") + 1).cast("string"), F.lit("."))
    ordered = grid.join(o, ["doc_id", "ilvl"], "full_outer").select(
        "doc_id", F.lit("ordered").alias("kind"), "ilvl", F.coalesce("f.num_fmt", fill).alias("format"),
        F.coalesce(F.nullif("f.lvl_text", F.lit("")), default_text).alias("lvl_text"),
        F.coalesce("f.start", F.lit(1)).alias("start"))
    u = first.where("kind = 'unordered'").select("doc_id", F.col("ilvl").cast("int").alias("ilvl"), bullet_type("f.lvl_text").alias("bt"))
    glyphs = F.array(*[F.lit(x) for x in ("disc", "circle", "square", "dash", "disc")])
    unordered = grid.drop("seq").join(u, ["doc_id", "ilvl"], "full_outer").select(
        "doc_id", F.lit("unordered").alias("kind"), "ilvl", F.coalesce("bt", F.get(glyphs, F.col("ilvl") % 5)).alias("format"),
        F.lit("").alias("lvl_text"), F.lit(1).alias("start"))
    return ordered.unionByName(unordered)


def list_examples(numbered: DataFrame, per_level: int = 3) -> DataFrame:
    """First items of each level (150 characters)."""
    df = scan(numbered, ["doc_id", "ilvl"], ["para_idx"], {"nth": row_number()})
    return df.where(F.col("nth") <= per_level).select("doc_id", "ilvl", "nth", F.substring(L.strip("text"), 1, 150).alias("text"))


def dangling_styles(uses: DataFrame, styles: DataFrame) -> DataFrame:
    """Used styles that are not defined, with their replacement."""
    repl = F.when(F.col("kind") == "p", "Normal").otherwise("DefaultParagraphFont")
    return (uses.select("doc_id", "kind", "style_id").join(styles.select("doc_id", "style_id"), ["doc_id", "style_id"], "left_anti")
            .distinct().withColumn("replacement", repl))


def style_id_diff(used: DataFrame, defined: DataFrame) -> DataFrame:
    """Used minus defined, as a set."""
    return used.select("doc_id", "style_id").subtract(defined.select("doc_id", "style_id"))


def orphan_numbering(nums: DataFrame, levels: DataFrame) -> DataFrame:
    """Numbering instances whose scheme is not defined."""
    return nums.join(levels.select("doc_id", "abs_id").distinct(), ["doc_id", "abs_id"], "left_anti")


def resolve_styles(styles: DataFrame, fields: list[str]) -> DataFrame:
    """Inherited fields: the first non-null value along the based-on chain; a chain that
    returns to a visited style stops. One join per inheritance step, on unfinished rows."""
    styles = durable(styles.select("doc_id", "style_id", "based_on", *fields))
    base = styles.select("doc_id", F.col("style_id").alias("_next"), F.col("based_on").alias("_base"),
                         *[F.col(f).alias(f"_p_{f}") for f in fields], F.lit(True).alias("_known"))
    cur = styles.select("doc_id", "style_id", F.col("based_on").alias("_next"), F.array("style_id").alias("chain"), *fields)
    done = None
    while True:
        live = F.coalesce(F.col("_next").isNotNull() & ~F.array_contains("chain", F.col("_next")), F.lit(False))
        # Rows that go on take the next style's values; all others have ended. A step is written once, so no later one joins it again.
        step = durable(cur.withColumn("_next", F.when(live, F.col("_next"))).join(base, ["doc_id", "_next"], "left"))
        ended = step.where("_known IS NULL").select("doc_id", "style_id", "chain", *fields)
        done = ended if done is None else done.unionByName(ended)
        cur = step.where("_known").select(
            "doc_id", "style_id", F.col("_base").alias("_next"), F.concat("chain", F.array("_next")).alias("chain"),
            *[F.coalesce(f, f"_p_{f}").alias(f) for f in fields])
        if cur.isEmpty():
            return done
