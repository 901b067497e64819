"""JSON maps and bundles: heading maps, sequence maps, manifests, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L

_MAP, _LIST = "map<string,string>", "array<string>"


def _array(c: Column) -> Column:
    return F.from_json(F.when(F.ltrim(c).startswith("["), c), _LIST)


def _object(c: Column) -> Column:
    return F.from_json(F.when(F.ltrim(c).startswith("{"), c), _MAP)


def read_heading_map(df: DataFrame, json_col: str = "raw") -> DataFrame:
    """(doc_id, signature, nth, id) from any of the four accepted JSON shapes: an object with
    "entries", a bare list of entries, signature to id, signature to list of ids. Signatures
    are normalised again and repeated ones append in file order. Bad JSON gives no rows."""
    raw = F.col(json_col)
    d = df.select("doc_id", _object(raw).alias("o"), _array(raw).alias("l"))
    listed = F.coalesce("l", _array(F.try_element_at("o", F.lit("entries"))))
    entry = lambda e: F.struct(F.try_element_at(_object(e), F.lit("signature")).alias("sig"), F.coalesce(
        F.try_element_at(_object(e), F.lit("ids")), F.try_element_at(_object(e), F.lit("id"))).alias("ids"))
    flat = F.transform(F.map_entries("o"), lambda kv: F.struct(kv["key"].alias("sig"), kv["value"].alias("ids")))
    rows = d.select("doc_id", F.posexplode(F.when(listed.isNotNull(), F.transform(listed, entry)).otherwise(flat)).alias("pos", "e"))
    ids = F.coalesce(_array(F.col("e.ids")), F.array("e.ids"))
    rows = rows.select("doc_id", "pos", L.heading_signature("e.sig").alias("signature"), F.posexplode(ids).alias("sub", "id"))
    rows = rows.withColumn("id", L.strip("id")).where("signature <> '' AND id <> ''")
    from ..operators.scan import row_number, scan

    # Positions inside one JSON cell; the chunk follows the entry position.
    return scan(rows, ["doc_id", "signature"], ["pos", "sub"], {"nth": row_number()}).select("doc_id", "signature", "nth", "id")


def read_sequence_map(df: DataFrame, json_col: str = "raw") -> DataFrame:
    """(doc_id, sequence, level) from the list form or the "a>b" object form; the last entry
    of a sequence wins, entries without a whole level are dropped."""
    raw = F.col(json_col)
    d = df.select("doc_id", _object(raw).alias("o"), _array(raw).alias("l"))
    listed = F.transform("l", lambda e: F.struct(
        F.array_join(_array(F.try_element_at(_object(e), F.lit("sequence"))), ">").alias("sequence"),
        F.try_element_at(_object(e), F.lit("level")).alias("level")))
    keyed = F.transform(F.map_entries("o"), lambda kv: F.struct(
        F.array_join(F.filter(F.split(kv["key"], ">"), lambda p: p != ""), ">").alias("sequence"), kv["value"].alias("level")))
    rows = d.select("doc_id", F.posexplode(F.coalesce(listed, keyed)).alias("pos", "e"))
    rows = rows.select("doc_id", "pos", "e.sequence", F.floor(F.col("e.level").try_cast("double")).cast("int").alias("level"))
    return rows.where("sequence <> '' AND level IS NOT NULL").groupBy("doc_id", "sequence").agg(F.max_by("level", "pos").alias("level"))


def sequence_map_json(seq: DataFrame) -> DataFrame:
    """One JSON entry per row: {"sequence": [...], "level": n}."""
    return seq.select("doc_id", "sequence", F.to_json(F.struct(F.split("sequence", ">").alias("sequence"), "level")).alias("entry"))


def stable_map_json(stable: DataFrame) -> DataFrame:
    """Heading map as one JSON entry per recorded id, in document order. Entries of a
    signature repeat, which the reader appends, so no document is gathered in one row."""
    return stable.select("doc_id", "signature", "nth", F.to_json(F.struct("signature", "id")).alias("entry"))


def write_stable_map(stable: DataFrame, path: str) -> None:
    """JSON lines, range-partitioned so that one long document spreads over many files."""
    (stable.select("doc_id", "signature", "nth", "id").repartitionByRange("doc_id", "signature", "nth")
     .sortWithinPartitions("doc_id", "signature", "nth").write.mode("overwrite").json(path))


def read_stable_map(spark, path: str, id_type: str = "long") -> DataFrame:
    return spark.read.schema(f"doc_id {id_type}, signature string, nth long, id string").json(path)


def manifest_json(runs: DataFrame) -> DataFrame:
    """One manifest document per run row."""
    cols = [c for c in runs.columns if c != "doc_id"]
    return runs.select("doc_id", F.to_json(F.struct(*cols)).alias("manifest"))


def write_manifest(runs: DataFrame, path: str) -> None:
    manifest_json(runs).write.mode("overwrite").json(path)


def write_toc(lines: DataFrame, path: str) -> None:
    """Contents lines as text files, in order inside each file and across file names."""
    (lines.repartitionByRange("doc_id", "part", "ord").sortWithinPartitions("doc_id", "part", "ord")
     .select(F.concat_ws("\t", F.col("doc_id").cast("string"), "line").alias("value")).write.mode("overwrite").text(path))


def read_bundles(parts: DataFrame) -> dict[str, DataFrame]:
    """Manifests, long-form edits and stable maps of bundle parts (doc_id, part, content).
    The map file of a bundle is preferred over the copy in its manifest."""
    from ..functions.fixed import EDIT_KINDS

    p = parts.withColumn("raw", F.decode("content", "UTF-8"))
    man = p.where("part = 'manifest.json'").withColumn("m", _object(F.col("raw")))
    g = lambda k: F.try_element_at("m", F.lit(k))
    files = _object(g("files"))
    manifests = man.select("doc_id", g("document").alias("document"), g("doc_hash").alias("doc_hash"), g("manual_type").alias("manual_type"),
                           g("toc_depth").try_cast("int").alias("toc_depth"), g("mapping_mode").alias("mapping_mode"),
                           F.try_element_at(files, F.lit("docx")).alias("docx"), F.try_element_at(files, F.lit("edits")).alias("edits"))
    named = manifests.select("doc_id", F.col("edits").alias("part"))
    e = p.join(named, ["doc_id", "part"], "left_semi").withColumn("m", _object(F.col("raw")))
    long = e.select("doc_id", F.inline(F.array(*[
        F.struct(F.lit(k).alias("kind"), _object(g(k)).alias("vals")) for k in EDIT_KINDS])))
    edits = long.select("doc_id", "kind", F.explode("vals").alias("ref_id", "value"))
    filed = p.where("part = 'stable_heading_map.json'").select("doc_id", "raw")
    copy = man.select("doc_id", g("stable_heading_map").alias("raw")).join(filed.select("doc_id"), "doc_id", "left_anti")
    return {"manifests": manifests, "edits": edits, "stable_map": read_heading_map(filed.unionByName(copy).where("raw IS NOT NULL"))}
