"""What the operators of this folder share: reading, shared folder, safe column names, words."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space. ``bytes.split()`` cuts at the same characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Only a local session may go without: it gets a folder
    of its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="llm-shared-"))
    return sc._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def durable(df: DataFrame, what: str = "step") -> DataFrame:
    """Written to the shared folder and read back: lineage ends here, and the rows outlive any executor."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever columns it came with."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def once(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated once per row, however often they are used above."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def in_slices(array, size: int, work, kind):
    """An Arrow array of ``work(values of a slice)`` for each slice of an Arrow array, so that few values are Python objects at a time. Memory that Arrow
    keeps after a batch goes back to the system, as idle workers of earlier stages stay alive."""
    import pyarrow as pa

    parts = [pa.array(work(array.slice(k, size).to_pylist()), kind) for k in range(0, len(array), size)]
    out = pa.concat_arrays(parts) if parts else pa.array([], kind)
    pa.default_memory_pool().release_unused()
    return out


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label): rows without id or label are left out, of several labels of one id the smallest holds."""
    return (labels.select("doc_id", F.col(column).alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
            .groupBy("doc_id").agg(F.min("label").alias("label")))


def sampling_rates(labels: DataFrame, column: str, learn: Column, bound: int) -> dict[int, float]:
    """Which share of the learning rows of each of the labels 0 and 1 ``labelled_sample`` picks; 1 for a label without rows."""
    counts = {r["label"]: r["count"] for r in one_label(labels, column).where(learn).where(F.col("label").isin(0, 1)).groupBy("label").count().collect()}
    return {value: min(1.0, bound / counts[value]) if counts.get(value) else 1.0 for value in (0, 1)}


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, learn: Column, bound: int) -> DataFrame:
    """(doc_id, text, label) of at most ``bound`` rows of each of the labels 0 and 1, those with the smallest hash of their id.
    Only ids of at most ``2 * bound`` rows are broadcast, and ids that are repeated in ``docs`` count once."""
    own = one_label(labels, column).where(learn)
    picked = None
    for value in (0, 1):
        part = own.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        picked = part if picked is None else picked.unionAll(part)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def crc_rest(divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor
