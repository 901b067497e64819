"""Session and checkpoint helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and local runs; on a cluster pass your own session instead."""
    return (SparkSession.builder.master(f"local[{cores}]").appName("docweave")
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .config("spark.driver.memory", memory)
            .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
            .getOrCreate())


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster in ``spark.checkpoint.dir`` or set on the context. Only a session in one process (master
    ``local``) may go without and gets a folder of its own."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="docweave-ckpt-")
    sc.setCheckpointDir(path)
    return path


#: Written tables by session, for ``drop_written``.
_WRITTEN: dict[int, list[str]] = {}


def drop_written(spark: SparkSession) -> int:
    """Delete the tables that ``durable`` has written in this session, once their results are no longer read."""
    paths, fs = _WRITTEN.pop(id(spark), []), spark._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        fs(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs(path), True)
    return len(paths)


def durable(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder once and go on from there: the rows survive lost
    executors, are not computed again per use, and keep size statistics."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.setdefault(id(spark), []).append(path)
    return spark.read.schema(df.schema).parquet(path)
