"""Views over the order tables: rows built here, and plans that stay short."""
from pyspark.sql import functions as F

from catalog.fixtures import Source
from docweave.operators import headings as H, references as R


def source(spark, folder):
    rows = [(k, n, p, 1, 2.0, 3.0, "A", "O") for k, n, p in [(1, 1, 7), (1, 1, 7), (1, 2, 600000), (1, 2, 5), (51, 3, 1), (None, 1, 1), (None, 1, 2)]]
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, names).write.parquet(f"{folder}/lineitem.parquet")
    return Source(spark, str(folder))


def test_lines_are_numbered_in_one_exchange(spark, tmp_path):
    lines = source(spark, tmp_path)("fx_lines")
    plan = lines._jdf.queryExecution().executedPlan().toString()
    got = sorted((str(r["k"]), str(r["pos"]), r["pk"]) for r in lines.collect())
    assert got == sorted([("1", "4097", 7), ("1", "4098", 7), ("1", "4099", 5), ("1", "4100", 600000), ("51", "4097", 1), ("None", "None", 1), ("None", "None", 2)])
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_texts_are_worked_out_once(spark, tmp_path):
    rows = source(spark, tmp_path)("fx_numbered").where("text <> '' AND length(text) > 2 AND upper(text) <> 'X'")
    assert rows._jdf.queryExecution().executedPlan().toString().count("Faculty") == 1


def test_no_table_of_the_corpus_is_broadcast(spark, tmp_path):
    s = source(spark, tmp_path)
    ids = H.assign_ids(s("fx_numbered"))
    found = R.find_heading_by_full(s("fx_numbered").select("doc_id", F.col("text").alias("target")), H.heading_index(H.heading_keys(s("fx_numbered"))))
    for df in (ids, found):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 6 and ids.count() == 7
