"""Every twin on the smallest data, a sample of the families per run."""
import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SAMPLE = ["number_headings", "heading_keys", "permalink_flow", "extract_references", "match_references", "reattach_edits", "align_cells",
          "list_numbers", "read_heading_map", "stream_edits", "docx_paragraphs", "strip_front_matter", "reattach_edits_trusted"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "orders lineitem customer part pages events documents".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(names, data):
    return sorted(tuple(str(r[n]) for n in sorted(names)) for r in data)


@pytest.mark.parametrize("name", SAMPLE)
def test_twin(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(names, df.collect()) == rows(names, [dict(zip(names, r)) for r in cur.fetchall()])


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
