import random

from pyspark.sql import functions as F

from docweave.operators import edits as E
from docweave.operators import headings as H
from docweave.operators import lists as Li
from docweave.operators import references as R
from docweave.operators import scan as S
from docweave.operators import tables as T


def test_scan_equals_loop_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 7)
    rnd = random.Random(3)
    rows = [(d, p, rnd.random() < 0.4, rnd.random() < 0.15, rnd.choice([None, p])) for d in (1, 2, None) for p in range(60)]
    df = spark.createDataFrame(rows, "doc_id int, p int, c boolean, r boolean, v int")
    out = S.scan(df, ["doc_id"], ["p"], {"n": S.count_since(F.col("c") & ~F.col("r"), F.col("r")), "last": S.last_value(F.col("v"), inclusive=False),
                                        "k": S.row_number(), "hi": S.running_max(F.col("v"))}).collect()
    want = {}
    for d in (1, 2, None):
        n, last, k, hi = 0, None, 0, None
        for (_, p, c, r, v) in [x for x in rows if x[0] == d]:
            k += 1
            n = 0 if r else n + (1 if c else 0)
            hi = v if hi is None else (hi if v is None else max(hi, v))
            want[(d, p)] = (n, last, k, hi)
            last = last if v is None else v
    assert {(r.doc_id, r.p): (r.n, r["last"], r.k, r.hi) for r in out} == want


def test_scan_descending(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 4)
    df = spark.createDataFrame([(1, i, i if i % 5 == 0 else None) for i in range(23)], "doc_id int, p int, v int")
    out = S.scan(df, ["doc_id"], ["p"], {"nxt": S.last_value(F.col("v"), inclusive=False)}, descending=True)
    for r in out.collect():
        later = [i for i in range(r.p + 1, 23) if i % 5 == 0]
        assert r.nxt == (later[0] if later else None)


def greedy(bases):
    used, out = set(), []
    for b in bases:
        s, n = b, 1
        while s in used:
            s, n = f"{b}-{n}", n + 1
        used.add(s)
        out.append(s)
    return out


def test_unique_ids_equal_greedy(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 16)
    rnd = random.Random(11)
    pool = ["a", "a-1", "a-2", "a-3", "a-1-1", "a-1-2", "a-7", "b", "b-1", "c-x", "a-01", "a-1-1-1"]
    docs = {d: [rnd.choice(pool) for _ in range(rnd.randint(5, 60))] for d in range(40)}
    df = spark.createDataFrame([(d, i, b) for d, bs in docs.items() for i, b in enumerate(bs)], "doc_id long, ord int, base string")
    got = {}
    for r in H.unique_ids(df).orderBy("doc_id", "ord").collect():
        got.setdefault(r.doc_id, []).append(r.id)
    assert got == {d: greedy(bs) for d, bs in docs.items()}


def test_ids_stable_on_rerun(spark):
    h = spark.createDataFrame([(1, 0, 1, "Overview"), (1, 1, 1, "Overview"), (1, 2, 1, "Unique")], "doc_id long, ord int, level int, text string")
    first = H.assign_ids(h)
    assert [r.id for r in first.orderBy("ord").collect()] == ["overview", "overview-1", "unique"]
    again = H.assign_ids(h, H.stable_map(first))
    assert [r.id for r in again.orderBy("ord").collect()] == ["overview", "overview-1", "unique"]


def test_numbering_skips_numbered_headings(spark):
    h = spark.createDataFrame([(1, 0, 1, "A"), (1, 1, 3, "B"), (1, 2, 2, "1.9 Kept"), (1, 3, 2, "C"), (1, 4, 1, "D"), (1, 5, 2, "E")],
                              "doc_id long, ord int, level int, text string")
    out = [r.numbered_text for r in H.number_headings(h).orderBy("ord").collect()]
    assert out == ["Chapter 1 - A", "1.0.1 B", "1.9 Kept", "1.1 C", "Chapter 2 - D", "2.1 E"]


def test_heading_keys(spark):
    h = spark.createDataFrame([(1, 0, 1, "Chapter 1 - Administration"), (1, 1, 2, "1.1 Governance"), (1, 2, 3, "A Title"), (1, 3, 2, "IN GENERAL"), (1, 4, 2, "Plain")],
                              "doc_id long, ord int, level int, text string")
    keys = [r.key for r in H.heading_keys(h).orderBy("ord").collect()]
    assert keys == ["Chapter 1", "Chapter 1.1", "Chapter 1.1.A", "H2: IN GENERAL", "H2: Plain"]


def test_match_references(spark):
    refs = spark.createDataFrame([(1, 0, 0, "Chapter 1.D"), (1, 1, 0, "Chapter 2.D.2.d"), (1, 2, 0, "Chapter 99.A"), (1, 3, 0, "1.2.3")],
                                 "doc_id long, para_idx int, start int, label string")
    keys = spark.createDataFrame([(1, "Chapter 1.4")], "doc_id long, key string")
    got = {r.old_ref: (r.new_ref, r.matched) for r in R.match_references(refs, keys).collect()}
    assert got == {"Chapter 1.D": ("Chapter 1.4", True), "Chapter 2.D.2.d": ("Chapter 2.4.2.4", False)}


def test_extraction_guards(spark):
    text = "q1.2.3 no, 42.52.040 yes, Ph.D no, Section II.F.6 and See M.S.N."
    df = spark.createDataFrame([(1, 0, text)], "doc_id long, block_idx int, text string")
    rows = R.extract_references(df).orderBy("start").collect()
    assert [r.label for r in rows] == ["42.52.040", "Section II.F.6"]
    assert all(text[r.start:r.end] == r.label for r in rows)


def test_reattach_edits(spark):
    from docweave.functions import labels as L
    old = spark.createDataFrame([(1, 10, 5, "Section 1.A.2"), (1, 11, 5, "Section 1.A.2"), (1, 12, 0, "1.2.3")], "doc_id long, para_idx int, start int, label string")
    new = spark.createDataFrame([(1, 13, 5, "Section 1.A.2"), (1, 14, 5, "Section 1.A.2"), (1, 12, 0, "1.2.3"), (1, 20, 0, "1.2.3")], "doc_id long, para_idx int, start int, label string")
    ed = old.select("doc_id", L.ref_id("para_idx", "start", "label").alias("ref_id"), F.lit("reference_edits").alias("kind"), F.col("para_idx").cast("string").alias("value"))
    rows = {r.value: (r.status, r.new_ref_id.split("_")[1]) for r in E.reattach_edits(new, ed).collect()}
    assert rows == {"10": ("moved", "13"), "11": ("moved", "14"), "12": ("orphaned", "12")}
    total = E.reattach_summary(E.reattach_edits(new, ed)).first()
    assert total.kept + total.moved + total.orphaned == 3


def test_place_and_rebuild(spark):
    seg = spark.createDataFrame([(1, 0, 0, "Patents, Section IV.G.8, or Section IV.G.9, then Section IV.G.8 again.", False, None)],
                                "doc_id long, block_idx int, seg_idx int, text string, in_link boolean, href string")
    dec = spark.createDataFrame([(1, 0, "Section IV.G.8", "4.7.8", "#a", 1), (1, 0, "Section IV.G.9", "4.7.9", "#b", 0)],
                                "doc_id long, block_idx int, label string, display string, href string, occurrence int")
    text = R.rebuild_text(R.place_links(dec, seg), seg).first().text
    assert text == 'Patents, Section IV.G.8, or <a href="#b">4.7.9</a>, then <a href="#a">4.7.8</a> again.'


def test_table_grid_with_row_spans(spark):
    rows = [(0, 0, 1, 2), (0, 1, 2, 1), (0, 2, 1, 1), (1, 3, 1, 1), (1, 4, 1, 2), (2, 5, 1, 1), (2, 6, 1, 1), (3, 7, 1, 1)]
    df = spark.createDataFrame([(1, 0, r, c, cs, rs) for r, c, cs, rs in rows], "doc_id long, table_idx int, row_idx int, cell_idx int, colspan int, rowspan int")
    got = {r.cell_idx: r.col_idx for r in T.table_grid(df).collect()}
    assert got == {0: 0, 1: 1, 2: 3, 3: 1, 4: 2, 5: 0, 6: 1, 7: 0}


def test_numeric_columns(spark):
    vals = [["1/3 or more", "3"], ["3", "12"], ["x", "3*"], ["y", "9*"]]
    df = spark.createDataFrame([(1, 0, i, j, False, "td", t) for i, r in enumerate(vals) for j, t in enumerate(r)],
                               "doc_id long, table_idx int, row_idx int, col_idx int, in_thead boolean, tag string, text string")
    assert {r.col_idx: r.is_numeric for r in T.classify_numeric_columns(df).collect()} == {0: False, 1: True}


def test_list_styles(spark):
    df = spark.createDataFrame([(1, 0, None, 0, "A", [], ""), (1, 1, 0, 1, "", [], ""), (1, 2, 1, 2, "", [], "list-style-type: lower-roman"),
                                (1, 3, None, 0, "", [], ""), (1, 4, 3, 1, "", [], "")],
                               "doc_id long, list_idx int, parent_list_idx int, depth int, type string, classes array<string>, style string")
    got = {r.list_idx: r.list_style for r in Li.list_styles(df).collect()}
    assert got == {0: "upper-alpha", 1: "decimal", 2: "lower-roman", 3: "upper-alpha", 4: "decimal"}


def test_resolve_styles_reads_its_input_once(spark):
    from docweave.operators.numbering import resolve_styles
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        reads.add(1)
        yield from batches

    rows = [(1, "a", None, "F"), (1, "b", "a", None), (1, "c", "b", None), (1, "d", "d", None), (1, "e", "gone", "G"), (1, "f", "g", None), (1, "g", "f", "H"), (None, "h", "a", None)]
    schema = "doc_id long, style_id string, based_on string, font string"
    styles = spark.createDataFrame(rows, schema).coalesce(1).mapInArrow(seen, schema)
    out = {r.style_id: ("".join(r.chain), r.font) for r in resolve_styles(styles, ["font"]).collect()}
    assert out == {"a": ("a", "F"), "b": ("ba", "F"), "c": ("cba", "F"), "d": ("d", None), "e": ("e", "G"), "f": ("fg", "H"), "g": ("gf", "H"), "h": ("h", None)}
    assert reads.value == 1
