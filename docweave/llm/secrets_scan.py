"""Secrets in texts, in Spark expressions only: three fixed patterns and a battery of randomness tests.

Every run of 20 or more credential characters is a candidate. Its encoding is inferred (hex, lower- or upper-case letters with
digits, base64 and its URL form), then it takes three tests against "its symbols are drawn evenly and independently": the
chi-squared test of the alphabet, the runs test around the middle of the alphabet and the serial correlation of neighbours.
A candidate passes the battery if the sum of the squared test scores stays under the chi-squared limit.

Passing is easy for a short run, so each candidate also needs evidence against being ordinary text: the likelihood ratio of
"even" against a letter model of text. Under the text model a ratio of ``2**b`` or more has probability ``2**-b`` at most, so
``2**-b`` is a p-value that takes the length into account. Over all candidates of the table the Benjamini-Hochberg rule picks
the limit for ``b`` at false-discovery rate ``fdr``. Only a histogram of p-values (512 bins at most) leaves the tasks.

Cases: null and empty texts have no spans; spans of the fixed patterns are always kept, and candidates that overlap one of them
are left to it; repeated rows are scanned one by one and count one by one in the histogram; an empty table gives no rows.
Characters U+0001 and U+0002 in a text, which serve as
fences, are masked first; they match no pattern either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, once

# The three base patterns, in the order in which kinds are listed, with the length their match needs.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "random"]
# Letters of running text per thousand, a to z; other credential characters inside a text run; the share of
# capitals inside a run of both cases.
LETTERS = [82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1]
DIGIT, OTHER, CAPITALS = 8, 8, 0.05
#: Limit of the sum of three squared scores: chi-squared with 3 degrees of freedom, upper share 0.001.
BATTERY = 16.27
#: Evidence is counted in quarters of a bit, up to this many.
BINS = 511
_SPANS = "array<struct<start:int,kind:int,stop:int,text:string>>"


def _fields(**cols: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in cols.items()])


def spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """Leftmost non-overlapping matches as (start, kind, stop, text) in code points. Matches are fenced, the text is split at the
    fences, and one pass adds up the lengths; the pass works in blocks, so that its cost stays near the number of matches."""
    inside = lambda p: F.substring_index(p, "\x02", 1)
    fenced = F.regexp_replace(text, f"({pattern})", "\x01$1\x02")

    def walk(parts: Column) -> Column:
        size = F.size(parts) - 1
        step = F.greatest(F.lit(1), F.ceil(F.sqrt(size)).cast("int"))

        def add(state: Column, i: Column) -> Column:
            # The part in front of a match ends in the text between it and the match before.
            before, found = F.get(parts, i - 1), inside(F.get(parts, i))
            gap = F.when(i == 1, F.length(before)).otherwise(F.length(before) - F.length(inside(before)) - 1)
            start = state["at"] + gap
            one = _fields(start=start, kind=F.lit(kind), stop=start + F.length(found), text=found)
            return _fields(at=start + F.length(found), got=F.when(keep(found), F.concat(state["got"], F.array(one))).otherwise(state["got"]))

        def block(state: Column, first: Column) -> Column:
            done = F.aggregate(F.sequence(first, F.least(first + step - 1, size)), _fields(at=state["at"], got=F.array().cast(_SPANS)), add)
            return let(done, lambda d: _fields(at=d["at"], got=F.concat(state["got"], F.array(d["got"]))))

        starts = F.when(size > 0, F.sequence(F.lit(1), size, step)).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.aggregate(starts, _fields(at=F.lit(0), got=F.array().cast(f"array<{_SPANS}>")), block, lambda s: s["got"]))

    return let(F.split(fenced, "\x01"), walk)


def base_spans(text: Column) -> list[Column]:
    """For access and hex, a match of the pattern that is too short takes no longer match away, so the least length is part of the
    pattern; for assign it can, so the match is dropped afterwards."""
    return [spans(text, ASSIGN.replace("([A-Z", "(?:[A-Z"), 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6),
            spans(text, ACCESS[:-1] + "{16,}", 1, lambda m: F.lit(True)),
            spans(text, HEX[:-1] + "{24,}", 2, lambda m: F.lit(True))]


def alphabet(token: Column) -> Column:
    """Size of the inferred alphabet; 0 for decimal numbers and runs that no encoding explains."""
    has = token.rlike
    letters = has("[A-Za-z]")
    return (F.when(~letters, 0).when(has("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(has("[a-z]") & has("[A-Z]"), 64)
            .when(has("[+/_-]"), 0).when(has("[0-9]"), 36).otherwise(26))


def _symbol(char: Column, size: Column) -> Column:
    code = F.ascii(char)
    wide = F.when(code.between(65, 90), code - 65).when(code.between(97, 122), code - 71).when(code.between(48, 57), code + 4).when(char.isin("+", "-"), 62).otherwise(63)
    letter = F.ascii(F.lower(char)) - 97
    return F.when(size == 64, wide).when(code.between(48, 57), code - 48).when(size == 26, letter).otherwise(letter + 10).cast("double")


def _surprise(char: Column, size: Column) -> Column:
    """Bits of a character under the text model. Where both cases occur, text has few capitals."""
    letters = F.array(*[F.lit(float(x)) for x in LETTERS])
    letter = F.element_at(letters, F.ascii(F.lower(char)) - 96)
    per_thousand = F.when(char.rlike("[A-Z]") & (size == 64), letter * CAPITALS).when(char.rlike("[A-Za-z]"), letter).when(char.rlike("[0-9]"), F.lit(float(DIGIT))).otherwise(F.lit(float(OTHER)))
    return F.log2(1000.0 / per_thousand)


def tested(token: Column) -> Column:
    """Struct of a candidate: size of its alphabet, scores chi2, runs and serial, passed (the battery), evidence (quarter bits)."""
    add = lambda s, v: s + v
    zero = F.lit(0.0)

    def numbers(t: Column) -> Column:
        return _fields(size=t["size"], chars=t["chars"], v=F.transform(t["chars"], lambda c: _symbol(c, t["size"])), n=F.size(t["chars"]).cast("double"), a=F.greatest(t["size"], F.lit(2)).cast("double"))

    def sums(t: Column) -> Column:
        v = t["v"]
        mean = F.aggregate(v, zero, add) / t["n"]
        neighbours = F.arrays_zip(F.slice(v, 1, F.size(v) - 1).alias("x"), F.slice(v, 2, F.size(v) - 1).alias("y"))
        squares = F.aggregate(F.array_distinct(v), zero, lambda s, x: s + F.pow(F.size(F.filter(v, lambda y: y == x)).cast("double"), F.lit(2.0)))
        return let(mean, lambda m: _fields(
            size=t["size"], n=t["n"], a=t["a"], squares=squares, ones=F.size(F.filter(v, lambda x: x >= t["a"] / 2)).cast("double"),
            changes=1.0 + F.size(F.filter(neighbours, lambda p: (p["x"] >= t["a"] / 2) != (p["y"] >= t["a"] / 2))),
            spread=F.aggregate(v, zero, lambda s, x: s + (x - m) * (x - m)), lagged=F.aggregate(neighbours, zero, lambda s, p: s + (p["x"] - m) * (p["y"] - m)),
            surprise=F.aggregate(t["chars"], zero, lambda s, c: s + _surprise(c, t["size"]))))

    def scores(t: Column) -> Column:
        n, a = t["n"], t["a"]
        chi2 = (a / n * t["squares"] - n - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n)
        pairs = 2 * t["ones"] * (n - t["ones"])
        var = pairs * (pairs - n) / (n * n * (n - 1))
        runs = F.when(var > 0, (t["changes"] - pairs / n - 1) / F.sqrt(F.when(var > 0, var))).otherwise(F.lit(99.0))
        serial = F.when(t["spread"] > 0, (t["lagged"] / F.when(t["spread"] > 0, t["spread"]) + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
        return _fields(size=t["size"], chi2=chi2, runs=runs, serial=serial, bits=t["surprise"] - n * F.log2(a))

    def verdict(t: Column) -> Column:
        total = F.pow(F.greatest(t["chi2"], zero), F.lit(2.0)) + t["runs"] * t["runs"] + t["serial"] * t["serial"]
        return _fields(size=t["size"], chi2=t["chi2"], runs=t["runs"], serial=t["serial"], passed=(t["size"] > 0) & (total <= BATTERY),
                       evidence=F.least(F.lit(BINS), F.greatest(F.lit(0), F.floor(4 * t["bits"]))).cast("int"))

    start = _fields(size=alphabet(token), chars=F.split(F.regexp_replace(token, "(?<=.)=+$", ""), ""))
    return let(let(let(let(start, numbers), sums), scores), verdict)


def evidence_limit(histogram: list[tuple[int, int]], fdr: float) -> int:
    """Benjamini-Hochberg on binned p-values ``2**(-bin/4)``: the smallest bin whose p-value is at most fdr x (share of candidates at
    or above it); one more than the last bin if none is."""
    total, above, limit = sum(c for _, c in histogram), 0, BINS + 1
    for bin_, count in sorted(histogram, reverse=True):
        above += count
        if 2.0 ** (-bin_ / 4) <= fdr * above / total:
            limit = bin_
    return limit


def limit_of(docs: DataFrame, fdr: float) -> int:
    """The limit for all candidates of all rows; at most 512 counts reach the driver."""
    tokens = docs.select(F.explode(F.regexp_extract_all("text", F.lit(CANDIDATE), 0)).alias("token"))
    rows = tokens.select(tested(F.col("token")).alias("t")).where("t.size > 0").groupBy("t.evidence").count().collect()
    return evidence_limit([(r["evidence"], r["count"]) for r in rows], fdr)


def secret_spans(docs: DataFrame, fdr: float = 0.01) -> DataFrame:
    """doc_id, base (spans of the three patterns) and spans (all), each an array of (start, kind, stop, text) in order; one row per
    row of docs."""
    limit = limit_of(docs, fdr)
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", F.when(text.rlike("[\x01\x02]"), F.translate(text, "\x01\x02", "\x03\x03")).otherwise(text).alias("text"))
    out = once(out, {"base": F.array_sort(F.concat(*base_spans(F.col("text")))), "more": spans(F.col("text"), CANDIDATE, 3, lambda m: F.lit(True))})
    free = F.filter("more", lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    added = F.filter(free, lambda s: let(tested(s["text"]), lambda t: t["passed"] & (t["evidence"] >= limit)))
    return out.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, hash of the base spans, and all spans as text."""
    def listed(column: str) -> Column:
        kinds = F.array(*[F.lit(k) for k in KINDS])
        return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", *map(count, range(3)), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
