"""Label and heading text functions, all built from native Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as K

U = "(?U)"
IU = "(?iU)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: What a pattern with U takes for white space.
WHITE = "\t\n\x0b\f\r \x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c) -> Column:
    """Trim Unicode whitespace on both ends."""
    return F.btrim(_c(c), F.lit(WHITE))


def has(c, pattern: str, ignore_case: bool = False) -> Column:
    return _c(c).rlike((IU if ignore_case else U) + pattern)


def words(c) -> Column:
    """Number of whitespace-separated words."""
    s = strip(c)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, U + r"\s+")))


def _first(whens, otherwise):
    """First matching (condition, value) pair."""
    return reduce(lambda acc, cv: F.when(cv[0], cv[1]).otherwise(acc), reversed(list(whens)), otherwise)


def normalize_ws(c) -> Column:
    """Unicode spaces become a plain space, zero-width characters disappear."""
    return F.translate(_c(c), K.SPACE_CHARS + K.ZERO_WIDTH, " " * len(K.SPACE_CHARS))


def normalize_nbsp(c) -> Column:
    return F.translate(_c(c), "\u00a0" + K.ZERO_WIDTH, " ")


def collapse_ws(c) -> Column:
    return strip(F.regexp_replace(F.translate(F.coalesce(_c(c), F.lit("")), "\u00a0", " "), U + r"\s+", " "))


def heading_signature(c) -> Column:
    s = F.lower(strip(F.regexp_replace(F.coalesce(_c(c), F.lit("")), U + r"\s+", " ")))
    return F.regexp_replace(s, "[^a-z0-9 ]+", "")


def fulltext_key(c) -> Column:
    """Comparison form used when a heading is looked up by its whole text."""
    return F.regexp_replace(F.lower(collapse_ws(c)), U + r"[^a-z0-9\s]", "")


def _spelled_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in K.SPELLED.items() for x in kv])


def normalize_heading_ref(c) -> Column:
    s = strip(F.regexp_replace(collapse_ws(c), r"[.\-:—–]+$", ""))
    pat = IU + r"^(Chapter|Section)\s+([A-Za-z]+)\b(.*)$"
    number = F.try_element_at(_spelled_map(), F.lower(F.regexp_extract(s, pat, 2)))
    spelled = F.concat(F.regexp_extract(s, pat, 1), F.lit(" "), number.cast("string"), F.regexp_extract(s, pat, 3))
    return F.when(number.isNotNull(), spelled).otherwise(s)


def manual_prefix(manual_type) -> Column:
    t = F.lower(strip(F.coalesce(_c(manual_type), F.lit(""))))
    return F.when(t.isin(*K.SECTION_TYPES), "Section").otherwise("Chapter")


def ensure_prefixed(c, manual_type) -> Column:
    s = F.coalesce(_c(c), F.lit(""))
    return F.when(s == "", "").when(has(s, K.LABEL_WORD, True), strip(s)).otherwise(
        F.concat(manual_prefix(manual_type), F.lit(" "), strip(s)))


def canonical_label(c, manual_type) -> Column:
    """Normalised label that carries its Chapter/Section word."""
    return ensure_prefixed(normalize_heading_ref(c), manual_type)


def drop_label_word(c) -> Column:
    return F.regexp_replace(_c(c), IU + K.LABEL_WORD, "")


def roman_to_int(c) -> Column:
    """Lenient Roman value: sums right to left, -1 when a character is not Roman."""
    up = F.upper(_c(c))
    chars = F.filter(F.split(F.reverse(up), ""), lambda x: x != "")
    value = lambda x: _first(
        [(x == k, F.lit(v)) for k, v in
         {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items()], F.lit(0))
    state = F.struct(F.lit(0).alias("total"), F.lit(0).alias("top"))
    total = F.aggregate(
        chars, state,
        lambda a, x: F.when(value(x) < a["top"], F.struct((a["total"] - value(x)).alias("total"), a["top"].alias("top")))
        .otherwise(F.struct((a["total"] + value(x)).alias("total"), value(x).alias("top"))),
        lambda a: a["total"])
    return F.when(up.rlike("^[IVXLCDM]+$"), total).otherwise(F.lit(-1))


def int_to_roman(c) -> Column:
    n = _c(c).cast("int")
    digit = lambda table, unit: F.element_at(
        F.array(*[F.lit(x) for x in table]), (F.floor(n / unit) % 10).cast("int") + 1)
    return F.when(n <= 0, "").otherwise(F.concat(
        F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")),
        digit(["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"], 100),
        digit(["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"], 10),
        digit(["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"], 1)))


def int_to_letters(c, upper: bool = True) -> Column:
    base = 65 if upper else 97
    n = _c(c).cast("long")
    start = F.struct(n.alias("n"), F.lit("").alias("s"))
    step = lambda a, _: F.when(a["n"] > 0, F.struct(
        F.floor((a["n"] - 1) / 26).cast("long").alias("n"),
        F.concat(F.char(F.lit(base) + (a["n"] - 1) % 26), a["s"]).alias("s"))).otherwise(a)
    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), start, step, lambda a: a["s"])


def format_number(value, fmt) -> Column:
    v, f = _c(value), _c(fmt)
    return (F.when(f == "lowerLetter", int_to_letters(v, False))
            .when(f == "upperLetter", int_to_letters(v, True))
            .when(f == "lowerRoman", F.lower(int_to_roman(v)))
            .when(f == "upperRoman", int_to_roman(v))
            .otherwise(v.cast("string")))


def _letter_value(p: Column) -> Column:
    return F.ascii(F.upper(p)) - 64


def convert_numbering(c) -> Column:
    """Old lettered label to decimal, e.g. ``Chapter 1.D.4`` to ``Chapter 1.4.4``."""
    src = _c(c)
    pat = IU + r"^(Chapter|Section)\s+(.+?)(?:\s+[-–—:]|$)"
    prefix = F.regexp_extract(src, pat, 1)
    body = strip(F.regexp_extract(src, pat, 2))
    head = F.split(body, r"\.").getItem(0)
    spelled = F.try_element_at(_spelled_map(), F.lower(strip(head)))
    body = F.when(spelled.isNotNull(),
                  F.concat(spelled.cast("string"), F.substr(body, F.length(head) + 1))).otherwise(body)
    body = F.regexp_replace(body, U + r"(\d)([A-Za-z])", "$1.$2")
    body = F.regexp_replace(body, U + r"([A-Za-z])(\d)", "$1.$2")

    def part(raw, i):
        p = strip(raw)
        rv = roman_to_int(p)
        is_roman = p.rlike("(?i)^[IVXLCDM]+$")
        single = p.rlike(U + r"^\p{L}$")
        return (F.when(is_roman & (i == 0) & (rv > 0) & (rv <= 20), rv.cast("string"))
                .when(is_roman & (i > 0) & (F.length(p) > 1) & (rv > 0), rv.cast("string"))
                .when(single, _letter_value(p).cast("string"))
                .otherwise(p))

    parts = F.filter(F.transform(F.split(body, r"\."), part), lambda p: p != "")
    return F.when(prefix == "", src).otherwise(F.concat(prefix, F.lit(" "), F.array_join(parts, ".")))


def full_roman_numbering(c) -> Column:
    """Variant that reads every part as Roman first (used only as a match candidate)."""
    src = _c(c)
    pat = IU + r"^(Chapter|Section)\s+(.+)$"
    prefix = F.initcap(F.lower(F.regexp_extract(src, pat, 1)))
    parts = F.filter(F.transform(F.split(strip(F.regexp_extract(src, pat, 2)), r"\."), strip), lambda p: p != "")
    conv = F.transform(parts, lambda p: F.when(roman_to_int(p) > 0, roman_to_int(p).cast("string"))
                       .when(p.rlike(U + r"^\p{L}$"), _letter_value(p).cast("string")).otherwise(p))
    return F.when((prefix != "") & (F.size(conv) > 0),
                  F.concat(prefix, F.lit(" "), F.array_join(conv, ".")))


def heading_sort_key(c) -> Column:
    """Orderable key: numbers before text at each position, empty keys last."""
    key = strip(F.coalesce(_c(c), F.lit("")))
    rest = F.when(key.rlike(IU + r"^(?:Chapter|Section)\s+.+$"), drop_label_word(key)).otherwise(key)
    parts = F.filter(F.split(F.translate(rest, "-", "."), r"\."), lambda p: p != "")
    item = lambda tag, n, s: F.struct(F.lit(tag).alias("tag"), n.cast("long").alias("n"), s.cast("string").alias("s"))
    none_s = F.lit(None).cast("string")

    def one(p):
        rv = roman_to_int(p)
        return (F.when(rv > 0, item(0, rv, none_s))
                .when(p.rlike(U + r"^\d+$"), item(0, p.try_cast("long"), none_s))
                .when(p.rlike(U + r"^\p{L}$"), item(0, _letter_value(p), none_s))
                .otherwise(item(1, F.lit(None), F.lower(p))))

    return F.when(F.size(parts) > 0, F.transform(parts, one)).otherwise(
        F.array(item(2, F.lit(None), F.lower(key))))


def _slug_tail(c) -> Column:
    s = F.regexp_replace(c, U + r"[^\w\s-]", "")
    s = F.regexp_replace(s, U + r"[\s_]+", "-")
    return F.substring(F.lower(F.regexp_replace(s, "^-+|-+$", "")), 1, 50)


def heading_slug(c) -> Column:
    s = F.regexp_replace(_c(c), IU + K.SLUG_LABEL, "")
    return _slug_tail(F.regexp_replace(s, IU + K.SLUG_DOTTED, ""))


def scrape_slug(c, drop_digits: bool = False) -> Column:
    s = _c(c)
    return _slug_tail(F.regexp_replace(s, U + r"^[\d\.\s]+", "") if drop_digits else s)


def client_slug(c) -> Column:
    s = F.lower(F.coalesce(_c(c), F.lit("")))
    s = F.regexp_replace(s, r"^(.*?)chapter\s+\w+\s*[–—-]\s*", "$1")
    s = F.trim(F.regexp_replace(s, r"[^\w\s.-]", ""))
    s = F.regexp_replace(F.regexp_replace(s, r"\s+", "-"), "-+", "-")
    return F.regexp_replace(s, "^-+|-+$", "")


def strip_heading_prefix(c) -> Column:
    """struct(title, prefix): the number or label in front of a heading is cut off.

    The prefix is found on whitespace-normalised text; the cut counts only characters
    that survive normalisation, so zero-width characters inside the prefix go with it.
    """
    src = _c(c)
    found = F.regexp_extract(normalize_ws(src), U + "(" + K.HEADING_PREFIX + ")", 1)
    n = F.length(found)
    zw = K.ZERO_WIDTH
    cut = F.concat(F.lit(f"^(?:[{zw}]*[^{zw}]){{"), n.cast("string"), F.lit("}"))
    title = (F.when(n == 0, src)
             .when(src.rlike(f"[{zw}]"), F.regexp_replace(src, F.concat(F.lit("(?s)"), cut), F.lit("")))
             .otherwise(F.substr(src, n + 1)))
    return F.struct(title.alias("title"), strip(found).alias("prefix"))


def strip_label_prefix(c) -> Column:
    s = drop_label_word(strip(F.coalesce(_c(c), F.lit(""))))
    return strip(F.regexp_replace(s, IU + K.LABEL_BODY, ""))


def heading_tokens(c) -> Column:
    seq = F.regexp_extract(strip(normalize_ws(c)), U + K.HEADING_INFER, 1)
    return F.filter(F.transform(F.split(seq, r"\."), strip), lambda p: p != "")


def style_tokens(c) -> Column:
    prefix = F.regexp_extract(normalize_ws(c), U + "(" + K.HEADING_PREFIX + ")", 1)
    prefix = strip(F.regexp_replace(prefix, IU + r"^(?:Chapter|Section)\s+", ""))
    prefix = strip(F.regexp_replace(prefix, U + r"[:.\-\s]+$", ""))
    return F.filter(F.split(prefix, U + r"[.\s]+"), lambda p: p != "")


def token_type(t: Column) -> Column:
    return (F.when(t.rlike(U + r"^\d+$"), "decimal")
            .when(t.rlike("^[ivxlcdm]+$"), "roman_lower")
            .when(t.rlike("^[IVXLCDM]+$"), "roman_upper")
            .when(t.rlike(U + r"^\p{L}+$") & (F.upper(t) == t), "alpha_upper")
            .when(t.rlike(U + r"^\p{L}+$"), "alpha_lower")
            .otherwise(""))


def token_types(tokens) -> Column:
    return F.transform(_c(tokens), token_type)


def styled_token_type(token, n_parts, style_map, prefer_roman) -> Column:
    """Type of the last token when a style map says which families are in use."""
    t, m = _c(token), _c(style_map)
    keys = F.map_keys(m)
    alpha = F.array_contains(keys, "alpha_lower") | F.array_contains(keys, "alpha_upper")
    roman = F.array_contains(keys, "roman_lower") | F.array_contains(keys, "roman_upper")
    low = F.lower(t) == t
    as_roman = F.when(low, "roman_lower").otherwise("roman_upper")
    as_alpha = F.when(low, "alpha_lower").otherwise("alpha_upper")
    deep = _c(prefer_roman) | (_c(n_parts) >= 5)
    return (F.when(t.rlike(U + r"^\d+$"), "decimal")
            .when(~t.rlike("(?i)^[a-z]+$"), "")
            .when(roman & ~alpha, as_roman)
            .when(alpha & ~roman, as_alpha)
            .when(alpha & roman, F.when(deep & t.rlike("(?i)^[ivxlcdm]+$"), as_roman)
                  .when(F.length(t) == 1, as_alpha).otherwise(as_roman))
            .otherwise(""))


def has_number_prefix(c) -> Column:
    s = strip(normalize_ws(F.coalesce(_c(c), F.lit(""))))
    return reduce(lambda a, b: a | b, [has(s, p, True) for p in K.NUMBER_PREFIX])


def bookmark_id(c) -> Column:
    s = F.coalesce(_c(c), F.lit(""))
    clean = F.regexp_replace(s, "[^A-Za-z0-9_]", "_")
    return F.when(s == "", "b_1").when(clean.rlike("^[A-Za-z]"), clean).otherwise(F.concat(F.lit("b_"), clean))


def export_anchor_id(c) -> Column:
    clean = F.substring(F.regexp_replace(_c(c), "[^a-zA-Z0-9_]", "_"), 1, 40)
    return F.when(clean.rlike(r"^\d"), F.concat(F.lit("h_"), clean)).otherwise(clean)


def label_hash(label) -> Column:
    return F.substring(F.md5(F.encode(_c(label), "UTF-8")), 1, 8)


def ref_id(para, start, label) -> Column:
    return F.concat(F.lit("ref_"), _c(para).cast("string"), F.lit("_"), _c(start).cast("string"),
                    F.lit("_"), label_hash(label))


def content_hash(c) -> Column:
    return F.sha2(_c(c).cast("binary"), 256)


def config_hash(**settings) -> Column:
    """Hash of settings in a canonical (sorted) key order."""
    ordered = F.struct(*[F.coalesce(_c(settings[k]).cast("string"), F.lit("")).alias(k) for k in sorted(settings)])
    return F.sha2(F.to_json(ordered), 256)


def guess_heading_level(c) -> Column:
    raw = F.coalesce(_c(c), F.lit(""))
    s = strip(raw)
    n = F.length(s)
    caps = (n <= 60) & (F.upper(s) == s) & s.rlike("[A-Z]") & ~s.rlike("[a-z]")
    caps_title = s.rlike(U + r"^[A-Z\s]{2,60}$") & ((words(s) >= 2) | (n >= 6))
    return _first([(caps & (n <= 4), F.lit(0)), (caps & caps_title, F.lit(2))]
                  + [(has(raw, r"^\s*" + p[1:]), F.lit(v)) for p, v in K.GUESS_LEVEL], F.lit(0))


def list_marker(c) -> Column:
    """struct(kind, value, type) of a typed list marker, null kind when there is none."""
    s = _c(c)
    rm, al, de = (F.regexp_extract(s, U + p, 1) for p in (K.LIST_ROMAN, K.LIST_ALPHA, K.LIST_DECIMAL))
    kind = F.when(rm != "", "roman").when(al != "", "alpha").when(de != "", "decimal")
    value = (F.when(rm != "", roman_to_int(rm)).when(al != "", F.ascii(F.lower(al)) - 96)
             .when(de != "", de.try_cast("int")))
    mtype = (F.when(rm != "", F.when(F.lower(rm) == rm, "i").otherwise("I"))
             .when(al != "", F.when(F.lower(al) == al, "a").otherwise("A"))
             .when(de != "", ""))
    return F.struct(kind.alias("kind"), value.cast("int").alias("value"), mtype.alias("type"))


def list_class(type_attr) -> Column:
    t = _c(type_attr)
    return (F.when(t == "a", "list-alpha-lower").when(t == "A", "list-alpha-upper")
            .when(t == "i", "list-roman-lower").when(t == "I", "list-roman-upper").otherwise("list-decimal"))


def citation_prefix(c) -> Column:
    """struct(head, prefix): a trailing citation word that belongs to the next citation."""
    s = F.coalesce(_c(c), F.lit(""))
    prefix = F.regexp_extract(s, U + r"(?:^|(?<=[\s(\[]))((?:" + "|".join(K.CITATION_WORDS) + r")\s+)$", 1)
    return F.struct(F.substr(s, F.lit(1), F.length(s) - F.length(prefix)).alias("head"), prefix.alias("prefix"))


def is_reference_label(c) -> Column:
    s = strip(F.coalesce(_c(c), F.lit("")))
    drop = s.rlike("(?i)" + K.DEGREE) | (~s.rlike(U + r"\d") & s.rlike(K.LETTERS_DOTTED))
    return F.when(s == "", False).when(has(s, K.LABEL_WORD, True), True).otherwise(~drop)


def looks_numbered_heading(c) -> Column:
    s = F.coalesce(_c(c), F.lit(""))
    return reduce(lambda a, b: a | b, [has(s, p, i) for p, i in K.LOOKS_NUMBERED])


def guarded_pattern(label) -> Column:
    """Pattern of a label that stands on its own, not as part of a longer label; white space in it may vary."""
    body = F.regexp_replace(F.regexp_replace(collapse_ws(label), r"([\\^$.|?*+()\[\]{}\-])", r"\\$1"), " ", r"\\s+")
    return F.concat(F.lit(IU + r"(?<![\w.])"), body, F.lit(r"(?![.\-‐‑–—]?\w)"))


def contains_label(text, label) -> Column:
    """Label stands in the text on its own, not as part of a longer label."""
    pat = guarded_pattern(label)
    return F.regexp_like(collapse_ws(text), pat) & (collapse_ws(label) != "")
