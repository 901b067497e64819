"""SQL expression snippets for the DuckDB twins."""

from docweave.functions import fixed as K


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x):
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def collapse(x):
    return strip(rf"regexp_replace(replace({x}, chr(160), ' '), '\s+', ' ', 'g')")


def sig(x):
    return rf"regexp_replace(lower({strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")}), '[^a-z0-9 ]+', '', 'g')"


def fulltext(x):
    return rf"regexp_replace(lower({collapse(x)}), '[^a-z0-9\s]', '', 'g')"


WORDS = "[" + ", ".join(q(w) for w in K.SPELLED) + "]"


def spelled(w):
    return f"nullif(coalesce(list_position({WORDS}, lower({w})), 0), 0)"


def norm_ref(x):
    s = strip(rf"regexp_replace({collapse(x)}, '[.\-:—–]+$', '')")
    word = rf"regexp_extract({s}, '^(Chapter|Section)\s+([A-Za-z]+)\b(.*)$', 2, 'i')"
    pre = rf"regexp_extract({s}, '^(Chapter|Section)\s+([A-Za-z]+)\b(.*)$', 1, 'i')"
    rest = rf"regexp_extract({s}, '^(Chapter|Section)\s+([A-Za-z]+)\b(.*)$', 3, 'i')"
    return f"CASE WHEN {spelled(word)} IS NOT NULL THEN {pre} || ' ' || CAST({spelled(word)} AS VARCHAR) || {rest} ELSE {s} END"


def prefixed(x, word="Chapter"):
    return rf"CASE WHEN {x} = '' THEN '' WHEN regexp_matches({x}, '^(?:Chapter|Section)\s+', 'i') THEN {strip(x)} ELSE '{word} ' || {strip(x)} END"


def no_word(x):
    return rf"regexp_replace({x}, '^(?:Chapter|Section)\s+', '', 'i')"


def canonical(x, word="Chapter"):
    return prefixed(f"({norm_ref(x)})", word)


def roman(x):
    v = ("list_transform(string_split(upper(%s), ''), lambda ch: CASE ch WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 "
         "WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 WHEN 'M' THEN 1000 ELSE 0 END)" % x)
    # Subtract a digit that is smaller than any digit to its right.
    total = (f"list_sum(list_transform({v}, lambda d, i: CASE WHEN d < coalesce(list_max(list_slice({v}, i + 1, 99)), 0) "
             f"THEN -d ELSE d END))")
    return f"CASE WHEN regexp_matches({x}, '^[IVXLCDM]+$', 'i') THEN CAST({total} AS INT) ELSE -1 END"


def convert(x):
    pat = r"^(Chapter|Section)\s+(.+?)(?:\s+[-–—:]|$)"
    pre = f"regexp_extract({x}, {q(pat)}, 1, 'i')"
    body = strip(f"regexp_extract({x}, {q(pat)}, 2, 'i')")
    first = f"split_part({body}, '.', 1)"
    body = f"CASE WHEN {spelled(first)} IS NOT NULL THEN CAST({spelled(first)} AS VARCHAR) || substr({body}, length({first}) + 1) ELSE {body} END"
    body = rf"regexp_replace(regexp_replace({body}, '(\d)([A-Za-z])', '\1.\2', 'g'), '([A-Za-z])(\d)', '\1.\2', 'g')"
    p = "trim(p)"
    r = roman(p)
    part = (f"CASE WHEN regexp_matches({p}, '^[IVXLCDM]+$', 'i') AND i = 1 AND ({r}) BETWEEN 1 AND 20 THEN CAST(({r}) AS VARCHAR) "
            f"WHEN regexp_matches({p}, '^[IVXLCDM]+$', 'i') AND i > 1 AND length({p}) > 1 AND ({r}) > 0 THEN CAST(({r}) AS VARCHAR) "
            f"WHEN regexp_matches({p}, '^[A-Za-z]$') THEN CAST(ascii(upper({p})) - 64 AS VARCHAR) ELSE {p} END")
    parts = f"list_filter(list_transform(string_split({body}, '.'), lambda p, i: {part}), lambda z: z <> '')"
    return f"CASE WHEN {pre} = '' THEN {x} ELSE {pre} || ' ' || array_to_string({parts}, '.') END"


def full_roman(x):
    pat = r"^(Chapter|Section)\s+(.+)$"
    pre = f"regexp_extract({x}, {q(pat)}, 1, 'i')"
    body = strip(f"regexp_extract({x}, {q(pat)}, 2, 'i')")
    r = roman("p")
    part = f"CASE WHEN ({r}) > 0 THEN CAST(({r}) AS VARCHAR) WHEN regexp_matches(p, '^[A-Za-z]$') THEN CAST(ascii(upper(p)) - 64 AS VARCHAR) ELSE p END"
    return f"upper({pre}[1]) || lower(substr({pre}, 2)) || ' ' || array_to_string(list_transform(string_split({body}, '.'), lambda p: {part}), '.')"


def slug_tail(x):
    s = rf"regexp_replace(regexp_replace({x}, '[^\w\s-]', '', 'g'), '[\s_]+', '-', 'g')"
    return f"substr(lower(regexp_replace({s}, '^-+|-+$', '', 'g')), 1, 50)"


def slug(x):
    return slug_tail(f"regexp_replace(regexp_replace({x}, {q(K.SLUG_LABEL)}, '', 'i'), {q(K.SLUG_DOTTED)}, '', 'i')")


def strip_label(x):
    s = no_word(strip(x))
    return strip(f"regexp_replace({s}, {q(K.LABEL_BODY)}, '', 'i')")


def words(x):
    return rf"(CASE WHEN {strip(x)} = '' THEN 0 ELSE len(regexp_split_to_array({strip(x)}, '\s+')) END)"


def guess(x):
    s = strip(x)
    cases = " ".join(f"WHEN regexp_matches({s}, {q(p)}) THEN {v}" for p, v in K.GUESS_LEVEL)
    caps = f"length({s}) <= 60 AND upper({s}) = {s} AND regexp_matches({s}, '[A-Z]') AND NOT regexp_matches({s}, '[a-z]')"
    title = rf"regexp_matches({s}, '^[A-Z\s]{{2,60}}$') AND ({words(x)} >= 2 OR length({s}) >= 6)"
    return f"CASE WHEN {caps} AND length({s}) <= 4 THEN 0 WHEN {caps} AND {title} THEN 2 {cases} ELSE 0 END"


def style_level(x):
    return rf"coalesce(try_cast(regexp_extract({x}, '^Heading\s+([1-9])', 1, 'i') AS INT), 0)"


def likely(x="text"):
    return f"coalesce(nullif({style_level('style_name')}, 0), nullif(outline_lvl, 0), {guess(x)})"


def safe_href(x):
    v = strip(x)
    low = f"lower({v})"
    return (f"CASE WHEN {v} = '' THEN false WHEN starts_with({low}, '#') THEN NOT starts_with({low}, '#x') "
            f"WHEN starts_with({low}, 'mailto:') THEN contains(substr({v}, 8, 43), '@') "
            f"ELSE starts_with({low}, 'http://') OR starts_with({low}, 'https://') END")


def plausible(x):
    rest = f"CASE WHEN contains({x}, '//') THEN substr({x}, strpos({x}, '//') + 2) ELSE {x} END"
    auth = f"regexp_extract({rest}, '^([^/?#]*)', 1)"
    return rf"(NOT contains({auth}, '@') AND regexp_matches({auth}, '^[\x00-\x7F]*$'))"


def web(x):
    return f"(starts_with(lower({x}), 'http://') OR starts_with(lower({x}), 'https://'))"


def normalize_href(x):
    v = strip(x)
    rel, host = f"('https:' || {v})", f"('https://' || {v})"
    return (f"CASE WHEN {v} = '' THEN '' WHEN {web(v)} AND NOT {plausible(v)} THEN '' WHEN {safe_href(x)} THEN {v} "
            f"WHEN starts_with({v}, '//') THEN CASE WHEN {plausible(rel)} THEN {rel} ELSE '' END "
            f"WHEN regexp_matches({v}, {q(K.BARE_HOST)}) THEN CASE WHEN {plausible(host)} THEN {host} ELSE '' END ELSE '' END")


def sanitize_href(x):
    v = strip(x)
    return f"CASE WHEN NOT ({safe_href(x)}) THEN '' WHEN {web(v)} AND NOT {plausible(v)} THEN '' ELSE {v} END"


def types(tokens):
    return (f"list_transform({tokens}, lambda t: CASE WHEN regexp_matches(t, '^\\d+$') THEN 'decimal' WHEN regexp_matches(t, '^[ivxlcdm]+$') THEN 'roman_lower' "
            "WHEN regexp_matches(t, '^[IVXLCDM]+$') THEN 'roman_upper' WHEN regexp_matches(t, '^[A-Za-z]+$') AND upper(t) = t THEN 'alpha_upper' "
            "WHEN regexp_matches(t, '^[A-Za-z]+$') THEN 'alpha_lower' ELSE '' END)")


def heading_tokens(x):
    return (f"list_filter(list_transform(string_split(regexp_extract({strip(x)}, {q(K.HEADING_INFER)}, 1), '.'), lambda p: trim(p)), lambda p: p <> '')")


def style_tokens(x):
    pre = f"regexp_extract({x}, {q('(' + K.HEADING_PREFIX + ')')}, 1)"
    pre = strip(rf"regexp_replace({pre}, '^(?:Chapter|Section)\s+', '', 'i')")
    pre = strip(rf"regexp_replace({pre}, '[:.\-\s]+$', '')")
    return rf"list_filter(regexp_split_to_array({pre}, '[.\s]+'), lambda p: p <> '')"


def has_number(x):
    s = strip(x)
    return "(" + " OR ".join(f"regexp_matches({s}, {q(p)}, 'i')" for p in K.NUMBER_PREFIX) + ")"


def looks_numbered(x):
    return "(" + " OR ".join(f"regexp_matches({x}, {q(p)}{', ' + q('i') if ic else ''})" for p, ic in K.LOOKS_NUMBERED) + ")"


def number_match(x):
    pat = q("(?:" + K.HEADING_NUMBER + ")")
    whole = f"regexp_extract({x}, {pat}, 0, 'i')"
    num = f"coalesce(nullif(regexp_extract({x}, {pat}, 1, 'i'), ''), regexp_extract({x}, {pat}, 2, 'i'))"
    return whole, num
