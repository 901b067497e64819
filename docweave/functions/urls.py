"""URL policy columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as K
from .labels import _c, strip


def _web(lower: Column) -> Column:
    return lower.startswith("http://") | lower.startswith("https://")


def plausible_authority(url) -> Column:
    """The authority has no user part and no look-alike (non-ASCII) characters."""
    u = _c(url)
    rest = F.when(u.contains("//"), F.regexp_replace(u, r"(?s)^.*?//", "")).otherwise(u)
    auth = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return ~auth.contains("@") & auth.rlike(r"^[\x00-\x7F]*$")


def is_safe_href(href) -> Column:
    v = strip(F.coalesce(_c(href), F.lit("")))
    low = F.lower(v)
    return (F.when(v == "", False)
            .when(low.startswith("#"), ~low.startswith("#x"))
            .when(low.startswith("mailto:"), F.substring(v, 8, 43).contains("@"))
            .otherwise(_web(low)))


def normalize_external_href(href) -> Column:
    v = strip(F.coalesce(_c(href), F.lit("")))
    low = F.lower(v)
    relative, host = F.concat(F.lit("https:"), v), F.concat(F.lit("https://"), v)
    return (F.when(v == "", "")
            .when(_web(low) & ~plausible_authority(v), "")
            .when(is_safe_href(v), v)
            .when(v.startswith("//"), F.when(plausible_authority(relative), relative).otherwise(""))
            .when(v.rlike("(?U)" + K.BARE_HOST), F.when(plausible_authority(host), host).otherwise(""))
            .otherwise(""))


def sanitize_external_href(href) -> Column:
    v = strip(F.coalesce(_c(href), F.lit("")))
    return (F.when(~is_safe_href(v), "")
            .when(_web(F.lower(v)) & ~plausible_authority(v), "").otherwise(v))


def is_bad_docx_link(href) -> Column:
    raw = F.coalesce(_c(href), F.lit(""))
    v = strip(raw)
    low = F.lower(v)
    return (F.when(raw == "", True)
            .when(low.startswith("#x") | low.startswith("file:"), True)
            .when(v.rlike(r"^[a-zA-Z]:\\\\") | v.rlike("^[a-zA-Z]:/") | v.startswith("\\\\"), True)
            .when(low.startswith("#"), False)
            .when(low.startswith("mailto:"), ~F.substring(v, 8, 73).contains("@"))
            .when(_web(low), False)
            .otherwise(True))


def external_scheme(href) -> Column:
    return F.lower(F.regexp_extract(strip(_c(href)), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
