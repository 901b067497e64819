"""Label and URL functions under SQL names.

Each is a SQL function whose body is the expression that the DataFrame function builds, so a statement that calls it is planned
like any other expression.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import labels, urls

#: Functions of one text: SQL name -> column function.
ONE_TEXT = {f.__name__: f for f in (
    labels.normalize_ws, labels.collapse_ws, labels.heading_signature, labels.normalize_heading_ref, labels.roman_to_int, labels.convert_numbering,
    labels.heading_slug, labels.scrape_slug, labels.client_slug, labels.strip_label_prefix, labels.has_number_prefix, labels.bookmark_id,
    labels.content_hash, labels.guess_heading_level, labels.is_reference_label, labels.looks_numbered_heading,
    urls.is_safe_href, urls.normalize_external_href, urls.sanitize_external_href, urls.is_bad_docx_link)}


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Make the functions known to ``spark.sql`` under their names, after ``prefix``; returns the names. Functions whose
    expression walks an array (such as convert_numbering) have no SQL text and stay DataFrame functions only."""
    names: list[str] = []
    frame = spark.range(0).select(F.lit("").alias("c"))
    for name, function in ONE_TEXT.items():
        kind = frame.select(function("c").alias("v")).schema["v"].dataType.simpleString()
        body = frame.select(function("c").alias("v"))._jdf.queryExecution().analyzed().expressions().head().child().sql()
        if "lambdafunction(" not in body:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(c STRING) RETURNS {kind} RETURN {body}")
            names.append(prefix + name)
    return names
