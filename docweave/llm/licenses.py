"""Licences of files: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor
directory. Spark expressions only.

A file's passages are its lines that speak of a licence (the cue words below) and, for licence files by name, the whole text.
Each passage becomes a sparse vector of word terms with TF-IDF weights over the templates, whose few hundred weights are
constants of the expression; its cosine to every template follows in place, without moving the text. The best
template of at least ``least`` is the passage's licence, the best passage's is the file's.

A licence file stands for its directory. A file without a licence of its own takes that of the nearest directory above it. That
is settled once per directory: directories, not files, are joined by path to those that carry a licence, and files then join their own
directory; crowded directories are split by Spark's skew handling, as both sides of that join are plain exchanges.

Cases: null texts and empty texts have no passage but can inherit; a null path has no directory and inherits nothing; of
equally close templates the first by name holds; a directory with several licence files takes the closest match, then the first by
name; repeated rows are scanned one by one; an empty table gives no row.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, let, once

# Notices as they are commonly worded, with their SPDX names; a licence may have several.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "BSD 3-Clause License. All rights reserved."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under Creative Commons CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
]
CUE = r"(?i)licen[sc]e|copyright|rights reserved|public domain|spdx|redistribution"
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|notice|unlicense)([._-].*)?$"
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"


def template_weights() -> list[tuple[int, str, str, float, float]]:
    """(template, license, term, weight, idf): unit vectors of the templates. A term in few templates weighs more."""
    counts = [Counter(re.findall(TERM, text.lower())) for _, text in TEMPLATES]
    seen = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(counts)) / n) for t, n in seen.items()}
    out = []
    for k, c in enumerate(counts):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        out += [(k, TEMPLATES[k][0], t, n * idf[t] / norm, idf[t]) for t, n in c.items()]
    return out


#: Weight of a word that no template has: it only lengthens the passage's vector.
OTHER_TERM = 1.0


def _map(pairs) -> Column:
    return F.create_map(*[x for k, v in pairs for x in (F.lit(k), F.lit(float(v)))])


def closest(passage: Column) -> Column:
    """Struct (similarity in whole thousandths, license) of the template closest to a passage; null if no term is shared."""
    weights = template_weights()
    idf = _map(sorted({(t, i) for *_, t, _, i in weights}))
    add = lambda s, v: s + v

    def counted(terms: Column) -> Column:
        known = F.filter(terms, lambda t: F.map_contains_key(idf, t))
        return let(known, lambda k: F.struct(F.transform(F.array_distinct(k), lambda t: F.struct(t.alias("t"), (F.size(F.filter(k, lambda x: x == t)) * F.element_at(idf, t)).alias("w"))).alias("own"),
                                             (F.size(terms) - F.size(k)).alias("others")))

    def compared(c: Column) -> Column:
        norm = F.sqrt(F.aggregate(c["own"], F.lit(0.0), lambda s, x: s + x["w"] * x["w"]) + c["others"] * OTHER_TERM * OTHER_TERM)
        scores = []
        for k, (name, _) in enumerate(TEMPLATES):
            own = _map(sorted((t, w) for n, _, t, w, _ in weights if n == k))
            dot = F.aggregate(c["own"], F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.try_element_at(own, x["t"]), F.lit(0.0)))
            scores.append(F.struct((-F.round(1000 * dot / F.when(norm > 0, norm))).cast("int").alias("minus"), F.lit(name).alias("license")))
        return F.array_min(F.filter(F.array(*scores), lambda x: x["minus"] < 0))

    return let(let(F.regexp_extract_all(F.lower(passage), F.lit(f"({TERM})"), 1), counted), compared)


def with_own(files: DataFrame, least: float = 0.5) -> DataFrame:
    """files (path, text, ...) with own_license and similarity (whole thousandths), null where no passage is close enough."""
    name = F.element_at(F.split("path", "/"), -1)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(CUE))
    passages = F.when(F.col("text").rlike(CUE), F.concat(lines, F.when(name.rlike(LICENSE_FILE), F.array("text")).otherwise(F.array().cast("array<string>"))))
    best = F.array_min(F.filter(F.transform(passages, closest), lambda x: x["minus"] <= -1000 * least))
    out = once(files, {"_best": best})
    return out.select(*files.columns, F.col("_best.license").alias("own_license"), (-F.col("_best.minus")).alias("similarity"))


def _directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))


def directory_licences(files: DataFrame) -> DataFrame:
    """dir, inherited, from_dir: for each directory of files (with own_license), the licence of the nearest directory at or above it."""
    name = F.element_at(F.split("path", "/"), -1)
    carried = (files.where(F.col("own_license").isNotNull() & name.rlike(LICENSE_FILE)).groupBy("dir")
               .agg(F.min(F.struct((-F.col("similarity")).alias("minus"), F.col("own_license").alias("license"))).alias("best")).select(F.col("dir").alias("above"), F.col("best.license").alias("inherited")))
    dirs = files.where("dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("above")))
    # The top, which has no name, is above everything.
    steps = dirs.select("dir", F.inline(F.concat(F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("above"))), F.when(F.col("dir") != "", above).otherwise(F.array().cast("array<struct<depth:int,above:string>>")))))
    found = steps.join(durable(carried, "directory-licences"), "above").groupBy("dir").agg(F.max(F.struct("depth", "inherited", "above")).alias("near"))
    return found.select("dir", F.col("near.inherited").alias("inherited"), F.col("near.above").alias("from_dir"))


def licences(files: DataFrame, least: float = 0.5) -> DataFrame:
    """The columns of files but text, with own_license, similarity, license (own or inherited) and inherited_from (directory). files: path, text and
    any other columns whose names are not among these."""
    own = with_own(files.select("*", _directory(F.col("path")).alias("dir")), least).drop("text")
    own = durable(own, "own-licences")
    near = durable(directory_licences(own), "inherited")
    out = own.join(near, "dir", "left")
    return out.select(*[c for c in own.columns if c != "dir"], F.coalesce("own_license", "inherited").alias("license"), F.when(F.col("own_license").isNull(), F.col("from_dir")).alias("inherited_from"))


def document_paths(docs: DataFrame) -> DataFrame:
    """doc_id, path, text: a directory tree for a table of documents. Sixty-four neighbouring ids share a directory, 64 directories one above;
    documents that speak of a licence are licence files, and every fourth directory keeps its own one level up."""
    leaf, top = F.floor(F.col("doc_id") / 64), F.floor(F.col("doc_id") / 4096)
    marked = F.coalesce(F.col("text").rlike(CUE), F.lit(False))
    up = F.concat_ws("/", "source", top.cast("string"))
    path = F.when(marked & (leaf % 4 == 0), F.concat(up, F.lit("/LICENSE-"), F.col("doc_id"))).otherwise(
        F.concat(up, F.lit("/"), leaf.cast("string"), F.when(marked, F.lit("/LICENSE-")).otherwise(F.lit("/")), F.col("doc_id")))
    return docs.select("doc_id", path.alias("path"), "text")
