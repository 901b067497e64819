"""Table functions for SQL: ``SELECT d.doc_id, n.* FROM docs d, LATERAL html_nodes(d.html) n``. Their schemas follow from the arguments."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import fixed as K

NODES = T.StructType([T.StructField(n, t) for n, t in (
    ("node_idx", T.IntegerType()), ("parent_idx", T.IntegerType()), ("depth", T.IntegerType()), ("end_idx", T.IntegerType()), ("kind", T.StringType()), ("tag", T.StringType()),
    ("ord", T.IntegerType()), ("text", T.StringType()), ("attrs", T.MapType(T.StringType(), T.StringType())), ("link_idx", T.IntegerType()), ("href", T.StringType()))])
MEMBERS = T.StructType([T.StructField("part", T.StringType()), T.StructField("size", T.LongType()), T.StructField("error", T.StringType())])


def _kind(argument: AnalyzeArgument, wanted: type, name: str, what: str) -> None:
    if not isinstance(argument.dataType, (wanted, T.NullType)):
        raise ValueError(f"{name} must be {what}, not {argument.dataType.simpleString()}")


class HtmlNodes:
    """html_nodes(html[, tags]): the nodes of one page in order; tags, a constant of names with blanks between, keeps only those elements and adds their inner text."""

    @staticmethod
    def analyze(html: AnalyzeArgument, tags: AnalyzeArgument | None = None) -> AnalyzeResult:
        _kind(html, T.StringType, "html", "a string")
        if tags is None:
            return AnalyzeResult(NODES)
        if not tags.isConstantExpression:
            raise ValueError("tags must be a constant")
        return AnalyzeResult(T.StructType([*NODES.fields, T.StructField("inner", T.StringType())]))

    def eval(self, html: str, tags: str | None = None):
        from ..sources.html import NAMES, _Reader

        reader = _Reader(None if tags is None else frozenset(tags.lower().split()))
        reader.read(html or "")
        columns = dict(zip(NAMES, (c.to_pylist() for c in reader.columns())))
        columns["attrs"] = [dict(a) for a in columns["attrs"]]
        yield from zip(*(columns[n] for n in [*NODES.names, *([] if tags is None else ["inner"])]))


class ArchiveMembers:
    """archive_members(content[, with_content]): one row per member of a zip archive. A damaged member is a row with its error and does not hide the others; what is no archive
    is one row with a null name. A constant true adds the bytes."""

    @staticmethod
    def analyze(content: AnalyzeArgument, with_content: AnalyzeArgument | None = None) -> AnalyzeResult:
        _kind(content, T.BinaryType, "content", "binary")
        full = with_content is not None and with_content.isConstantExpression and bool(with_content.value)
        return AnalyzeResult(T.StructType([*MEMBERS.fields, T.StructField("content", T.BinaryType())]) if full else MEMBERS)

    def eval(self, content: bytes, with_content: bool = False):
        row = lambda part, size, error, data=None: (part, size, error, data) if with_content else (part, size, error)
        try:
            archive = zipfile.ZipFile(io.BytesIO(content or b""))
        except zipfile.BadZipFile as bad:
            yield row(None, None, str(bad))
            return
        total = 0
        for n, member in enumerate(archive.infolist()):
            total += member.file_size
            if n >= K.MAX_ARCHIVE_FILES or total > K.MAX_ARCHIVE_BYTES:
                yield row(member.filename, member.file_size, "over the limit of the archive")
                continue
            try:
                yield row(member.filename, member.file_size, None, archive.read(member))
            except Exception as bad:  # whatever a damaged member raises is its finding
                yield row(member.filename, member.file_size, f"{type(bad).__name__}: {bad}")


FUNCTIONS = {"html_nodes": HtmlNodes, "archive_members": ArchiveMembers}


def register_tables(spark: SparkSession) -> list[str]:
    """Register all table functions for SQL; returns their names."""
    for name, handler in FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler))
    return list(FUNCTIONS)
