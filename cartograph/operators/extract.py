"""Table functions over source text: rows of members, and what is derived from them.

``extract_members`` turns rows of files into rows of members with spans; everything else is
an ordinary projection or filter on its output.  A file that cannot be read or parsed gives
one row with ``error`` set, and the others go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexer import without_comments
from ..functions.members import find_members
from ..functions.paths import language_of

SIGNATURE_PLUS_BODY, SIGNATURE_ONLY, BODY_ONLY, BODY_WITHOUT_COMMENTS = MODES = (
    "signature_plus_body", "signature_only", "body_only", "body_without_comments"
)

COLUMNS = (
    "path string, line int, containing_type string, member_name string, signature string, kind string, is_public boolean, "
    "start_line int, end_line int, start_char int, end_char int, body_start int, body_end int, content string, body string, "
    "bare_body string, error string"
)
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
_TYPES = [{"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[c.split()[1]] for c in COLUMNS.split(", ")]
#: Members that a worker holds before it hands them on.
AT_ONCE = 2048


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def member_rows(path: str, source: str | None, language: str | None) -> Iterator[tuple]:
    """Rows of one file; any failure is a row of its own."""
    try:
        if source is None:
            raise FileNotFoundError("no content")
        language = language or "csharp"
        breaks = [k for k, c in enumerate(source) if c == "\n"]
        from bisect import bisect_left

        for m in find_members(source, language):
            first, last = bisect_left(breaks, m.start) + 1, bisect_left(breaks, max(m.end - 1, m.start)) + 1
            body = None if m.body_start is None else source[m.body_start : m.body_end]
            bare = None if body is None else without_comments(body, language)
            yield (path.replace("\\", "/"), first, m.container, m.name, m.signature, m.kind, m.is_public, first, last, m.start, m.end,
                   m.body_start, m.body_end, source[m.start : m.end], body, bare, None)
    except Exception as problem:  # noqa: BLE001  one bad file must not end the job
        yield (path, *[None] * (len(_NAMES) - 2), f"{type(problem).__name__}: {problem}")


def extract_members(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """A row a member of ``files(path, content)``; the language goes by extension, and what is
    not TypeScript is read as C#.  Columns are pruned before the text leaves the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for k in range(batch.num_rows):
                held += member_rows(*(batch.column(c)[k].as_py() for c in range(3)))
                if len(held) >= AT_ONCE:
                    yield _batch(held)
                    held = []
        if held:
            yield _batch(held)

    narrow = files.select(F.col(path_col).alias("path"), F.col(content_col).cast("string").alias("content"))
    return narrow.withColumn("language", F.coalesce(language_of(F.col("path")), F.lit("csharp"))).mapInArrow(run, COLUMNS)


def register_table_function(spark: SparkSession, name: str = "extract_members") -> None:
    """The same as a table function of SQL: ``FROM files, LATERAL extract_members(path, content)``."""
    from pyspark.sql.functions import udtf

    @udtf(returnType=COLUMNS)
    class ExtractMembers:
        def eval(self, path: str, content: str):
            lower = (path or "").lower()
            yield from member_rows(path, content, "typescript" if lower.endswith((".ts", ".tsx")) else "csharp")

    spark.udtf.register(name, ExtractMembers)


def signatures(members: DataFrame) -> DataFrame:
    """``path, line, containing_type, member_name, signature`` in document order of each file."""
    return members.where("error is null").select("path", "line", "containing_type", "member_name", "signature", "start_char")


def errors(members: DataFrame) -> DataFrame:
    return members.where("error is not null").select("path", "error")


def public_names(members: DataFrame) -> DataFrame:
    """``path, names``: distinct public method and exported function names, as first met."""
    public = members.where("error is null and is_public").groupBy("path", "member_name").agg(F.min("start_char").alias("at"))
    return public.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "member_name"))), lambda s: s["member_name"]).alias("names"))


def of_type(containing: Column, name: str) -> Column:
    """The type itself or one nested to that name."""
    return (containing == name) | containing.endswith("." + name)


def member_source(members: DataFrame, member_name: str | None = None, type_filter: str | None = None, mode: str = SIGNATURE_PLUS_BODY) -> DataFrame:
    """Source of members: a row an overload, in the shape that the JSON sink prints.

    Without a name, all members.  ``body_*`` give no row to a member without body.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    rows = members.where("error is null")
    if member_name is not None:
        rows = rows.where(F.col("member_name") == member_name)
    if type_filter is not None:
        rows = rows.where(of_type(F.col("containing_type"), type_filter))
    content, start, end, lines = F.col("content"), F.col("start_char"), F.col("end_char"), (F.col("start_line"), F.col("end_line"))
    breaks = lambda text: F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    if mode == SIGNATURE_ONLY:
        head = F.regexp_replace(F.substring(content, F.lit(1), F.col("body_start") - start), r"\s+$", "")
        content = F.when(F.col("body_start").isNull(), content).otherwise(head)
        end = start + F.length(content)
        lines = (lines[0], lines[0] + breaks(content))
    elif mode in (BODY_ONLY, BODY_WITHOUT_COMMENTS):
        rows = rows.where("body_start is not null")
        lead = F.substring(F.col("content"), F.lit(1), F.col("body_start") - start)
        lines = (lines[0] + breaks(lead), lines[0] + breaks(lead) + breaks(F.col("body")))
        content = F.col("body") if mode == BODY_ONLY else F.col("bare_body")
        start, end = F.col("body_start"), F.col("body_end")
    return rows.select(
        F.col("path").alias("file"), "member_name", "containing_type", "signature", F.lit(mode).alias("mode"),
        lines[0].alias("start_line"), lines[1].alias("end_line"), start.alias("start_char"), end.alias("end_char"), content.alias("content"),
    )


def utf16_offset(text: Column, offset: Column) -> Column:
    """UTF-16 code units before a code-point ``offset``: supplementary characters count twice."""
    head = F.substring(text, F.lit(1), offset)
    return offset + F.length(F.regexp_replace(head, r"[^\x{10000}-\x{10FFFF}]", ""))


def line_of(text: Column, offset: Column) -> Column:
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n", -1))


def suggest_names(members: DataFrame, name: str, count: int = 10) -> DataFrame:
    """Up to ``count`` member names that contain ``name`` or are contained in it, in any case."""
    low, wanted = F.lower("member_name"), name.lower()
    near = members.where("error is null").where(low.contains(wanted) | F.lit(wanted).contains(low))
    return near.groupBy("member_name").agg(F.min(F.struct("path", "start_char")).alias("at")).orderBy("at", "member_name").select("member_name").limit(count)


def filter_signatures(rows: DataFrame, pattern: str | None) -> DataFrame:
    """Rows whose type, name and signature match ``pattern`` without regard to case; an
    escaped bar means alternation too."""
    if not pattern:
        return rows
    regex = "(?i)" + pattern.replace("\\|", "|")
    if not is_valid_regex(rows.sparkSession, regex):
        raise ValueError(f"invalid pattern: {pattern}")
    return rows.where(F.concat_ws("\t", "containing_type", "member_name", "signature").rlike(regex))


def is_valid_regex(spark: SparkSession, regex: str) -> bool:
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import IllegalArgumentException

    try:
        spark._jvm.java.util.regex.Pattern.compile(regex)
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


def signature_lines(rows: DataFrame) -> DataFrame:
    """``value``: tab-separated lines ``path:line, type, name, signature``."""
    place = F.concat_ws(":", "path", "line")
    return rows.select(F.concat_ws("\t", place, "containing_type", "member_name", "signature").alias("value"))


def signature_blocks(rows: DataFrame) -> DataFrame:
    """``path, block``: a file's path, then its members indented; files sort without case."""
    line = F.concat(F.lit("  "), F.concat_ws("\t", "line", "containing_type", "member_name", "signature"))
    lists = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_char", line.alias("text")))).alias("lines"))
    block = F.concat_ws("\n", "path", F.transform("lines", lambda s: s["text"]))
    return lists.select("path", block.alias("block")).orderBy(F.upper("path"), "path")


def to_json_array(rows: DataFrame) -> str:
    """The JSON sink: an indented array, nulls left out, ``[]`` without rows."""
    import json

    found = [json.loads(r) for r in rows.toJSON().collect()]  # a few overloads of one member
    return json.dumps(found, indent=2, ensure_ascii=False)
