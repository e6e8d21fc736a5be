"""Text expressions: tokens, windows, paths, prompts. All are built-in column functions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.schema import WINDOW_CHARS, WINDOW_OVERLAP

#: White space as Unicode has it, for strip: what Python and Java call white space, in ASCII and beyond.
SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A token: letters with their marks, digits and underscores of any script.
TOKEN = r"[\p{L}\p{M}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Lower-case words and numbers of any script; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def query_terms(spark: SparkSession, query: str | None) -> list[str]:
    """The distinct tokens of a query, by the same rule as a text's; none for an empty query."""
    row = spark.range(1).select(F.array_distinct(tokens(F.lit(query or ""))).alias("t")).first()
    return list(row["t"])


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def count_of(text: Column, part: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))


def windows(df: DataFrame, text: str, size: int = WINDOW_CHARS, overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """df with a row per character window: window, char_start, and content in place of the text column.

    Windows stop with the first that reaches the end; a size of 0 or less is one whole window. Texts that
    are null or only white space give none.
    """
    body = df.withColumn(text, strip(F.col(text))).filter(F.length(text) > 0)
    if size <= 0:
        return body.withColumns({"window": F.lit(0), "char_start": F.lit(0), "content": F.col(text)}).drop(text)
    step = max(1, size - overlap)
    last = F.greatest(F.length(text) - F.lit(size) + F.lit(step - 1), F.lit(0))
    starts = F.sequence(F.lit(0), (F.floor(last / step) * step).cast("int"), F.lit(step))
    return body.select("*", F.posexplode(starts).alias("window", "char_start")).withColumn("content", F.substring(text, F.col("char_start") + 1, F.lit(size))).withColumn(
        "lines_before", count_of(F.substring(text, F.lit(1), F.col("char_start")), "\n")).drop(text)


# Fixed value: what a Markdown heading is.
HEADING = r"^(#{1,6})\s+(.+?)\s*$"


def sections(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """A row per heading section of a Markdown text: key, section, title, first_line, body; no fences, no hierarchy.

    A section stays if it has lines or a title. Lines before the first heading are section 0.
    """
    heading = HEADING
    lines = df.select(*key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    opened = Window.partitionBy(*key).orderBy("line_no")
    marked = lines.withColumn("is_heading", F.col("line").rlike(heading)).withColumn("section", F.sum(F.col("is_heading").cast("int")).over(opened))
    title = F.max(F.when(F.col("is_heading"), F.trim(F.regexp_extract("line", heading, 2))))
    body = F.filter(F.sort_array(F.collect_list(F.struct("line_no", "line", "is_heading"))), lambda x: ~x["is_heading"])
    grouped = marked.groupBy(*key, "section").agg(title.alias("title"), body.alias("lines"))
    first = F.coalesce(F.get(F.col("lines"), F.lit(0))["line_no"], F.lit(0)) + 1
    return grouped.filter(F.col("title").isNotNull() | (F.size("lines") > 0)).select(
        *key, "section", "title", first.alias("first_line"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("body"))


def chunks(df: DataFrame, key: list[str], text: str, size: int = WINDOW_CHARS, overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """Markdown texts as numbered windows of their sections: key, chunk_index, title, content, line_start, line_end."""
    parts = sections(df, key, text)
    skipped = F.length("body") - F.length(F.ltrim("body", F.lit(SPACE)))
    led = parts.withColumn("lead", count_of(F.substring(F.col("body"), F.lit(1), skipped), "\n"))
    cut = windows(led, "body", size, overlap)
    order = Window.partitionBy(*key).orderBy("section", "window")
    start = F.col("first_line") + F.col("lead") + F.col("lines_before")
    return cut.select(
        *key, (F.row_number().over(order) - 1).alias("chunk_index"), "title", "content", start.alias("line_start"), (start + count_of(F.col("content"), "\n")).alias("line_end"))


def html_text(html: Column) -> Column:
    """Tags, scripts and styles out, white space as single spaces."""
    bare = F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"[ \t\n\r]+", " "))


def normal_path(path: Column, root: str | None = None) -> Column:
    """One spelling for a file, whoever names it: scans by URI, logs and diffs relative to a root.

    file: is no part of it, another scheme and its host are; a relative path is taken under root, if that is
    given. Empty parts and `.` go, and `..` takes the part before it along; above the top it is nothing.
    """
    whole = path if root is None else F.when(path.rlike(r"^(/|[A-Za-z][A-Za-z0-9+.-]*:)"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    scheme = F.regexp_extract(whole, r"^([A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?)", 1)
    rest = F.substring(whole, F.length(scheme) + 1, F.length(whole))
    step = lambda kept, part: F.when(part.isin("", "."), kept).when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(part)))
    parts = F.aggregate(F.split(rest, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(scheme.startswith("file:"), "").otherwise(scheme), F.when(rest.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))


def first_line(text: Column) -> Column:
    return F.trim(F.substring_index(text, "\n", 1))


def signature(name: Column, parameters: Column, returns: Column) -> Column:
    return F.concat_ws(" ", name, parameters, returns)


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def chunk_id(*parts: Column) -> Column:
    """A chunk's own stable id: the same text position gets the same id in every run."""
    return F.sha2(F.concat_ws("\x01", *(p.cast("string") for p in parts)), 256)


def language_of(path: Column) -> Column:
    s = suffix(path)
    return F.when(s == "cs", "csharp").when(s.isin("ts", "tsx", "mts", "cts"), "typescript").when(s.isin("js", "jsx"), "javascript").when(s.isin("md", "markdown", "txt"), "docs")


def collection_of(language: Column) -> Column:
    return F.when(language == "csharp", "code_cs").otherwise("code_ts")


# The wording of description requests.
PROMPT_HEAD = """\
Viết 1-2 câu tiếng Việt mô tả nghiệp vụ (business semantics) của hàm/lớp dưới đây.
Tập trung vào: làm gì theo góc nhìn nghiệp vụ, khi nào dùng đến.
Không giải thích kỹ thuật, không nhắc tên biến/tên hàm.
Chỉ trả về 1-2 câu tiếng Việt, không thêm dấu trích dẫn, không markdown.
"""
PROMPT_LABELS = ("Tên", "Loại", "Signature", "Docstring", "Code")
PROMPT_MISSING = "(không có)"
PROMPT_CHARS = 500


def prompt(name: Column, kind: Column, signature_: Column, docstring: Column, content: Column, most: int = PROMPT_CHARS) -> Column:
    """The request for a description in a sentence or two; the content's first characters after stripping. An empty signature or docstring is missing."""
    given = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(PROMPT_MISSING))
    lines = [F.concat(F.lit(f"{label}: "), value) for label, value in zip(PROMPT_LABELS, (name, kind, given(signature_), given(docstring)), strict=False)]
    code = F.substring(strip(F.coalesce(content, F.lit(""))), 1, most)
    return F.concat(F.lit(PROMPT_HEAD + "\n"), F.concat_ws("\n", *lines), F.lit(f"\n{PROMPT_LABELS[-1]}:\n"), code, F.lit("\n"))


def cleaned(output: Column) -> Column:
    """A generator's answer without wrapping quotes and list bullets."""
    inner = F.btrim(strip(output), F.lit("\"'`"))
    return strip(F.regexp_replace(inner, r"^[-•]+", ""))


def shortened(error: Column, most: int = 2000) -> Column:
    return F.left(error, F.lit(most))


def mentions(text: Column, names: list[str]) -> Column:
    """True where text holds one of a few names as a whole word; many names: join on tokens instead."""
    if not names:
        return F.lit(False)
    return text.rlike(r"\b(?:" + "|".join(re.escape(n) for n in names) + r")\b")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
