"""File scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import content_hash, html_text, language_of, normal_path, suffix
from tessera.operators.filters import indexed_source, outside_skipped
from tessera.schema import DOC_SUFFIXES


def scan_repo(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, content, content_hash, language) of source files under root, without build and vendor folders. Paths are as normal_path writes them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{ts,tsx,js,jsx,mts,cts,cs}").load(root)
    path = F.col("path")
    kept = files.filter(indexed_source(path) & outside_skipped(path))
    return kept.select(normal_path(path).alias("file_path"), F.decode("content", "UTF-8").alias("content"), content_hash(F.col("content")).alias("content_hash"), language_of(path).alias("language"))


def scan_docs(spark: SparkSession, root: str, html: bool = False) -> DataFrame:
    """(file_path, text) of documents under root. html: also HTML files, without their tags."""
    kinds = (*DOC_SUFFIXES, "html") if html else DOC_SUFFIXES
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(kinds) + "}").load(root)
    text = F.decode("content", "UTF-8")
    return files.select(normal_path(F.col("path")).alias("file_path"), F.when(suffix(F.col("path")) == "html", html_text(text)).otherwise(text).alias("text"))

