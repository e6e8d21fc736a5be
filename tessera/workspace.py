"""Folders for tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary one in local mode, as in tests; an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """Hadoop's (file system, path) for a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    fs, at = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and last change of a file or folder."""
    fs, at = file_system(spark, path)
    return fs.getContentSummary(at).getLength(), fs.getFileStatus(at).getModificationTime()


def size(spark: SparkSession, path: str) -> int:
    """Bytes under a path; 0 where there is nothing."""
    fs, at = file_system(spark, path)
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0


def make_folder(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.mkdirs(at)


def files_in(spark: SparkSession, path: str) -> frozenset[str]:
    """Names and times of a folder's files."""
    fs, at = file_system(spark, path)
    return frozenset(f"{s.getPath().getName()}@{s.getModificationTime()}" for s in fs.listStatus(at)) if fs.exists(at) else frozenset()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there as a whole or not at all."""
    half = f"{path}.half"
    fs, at = file_system(spark, half)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.rename(at, file_system(spark, path)[1])


def write_stream(spark: SparkSession, path: str, chunks: Iterable[bytes]) -> None:
    """A file of bytes that come a chunk at a time."""
    fs, at = file_system(spark, path)
    out = fs.create(at, True)
    try:
        for chunk in chunks:
            out.write(bytearray(chunk))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = file_system(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
