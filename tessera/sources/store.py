"""Named tables under one folder, and the points of collections: what a store's upserts and deletes are in Spark.

A table is Parquet in folders by the hash of its key column (file_path, mostly). A change reads and
overwrites the folders of the keys that it touches (Spark's dynamic partition overwrite) and no others. A
table that has grown several times over is laid out anew in more folders, so what a change of one file
writes does not grow with the table. Index tables are appended to instead: their rows carry the stamp of
the write that they belong to, readers join them with what is live, and now and then they are written anew
without the rest.

Beside the rows lies the table's description: schema, folders, key. So a table may be empty, and a layout
that a lost writer left half done is not seen. A change that is lost half way is repeated as a whole and
leaves the same table. One writer at a time; a DataFrame read before a change is to be read again after it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.changes import latest, patch
from tessera.schema import COLLECTIONS
from tessera.workspace import children, files_in, make_folder, read_text, remove, size, write_text

PARTITION = "collection"
BUCKET = "bucket"
#: Rows of a folder when a table is laid out, and the most folders of a table.
ROWS, MOST_FOLDERS = 50_000, 1 << 16
#: A table of so many times the bytes it was laid out for, and of LEAST_BYTES at least, is laid out anew.
GROWTH, LEAST_BYTES = 4, 1 << 26
#: Appends after which an index table is written anew.
APPENDS = 64


class Tables:
    """Tables by name under one folder."""

    def __init__(self, spark: SparkSession, root: str, rows: int = ROWS, least_bytes: int = LEAST_BYTES):
        self.spark, self.root, self.rows, self.least_bytes = spark, root.rstrip("/"), rows, least_bytes

    def about(self, name: str) -> dict | None:
        """The description in force: the last one."""
        found = [c for c in children(self.spark, f"{self.root}/{name}") if c.startswith("about-") and not c.endswith(".half")]
        return json.loads(read_text(self.spark, f"{self.root}/{name}/{found[-1]}")) if found else None

    def _describe(self, name: str, about: dict) -> None:
        """Puts a description in force and removes what neither it nor the one before needs."""
        at = f"{self.root}/{name}"
        about["version"] += 1
        write_text(self.spark, f"{at}/about-{about['version']:08d}", json.dumps(about))
        held = children(self.spark, at)
        kept = [c for c in held if c.startswith("about-")][-2:]
        layouts = {json.loads(read_text(self.spark, f"{at}/{c}"))["layout"] for c in kept}
        for c in held:
            if c not in kept and c not in layouts:
                remove(self.spark, f"{at}/{c}")

    def __contains__(self, name: str) -> bool:
        return self.about(name) is not None

    def get(self, name: str, keys: list[str] | DataFrame | None = None) -> DataFrame | None:
        """The table, or None if it was never written. keys (a list, or a DataFrame's first column): only the folders of these values of the table's key, by partition filter."""
        if (about := self.about(name)) is None:
            return None
        rows = self._rows(name, about)
        if keys is not None:
            rows = rows.filter(F.col(BUCKET).isin(*self._folders(about, keys)))
        return rows.drop(BUCKET)

    def __getitem__(self, name: str) -> DataFrame:
        if (df := self.get(name)) is None:
            raise KeyError(name)
        return df

    def _rows(self, name: str, about: dict) -> DataFrame:
        schema = T.StructType([*T.StructType.fromJson(about["schema"]).fields, T.StructField(BUCKET, T.IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{about['layout']}")

    @staticmethod
    def _bucket(key: str, folders: int) -> Column:
        return F.pmod(F.xxhash64(F.col(key)), F.lit(folders)).cast("int")

    def _folders(self, about: dict, keys: list[str] | DataFrame) -> list[int]:
        named = keys.toDF("k") if isinstance(keys, DataFrame) else self.spark.createDataFrame([(k,) for k in keys], "k string")
        return sorted(r[0] for r in named.select(self._bucket("k", about["folders"])).distinct().collect())  # numbers of folders

    def _write(self, placed: DataFrame, path: str, key: str, mode: str) -> None:
        placed.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, key).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)

    def put(self, name: str, df: DataFrame, key: str = "file_path", folders: int | None = None) -> DataFrame:
        """df in place of the whole table, in folders by key; returns it as read."""
        about = self.about(name) or {"version": 0}
        layout = f"rows-{about['version'] + 1:08d}"
        path = f"{self.root}/{name}/{layout}"
        remove(self.spark, path)  # what a lost writer left
        if folders is None:
            folders = min(MOST_FOLDERS, 1 << max(0, -(-df.count() // self.rows) - 1).bit_length())
        make_folder(self.spark, path)
        self._write(df.withColumn(BUCKET, self._bucket(key, folders)), path, key, "append")
        laid = size(self.spark, path)
        self._describe(name, {"version": about["version"], "schema": df.schema.jsonValue(), "layout": layout, "folders": folders, "key": key, "laid": laid, "bytes": laid, "appends": 0})
        return self[name]

    def change(self, name: str, rows: DataFrame | None, gone: DataFrame, on: list[str], key: str = "file_path") -> DataFrame | None:
        """rows in place of what the table holds of the keys in gone (columns `on`, the table's key among them); returns the table as read.

        Folders of other keys are neither read nor written. Columns that one side lacks are null in its rows.
        """
        if (about := self.about(name)) is None:
            return None if rows is None else self.put(name, rows, key)
        key, place = about["key"], self._bucket(about["key"], about["folders"])
        lost = gone.select(*on).distinct()
        touched = lost.select(place.alias(BUCKET))
        if rows is not None:
            rows = rows.withColumn(BUCKET, place)
            touched = touched.unionAll(rows.select(BUCKET))
        at = sorted(r[0] for r in touched.distinct().collect())  # numbers of folders
        if not at:
            return self[name]
        path = f"{self.root}/{name}/{about['layout']}"
        of = {b: f"{path}/{BUCKET}={b}" for b in at}
        before, held = sum(size(self.spark, f) for f in of.values()), {b: files_in(self.spark, f) for b, f in of.items()}
        after = self._rows(name, about).filter(F.col(BUCKET).isin(*at)).join(lost, on, "left_anti")
        after = after if rows is None else after.unionByName(rows, allowMissingColumns=True)
        about["schema"] = after.drop(BUCKET).schema.jsonValue()
        self._write(after, path, key, "overwrite")
        for b, f in of.items():
            if held[b] and files_in(self.spark, f) == held[b]:  # no row is left, so nothing was written over the old ones
                remove(self.spark, f)
        about["bytes"] += sum(size(self.spark, f) for f in of.values()) - before
        self._describe(name, about)
        if about["bytes"] > max(self.least_bytes, GROWTH * about["laid"]):
            return self.put(name, self[name], key)
        return self[name]

    def append(self, name: str, rows: DataFrame, key: str) -> bool:
        """Adds rows; True once there were so many appends that the table should be put anew without what is stale."""
        if (about := self.about(name)) is None:
            self.put(name, rows, key)
            return False
        self._write(rows.withColumn(BUCKET, self._bucket(key, about["folders"])), f"{self.root}/{name}/{about['layout']}", key, "append")
        about["appends"] += 1
        self._describe(name, about)
        return about["appends"] >= APPENDS


def read_points(spark: SparkSession, path: str, collections: tuple[str, ...] = COLLECTIONS) -> DataFrame | None:
    """The points of collections; each is a table of its own. None if none of them was ever written."""
    tables, out = Tables(spark, path), None
    for c in collections:
        if (some := tables.get(c)) is not None:
            some = some.withColumn(PARTITION, F.lit(c))
            out = some if out is None else out.unionByName(some, allowMissingColumns=True)
    return out


def _touched(points: DataFrame) -> list[str]:
    """The collections of points; an error if one is unknown."""
    if unknown := points.filter(~F.coalesce(F.col(PARTITION).isin(*COLLECTIONS), F.lit(False))).select(PARTITION).first():
        raise ValueError(f"unknown collection: {unknown[0]}")
    return sorted(r[0] for r in points.select(PARTITION).distinct().collect())  # known names only


def upsert_points(points: DataFrame, path: str) -> None:
    """Adds points; those of an equal chunk_id in the same collection are replaced. An unknown collection is an error.

    A chunk_id belongs to one file. Of several points with a chunk_id in one call one is kept, the same one in every run.
    """
    tables = Tables(points.sparkSession, path)
    for c in _touched(points):
        some = points.filter(F.col(PARTITION) == c).drop(PARTITION)
        once = latest(some, ["chunk_id"], [F.xxhash64(*some.columns), F.to_json(F.struct(*some.columns))])
        tables.change(c, once, some, ["file_path", "chunk_id"])


def replace_points(points: DataFrame, files: DataFrame, path: str, collections: tuple[str, ...]) -> None:
    """points in place of what these collections hold of the files (file_path), each of whose points is among them once."""
    tables = Tables(points.sparkSession, path)
    held = _touched(points)
    for c in collections:
        if c in held or c in tables:
            tables.change(c, points.filter(F.col(PARTITION) == c).drop(PARTITION) if c in held else None, files, ["file_path"])


def patch_points(values: DataFrame, path: str) -> None:
    """Merges columns (collection, chunk_id, maybe file_path, ...) into the points there are; without file_path all points are searched for the ids."""
    tables = Tables(values.sparkSession, path)
    for c in _touched(values):
        if (old := tables.get(c)) is not None:
            some = values.filter(F.col(PARTITION) == c).drop(PARTITION)
            some = some if "file_path" in some.columns else some.join(old.select("chunk_id", "file_path"), "chunk_id")
            held = old.join(some.select("file_path", "chunk_id").distinct(), ["file_path", "chunk_id"], "left_semi")
            tables.change(c, patch(held, some, ["file_path", "chunk_id"]), some, ["file_path", "chunk_id"])


def delete_points(files: DataFrame, path: str, collections: tuple[str, ...] = COLLECTIONS) -> None:
    """Takes the points of files out of the named collections; a collection may end up empty."""
    tables = Tables(files.sparkSession, path)
    for c in collections:
        if c in tables:
            tables.change(c, None, files, ["file_path"])


def point(spark: SparkSession, path: str, collection: str, chunk_id: str) -> DataFrame:
    return read_points(spark, path, (collection,)).filter(F.col("chunk_id") == chunk_id)
