"""What the operators share: reading tables, tables in the cluster's shared folder, checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.workspace import shared_dir

#: One step of strip and split: the six ASCII white-space characters.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.stored_at = path
    return made


def discard(*tables: DataFrame) -> None:
    """Deletes tables that stored() wrote and that nothing will read again; leaves other DataFrames alone."""
    for df in tables:
        if path := vars(df).get("stored_at"):
            spark = df.sparkSession
            if name := vars(df).get("stored_as"):
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that df has not: the wish, with underscores before it as needed."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


#: Rows of a key that one task takes in any case.
FEW_ROWS = 2000


def dealt(many: DataFrame, key: str, rows_each: int | None = None) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`many` with a column __salt, and how to copy rows of the other side of a join on (key, __salt).

    A key that holds more rows than rows_each is dealt to several salts, with the other side's rows of that
    key copied to each. Without rows_each a key's fair share is the rows over twice the shuffle partitions
    (FEW_ROWS at least), so less keys than that are dealt, and they are broadcast. Rows of a null key, which
    meet nothing, are dealt too. `many` is read once to count, so it should be a stored table.
    """
    parts, rows = 2 * int(many.sparkSession.conf.get("spark.sql.shuffle.partitions")), many.count()
    fair = rows_each or max(FEW_ROWS, rows // parts)
    if rows <= fair:
        return many.withColumn("__salt", F.lit(0)), lambda one: one.withColumn("__salt", F.lit(0))
    often = many.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > fair)
    hot = stored(often.select(key, F.ceil(F.col("__n") / fair).cast("int").alias("__parts")), "hot")
    if not hot.count() and not many.filter(F.col(key).isNull()).limit(fair + 1).count() > fair:
        return many.withColumn("__salt", F.lit(0)), lambda one: one.withColumn("__salt", F.lit(0))
    hot = hot if rows_each else F.broadcast(hot)
    plain = [f.name for f in many.schema.fields if "map<" not in f.dataType.simpleString()]
    salt = F.pmod(F.xxhash64(*plain), F.coalesce("__parts", F.when(F.col(key).isNull(), F.lit(parts)), F.lit(1)).cast("long")).cast("int")

    def copies(one: DataFrame) -> DataFrame:
        return one.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")

    # stored, so that Spark knows its size: what is small then meets large tables without moving them
    return stored(many.join(hot, key, "left").withColumn("__salt", salt).drop("__parts"), "dealt"), copies


def spread_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join on `key` of rows that may hold a key very often with rows that hold it once or seldom, hot keys dealt to several tasks."""
    salted, copies = dealt(many, key)
    return salted.join(copies(one), [key, "__salt"], how).drop("__salt")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() agrees on pure ASCII and is faster there."""
    pure = F.octet_length(text) == F.char_length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body's own lambdas use it."""
    return F.transform(F.array(value), body)[0]


def bounded_sample(rows: DataFrame, at: Column, most: int, about: int) -> DataFrame:
    """At most `most` rows, the first by the hash `at`; about: how many rows there may be.

    A share of the hash's range comes first, so that tasks send the driver little more than `most` rows in all.
    """
    share = min(1.0, 1.5 * most / max(1, about))
    near = rows.filter(F.pmod(at, F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    return near.orderBy(at, *(c for c in rows.columns if c != "__y")).limit(most)
