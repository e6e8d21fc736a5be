"""Resolution of relations to entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import normal_path
from tessera.schema import CONFIDENCE


def same_file(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations (file_path, to_name, to_qn, ...) with targets in their own file: the first entity of that name, by ordinal.

    What has a target already stays as it is; a resolved relation's confidence is 0.9 at least.
    """
    first = Window.partitionBy("file_path", "name").orderBy("ordinal")
    names = entities.withColumn("__n", F.row_number().over(first)).filter("__n = 1").select("file_path", F.col("name").alias("to_name"), F.col("qualified_name").alias("__qn"))
    met = relations.join(names, ["file_path", "to_name"], "left")
    hit = F.col("to_qn").isNull() & F.col("__qn").isNotNull()
    return met.withColumns({
        "confidence": F.when(hit, F.greatest("confidence", F.lit(CONFIDENCE["same_file"]))).otherwise(F.col("confidence")),
        "resolution_type": F.when(hit, "same-file").otherwise(F.col("resolution_type")), "to_qn": F.coalesce("to_qn", "__qn")}).drop("__qn")


def cross_file(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations still without a target: names that an imported file defines at 0.7, names defined once in all at 0.5."""
    suffixless = F.regexp_replace("path", r"\.(ts|tsx|js|jsx|mts|cts)$", "")
    imports = relations.filter("rel_type = 'IMPORTS'").select("file_path", F.col("to_name").alias("raw")).filter(F.col("raw").startswith("."))
    plain = normal_path(F.concat(F.regexp_replace("file_path", r"[^/]*$", ""), F.col("raw")))
    imported = imports.select("file_path", F.regexp_replace(plain, r"\.(ts|tsx|js|jsx|mts|cts)$", "").alias("base")).distinct()
    defined = entities.filter("symbol_type != 'module'").select(F.col("file_path").alias("path"), "name", "qualified_name").withColumn("base", suffixless)
    near = imported.join(defined, "base").groupBy("file_path", F.col("name").alias("to_name")).agg(F.min("qualified_name").alias("__near"))
    once = defined.groupBy(F.col("name").alias("to_name")).agg(F.min("qualified_name").alias("__once"), F.count("*").alias("__n")).filter("__n = 1").drop("__n")
    modules = entities.filter("symbol_type = 'module'").select(F.col("file_path").alias("path")).withColumn("base", suffixless)
    open_ = F.col("to_qn").isNull()
    met = relations.join(near, ["file_path", "to_name"], "left").join(once, "to_name", "left")
    found = F.when(F.col("rel_type") == "IMPORTS", None).otherwise(F.coalesce("__near", "__once"))
    out = met.withColumns({
        "confidence": F.when(open_ & found.isNotNull(), F.when(F.col("__near").isNotNull(), CONFIDENCE["imported"]).otherwise(CONFIDENCE["unique_name"])).otherwise(F.col("confidence")),
        "resolution_type": F.when(open_ & found.isNotNull(), F.when(F.col("__near").isNotNull(), "import").otherwise("unique-name")).otherwise(F.col("resolution_type")),
        "to_qn": F.coalesce("to_qn", found)}).drop("__near", "__once")
    targets = imports.withColumn("base", F.regexp_replace(plain, r"\.(ts|tsx|js|jsx|mts|cts)$", "")).join(modules, "base").groupBy("file_path", F.col("raw").alias("to_name")).agg(F.min("path").alias("__module"))
    return out.join(targets, ["file_path", "to_name"], "left").withColumn("to_qn", F.when(F.col("rel_type") == "IMPORTS", F.coalesce("__module", "to_qn")).otherwise(F.col("to_qn"))).drop("__module")


def defines(entities: DataFrame) -> DataFrame:
    """Edges from each file's module to its other entities."""
    inner = entities.filter("symbol_type != 'module'").select(F.col("file_path").alias("src"), F.col("qualified_name").alias("dst"), F.lit("DEFINES").alias("rel_type"))
    return inner.join(entities.filter("symbol_type = 'module'").select(F.col("qualified_name").alias("src")), "src", "left_semi")
