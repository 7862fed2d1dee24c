"""Manifests (JSON lines), replayed predictions and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docgauge.operators.corpus import cases_of


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """lineno, line of a manifest, read in as many pieces as Spark cuts the file into.

    Lines are counted for each piece, and a piece's first line number is the sum of those before it; a piece is known by its place in the file.
    """
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("id"))
    counts = read.groupBy("file", "piece").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = Window.orderBy("file", "piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece
    starts = counts.select("file", "piece", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return read.join(F.broadcast(starts), ["file", "piece"]).select((F.col("id") - F.col("first") + F.col("before") + 1).alias("lineno"), F.col("value").alias("line"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return cases_of(read_lines(spark, path))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """id, predicted (variant) of a file of recorded answers."""
    return spark.read.schema("id string, predicted variant").json(path).where("id is not null")


def replay(cases: DataFrame, predictions: DataFrame, fallback: str | None = None) -> DataFrame:
    """cases with the recorded answer of each id (of several the last); those without one have the column `fallback`, or null."""
    last = predictions.withColumn("at", F.monotonically_increasing_id()).groupBy("id").agg(F.max("at").alias("at"))
    kept = predictions.withColumn("at", F.monotonically_increasing_id()).join(last, ["id", "at"]).select("id", F.col("predicted").alias("__said"))
    joined = cases.join(kept, "id", "left")
    other = F.col(fallback) if fallback else F.lit(None).cast("variant")
    return joined.withColumn("predicted", F.coalesce("__said", other)).drop("__said")

