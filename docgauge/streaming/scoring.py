"""Scoring of answers as they arrive. A row is scored by itself, so there is no state and no watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docgauge.operators.scoring import FieldSpec, score_cases

ANSWERS = "run string, case_id string, truth variant, predicted variant, error string"


def answer_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Answers from JSON files that appear in a folder."""
    return spark.readStream.schema(ANSWERS).option("maxFilesPerTrigger", files_per_batch).json(folder)


def score_stream(answers: DataFrame, specs: Sequence[FieldSpec], target: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Writes the scored fields of each batch once: the file sink and the checkpoint together give exactly that."""
    writer = score_cases(answers, specs).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
