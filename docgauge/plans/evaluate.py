"""A run from corpus and configuration to scored facts: cached answers are joined in, only the rest goes to the backend."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.functions.parse import parse_json
from docgauge.operators.scoring import score_cases
from docgauge.sources import images as pictures
from docgauge.sources.backends import NO_JSON, Backend, Mock, infer
from docgauge.sources.cache import Cache, cache_key, split
from docgauge.sources.config import Config, Schema, render_prompt
from docgauge.sources.manifest import read_predictions, replay

PAYLOAD = "data string, raw string, latency_ms double, tokens_in bigint, tokens_out bigint, cost_usd double"


def _questions(miss: DataFrame, config: Config, backend: Backend, images: DataFrame | None) -> DataFrame:
    """What the backend is asked: image bytes, prepared under the configuration's profile, are read only for cases that the cache doesn't answer."""
    asked = miss.withColumn("truth_json", F.to_json("truth"))
    if isinstance(backend, Mock) and config.params.get("predictions"):
        recorded = read_predictions(miss.sparkSession, config.params["predictions"])
        asked = replay(asked, recorded).withColumn("recorded_json", F.to_json("predicted")).drop("predicted")
    if images is not None:
        asked = pictures.prepared(asked.drop("content").join(images, "image", "left"), config.preprocess)
    return asked


def answers(cases: DataFrame, schema: Schema, config: Config, backend: Backend, cache: Cache | None = None, concurrency: int | None = None, images: DataFrame | None = None) -> DataFrame:
    """cases (id, truth, tags, image, image_hash) with the model's answer; what the cache doesn't have is inferred and put there.

    images: image, content. An answer without JSON is an error, and errors aren't put into the cache, so that they are tried again.
    """
    spark = cases.sparkSession
    if "image_hash" not in cases.columns:
        cases = cases.withColumn("image_hash", F.lit(""))
    keyed = cases.withColumn("key", cache_key(F.lit(config.hash), F.col("id"), F.coalesce("image_hash", F.lit("")), F.lit(schema.hash)))
    known = cache.rows() if cache else spark.createDataFrame([], "key string, payload string")
    hit, miss = split(keyed, known)
    asked = infer(_questions(miss, config, backend, images), backend, render_prompt(config, schema), schema.json_schema(), concurrency)
    parsed = lambda data, raw: F.coalesce(F.try_parse_json(data), parse_json(raw))
    said = asked.withColumn("error", F.when((F.col("error") == "") & parsed(F.col("data"), F.col("raw")).isNull(), F.lit(NO_JSON)).otherwise(F.col("error")))
    said = said.withColumn("payload", F.to_json(F.struct("data", "raw", "latency_ms", "tokens_in", "tokens_out", "cost_usd")))
    fresh = miss.join(said.select(F.col("case_id").alias("id"), "payload", "error"), "id").withColumn("cached", F.lit(False))
    if cache and cache.enabled:
        now = datetime.now(timezone.utc).isoformat()
        fresh = fresh.persist()  # asked once: the cache and the scores both read it
        cache.put(fresh.where("error = ''").select("key", F.lit(config.hash).alias("config_hash"), F.col("id").alias("case_id"), "payload", F.lit(now).alias("created_at")))
    both = fresh.unionByName(hit.withColumns({"error": F.lit(""), "cached": F.lit(True)}))
    x = both.withColumn("said", F.from_json("payload", PAYLOAD))
    predicted = parsed(F.col("said.data"), F.col("said.raw"))
    order = F.col("lineno") if "lineno" in x.columns else F.lit(0).cast("long")
    return x.select(F.col("id").alias("case_id"), order.alias("case_pos"), "tags", "truth", F.when(F.col("error") == "", predicted).alias("predicted"), "error", *[F.col(f"said.{c}").alias(c) for c in ("raw", "latency_ms", "tokens_in", "tokens_out", "cost_usd")], "cached")


def run_config(cases: DataFrame, schema: Schema, config: Config, backend: Backend, name: str | None = None, cache: Cache | None = None, concurrency: int | None = None, images: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The long fact and the cases of a run."""
    said = answers(cases, schema, config, backend, cache, concurrency, images).withColumn("run", F.lit(name or config.name))
    return score_cases(said.drop("raw"), schema.specs), said.drop("truth", "predicted")
