"""Corpora: cases read from a manifest, checked, narrowed and hashed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgauge.functions.text import strip


def parsed_lines(lines: DataFrame) -> DataFrame:
    """lineno, line -> the lines that are records, with the parsed object (null if it is none). Blank lines and those that begin with # are passed over."""
    kept = lines.where((strip(F.col("line")) != "") & ~F.startswith(F.ltrim("line"), F.lit("#")))
    v = F.try_parse_json("line")
    return kept.withColumn("record", F.when(F.coalesce(F.schema_of_variant(v), F.lit("")).startswith("OBJECT"), v))


def _text(field: str) -> Column:
    return strip(F.try_variant_get("record", f"$.{field}", "string"))


def cases_of(lines: DataFrame) -> DataFrame:
    """lineno, id, image, truth (variant), tags, notes of the records."""
    tags = F.coalesce(F.try_variant_get("record", "$.tags", "array<string>"), F.array().cast("array<string>"))
    return parsed_lines(lines).where("record is not null").select("lineno", _text("id").alias("id"), _text("image").alias("image"), F.try_variant_get("record", "$.truth", "variant").alias("truth"), tags.alias("tags"), F.coalesce(F.try_variant_get("record", "$.notes", "string"), F.lit("")).alias("notes"))


def manifest_problems(lines: DataFrame, known: Sequence[str], images: DataFrame | None = None) -> DataFrame:
    """lineno, problem (images: a column `image` of those that are there): everything that is wrong with a manifest, not just the first thing; an empty corpus is a problem too (line 0)."""
    parsed = parsed_lines(lines)
    bad = parsed.where("record is null").select("lineno", F.lit("not a JSON object").alias("problem"))
    kind = F.coalesce(F.schema_of_variant(F.try_variant_get("record", "$.truth", "variant")), F.lit(""))
    keys = F.json_object_keys(F.to_json(F.try_variant_get("record", "$.truth", "variant")))
    unknown = F.array_sort(F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*map(F.lit, known))))
    no_id, no_image = F.coalesce(_text("id"), F.lit("")) == "", F.coalesce(_text("image"), F.lit("")) == ""
    found = F.array_compact(
        F.array(
            F.when(no_id, F.lit("missing id")),
            F.when(no_image, F.lit("missing image")),
            F.when(~kind.startswith("OBJECT"), F.lit("truth is not an object")),
            F.when(kind.startswith("OBJECT") & (F.size(unknown) > 0), F.concat(F.lit("unknown truth keys: "), F.array_join(unknown, ", "))),
        )
    )
    good = parsed.where("record is not null")
    each = good.select("lineno", F.explode(found).alias("problem"))
    order = Window.partitionBy("id").orderBy("lineno")
    twice = good.select("lineno", _text("id").alias("id")).where("id <> ''").withColumn("n", F.row_number().over(order)).where("n > 1").select("lineno", F.concat(F.lit("duplicate id "), "id").alias("problem"))
    out = bad.unionByName(each).unionByName(twice)
    if images is not None:
        there = images.select("image").distinct()
        lost = good.select("lineno", _text("image").alias("image")).where("image <> ''").join(there, "image", "left_anti")
        out = out.unionByName(lost.select("lineno", F.concat(F.lit("image not found: "), "image").alias("problem")))
    empty = good.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(0).cast("long").alias("lineno"), F.lit("no cases").alias("problem"))
    return out.select(F.col("lineno").cast("long").alias("lineno"), "problem").unionByName(empty)


def narrow(cases: DataFrame, tags: Sequence[str] | None = None, exclude: Sequence[str] | None = None, limit: int | None = None, order: str = "lineno") -> DataFrame:
    """Cases with any of the tags, then without any of the excluded, then the first in manifest order. None or nothing: no such limit."""
    own = F.coalesce("tags", F.array().cast("array<string>"))
    if tags:
        cases = cases.where(F.arrays_overlap(own, F.array(*map(F.lit, tags))))
    if exclude:
        cases = cases.where(~F.arrays_overlap(own, F.array(*map(F.lit, exclude))))
    return cases.orderBy(order).limit(limit) if limit else cases


def image_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def corpus_hash(cases: DataFrame, schema_hash: str = "", length: int = 12) -> DataFrame:
    """One hash of ids, image hashes and truths (not of tags and notes), whatever their order.

    Each case is hashed where it is; the sorted hashes are folded in buckets of their first digits, then over the 4096
    buckets, so that no task holds more than a bucket.
    """
    one = F.sha2(F.concat_ws("|", "id", F.coalesce("image_hash", F.lit("")), F.coalesce(F.col("truth").cast("string"), F.lit(""))), 256)
    folded = cases.select(one.alias("h")).groupBy(F.substring("h", 1, 3).alias("k")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    all_ = folded.agg(F.array_sort(F.collect_list(F.struct("k", "h"))).alias("x"))
    return all_.select(F.substring(F.sha2(F.concat(F.lit(schema_hash + "|"), F.array_join(F.transform("x", lambda x: x["h"]), "")), 256), 1, length).alias("corpus_hash"))
