"""Prompt echo: answers that a model copies out of its prompt."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgauge.functions.text import casefold, collapse_ws, let
from docgauge.operators.metrics import ratio

# What a prompt's literals look like, and the least hits and lift of a suspicious one.
QUOTED = "[\"'`“‘«]([^\"'`”’»\n]{3,60})[\"'`”’»]"
CAPITALS = r"\b([A-Z][A-Z0-9./-]{1,}(?:\s+[A-Z][A-Z0-9./-]{1,}){1,5})\b"
LEAST_LENGTH, LEAST_HITS, LEAST_LIFT, SHOWN = 4, 3, 1.5, 12


def literals(prompt: Column, least: int = LEAST_LENGTH) -> Column:
    """Quoted spans and runs of capitalised words of a prompt, without repeats, longest first, then by alphabet."""
    found = F.array_union(F.regexp_extract_all(prompt, F.lit(QUOTED), F.lit(1)), F.regexp_extract_all(prompt, F.lit(CAPITALS), F.lit(1)))
    clean = F.array_distinct(F.filter(F.transform(found, collapse_ws), lambda s: F.length(s) >= least))
    ordered = F.array_sort(F.transform(F.coalesce(clean, F.array().cast("array<string>")), lambda s: F.struct((-F.length(s)).alias("k"), s.alias("s"))))
    return F.transform(ordered, lambda x: x["s"])


def prompt_literals(spark, prompt: str, least: int = LEAST_LENGTH) -> list[str]:
    """The same of one prompt, on the driver."""
    return spark.range(1).select(literals(F.lit(prompt), least).alias("x")).first()["x"]


def echo_report(fields: DataFrame, wanted: Sequence[str], fold: Callable[[Column], Column] = casefold) -> DataFrame:
    """For each literal that some case predicts: cases that predict it, that have it as truth, accuracies with and without, and whether that is suspicious.

    The literals are those of one prompt, so they stand in the plan. Each field is folded and looked at once, and what is
    rare (a hit) is what is shuffled. The totals travel as one more group; the accuracy of all other cases follows from them,
    without a join or a second pass. Rows of one id are one case, unless case_pos tells them apart.
    """
    # Folded once, here: in the plan a fold that the optimizer can't work out would be redone for each row.
    folded = fields.sparkSession.range(1).select(F.array(*[fold(F.lit(x).cast("string")) for x in wanted])).first()[0] if wanted else []
    listed = F.array(*[F.struct(F.lit(x).cast("string").alias("own"), F.lit(y).cast("string").alias("folded")) for x, y in zip(wanted, folded, strict=True)]) if wanted else F.array().cast("array<struct<own:string,folded:string>>")
    found = lambda c: let(fold(F.col(c)), lambda v: F.transform(F.filter(listed, lambda x: F.coalesce(F.contains(v, x["folded"]), F.lit(False))), lambda x: x["own"]))
    key = [c for c in ("case_id", "case_pos") if c in fields.columns]
    each = fields.select(*key, (F.col("outcome") == "correct").cast("int").alias("ok"), found("predicted").alias("said"), found("truth").alias("true"))
    cases = each.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("ok"), F.array_distinct(F.flatten(F.collect_list("said"))).alias("said"), F.array_distinct(F.flatten(F.collect_list("true"))).alias("true"))
    marked = lambda c, side: F.transform(c, lambda x: F.struct(x.alias("literal"), F.lit(side).alias("side")))
    hits = cases.select("n", "ok", F.inline(F.concat(marked(F.array(F.lit(None).cast("string")), 0), marked(F.col("said"), 1), marked(F.col("true"), 2))))
    said = F.col("side") < 2
    summed = hits.groupBy("literal").agg(F.count_if(said).alias("n_predicted"), F.count_if(F.col("side") == 2).alias("n_truth"), F.coalesce(F.sum(F.when(said, F.col("n"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(said, F.col("ok"))), F.lit(0)).alias("ok"))
    total = lambda c: F.max(F.when(F.col("literal").isNull(), F.col(c))).over(Window.partitionBy())  # noqa: E731  as many rows as literals
    joined = summed.select("*", total("n_predicted").alias("n_cases"), total("n").alias("all_n"), total("ok").alias("all_ok")).where("literal is not null and n_predicted > 0")
    out = joined.select("literal", "n_predicted", "n_truth", "n_cases", ratio(F.col("ok"), F.col("n")).alias("accuracy_echoed"), ratio(F.col("all_ok") - F.col("ok"), F.col("all_n") - F.col("n")).alias("accuracy_other"))
    lift = F.when(F.col("n_truth") > 0, (F.col("n_predicted") / F.col("n_cases")) / (F.col("n_truth") / F.col("n_cases")))
    out = out.withColumns({"lift": lift, "accuracy_gap": F.col("accuracy_echoed") - F.col("accuracy_other")})
    return out.withColumn("suspicious", (F.col("n_predicted") >= LEAST_HITS) & (F.col("lift").isNull() | (F.col("lift") >= LEAST_LIFT)) & (F.col("accuracy_gap") < 0))


def suspicious(report: DataFrame) -> DataFrame:
    """The suspicious literals; worst gap first."""
    return report.where("suspicious").orderBy("accuracy_gap", "literal")


def top_echoes(report: DataFrame, shown: int = SHOWN) -> DataFrame:
    """What a report shows: most predicted first, then longest."""
    return report.orderBy(F.desc("n_predicted"), F.desc(F.length("literal")), "literal").limit(shown)
