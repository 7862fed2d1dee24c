"""Aggregates of scored fields: for each field, run and tag.

`fields` is the long fact (run, case_id, field, outcome, score); `cases` has a row for each case (run, case_id, tags,
latency_ms, tokens_in, tokens_out, cost_usd, cached). Everything is summed for each case once (`case_vectors`, one
shuffle on run and case; cases that repeat an id are told apart by case_pos, where there is one), and runs, tags, intervals and differences are then sums over these rows. Empty groups give 0.0
rather than null, as the published definitions have it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgauge.operators.scoring import OUTCOMES


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def case_key(*tables: DataFrame) -> list[str]:
    """What tells cases apart in all of the tables: run, id and, as ids may repeat, the place in the run."""
    return [c for c in ("run", "case_id", "case_pos") if all(c in t.columns for t in tables)]


def outcome_counts(fields: DataFrame, by: Sequence[str] = ("run", "field")) -> DataFrame:
    return fields.groupBy(*by, "outcome").agg(F.count(F.lit(1)).alias("n"))


def field_metrics(fields: DataFrame, by: Sequence[str] = ("run",), critical: Sequence[str] = ()) -> DataFrame:
    """n, accuracy, the five failure rates and the mean score of each field."""
    n = F.count(F.lit(1))
    rates = [ratio(F.count_if(F.col("outcome") == o), n).alias("accuracy" if o == "correct" else f"{o}_rate") for o in OUTCOMES]
    return fields.groupBy(*by, "field").agg(n.alias("n"), *rates, F.avg("score").alias("mean_score")).withColumn("critical", F.col("field").isin(list(critical)))


def field_names(fields: DataFrame) -> DataFrame:
    """run and its fields, in the order in which they are first seen."""
    first = fields.groupBy("run", "field").agg(F.min(F.struct("case_pos", "field_pos")).alias("at"))
    listed = first.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("at", "field"))).alias("x"))
    return listed.select("run", F.transform("x", lambda x: x["field"]).alias("field_names"))


def scored_names(names: Sequence[str], weights: Mapping[str, float] | None) -> list[tuple[str, float]]:
    """Fields with a weight above 0, which is 1 unless it is named."""
    return [(n, float((weights or {}).get(n, 1.0))) for n in names if (weights or {}).get(n, 1.0) > 0]


def case_vectors(fields: DataFrame, names: Sequence[str], critical: Sequence[str] = ()) -> DataFrame:
    """Sums for each case: n, correct, hallucinated, missing, refused, critical_n, critical_hallucinated, score; and n_<i>, ok_<i> of field i."""
    is_ = lambda o: F.col("outcome") == o
    crucial = F.col("field").isin(list(critical))
    own = []
    for i, name in enumerate(names):
        this = F.col("field") == name
        own += [F.count_if(this).alias(f"n_{i}"), F.count_if(this & is_("correct")).alias(f"ok_{i}"), F.count_if(this & is_("hallucinated")).alias(f"hall_{i}"), F.count_if(this & is_("missing")).alias(f"miss_{i}")]
    return fields.groupBy(*case_key(fields)).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(is_(o)).alias(o) for o in ("correct", "hallucinated", "missing", "refused")],
        F.count_if(crucial).alias("critical_n"), F.count_if(crucial & is_("hallucinated")).alias("critical_hallucinated"), F.sum("score").alias("score"), *own,
    )


def all_correct() -> Column:
    """Of a case vector: every field is correct, and there is one."""
    return (F.col("n") > 0) & (F.col("correct") == F.col("n"))


def macro_of(total: Mapping[str, Column] | None, names: Sequence[str], weights: Mapping[str, float] | None) -> Column:
    """Weighted mean of the fields' accuracies; a field without rows counts as 0. total: columns of sums, n_<i> and ok_<i> by default."""
    get = (lambda c: total[c]) if total else (lambda c: F.sum(c))
    chosen = {n: w for n, w in scored_names(names, weights)}
    parts = [ratio(get(f"ok_{i}"), get(f"n_{i}")) * chosen[n] for i, n in enumerate(names) if n in chosen]
    if not parts:
        return F.lit(0.0)
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out / sum(chosen.values())


def run_metrics(vectors: DataFrame, cases: DataFrame, names: Sequence[str], weights: Mapping[str, float] | None = None) -> DataFrame:
    """One row for each run: accuracies, hallucination rates, latencies over timed cases, tokens, cost and counts.

    Cases without any field are in the run, and are not all correct, but have no row in the vectors: hence the outer side.
    """
    own = vectors if "case_pos" in cases.columns else vectors.drop("case_pos")
    joined = cases.join(own, case_key(cases, own), "left")
    timed = F.when(F.col("latency_ms") > 0, F.col("latency_ms"))
    quantile = lambda p: F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY latency_ms) FILTER (WHERE latency_ms > 0)"), F.lit(0.0))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return joined.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_cases"), macro_of(None, names, weights).alias("macro_accuracy"),
        ratio(F.count_if(all_correct()), F.count(F.lit(1))).alias("all_fields_correct"), ratio(F.sum("hallucinated"), F.sum("n")).alias("hallucination_rate"),
        ratio(F.sum("critical_hallucinated"), F.sum("critical_n")).alias("critical_hallucination_rate"),
        quantile(0.5).alias("latency_p50"), quantile(0.95).alias("latency_p95"), mean(timed).alias("latency_mean"), mean("tokens_in").alias("tokens_in_mean"), mean("tokens_out").alias("tokens_out_mean"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_total"), F.count_if((F.col("n") > 0) & (F.col("refused") == F.col("n"))).alias("n_refused"), F.count_if("cached").alias("n_cached"),
    )


def by_tag(vectors: DataFrame, cases: DataFrame, names: Sequence[str], weights: Mapping[str, float] | None = None) -> DataFrame:
    """For each tag, counted once a case: n, macro accuracy and all-correct share. Sort by accuracy, then tag, for the worst first."""
    own = vectors if "case_pos" in cases.columns else vectors.drop("case_pos")
    key = case_key(cases, own)
    tagged = cases.select(*key, F.explode(F.array_distinct("tags")).alias("tag")).join(own, key, "left")
    return tagged.groupBy("run", "tag").agg(F.count(F.lit(1)).alias("n"), macro_of(None, names, weights).alias("accuracy"), ratio(F.count_if(all_correct()), F.count(F.lit(1))).alias("all_fields_correct"))


def tag_gap(tags: DataFrame, least: float = 0.10) -> DataFrame:
    """Tags whose accuracy is more than `least` below the best of their run."""
    best = F.max("accuracy").over(Window.partitionBy("run"))
    return tags.withColumn("gap", best - F.col("accuracy")).where(F.col("gap") > least)


def tag_counts(cases: DataFrame) -> DataFrame:
    """How often each tag is there, repeats included."""
    return cases.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def leaderboard(metrics: DataFrame, position: str | None = None) -> DataFrame:
    """Runs by macro accuracy, best first; ties by the position of their configuration, or by name."""
    return metrics.withColumn("place", F.row_number().over(Window.orderBy(F.desc("macro_accuracy"), position or "run")))
