"""Paired comparison of two runs on the cases that both have."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgauge.operators.metrics import macro_of, ratio
from docgauge.operators.resample import ITERATIONS, LEAST_CASES, LEAST_ITERATIONS, SEED, interval, replicate_sums


def latest(cases: DataFrame, order: str, key: str = "case_id") -> DataFrame:
    """Of cases that repeat an id, the last."""
    return cases.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def paired(baseline: DataFrame, candidate: DataFrame, names: Sequence[str]) -> DataFrame:
    """Case vectors side by side: b_* and c_* of each case that both runs have; of a repeated id the last case."""
    baseline, candidate = (latest(df, "case_pos") if "case_pos" in df.columns else df for df in (baseline, candidate))
    own = ["n", "correct", *[f"{k}_{i}" for i in range(len(names)) for k in ("n", "ok", "hall", "miss")]]
    side = lambda df, p: df.select("case_id", *[F.col(c).alias(p + c) for c in own], ((F.col("n") > 0) & (F.col("correct") == F.col("n"))).cast("int").alias(p + "all_ok"))
    return side(baseline, "b_").join(side(candidate, "c_"), "case_id").withColumn("one", F.lit(1))


def _deltas(names: Sequence[str], weights: Mapping[str, float] | None):
    sums = {c: F.col(c) for c in _columns(names)}
    macro = {p: macro_of({f"{k}_{i}": sums[f"{p}_{k}_{i}"] for i in range(len(names)) for k in ("n", "ok")}, names, weights) for p in "bc"}
    correct = {p: ratio(sums[f"{p}_all_ok"], sums["one"]) for p in "bc"}
    out = {"macro_accuracy": (macro["b"], macro["c"]), "all_fields_correct": (correct["b"], correct["c"])}
    return out | {f"accuracy:{n}": tuple(ratio(sums[f"{p}_ok_{i}"], sums[f"{p}_n_{i}"]) for p in "bc") for i, n in enumerate(names)}


def _columns(names: Sequence[str]) -> list[str]:
    return [f"{p}_{k}_{i}" for p in "bc" for i in range(len(names)) for k in ("n", "ok", "hall", "miss")] + ["b_all_ok", "c_all_ok", "one"]


def diff_runs(baseline: DataFrame, candidate: DataFrame, names: Sequence[str], weights: Mapping[str, float] | None = None, iterations: int = ITERATIONS, seed: int = SEED, method: str = "poisson", alpha: float = 0.05) -> DataFrame:
    """statistic, n_paired, baseline, candidate, delta, low, high, significant; fields also have hallucination_delta and missing_delta.

    Weights and critical fields are those of the baseline. Both sides of a replicate have the same weights, so what
    the runs share cancels out.
    """
    pairs = paired(baseline, candidate, names).withColumn("run", F.lit("pair"))
    deltas, columns = _deltas(names, weights), _columns(names)
    extra = {f"accuracy:{n}": [ratio(F.col(f"c_{k}_{i}"), F.col(f"c_n_{i}")) - ratio(F.col(f"b_{k}_{i}"), F.col(f"b_n_{i}")) for k in ("hall", "miss")] for i, n in enumerate(names)}
    none = F.lit(None).cast("double")
    listed = F.array(*[F.struct(F.lit(k).alias("statistic"), b.alias("baseline"), c.alias("candidate"), (c - b).alias("delta"), extra.get(k, [none, none])[0].alias("hallucination_delta"), extra.get(k, [none, none])[1].alias("missing_delta")) for k, (b, c) in deltas.items()])
    point = pairs.groupBy("run").agg(*[F.sum(c).alias(c) for c in columns]).select(F.col("one").alias("n_paired"), F.inline(listed))
    # Only what the deltas need is drawn for: fewer columns, fewer patterns.
    needed = [c for c in columns if c == "one" or c.split("_")[1] in ("n", "ok", "all")]
    spread = F.array(*[F.struct(F.lit(k).alias("statistic"), (c - b).alias("delta")) for k, (b, c) in deltas.items()])
    replicates = replicate_sums(pairs, needed, iterations, seed, method).select(F.inline(spread))
    bounds = replicates.groupBy("statistic").agg(interval(F.collect_list("delta"), alpha).alias("ci"))
    enough = (F.col("n_paired") >= LEAST_CASES) & F.lit(iterations >= LEAST_ITERATIONS)
    joined = point.join(bounds, "statistic", "left").withColumns({"low": F.when(enough, F.col("ci.low")), "high": F.when(enough, F.col("ci.high"))}).drop("ci")
    return joined.withColumn("significant", F.coalesce((F.col("low") > 0) | (F.col("high") < 0), F.lit(False)))


def regressions(deltas: DataFrame) -> DataFrame:
    return deltas.where("significant and delta < 0 and statistic like 'accuracy:%'")


def improvements(deltas: DataFrame) -> DataFrame:
    return deltas.where("significant and delta > 0 and statistic like 'accuracy:%'")


def latency_change(metrics: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """Median latencies of the whole runs: difference, and ratio (0 for a baseline of 0)."""
    of = lambda run: F.max(F.when(F.col("run") == run, F.col("latency_p50")))
    both = metrics.agg(of(baseline).alias("b"), of(candidate).alias("c"))
    return both.select((F.col("c") - F.col("b")).alias("latency_delta"), ratio(F.col("c"), F.nullif(F.col("b"), F.lit(0.0))).alias("latency_ratio"))


def comparable(runs: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """Whether two runs are over one corpus, and if not, why."""
    of = lambda run: F.max(F.when(F.col("run") == run, F.col("corpus_hash")))
    both = runs.agg(of(baseline).alias("b"), of(candidate).alias("c"))
    same = F.col("b").eqNullSafe(F.col("c"))
    return both.select(same.alias("comparable"), F.when(~same, F.concat(F.lit("different corpora: "), F.coalesce("b", F.lit("?")), F.lit(" and "), F.coalesce("c", F.lit("?")))).otherwise(F.lit("")).alias("reason"))
