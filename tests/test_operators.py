"""Aggregates, intervals, differences, selective prediction and echo against plain Python."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from docgauge.operators import diff, leakage, metrics, resample, selective

FIELDS = "run string, case_id string, case_pos int, field string, field_pos int, outcome string, score double, truth string, predicted string"


def fact(spark, cases, run="r"):
    """cases: lists of outcomes of the fields a, b, ..."""
    rows = [(run, f"c{i:03d}", i, chr(97 + j), j, o, 1.0 if o == "correct" else 0.0, "t", "p") for i, c in enumerate(cases) for j, o in enumerate(c)]
    return spark.createDataFrame(rows, FIELDS)


def case_rows(spark, n, run="r", latency=100.0):
    return spark.createDataFrame([(run, f"c{i:03d}", ["all", "even" if i % 2 == 0 else "odd"], latency if i else 0.0, 10, 5, 0.5, i % 2 == 0) for i in range(n)], "run string, case_id string, tags array<string>, latency_ms double, tokens_in long, tokens_out long, cost_usd double, cached boolean")


def test_run_metrics(spark):
    cases = [["correct", "wrong"], ["correct", "correct"], ["hallucinated", "correct"], ["refused", "refused"]]
    vectors = metrics.case_vectors(fact(spark, cases), ["a", "b", "never"], ["a"])
    got = metrics.run_metrics(vectors, case_rows(spark, 5), ["a", "b", "never"], {"a": 3.0, "never": 1.0}).first()
    assert got["n_cases"] == 5 and got["n_refused"] == 1 and got["n_cached"] == 3
    assert got["macro_accuracy"] == pytest.approx((0.5 * 3 + 0.5 * 1 + 0) / 5)
    assert got["all_fields_correct"] == pytest.approx(1 / 5)  # the case without fields is not correct
    assert got["hallucination_rate"] == pytest.approx(1 / 8) and got["critical_hallucination_rate"] == pytest.approx(1 / 4)
    assert got["latency_p50"] == 100.0 and got["cost_total"] == 2.5
    tags = {r["tag"]: r for r in metrics.by_tag(vectors, case_rows(spark, 4), ["a", "b"]).collect()}
    assert tags["all"]["n"] == 4 and tags["odd"]["accuracy"] == pytest.approx(0.5)


def test_empty_fact(spark):
    empty = fact(spark, [])
    vectors = metrics.case_vectors(empty, ["a"])
    assert metrics.field_metrics(empty).count() == 0 and vectors.count() == 0
    got = metrics.run_metrics(vectors, case_rows(spark, 2), ["a"]).first()
    assert got["macro_accuracy"] == 0.0 and got["hallucination_rate"] == 0.0
    assert selective.risk_coverage(selective.case_confidence(empty)).count() == 0
    assert leakage.echo_report(empty, ["abc"]).count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["correct", "missing", "hallucinated", "wrong", "malformed", "refused"]), min_size=2, max_size=2), min_size=1, max_size=12))
def test_rates_sum_to_one(spark, cases):
    for r in metrics.field_metrics(fact(spark, cases)).collect():
        assert sum(r[f"{o}_rate"] for o in ("missing", "hallucinated", "wrong", "malformed", "refused")) + r["accuracy"] == pytest.approx(1)


def test_mersenne_interval_redoes_the_plain_bootstrap(spark):
    dice = random.Random(1)
    cases = [[dice.choice(["correct", "wrong"])] for _ in range(20)]
    got = {r["statistic"]: r for r in resample.bootstrap_ci(metrics.case_vectors(fact(spark, cases), ["a"]), ["a"], None, 200, 7, "mersenne").collect()}
    generator, ok, samples = random.Random(7), [c[0] == "correct" for c in cases], []
    for _ in range(200):
        samples.append(sum(ok[generator.randrange(20)] for _ in range(20)) / 20)
    samples.sort()
    assert got["macro_accuracy"]["low"] == pytest.approx(samples[5]) and got["macro_accuracy"]["high"] == pytest.approx(samples[194])


def test_too_few_cases_have_no_interval(spark):
    vectors = metrics.case_vectors(fact(spark, [["correct"]] * 4), ["a"])
    for method in ("poisson", "draws", "mersenne"):
        assert resample.bootstrap_ci(vectors, ["a"], None, 200, 7, method).where("low is not null").count() == 0


def test_diff_swaps_sign_and_finds_regression(spark):
    good, bad = [["correct", "correct"]] * 30, [["wrong", "correct"]] * 25 + [["correct", "correct"]] * 5
    v = [metrics.case_vectors(fact(spark, c), ["a", "b"]) for c in (good, bad)]
    one = {r["statistic"]: r for r in diff.diff_runs(v[0], v[1], ["a", "b"], None, 200).collect()}
    two = {r["statistic"]: r for r in diff.diff_runs(v[1], v[0], ["a", "b"], None, 200).collect()}
    assert one["accuracy:a"]["significant"] and one["accuracy:a"]["delta"] == pytest.approx(-25 / 30)
    assert not one["accuracy:b"]["significant"]
    assert all(two[k]["delta"] == pytest.approx(-one[k]["delta"]) for k in one)
    assert all(two[k]["low"] == pytest.approx(-one[k]["high"], abs=0.1) for k in one)  # a swapped pattern has draws of its own
    plain = [{r["statistic"]: r for r in diff.diff_runs(v[i], v[1 - i], ["a", "b"], None, 200, method="draws").collect()} for i in (0, 1)]
    assert all(plain[1][k]["low"] == pytest.approx(-plain[0][k]["high"]) for k in one)
    assert [r["statistic"] for r in diff.regressions(diff.diff_runs(v[0], v[1], ["a", "b"], None, 200)).collect()] == ["accuracy:a"]


def test_curve_is_the_plain_running_mean(spark):
    dice = random.Random(3)
    rows = [("r", f"c{i:03d}", i, "a", 0, dice.choice(["correct", "wrong"]), dice.choice([0.0, 0.5, 0.5, 1.0]), "t", "p") for i in range(300)]
    confident = selective.case_confidence(spark.createDataFrame(rows, FIELDS))
    import hashlib

    order = sorted(rows, key=lambda r: (-r[6], hashlib.sha1(f"{selective.SEED}|{r[1]}".encode()).hexdigest()))
    got = selective.risk_coverage(confident).orderBy("n_accepted").collect()
    right = 0
    for k, (r, g) in enumerate(zip(order, got, strict=True), 1):
        right += r[5] == "correct"
        assert g["case_id"] == r[1] and g["n_accepted"] == k and g["accuracy"] == pytest.approx(right / k)
    points = {r["target"]: r["n_accepted"] for r in selective.operating_points(selective.risk_coverage(confident)).collect()}
    assert points[0.5] == 150 and points[1.0] == 300


def test_confidence_field_and_scale(spark):
    rows = [("r", "c1", 0, "confidence", 1, "correct", 1.0, None, "87"), ("r", "c1", 0, "a", 0, "wrong", 0.2, "t", "p"), ("r", "c2", 1, "a", 0, "wrong", 0.2, "t", "p")]
    got = {r["case_id"]: r for r in selective.case_confidence(spark.createDataFrame(rows, FIELDS)).collect()}
    assert got["c1"]["confidence"] == pytest.approx(0.87) and got["c2"]["confidence"] == pytest.approx(0.2)
    assert selective.confidence_source(selective.case_confidence(spark.createDataFrame(rows, FIELDS))).first()["source"] == "schema field"


def test_holdout_of_a_separable_run(spark):
    rows = [("r", f"c{i:03d}", i, "a", 0, "correct" if i < 40 else "wrong", 0.9 if i < 40 else 0.1, "t", "p") for i in range(80)]
    got = selective.holdout(selective.case_confidence(spark.createDataFrame(rows, FIELDS)), 0.95, 20).first()
    assert 0.3 < got["coverage"] < 0.6 and got["accuracy"] > 0.85 and got["lift"] > 0.3


def test_literals(spark):
    got = leakage.prompt_literals(spark, 'Use "US  ABD TOTAL" or \'RX TORAX\'. JSON ONLY; the code RX TORAX PA. "abc"')
    assert got == ["US ABD TOTAL", "RX TORAX PA", "JSON ONLY", "RX TORAX"]


def test_echo_needs_lift_and_gap(spark):
    said = [("US TOTAL", "other")] * 10 + [("x", "x")] * 10
    rows = [("r", f"c{i}", i, "a", 0, "correct" if p == t else "wrong", 0.0, t, p) for i, (p, t) in enumerate(said)]
    got = leakage.echo_report(spark.createDataFrame(rows, FIELDS), ["us total", "never said"]).collect()
    assert len(got) == 1 and got[0]["suspicious"] and got[0]["n_truth"] == 0 and got[0]["lift"] is None
    fine = [("r", f"c{i}", i, "a", 0, "correct", 1.0, "US TOTAL", "US TOTAL") for i in range(10)]
    assert not leakage.echo_report(spark.createDataFrame(fine, FIELDS), ["us total"]).first()["suspicious"]


def test_casefold_folds_columns_and_literals_alike(spark):
    from pyspark.sql import functions as F

    from docgauge.functions.text import casefold

    df = spark.createDataFrame([("Straße ÄÖ",), ("STRASSE äö",)], "x string")
    assert {r[0] for r in df.select(casefold(F.col("x"))).collect()} == {"strasse äö"} == {spark.range(1).select(casefold(F.lit("Straße ÄÖ"))).first()[0]}
    fields = [("r", f"c{i}", i, "a", 0, "wrong", 0.0, "t", t) for i, t in enumerate(["in der Straße hier", "STRASSE", "road"])]
    assert leakage.echo_report(spark.createDataFrame(fields, FIELDS), ["straße"]).first()["n_predicted"] == 2


def test_repeated_ids_are_cases_of_their_own(spark):
    rows = [("r", "c1", 0, "a", 0, "correct", 1.0, "t", "p"), ("r", "c1", 1, "a", 0, "wrong", 0.0, "t", "p"), ("r", "c2", 2, "a", 0, "correct", 1.0, "t", "p")]
    vectors = metrics.case_vectors(spark.createDataFrame(rows, FIELDS), ["a"])
    cases = spark.createDataFrame([("r", i, p, ["x"], 1.0, 1, 1, 0.0, False) for _, i, p, *_ in rows], "run string, case_id string, case_pos int, tags array<string>, latency_ms double, tokens_in long, tokens_out long, cost_usd double, cached boolean")
    got = metrics.run_metrics(vectors, cases, ["a"]).first()
    assert got["n_cases"] == 3 and got["macro_accuracy"] == pytest.approx(2 / 3) == got["all_fields_correct"]
    assert metrics.by_tag(vectors, cases, ["a"]).first()["accuracy"] == pytest.approx(2 / 3)
    other = metrics.case_vectors(fact(spark, [["correct"]] * 3).withColumn("case_id", __import__("pyspark").sql.functions.expr("replace(case_id, 'c00', 'c')")), ["a"])
    d = {r["statistic"]: r for r in diff.diff_runs(vectors, other, ["a"], None, 0).collect()}
    assert d["accuracy:a"]["n_paired"] == 2 and d["accuracy:a"]["baseline"] == 0.5  # of c1 the last


def test_poisson_tables(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 50, 4000, resample.CHUNK):
        first, edges = spark.range(1).select(resample.poisson_table(F.lit(float(n))).alias("t")).select("t.first", "t.edges").first()
        total, want = 0.0, []
        for k in range(first, first + len(edges)):
            total += math.exp(k * math.log(n) - n - math.lgamma(k + 1))
            want.append(total * 2**32)
        assert all(abs(a - b) < 16 for a, b in zip(edges, want, strict=True)) and edges[-1] >= 2**32 - 16
    from docgauge.functions.arrays import count_up_to

    df = spark.createDataFrame([([1, 3, 3, 7], x) for x in range(9)], "a array<long>, x long")
    assert [r[0] for r in df.orderBy("x").select(count_up_to(F.col("a"), F.col("x"), 4)).collect()] == [0, 1, 1, 3, 3, 3, 3, 4, 4]


def test_poisson_draws_are_as_wide_as_they_should_be(spark):
    cases = [["correct"]] * 60 + [["wrong"]] * 40
    got = {r["statistic"]: r for r in resample.bootstrap_ci(metrics.case_vectors(fact(spark, cases), ["a"]), ["a"]).collect()}
    assert got["macro_accuracy"]["low"] == pytest.approx(0.5, abs=0.02) and got["macro_accuracy"]["high"] == pytest.approx(0.7, abs=0.02)
    own = resample.bootstrap_statistics(metrics.case_vectors(fact(spark, cases), ["a"]), ["ok_0", "n_0"], {"twice": 2 * __import__("pyspark").sql.functions.col("ok_0") / __import__("pyspark").sql.functions.col("n_0")}).first()
    assert own["value"] == pytest.approx(1.2) and own["low"] == pytest.approx(2 * got["macro_accuracy"]["low"])


def test_holdout_by_hand(spark):
    import hashlib

    dice = random.Random(5)
    rows = [("r", f"c{i:03d}", i, "a", 0, dice.choice(["correct", "correct", "wrong"]), dice.choice([0.2, 0.5, 0.9]), "t", "p") for i in range(101)]
    confident = selective.case_confidence(spark.createDataFrame(rows, FIELDS))
    got = selective.holdout(confident, 0.7, 7).first()
    wide, accuracy = [], []
    sha = lambda x: hashlib.sha1(f"{selective.SEED}|{x}".encode()).hexdigest()
    for split in range(7):
        order = sorted(rows, key=lambda r: hashlib.md5(f"{selective.SEED}|{split}|{r[1]}".encode()).hexdigest())  # noqa: B023
        fit, test = (sorted(half, key=lambda r: (-r[6], sha(r[1]))) for half in (order[:50], order[50:]))
        ok = lambda half, k: sum(r[5] == "correct" for r in half[:k]) / k
        best = max((k / 50 for k in range(1, 51) if ok(fit, k) >= 0.7), default=0.0)
        best = best if best >= selective.LEAST_COVERAGE else 0.0
        wide.append(best)
        if best:
            accuracy.append(ok(test, max(1, round(best * 51))))
    assert got["coverage"] == pytest.approx(sum(wide) / 7) and got["accuracy"] == pytest.approx(sum(accuracy) / len(accuracy))
    accuracy.sort()
    assert got["low"] == pytest.approx(accuracy[int(0.025 * len(accuracy))]) and got["high"] == pytest.approx(accuracy[min(len(accuracy) - 1, int(0.975 * len(accuracy)))])
