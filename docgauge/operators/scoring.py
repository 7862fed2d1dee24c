"""Scoring of predicted against true field values: six outcomes, a score and a detail for each field of each case."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge.functions.parse import is_empty_text, parse_bool, parse_date, parse_number
from docgauge.functions.text import DEFAULT_CHAIN, apply_chain, digits_only, let, similarity, strip
from docgauge.functions.values import has_key, is_empty, value_of

CORRECT, MISSING, HALLUCINATED, WRONG, MALFORMED, REFUSED = OUTCOMES = ("correct", "missing", "hallucinated", "wrong", "malformed", "refused")
MODES = ("exact", "text", "digits", "number", "date", "bool", "set_text")


@dataclass(frozen=True)
class FieldSpec:
    """How one field is compared, and how much it counts."""

    name: str
    compare: str = "text"
    normalize: tuple[str, ...] | None = None
    fuzzy_threshold: float = 1.0
    tolerance: float = 0.0
    tolerance_days: int = 0
    dayfirst: bool = True
    weight: float = 1.0
    critical: bool = False

    @property
    def chain(self) -> tuple[str, ...]:
        """The normalisers: text and sets of texts have the default chain, others none, unless one is named."""
        return self.normalize if self.normalize is not None else DEFAULT_CHAIN if self.compare in ("text", "set_text") else ()


def declared(specs: Sequence[FieldSpec]) -> Sequence[FieldSpec]:
    """The specs, if each mode is known and names differ; else an error, as at declaration."""
    for s in specs:
        if s.compare not in MODES:
            raise ValueError(f"unknown comparison {s.compare!r} of {s.name}; known: {', '.join(MODES)}")
        apply_chain(F.lit(""), s.chain)
    if len({s.name for s in specs}) < len(specs):
        raise ValueError("two fields have one name")
    return specs


def _result(outcome: Column | str, score: Column | float, detail: Column | str) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(outcome).alias("outcome"), as_column(score).cast("double").alias("score"), as_column(detail).alias("detail"))


def _equal(t: Column, p: Column, same: str, differ: Column | str) -> Column:
    return F.when(t == p, _result(CORRECT, 1.0, same)).otherwise(_result(WRONG, similarity(t, p), differ))


def _exact(t: Column, p: Column, spec: FieldSpec) -> Column:
    return _equal(t["text"], p["text"], "exact", "exact mismatch")


def _text(t: Column, p: Column, spec: FieldSpec) -> Column:
    def near(s: Column) -> Column:
        differ = _result(WRONG, s, F.format_string("similarity %.3f", s))
        return F.when(s >= spec.fuzzy_threshold, _result(CORRECT, s, F.format_string("fuzzy match %.3f", s))).otherwise(differ) if spec.fuzzy_threshold < 1.0 else differ

    of = lambda x: F.when(x["a"] == x["b"], _result(CORRECT, 1.0, "normalized match")).otherwise(let(similarity(x["a"], x["b"]), near))
    return let(_both(apply_chain(t["text"], spec.chain), apply_chain(p["text"], spec.chain)), of)


def _digits(t: Column, p: Column, spec: FieldSpec) -> Column:
    of = lambda x: (
        F.when(x["a"] == "", _result(MALFORMED, 0.0, "no digits in ground truth"))
        .when(x["b"] == "", _result(MALFORMED, 0.0, "no digits in predicted value"))
        .otherwise(_equal(x["a"], x["b"], "digits match", F.format_string("%d digit(s) off", F.levenshtein(x["a"], x["b"]))))
    )
    return let(_both(digits_only(t["text"]), digits_only(p["text"])), of)


def _both(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def _parsed(a: Column, b: Column, what: str, close: Callable[[Column, Column], Column], detail: Callable[[Column, Column], Column]) -> Column:
    def of(x: Column) -> Column:
        said = detail(x["a"], x["b"])
        return (
            F.when(x["a"].isNull(), _result(MALFORMED, 0.0, "unparseable ground truth"))
            .when(x["b"].isNull(), _result(MALFORMED, 0.0, f"not a {what}"))
            .when(close(x["a"], x["b"]), _result(CORRECT, 1.0, said))
            .otherwise(_result(WRONG, 0.0, said))
        )

    return let(_both(a, b), of)


def _number(t: Column, p: Column, spec: FieldSpec) -> Column:
    of = lambda v: F.when(v["kind"] == "number", v["text"].try_cast("double")).when(v["kind"] != "bool", parse_number(v["text"]))
    gap = lambda a, b: F.abs(a - b)
    return _parsed(of(t), of(p), "number", lambda a, b: gap(a, b) <= spec.tolerance, lambda a, b: F.concat(F.lit("delta "), gap(a, b).cast("string")))


def _date(t: Column, p: Column, spec: FieldSpec) -> Column:
    days = lambda a, b: F.abs(F.datediff(b, a))
    read = lambda v: parse_date(v["text"], spec.dayfirst)
    return _parsed(read(t), read(p), "date", lambda a, b: days(a, b) <= spec.tolerance_days, lambda a, b: F.format_string("%dd apart", days(a, b)))


def _bool(t: Column, p: Column, spec: FieldSpec) -> Column:
    of = lambda v: F.when(v["kind"] == "number", F.when(v["text"].try_cast("double") == 1, F.lit(True)).when(v["text"].try_cast("double") == 0, F.lit(False))).otherwise(parse_bool(v["text"]))
    said = lambda a, b: F.when(a == b, F.lit("bool match")).otherwise(F.format_string("expected %s, got %s", F.initcap(a.cast("string")), F.initcap(b.cast("string"))))
    return _parsed(of(t), of(p), "boolean", lambda a, b: a == b, said)


def items_of(v: Column) -> Column:
    """A list's items; a text is cut at semicolons and line ends; else null."""
    cut = F.filter(F.transform(F.split(v["text"], "[;\n]"), strip), lambda x: x != "")
    return F.when(v["kind"] == "list", v["items"]).when(v["kind"] == "text", cut)


def _set_text(t: Column, p: Column, spec: FieldSpec) -> Column:
    """A truth that is no list is malformed, like any truth that can't be read."""
    clean = lambda v: F.array_distinct(F.transform(F.filter(items_of(v), lambda x: ~is_empty_text(x)), lambda x: apply_chain(x, spec.chain)))

    def of(x: Column) -> Column:
        hits, n, m = x["hits"], x["n"], x["m"]
        # 2PR / (P + R) with P = hits / m and R = hits / n.
        f1 = F.when(hits == 0, F.lit(0.0)).otherwise(2 * (hits / m) * (hits / n) / (hits / m + hits / n))
        share = lambda k: F.when(k > 0, hits / k).otherwise(F.lit(0.0))
        detail = F.format_string("P %.2f R %.2f F1 %.2f (%d/%d)", share(m), share(n), f1, hits, n)
        return (
            F.when((hits == n) & (hits == m), _result(CORRECT, 1.0, F.concat(F.lit("set match · "), detail)))
            .when((hits == 0) & (m > n), _result(HALLUCINATED, f1, F.concat(F.lit("over-read · "), detail)))
            .otherwise(_result(WRONG, f1, detail))
        )

    counted = lambda x: let(F.struct(F.size(F.array_intersect(x["a"], x["b"])).alias("hits"), F.size(x["a"]).alias("n"), F.size(x["b"]).alias("m")), of)
    return (
        F.when(~t["kind"].isin("list", "text"), _result(MALFORMED, 0.0, "unparseable ground truth"))
        .when(~p["kind"].isin("list", "text"), _result(MALFORMED, 0.0, "not a list"))
        .otherwise(let(_both(clean(t), clean(p)), counted))
    )


HANDLERS: dict[str, Callable[[Column, Column, FieldSpec], Column]] = {"exact": _exact, "text": _text, "digits": _digits, "number": _number, "date": _date, "bool": _bool, "set_text": _set_text}


def compare_field(truth: Column, predicted: Column, spec: FieldSpec, key_present: Column | None = None) -> Column:
    """Struct (outcome, score, detail) of two values; emptiness is settled before the mode is asked. An unknown mode compares as text."""
    absent = F.lit("empty value returned") if key_present is None else F.when(key_present, F.lit("empty value returned")).otherwise(F.lit("key absent from output"))
    handler = HANDLERS.get(spec.compare, _text)
    of = lambda x: (
        F.when(x["te"] & x["pe"], _result(CORRECT, 1.0, "both empty"))
        .when(x["te"], _result(HALLUCINATED, 0.0, "ground truth is empty; model returned a value"))
        .when(x["pe"], _result(MISSING, 0.0, absent))
        .otherwise(handler(x["t"], x["p"], spec))
    )
    return let(F.struct(truth.alias("t"), predicted.alias("p"), is_empty(truth).alias("te"), is_empty(predicted).alias("pe")), of)


def spread(cases: DataFrame, by: Sequence[str] = ("run", "case_id")) -> DataFrame:
    """cases dealt out over all cores if they come in fewer partitions, as from one small file; else as they are.

    Scoring is what takes time, so a table in one piece would be scored by one core. The rows are dealt by run and case, which later
    sums for each case need anyway.
    """
    cores = cases.sparkSession.sparkContext.defaultParallelism
    key = [c for c in by if c in cases.columns]
    return cases.repartition(cores, *key) if key and cases.rdd.getNumPartitions() < cores else cases


def score_cases(cases: DataFrame, specs: Sequence[FieldSpec], truth_col: str = "truth", predicted_col: str = "predicted", error_col: str | None = "error") -> DataFrame:
    """The long fact: one row for each case and field, with the case's other columns.

    truth and predicted are variant objects; a null prediction means that the backend refused, and so does each field. The
    modes are known when the plan is made, so each field's expression holds its own mode alone, and no shuffle is
    needed: scoring is one projection over the scan.
    """
    reason = F.lit("no output")
    if error_col and error_col in cases.columns:
        reason = F.coalesce(F.nullif(F.col(error_col), F.lit("")), reason)
    refused = F.col(predicted_col).isNull()
    rows = []
    for k, spec in enumerate(specs):

        def of(x: Column, k: int = k, spec: FieldSpec = spec) -> Column:
            compared = F.when(x["refused"], _result(REFUSED, 0.0, reason)).otherwise(compare_field(x["t"], x["p"], spec, x["there"]))
            return F.struct(F.lit(spec.name).alias("field"), F.lit(k).alias("field_pos"), compared.alias("r"), x["t"]["text"].alias("truth_text"), x["p"]["text"].alias("predicted_text"))

        both = F.struct(value_of(F.col(truth_col), spec.name).alias("t"), value_of(F.col(predicted_col), spec.name).alias("p"), has_key(F.col(predicted_col), spec.name).alias("there"), refused.alias("refused"))
        rows.append(let(both, of))
    rest = [c for c in cases.columns if c not in (truth_col, predicted_col)]
    long = cases.select(*rest, F.explode(F.array(*rows)).alias("x"))
    return long.select(*rest, "x.field", "x.field_pos", "x.r.outcome", "x.r.score", "x.r.detail", F.col("x.truth_text").alias("truth"), F.col("x.predicted_text").alias("predicted"))
