"""Reports of runs and differences, as Markdown, HTML, JSON and plain text. Only small results are collected."""

from __future__ import annotations

import html
import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.operators import metrics as metrics_of
from docgauge.operators import resample, selective

#: Accuracies for which a report says how much can be automated; least gain of a ranking that is worth something.
QUALITY_TARGETS, LEAST_GAIN = (0.90, 0.95, 0.99), 0.05
#: Shares from which a figure is marked: hallucination rates, and how far a tag is below the best.
WARN_HALLUCINATION, WARN_TAG_GAP = 0.01, 0.10
#: What a verdict calls a change: hallucination rate, and latency ratio either way.
HALLUCINATION_CHANGE, LATENCY_CHANGE = 0.005, 0.15


def percent(value: float | None) -> str:
    return "–" if value is None else f"{100 * value:.2f}%"


def signed(value: float | None, as_percent: bool = False) -> str:
    return "–" if value is None else f"{100 * value:+.2f} pp" if as_percent else f"{value:+.3f}"


def figures(df: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in df.collect()]


def run_figures(metrics: DataFrame, fields: DataFrame, tags: DataFrame, intervals: DataFrame | None = None, selective: dict[str, Any] | None = None) -> dict[str, Any]:
    """All that a report of one run shows."""
    ordered = tags.orderBy("accuracy", "tag")
    return {"run": figures(metrics)[0], "fields": figures(fields), "tags": figures(ordered), "intervals": {r["statistic"]: r for r in figures(intervals)} if intervals is not None else {}, "selective": selective or {}}


def assembled(fields: DataFrame, cases: DataFrame, names: list[str], weights: dict[str, float] | None = None, critical: list[str] | None = None, iterations: int = resample.ITERATIONS, seed: int = resample.SEED, confidence_field: str = "confidence") -> dict[str, Any]:
    """Every metric of a run in one result: run, fields, tags, intervals and selective prediction. The fact is summed for each case once."""
    names = names or metrics_of.field_names(fields).first()["field_names"]
    vectors = metrics_of.case_vectors(fields, names, critical or []).persist()
    slim = cases.select(*[c for c in ("run", "case_id", "case_pos", "tags", "latency_ms", "tokens_in", "tokens_out", "cost_usd", "cached") if c in cases.columns])
    per_field = sort_fields(metrics_of.field_metrics(fields, critical=critical or []), names)
    intervals = resample.bootstrap_ci(vectors, names, weights, iterations, seed) if iterations >= resample.LEAST_ITERATIONS else None
    return run_figures(metrics_of.run_metrics(vectors, slim, names, weights), per_field, metrics_of.by_tag(vectors, slim, names, weights), intervals, selective_figures(fields, confidence_field))


def selective_figures(fields: DataFrame, confidence_field: str = "confidence", holdout_target: float = 0.95) -> dict[str, Any]:
    """What the selective block shows: areas, operating points, coverage at given accuracies, and the hold-out policy."""
    confident = selective.case_confidence(fields, confidence_field).persist()
    summary = figures(selective.selective_report(fields, confidence_field))
    if not summary:
        return {}
    curve = selective.risk_coverage(confident).persist()
    wide = {t: selective.coverage_for(curve, t).first()["coverage"] for t in QUALITY_TARGETS}
    return {**summary[0], "points": figures(selective.operating_points(curve).orderBy("target")), "coverage_for": wide, "holdout": figures(selective.holdout(confident, holdout_target))[0]}


def selective_block(s: dict[str, Any]) -> list[str]:
    if not s:
        return []
    out = ["## Selective prediction", "", f"Confidence is the {s['source']}. Area {s['aurc']:.4f}, of random orders {s['random_aurc']:.4f}, gain {percent(s['ranking_gain'])}."]
    if s["ranking_gain"] < LEAST_GAIN:
        out.append("⚠ This confidence ranks hardly better than chance: sending the least sure documents to review would pick them at random.")
    rows = [[percent(p["coverage"]), str(p["n_accepted"]), f"{p['accuracy']:.3f}", percent(p["risk"]), percent(p["hallucination_rate"])] for p in s["points"]]
    out += ["", *_table(["automated", "n", "accuracy", "errors that pass", "hallucinated"], rows)]
    out += [f"- accuracy of {t:.2f} at least: {percent(c)} of the documents" + ("" if c else " (at no coverage)") for t, c in s["coverage_for"].items()]
    h = s["holdout"]
    out += ["", f"Hold-out for {h['target']:.2f}: coverage {percent(h['coverage'])}, accuracy {h['accuracy']:.3f} [{h['low']:.3f}, {h['high']:.3f}], lift {signed(h['lift'])}, met on {percent(h['hit_rate'])} of the splits that have a policy.", ""]
    return out


def _table(head: list[str], rows: list[list[str]]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *["| " + " | ".join(r) + " |" for r in rows], ""]


def _with_interval(value: float, ci: dict[str, Any] | None) -> str:
    return f"{value:.3f}" + (f" [{ci['low']:.3f}, {ci['high']:.3f}]" if ci and ci["low"] is not None else "")


def _rows(shown: dict[str, Any]) -> tuple[list[list[str]], list[list[str]], list[list[str]]]:
    run, ci = shown["run"], shown["intervals"]
    warn = lambda v, limit: percent(v) + (" ⚠" if v > limit else "")
    best = max((t["accuracy"] for t in shown["tags"]), default=0.0)
    summary = [
        ["macro accuracy", _with_interval(run["macro_accuracy"], ci.get("macro_accuracy"))],
        ["all fields correct", _with_interval(run["all_fields_correct"], ci.get("all_fields_correct"))],
        ["hallucination rate", warn(run["hallucination_rate"], WARN_HALLUCINATION)],
        ["critical hallucination rate", warn(run["critical_hallucination_rate"], WARN_HALLUCINATION)],
        ["latency p50 / p95 ms", f"{run['latency_p50']:.0f} / {run['latency_p95']:.0f}"],
        ["tokens in / out, mean", f"{run['tokens_in_mean']:.0f} / {run['tokens_out_mean']:.0f}"],
        ["cases, refused, cached", f"{run['n_cases']}, {run['n_refused']}, {run['n_cached']}"],
    ]
    fields = [[f["field"] + (" (critical)" if f["critical"] else ""), str(f["n"]), _with_interval(f["accuracy"], ci.get(f"accuracy:{f['field']}")), *[percent(f[f"{o}_rate"]) for o in ("missing", "hallucinated", "wrong", "malformed", "refused")], f"{f['mean_score']:.3f}"] for f in shown["fields"]]
    tags = [[t["tag"] + (" ⚠" if best - t["accuracy"] > WARN_TAG_GAP else ""), str(t["n"]), f"{t['accuracy']:.3f}", f"{t['all_fields_correct']:.3f}"] for t in shown["tags"]]
    return summary, fields, tags


_FIELD_HEAD = ["field", "n", "accuracy", "missing", "hallucinated", "wrong", "malformed", "refused", "mean score"]


def markdown_run(shown: dict[str, Any]) -> str:
    summary, fields, tags = _rows(shown)
    out = [f"# {shown['run']['run']}", "", *_table(["figure", "value"], summary), "## Fields", "", *_table(_FIELD_HEAD, fields), "## Tags, worst first", "", *_table(["tag", "n", "accuracy", "all fields correct"], tags)]
    out += selective_block(shown["selective"])
    return "\n".join(out)


def _html(title: str, parts: list[tuple[str, list[str], list[list[str]]] | str]) -> str:
    cell = lambda r, t: "<tr>" + "".join(f"<{t}>{html.escape(c)}</{t}>" for c in r) + "</tr>"
    shown = [f"<p>{html.escape(p)}</p>" if isinstance(p, str) else (f"<h2>{html.escape(p[0])}</h2>" if p[0] else "") + "<table>" + cell(p[1], "th") + "".join(cell(r, "td") for r in p[2]) + "</table>" for p in parts]
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{''.join(shown)}</body></html>"


def html_run(shown: dict[str, Any]) -> str:
    summary, fields, tags = _rows(shown)
    prose = [line for line in selective_block(shown["selective"]) if line and line[0] not in "|#"]
    return _html(shown["run"]["run"], [("", ["figure", "value"], summary), ("Fields", _FIELD_HEAD, fields), ("Tags", ["tag", "n", "accuracy", "all fields correct"], tags), *prose])


def text_run(shown: dict[str, Any]) -> str:
    summary, fields, _ = _rows(shown)
    return "\n".join([shown["run"]["run"], *[f"  {a:<28} {b}" for a, b in summary], *[f"  {r[0]:<28} {r[2]}" for r in fields]])


def verdict(deltas: list[dict[str, Any]], base: dict[str, Any], candidate: dict[str, Any]) -> str:
    """One sentence for each thing that changed: accuracy by its interval, hallucination and latency by fixed limits."""
    macro = next(d for d in deltas if d["statistic"] == "macro_accuracy")
    said = ["accuracy can't be told apart" if not macro["significant"] else "accuracy is better" if macro["delta"] > 0 else "accuracy is worse"]
    change = candidate["hallucination_rate"] - base["hallucination_rate"]
    if abs(change) > HALLUCINATION_CHANGE:
        said.append(f"hallucination {'rises' if change > 0 else 'falls'} by {abs(100 * change):.2f} pp")
    ratio = candidate["latency_p50"] / base["latency_p50"] if base["latency_p50"] else 0.0
    if base["latency_p50"] and abs(ratio - 1) > LATENCY_CHANGE:
        said.append(f"median latency is {ratio:.2f} times as long")
    fields = [d for d in deltas if d["statistic"].startswith("accuracy:") and d["significant"] and d["delta"] < 0]
    if fields:
        worst = min(fields, key=lambda d: d["delta"])
        said.append(f"worst regression: {worst['statistic'].removeprefix('accuracy:')} ({signed(worst['delta'])})")
    return "; ".join(said) + "."


def _diff_rows(deltas: list[dict[str, Any]], base: dict[str, Any], candidate: dict[str, Any]) -> tuple[list[str], list[list[str]]]:
    rows = [[d["statistic"].removeprefix("accuracy:"), f"{d['baseline']:.3f}", f"{d['candidate']:.3f}", signed(d["delta"]), "–" if d["low"] is None else f"[{d['low']:+.3f}, {d['high']:+.3f}]", "yes" if d["significant"] else "no", signed(d["hallucination_delta"], True), signed(d["missing_delta"], True)] for d in deltas]
    return ["figure", base["run"], candidate["run"], "delta", "interval", "significant", "hallucinated", "missing"], rows


def markdown_diff(deltas: list[dict[str, Any]], base: dict[str, Any], candidate: dict[str, Any], comparable: bool = True, reason: str = "") -> str:
    note = [] if comparable else [f"**Not comparable: {reason}**", ""]
    return "\n".join([f"# {candidate['run']} against {base['run']}", "", *note, verdict(deltas, base, candidate), "", f"Paired cases: {deltas[0]['n_paired']}", "", *_table(*_diff_rows(deltas, base, candidate))])


def html_diff(deltas: list[dict[str, Any]], base: dict[str, Any], candidate: dict[str, Any], comparable: bool = True, reason: str = "") -> str:
    note = [] if comparable else [f"Not comparable: {reason}"]
    return _html(f"{candidate['run']} against {base['run']}", [*note, verdict(deltas, base, candidate), f"Paired cases: {deltas[0]['n_paired']}", ("", *_diff_rows(deltas, base, candidate))])


_BOARD_HEAD = ["#", "run", "macro", "all correct", "hallucination", "critical", "p50 ms"]


def _board_rows(board: DataFrame) -> list[list[str]]:
    return [[str(r["place"]), r["run"], f"{r['macro_accuracy']:.3f}", f"{r['all_fields_correct']:.3f}", percent(r["hallucination_rate"]), percent(r["critical_hallucination_rate"]), f"{r['latency_p50']:.0f}"] for r in figures(board.orderBy("place"))]


def sweep_table(board: DataFrame) -> str:
    return "\n".join(_table(_BOARD_HEAD, _board_rows(board)))


def html_sweep(board: DataFrame) -> str:
    return _html("Leaderboard", [("", _BOARD_HEAD, _board_rows(board))])


def echo_text(echoes: DataFrame) -> str:
    rows = figures(echoes)
    lines = [f"{'SUSPICIOUS ' if r['suspicious'] else ''}{r['literal']!r}: predicted {r['n_predicted']}, true {r['n_truth']} of {r['n_cases']}; accuracy {percent(r['accuracy_echoed'])} against {percent(r['accuracy_other'])}" for r in rows]
    return "\n".join(lines) or "no literal of the prompt is predicted"


def write_reports(shown: dict[str, Any], folder: str) -> list[str]:
    """Markdown, HTML and JSON beside each other; their paths."""
    place = Path(folder)
    place.mkdir(parents=True, exist_ok=True)
    made = {"md": markdown_run(shown), "html": html_run(shown), "json": json.dumps(shown, ensure_ascii=False, indent=2, default=str)}
    for kind, text in made.items():
        (place / f"{shown['run']['run']}.{kind}").write_text(text, encoding="utf-8")
    return [str(place / f"{shown['run']['run']}.{kind}") for kind in made]


def gate(run: dict[str, Any], fail_under: float | None = None, fail_hallucination_over: float | None = None) -> list[str]:
    """What a run fails: macro accuracy below, or hallucination above, a limit."""
    out = []
    if fail_under is not None and run["macro_accuracy"] < fail_under:
        out.append(f"macro accuracy {run['macro_accuracy']:.3f} is below {fail_under}")
    if fail_hallucination_over is not None and run["hallucination_rate"] > fail_hallucination_over:
        out.append(f"hallucination rate {run['hallucination_rate']:.4f} is above {fail_hallucination_over}")
    return out


def gate_diff(deltas: list[dict[str, Any]], on_regression: bool = False, under_delta: float | None = None) -> list[str]:
    """What a difference fails: a significant regression of a field, or a macro delta below a limit."""
    out = []
    bad = [d["statistic"] for d in deltas if d["statistic"].startswith("accuracy:") and d["significant"] and d["delta"] < 0]
    if on_regression and bad:
        out.append("significant regression: " + ", ".join(bad))
    macro = next(d["delta"] for d in deltas if d["statistic"] == "macro_accuracy")
    if under_delta is not None and macro < under_delta:
        out.append(f"macro delta {macro:+.3f} is below {under_delta}")
    return out


def sort_fields(fields: DataFrame, names: list[str]) -> DataFrame:
    return fields.orderBy(F.array_position(F.array(*map(F.lit, names)), F.col("field")))
