"""Command line: validate, run, report, echo, diff, sweep, list, cache. Exit codes: 0, 2 a gate failed, 3 bad input."""

from __future__ import annotations

import argparse
import glob
import json
import platform
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docgauge.operators import corpus, diff, leakage, metrics, resample
from docgauge.plans import report
from docgauge.plans.evaluate import run_config
from docgauge.sources import backends, config, images, manifest, runs
from docgauge.sources.cache import Cache

VERSION, GATE_FAILED, BAD_INPUT, SHOWN_PROBLEMS = "0.2.0", 2, 3, 100


class BadInput(Exception):
    """What the user gave can't be used."""


def _schema(folder: str) -> config.Schema:
    found = [p for p in (Path(folder) / f"schema{s}" for s in (".json", ".yaml", ".yml")) if p.exists()]
    if not found:
        raise BadInput(f"{folder}: no schema.json or schema.yaml")
    return config.load_schema(str(found[0]))


def _corpus(spark, folder: str, schema: config.Schema, strict: bool = True):
    """Cases with the hashes of their images, the images, and what is wrong with the manifest."""
    lines = manifest.read_lines(spark, f"{folder}/manifest.jsonl")
    cases = corpus.cases_of(lines)
    found = images.of_corpus(spark, folder, cases)
    problems = corpus.manifest_problems(lines, schema.names, found)
    if strict and (first := problems.orderBy("lineno", "problem").limit(SHOWN_PROBLEMS + 1).collect()):
        more = ["..."] if len(first) > SHOWN_PROBLEMS else []
        raise BadInput("\n".join([f"line {p['lineno']}: {p['problem']}" for p in first[:SHOWN_PROBLEMS]] + more))
    return cases.join(images.hashed(found), "image", "left"), found, problems


def _shown(fields, cases, meta, iterations):
    return report.assembled(fields, cases, meta["field_names"], meta["weights"], meta["critical_fields"], iterations)


def _one_run(spark, a, schema, cases, found, path, name=None):
    c, began = config.load_config(path), runs.now()
    backend, weighing = backends.build_for(c), config.scoring_policy(schema, c)
    images.settings(c.preprocess)  # an unknown profile is bad input, not a failure of each case
    hashed = corpus.corpus_hash(cases.select("id", "image_hash", F.to_json("truth").alias("truth")), schema.hash).first()[0]
    fields, rows = run_config(cases, schema, c, backend, name, None if a.no_cache else Cache(spark, a.cache_dir), a.concurrency, found)
    told = {
        "version": VERSION, "python": platform.python_version(), "platform": platform.platform(), "spark": spark.version, "config": {k: getattr(c, k) for k in c.__dataclass_fields__}, "prompt_hash": c.prompt_hash, "schema_hash": schema.hash, "corpus_hash": hashed,
        "concurrency": a.concurrency, "preprocess": images.describe(c.preprocess), "backend": backend.describe(),
    }
    meta = {"name": name or c.name, "corpus_name": Path(a.corpus).resolve().name, "corpus_hash": hashed, "config_name": c.name, "config_hash": c.hash, "field_names": schema.names, "weights": weighing[0], "critical_fields": weighing[1], "provenance": told, "started_at": began}
    runs.save(spark, a.runs_dir, fields, rows, meta | {"finished_at": runs.now()}, a.overwrite)
    return runs.load(spark, a.runs_dir, meta["name"])


def _slim(cases):
    return cases.select(*[c for c in ("run", "case_id", "case_pos", "tags", "latency_ms", "tokens_in", "tokens_out", "cost_usd", "cached") if c in cases.columns])


def _diff(spark, a, base, candidate):
    (f0, c0, m0), (f1, c1, m1) = base, candidate
    names, weights = m0["field_names"], m0["weights"]
    v0, v1 = (metrics.case_vectors(f, names, m0["critical_fields"]).persist() for f in (f0, f1))
    deltas = report.figures(diff.diff_runs(v0, v1, names, weights, a.bootstrap).orderBy(F.col("statistic") != "macro_accuracy", "statistic"))
    full = [report.figures(metrics.run_metrics(v, _slim(c), names, weights))[0] for v, c in ((v0, c0), (v1, c1))]
    return deltas, full


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="docgauge", description=__doc__)
    top.add_argument("--version", action="version", version=VERSION)
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, *options: str):
        p = verbs.add_parser(name)
        known = {
            "corpus": ("--corpus", {"required": True}), "config": ("--config", {"required": True}), "configs": ("--configs", {"required": True}), "name": ("--name", {}), "limit": ("--limit", {"type": int, "default": 0}), "tags": ("--tags", {}), "exclude": ("--exclude-tags", {}),
            "concurrency": ("--concurrency", {"type": int}), "cache": ("--cache-dir", {"default": ".cache"}), "nocache": ("--no-cache", {"action": "store_true"}), "runs": ("--runs-dir", {"default": "runs"}), "out": ("--out", {}), "bootstrap": ("--bootstrap", {"type": int, "default": resample.ITERATIONS}),
            "overwrite": ("--overwrite", {"action": "store_true"}), "under": ("--fail-under", {"type": float}), "over": ("--fail-hallucination-over", {"type": float}), "run": ("run", {}), "format": ("--format", {"choices": ["text", "md", "html", "json"], "default": "text"}), "baseline": ("baseline", {}),
            "candidate": ("candidate", {}), "force": ("--force", {"action": "store_true"}), "regression": ("--fail-on-regression", {"action": "store_true"}), "delta": ("--fail-under-delta", {"type": float}), "clear": ("--clear", {"action": "store_true"}), "against": ("--baseline", {}), "document": ("--document", {}),
        }
        for o in options:
            p.add_argument(known[o][0], **known[o][1])

    verb("validate", "corpus")
    verb("run", "corpus", "config", "name", "limit", "tags", "exclude", "concurrency", "cache", "nocache", "runs", "out", "bootstrap", "overwrite", "under", "over", "document")
    verb("report", "run", "format", "out", "runs", "bootstrap")
    verb("echo", "run", "config", "runs")
    verb("diff", "baseline", "candidate", "runs", "format", "bootstrap", "force", "regression", "delta")
    verb("sweep", "corpus", "configs", "out", "runs", "concurrency", "limit", "nocache", "cache", "bootstrap", "against")
    verb("list", "runs")
    verb("cache", "clear", "cache")
    a = top.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        return _VERBS[a.verb](spark, a)
    except (BadInput, ValueError, KeyError, FileNotFoundError, FileExistsError) as e:
        print(e, file=sys.stderr)
        return BAD_INPUT


def _failed(problems: list[str]) -> int:
    for p in problems:
        print(p, file=sys.stderr)
    return GATE_FAILED if problems else 0


def _validate(spark, a) -> int:
    schema = _schema(a.corpus)
    cases, _, problems = _corpus(spark, a.corpus, schema, strict=False)
    wrong = False
    for p in problems.orderBy("lineno", "problem").toLocalIterator():
        wrong = True
        print(f"line {p['lineno']}: {p['problem']}")
    if not wrong:
        print(f"{cases.count()} cases")
        for r in metrics.tag_counts(cases).orderBy(F.desc("n"), "tag").collect():
            print(f"  {r['tag']} {r['n']}")
    return BAD_INPUT if wrong else 0


def _run(spark, a) -> int:
    schema = _schema(a.corpus)
    cases, found, _ = _corpus(spark, a.corpus, schema)
    cases = corpus.narrow(cases, config.split_list(a.tags), config.split_list(a.exclude_tags), a.limit or None)
    fields, rows, meta = _one_run(spark, a, schema, cases, found, a.config, a.name)
    shown = _shown(fields, rows, meta, a.bootstrap)
    print(report.text_run(shown))
    if a.document:
        runs.write_document(spark, a.document, fields, rows, meta, a.overwrite)
    if a.out:
        report.write_reports(shown, a.out)
    return _failed(report.gate(shown["run"], a.fail_under, a.fail_hallucination_over))


def _report(spark, a) -> int:
    shown = _shown(*runs.load(spark, a.runs_dir, a.run), a.bootstrap)
    if a.out:
        print("\n".join(report.write_reports(shown, a.out)))
    else:
        print({"text": report.text_run, "md": report.markdown_run, "html": report.html_run, "json": lambda s: json.dumps(s, ensure_ascii=False, indent=2, default=str)}[a.format](shown))
    return 0


def _echo(spark, a) -> int:
    fields, _, meta = runs.load(spark, a.runs_dir, a.run)
    c = config.load_config(a.config)
    if meta["provenance"].get("prompt_hash") != c.prompt_hash:
        raise BadInput("the run was made with another prompt")
    echoes = leakage.echo_report(fields, leakage.prompt_literals(spark, c.prompt))
    print(report.echo_text(leakage.top_echoes(echoes)))
    return GATE_FAILED if leakage.suspicious(echoes).take(1) else 0


def _diff_verb(spark, a) -> int:
    base, candidate = (runs.load(spark, a.runs_dir, n) for n in (a.baseline, a.candidate))
    same = base[2]["corpus_hash"] == candidate[2]["corpus_hash"]
    if not same and not a.force:
        raise BadInput("the runs are over different corpora; --force compares the cases they share")
    deltas, full = _diff(spark, a, base, candidate)
    said = (deltas, *full, same, "" if same else "different corpora")
    print(json.dumps(deltas, indent=2) if a.format == "json" else (report.html_diff if a.format == "html" else report.markdown_diff)(*said))
    return _failed(report.gate_diff(deltas, a.fail_on_regression, a.fail_under_delta))


def _sweep(spark, a) -> int:
    a.overwrite = True
    schema = _schema(a.corpus)
    cases, found, _ = _corpus(spark, a.corpus, schema)
    cases = corpus.narrow(cases, limit=a.limit or None)
    made = [_one_run(spark, a, schema, cases, found, p) for p in sorted(glob.glob(a.configs))]
    if not made:
        raise BadInput(f"{a.configs}: no configuration")
    every = None
    for position, (fields, rows, meta) in enumerate(made):
        vectors = metrics.case_vectors(fields, meta["field_names"], meta["critical_fields"])
        one = metrics.run_metrics(vectors, _slim(rows), meta["field_names"], meta["weights"]).withColumn("position", F.lit(position))
        every = one if every is None else every.unionByName(one)
    board = metrics.leaderboard(every, "position")
    print(report.sweep_table(board))
    if a.out:
        for fields, rows, meta in made:
            report.write_reports(_shown(fields, rows, meta, a.bootstrap), a.out)
        (Path(a.out) / "leaderboard.html").write_text(report.html_sweep(board), encoding="utf-8")
    base = next((m for m in made if m[2]["name"] == a.baseline), None)
    for other in made if base else []:
        if other is not base:
            deltas, full = _diff(spark, a, base, other)
            print(report.markdown_diff(deltas, *full))
    return 0


def _list(spark, a) -> int:
    for meta in runs.listed(spark, a.runs_dir):
        print(meta["name"])
    return 0


def _cache(spark, a) -> int:
    cache = Cache(spark, a.cache_dir)
    print(f"cleared {cache.clear()}" if a.clear else json.dumps(cache.stats()))
    return 0


_VERBS = {"validate": _validate, "run": _run, "report": _report, "echo": _echo, "diff": _diff_verb, "sweep": _sweep, "list": _list, "cache": _cache}

if __name__ == "__main__":
    sys.exit(main())
