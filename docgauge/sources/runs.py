"""Stored runs: a folder of run documents (JSON) and the same as Parquet facts."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.functions.text import safe_name
from docgauge.operators.metrics import case_key
from docgauge.sources import files

FIELD = "struct<field:string,outcome:string,truth:variant,predicted:variant,score:double,detail:string>"
CASE = f"struct<case_id:string,tags:array<string>,fields:array<{FIELD}>,latency_ms:double,tokens_in:bigint,tokens_out:bigint,cost_usd:double,error:string,raw_output:string,cached:boolean>"
RUN = f"name string, corpus_name string, corpus_hash string, config_name string, config_hash string, field_names array<string>, weights map<string,double>, critical_fields array<string>, provenance variant, started_at string, finished_at string, cases array<{CASE}>"


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each run document that can be read; others are passed over."""
    return spark.read.schema(RUN).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).where("name is not null")


def facts(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The long fact and the cases of stored runs."""
    each = runs.select(F.col("name").alias("run"), F.posexplode("cases").alias("case_pos", "c"))
    cases = each.select("run", "case_pos", "c.case_id", F.coalesce("c.tags", F.array().cast("array<string>")).alias("tags"), *[F.coalesce(f"c.{n}", F.lit(0)).alias(n) for n in ("latency_ms", "tokens_in", "tokens_out", "cost_usd")], F.coalesce("c.error", F.lit("")).alias("error"), F.coalesce("c.raw_output", F.lit("")).alias("raw_output"), F.coalesce("c.cached", F.lit(False)).alias("cached"))
    fields = each.select("run", "case_pos", "c.case_id", F.posexplode("c.fields").alias("field_pos", "f"))
    return fields.select("run", "case_pos", "case_id", "field_pos", "f.field", "f.outcome", "f.score", "f.detail", F.col("f.truth").cast("string").alias("truth"), F.col("f.predicted").cast("string").alias("predicted")), cases


def list_runs(runs: DataFrame) -> DataFrame:
    """Stored runs, the last to finish first."""
    return runs.select("name", "corpus_name", "corpus_hash", "config_name", "finished_at", F.size("cases").alias("n_cases")).orderBy(F.desc("finished_at"), "name")


def file_name(spark: SparkSession, name: str) -> str:
    return spark.range(1).select(safe_name(F.lit(name))).first()[0]


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


META = ("name", "corpus_name", "corpus_hash", "config_name", "config_hash", "field_names", "weights", "critical_fields", "provenance", "started_at", "finished_at")


def save(spark: SparkSession, folder: str, fields: DataFrame, cases: DataFrame, meta: dict, overwrite: bool = False) -> str:
    """Writes a run's facts as Parquet, and what is said about it as JSON last, so that a run that broke off isn't listed; an existing run stays unless it is to be overwritten."""
    base = f"{folder.rstrip('/')}/{file_name(spark, meta['name'])}"
    if files.exists(spark, f"{base}/meta.json") and not overwrite:
        raise FileExistsError(f"{base} is there already; --overwrite replaces it")
    fields.write.mode("overwrite").parquet(f"{base}/fields")
    cases.write.mode("overwrite").parquet(f"{base}/cases")
    files.write_text(spark, f"{base}/meta.json", [json.dumps(meta, ensure_ascii=False, indent=2, default=str)])
    return base


def load(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame, dict]:
    """Fields, cases and what is said about a stored run, by its name or by the path of a run document."""
    if name.endswith(".json"):
        if not files.exists(spark, name):
            raise FileNotFoundError(f"no run document {name}")
        read = read_runs(spark, name)
        said = read.select(*[c for c in META if c != "provenance"], F.to_json("provenance").alias("provenance")).first()
        if said is None:
            raise ValueError(f"{name} is no run document")
        fields, cases = facts(read)
        meta = said.asDict(recursive=True)
        return fields, cases, meta | {"provenance": json.loads(meta["provenance"] or "{}"), **{k: meta[k] or [] for k in ("field_names", "critical_fields")}, "weights": meta["weights"] or {}}
    base = f"{folder.rstrip('/')}/{file_name(spark, name)}"
    if not files.exists(spark, f"{base}/meta.json"):
        raise FileNotFoundError(f"no run {name} in {folder}")
    return spark.read.parquet(f"{base}/fields"), spark.read.parquet(f"{base}/cases"), json.loads(files.read_text(spark, f"{base}/meta.json"))


def listed(spark: SparkSession, folder: str) -> list[dict]:
    """What is said about the stored runs, the last to finish first; folders without a readable description are passed over."""
    out = []
    for path in files.children(spark, folder):
        try:
            out.append(json.loads(files.read_text(spark, f"{path}/meta.json")))
        except Exception:  # noqa: BLE001, S112  no run, or one that broke off
            continue
    return sorted(sorted(out, key=lambda m: m.get("name", "")), key=lambda m: m.get("finished_at") or "", reverse=True)


def write_document(spark: SparkSession, path: str, fields: DataFrame, cases: DataFrame, meta: dict, overwrite: bool = False) -> None:
    """A run as one JSON document, as read_runs() reads it. Cases pass through the driver one after the other; values are texts, as they were compared."""
    if files.exists(spark, path) and not overwrite:
        raise FileExistsError(f"{path} is there already")
    key = case_key(fields, cases)
    own = F.struct("field_pos", *[c for c in ("field", "outcome", "truth", "predicted", "score", "detail") if c in fields.columns])
    each = fields.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(own)), lambda x: x.dropFields("field_pos")).alias("fields"))
    raw = F.col("raw_output" if "raw_output" in cases.columns else "raw").alias("raw_output")
    joined = cases.select(*key, "tags", "latency_ms", "tokens_in", "tokens_out", "cost_usd", "error", raw, "cached").join(each, key, "left")
    rows = joined.orderBy(*[c for c in ("case_pos", "case_id") if c in key])
    document = F.to_json(F.struct("case_id", "tags", F.coalesce("fields", F.array().cast(each.schema["fields"].dataType)).alias("fields"), "latency_ms", "tokens_in", "tokens_out", "cost_usd", "error", "raw_output", "cached"), {"ignoreNullFields": "false"})

    def parts():
        head = json.dumps({k: meta.get(k) for k in META}, ensure_ascii=False, indent=2, default=str)
        yield head[: head.rindex("}")].rstrip() + ',\n  "cases": ['
        for i, r in enumerate(rows.select(document.alias("c")).toLocalIterator()):
            yield (",\n    " if i else "\n    ") + r["c"]
        yield "\n  ]\n}\n"

    files.write_text(spark, path, parts(), overwrite)
