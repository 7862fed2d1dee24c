"""Truths and predictions derived from orders and customers, by one SQL text for Spark and for the checking engine.

A case is an order. The prediction is the truth, disturbed where the order's key has certain remainders; variant k shifts the
remainders, so that two variants are two runs over one corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.operators.scoring import FieldSpec

SPECS = [
    FieldSpec("name", "text", fuzzy_threshold=0.9),
    FieldSpec("account", "digits", critical=True),
    FieldSpec("total", "number", tolerance=0.01, weight=2.0),
    FieldSpec("ordered", "date"),
    FieldSpec("urgent", "bool", weight=0.5),
    FieldSpec("notes", "set_text", critical=True),
    FieldSpec("code", "exact", weight=0.0),
]
NAMES = [s.name for s in SPECS]
WEIGHTS = {s.name: s.weight for s in SPECS}
CRITICAL = [s.name for s in SPECS if s.critical]


def typed_sql(k: int) -> str:
    """Columns t_* and p_* of variant k, and the case's own; understood by both engines."""
    day = "lpad(CAST(day(o_orderdate) AS STRING), 2, '0')"
    month = "lpad(CAST(month(o_orderdate) AS STRING), 2, '0')"
    year = "CAST(year(o_orderdate) AS STRING)"
    key = f"(o_orderkey + {k})"
    amount = "CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS STRING)"
    return f"""
SELECT lpad(CAST(o_orderkey AS STRING), 10, '0') AS case_id, o_orderkey AS case_pos,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE c_name END AS t_name,
  CASE WHEN {key} % 22 = 0 THEN 'n/a' WHEN {key} % 17 = 0 THEN replace(c_name, 'Customer', 'Custumer') WHEN {key} % 19 = 0 THEN 'Someone else'
       WHEN {key} % 5 = 0 THEN upper(replace(c_name, '#', ' - ')) ELSE c_name END AS p_name,
  'CRM ' || CAST(o_custkey AS STRING) || '/RS' AS t_account,
  CASE WHEN {key} % 23 = 0 THEN NULL WHEN {key} % 29 = 0 THEN 'illegible' WHEN {key} % 13 = 0 THEN CAST(o_custkey + 1 AS STRING) ELSE 'crm-' || CAST(o_custkey AS STRING) END AS p_account,
  {amount} AS t_total,
  CASE WHEN {key} % 31 = 0 THEN '' WHEN {key} % 7 = 0 THEN 'R$ ' || replace({amount}, '.', ',') WHEN {key} % 37 = 0 THEN '12-34' WHEN {key} % 8 = 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18, 2)) + 1 AS STRING) ELSE {amount} END AS p_total,
  {year} || '-' || {month} || '-' || {day} AS t_ordered,
  CASE WHEN {key} % 41 = 0 THEN 'sometime' WHEN {key} % 3 = 0 THEN {day} || '/' || {month} || '/' || {year} WHEN {key} % 14 = 0 THEN {year} || '-' || {month} || '-' || CASE WHEN day(o_orderdate) = 1 THEN '02' ELSE '01' END ELSE {year} || '-' || {month} || '-' || {day} END AS p_ordered,
  o_orderstatus = 'F' AS t_urgent,
  CASE WHEN {key} % 43 = 0 THEN 'perhaps' WHEN {key} % 9 = 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'nao' ELSE 'sim' END ELSE CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'NO' END END AS p_urgent,
  lower(o_orderpriority) || '; ' || lower(c_mktsegment) AS t_notes,
  CASE WHEN {key} % 12 = 0 THEN 'one; two; three' WHEN {key} % 10 = 0 THEN upper(o_orderpriority) ELSE upper(c_mktsegment) || ';' || upper(o_orderpriority) END AS p_notes,
  'K' || CAST(o_orderkey AS STRING) AS t_code,
  CASE WHEN {key} % 15 = 0 THEN 'k' || CAST(o_orderkey AS STRING) ELSE 'K' || CAST(o_orderkey AS STRING) END AS p_code,
  {key} % 47 = 0 AS refused,
  c_mktsegment AS tag_segment, 'status ' || o_orderstatus AS tag_status, o_orderpriority AS tag_priority,
  CASE WHEN o_orderkey % 13 = 0 THEN 0.0E0 ELSE CAST(100 + ({key} * 7) % 97 AS DOUBLE) END AS latency_ms,
  CAST(1000 + {key} % 50 AS BIGINT) AS tokens_in, CAST(60 + {key} % 20 AS BIGINT) AS tokens_out, CAST({key} % 10 AS DOUBLE) / 1024 AS cost_usd, {key} % 5 = 0 AS cached
FROM orders JOIN customer ON o_custkey = c_custkey
"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def extraction_run(spark: SparkSession, sf_dir: str, k: int = 0) -> DataFrame:
    """Cases of variant k as a run has them: truth and predicted as variant objects, tags as an array."""
    tables(spark, sf_dir, "orders", "customer")
    typed = spark.sql(typed_sql(k))
    truth = F.to_variant_object(F.struct(F.col("t_name").alias("name"), F.col("t_account").alias("account"), F.col("t_total").cast("double").alias("total"), F.col("t_ordered").alias("ordered"), F.col("t_urgent").alias("urgent"), F.split("t_notes", "; ").alias("notes"), F.col("t_code").alias("code")))
    predicted = F.to_variant_object(F.struct(*[F.col(f"p_{n}").alias(n) for n in NAMES]))
    return typed.select(
        F.lit(f"run{k}").alias("run"), "case_id", "case_pos", F.array("tag_segment", "tag_status", "tag_priority").alias("tags"), truth.alias("truth"), F.when(~F.col("refused"), predicted).alias("predicted"),
        F.when(F.col("refused"), F.lit("timeout")).otherwise(F.lit("")).alias("error"), "latency_ms", "tokens_in", "tokens_out", "cost_usd", "cached")


def outcomes_sql(k: int) -> str:
    """The long fact of variant k, from the typed columns, for the checking engine."""
    blank = "('', 'null', 'none', 'nil', 'n/a', 'na', '-', '--', 'nao informado', 'nao consta', 'ilegivel', 'not available', 'unknown')"
    clean = lambda c: f"trim(regexp_replace(regexp_replace(lower(trim({c})), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    ratio = lambda a, b: f"(1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})))"
    digits = lambda c: f"regexp_replace({c}, '[^0-9]+', '', 'g')"
    number = lambda c: f"TRY_CAST(replace(regexp_replace({c}, '[^0-9,.\\-]', '', 'g'), ',', '.') AS DOUBLE)"
    date = lambda c: f"coalesce(TRY_CAST(CASE WHEN {c} LIKE '____-__-__' THEN {c} END AS DATE), CAST(try_strptime(CASE WHEN {c} LIKE '__/__/____' THEN {c} END, '%d/%m/%Y') AS DATE))"
    bool_ = lambda c: f"CASE WHEN lower({c}) IN ('yes', 'sim', 'true') THEN TRUE WHEN lower({c}) IN ('no', 'nao', 'false') THEN FALSE END"
    items = lambda c: f"list_distinct([{clean('x')} FOR x IN string_split({c}, ';') IF trim(x) <> ''])"
    a, b = clean("t_name"), clean("p_name")
    d, e = digits("t_account"), digits("p_account")
    s, u = items("t_notes"), items("p_notes")
    hits = f"len(list_intersect({s}, {u}))"
    f1 = f"CASE WHEN {hits} = 0 THEN 0.0 ELSE 2.0 * ({hits} / len({u})) * ({hits} / len({s})) / ({hits} / len({u}) + {hits} / len({s})) END"
    rules = [
        ("name", f"CASE WHEN {a} = {b} OR {ratio(a, b)} >= 0.9 THEN 'correct' ELSE 'wrong' END", f"CASE WHEN {a} = {b} THEN 1.0 ELSE {ratio(a, b)} END"),
        ("account", f"CASE WHEN {e} = '' THEN 'malformed' WHEN {d} = {e} THEN 'correct' ELSE 'wrong' END", f"CASE WHEN {e} = '' THEN 0.0 WHEN {d} = {e} THEN 1.0 ELSE {ratio(d, e)} END"),
        ("total", f"CASE WHEN {number('p_total')} IS NULL THEN 'malformed' WHEN abs({number('t_total')} - {number('p_total')}) <= 0.01 THEN 'correct' ELSE 'wrong' END", None),
        ("ordered", f"CASE WHEN {date('p_ordered')} IS NULL THEN 'malformed' WHEN {date('t_ordered')} = {date('p_ordered')} THEN 'correct' ELSE 'wrong' END", None),
        ("urgent", f"CASE WHEN {bool_('p_urgent')} IS NULL THEN 'malformed' WHEN t_urgent = {bool_('p_urgent')} THEN 'correct' ELSE 'wrong' END", None),
        ("notes", f"CASE WHEN {hits} = len({s}) AND {hits} = len({u}) THEN 'correct' WHEN {hits} = 0 AND len({u}) > len({s}) THEN 'hallucinated' ELSE 'wrong' END", f"CASE WHEN {hits} = len({s}) AND {hits} = len({u}) THEN 1.0 ELSE {f1} END"),
        ("code", "CASE WHEN t_code = p_code THEN 'correct' ELSE 'wrong' END", f"CASE WHEN t_code = p_code THEN 1.0 ELSE {ratio('t_code', 'p_code')} END"),
    ]
    parts = []
    for i, (name, rule, score) in enumerate(rules):
        t, p = f"t_{name}", f"p_{name}"
        empty = lambda c: "FALSE" if c == "t_urgent" else f"({c} IS NULL OR lower(trim({c})) IN {blank})"
        outcome = f"CASE WHEN refused THEN 'refused' WHEN {empty(t)} AND {empty(p)} THEN 'correct' WHEN {empty(t)} THEN 'hallucinated' WHEN {empty(p)} THEN 'missing' ELSE {rule} END"
        plain = f"CASE WHEN ({rule}) = 'correct' THEN 1.0 ELSE 0.0 END"
        points = f"CASE WHEN refused THEN 0.0 WHEN {empty(t)} AND {empty(p)} THEN 1.0 WHEN {empty(t)} OR {empty(p)} THEN 0.0 ELSE {score or plain} END"
        parts.append(f"SELECT 'run{k}' AS run, case_id, case_pos, '{name}' AS field, {i} AS field_pos, {outcome} AS outcome, CAST({points} AS DOUBLE) AS score FROM typed{k}")
    return f"typed{k} AS ({typed_sql(k)}), f{k} AS ({' UNION ALL '.join(parts)})"
