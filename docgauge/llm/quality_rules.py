"""Quality rules whose cutoffs are risk-controlled, in DataFrame functions only.

Each rule compares one statistic of a text with a cutoff. The cutoffs are chosen for each stratum (language) on a
labelled holdout, the good documents that pass the base rule: of a grid of candidates, tried from the loosest to the
strictest, the last whose exact (Clopper-Pearson) upper bound on the share of good documents that it rejects is at most
RISK / number of rules. The bounds hold together with confidence 1 - DELTA: each sequence of tests has the level
DELTA / (groups * rules). Strata with too few good documents for a proof are pooled into one group, for which the bound
holds as a whole; a pool too small takes in the next larger strata. Where all together are too few, and in a
stratum without any good document, there is no cutoff, and nothing is rejected.

Edge cases: a null or blank text has no words, and fails the base rule; a null language is a stratum of its own; an
empty table gives an empty result; without labels no document is rejected beyond the base rule; of several labels
of one id the lowest counts; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgauge.llm.common import WORD_SPACE, documents, materialise

#: Largest share of good documents of a stratum that all rules together may reject, and the chance of breaking that.
RISK, DELTA = 0.01, 0.05
# Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]+"
#: Rules: name, statistic as SQL over the counts, and candidates for "more than this is rejected", strictest first.
RULES = [
    ("symbols", "n_symbols / n_words", [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0, 2.0]),
    ("repeats", "n_repeat_words / n_words", [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5]),
    ("lines", "n_dup_lines / n_words", [0.001, 0.003, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2]),
    ("long words", "word_chars / n_words", [6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0]),
    ("short words", "-word_chars / n_words", [-5.0, -4.5, -4.0, -3.5, -3.0, -2.5, -2.0, -1.0]),
    ("few words", "-n_words", [-200.0, -150.0, -120.0, -100.0, -80.0, -70.0, -60.0, -50.0]),
]


def _repeated(words: Column) -> Column:
    """Words in windows of three that are found twice or more.

    A window's hash and its place share a long: sorted longs bring like hashes together without objects. Windows whose
    hashes meet are then compared by their words, so the count is exact.
    """
    place, low = 30, (1 << 30) - 1
    last = F.size(words) - 3
    word = lambda i, k: F.get(words, i + k)
    packed = F.transform(F.sequence(F.lit(0), last), lambda i: F.shiftleft(F.xxhash64(word(i, 0), word(i, 1), word(i, 2)), place).bitwiseOR(i.cast("long")))
    return packed, place, low, word


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs and its counts as long columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    kept = docs.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("__t", text).withColumn("__w", F.filter(F.split("__t", WORD_SPACE + "+"), lambda w: w != ""))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("__l", lines)
    packed, place, low, _ = _repeated(F.col("__w"))
    none = F.array().cast("array<bigint>")
    out = out.withColumn("__p", F.when(F.size("__w") >= 4, F.sort_array(packed)).otherwise(none))
    same = lambda x, y: F.shiftright(x, place) == F.shiftright(y, place)
    # Places whose window's hash is found again: next to its like in the sorted array.
    near = F.filter("__p", lambda x, i: F.coalesce(same(x, F.get("__p", i + 1)), F.lit(False)) | F.coalesce(same(x, F.get("__p", i - 1)), F.lit(False)))
    out = out.withColumn("__n", F.transform(near, lambda x: x.bitwiseAND(low).cast("int")))
    window = lambda i: F.concat_ws(" ", F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2))
    out = out.withColumn("__s", F.when(F.size("__n") > 0, F.array_sort(F.transform("__n", lambda i: F.struct(window(i).alias("s"), i.alias("i"))))))
    true = F.filter("__s", lambda x, k: F.coalesce(x["s"] == F.get("__s", k + 1)["s"], F.lit(False)) | F.coalesce(x["s"] == F.get("__s", k - 1)["s"], F.lit(False)))
    out = out.withColumn("__i", F.when(F.size("__n") > 0, F.sort_array(F.transform(true, lambda x: x["i"]))))
    covered = F.aggregate("__i", F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")), lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(3), i - acc["at"])).alias("n")), lambda acc: acc["n"])
    return out.select(
        *[F.col(c) for c in kept],
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.regexp_replace("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.size("__n") > 0, covered), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), exactly, term by term in logarithms; k is the number of rejected, so few terms count."""
    step = lambda acc, i: F.struct((acc["log"] + F.log((n - i + 1) * F.lit(p) / (i * F.lit(1 - p)))).alias("log"), (acc["sum"] + F.exp(acc["log"] + F.log((n - i + 1) * F.lit(p) / (i * F.lit(1 - p))))).alias("sum"))
    first = F.struct((n * F.log(F.lit(1 - p))).alias("log"), F.exp(n * F.log(F.lit(1 - p))).alias("sum"))
    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(terms, first, step, lambda acc: acc["sum"])


def cutoffs(counted: DataFrame, labels: DataFrame, stratum: str = "stratum", id_col: str = "doc_id", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff: the strictest cutoff proved safe. At most strata * rules rows.

    The upper bound on the false rejection is at most r exactly if P(X <= k | n, r) is at most the test's level. What a
    cutoff rejects, stricter ones reject too, so all cutoffs before the strictest that is proved are proved as well: the
    sequence needs no division by the grid.
    """
    each = risk / len(RULES)
    good = labels.groupBy(id_col).agg(F.min("quality").alias("quality")).where("quality = 1").select(F.col(id_col).alias("__id"))
    held = counted.join(good, counted[id_col] == good["__id"], "left_semi").where(~base_failed())
    tried = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(c).alias("cutoff"), (_value(stat) > c).alias("rejected")) for name, stat, grid in RULES for c in grid])
    rows = held.select(stratum, F.explode(tried).alias("x"))
    tests = rows.groupBy(stratum, "x.rule", "x.cutoff").agg(F.count(F.lit(1)).alias("n"), F.count_if("x.rejected").alias("k"))
    # One row for each stratum from here on: which are alone and which are pooled follows from the numbers of documents only.
    per = tests.groupBy(stratum).agg(F.max("n").alias("n"), F.collect_list(F.struct("rule", "cutoff", "k")).alias("tests"))
    every, upto = _all_rows(), _all_rows().orderBy("n", stratum).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = lambda groups: F.lit(delta) / (groups * F.lit(len(RULES)))
    need = F.log(level(F.count(F.lit(1)).over(every) + 1)) / F.log(F.lit(1 - each))
    smaller = F.sum("n").over(upto) - F.col("n")
    alone = F.max((F.col("n") >= F.col("need")) & ((F.col("smaller") == 0) | (F.col("smaller") >= F.col("need")))).over(upto)
    dealt = per.withColumn("need", need).withColumn("smaller", smaller).withColumn("alone", alone).withColumn("group", F.when(F.col("alone"), F.col(stratum)))
    groups = F.count_if("alone").over(every) + F.max((~F.col("alone")).cast("long")).over(every)
    dealt = dealt.withColumn("level", level(groups)).select(stratum, "group", "n", "level", F.explode("tests").alias("x"))
    whole = Window.partitionBy("group", "x.rule", "x.cutoff")
    summed = dealt.withColumn("k", F.sum("x.k").over(whole)).withColumn("n", F.sum("n").over(whole))
    sure = summed.where((F.col("k") <= F.col("n") * each) & (binomial_cdf(F.col("k"), F.col("n"), each) <= F.col("level")))
    return sure.groupBy(stratum, F.col("x.rule").alias("rule")).agg(F.min("x.cutoff").alias("cutoff"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _value(stat: str) -> Column:
    return F.expr(f"double({stat.replace('/ n_words', '/ nullif(n_words, 0)')})")


def _all_rows():
    return Window.partitionBy(F.lit(0))


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Counts, base_failed, the names of the rules broken, and kept, for each row of docs."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col), F.lit("")).alias("stratum"), F.col(text_col).alias("text"))
    counted = materialise(counts(slim).drop("text"), "quality-counts")
    labelled = labels.select(F.col(id_col).alias("doc_id"), "quality")
    table = cutoffs(counted, labelled, risk=risk, delta=delta)
    # At most as many rows as there are strata; broadcast only by Spark's own size check.
    limits = table.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits"))
    joined = counted.join(limits.withColumnRenamed("stratum", "__stratum"), F.col("stratum") == F.col("__stratum"), "left")
    broken = F.array_compact(F.array(*[F.when(_value(stat) > F.try_element_at("limits", F.lit(name)), F.lit(name)) for name, stat, _ in RULES]))
    out = joined.withColumn("base_failed", base_failed()).withColumn("broken", broken)
    return out.select(F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"), F.array_join("broken", ",").alias("broken"))


def query(spark, sf_dir: str) -> DataFrame:
    return verdicts(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_WORDS = r"[^\x20\x09-\x0D]+"
_VALUE = "CASE rule " + " ".join(f"WHEN '{name}' THEN {stat.replace('/ n_words', '/ nullif(n_words, 0)')}" for name, stat, _ in RULES) + " END"
_GRID = ", ".join(f"({k}, '{name}', {cutoff}::DOUBLE)" for k, (name, _, grid) in enumerate(RULES) for cutoff in grid)
_EACH = RISK / len(RULES)

#: The same counts, proofs and verdicts; the binomial is summed by its terms' logarithms.
ORACLE_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
words AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t),
win AS (SELECT r, i, x || ' ' || lead(x) OVER p || ' ' || lead(x, 2) OVER p AS s FROM words WINDOW p AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM win WHERE s IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, (VALUES (0), (1), (2)) AS o(j) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORDS}')) AS l FROM t),
c AS (
  SELECT r, doc_id, stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed
  FROM t JOIN lines USING (r) LEFT JOIN rep USING (r)
),
grid AS (SELECT * FROM (VALUES {_GRID}) AS g(place, rule, cutoff)),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
held AS (SELECT * FROM c SEMI JOIN good USING (doc_id) WHERE NOT base_failed),
tests AS (SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER (WHERE {_VALUE} > cutoff) AS k FROM held, grid GROUP BY ALL),
per AS (SELECT stratum, max(n) AS n FROM tests GROUP BY stratum),
sized AS (SELECT *, ln({DELTA} / ((count(*) OVER () + 1) * {len(RULES)})) / ln(1 - {_EACH!r}) AS need, sum(n) OVER (ORDER BY n, stratum ROWS UNBOUNDED PRECEDING) - n AS smaller FROM per),
dealt AS (SELECT *, bool_or(n >= need AND (smaller = 0 OR smaller >= need)) OVER (ORDER BY n, stratum ROWS UNBOUNDED PRECEDING) AS alone FROM sized),
levels AS (SELECT stratum, CASE WHEN alone THEN stratum END AS pool, {DELTA} / ((count(*) FILTER (WHERE alone) OVER () + max((NOT alone)::INT) OVER ()) * {len(RULES)}) AS level FROM dealt),
summed AS (SELECT stratum, rule, cutoff, level, sum(k) OVER g AS k, sum(n) OVER g AS n FROM tests JOIN levels USING (stratum) WINDOW g AS (PARTITION BY pool, rule, cutoff)),
proved AS (
  SELECT stratum, rule, min(cutoff) AS limit_ FROM summed WHERE k <= n * {_EACH!r}
    AND list_sum(list_transform(range(0, k::BIGINT + 1), lambda i: exp(lgamma(n + 1.0::DOUBLE) - lgamma(i + 1.0::DOUBLE) - lgamma(n - i + 1.0::DOUBLE) + i * ln({_EACH!r}) + (n - i) * ln(1 - {_EACH!r})))) <= level
  GROUP BY ALL
),
broken AS (
  SELECT r, string_agg(rule, ',' ORDER BY place) AS broken FROM c JOIN proved USING (stratum) JOIN (SELECT DISTINCT place, rule FROM grid) USING (rule) WHERE {_VALUE} > limit_ GROUP BY r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken IS NULL AS kept, coalesce(broken, '') AS broken FROM c LEFT JOIN broken USING (r)
"""
