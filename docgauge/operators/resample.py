"""Bootstrap intervals of ratios and macro accuracies over case vectors.

Every statistic is a function of sums, so a replicate needs one weighted sum of each column. Three ways to weight:

* "poisson": each case has a Poisson(1) weight in each replicate. Cases with equal columns are one pattern with a count, and the
  weights of `count` cases sum to one Poisson(count) number, drawn by a hash of seed, replicate and pattern. So the work depends on
  the patterns, of which there are few, and not on the cases: the way for large runs.
* "draws": n draws with replacement from a hash, for cases numbered from 0. What an SQL engine can redo exactly.
* "mersenne": the same with Python's generator on the driver, n * iterations at most MERSENNE_LIMIT; this redoes
  published intervals for small runs. One table of draws serves all statistics, as each starts from the same seed.

An interval is null below LEAST_CASES cases or LEAST_ITERATIONS replicates.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgauge.functions.arrays import count_up_to, scan
from docgauge.operators.metrics import macro_of, ratio

SEED, ITERATIONS, LEAST_CASES, LEAST_ITERATIONS, MERSENNE_LIMIT = 20260807, 2000, 5, 200, 10_000_000
#: Cases of a pattern that are drawn for at once: bounds the table of chances. Tables reach REACH standard deviations and a few more to each side.
CHUNK, REACH, MORE = 1 << 16, 10, 20
#: Parts in which a pattern's replicates are dealt out over tasks.
PARTS = 16


def hashed(*parts: Column) -> Column:
    """An unsigned 32-bit number of the parts, the same in any engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def log_factorial(k: Column) -> Column:
    """ln(k!), by Stirling's series eight places further on."""
    x = k + 9.0
    series = 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x) - 1 / (1680 * x * x * x * x * x * x * x)
    below = F.lit(1.0)
    for i in range(1, 9):
        below = below * (k + float(i))
    return (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + series - F.log(below)


def poisson_table(n: Column) -> Column:
    """Struct (first, edges) for a count n up to CHUNK: the numbers below 2^32 at which a Poisson(n) number goes on from first + i to the next."""
    wide = REACH * F.sqrt(n) + MORE
    ks = F.sequence(F.greatest(F.lit(0), F.floor(n - wide)).cast("long"), F.ceil(n + wide).cast("long"))
    chances = F.transform(ks, lambda k: F.exp(k * F.log(n) - n - log_factorial(k)))
    edges = F.transform(scan(chances, lambda x, y: x + y, 0.0), lambda c: F.floor(c * float(1 << 32)).cast("long"))
    return F.struct(F.element_at(ks, 1).alias("first"), edges.alias("edges"))


def poisson_draws(vectors: DataFrame, columns: Sequence[str], iterations: int, seed: int, by: Sequence[str]) -> DataFrame:
    """For each pattern of the columns and replicate b: how often its cases are drawn, all together (w)."""
    patterns = vectors.groupBy(*by, *columns).agg(F.count(F.lit(1)).alias("__cases"))
    chunks = patterns.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("__cases") - 1) / CHUNK).cast("int"))))
    chunks = chunks.withColumns({"__n": F.least(F.col("__cases") - F.col("__chunk") * CHUNK, F.lit(CHUNK)).cast("double"), "__key": F.concat_ws("|", "__chunk", *columns), "__part": F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))})
    width = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tables = chunks.repartition(width, *by, "__key", "__part").withColumn("__table", poisson_table(F.col("__n")))
    # One digest serves four replicates.
    quads = -(-iterations // 4)
    each = tables.withColumn("__q", F.explode(F.sequence(F.col("__part"), F.greatest(F.col("__part"), F.lit(quads - 1)), F.lit(PARTS)))).where(F.col("__q") < quads)
    each = each.withColumn("__h", F.md5(F.concat_ws("|", F.lit(str(seed)), "__q", "__key")))
    part = lambda k: F.conv(F.substring("__h", 1 + 8 * k, 8), 16, 10).cast("long")
    each = each.select(*by, *columns, "__q", "__table", F.posexplode(F.array(*[part(k) for k in range(4)])).alias("__k", "__u"))
    most = int(2 * (REACH * math.sqrt(CHUNK) + MORE)) + 4
    w = F.col("__table.first") + count_up_to(F.col("__table.edges"), F.col("__u"), most)
    return each.select(*by, *columns, (4 * F.col("__q") + F.col("__k")).alias("b"), w.alias("w")).where((F.col("w") > 0) & (F.col("b") < iterations))


def replicate_sums(vectors: DataFrame, columns: Sequence[str], iterations: int = ITERATIONS, seed: int = SEED, method: str = "poisson", by: Sequence[str] = ("run",)) -> DataFrame:
    """For each group and replicate b, the weighted sums of the columns."""
    if method == "poisson":
        weighted = poisson_draws(vectors, columns, iterations, seed, by)
    else:
        place = F.row_number().over(Window.partitionBy(*by).orderBy("case_id")) - 1
        placed = vectors.withColumn("pos", place)
        sizes = vectors.groupBy(*by).agg(F.count(F.lit(1)).alias("size"))
        if method == "draws":
            draws = sizes.select(*by, "size", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("b")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("k"))
            draws = draws.select(*by, "b", (hashed(F.lit(seed), F.col("b"), F.col("k")) % F.col("size")).alias("pos"))
            drawn = draws.groupBy(*by, "b", "pos").agg(F.count(F.lit(1)).alias("w"))
        elif method == "mersenne":
            rows = []
            for group in sizes.collect():  # one row for each group
                n = group["size"]
                if n * iterations > MERSENNE_LIMIT:
                    raise ValueError(f"{n} cases * {iterations} replicates are more than {MERSENNE_LIMIT}; use poisson")
                generator = random.Random(seed)
                for b in range(iterations):
                    rows += [(*[group[c] for c in by], b, pos, w) for pos, w in Counter(generator.randrange(n) for _ in range(n)).items()]
            kinds = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in by)
            drawn = vectors.sparkSession.createDataFrame(rows, f"{kinds}, b int, pos int, w int")
        else:
            raise ValueError(f"unknown method {method!r}")
        weighted = drawn.join(placed, [*by, "pos"])
    return weighted.groupBy(*by, "b").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in columns])


def interval(samples: Column, alpha: float = 0.05) -> Column:
    """Struct (low, high) of an array of replicates: as many are left out at one end as at the other."""
    ordered, tail = F.sort_array(samples), F.floor(F.lit(alpha / 2) * F.size(samples)).cast("int")
    return F.struct(F.element_at(ordered, tail + 1).alias("low"), F.element_at(ordered, F.size(samples) - tail).alias("high"))


def statistics_of(names: Sequence[str], weights: Mapping[str, float] | None = None) -> dict[str, Column]:
    """Macro accuracy, all-correct share and each field's accuracy, over columns of sums."""
    total = {c: F.col(c) for i in range(len(names)) for c in (f"n_{i}", f"ok_{i}")}
    out = {"macro_accuracy": macro_of(total, names, weights), "all_fields_correct": ratio(F.col("all_ok"), F.col("one"))}
    return out | {f"accuracy:{name}": ratio(total[f"ok_{i}"], total[f"n_{i}"]) for i, name in enumerate(names)}


def _prepared(vectors: DataFrame) -> DataFrame:
    all_ok = ((F.col("n") > 0) & (F.col("correct") == F.col("n"))).cast("int")
    return vectors.withColumns({"all_ok": all_ok, "one": F.lit(1)})


def bootstrap_statistics(vectors: DataFrame, columns: Sequence[str], statistics: Mapping[str, Column], iterations: int = ITERATIONS, seed: int = SEED, method: str = "poisson", alpha: float = 0.05) -> DataFrame:
    """run, statistic, value (on all cases), low, high of any statistics that are expressions over sums of columns of the case vectors."""
    listed = F.array(*[F.struct(F.lit(k).alias("statistic"), v.cast("double").alias("value")) for k, v in statistics.items()])
    sums = vectors.groupBy("run").agg(F.count(F.lit(1)).alias("__cases"), *[F.sum(c).alias(c) for c in columns])
    point = sums.select("run", "__cases", F.inline(listed))
    spread = replicate_sums(vectors, columns, iterations, seed, method).select("run", F.inline(listed)).groupBy("run", "statistic").agg(F.collect_list("value").alias("samples"))
    enough = (F.col("__cases") >= LEAST_CASES) & F.lit(iterations >= LEAST_ITERATIONS)
    bounds = point.join(spread.select("run", "statistic", interval(F.col("samples"), alpha).alias("ci")), ["run", "statistic"], "left")
    return bounds.select("run", "statistic", "value", F.when(enough, F.col("ci.low")).alias("low"), F.when(enough, F.col("ci.high")).alias("high"))


def bootstrap_ci(vectors: DataFrame, names: Sequence[str], weights: Mapping[str, float] | None = None, iterations: int = ITERATIONS, seed: int = SEED, method: str = "poisson", alpha: float = 0.05) -> DataFrame:
    """run, statistic, value (on all cases), low, high."""
    columns = [c for i in range(len(names)) for c in (f"n_{i}", f"ok_{i}")] + ["all_ok", "one"]
    return bootstrap_statistics(_prepared(vectors), columns, statistics_of(names, weights), iterations, seed, method, alpha)
