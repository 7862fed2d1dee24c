"""Risk against coverage: what is right among the cases that a run is surest of.

Cases rank by confidence, surest first, ties by the SHA-1 of seed and id. Running sums are taken in two steps so that no
task holds a run: cases fall into buckets between approximate quantiles (a value that many cases share is a
bucket of its own, cut by the tie-breaker), buckets are summed, and a window runs inside each bucket only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgauge.functions.digests import keys_of
from docgauge.functions.parse import parse_number
from docgauge.operators.metrics import case_key, ratio
from docgauge.operators.resample import hashed

SEED, TARGETS, SHUFFLES, SPLITS, LEAST_COVERAGE, LEAST_CASES = 20260807, (0.5, 0.6, 0.7, 0.8, 0.9, 1.0), 25, 200, 0.05, 8
#: Buckets for each run, at least; there are as many as shuffle partitions.
BUCKETS = 64
#: Blocks of a run's ranks in a hold-out; cases of a shuffle that are put in order at once, about; cases that are hashed at once.
BLOCKS, ORDERED, HASHED = 512, 1 << 16, 1 << 18


def case_confidence(fields: DataFrame, confidence_field: str = "confidence") -> DataFrame:
    """For each case with fields: confidence, its source, and sums over all its fields.

    Confidence is the field of that name, as a share of 1 (or of 100 above 1), else the mean score of the other fields;
    it is rounded to 12 places so that ties are ties in any engine.
    """
    said = F.max(F.when(F.col("field") == confidence_field, parse_number(F.col("predicted"))))
    scaled = F.when(F.col("said") > 1, F.col("said") / 100).otherwise(F.col("said"))
    share = F.when(F.col("said").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))  # least() passes over nulls
    others = F.avg(F.when(F.col("field") != confidence_field, F.col("score")))
    key = case_key(fields)
    summed = fields.groupBy(*key).agg(
        said.alias("said"), F.coalesce(others, F.lit(0.0)).alias("mean_score"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "correct").alias("correct"), F.count_if(F.col("outcome") == "hallucinated").alias("hallucinated"))
    return summed.select(*key, F.round(F.coalesce(share, F.col("mean_score")), 12).alias("confidence"), F.col("said").isNotNull().alias("from_field"), "n", "correct", "hallucinated", (F.col("correct") == F.col("n")).cast("int").alias("ok"))


def confidence_source(confident: DataFrame) -> DataFrame:
    """'schema field' for a run in which any case has one."""
    return confident.groupBy("run").agg(F.when(F.bool_or("from_field"), F.lit("schema field")).otherwise(F.lit("mean field score")).alias("source"))


def tie(case_id: Column, seed: int = SEED) -> Column:
    return F.sha1(F.concat(F.lit(f"{seed}|"), case_id.cast("string")))


def running(df: DataFrame, by: Sequence[str], confidence: str, tie_col: str, sums: Sequence[str]) -> DataFrame:
    """df with rank (from 1) and cum_<c> for each of the sums, by falling confidence, then tie."""
    buckets = max(BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    points = F.array(*[F.lit(k / buckets) for k in range(1, buckets)])
    last = [c for c in ("case_pos",) if c in df.columns]  # of cases that repeat an id
    edges = df.groupBy(*by).agg(F.array_distinct(F.percentile_approx(confidence, points, F.lit(1000))).alias("__edges"))
    cut = df.join(edges, list(by))
    above = F.size(F.filter("__edges", lambda e: e > F.col(confidence)))
    at_edge = F.array_contains("__edges", F.col(confidence))
    cut = cut.withColumn("__bucket", F.struct((2 * above + at_edge.cast("int")).alias("k"), F.when(at_edge, F.substring(tie_col, 1, 2)).otherwise(F.lit("")).alias("t"))).drop("__edges")
    totals = cut.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__sum_rows"), *[F.sum(c).alias(f"__sum_{c}") for c in sums])
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # a few thousand rows at most
    offsets = totals.select(*by, F.col("__bucket"), *[F.coalesce(F.sum(f"__sum_{c}").over(before), F.lit(0)).alias(f"__before_{c}") for c in ("rows", *sums)])
    inside = Window.partitionBy(*by, "__bucket").orderBy(F.desc(confidence), tie_col, *last)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(offsets, [*by, "__bucket"]).withColumn("rank", F.row_number().over(inside) + F.col("__before_rows"))
    out = out.withColumns({f"cum_{c}": F.sum(c).over(upto) + F.col(f"__before_{c}") for c in sums})
    return out.drop("__bucket", *[f"__before_{c}" for c in ("rows", *sums)])


def risk_coverage(confident: DataFrame, seed: int = SEED) -> DataFrame:
    """A point for each case: rank, coverage, accuracy (all fields right) and risk so far, hallucinated share of the fields so far."""
    ranked = running(confident.withColumn("tie", tie(F.col("case_id"), seed)), ["run"], "confidence", "tie", ["ok", "hallucinated", "n"])
    size = confident.groupBy("run").agg(F.count(F.lit(1)).alias("n_cases"))
    accuracy = F.col("cum_ok") / F.col("rank")
    return ranked.join(size, "run").select("run", "case_id", F.col("rank").alias("n_accepted"), (F.col("rank") / F.col("n_cases")).alias("coverage"), accuracy.alias("accuracy"), (1 - accuracy).alias("risk"), ratio(F.col("cum_hallucinated"), F.col("cum_n")).alias("hallucination_rate"), "n_cases")


def aurc(curve: DataFrame) -> DataFrame:
    """Mean risk over all coverages."""
    return curve.groupBy("run").agg(F.avg("risk").alias("aurc"))


def _by_run(size: int):
    """A function from batches to (run, table) of about `size` rows; made here, so that Spark sends it by value."""

    def whole(held: list[pa.RecordBatch]) -> Iterator[tuple]:
        table = pa.Table.from_batches(held)
        runs = table.column("run").to_pylist() if table.num_rows else []
        for run in dict.fromkeys(runs):
            yield run, table.filter(pa.array([r == run for r in runs])).combine_chunks() if len(set(runs)) > 1 else table.combine_chunks()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= size:
                yield from whole(held)
                held, n = [], 0
        if n:
            yield from whole(held)

    return chunks


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """df over all tasks, however few rows it has: each becomes many hashes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def random_aurc(confident: DataFrame, shuffles: int = SHUFFLES, seed: int = SEED) -> DataFrame:
    """Mean area of orders that know nothing: each shuffle sorts by a hash of seed, shuffle and id.

    Hashes are made twice: first only counted by their leading bits, so that each bucket's first rank and the right cases before it are
    known; then sent to their buckets, eight bytes a case and shuffle (63 bits of the hash and whether the case is
    right), and put in order there. So no task holds a run.
    """
    kind = confident.schema["run"].dataType.simpleString()
    narrow = _dealt(confident.select("run", F.col("case_id").cast("string").alias("case_id"), F.col("ok").cast("int").alias("ok")), "case_id")
    sizes = {r["run"]: r["n"] for r in confident.groupBy("run").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each run
    bits = {run: max(1, (n // ORDERED).bit_length()) for run, n in sizes.items()}
    chunks, keys, one = _by_run(HASHED), keys_of(), lambda c: c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, table in chunks(batches):
            ids, ok, width = one(table.column("case_id")), table.column("ok").to_numpy(), 1 << bits[run]
            for trial in range(shuffles):
                bucket = (keys(f"{seed}|{trial}", ids)[0] >> np.uint64(64 - bits[run])).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"run": [run] * width, "trial": np.full(width, trial, np.int32), "bucket": np.arange(width), "n": np.bincount(bucket, minlength=width), "ok": np.bincount(bucket, ok, width).astype(np.int64)})

    counted = narrow.mapInArrow(count, f"run {kind}, trial int, bucket long, n long, ok long").groupBy("run", "trial", "bucket").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"))
    before, so_far = {}, {}
    for r in sorted(counted.collect(), key=lambda r: (str(r["run"]), r["trial"], r["bucket"])):  # a row for each ORDERED cases and shuffle, about
        n, right = so_far.get((r["run"], r["trial"]), (0, 0))
        before[r["run"], r["trial"], r["bucket"]] = n, right
        so_far[r["run"], r["trial"]] = n + r["n"], right + r["ok"]
    known = confident.sparkSession.sparkContext.broadcast(before)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, table in chunks(batches):
            ids, ok = one(table.column("case_id")), table.column("ok").to_numpy().astype(np.uint64)
            for trial in range(shuffles):
                key = np.sort(keys(f"{seed}|{trial}", ids)[0] & ~np.uint64(1) | ok)
                bucket = (key >> np.uint64(64 - bits[run])).astype(np.int64)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)).tolist()
                spans = list(zip(cuts, cuts[1:], strict=False))
                yield pa.RecordBatch.from_pydict({"run": [run] * len(spans), "trial": np.full(len(spans), trial, np.int32), "bucket": bucket[[x for x, _ in spans]], "keys": pa.array([key[x:z].tobytes() for x, z in spans], pa.binary())})

    def area(group: tuple, table: pa.Table) -> pa.Table:
        run, trial, bucket = (x.as_py() for x in group)
        key = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]))
        n, right = known.value[run, trial, bucket]
        risk = 1 - (right + np.cumsum((key & np.uint64(1)).astype(np.int64))) / (n + np.arange(1, len(key) + 1))
        return pa.table({"run": pa.array([run], table.schema.field("run").type), "trial": pa.array([trial], pa.int32()), "risk": [float(risk.sum())], "n": pa.array([len(key)], pa.int64())})

    dealt = narrow.mapInArrow(deal, f"run {kind}, trial int, bucket long, keys binary")
    areas = dealt.groupBy("run", "trial", "bucket").applyInArrow(area, f"run {kind}, trial int, risk double, n long")
    return areas.groupBy("run", "trial").agg((F.sum("risk") / F.sum("n")).alias("a")).groupBy("run").agg(F.avg("a").alias("random_aurc"))


def ranking_gain(own: Column, chance: Column) -> Column:
    return F.when(chance > 0, F.greatest(F.lit(0.0), (chance - own) / chance)).otherwise(F.lit(0.0))


def operating_points(curve: DataFrame, targets: Sequence[float] = TARGETS) -> DataFrame:
    """The curve at given coverages: the point number is the target share of the cases, half to even, at least the first."""
    wanted = F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias("target")
    sizes = curve.groupBy("run").agg(F.max("n_cases").alias("n_cases")).select("run", wanted, "n_cases")
    at = F.greatest(F.lit(1), F.least(F.col("n_cases"), F.bround(F.col("target") * F.col("n_cases")).cast("long")))
    return sizes.select("run", "target", at.alias("n_accepted")).join(curve.drop("case_id", "n_cases"), ["run", "n_accepted"])


def accuracy_at(curve: DataFrame, coverage: float) -> DataFrame:
    """Accuracy at the last point within the coverage; null if there is none."""
    return curve.groupBy("run").agg(F.max_by(F.when(F.col("coverage") <= coverage + 1e-9, F.col("accuracy")), F.when(F.col("coverage") <= coverage + 1e-9, F.col("n_accepted"))).alias("accuracy"))


def coverage_for(curve: DataFrame, accuracy: float) -> DataFrame:
    """The widest coverage with that accuracy; 0 if there is none."""
    return curve.groupBy("run").agg(F.coalesce(F.max(F.when(F.col("accuracy") >= accuracy, F.col("coverage"))), F.lit(0.0)).alias("coverage"))


def _cuts(narrow: DataFrame, sizes: dict, splits: int, seed: int) -> dict[tuple, tuple[int, int]]:
    """For each run and split the key, as two numbers, of the last case of the first half by key.

    Keys are hashes, so the middle one lies near the middle of all numbers: keys below a window there are counted and those in it
    are put in order. A window that misses the middle is widened, in the end to all numbers.
    """
    kind = narrow.schema["run"].dataType.simpleString()
    chunks, keys, one = _by_run(HASHED), keys_of(), lambda c: c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks)
    cuts, reach = {}, 8.0
    while len(cuts) < len(sizes) * splits:
        missing = [(run, split) for run in sizes for split in range(splits) if (run, split) not in cuts]
        window = {}
        for run, n in sizes.items():
            middle, wide = (n // 2) / n, (reach * n**0.5 / 2 + 16) / n
            window[run] = max(0, int((middle - wide) * 2**64)), min(2**64 - 1, int((middle + wide) * 2**64))

        def scan(batches: Iterator[pa.RecordBatch], missing: list = missing, window: dict = window) -> Iterator[pa.RecordBatch]:
            for run, table in chunks(batches):
                ids, (low, high) = one(table.column("case_id")), (np.uint64(x) for x in window[run])
                wanted = [split for r, split in missing if r == run]
                below, inside = [], []
                for split in wanted:
                    a, b = keys(f"{seed}|{split}", ids)
                    at = np.flatnonzero((a >= low) & (a <= high))
                    below.append(int((a < low).sum()))
                    inside.append(np.stack([a[at], b[at]], axis=1).tobytes())
                yield pa.RecordBatch.from_pydict({"run": [run] * len(wanted), "split": pa.array(wanted, pa.int32()), "below": pa.array(below, pa.int64()), "inside": pa.array(inside, pa.binary())})

        def cut(group: tuple, table: pa.Table) -> pa.Table:
            run, split = (x.as_py() for x in group)
            inside = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("inside").to_pylist()]).reshape(-1, 2)
            inside = inside[np.lexsort((inside[:, 1], inside[:, 0]))]
            at = sizes[run] // 2 - sum(table.column("below").to_pylist()) - 1
            found = 0 <= at < len(inside)
            whole = [int(x) - 2**63 for x in inside[at]] if found else [None, None]  # signed, for Spark
            return pa.table({"run": pa.array([run], table.schema.field("run").type), "split": pa.array([split], pa.int32()), "high": pa.array(whole[:1], pa.int64()), "low": pa.array(whole[1:], pa.int64())})

        sent = narrow.select("run", "case_id").mapInArrow(scan, f"run {kind}, split int, below long, inside binary")
        for r in sent.groupBy("run", "split").applyInArrow(cut, f"run {kind}, split int, high long, low long").where("high is not null").collect():  # a row for each run and split
            cuts[r["run"], r["split"]] = r["high"] + 2**63, r["low"] + 2**63
        reach *= 64
    return cuts


def _tested(confident: DataFrame, sizes: dict, target: float, splits: int, seed: int) -> list[tuple]:
    """Rows (run, split, wide, accuracy): the coverage that one half allows and what it gives on the other, null without a policy.

    All splits share one order of the cases, which is cut into BLOCKS blocks. A block's halves are bits, kept; what lies before a
    block is known from the blocks' sums, BLOCKS rows for each run, so that no task holds a run.
    """
    kind = confident.schema["run"].dataType.simpleString()
    ordered = running(confident.withColumn("tie", tie(F.col("case_id"), seed)), ["run"], "confidence", "tie", [])
    counted = confident.sparkSession.createDataFrame(list(sizes.items()), f"run {kind}, n_cases long")
    place = F.col("rank") - 1
    cases = ordered.join(F.broadcast(counted), "run").select("run", F.col("case_id").cast("string").alias("case_id"), F.col("ok").cast("int").alias("ok"), F.col("rank").alias("place"), F.floor(place * BLOCKS / F.col("n_cases")).cast("int").alias("block"))
    cuts = _cuts(_dealt(confident.join(F.broadcast(counted), "run").select("run", F.col("case_id").cast("string").alias("case_id")), "case_id"), sizes, splits, seed)
    keys, one = keys_of(), lambda c: c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks)

    def halve(group: tuple, table: pa.Table) -> pa.Table:
        run, block = (x.as_py() for x in group)
        table = table.sort_by("place").combine_chunks()
        ids, ok = one(table.column("case_id")), table.column("ok").to_numpy().astype(bool)
        halves = np.empty((splits, len(ok)), bool)
        for split in range(splits):
            a, b = keys(f"{seed}|{split}", ids)
            high, low = (np.uint64(x) for x in cuts[run, split])
            halves[split] = (a < high) | ((a == high) & (b <= low))
        fit, right = halves.sum(axis=1), (halves & ok).sum(axis=1)
        sums = np.stack([fit, right, len(ok) - fit, ok.sum() - right]).astype(np.int64)
        return pa.table({"run": pa.array([run], table.schema.field("run").type), "block": pa.array([block], pa.int32()), "ok": [np.packbits(ok).tobytes()], "halves": [np.packbits(halves, axis=1).tobytes()], "n": pa.array([len(ok)], pa.int64()), "sums": [sums.tobytes()]})

    blocks = _dealt(cases, "run", "block").groupBy("run", "block").applyInArrow(halve, f"run {kind}, block int, ok binary, halves binary, n long, sums binary").persist()
    before, whole = {}, {}
    for r in sorted(blocks.select("run", "block", "sums").collect(), key=lambda r: (str(r["run"]), r["block"])):
        before[r["run"], r["block"]] = whole.get(r["run"], np.zeros((4, splits), np.int64))
        whole[r["run"]] = before[r["run"], r["block"]] + np.frombuffer(r["sums"], np.int64).reshape(4, splits)
    known = confident.sparkSession.sparkContext.broadcast(before)

    def each(batch: pa.RecordBatch) -> Iterator[tuple]:
        for run, block, ok, halves, n in zip(*(batch.column(c).to_pylist() for c in ("run", "block", "ok", "halves", "n")), strict=True):
            right = np.unpackbits(np.frombuffer(ok, np.uint8), count=n).astype(np.int64)
            yield run, right, np.frombuffer(halves, np.uint8).reshape(splits, -1), n, known.value[run, block]

    def widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, ok, halves, n, sums in each(batch):
                best = []
                for split in range(splits):
                    mine = ok[np.unpackbits(halves[split], count=n).view(bool)]
                    rank = sums[0, split] + np.arange(1, len(mine) + 1)
                    good = np.flatnonzero((sums[1, split] + np.cumsum(mine)) / rank >= target)
                    best.append(int(rank[good[-1]]) if len(good) else 0)
                yield pa.RecordBatch.from_pydict({"run": [run] * splits, "split": np.arange(splits, dtype=np.int32), "rank": pa.array(best, pa.int64())})

    best = blocks.mapInArrow(widest, f"run {kind}, split int, rank long").groupBy("run", "split").agg(F.max("rank").alias("rank")).collect()
    wide = {(r["run"], r["split"]): r["rank"] / int(whole[r["run"]][0, r["split"]]) for r in best}
    wide = {k: w if w >= LEAST_COVERAGE else 0.0 for k, w in wide.items()}
    # Python rounds halves to even.
    take = {(run, split): max(1, round(w * int(whole[run][2, split]))) for (run, split), w in wide.items()}

    def right_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, ok, halves, n, sums in each(batch):
                got = []
                for split in range(splits):
                    need = take[run, split] - int(sums[2, split])
                    if need > 0:
                        mine = ok[~np.unpackbits(halves[split], count=n).view(bool)]
                        if need <= len(mine):
                            got.append((split, int(sums[3, split]) + int(mine[:need].sum())))
                yield pa.RecordBatch.from_pydict({"run": pa.array([run] * len(got), batch.schema.field("run").type), "split": pa.array([s for s, _ in got], pa.int32()), "cum": pa.array([c for _, c in got], pa.int64())})

    found = blocks.mapInArrow(right_at, f"run {kind}, split int, cum long").collect()
    blocks.unpersist()
    return [(r["run"], r["split"], float(wide[r["run"], r["split"]]), r["cum"] / take[r["run"], r["split"]] if wide[r["run"], r["split"]] > 0 else None) for r in found]


def holdout(confident: DataFrame, target: float = 0.95, splits: int = SPLITS, seed: int = SEED) -> DataFrame:
    """A policy fitted on half of the cases and tried on the other half, many times over.

    In each split the policy is the widest coverage of one half that reaches the target; below LEAST_COVERAGE there is
    none, and the split counts as coverage 0. Accuracy, its bounds and the hit rate are over splits that have a policy.
    The splits are worked out at once; only their `splits` rows for each run come back to the driver.
    """
    kind = confident.schema["run"].dataType.simpleString()
    sizes = confident.groupBy("run").agg(F.count(F.lit(1)).alias("n_cases"), F.avg("ok").alias("base"))
    large = {r["run"]: r["n_cases"] for r in sizes.where(F.col("n_cases") >= LEAST_CASES).collect()}
    rows = _tested(confident, large, target, splits, seed) if large else []
    tested = confident.sparkSession.createDataFrame(rows, f"run {kind}, split int, wide double, accuracy double")
    low = lambda k: F.least(k - 1, F.floor(F.lit(0.025) * k).cast("int"))
    high = lambda k: F.least(k - 1, F.floor(F.lit(0.975) * k).cast("int"))
    summed = tested.groupBy("run").agg(F.avg("wide").alias("coverage"), F.avg("accuracy").alias("accuracy"), F.sort_array(F.collect_list("accuracy")).alias("all"), F.avg((F.col("accuracy") >= target).cast("int")).alias("hit_rate"))
    k = F.size("all")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = sizes.join(summed, "run", "left")
    bound = lambda at: F.when(k > 0, F.get("all", at(k)))
    return out.select("run", F.lit(float(target)).alias("target"), zero(F.col("coverage")).alias("coverage"), zero(F.col("accuracy")).alias("accuracy"), zero(bound(low)).alias("low"), zero(bound(high)).alias("high"), zero(F.col("hit_rate")).alias("hit_rate"), F.when(F.col("accuracy").isNotNull(), F.col("accuracy") - F.col("base")).otherwise(F.lit(0.0)).alias("lift"))


def selective_report(fields: DataFrame, confidence_field: str = "confidence", seed: int = SEED) -> DataFrame:
    """For each run: cases, source of confidence, area, area of random orders and gain."""
    confident = case_confidence(fields, confidence_field).persist()  # a narrow row for each case, read five times
    curve = risk_coverage(confident, seed)
    sizes = confident.groupBy("run").agg(F.count(F.lit(1)).alias("n_cases"))
    joined = sizes.join(confidence_source(confident), "run").join(aurc(curve), "run").join(random_aurc(confident, seed=seed), "run")
    return joined.withColumn("ranking_gain", ranking_gain(F.col("aurc"), F.col("random_aurc")))


__all__ = ["accuracy_at", "aurc", "case_confidence", "confidence_source", "coverage_for", "hashed", "holdout", "operating_points", "random_aurc", "ranking_gain", "risk_coverage", "running", "selective_report", "tie"]
