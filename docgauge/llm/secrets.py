"""Secret scans: fixed patterns, and character Markov models for strings that no pattern knows; DataFrame functions only.

Two first-order Markov models over characters, one of random strings and one of ordinary identifiers, are trained
from labelled samples. The random sample is made by rule (digests in hex, base 64 and base 62); the ordinary one is
made of the words of ORDINARY_DOCS documents, taken by hash, and of identifiers built from them (joined by _ or -, in
camel case, with a short number). A candidate is a run of CANDIDATE characters that holds a digit, glued to = or not; it
is a secret if the log-likelihood ratio of the two models reaches a threshold for each step, and in all. The threshold comes
from labelled strings that the models were not fitted on, midway between the two kinds.

Spans are code points, end exclusive. Edge cases: a null text counts as empty and has no spans; a span of the
models is added only where no base span overlaps it; an empty table gives an empty result; other columns are left
alone.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge.llm.common import LOWER, UPPER, documents, wrapped

# The patterns of the base spans, in the order in which their kinds are listed, and the least lengths.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # shorter runs can't be part of a longer match
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "markov")
SPAN = "struct<start:int,rank:int,end:int,value:string>"

#: Characters of a candidate, and how many there must be; = belongs to it as padding at the end only.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{10,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
ALPHABET = UPPER + LOWER + "0123456789" + "+/_-="
#: Documents whose words the ordinary model is trained on, and strings of each kind that the random model is trained on.
ORDINARY_DOCS, RANDOM_STRINGS = 2000, 4000
#: Shares of held-out ordinary strings beyond the margin, and of random strings; steps of the grid of ratios for one natural unit, and the grid's ends.
FALSE_ALARMS, MISSES, GRID, GRID_TOP = 0.0005, 0.01, 100, 10
#: The threshold where the sample is too small to find one; and the steps whose evidence any string needs in all, so that shorter strings need clearer steps.
THRESHOLD, EVIDENCE_STEPS = 0.35, 19
#: Kinds below this rank are base spans.
BASE = 3
#: Characters in a piece of a text that is put together anew.
PIECE = 4096


def _scan(values: Column, merge, none) -> Column:
    """values merged from the left up to each place, in log2(size) passes that double the reach: no array grows step by step."""
    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int"))
    before = lambda acc, i, k: F.coalesce(F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(none))
    return F.aggregate(passes, values, lambda acc, k: F.transform(acc, lambda x, i: merge(x, before(acc, i, k))))


def _parts(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """Lengths of what lies between the matches of a pattern, lengths of the matches, and what is to be kept of them; null without a match."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    return F.when(text.rlike(pattern), F.struct(gaps.alias("gaps"), F.transform(whole, F.length).alias("lengths"), value.alias("values")))


def _spans(parts: Column, kind: str) -> Column:
    """Spans (start, rank, end, value) of the matches, leftmost first and without overlap; those below the kind's least length are left out."""
    ends = _scan(F.zip_with(F.slice(parts["gaps"], 1, F.size(parts["lengths"])), parts["lengths"], lambda g, n: g + n), lambda x, y: x + y, 0)
    start = lambda end, i: end - F.get(parts["lengths"], i)
    rank = F.lit(KINDS.index(kind))
    each = F.transform(ends, lambda end, i: F.struct(start(end, i).alias("start"), rank.alias("rank"), end.alias("end"), F.get(parts["values"], i).alias("value")))
    return F.coalesce(F.filter(each, lambda x: F.length(x["value"]) >= LEAST.get(kind, 0)), F.array().cast(f"array<{SPAN}>"))



def _held() -> Column:
    """Whether a string is in the eighth of its sample that the threshold is found on."""
    return F.pmod(F.xxhash64("s"), F.lit(8)) == 0


def _steps(strings: DataFrame, label: str) -> DataFrame:
    """How often one character follows another."""
    chars = strings.select(F.split("s", "").alias("c"), _held().alias("held"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.concat(F.get("c", i), F.get("c", i + 1)))
    return chars.where(F.size("c") > 1).select("held", F.explode(pairs).alias("pair")).groupBy("held", "pair").count().withColumn("label", F.lit(label))


def random_sample(spark, n: int = RANDOM_STRINGS) -> DataFrame:
    """Strings labelled random, by rule from digests."""
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    b64 = lambda salt: F.base64(F.unhex(digest(salt)))
    return spark.range(n).select(
        F.explode(F.array(digest("hex"), F.upper(F.md5(F.concat(F.lit("md5"), F.col("id").cast("string")))), b64("b64"), F.regexp_replace(b64("b62"), "[+/=]", ""), F.translate(b64("url"), "+/=", "-_"), F.regexp_replace(F.upper(b64("b32")), "[+/=]", ""))).alias("s")
    )


def ordinary_sample(docs: DataFrame, id_col: str, text_col: str, n: int = ORDINARY_DOCS) -> DataFrame:
    """Strings labelled ordinary: words of n documents, taken by the hash of their ids, and identifiers made of them."""
    # Only ids go through the top n, 16 bytes each; the texts are then read where they are.
    ids = docs.select(F.col(id_col).alias("__id")).distinct().orderBy(F.xxhash64("__id"), "__id").limit(n)
    some = docs.select(F.col(id_col).alias("__own"), F.col(text_col).alias("t")).join(F.broadcast(ids), F.col("__own") == F.col("__id"), "left_semi")
    words = F.filter(F.regexp_extract_all("t", F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]+(?![A-Za-z0-9+/_=-])"), F.lit(0)), lambda w: F.length(w) > 1)
    w = some.select(words.alias("w")).where(F.size("w") > 3)
    at = lambda i, k: F.get("w", i + k)
    # From each run of three words: as they are, in snake case, with dashes, in camel case, with a short number, in capitals.
    made = F.flatten(F.transform(F.sequence(F.lit(0), F.size("w") - 3, F.lit(3)), lambda i: F.array(
        at(i, 0), at(i, 1), at(i, 2), F.concat_ws("_", at(i, 0), at(i, 1), at(i, 2)), F.concat_ws("-", at(i, 1), at(i, 2)), F.concat(at(i, 0), F.initcap(at(i, 1)), F.initcap(at(i, 2))),
        F.concat(at(i, 0), (i % 100).cast("string")), F.concat_ws("_", F.upper(at(i, 0)), F.upper(at(i, 1))), F.concat_ws("/", at(i, 1), at(i, 2), at(i, 0)))))
    return w.select(F.explode(made).alias("s"))


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratio of each step, random against ordinary, for the pairs of ALPHABET in order; least mean ratio of a secret."""

    table: list[float]
    threshold: float


def _table(got: dict) -> list[float]:
    logs = {}
    for label in ("random", "ordinary"):
        for a in ALPHABET:
            row = [got.get((label, a + b), 0) + 0.5 for b in ALPHABET]
            logs[label, a] = [math.log(x / sum(row)) for x in row]
    return [logs["random", a][j] - logs["ordinary", a][j] for a in ALPHABET for j in range(len(ALPHABET))]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Both models from the labelled samples, and the threshold from what models of seven eighths of them say about the rest.

    The threshold is a mean ratio a step: midway between what all but FALSE_ALARMS of the different ordinary strings of candidate
    length stay below and what all but MISSES of the random strings reach. Fewer strings than could show such shares leave it at
    THRESHOLD. What comes to the driver is bounded: 4489 counts of pairs for each label and part, and 2 * GRID * GRID_TOP counts of ratios.
    """
    samples = {"random": random_sample(docs.sparkSession), "ordinary": ordinary_sample(docs, id_col, text_col)}
    counts = _steps(samples["random"], "random").unionByName(_steps(samples["ordinary"], "ordinary"))
    inside = F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$")
    fitted, both = {}, {}
    for r in counts.where(inside).collect():
        key = r["label"], r["pair"]
        both[key] = both.get(key, 0) + r["count"]
        if not r["held"]:
            fitted[key] = r["count"]
    return Model(_table(both), _threshold(*(df.where(_held()) for df in samples.values()), _table(fitted)))


def _threshold(random_: DataFrame, ordinary: DataFrame, table: list[float]) -> float:
    ratios = F.from_json(F.lit(json.dumps([round(x, 6) for x in table])), "array<double>")
    both = random_.withColumn("random", F.lit(True)).unionByName(ordinary.withColumn("random", F.lit(False))).where(F.col("s").rlike(r"^[A-Za-z0-9+/_=-]{10,}$")).distinct()
    place = F.round(GRID * F.greatest(F.lit(-GRID_TOP), F.least(F.lit(GRID_TOP), _ratio(F.col("s"), ratios) / (F.length("s") - 1)))).cast("int")
    seen = both.groupBy("random", place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()
    sides = []
    for label, spared, order in ((False, FALSE_ALARMS, -1), (True, MISSES, 1)):
        own = sorted(((r["place"], r["n"]) for r in seen if r["random"] == label), key=lambda x: order * x[0])
        left = spared * sum(n for _, n in own)
        if left < 1:
            return THRESHOLD
        for at, n in own:
            left -= n
            if left < 0:
                sides.append(at)
                break
    return max(1, round(sum(sides) / 2)) / GRID


def _ratio(value: Column, table: Column) -> Column:
    """Log-likelihood ratio of all steps of a string, in time linear in its length.

    The characters' places are bound to a variable of a lambda: as an expression they would be worked out again for each step.
    """
    n = len(ALPHABET)
    place = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    total = lambda p: F.aggregate(F.sequence(F.lit(0), F.size(p) - 2), F.lit(0.0), lambda acc, i: acc + F.get(table, F.get(p, i) * n + F.get(p, i + 1)))
    return F.get(F.transform(F.array(place), total), F.lit(0))


def _free(spans: Column) -> Column:
    """Of sorted spans, those of the base and those of the models that no base span overlaps.

    An earlier base span starts no later, so it overlaps if it ends after the start; a later one if it starts before the end.
    """
    first, after = 0, 2**31 - 1
    base = lambda c, none: F.transform("spans", lambda x: F.when(x["rank"] < BASE, x[c]).otherwise(none))
    ended = _scan(base("end", first), F.greatest, first)
    begins = F.reverse(_scan(F.reverse(base("start", after)), F.least, after))
    overlapped = lambda x, i: (F.coalesce(F.get("ended", i - 1), F.lit(first)) > x["start"]) | (F.coalesce(F.get("begins", i + 1), F.lit(after)) < x["end"])
    return ended, begins, lambda x, i: (x["rank"] < BASE) | ~overlapped(x, i)


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """row (a struct of docs' columns) and spans: an array of (start, rank, end, value), by start, then kind as in KINDS.

    Each step is a projection of its own, so that no pattern is matched twice; passes over spans are doubling scans, so time is
    near linear in their number.
    """
    model = model or train(docs, id_col, text_col)
    ratios = F.from_json(F.lit(json.dumps([round(x, 6) for x in model.table])), "array<double>")
    text = F.coalesce(F.col("text"), F.lit(""))
    found = {"assign": _parts(text, ASSIGN, "assign", 2), "access": _parts(text, ACCESS, "access"), "hex": _parts(text, HEX, "hex"), "markov": _parts(text, CANDIDATE, "markov")}
    staged = wrapped(docs, text=F.col(text_col)).select("row", *[c.alias(k) for k, c in found.items()])
    surely = lambda x: _ratio(x["value"], ratios) >= F.greatest(F.lit(model.threshold * EVIDENCE_STEPS), model.threshold * (F.length(x["value"]) - 1))
    staged = staged.select("row", F.concat(*[_spans(F.col(k), k) for k in KINDS[:BASE]]).alias("base"), F.filter(_spans(F.col("markov"), "markov"), surely).alias("more"))
    staged = staged.select("row", F.size("base").alias("n_base"), F.size("more").alias("n_more"), F.array_sort(F.concat("base", "more")).alias("spans"))
    ended, begins, keep = _free(F.col("spans"))
    mixed = (F.col("n_base") > 0) & (F.col("n_more") > 0)
    staged = staged.select("row", "spans", F.when(mixed, ended).alias("ended"), F.when(mixed, begins).alias("begins"))
    return staged.select("row", F.when(F.col("ended").isNull(), F.col("spans")).otherwise(F.filter("spans", keep)).alias("spans"))


def _joined(spans: Column) -> Column:
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["rank"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"], x["end"])), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """Counts and spans of each document; see op6's contract."""
    found = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", model)
    count = lambda k: F.size(F.filter("spans", lambda x: x["rank"] == KINDS.index(k))).cast("long")
    base = F.filter("spans", lambda x: x["rank"] < BASE)
    return found.select(F.col("row.doc_id").alias(id_col), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]", model: Model | None = None) -> DataFrame:
    """docs with every span put out of its text (overlapping spans as one); same columns. Of an assignment the whole match goes.

    What is kept between two spans is read from pieces of PIECE characters, since a substring is sought from the start of a string.
    """
    found = with_spans(docs, id_col, text_col, model)
    text = F.col(f"row.`{text_col}`")
    some = F.size("spans") > 0
    cut = found.select("row", "spans", F.when(some, _scan(F.transform("spans", lambda x: x["end"]), F.greatest, 0)).alias("ended"), F.when(some, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("pieces"), F.length(text).alias("length"))

    def between(a: Column, b: Column) -> Column:
        part = lambda j: F.substring(F.get("pieces", j), F.greatest(a - j * PIECE, F.lit(0)) + 1, F.least(b - j * PIECE, F.lit(PIECE)) - F.greatest(a - j * PIECE, F.lit(0)))
        at = lambda n: F.floor(n / F.lit(PIECE)).cast("int")
        return F.when(a < b, F.array_join(F.transform(F.sequence(at(a), at(b - 1)), part), "")).otherwise("")

    before = lambda i: F.coalesce(F.get("ended", i - 1), F.lit(0))
    kept = F.transform("spans", lambda x, i: F.when(x["start"] >= before(i), F.concat(between(before(i), x["start"]), F.lit(mask))).otherwise(""))
    clean = F.concat(F.array_join(kept, ""), between(F.element_at("ended", -1), F.col("length")))
    new = cut.select("row", F.when(some, clean).otherwise(text).alias("clean"))
    return new.select(*[(F.col("clean") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))
