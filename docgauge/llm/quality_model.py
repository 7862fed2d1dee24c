"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

The statistics come from the text alone (never from its id, language, source or label). The trees are fitted on the driver,
with numpy, on at most TRAIN_ROWS labelled documents, taken by the hash of their ids; only their statistics
(TRAIN_ROWS x about 40 numbers) reach it. The trees are then flattened into arrays (feature, cut, first child, value) and
all rows of a batch walk all trees at once, one gather for each level.

Edge cases: null and empty texts have statistics of zero and get a score like any other; without labels, or with labels
of one kind, the score is that kind's share (0.5 without any); of several labels of one id the lowest counts; a label
that is null is left out; rows that repeat are scored alike; other columns are left alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgauge.llm.common import documents, held, in_arrow, ship

#: Labelled documents that the trees are fitted on, at most.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST_HESSIAN, RIDGE = 80, 4, 48, 0.12, 4.0, 1.0
#: Scores from here on are predicted 1.
CUT = 0.3

_GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",", b"!?", b";:", b"#*$%&|<>", b"'\"`", b"()[]{}", b"@", b"/\\", b"_-=+~^", bytes(range(128, 256)), bytes([*range(9), *range(14, 32), 127])]
_GROUP_OF = np.full(256, len(_GROUPS))
for _k, _chars in enumerate(_GROUPS):
    _GROUP_OF[list(_chars)] = _k
WIDTH = len(_GROUPS) + 18


def statistics(text: str | None) -> list[float]:
    """Figures of a whole text: shares of kinds of characters, words, lines and repetition."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * WIDTH
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_GROUP_OF, weights=counts, minlength=len(_GROUPS) + 1)[: len(_GROUPS)]
    share = counts[counts > 0] / n
    words = raw.split()
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = set(zip(words, words[1:], strict=False))
    threes = set(zip(words, words[1:], words[2:], strict=False))
    ends = sum(x.rstrip()[-1:] in b".!?:" for x in lines)
    upper = sum(map(bytes.isupper, words))
    title = sum(map(bytes.istitle, words))
    letters = kinds[0] + kinds[1] + kinds[15]
    l = max(1, len(lines))  # noqa: E741
    return [
        *(kinds / n),
        np.log1p(n), np.log1p(len(words)), float(lengths.mean()), float(lengths.std()), float(lengths.max()),
        len(set(words)) / w, len(pairs) / max(1, w - 1), len(threes) / max(1, w - 2),
        len(lines) / w, len(set(lines)) / l, ends / l, n / l,
        upper / w, title / w, letters / n, w / (1 + kinds[5] + kinds[7]),
        float(-(share * np.log2(share)).sum()), len(zlib.compress(raw, 1)) / n,
    ]


class Trees:
    """Boosted trees as arrays: for node k the feature, the cut (rows at most that go to child[k], others to child[k] + 1) and the value."""

    def __init__(self, base: float, roots, feature, cut, child, value):
        self.base, self.roots, self.feature, self.cut, self.child, self.value = base, roots, feature, cut, child, value

    def score(self, x: np.ndarray) -> np.ndarray:
        node = np.tile(self.roots, (len(x), 1))
        row = np.arange(len(x))[:, None]
        for _ in range(DEPTH):  # a leaf is its own child
            inner = self.child[node] >= 0
            right = x[row, self.feature[node]] > self.cut[node]
            node = np.where(inner, self.child[node] + right, node)
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of the log loss; cuts between histogram bins at quantiles."""
    n, width = x.shape if len(x) else (0, WIDTH)
    share = (y.sum() + 0.5) / (n + 1) if n else 0.5
    base = float(np.log(share / (1 - share)))
    feature, cut, child, value, roots = [], [], [], [], []
    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        flat = binned + np.arange(width) * BINS
        margin = np.full(n, base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            at, first = np.zeros(n, np.int64), len(feature)
            roots.append(first)
            level = [first]
            for out in (feature, cut, child, value):
                out.append(0)
            child[first] = -1
            value[first] = -RATE * g.sum() / (h.sum() + RIDGE)
            for _ in range(DEPTH):
                m = len(level)
                live = at >= 0
                key = (at[live, None] * width * BINS + flat[live]).ravel()
                sums = [np.bincount(key, np.repeat(v[live], width), m * width * BINS).reshape(m, width, BINS) for v in (g, h)]
                left = [s.cumsum(axis=2)[:, :, :-1] for s in sums]
                total = [s[:, :1, :].sum(axis=2, keepdims=True) for s in sums]
                right = [t - s for t, s in zip(total, left, strict=True)]
                gain = left[0] ** 2 / (left[1] + RIDGE) + right[0] ** 2 / (right[1] + RIDGE) - total[0] ** 2 / (total[1] + RIDGE)
                gain[(left[1] < LEAST_HESSIAN) | (right[1] < LEAST_HESSIAN)] = 0
                best = gain.reshape(m, -1).argmax(axis=1)
                move, fresh = np.full((m, 2), -1), []
                split = np.zeros((m, 2), np.int64)
                for k in range(m):
                    j, b = divmod(int(best[k]), BINS - 1)
                    if gain[k, j, b] <= 1e-6 or b >= len(cuts[j]):
                        continue
                    node, new = level[k], len(feature)
                    feature[node], cut[node], child[node] = j, float(cuts[j][b]), new
                    for s in (left, right):
                        for out in (feature, cut):
                            out.append(0)
                        child.append(-1)
                        value.append(-RATE * s[0][k, j, b] / (s[1][k, j, b] + RIDGE))
                    split[k], move[k] = (j, b), (len(fresh), len(fresh) + 1)
                    fresh += [new, new + 1]
                ids = np.flatnonzero(live)
                node_of = at[ids]
                side = (binned[ids, split[node_of, 0]] > split[node_of, 1]).astype(np.int64)
                # Rows whose node is a leaf leave the level with its value.
                stays = move[node_of, 0] < 0
                margin[ids[stays]] += np.array([value[v] for v in level])[node_of[stays]]
                at[ids] = move[node_of, side]
                level = fresh
                if not level:
                    break
            if level:
                live = at >= 0
                margin[live] += np.array([value[v] for v in level])[at[live]]
    return Trees(base, np.array(roots, np.int64), np.array(feature, np.int64), np.array(cut, float), np.array(child, np.int64), np.array(value, float))


def with_statistics(df: DataFrame, text_col: str = "text", into: str = "stats") -> DataFrame:
    """df without its text, and its statistics as an array of doubles."""
    ship(df.sparkSession)
    at = df.columns.index(text_col)
    rest = [f for f in df.schema.fields if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([statistics(t) for t in batch.column(at).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != at], new], names=[*[f.name for f in rest], into])

    return in_arrow(df, run, T.StructType([*rest, T.StructField(into, T.ArrayType(T.DoubleType()))]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Trees:
    """Fits on at most `rows` labelled documents whose crc32 of the id is not divisible by 5."""
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (held(id_col) != 0))
    one = one.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__label"))
    some = one.orderBy(F.xxhash64("__id"), "__id").limit(rows)  # bounded: 16 bytes a row
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    joined = slim.join(F.broadcast(some), slim.doc_id == some["__id"]).select("__id", "__label", "text")
    got = with_statistics(joined).select("__id", "__label", "stats").orderBy("__id").limit(2 * rows).toArrow()
    x = np.array(got.column("stats").to_pylist(), float).reshape(-1, WIDTH)
    return fit(x, np.array(got.column("__label").to_pylist(), float))


def score(docs: DataFrame, trees: Trees, text_col: str = "text", into: str = "score") -> DataFrame:
    """docs and a score from 0 to 1, higher where label 1 is likelier."""
    if into in docs.columns:
        raise ValueError(f"there is a column {into} already")
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                x = np.array([statistics(t) for t in part.column(at).to_pylist()], float).reshape(-1, WIDTH)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(trees.score(x), pa.float64())], names=[*part.schema.names, into])

    return in_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())]))


def select_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of docs that score at least `cut`; same columns."""
    return score(docs, train(docs, labels), into="__score").where(F.col("__score") >= cut).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    trees = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, trees).drop("text")
    return scored.select("doc_id", (held("doc_id") == 0).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
