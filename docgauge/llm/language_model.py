"""Scores texts with a hashed maximum-entropy language model, beside a unigram base score.

Counts. The words of all training documents are counted in buckets. The HEAD most frequent words (a bounded number) go
to every task; the others meet their counts in their bucket, so no table grows with the corpus on one machine.

Model. The probability of a word is that of its class times that of the word in its class, both softmaxes over sums
of weights of hashed features: the word before, the one before that (a skip), the third (a skip), the pair
before, and a bias. The (CLASSES - 1) * MEMBERS most frequent words have classes by frequency, MEMBERS each; all other
words are class 0, in which a word has its smoothed share of the counts of that class. Words and their
features are hashes, so texts of any vocabulary score.

Training. In each of ROUNDS rounds the training documents of one part (by hash of the id; together the parts are all of
them) pass once through the tasks. A task starts from the weights of the round before and takes gradient steps (AdaGrad)
on its own rows; its change of the weights, in blocks of rows, is averaged over the tasks by tokens seen. Weights
have a fixed size; counts, updates and tail words grow with the corpus.

Edge cases: a null text counts as empty and has one token, its end; without training documents all counts are 0 and the
model is uniform; rows that repeat an id are scored, and learned from, each for itself; a null id is a training row;
an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.llm.common import documents, held, materialise, ship, shuffle_width
from docgauge.llm.jaccard_join import _groups, _sorted
from docgauge.llm.shingles import mix, words

#: Words whose counts every task holds, at most.
HEAD = 1 << 18
CLASSES, MEMBERS, CLASS_ROWS, WORD_ROWS, ROUNDS = 32, 64, 1 << 13, 1 << 15, 2
RATE, BATCH, CHUNK_CHARS, BLOCKS = 0.2, 8192, 16_000_000, 32
#: In a gradient step: slopes of a row that are added together with other rows', and rows that are updated at a time.
TOGETHER, STEP = 16, 512
#: Folds, and the one that is held out.
FOLDS, HELD = 5, 1
_END, _START = np.uint64(0x0DDC0FFEE0DDF00D), np.uint64(0x5EED5EED5EED5EED)
_LOG10 = float(np.log(10))


def _tokens(text: str | None) -> np.ndarray:
    return np.r_[words(text), _END]


def _counted(docs: DataFrame, buckets: int, width: int) -> DataFrame:
    """word, count of the tokens of all rows of docs (text)."""

    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        word, count = np.unique(np.concatenate(parts), return_counts=True)
        bucket = (word % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        word, count, bucket = word[order], count[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)).tolist()
        spans = list(zip(cuts, cuts[1:], strict=False))
        return pa.RecordBatch.from_arrays([pa.array([int(bucket[a]) for a, _ in spans], pa.int64()), pa.array([word[a:z].tobytes() for a, z in spans], pa.binary()), pa.array([count[a:z].tobytes() for a, z in spans], pa.binary())], names=["bucket", "words", "counts"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                parts.append(_tokens(text))
                size += len(text or "")
                if size >= CHUNK_CHARS:
                    yield flush(parts)
                    parts, size = [], 0
        if parts:
            yield flush(parts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "bucket"):
            word = np.concatenate([np.frombuffer(x, np.uint64) for x in rows.column("words").to_pylist()])
            count = np.concatenate([np.frombuffer(x, np.int64) for x in rows.column("counts").to_pylist()])
            found, inverse = np.unique(word, return_inverse=True)
            total = np.zeros(len(found), np.int64)
            np.add.at(total, inverse, count)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(total)], names=["word", "count"])

    sent = docs.select("text").mapInArrow(scan, "bucket long, words binary, counts binary")
    return _sorted(sent, "bucket", width).mapInArrow(add, "word long, count long")


class Vocabulary:
    """Counts of the frequent words, totals, and class and member of those that have them."""

    def __init__(self, word: np.ndarray, count: np.ndarray, total: int, distinct: int):
        rank = np.lexsort((word, -count))
        modelled = rank[: (CLASSES - 1) * MEMBERS]
        slot = np.full(len(word), -1, np.int64)
        slot[modelled] = np.arange(len(modelled)) + MEMBERS  # class 0 has no members
        order = np.argsort(word)
        self.word, self.count, self.slot = word[order], count[order], slot[order]
        self.total, self.distinct = total, distinct
        self.rest_total = total - int(count[modelled].sum())
        self.rest_distinct = distinct - len(modelled)
        self.filled = np.bincount((np.arange(len(modelled)) + MEMBERS) // MEMBERS, minlength=CLASSES)

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether a token is frequent, its count (else 0) and its slot (else -1)."""
        if not len(self.word):
            return np.zeros(len(tokens), bool), np.zeros(len(tokens), np.int64), np.full(len(tokens), -1)
        at = np.minimum(np.searchsorted(self.word, tokens), len(self.word) - 1)
        known = self.word[at] == tokens
        return known, np.where(known, self.count[at], 0), np.where(known, self.slot[at], -1)


def _context(tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three tokens before each; before the first of a text stands a start."""
    before = []
    place = np.arange(len(tokens)) - np.repeat(starts, np.diff(np.r_[starts, len(tokens)]))
    for k in (1, 2, 3):
        b = np.roll(tokens, k)
        b[place < k] = _START
        before.append(b)
    return tuple(before)


def _rows(before: tuple[np.ndarray, ...], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the class table and, given the class, of the word table."""
    one, two, three = before
    hashed = lambda x, k, n: (mix(x + np.uint64(k)) % np.uint64(n - CLASSES)).astype(np.int64) + CLASSES
    first = np.zeros(len(one), np.int64)
    upper = np.stack([first, hashed(one, 1, CLASS_ROWS), hashed(two, 2, CLASS_ROWS), hashed(three, 3, CLASS_ROWS), hashed(mix(one) + two, 4, CLASS_ROWS)], axis=1)
    c = classes.astype(np.uint64)
    lower = np.stack([classes, hashed(mix(one) + c, 5, WORD_ROWS), hashed(mix(two) + c, 6, WORD_ROWS), hashed(mix(mix(one) + two) + c, 7, WORD_ROWS)], axis=1)
    return upper, lower


def _logits(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = table.take(rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        out += table.take(rows[:, k], axis=0)
    return out


def _normal(z: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Softmax, in place. Sums of weights are far below the range of exp, so they are clipped rather than shifted."""
    np.clip(z, -60, 60, out=z)
    np.exp(z, out=z)
    if mask is not None:
        z[mask] = 0
    z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]
    return z


def _step(table: np.ndarray, seen: np.ndarray, at: np.ndarray, slope: np.ndarray) -> None:
    """One AdaGrad step on different rows, a few at a time, so that they stay in the processor's cache."""
    for a in range(0, len(at), STEP):
        i, g = at[a : a + STEP], slope[a : a + STEP]
        squares = seen.take(i, axis=0)
        squares += g * g
        seen[i] = squares
        np.sqrt(squares, out=squares)
        change = g / squares
        change *= RATE
        table[i] -= change


def _descend(table: np.ndarray, seen: np.ndarray, rows: np.ndarray, slope: np.ndarray) -> None:
    """One AdaGrad step: slopes of equal rows are summed first.

    The first feature has few rows, below CLASSES, which no other feature has: they are summed by a matrix product. Of the
    others most stand there once or twice: the k-th slopes of all rows are added at once, for k below TOGETHER, and what
    is left of frequent rows is summed row by row.
    """
    n, first = len(rows), rows[:, 0].astype(np.uint8)
    at = np.flatnonzero(np.bincount(first)).astype(np.uint8)
    _step(table, seen, at.astype(np.int64), (first == at[:, None]).astype(slope.dtype) @ slope)
    flat = rows.T[1:].astype(np.uint16).ravel()
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    order %= n
    cut = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    size = np.diff(cut, append=len(flat))
    down = np.argsort(-size, kind="stable")
    cut, size = cut[down], size[down]
    g = slope.take(order[cut], axis=0)
    for k in range(1, TOGETHER):
        m = int(np.searchsorted(-size, -k))  # so many rows have more than k slopes
        g[:m] += slope.take(order[cut[:m] + k], axis=0)
    for j in range(int(np.searchsorted(-size, -TOGETHER))):
        g[j] += slope.take(order[cut[j] + TOGETHER : cut[j] + size[j]], axis=0).sum(axis=0)
    _step(table, seen, flat[cut].astype(np.int64), g)


def _start(vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Weights from which training starts: the biases give each class and each member its share of the counts."""
    upper, lower = np.zeros((CLASS_ROWS, CLASSES), np.float32), np.zeros((WORD_ROWS, MEMBERS), np.float32)
    count = np.zeros(CLASSES * MEMBERS)
    modelled = vocabulary.slot >= 0
    count[vocabulary.slot[modelled]] = vocabulary.count[modelled]
    count = count.reshape(CLASSES, MEMBERS) + 0.5
    mass = count.sum(axis=1)
    mass[0] = vocabulary.rest_total + 0.5
    upper[0] = np.log(mass / mass.sum())
    lower[:CLASSES] = np.log(count / count.sum(axis=1, keepdims=True))
    return upper, lower


def _learn(weights: tuple[np.ndarray, np.ndarray], vocabulary: Vocabulary, batches: Iterator[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Weights after gradient steps on lists of texts, and the tokens seen."""
    upper, lower = weights[0].copy(), weights[1].copy()
    seen = np.ones_like(upper), np.ones_like(lower)
    empty = np.arange(MEMBERS)[None, :] >= vocabulary.filled[:, None]
    n = 0
    for texts in batches:
        tokens = np.concatenate(texts)
        starts = np.cumsum([0, *map(len, texts[:-1])])
        *_, slot = vocabulary.find(tokens)
        classes = np.where(slot < 0, 0, slot // MEMBERS)
        rows = _rows(_context(tokens, starts), classes)
        for a in range(0, len(tokens), BATCH):
            z = min(len(tokens), a + BATCH)
            p = _normal(_logits(upper, rows[0][a:z]))
            p[np.arange(z - a), classes[a:z]] -= 1
            _descend(upper, seen[0], rows[0][a:z], p)
            own = np.flatnonzero(classes[a:z]) + a
            if len(own):
                p = _normal(_logits(lower, rows[1][own]), empty[classes[own]])
                p[np.arange(len(own)), slot[own] % MEMBERS] -= 1
                _descend(lower, seen[1], rows[1][own], p)
        n += len(tokens)
    return upper, lower, n


def _texts(batches: Iterator[pa.RecordBatch], column: int, limit: int = CHUNK_CHARS // 8) -> Iterator[list[np.ndarray]]:
    held, size = [], 0
    for batch in batches:
        for text in batch.column(column).to_pylist():
            held.append(_tokens(text))
            size += len(text or "")
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def _round(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], vocabulary, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The weights after one pass over docs (text): the mean of the tasks' weights, by tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *after, n = _learn(sent.value, vocabulary.value, _texts(batches, 0))
        if n:
            for kind, (new, old) in enumerate(zip(after, sent.value, strict=True)):
                for k, part in enumerate(np.array_split(new - old, BLOCKS)):
                    yield pa.RecordBatch.from_arrays([pa.array([kind * BLOCKS + k], pa.int64()), pa.array([n], pa.int64()), pa.array([part.astype(np.float16).tobytes()], pa.binary())], names=["block", "tokens", "change"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens, now = None, 0, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([(total / tokens).astype(np.float32).tobytes()], pa.binary())], names=["block", "change"])
        for batch in batches:
            for block, n, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "tokens", "change")), strict=True):
                if block != now:
                    if now is not None:
                        yield out()
                    total, tokens, now = 0.0, 0, block
                total, tokens = total + np.frombuffer(raw, np.float16).astype(np.float64) * n, tokens + n
        if now is not None:
            yield out()

    changes = docs.select("text").mapInArrow(work, "block long, tokens long, change binary")
    got = {r["block"]: np.frombuffer(r["change"], np.float32) for r in _sorted(changes, "block", min(width, 2 * BLOCKS)).mapInArrow(mean, "block long, change binary").collect()}
    sent.unpersist()
    after = []
    for kind, old in enumerate(weights):
        parts = [got.get(kind * BLOCKS + k, np.zeros(x.size, np.float32)).reshape(x.shape) for k, x in enumerate(np.array_split(old, BLOCKS))]
        after.append(old + np.concatenate(parts))
    return tuple(after)


class Model:
    """What scoring needs: broadcasts of the vocabulary and the weights, and the table of all counts."""

    def __init__(self, counts: DataFrame, least: int, vocabulary, weights, total: int, distinct: int):
        self.counts, self.least, self.vocabulary, self.weights, self.total, self.distinct = counts, least, vocabulary, weights, total, distinct


def train(docs: DataFrame) -> Model:
    """Learns from all rows of docs (doc_id, text)."""
    ship(docs.sparkSession)
    width = shuffle_width(docs)
    context = docs.sparkSession.sparkContext
    counts = materialise(_counted(docs, 4 * width, width), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    # How many words reach each count, to a sixteenth of a power of two: some hundred rows.
    steps = counts.groupBy(F.floor(F.log2("count") * 16).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("count").alias("least")).collect()
    least, n = 1 << 62, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        n += r["n"]
        if n > HEAD:
            break
        least = r["least"]
    got = counts.where(F.col("count") >= least).toArrow()
    vocabulary = Vocabulary(got.column("word").to_numpy().view(np.uint64), got.column("count").to_numpy(), total, distinct)
    sent = context.broadcast(vocabulary)
    weights = _start(vocabulary)
    for k in range(ROUNDS):
        mine = docs.where(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit("round")), F.lit(ROUNDS)) == k)
        weights = _round(mine, weights, sent, width)
    return Model(counts, least, sent, context.broadcast(weights), total, distinct)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, further columns are dropped) with n_tokens, n_known, base_score and score."""
    ship(docs.sparkSession)
    width = shuffle_width(docs)
    buckets = 4 * width
    kind = docs.schema["doc_id"].dataType.simpleString()
    base_log = float(np.log10(model.total + 0.5 * (model.distinct + 1)))
    shared, weights = model.vocabulary, model.weights

    def flush(ids: list[pa.Array], texts: list[np.ndarray], part: int) -> Iterator[pa.RecordBatch]:
        v, (upper, lower) = shared.value, weights.value
        empty = np.arange(MEMBERS)[None, :] >= v.filled[:, None]
        tokens = np.concatenate(texts)
        lengths = np.array([len(t) for t in texts])
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        known, count, slot = v.find(tokens)
        classes = np.where(slot < 0, 0, slot // MEMBERS)
        rows = _rows(_context(tokens, starts), classes)
        value = np.empty(len(tokens))
        rest_log = float(np.log10(v.rest_total + 0.5 * (v.rest_distinct + 1)))
        for a in range(0, len(tokens), BATCH):
            z = min(len(tokens), a + BATCH)
            p = _normal(_logits(upper, rows[0][a:z]))
            value[a:z] = np.log10(p[np.arange(z - a), classes[a:z]])
            own = np.flatnonzero(classes[a:z]) + a
            if len(own):
                p = _normal(_logits(lower, rows[1][own]), empty[classes[own]])
                value[own] += np.log10(np.maximum(p[np.arange(len(own)), slot[own] % MEMBERS], 1e-30))
        own_log = np.where(known, np.log10(count + 0.5), 0.0)
        value += np.where((classes == 0) & known, own_log - rest_log, 0.0)
        doc = np.repeat(np.arange(len(texts)), lengths)
        total = lambda x: np.bincount(doc, x, len(texts))
        blank = pa.nulls(len(texts), pa.binary())
        names = ["part", "row", "doc_id", "n_tokens", "n_known", "base_score", "score", "bucket", "words", "rows"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(texts), part)), pa.array(np.arange(len(texts))), pa.concat_arrays(ids), pa.array(lengths), pa.array(total(known & (count > 0)).astype(np.int64)), pa.array(total(own_log) - lengths * base_log), pa.array(total(value)), pa.nulls(len(texts), pa.int64()), blank, blank], names=names,
        )
        rare = np.flatnonzero(~known)
        if len(rare):
            word, where = tokens[rare], doc[rare].astype(np.uint32)
            bucket = (word % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            word, where, bucket = word[order], where[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)).tolist()
            spans = list(zip(cuts, cuts[1:], strict=False))
            none = lambda t: pa.nulls(len(spans), t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(spans), part)), none(pa.int64()), none(ids[0].type), none(pa.int64()), none(pa.int64()), none(pa.float64()), none(pa.float64()), pa.array([int(bucket[a]) for a, _ in spans], pa.int64()), pa.array([word[a:z].tobytes() for a, z in spans], pa.binary()), pa.array([where[a:z].tobytes() for a, z in spans], pa.binary())], names=names,
            )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, k = TaskContext.get().partitionId() << 24, 0
        ids, texts, size = [], [], 0
        for batch in batches:
            start = 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                texts.append(_tokens(text))
                size += len(text or "")
                if size >= CHUNK_CHARS // 4:
                    ids.append(batch.column(0).slice(start, i + 1 - start))
                    yield from flush(ids, texts, first + k)
                    ids, texts, size, start, k = [], [], 0, i + 1, k + 1
            if start < batch.num_rows:
                ids.append(batch.column(0).slice(start))
        if texts:
            yield from flush(ids, texts, first + k)

    scored = docs.select("doc_id", "text").mapInArrow(scan, f"part long, row long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double, bucket long, words binary, rows binary")
    scored = materialise(scored, "scored")
    none = lambda t: F.lit(None).cast(t)
    # The same bucket as in flush: the unsigned word modulo the number of buckets, worked out in Python for both sides.
    rare = scored.where("bucket is not null").select("bucket", "part", "words", "rows")

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, count = (batch.column(c).to_numpy() for c in ("word", "count"))
            bucket = (word.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            word, count, bucket = word[order], count[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)).tolist()
            spans = list(zip(cuts, cuts[1:], strict=False))
            if spans:
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a]) for a, _ in spans], pa.int64()), pa.nulls(len(spans), pa.int64()), pa.array([word[a:z].tobytes() for a, z in spans], pa.binary()), pa.array([count[a:z].tobytes() for a, z in spans], pa.binary())], names=["bucket", "part", "words", "rows"])

    tail = model.counts.where(F.col("count") < model.least).mapInArrow(tag, "bucket long, part long, words binary, rows binary")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _groups(batches, "bucket"):
            part, word, row = (table.column(c).to_pylist() for c in ("part", "words", "rows"))
            mine = [i for i, p in enumerate(part) if p is None]
            known = np.concatenate([np.frombuffer(word[i], np.uint64) for i in mine] or [np.zeros(0, np.uint64)])
            count = np.concatenate([np.frombuffer(row[i], np.int64) for i in mine] or [np.zeros(0, np.int64)])
            order = np.argsort(known)
            known, count = known[order], count[order]
            asked = [i for i, p in enumerate(part) if p is not None]
            answers = []
            for i in asked:
                w = np.frombuffer(word[i], np.uint64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, w), len(known) - 1)
                    answers.append(np.where(known[at] == w, count[at], 0).astype(np.int64).tobytes())
                else:
                    answers.append(np.zeros(len(w), np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([part[i] for i in asked], pa.int64()), pa.array([row[i] for i in asked], pa.binary()), pa.array(answers, pa.binary())], names=["part", "rows", "counts"])

    answers = _sorted(rare.unionByName(tail), "bucket", width).mapInArrow(look_up, "part long, rows binary, counts binary")
    own = scored.where("row is not null").select("part", "row", "doc_id", "n_tokens", "n_known", "base_score", "score", none("binary").alias("rows"), none("binary").alias("counts"))
    answers = answers.select("part", none("long").alias("row"), none(kind).alias("doc_id"), none("long").alias("n_tokens"), none("long").alias("n_known"), none("double").alias("base_score"), none("double").alias("score"), "rows", "counts")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        rest_log = float(np.log10(v.rest_total + 0.5 * (v.rest_distinct + 1)))
        for _, table in _groups(batches, "part"):
            is_doc = pa.array([x is None for x in table.column("counts").to_pylist()])
            rows = table.filter(is_doc).sort_by("row")
            got = table.filter(pa.compute.invert(is_doc))
            n = rows.num_rows
            place = np.concatenate([np.frombuffer(x, np.uint32) for x in got.column("rows").to_pylist()] or [np.zeros(0, np.uint32)]).astype(np.int64)
            count = np.concatenate([np.frombuffer(x, np.int64) for x in got.column("counts").to_pylist()] or [np.zeros(0, np.int64)])
            logs = np.bincount(place, np.log10(count + 0.5), n)
            rare = np.bincount(place, minlength=n)
            seen = np.bincount(place, count > 0, n).astype(np.int64)
            column = lambda c: rows.column(c).to_numpy()  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), pa.array(column("n_tokens")), pa.array(column("n_known") + seen), pa.array(column("base_score") + logs), pa.array(column("score") + logs - rare * rest_log)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return _sorted(own.unionByName(answers), "part", width).mapInArrow(add, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs.where(F.coalesce(held("doc_id", FOLDS), F.lit(0)) != HELD))
    scored = score(docs, model)
    return scored.select("doc_id", (held("doc_id", FOLDS) == HELD).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
