"""Near duplicates: links between documents whose sets of word n-grams have a Jaccard similarity of at least a threshold,
and the components of these links, by a token-group matrix.

1. Sets. Each text becomes its sorted distinct n-gram hashes; equal sets are one class from here on.
2. Groups of similar documents. Under one order of all tokens, sets that link share one of their first
   n - ceil(threshold * n) + 1 tokens. The order is by how many classes hold a token, rarest first, among a SAMPLE share of
   all tokens (taken by hash), and by hash for the rest, so that unlike documents nearly never meet. Tokens are counted in
   buckets, only those which two classes share go back to their classes, and classes that share a first
   token are joined into groups (connected components of the sharing). No two classes of different groups can link.
3. Token-group matrix. The classes of a group, in blocks of BLOCK (each pair of blocks is a task of its own, so a large
   group is many tasks), are dealt into token groups of TOKEN_GROUP classes; of each the union of tokens is kept. The
   overlap of a class with that union bounds its overlap with every member: only token groups that reach threshold *
   size are opened, and there the exact overlaps are counted by a matrix product.
4. Links give components; the links written are a spanning forest for each pair of blocks, which loses no component.

Nothing is capped: frequent tokens and large groups cost more tasks, not lost rows.

Edge cases: null and blank texts have an empty set, link with nothing and are components of their own; texts with fewer
words than n are one token; rows that repeat a text are equal sets; rows that repeat an id with other texts are documents
of their own under one id; a row without id has the component of an equal set that has one, else links with nothing, and is
never dropped; an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.llm.common import LOWER, UPPER, documents, in_arrow, materialise, ship, shuffle_width, sized, unwrapped, wrapped
from docgauge.llm.components import connected
from docgauge.llm.shingles import fingerprint, shingles

#: Words in an n-gram and least similarity, in hundredths, where no contract says otherwise.
WORDS, PERCENT = 5, 80
#: Share of tokens that are counted, as a part of 2^64; text read before postings are sent on. A share near that of the first
#: tokens leaves no choice of rare ones, and common passages then chain unlike documents into one large group.
SAMPLE, CHUNK_CHARS = 0.6, 8_000_000
BLOCK, TOKEN_GROUP, COLUMNS = 512, 32, 8192
_LIMIT = np.uint64(int(SAMPLE * 2**64))


def _first(n, percent: int):
    """How many first tokens of a set of n must be looked at."""
    return n - (percent * n + 99) // 100 + 1


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Rows of one key at a time, from batches sorted by it."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if keys[a] != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = keys[a]
            held.append(batch.slice(a, z - a))
    if held:
        yield now, pa.Table.from_batches(held)


def _sorted(df: DataFrame, key: str, width: int) -> DataFrame:
    return df.repartition(width, key).sortWithinPartitions(key)


def sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n (tokens), s (those that are counted), fp (of the set) for each row."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s, fp = [], [], []
            for text in batch.column(1).to_pylist():
                t = shingles(text, words)
                n.append(len(t))
                s.append(int(np.searchsorted(t, _LIMIT)))
                fp.append(fingerprint(t))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, s, fp))], names=["doc_id", "n", "s", "fp"])

    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n long, s long, fp long")


def _postings(docs: DataFrame, words: int, percent: int, buckets: int) -> DataFrame:
    """bucket, tokens, place, fps: the counted tokens of each set, and those first tokens that aren't counted; packed for each bucket."""

    def flush(held: list[np.ndarray], fps: list[int]) -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate(held)
        place = np.repeat(np.arange(len(held), dtype=np.uint32), [len(x) for x in held])
        held.clear()  # the sets, which views of them held whole, go before the copies below are made
        bucket = (tokens % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        tokens, place, bucket = tokens[order], place[order], bucket[order]
        del order
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        out, fp = ([], [], [], []), np.array(fps, np.int64)
        for a, z in zip(cuts, cuts[1:], strict=False):
            used, inner = np.unique(place[a:z], return_inverse=True)
            for c, x in zip(out, (int(bucket[a]), tokens[a:z].tobytes(), inner.astype(np.uint32).tobytes(), fp[used].tobytes()), strict=True):
                c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.binary()) for c in out[1:])], names=["bucket", "tokens", "place", "fps"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fps, seen, size = [], [], set(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                t = shingles(text, words)
                fp = fingerprint(t)
                if not len(t) or fp in seen:
                    continue
                seen.add(fp)
                s = int(np.searchsorted(t, _LIMIT))
                held.append(t[: max(s, int(_first(len(t), percent)))])
                fps.append(fp)
                size += len(text)
                if size >= CHUNK_CHARS:
                    yield from flush(held, fps)
                    held, fps, size = [], [], 0
                    if len(seen) > 1_000_000:
                        seen = set()
        if held:
            yield from flush(held, fps)

    return in_arrow(docs.select("text"), run, "bucket long, tokens binary, place binary, fps binary")


def _shared(postings: DataFrame, parts: int, width: int) -> DataFrame:
    """part, fp, tokens, counts: of each class (packed for each part of the classes) the tokens that another class holds too, and how many do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "bucket"):
            tokens = np.concatenate([np.frombuffer(x, np.uint64) for x in rows.column("tokens").to_pylist()])
            fps = np.concatenate([np.frombuffer(f, np.int64)[np.frombuffer(p, np.uint32)] for f, p in zip(rows.column("fps").to_pylist(), rows.column("place").to_pylist(), strict=True)])
            order = np.lexsort((fps, tokens))
            tokens, fps = tokens[order], fps[order]
            fresh = np.ones(len(tokens), bool)
            fresh[1:] = (tokens[1:] != tokens[:-1]) | (fps[1:] != fps[:-1])
            tokens, fps = tokens[fresh], fps[fresh]
            _, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
            df = counts[inverse]
            keep = df > 1
            tokens, fps, df = tokens[keep], fps[keep], df[keep].astype(np.int64)
            part = np.mod(fps, parts)
            order = np.argsort(part, kind="stable")
            tokens, fps, df, part = tokens[order], fps[order], df[order], part[order]
            cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            out = ([], [], [], [])
            for a, z in zip(cuts, cuts[1:], strict=False):
                for c, x in zip(out, (int(part[a]), fps[a:z].tobytes(), tokens[a:z].tobytes(), df[a:z].tobytes()), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.binary()) for c in out[1:])], names=["part", "fps", "tokens", "counts"])

    return in_arrow(_sorted(postings, "bucket", width), run, "part long, fps binary, tokens binary, counts binary")


def _first_shared(shared: DataFrame, classes: DataFrame, parts: int, width: int, percent: int) -> DataFrame:
    """token, fp: the first tokens of each class that another class holds too."""
    own = classes.where("n > 0").select("fp", "n", "s")
    own = own.withColumn("part", F.pmod("fp", F.lit(parts)).cast("long"))  # as in _shared
    empty = F.lit(None).cast("binary")
    rows = own.select("part", "fp", "n", "s", empty.alias("fps"), empty.alias("tokens"), empty.alias("counts"))
    none = F.lit(None).cast("long")
    rows = rows.unionByName(shared.select("part", none.alias("fp"), none.alias("n"), none.alias("s"), "fps", "tokens", "counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "part"):
            packed = rows.column("tokens").to_pylist()
            if all(x is None for x in packed):
                continue
            is_row = np.array([x is None for x in packed])
            fp, n, s = (rows.column(c).filter(pa.array(is_row)).to_numpy() for c in ("fp", "n", "s"))
            order = np.argsort(fp)
            fp, n, s = fp[order], n[order], s[order]
            join = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in rows.column(c).to_pylist() if x is not None])  # noqa: E731, B023
            fps, tokens, df = join("fps", np.int64), join("tokens", np.uint64), join("counts", np.int64)
            counted = tokens < _LIMIT
            forced = ~counted
            order = np.lexsort((tokens[counted], df[counted], fps[counted]))
            f, t = fps[counted][order], tokens[counted][order]
            at = np.searchsorted(fp, f)
            start = np.flatnonzero(np.r_[True, f[1:] != f[:-1]]) if len(f) else np.zeros(0, np.int64)
            size = np.diff(np.r_[start, len(f)])
            rank = np.arange(len(f)) - np.repeat(start, size)
            alone = s[at] - np.repeat(size, size)  # counted tokens that no other class holds: first of all
            keep = alone + rank < _first(n[at], percent)
            out_t, out_f = np.r_[t[keep], tokens[forced]], np.r_[f[keep], fps[forced]]
            yield pa.RecordBatch.from_arrays([pa.array(out_t.view(np.int64)), pa.array(out_f)], names=["token", "fp"])

    return in_arrow(_sorted(rows, "part", width), run, "token long, fp long")


def verify(tokens: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of side 0 and sets of side 1 (or among all, where there is one side)."""
    m, sizes = len(tokens), np.array([len(t) for t in tokens])
    one = not side.any()
    top = list(range(m))

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    links = []

    def link(a: int, b: int) -> None:
        x, y = root(a), root(b)
        if x != y:
            top[max(x, y)] = min(x, y)
            links.append((a, b))

    if m <= 6:
        for a in range(m):
            for b in range(a + 1, m):
                if (one or side[a] != side[b]) and percent * max(sizes[a], sizes[b]) <= 100 * min(sizes[a], sizes[b]):
                    both = len(np.intersect1d(tokens[a], tokens[b], assume_unique=True))
                    if 100 * both >= percent * (sizes[a] + sizes[b] - both):
                        link(a, b)
        return links
    _, inverse, counts = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), sizes)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    keep = shared[inverse]
    row, column, width = row[keep], number[inverse[keep]], int(shared.sum())
    order = np.lexsort((sizes, np.array([int(t[0] >> np.uint64(1)) for t in tokens])))
    members = order[side[order] == (0 if one else 1)]
    groups = [members[k : k + TOKEN_GROUP] for k in range(0, len(members), TOKEN_GROUP)]
    asking = np.flatnonzero(side == 0)
    bound = np.zeros((len(asking), len(groups)), np.float32)
    exact = np.zeros((len(asking), len(members)), np.float32)
    place = np.full(m, -1)
    place[members] = np.arange(len(members))
    spans = [(k, min(width, k + COLUMNS)) for k in range(0, width, COLUMNS)]

    def part(a: int, z: int) -> np.ndarray:
        out = np.zeros((m, z - a), np.float32)
        inside = (column >= a) & (column < z)
        out[row[inside], column[inside] - a] = 1
        return out

    kept = {}
    for a, z in spans:
        matrix = part(a, z)
        union = np.stack([matrix[g].max(axis=0) for g in groups])
        bound += matrix[asking] @ union.T
        if len(spans) == 1:
            kept[a] = matrix
    opened = bound * 100 >= percent * sizes[asking][:, None]
    for a, z in spans:
        matrix = kept[a] if a in kept else part(a, z)
        for k, g in enumerate(groups):
            ask = np.flatnonzero(opened[:, k])
            if len(ask):
                exact[np.ix_(ask, place[g])] += matrix[asking[ask]] @ matrix[g].T
    union_size = sizes[asking][:, None] + sizes[members][None, :] - exact
    for x, y in zip(*np.nonzero((100 * exact >= percent * union_size) & (exact > 0)), strict=True):
        if asking[x] != members[y]:
            link(int(asking[x]), int(members[y]))
    return links


def _links(docs: DataFrame, grouped: DataFrame, words: int, percent: int, width: int) -> DataFrame:
    """a, b: links between classes of one group. grouped: fp, label, doc_id of one document of each class."""
    sizes = grouped.groupBy("label").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    placed = grouped.join(sizes, "label").select("doc_id", "fp", "label", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("block"))
    # Texts of no group are put aside first, by ids alone. Repeated ids would only repeat equal sets.
    placed = materialise(placed, "grouped")
    ids = sized(placed.select(F.col("doc_id").alias("__id")))
    some = docs.join(ids, F.col("doc_id") == F.col("__id"), "left_semi")
    texts = some.join(placed, "doc_id").select("fp", "label", "blocks", "block", "text")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(shingles(t, words)) for t in batch.column("text").to_pylist()]
            same = pa.array([fingerprint(t) == f for t, f in zip(own, batch.column("fp").to_pylist(), strict=True)])
            cols = [batch.column(c) for c in ("fp", "label", "blocks", "block")]
            out = pa.RecordBatch.from_arrays([*cols, pa.array([t.tobytes() for t in own], pa.binary())], names=["fp", "label", "blocks", "block", "tokens"])
            yield out.filter(same)

    rows = in_arrow(texts, tokenise, "fp long, label long, blocks int, block int, tokens binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("fp", "label", "block", "tokens", other.alias("other"))
    pair = F.xxhash64("label", F.least("block", "other"), F.greatest("block", "other"))
    rows = rows.select(pair.alias("task"), "label", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "fp", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _groups(batches, "task"):
            fp, first = np.unique(table.column("fp").to_numpy(), return_index=True)
            take = table.take(first)
            side = (take.column("block").to_numpy() != take.column("low").to_numpy()).astype(int)
            tokens = [np.frombuffer(x, np.uint64) for x in take.column("tokens").to_pylist()]
            found = verify(tokens, side, percent)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(fp[list(a)]), pa.array(fp[list(b)])], names=["a", "b"])

    return in_arrow(_sorted(rows, "task", width), run, "a long, b long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """id_col, n_shingles, component_id for each row of docs."""
    width = shuffle_width(docs)
    buckets, parts = 2 * width, width  # packed rows go from each bucket to each part, so there are few of either
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    each = materialise(sets(slim, words, percent), "sets")
    classes = materialise(each.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("s").alias("s")), "classes")
    first = materialise(_first_shared(_shared(_postings(slim, words, percent, buckets), parts, width), classes, parts, width, percent), "first-tokens")
    heads = first.groupBy("token").agg(F.min("fp").alias("head"))
    groups = connected(first.join(heads, "token").where("fp <> head").select(F.col("fp").alias("a"), F.col("head").alias("b")))
    grouped = groups.join(classes, groups.node == classes.fp).select("fp", "label", "doc_id")
    links = materialise(_links(slim, grouped, words, percent, width), "links")
    linked = connected(links)
    labelled = classes.join(linked, classes.fp == linked.node, "left").select("fp", "doc_id", F.coalesce("label", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found = labelled.join(least, "label").select(F.col("fp").alias("__fp"), "component_id")
    joined = each.join(found, (each.fp == found["__fp"]) & (each.n > 0), "left")
    return joined.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component, that with the smallest id; same columns. An id is dropped if none of its rows stands for a component."""
    found = components(docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("text")), "own_id", "text", words, percent)
    lost = found.where("own_id is not null").groupBy("own_id").agg(F.bool_and(F.col("own_id") != F.col("component_id")).alias("copy")).where("copy")
    lost = materialise(lost.select(F.col("own_id").alias("lost_id")), "lost")
    return unwrapped(wrapped(docs, own_id=F.col(id_col)).join(sized(lost), F.col("own_id") == F.col("lost_id"), "left_anti"))


def query(spark, sf_dir: str) -> DataFrame:
    return components(documents(spark, sf_dir), words=4, percent=85)


ORACLE_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingle a JOIN shingle b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN size x ON a = x.doc_id JOIN size y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT DISTINCT a AS node, a AS other FROM edge UNION SELECT node, b FROM reach JOIN edge ON other = a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least_id, doc_id) AS component_id
FROM documents LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(other) AS least_id FROM reach GROUP BY node) USING (doc_id)
"""
