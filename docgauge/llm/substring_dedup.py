"""Removal of byte strings of a given length that a document with a smaller id holds too, by suffix arrays.

A. Anchors. In every window of LENGTH bytes the gram of GRAM bytes with the smallest hash (the leftmost of equals) is
   its anchor; equal windows have equal anchors at equal places. The windows of one anchor are a segment of less
   than 2 * LENGTH bytes. For each anchor a task sends on the gram's hash, a hash of the segment and the smallest id
   that it has seen there; that copies of a segment lie in one chunk of a task is settled on the spot.
B. Buckets of grams. A segment that a smaller id holds too is removed without a look at its bytes. Only segments whose
   gram occurs with other surroundings, alike on one side, stay open: of each the smallest id's copy is asked for.
C. Documents, in parts, mark what is settled and hand over the open segments. Texts travel compressed.
D. Shards of open segments. Each shard cuts its segments into pieces of SHARD_BYTES, builds the suffix array of each
   (Larsson-Sadakane), takes common prefixes (Kasai), so that runs of equal windows appear, and keeps each distinct
   window with its smallest id. The sorted windows of the pieces are merged by binary search, and windows with a smaller
   id elsewhere go back to their documents. A gram with more than HOT different surroundings isn't gathered: its windows
   travel one by one, by their hashes, and are counted in many tasks.
E. Documents remove all covered bytes.

Hashes have 64 bits or more where they settle anything; grams' 40 bits only bring candidates together.

Edge cases: ids are integers, others are an error; a null text counts as empty; texts below LENGTH bytes keep all; rows that repeat an id never remove each
other's bytes; a null id removes nothing and loses nothing; an empty table gives an empty result; columns other than id
and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgauge.llm.common import documents, materialise, ship, shuffle_width
from docgauge.llm.jaccard_join import _groups, _sorted
from docgauge.llm.shingles import mix
from docgauge.llm.suffix_array import PAD, common_prefixes, little_words_at, suffix_array

LENGTH, GRAM = 50, 20
SIDE = (LENGTH - GRAM) // 2
CHUNK_BYTES, CHUNK_DOCS, SHARD_BYTES, HOT = 16_000_000, 60_000, 4_000_000, 20_000
#: A chunk's documents are numbered in 16 bits: it is closed before a run of texts could take it beyond.
RUN_DOCS, PLACES = 5_000, 1 << 16
#: Longest stretch of a text in which anchors are looked for at once; stretches overlap by a window.
STRETCH = 1 << 20
_ODD = np.uint64(0x9FB21C651E98DF25)


def _hashes(key: np.ndarray, size: int, at: np.ndarray | None = None, n: int = 0) -> np.ndarray:
    """A hash of the `size` (8 or more) bytes from each place on, or from the places `at`; key: the eight bytes from each place of a padded text of n bytes."""
    n -= size - 1
    h = np.full(n if at is None else len(at), np.uint64(size))
    for k in [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]:
        h ^= key[k : k + n] if at is None else key[at + k]
        h *= _ODD
        h ^= h >> np.uint64(29)
    return mix(h)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Text, first window, last window, gram hash, segment hash (64 bits each) and context of each anchor, in order.

    Texts are worked on together, one after the other in one array, since most are short. The context is two numbers of 8
    bits: of the gram with SIDE bytes before it, and with SIDE bytes after it. Every window of an anchor holds one or the
    other, so anchors that share neither share no window.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(sizes) - sizes
    n, width = int(sizes.sum()), LENGTH - GRAM + 1
    valid = np.zeros(max(0, n - LENGTH + 1), bool)
    for o, size in zip(start.tolist(), sizes.tolist(), strict=True):
        if size >= LENGTH:
            valid[o : o + size - LENGTH + 1] = True
    window = np.flatnonzero(valid)
    if not len(window):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.astype(np.uint16)
    key = little_words_at(np.frombuffer(b"".join([*texts, bytes(PAD)]), np.uint8))
    gram = _hashes(key, GRAM, None, n)
    pick = np.empty(len(valid), np.int64)
    low = np.uint64((1 << 21) - 1)
    for a in range(0, len(valid), STRETCH):
        z = min(len(valid), a + STRETCH)
        least = (gram[a : z + width - 1] & ~low) | np.arange(z - a + width - 1, dtype=np.uint64)
        have = 1
        while 2 * have <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if rest := width - have:
            least = np.minimum(least[:-rest], least[rest:])
        pick[a:z] = (least & low).astype(np.int64) + a
    pick = pick[window]
    # A new anchor, or a new text: between texts there are no windows.
    head = np.flatnonzero(np.r_[True, (pick[1:] != pick[:-1]) | (window[1:] != window[:-1] + 1)])
    first, place = window[head], pick[head]
    last = window[np.r_[head[1:], len(window)] - 1]
    text = np.searchsorted(start, first, side="right") - 1
    # The first and the last window of a segment overlap, so together they are all of it.
    spread = mix(_hashes(key, LENGTH, first) ^ (_hashes(key, LENGTH, last) * _ODD) ^ ((last - first).astype(np.uint64) << np.uint64(40)) ^ ((place - first).astype(np.uint64) << np.uint64(50)))
    sides = [(_hashes(key, GRAM + SIDE, at) & np.uint64(0xFF)).astype(np.uint16) for at in (np.maximum(place - SIDE, start[text]), place)]
    return text, first - start[text], last - start[text], gram[place], spread, (sides[0] << np.uint16(8)) | sides[1]


def _together(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `limit` bytes, and of no more than RUN_DOCS."""
    a, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= limit or k + 1 - a >= RUN_DOCS:
            yield a, k + 1
            a, size = k + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _number(doc: int, raw: bytes) -> int:
    """64 bits of a row's id and text; rows that repeat both are treated alike anyway."""
    return xxhash.xxh64_intdigest(raw, seed=doc & ((1 << 64) - 1)) - (1 << 63)


def _key(gram: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(40 bits of the gram, 24 of the segment) and 16 more bits of the segment."""
    return (gram & ~np.uint64((1 << 24) - 1)) | (segment >> np.uint64(40)), (segment & np.uint64(0xFFFF)).astype(np.uint16)


def _one(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a ^ (b.astype(np.uint64) * _ODD))


def _packed(key: np.ndarray, columns: dict[str, np.ndarray], name: str, extra: dict | None = None) -> Iterator[pa.RecordBatch]:
    """Columns cut by key: a row of packed arrays for each value."""
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    key = key[order]
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]).tolist()
    spans = list(zip(cuts, cuts[1:], strict=False))
    arrays = [pa.array([int(key[a]) for a, _ in spans], pa.int64())]
    for c in columns.values():
        c = c[order]
        arrays.append(pa.array([c[a:z].tobytes() for a, z in spans], pa.binary()))
    yield pa.RecordBatch.from_arrays(arrays, names=[name, *columns])


def _join(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in table.column(column).to_pylist()] or [np.zeros(0, kind)])


_TEXT_ROWS = ["part", "doc_id", "text", "ids", "keys", "asks"]


def _text_rows(doc: pa.Array, texts: list[bytes], parts: int) -> Iterator[pa.RecordBatch]:
    shrink = zstandard.ZstdCompressor(level=3).compress
    blank = [pa.nulls(len(texts), pa.binary())] * 3
    yield pa.RecordBatch.from_arrays([pa.array(np.mod(doc.to_numpy(), parts)), doc, pa.array([shrink(t) for t in texts], pa.binary()), *blank], names=_TEXT_ROWS)


def _postings(docs: DataFrame, buckets: int, parts: int, settled: bool) -> DataFrame:
    """Anchors by bucket of their gram, the smallest id of a chunk for each; or, where settled, the texts (compressed) and what the chunk settles, by part of the document."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        a, b, context, doc = (np.concatenate([h[k] for h in held]) for k in range(4))
        if not len(a):
            return
        order = np.lexsort((doc, b, a))
        a, b, doc, context = a[order], b[order], doc[order], context[order]
        fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        if settled:
            late = doc > doc[fresh][np.cumsum(fresh) - 1]
            late[1:] &= (doc[1:] != doc[:-1]) | fresh[1:]
            doc = doc[late]
            for batch in _packed(np.mod(doc, parts), {"ids": doc, "keys": _one(a[late], b[late]), "asks": np.zeros(len(doc), np.uint8)}, "part"):
                blank = [pa.nulls(batch.num_rows, t) for t in (pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *blank, *batch.columns[1:]], names=_TEXT_ROWS)
            return
        a, b, doc, context = a[fresh], b[fresh], doc[fresh], context[fresh]
        bucket = ((a >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        a, b, doc, context, bucket = a[order], b[order], doc[order], context[order], bucket[order]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]).tolist()
        out = {c: [] for c in ("bucket", "a", "b", "context", "place", "ids")}
        for i, j in zip(cuts, cuts[1:], strict=False):
            own, place = np.unique(doc[i:j], return_inverse=True)
            for c, x in zip(out, (int(bucket[i]), a[i:j].tobytes(), b[i:j].tobytes(), context[i:j].tobytes(), place.astype(np.uint16).tobytes(), own.tobytes()), strict=True):
                out[c].append(x)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if c == "bucket" else pa.binary()) for c, v in out.items()], names=list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs_held, size = [], 0, 0
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            if settled and texts:
                yield from _text_rows(batch.column(0), texts, parts)
            ids = batch.column(0).to_numpy()
            for k, z in _together(texts):
                if docs_held + z - k > PLACES:
                    yield from flush(held)
                    held, docs_held, size = [], 0, 0
                text, _, _, gram, segment, context = anchors(texts[k:z])
                held.append((*_key(gram, segment), context, ids[k:z][text]))
                docs_held, size = docs_held + z - k, size + sum(map(len, texts[k:z]))
                if size >= CHUNK_BYTES or docs_held >= CHUNK_DOCS:
                    yield from flush(held)
                    held, docs_held, size = [], 0, 0
        if held:
            yield from flush(held)

    kind = "part long, doc_id long, text binary, ids binary, keys binary, asks binary" if settled else "bucket long, a binary, b binary, context binary, place binary, ids binary"
    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, kind)


def _answers(postings: DataFrame, parts: int, width: int) -> DataFrame:
    """part, ids, keys, asks: 0 a segment is settled as removed, 1 its bytes are asked for, 2 its windows are asked for one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _groups(batches, "bucket"):
            a, b, context = _join(table, "a", np.uint64), _join(table, "b", np.uint16), _join(table, "context", np.uint16)
            doc = np.concatenate([np.frombuffer(i, np.int64)[np.frombuffer(p, np.uint16)] for i, p in zip(table.column("ids").to_pylist(), table.column("place").to_pylist(), strict=True)])
            order = np.lexsort((doc, b, a))
            a, b, doc, context = a[order], b[order], doc[order], context[order]
            gram = a >> np.uint64(24)
            new_segment = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            new_gram = np.r_[True, gram[1:] != gram[:-1]]
            least = doc[new_segment]
            removed = doc > least[np.cumsum(new_segment) - 1]
            # Of each gram, its segments, by their smallest ids; a segment is open if another one shares a side with it.
            of = (np.cumsum(new_gram) - 1)[new_segment]
            kinds = np.bincount(of)
            open_ = np.zeros(len(least), bool)
            for side in (context[new_segment] >> np.uint16(8), context[new_segment] & np.uint16(0xFF)):
                several = np.flatnonzero(kinds[of] > 1)
                near = several[np.lexsort((least[several], side[several], of[several]))]
                if len(near):
                    first = np.flatnonzero(np.r_[True, (of[near][1:] != of[near][:-1]) | (side[near][1:] != side[near][:-1])])
                    differ = np.minimum.reduceat(least[near], first) < np.maximum.reduceat(least[near], first)
                    open_[near] |= np.repeat(differ, np.diff(np.r_[first, len(near)]))
            head = np.flatnonzero(new_segment)
            ask = np.full(len(doc), -1)
            ask[removed] = 0
            ask[head] = np.where(open_, np.where(kinds[of] > HOT, 2, 1), -1)
            keep = ask >= 0
            yield from _packed(np.mod(doc[keep], parts), {"ids": doc[keep], "keys": _one(a[keep], b[keep]), "asks": ask[keep].astype(np.uint8)}, "part")

    return _sorted(postings, "bucket", width).mapInArrow(run, "part long, ids binary, keys binary, asks binary")


def covered(windows: np.ndarray, n: int) -> np.ndarray:
    """Which bytes the windows that start at the marked places cover."""
    change = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(windows)
    np.add.at(change, at, 1)
    np.add.at(change, at + LENGTH, -1)
    return np.cumsum(change[:n]) > 0


def digest(raw: bytes, marked: np.ndarray) -> tuple[int, int, int, str, bytes]:
    """n_bytes, n_removed, n_spans, kept_sha256 and the bytes kept."""
    gone = covered(marked, len(raw))
    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(raw) else 0
    return len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _marked(texts: DataFrame, answers: DataFrame, shards: int, width: int, with_kept: bool) -> DataFrame:
    """Three kinds of rows: documents that are settled, with their result (n_bytes is set); documents that wait for open segments, with
    a number and settled windows as packed bits (row is set); and open segments, by shard (shard is set)."""
    none = lambda t: F.lit(None).cast(t)
    rows = texts.unionByName(answers.select("part", none("long").alias("doc_id"), none("binary").alias("text"), "ids", "keys", "asks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc_id", "marks", "shard", "grams", "ids", "rows", "starts", "windows", "sizes", "bytes", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), *[pa.binary()] * 7, *[pa.int64()] * 3, pa.string(), pa.binary()]

        def batch_of(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names=names)

        grow = zstandard.ZstdDecompressor().decompress
        for _, table in _groups(batches, "part"):
            has_text = pa.array([x is not None for x in table.column("text").to_pylist()])
            own, got = table.filter(has_text), table.filter(pa.compute.invert(has_text))
            ids, keys, asks = _join(got, "ids", np.int64), _join(got, "keys", np.uint64), _join(got, "asks", np.uint8)
            order = np.lexsort((asks, keys, ids))
            ids, keys, asks = ids[order], keys[order], asks[order]
            out = {c: [] for c in ("row", "doc_id", "marks")}
            ready = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            segments = {c: [] for c in ("gram", "doc", "row", "start", "windows", "raw")}
            loose = {c: [] for c in ("gram", "doc", "row", "start")}
            doc_ids, raws = own.column("doc_id").to_pylist(), [grow(t) for t in own.column("text").to_pylist()]
            for start, end in _together(raws):
                text, *found = anchors(raws[start:end])
                found[2:4] = [_one(*_key(found[2], found[3])), found[2]]
                cuts = np.searchsorted(text, np.arange(end - start + 1))
                for k in range(start, end):
                    i, raw = doc_ids[k], raws[k]
                    first, last, own_key, gram = (x[cuts[k - start] : cuts[k - start + 1]] for x in found[:4])
                    marked, waits, row = np.zeros(len(raw), bool), False, _number(i, raw)
                    a, z = np.searchsorted(ids, [i, i + 1])
                    if a < z and len(first):
                        at = np.minimum(np.searchsorted(keys[a:z], own_key), z - a - 1)
                        # A segment both settled and asked for is settled: equal keys stand together, the smallest ask first.
                        ask = np.where(keys[a:z][at] == own_key, asks[a:z][at], 9)
                        change = np.zeros(len(raw) + 1, np.int32)
                        np.add.at(change, first[ask == 0], 1)
                        np.add.at(change, last[ask == 0] + 1, -1)
                        marked = np.cumsum(change[:-1]) > 0
                        for j in np.flatnonzero(ask == 1).tolist():
                            waits, f, t = True, int(first[j]), int(last[j])
                            for c, v in zip(segments, (gram[j] >> np.uint64(24), i, row, f, t - f + 1, raw[f : t + LENGTH]), strict=True):
                                segments[c].append(v)
                        if (ask == 2).any():
                            waits, key = True, little_words_at(np.frombuffer(raw + bytes(PAD), np.uint8))
                            for j in np.flatnonzero(ask == 2).tolist():
                                place = np.arange(first[j], last[j] + 1)
                                for c, v in zip(loose, (_hashes(key, LENGTH, place), np.full(len(place), i), np.full(len(place), row), place), strict=True):
                                    loose[c].append(v)
                    if waits:
                        for c, v in zip(out, (row, i, np.packbits(marked).tobytes()), strict=True):
                            out[c].append(v)
                    else:
                        *counts, kept = digest(raw, marked)
                        for c, v in zip(ready, (i, *counts, kept if with_kept else None), strict=True):
                            ready[c].append(v)
            if out["row"]:
                yield batch_of(len(out["row"]), **out)
            if ready["doc_id"]:
                yield batch_of(len(ready["doc_id"]), **ready)
            if segments["gram"]:
                gram = np.array(segments["gram"], np.uint64)
                shard = (mix(gram) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.r_[True, shard[order][1:] != shard[order][:-1], True]).tolist()
                spans = [order[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]
                pack = lambda c, kind: [np.array([segments[c][j] for j in s], kind).tobytes() for s in spans]  # noqa: E731, B023
                sizes = [np.array([len(segments["raw"][j]) for j in s], np.uint8).tobytes() for s in spans]
                yield batch_of(len(spans), shard=[int(shard[s[0]]) for s in spans], grams=pack("gram", np.uint64), ids=pack("doc", np.int64), rows=pack("row", np.int64), starts=pack("start", np.int64), windows=pack("windows", np.uint8), sizes=sizes, bytes=[b"".join(segments["raw"][j] for j in s) for s in spans])
            if loose["gram"]:
                h, doc, row, start = (np.concatenate(loose[c]) for c in ("gram", "doc", "row", "start"))
                shard = -1 - (h % np.uint64(shards)).astype(np.int64)  # windows by themselves: negative shards
                order = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.r_[True, shard[order][1:] != shard[order][:-1], True]).tolist()
                spans = [order[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]
                yield batch_of(len(spans), shard=[int(shard[s[0]]) for s in spans], grams=[h[s].tobytes() for s in spans], ids=[doc[s].tobytes() for s in spans], rows=[row[s].tobytes() for s in spans], starts=[start[s].tobytes() for s in spans])

    kinds = "row long, doc_id long, marks binary, shard long, grams binary, ids binary, rows binary, starts binary, windows binary, sizes binary, bytes binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return _sorted(rows, "part", width).mapInArrow(run, kinds)


def _piece(raw: np.ndarray, start: np.ndarray, windows: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated segments: the window places in sorted order, their group, and each group's first place and smallest id."""
    data = np.r_[raw, np.zeros(PAD, np.uint8)]
    order, _ = suffix_array(data, LENGTH)
    shared = common_prefixes(data, order, LENGTH)
    owner = np.full(len(raw), -1)
    offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    owner[np.repeat(start, windows) + offset] = np.repeat(np.arange(len(start)), windows)
    real = owner[order] >= 0
    # A run goes on while neighbours share LENGTH bytes; places that are no windows stand between without breaking it.
    run = np.cumsum(shared < LENGTH)[real]
    places = order[real]
    fresh = np.r_[True, run[1:] != run[:-1]] if len(run) else np.zeros(0, bool)
    group = np.cumsum(fresh) - 1
    least = np.minimum.reduceat(doc[owner[places]], np.flatnonzero(fresh)) if len(places) else np.zeros(0, np.int64)
    return places, group, places[fresh], least


def _columns(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    """LENGTH bytes from each place on, as big-endian words that sort like the bytes."""
    size = -(-LENGTH // 8) * 8
    out = np.zeros((len(places), size), np.uint8)
    out[:, :LENGTH] = raw[places[:, None] + np.arange(LENGTH)]
    return np.ascontiguousarray(out).view(f"S{size}").ravel()


def _decided(marked: DataFrame, parts: int, width: int) -> DataFrame:
    """part, row, starts: windows that a smaller id holds, from the open segments."""

    def answer(doc: np.ndarray, row: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from _packed(np.mod(doc, parts), {"rows": row, "starts": start}, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, table in _groups(batches, "shard"):
            ids, rows, starts = (_join(table, c, np.int64) for c in ("ids", "rows", "starts"))
            if shard < 0:
                h = _join(table, "grams", np.uint64)
                order = np.lexsort((ids, h))
                fresh = np.r_[True, h[order][1:] != h[order][:-1]]
                late = ids[order] > ids[order][fresh][np.cumsum(fresh) - 1]
                yield from answer(ids[order][late], rows[order][late], starts[order][late])
                continue
            windows, sizes = _join(table, "windows", np.uint8).astype(np.int64), _join(table, "sizes", np.uint8).astype(np.int64)
            raw = _join(table, "bytes", np.uint8)
            # Equal windows have equal grams, so pieces are cut between grams where they can be.
            end = np.cumsum(sizes)
            order = np.argsort(_join(table, "grams", np.uint64), kind="stable")
            sorted_end = np.cumsum(sizes[order])
            piece_of = (sorted_end - 1) // SHARD_BYTES
            pieces = []
            for p in np.unique(piece_of):
                own = order[piece_of == p]
                take = np.repeat(end[own] - sizes[own], sizes[own]) + np.arange(sizes[own].sum()) - np.repeat(np.cumsum(sizes[own]) - sizes[own], sizes[own])
                text, begin = raw[take], np.cumsum(sizes[own]) - sizes[own]
                places, group, head, least = _piece(text, begin, windows[own], ids[own])
                pieces.append([own, begin, places, group, _columns(text, head) if len(np.unique(piece_of)) > 1 else None, least])
            # Merging: each piece looks its distinct windows up in the sorted windows of the others.
            for x in pieces if len(pieces) > 1 else []:
                for y in pieces:
                    if x is not y and len(y[4]):
                        at = np.minimum(np.searchsorted(y[4], x[4]), len(y[4]) - 1)
                        same = y[4][at] == x[4]
                        x[5] = np.where(same, np.minimum(x[5], y[5][at]), x[5])
            for own, begin, places, group, _, least in pieces:
                of = np.searchsorted(begin, places, side="right") - 1
                late = ids[own][of] > least[group]
                yield from answer(ids[own][of][late], rows[own][of][late], (starts[own][of] + places - begin[of])[late])

    segments = marked.where("shard is not null").select("shard", "grams", "ids", "rows", "starts", "windows", "sizes", "bytes")
    return _sorted(segments, "shard", width).mapInArrow(run, "part long, rows binary, starts binary")


def _finished(docs: DataFrame, marked: DataFrame, decided: DataFrame, parts: int, width: int, with_kept: bool) -> DataFrame:
    """doc_id, counts and digest of the documents that waited. Their texts are read again: that is less than to keep them."""
    none = lambda t: F.lit(None).cast(t)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _text_rows(batch.column(0), [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()], parts):
                yield rows.select(["part", "doc_id", "text"])

    texts = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(read, "part long, doc_id long, text binary")
    blank = {"doc_id": none("long"), "text": none("binary"), "row": none("long"), "marks": none("binary"), "rows": none("binary"), "starts": none("binary")}
    order = ["part", *blank]
    waits = marked.where("row is not null").select(F.pmod("doc_id", F.lit(parts)).cast("long").alias("part"), "row", "marks")
    rows = None
    for df in (texts, waits, decided):
        one = df.withColumns({c: v for c, v in blank.items() if c not in df.columns}).select(*order)
        rows = one if rows is None else rows.unionByName(one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        grow = zstandard.ZstdDecompressor().decompress

        def batch_of(held: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(),) * 4 + (pa.string(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

        for _, table in _groups(batches, "part"):
            wait = {r: m for r, m in zip(table.column("row").to_pylist(), table.column("marks").to_pylist(), strict=True) if r is not None}
            row = _join(table.filter(pa.compute.is_valid(table.column("rows"))), "rows", np.int64)
            at = _join(table.filter(pa.compute.is_valid(table.column("rows"))), "starts", np.int64)
            order = np.argsort(row, kind="stable")
            row, at = row[order], at[order]
            held, size = [], 0
            for doc, text in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True):
                if text is None:
                    continue
                raw = grow(text)
                number = _number(doc, raw)
                if number not in wait:
                    continue
                marked = np.unpackbits(np.frombuffer(wait[number], np.uint8), count=len(raw)).astype(bool)
                marked[at[np.searchsorted(row, number) : np.searchsorted(row, number, side="right")]] = True
                *counts, kept = digest(raw, marked)
                held.append((doc, *counts, kept if with_kept else None))
                size += len(raw)
                if size >= 4_000_000:
                    yield batch_of(held)
                    held, size = [], 0
            if held:
                yield batch_of(held)

    return _sorted(rows, "part", width).mapInArrow(run, _RESULT)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the bytes that are kept."""
    ship(docs.sparkSession)
    width = shuffle_width(docs)
    buckets, parts, shards = width, 2 * width, width  # packed rows go from each bucket and shard to each part
    if docs.schema[id_col].dataType not in (T.LongType(), T.IntegerType(), T.ShortType(), T.ByteType()):
        raise TypeError(f"{id_col} is to be an integer, since smaller ids come first")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    answers = _answers(_postings(slim, buckets, parts, settled=False), parts, width)
    texts = _postings(slim, buckets, parts, settled=True)
    marked = materialise(_marked(texts, answers, shards, width, with_kept), "marked")
    ready = marked.where("n_bytes is not null").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    out = ready.unionByName(_finished(slim, marked, _decided(marked, parts, width), parts, width, with_kept))
    nameless = slim.where("doc_id is null").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("kept"))
    nameless = nameless.select("doc_id", F.octet_length("kept").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "kept")
    every = out.unionByName(nameless).withColumnRenamed("doc_id", id_col)
    return every if with_kept else every.drop("kept")


def query(spark, sf_dir: str) -> DataFrame:
    return deduplicate(documents(spark, sf_dir), with_kept=False)


#: Every window of every text, as hex digits; rows that repeat an id stay rows of their own.
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) AS s FROM (SELECT *, unnest(range(0, len(h) // 2 - {LENGTH - 1})) AS i FROM d)),
least AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
hit AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM w JOIN least USING (s) WHERE first < doc_id),
run AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM hit),
span AS (SELECT r, k, min(i) AS low, max(i) + {LENGTH} AS high FROM run GROUP BY r, k),
gap AS (SELECT r, k, low, high, lag(high, 1, 0) OVER (PARTITION BY r ORDER BY low) AS done FROM span),
cut AS (SELECT r, count(*) AS n_spans, sum(high - low) AS n_removed, max(high) AS done, string_agg(substr(h, 2 * done + 1, 2 * (low - done)), '' ORDER BY low) AS kept FROM gap JOIN d USING (r) GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(done, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
