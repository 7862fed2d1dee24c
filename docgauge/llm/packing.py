"""Packing documents into sequences by shortest-pack-first over the histogram of lengths.

A document's ids are cut at multiples of the capacity; what is left over is one shorter piece. The histogram of piece
lengths (at most `capacity` rows) goes to the driver, which places lengths longest first: into the pack with the fewest
tokens in which they fit, else into new packs. Packs of the same lengths are one pattern with a count, so the
work depends on the histogram and not on the number of documents. Patterns then become intervals of ranks: the
pieces of one length are numbered, and the interval that holds a piece's number gives its sequence and offset.

Numbers come from counts by (length, bucket) and a window inside each bucket, so that a length that a third of all
pieces share is numbered in many tasks.

Edge cases: a null text counts as empty and gives one piece, the closing id; the strings of added tokens in a text become
those tokens, as the tokenizers library has it; rows that repeat an id are packed each
for itself; an empty table gives an empty result; columns beyond id and text are not read.
"""

from __future__ import annotations

import heapq
import itertools
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgauge.llm.byte_bpe import GENERAL, Memo, built, splitter
from docgauge.llm.common import documents, in_arrow, materialise, ship, shuffle_width

CAPACITY, CLOSING_ID = 1024, 0


def _byte_letters() -> str:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, then letters from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = itertools.count(256)
    return "".join(chr(byte if byte in plain else next(spare)) for byte in range(256))


def tokenizer(raw: bytes, pattern: str):
    """A function from text to packed ids, by the tokenizers library.

    Each match of the pattern that is not in the memo goes to the library's model. Texts that hold an added token's string,
    and vocabularies with another way of splitting, go to the library whole.
    """
    from tokenizers import Tokenizer

    own, said = Tokenizer.from_str(raw.decode("utf-8")), json.loads(raw)
    pack_ids = lambda ids: struct.pack(f"<{len(ids)}I", *ids)
    whole = lambda text: pack_ids(own.encode(text, add_special_tokens=False).ids)
    way = said.get("pre_tokenizer") or {}
    if said.get("normalizer") or pattern != GENERAL or (way.get("type"), way.get("add_prefix_space"), way.get("use_regex", True)) != ("ByteLevel", False, True):
        return whole
    letters, one = _byte_letters(), own.model.tokenize
    memo = Memo(lambda piece: [t.id for t in one(piece.encode("utf-8").decode("latin-1").translate(letters))])
    added = [t["content"] for t in said.get("added_tokens") or []]
    split = splitter(pattern)
    return lambda text: whole(text) if any(a in text for a in added) else b"".join(map(memo.__getitem__, split(text)))


def pieces(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Pieces of at most `capacity` ids of each document, with its closing id: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids."""
    with open(vocabulary, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    fields = [T.StructField("doc_id", kind), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")), *[T.StructField("ids", T.BinaryType())] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = built("tokenizer " + pattern, sent.value, lambda raw: tokenizer(raw, pattern))
        step, end = 4 * capacity, CLOSING_ID.to_bytes(4, "little")
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part, rows, cuts = batch.slice(k, 512), [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    raw = of(text or "") + end
                    for at in range(0, len(raw), step):
                        cut = raw[at : at + step]
                        rows.append((row, at // 4, len(cut) // 4, zlib.crc32(cut), len(raw) // 4))
                        if with_ids:
                            cuts.append(cut)
                place, *numbers = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
                columns = [part.column(0).take(place), *numbers, *[pa.array(cuts, pa.binary())] * with_ids]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return in_arrow(docs.select(F.col(id_col), F.col(text_col)), run, T.StructType(fields))


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (count, lengths in order) that hold each length as often as the histogram has it."""
    packs: dict[tuple[int, ...], int] = {}
    shortest: list[tuple[int, tuple[int, ...]]] = []  # heap of (tokens, lengths); a pattern may stand there after its count is used up
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(lengths: tuple[int, ...], count: int) -> None:
        total = sum(lengths)
        if total >= capacity:
            done.append((count, lengths))
        elif lengths in packs:
            packs[lengths] += count
        else:
            packs[lengths] = count
            heapq.heappush(shortest, (total, lengths))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if shortest and shortest[0][0] + length <= capacity:
                lengths = heapq.heappop(shortest)[1]
                count = packs.pop(lengths)
                used = min(count, left)
                if count > used:
                    put(lengths, count - used)
                put((*lengths, length), used)
                left -= used
            else:
                put((length,), left)
                left = 0
    return done + [(n, lengths) for lengths, n in packs.items() if n]


def intervals(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
    """For each length the intervals (first rank, rank after the last, sequence of the first, offset)."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    base = 0
    for count, lengths in sorted(patterns, key=lambda p: (-sum(p[1]), p[1])):
        offset = 0
        for length in lengths:
            first = ranks.get(length, 0)
            out.setdefault(length, []).append((first, first + count, base, offset))
            ranks[length] = first + count
            offset += length
        base += count
    return sorted(out.items())


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset. cut: from pieces(), written once, since it is read for the histogram and for the result."""
    spark = cut.sparkSession
    width = shuffle_width(cut)
    cut = cut.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(width)).cast("int"))
    counts = cut.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = intervals(shortest_pack_first(histogram, capacity))
    kind = "length long, slots array<struct<first:long,after:long,sequence:long,offset:long>>"
    table = spark.createDataFrame(slots, kind)
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("length", "__bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("__rank", F.row_number().over(inside) - 1).join(bases, ["length", "__bucket"]).withColumn("__rank", F.col("__rank") + F.col("__base"))
    slot = F.get(F.filter("slots", lambda s: (s["first"] <= F.col("__rank")) & (F.col("__rank") < s["after"])), F.lit(0))
    placed = ranked.join(table, "length").withColumn("__slot", slot)
    own = [c for c in cut.columns if c != "__bucket"]
    return placed.select(*own, (F.col("__slot.sequence") + F.col("__rank") - F.col("__slot.first")).alias("sequence_id"), F.col("__slot.offset").alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    cut = pieces(docs, vocabulary, pattern, id_col, text_col, capacity, with_ids)
    return pack(materialise(cut, "pieces"), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, with_ids=False)
