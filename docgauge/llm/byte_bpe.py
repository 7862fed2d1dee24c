"""Byte-level BPE: encoding and decoding of whole texts.

Encoding maps the bytes of each match of the pattern to Latin-1, finds all vocabulary entries in it with one
Aho-Corasick pass, and walks from the longest match at each place. A step is allowed if the two adjacent tokens are
compatible: encoding their joined bytes gives just the two. Compatibility is worked out once for a pair by
merging and then memoised; a sequence whose neighbours are all compatible is the one that merging in order of
rank would reach. A place from which the walk fails is never entered again, so time is linear in the text.

The vocabulary travels as a broadcast of its file's bytes (about 1 MB); each Python worker builds its tables once.
Memos are bounded: when one is full it becomes the older generation, from which pieces that occur again are taken back.

Edge cases: a null text counts as empty and gives no ids; ids that are not in the vocabulary fail on decoding;
columns of the input stay as they are, those to be added must not be there yet.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgauge.llm.common import documents, ship

#: Entries in each of a memo's two generations; longer pieces are never kept.
MEMO, MEMO_PIECE = 120_000, 48
_INF = 1 << 62


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: a token in base 64 and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


class Encoder:
    """Encodes single pieces (matches of the pattern) by ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.trie = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.trie.add_word(token.decode("latin-1"), (i, len(token)))
        self.trie.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}

    def merged(self, raw: bytes) -> list[int]:
        """Merging in order of rank, for short strings: what defines the encoding."""
        ranks, parts = self.ranks, [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best, at = min((ranks.get(parts[i] + parts[i + 1], _INF), i) for i in range(len(parts) - 1))
            if best == _INF:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def reachable(self, token: int) -> bool:
        """Whether merging ever makes this token; the others occur only as whole pieces."""
        if token not in self.whole:
            self.whole[token] = self.merged(self.tokens[token]) == [token]
        return self.whole[token]

    def compatible(self, left: int, right: int) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= 2 * MEMO:
                self.pairs.clear()
            found = self.pairs[left, right] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return found

    def encode(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        n = len(piece)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, found in self.trie.iter(piece.decode("latin-1")):
            starts[end - found[1] + 1].append(found)  # by start, shortest first
        dead, path, cursor, at = bytearray(n + 1), [], [], 0
        fresh = True
        while at < n:
            here = starts[at]
            k = len(here) - 1 if fresh else cursor.pop() - 1
            last = path[-1][0] if path else -1
            while k >= 0:
                token, size = here[k]
                if not dead[at + size] and self.reachable(token) and (last < 0 or self.compatible(last, token)):
                    break
                k -= 1
            if k >= 0:
                path.append(here[k])
                cursor.append(k)
                at, fresh = at + here[k][1], True
            else:
                dead[at] = 1
                at -= path.pop()[1]
                fresh = False
        return [t for t, _ in path]


class Memo(dict):
    """Piece to its ids as little-endian unsigned 32-bit integers, in two generations: what is looked up stays."""

    def __init__(self, encode):
        super().__init__()
        self.of, self.older = encode, {}

    def __missing__(self, piece: str) -> bytes:
        raw = self.older.get(piece)
        if raw is None:
            ids = self.of(piece)
            raw = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= MEMO_PIECE:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[piece] = raw
        return raw


_BUILT: dict[tuple, object] = {}


def built(kind: str, raw: bytes, make):
    """make(raw), once in each Python worker."""
    key = (kind, hashlib.sha256(raw).digest())
    if key not in _BUILT:
        _BUILT[key] = make(raw)
    return _BUILT[key]


# The pattern that most byte-level vocabularies split by, and what its classes are among LATIN characters.
GENERAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN = r"\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u024f"
LATIN_LETTERS, LATIN_SPACE = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"\t\n\x0b\x0c\r "


def splitter(pattern: str):
    """A function from text to the matches of the pattern. Texts of LATIN characters alone are split by the standard
    library, with the general pattern's classes written out: the same matches in half the time."""
    import regex

    split = regex.compile(pattern).findall
    if pattern != GENERAL:
        return split
    w, s = LATIN_LETTERS, LATIN_SPACE
    latin = re.compile(rf" ?(?:[{w}]+|[0-9]+)|'(?:[stmd]|re|ve|ll)| ?[^{s}{w}0-9]+|[{s}]+(?![^{s}])|[{s}]+").findall
    other = re.compile(rf"[^{LATIN}]").search
    return lambda text: split(text) if other(text) else latin(text)


def encoder(raw: bytes, pattern: str):
    """A function from text to packed ids."""
    tokens = Encoder(read_ranks(raw))
    memo = Memo(lambda piece: tokens.encode(piece.encode("utf-8")))
    split = splitter(pattern)
    return lambda text: b"".join(map(memo.__getitem__, split(text)))


def with_column(df: DataFrame, name: str, kind: T.DataType, make, source: str) -> DataFrame:
    """df and a column of make()(value of source), by Arrow batches."""
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    ship(df.sparkSession)
    at = df.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                new = pa.array([of(x) for x in part.column(at).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, new], names=[*part.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, kind)]))


def encode(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """df and the ids of its texts, packed as little-endian unsigned 32-bit integers; special tokens are ordinary text."""
    with open(vocabulary, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())

    def make():
        of = built("encoder " + pattern, sent.value, lambda raw: encoder(raw, pattern))
        return lambda text: of(text or "")

    return with_column(df, into, T.BinaryType(), make, text_col)


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """df and the bytes that its packed ids stand for."""
    with open(vocabulary, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())

    def make():
        import numpy as np

        table = built("decoder", sent.value, lambda raw: {i: t for t, i in read_ranks(raw).items()})
        return lambda ids: b"".join(map(table.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))

    return with_column(df, into, T.BinaryType(), make, ids_col)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = encode(documents(spark, sf_dir).select("doc_id", "text"), path, public_tokenizers.PATTERN)
    both = decode(ids.select("doc_id", "ids"), path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
