"""Exact duplicates by deterministic block naming, in DataFrame functions only.

Every text is cut into blocks of BLOCK_BYTES UTF-8 bytes. The distinct blocks are sorted, and a block's place in that
order is its integer name; neighbouring names are then sorted and named in pairs, again and again, until one name
stands for the text. A text's identity is its number of levels and its last name.

The order is that of SHA-256 digests. Blocks that have one digest are compared by their bytes first, on the whole input: all
distinct blocks come together by (digest, bytes), and two blocks under one digest would be an error (no such pair of
strings is known). After this proof only digests travel, 32 bytes for 4096: they are dealt out by range and sorted, and
a name is the range's offset (its number, shifted by 33 bits) plus the place inside. Names are written, and handed back by joins on
digests and on pairs of names; texts cross the network once, and copies are merged before that.

Edge cases: a null text counts as empty; an empty text has one empty block; an empty table gives an empty result;
a null id never wins against another id, and a group of null ids only keeps its rows; rows that repeat an id and
text are all marked alike; other columns are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge.llm.common import documents, materialise, sized, unwrapped, wrapped

#: Bytes in a block.
BLOCK_BYTES = 4096
#: What stands for the missing right neighbour of a last name; names are never negative.
NOTHING = -1


def _blocks(text: Column, block_bytes: int) -> Column:
    raw = text.cast("binary")
    last = F.greatest(F.lit(0), F.ceil(F.octet_length(raw) / F.lit(block_bytes)).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * block_bytes + 1, F.lit(block_bytes)))


def _digest(block: Column) -> Column:
    return F.unhex(F.sha2(block, 256))


def _digests(text: Column, block_bytes: int) -> Column:
    return F.transform(_blocks(F.coalesce(text, F.lit("")), block_bytes), _digest)


def _sorted_names(distinct: DataFrame, by: list[str], name: str) -> DataFrame:
    """Rows without repeats, and their places in the order of `by`: written, since a name must not change once it is given."""
    ordered = distinct.repartitionByRange(*by).sortWithinPartitions(*by)
    return materialise(ordered.withColumn("name", F.monotonically_increasing_id()), name)


def _block_names(texts: DataFrame, block_bytes: int) -> DataFrame:
    """digest, name of each distinct block of `text`."""
    blocks = texts.select(F.explode(_blocks(F.coalesce("text", F.lit("")), block_bytes)).alias("content"))
    distinct = blocks.select(_digest(F.col("content")).alias("digest"), "content").distinct()
    names = _sorted_names(distinct.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")), ["digest"], "block-names")
    if names.where("contents > 1").take(1):
        raise RuntimeError("two different blocks have one SHA-256 digest")
    return names.select("digest", "name")


def identities(texts: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """digests (of a text's blocks), levels, name: a row for each distinct block and each distinct longer text of the column `text`.

    Each round halves the names of a text, so there are as many as the longest text has levels.
    """
    names = _block_names(texts, block_bytes)
    out = names.select(F.array("digest").alias("digests"), F.lit(0).alias("levels"), "name")
    longer = texts.select(_digests(F.col("text"), block_bytes).alias("digests")).where(F.size("digests") > 1).distinct()
    longer = materialise(longer.withColumn("sequence", F.monotonically_increasing_id()), "sequences")
    most = longer.agg(F.max(F.size("digests"))).first()[0]
    if not most:
        return out
    at = longer.select("sequence", F.size("digests").alias("left"), F.posexplode("digests").alias("place", "digest"))
    at = materialise(at.join(names, "digest").select("sequence", "left", "place", "name"), "names")
    ends = None
    for level in range(1, (most - 1).bit_length() + 1):
        side = lambda k: F.max(F.when(F.col("place") % 2 == k, F.col("name")))
        pairs = at.groupBy("sequence", "left", F.floor(F.col("place") / 2).cast("int").alias("half")).agg(side(0).alias("first"), F.coalesce(side(1), F.lit(NOTHING)).alias("second"))
        named = _sorted_names(pairs.select("first", "second").distinct(), ["first", "second"], f"pair-names-{level}")
        left = F.ceil(F.col("left") / 2).cast("int")
        at = materialise(pairs.join(named, ["first", "second"]).select("sequence", left.alias("left"), F.col("half").alias("place"), "name"), f"names-{level}")
        done = at.where("left = 1").select("sequence", F.lit(level).alias("levels"), "name")
        ends = done if ends is None else ends.unionByName(done)
        at = at.where("left > 1")
    return out.unionByName(longer.join(ends, "sequence").select("digests", "levels", "name"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each row of docs: id_col, levels, name (of the text's identity), keep_id (largest id among equal texts), group_size, kept, text_sha256.

    Copies are counted before the shuffle; the joins that hand names and counts back have an exchange on each side, so that
    Spark splits a group which holds a large share of all rows.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keyed = own.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), _digests(F.col("text"), block_bytes).alias("digests"))
    named = materialise(keyed.join(identities(own, block_bytes), "digests").drop("digests"), "identities")
    sizes = named.groupBy("levels", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # The join has a key of its own: on the key that the counts are already dealt by, Spark would not split a large group.
    whole = F.concat_ws(":", "levels", "name").alias("identity")
    joined = named.select("*", whole).join(sizes.select(whole, "keep_id", "group_size"), "identity")
    return joined.select(F.col("doc_id").alias(id_col), "levels", "name", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows of which an equal text with a larger id is there; same columns.

    What is joined to the texts is a table of the copied texts' identities alone, written first so that its size is known: it
    is broadcast up to a fixed size, and both sides are shuffled beyond.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = own.groupBy(_digests(F.col("text"), BLOCK_BYTES).alias("digests")).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    named = found.join(identities(own), "digests")
    copied = named.groupBy("levels", "name").agg(F.max("digests").alias("copied"), F.max("keep_id").alias("keep_id"), F.sum("n").alias("n")).where("n > 1")
    copied = sized(materialise(copied.select("copied", "keep_id"), "copied"))
    keyed = wrapped(docs, own_id=F.col(id_col), digests=_digests(F.col(text_col), BLOCK_BYTES))
    joined = keyed.join(copied, F.col("digests") == F.col("copied"), "left")
    return unwrapped(joined.where(F.col("copied").isNull() | F.col("own_id").eqNullSafe(F.col("keep_id"))))


def query(spark, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
