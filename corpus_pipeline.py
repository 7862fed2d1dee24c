"""A corpus pipeline of five stages; each reads the Parquet table that its predecessor wrote.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs. All but the last return rows with the columns of
documents: rejected documents, exact copies, and all but one document of each group of near copies are gone, and
secrets are put out of the texts. The last returns the pieces of the packed sequences. A stage's near copies share five-word
n-grams with a similarity of 0.8 or more.

Edge cases: null and empty texts go through every stage as empty ones (the classifier scores them, all of one kind are one
exact copy group, the last stage gives them a piece of one id); rows that repeat an id are kept or dropped together by the
near-copy stage and each for itself by the others; an empty table gives an empty result; further columns of documents,
whatever their names, reach all stages but the last.
"""

from __future__ import annotations

from docgauge.llm import exact_dedup, jaccard_join, packing, quality_model, secrets
from docgauge.llm.common import materialise


def quality(spark, docs, sf_dir):
    return quality_model.select_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark, docs, sf_dir):
    return exact_dedup.deduplicate(docs)


def near(spark, docs, sf_dir):
    return jaccard_join.deduplicate(docs)


def scan_secrets(spark, docs, sf_dir):
    return secrets.redact(docs)


def pack(spark, docs, sf_dir):
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("secret scans", scan_secrets), ("packing", pack)]

#: The classifier and the tokenizer are beyond SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
