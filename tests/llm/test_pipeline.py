"""The pipeline's stages on small rows, each against a plain version of what it decides."""

import random

import numpy as np

import corpus_pipeline
from tests.llm.test_operators import DOCS, linked, vocabulary, words


def test_stages(spark, tmp_path):
    dice = random.Random(9)
    made = []
    for i in range(120):
        text = words(dice, 80) + "." if i % 4 else "!!! $$$ ### " * 30
        made.append((i, text))
    made += [(200 + i, made[i][1]) for i in range(1, 40)]  # exact copies
    made += [(300 + i, made[i][1] + " one more") for i in range(1, 30) if i % 4]  # near copies
    made += [(400, words(dice, 80) + ' password = "hunter2hunter2" end.')]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in made], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    texts, now, seen = dict(made), docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        seen.append({r["doc_id"]: r["text"] for r in now.collect()})
        now = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in seen[-1].items()], DOCS)
    good, exact, near, clean = seen
    assert set(good) == {i for i, t in texts.items() if "$$$" not in t}
    assert set(exact) == {max(j for j in good if good[j] == t) for t in good.values()}
    groups = linked(exact, 5, 80)
    assert set(near) == {g for _, g in groups.values()}
    assert clean[400].endswith('[secret]" end.') and all(clean[i] == near[i] for i in near if i != 400)
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary().path("byte_bpe_50k.json"))
    assert {p["doc_id"]: p["doc_tokens"] for p in pieces} == {i: len(own.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean.items()}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert np.sum([p["length"] for p in whole]) == np.sum([p["length"] for p in pieces])


def test_stages_on_empty_tables_and_odd_rows(spark, tmp_path):
    kind = DOCS + ", row string, digests string, lost_id string, spans string"
    made = [(1, None), (2, ""), (3, None), (4, "x"), (4, "y"), (None, "z z z")]
    odd = spark.createDataFrame([(i, t, None, None, 0, "r", "d", "l", "s") for i, t in made], kind)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, odd.limit(0)):
        now, n = docs, docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == docs.columns, name
            now = spark.createDataFrame(now.collect(), docs.schema)
        left = sorted(((r["doc_id"], r["text"]) for r in now.collect()), key=str)
        assert left == (sorted([(3, None), (4, "x"), (4, "y"), (None, "z z z")], key=str) if n else [])
        pieces = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
        assert sorted(p["doc_tokens"] for p in pieces) == ([1, 2, 2, 4] if n else [])


def test_packed_pieces_hold_their_ids(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary().path("byte_bpe_50k.json"))
    dice = random.Random(10)
    texts = {i: words(dice, n) for i, n in enumerate((3, 50, 4000))}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], DOCS)
    pieces = sorted(corpus_pipeline.STAGES[-1][1](spark, docs, "").collect(), key=lambda p: (p["doc_id"], p["start"]))
    for i, text in texts.items():
        ids = np.frombuffer(b"".join(bytes(p["ids"]) for p in pieces if p["doc_id"] == i), "<u4").tolist()
        assert ids == [*own.encode(text, add_special_tokens=False).ids, 0]


def test_tasks_give_back_memory(spark, monkeypatch):
    import re
    from pathlib import Path

    import public_tokenizers
    import pyarrow as pa

    from docgauge.llm import jaccard_join, packing, quality_model

    def anonymous() -> float:
        return sum(map(int, re.findall(r"\nAnonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    both = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a b c d e f g"]})
    runs = [
        (jaccard_join.sets(docs, 5, 80), both),
        (jaccard_join._postings(docs, 5, 80, 4), both.select(["text"])),
        (quality_model.with_statistics(docs), both),
        (packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN), both),
    ]
    for run, batch in runs:
        list(run(iter([batch])))  # what stays, such as the vocabulary, is there from now on
        blocks = [bytearray(b"x") * 100_000 for _ in range(2000)]
        del blocks[::2]  # 100 MB in holes, which the C library keeps
        before = anonymous()
        list(run(iter([batch])))
        assert anonymous() < before - 50
