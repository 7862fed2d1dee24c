"""Keys of many texts at once against hashlib, and the orders that are made of them against plain Python."""

import hashlib
import random

import pyarrow as pa
import pytest

from docgauge.functions.digests import keys_of
from docgauge.operators import selective

CASES = "run string, case_id string, confidence double, from_field boolean, n long, correct long, hallucinated long, ok int"


def test_keys_are_md5():
    ids = ["cut off", "a", "", None, "é" * 10, "x" * 42, "x" * 43, "x" * 44, "x" * 200, *[f"{i:010d}" for i in range(9000)]]
    for prefix in ("20260807|7", "20260807|123"):
        for text, high, low in zip(ids[1:], *keys_of()(prefix, pa.array(ids)[1:]), strict=True):
            assert f"{high:016x}{low:016x}" == hashlib.md5((prefix if text is None else f"{prefix}|{text}").encode()).hexdigest()


def confident(spark):
    dice = random.Random(9)
    rows = [(run, f"c{i}", dice.random(), False, 1, 1, 0, dice.choice([0, 1, 1])) for run, n in (("r", 700), ("s", 90)) for i in range(n)]
    return rows, spark.createDataFrame(rows, CASES)


def test_random_orders_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(selective, "ORDERED", 16)  # of small buckets, many
    monkeypatch.setattr(selective, "HASHED", 50)
    rows, df = confident(spark)
    got = {r["run"]: r["random_aurc"] for r in selective.random_aurc(df, 3).collect()}
    for run in "rs":
        areas = []
        for trial in range(3):
            order = sorted((x for x in rows if x[0] == run), key=lambda x: hashlib.md5(f"{selective.SEED}|{trial}|{x[1]}".encode()).hexdigest())  # noqa: B023
            right, risk = 0, 0.0
            for k, x in enumerate(order, 1):
                right += x[7]
                risk += 1 - right / k
            areas.append(risk / len(order))
        assert got[run] == pytest.approx(sum(areas) / 3, abs=1e-12)
    assert selective.random_aurc(df.where("run = 't'")).count() == 0


def test_no_row_for_each_case_and_split_is_shuffled(spark, capsys):
    _, df = confident(spark)
    for made in (selective.random_aurc(df), selective.holdout(df, 0.7, 20)):
        assert "Generate explode" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_windows_that_miss_the_middle_are_widened(spark):
    rows = [("r", "same", 0.5, False, 1, 1, 0, 1)] * 60 + [("r", f"c{i}", 0.1, False, 1, 1, 0, 0) for i in range(5)]
    got = selective._cuts(spark.createDataFrame(rows, CASES).select("run", "case_id"), {"r": 65}, 2, selective.SEED)
    for split in range(2):
        keys = sorted(hashlib.md5(f"{selective.SEED}|{split}|{x[1]}".encode()).hexdigest() for x in rows)
        assert "{:016x}{:016x}".format(*got["r", split]) == keys[31]
