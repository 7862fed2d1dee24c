"""The echo queries against their SQL on rows that repeat an id, lack one, or fold in odd ways."""

import pytest

NAMES = ("echo_report", "suspicious_echoes", "top_echoes")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    texts = [(1, "in der Straße"), (1, "in der STRASSE"), (1, "in der strasse"), (2, "die ΟΔΟΣ hier"), (2, "ΟΔΟΣΑ"), (None, "Straße"), (None, "İstanbul ﬁn"), (3, "straße und οδος"), (4, None), (5, ""), (6, "istanbul FIN ẞ")]
    texts += [(k, f"plain words {k}") for k in (7, 7, 8, 9, 9, 9)]
    rows = {
        "documents": (texts, "doc_id long, text string"),
        "labels": ([(1, 0), (1, 1), (2, 0), (3, 1), (6, 0), (9, 1)], "doc_id long, quality int"),
        "benchmark": ([(k, t) for k, t in enumerate(["Straße", "strasse", "ΟΔΟΣ", "οδος", "İstanbul", "fin", "ﬁn", "ß", "Plain Words", None])], "item_id long, text string"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_as_in_sql(spark, odd, name):
    import duckdb

    from docgauge.plans import queries

    con = duckdb.connect()
    for table in ("documents", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{odd}/{table}.parquet/*.parquet')")
    want = con.sql(queries.ORACLE[name]).fetchall()
    got = [tuple(r) for r in queries.QUERIES[name](spark, odd).collect()]
    assert want and sorted(map(str, got)) == sorted(map(str, want))


def test_letters_fold_one_by_one(spark):
    from pyspark.sql import functions as F

    from docgauge.functions.text import fold_letters

    df = spark.createDataFrame([("Straße ẞ STRASSE",), ("ΟΔΟΣ ΟΔΟΣΑ ς",), ("İıſK ﬁ Éé",), ("PLAIN",), (None,)], "x string")
    assert [r[0] for r in df.select(fold_letters(F.col("x"))).collect()] == ["straße ß strasse", "οδοσ οδοσα σ", "iisk ﬁ éé", "plain", None]
