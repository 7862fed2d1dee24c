"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes in an Arrow batch between Spark and Python.
ARROW_BYTES = 4 << 20
# The white space that ends a word.
WORD_SPACE = r"[\x20\x09-\x0D]"
#: A-Z and a-z, for lower-casing that leaves every other letter alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset, one of our own on a single machine; on a cluster that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="docgauge-")
        shared_dir.own = found
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a narrow table (a few numbers each) that are broadcast at most; some tens of MB on an executor.
BROADCAST_ROWS = 1_000_000


def sized(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has at most BROADCAST_ROWS rows; beyond that a join shuffles both sides."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def wrapped(df: DataFrame, **more: Column) -> DataFrame:
    """A struct `row` of df's columns, and columns of our own beside it: whatever df's are called, no two clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in more.items()])


def unwrapped(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def held(column: str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Hands memory that this process has freed back to the system, where the C library can; else it keeps its peak for good."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema) whose tasks give back what they freed: Python workers live on, beside the next stage's JVM memory."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(work, schema)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each context, so that they can import it wherever they run."""
    context = spark.sparkContext
    # Batches are bounded by bytes as well as rows: texts can be long.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    if getattr(context, "_docgauge_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="docgauge-")) / "docgauge.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    context._docgauge_shipped = True
