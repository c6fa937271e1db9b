"""Shared helpers: column selection, reliable checkpoints and per-worker caches."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that one step of a Python operator handles at a time; a longer single text is a step of its own.
STEP_CHARS = 4_000_000
#: Rows whose texts a Python operator holds at a time, where Arrow batches are larger.
ROWS_A_STEP = 1_000
#: Rows of numbers that a broadcast may have: about 20 MB.
MOST_BROADCAST = 500_000
#: Rows that a partition of a checkpoint should have at least: each partition is a file, and each later stage has a task for it.
ROWS_A_PART = 5_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster names in spark.checkpoint.dir.

    With a number of rows, about how many df has, few rows are put into few partitions. Only where that setting is absent and
    no folder was set otherwise (a local test session) is a folder of its own made.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pagemill-checkpoint-"))
    return (df if rows is None else df.coalesce(max(1, -(-rows // ROWS_A_PART)))).checkpoint(eager=True)


def release(*frames: DataFrame) -> None:
    """Delete the checkpoints of frames that durable() gave and that only results already durable themselves were made of."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        found = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if found.isDefined():
            folder = sc._jvm.org.apache.hadoop.fs.Path(found.get())
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def small(df: DataFrame) -> DataFrame:
    """df, a frame of few numbers a row, for the broadcast side of a join if it is counted to be small; else as it is, to be shuffled."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name += "_"
    return name


def steps(texts: list[str], limit: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most `limit` characters together, or of one longer text."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows, ROWS_A_STEP at most in a batch."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS_A_STEP):
            yield batch.slice(a, ROWS_A_STEP)


def small_batches(spark: SparkSession, rows: int = ROWS_A_STEP) -> None:
    """From now on Arrow batches of the session have that many rows at most, for frames already made too.

    With Spark's 10 000 a task's batch of texts is tens of MB, held beside the heap and doubled whenever its buffer grows, and
    once more in Python. Execution reads the setting, so it can't be put back once a lazy frame is returned.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def rows_of(batch: pa.RecordBatch, text: int = 1) -> list[str]:
    """The texts of a batch; null reads as empty."""
    return [t or "" for t in batch.column(text).to_pylist()]


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array | pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def id_remainder(column: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null ids have no remainder."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(n))


_HELD: dict = {}


def held(key: tuple, make: Callable[[], object]):
    """What make() gives, kept in this worker until another key is asked for, so that only one operator's tables are held."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def bounded_cache(cache: dict, most: int) -> None:
    """Empty a worker's cache once it holds more than `most` entries."""
    if len(cache) > most:
        cache.clear()


def ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, ..., c-1 for each count c, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def keep_rows(df: DataFrame, text_col: str, keep: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows of df, all columns as they are, for which keep() of their texts says so."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            yield batch.filter(pa.array(keep(batch.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)
