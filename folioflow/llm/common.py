"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, so that extra columns can't clash with its own."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share. Only a local master, whose workers are on this machine, may do without a
    configured one; elsewhere that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "folioflow-shared")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ensure_checkpoints(spark: SparkSession) -> None:
    """DataFrame.checkpoint() needs a folder; the session's own setting wins."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def partitions(spark: SparkSession, df: DataFrame | None = None, target: int = 8 << 20, least: int | None = None) -> int:
    """`least` (the session's number of shuffle partitions), or more where the plan's size estimate asks for it. Hand over the table
    itself: after a projection the estimate counts widths of types instead of bytes."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) if least is None else least
    if df is not None:
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        if size < 1 << 55:  # a plan without statistics reports a huge default, or a share of it
            n = max(n, -(-size // target))
    return n


def blocks(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20, rows: int = 256) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts as UTF-8) in runs of about `limit` bytes; a null text is empty, one long text is a run of its own."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            for i, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if size and size + len(t or b"") > limit:
                    yield ids, texts
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t or b"")
                size += len(t or b"") + 1
    if ids:
        yield ids, texts


class WordHashes(dict):
    """word -> 64-bit hash, kept for the words seen; emptied when it grows past `limit` words."""

    def __init__(self, seed: int = 0, limit: int = 400_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
S29, S32 = np.uint64(29), np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> S32)
    x *= C2
    x ^= x >> S29
    x *= C3
    x ^= x >> S32
    return x


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the sequence (a, b)."""
    return mix(a * C1 + b)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:]) if len(x) > span else x[:0]
        span *= 2
    rest = w - span
    return np.minimum(x[:-rest], x[rest:]) if rest and len(x) > rest else x if not rest else x[:0]
