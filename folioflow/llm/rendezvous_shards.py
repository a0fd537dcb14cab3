"""Rendezvous hashing of stable record keys over weighted shards.

Each record goes to the shard with the largest score -weight / ln(u), where u is a hash of record key and shard in (0, 1); so
one more shard takes records only into itself, a removed one gives away only its own, and shards fill by weight. The hash is
the first 52 bits of MD5 of "key:shard", which any engine can repeat.

Slots number the rows of a shard without gaps. A window over a shard would put 1/24 of all rows into one task, so each shard is
cut into blocks by another hash of the row, `BLOCKS` or as many as make a block of `BLOCK_BYTES` of input; blocks are counted,
their offsets come from a running sum over that table (a row for each block), and rows are numbered inside their block.

Defined results: a null key hashes as the text "null"; a null text has 0 bytes and CRC 0; repeated rows share a shard and get a
slot each; very long texts only count their bytes; an empty table gives an empty table; extra columns are ignored (`assign` raises
ValueError where a column of the new name exists, `with_slots` keeps them whatever their names).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions

SHARDS, BLOCKS, BLOCK_BYTES = 24, 64, 64 << 20


def unit(key: Column, salt: str) -> Column:
    """52 bits of a hash of key and salt, as a long."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{salt}")).cast("binary")), 1, 13), 16, 10).cast("long")


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the best score; ties go to the lower shard. Weights are positive."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    equal = len(set(weights)) == 1
    options = []
    for n, weight in enumerate(weights):
        u = unit(key, str(n))
        score = u.cast("double") if equal else -F.lit(float(weight)) / F.log((u.cast("double") + 0.5) / float(1 << 52))
        options.append(F.struct(score.alias("score"), F.lit(-n).alias("back")))
    return (-F.greatest(*options)["back"]).cast("int") if len(options) > 1 else F.lit(0)


def assign(df: DataFrame, key_col: str, shards: int = SHARDS, weights: Sequence[float] | None = None, name: str = "shard") -> DataFrame:
    """The rows with their shard."""
    if name in df.columns:
        raise ValueError(f"a column {name} exists")
    key = F.coalesce(F.col(key_col).cast("string"), F.lit("null"))
    return df.withColumn(name, shard_of(key, weights or [1.0] * shards))


def with_slots(df: DataFrame, order: list[str], shard: str = "shard", blocks: int = BLOCKS) -> DataFrame:
    """Adds `slot`, gapless from 0 in each shard; equal rows in any order."""
    cut = df.select(F.struct("*").alias("row"), F.col(shard).alias("shard"), F.struct(*order).alias("by"), F.pmod(F.xxhash64(*order), F.lit(blocks)).alias("block"))
    counts = cut.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(W.partitionBy("shard", "block").orderBy("by")) - 1
    rows = cut.withColumn("inside", inside)
    # shards x blocks rows: a row for each BLOCK_BYTES of input, or shards x BLOCKS
    return rows.join(F.broadcast(offsets), ["shard", "block"]).select("row.*", (F.col("offset") + F.col("inside")).alias("slot"))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    text = F.col(text_col).cast("string").cast("binary")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = assign(assign(rows, "doc_id", shards), "doc_id", shards + 1, name="grown_shard")
    blocks = max(BLOCKS, -(-partitions(docs.sparkSession, docs, BLOCK_BYTES, least=1) // shards))
    out = with_slots(rows, ["doc_id", "size", "text_crc32"], blocks=blocks)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
