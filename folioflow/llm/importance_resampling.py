"""Quality classifier by importance resampling over hashed n-gram models.

Words and pairs of words (lower case) are hashed into `buckets` each. Two generative models are counted: the raw one over all
documents, the target one over labelled good documents. A bucket's log ratio is log((t + 1) / (e + 1)), t being its target count
and e the count that the raw model expects in as many n-grams; where t lies within `spread` deviations of e, the models are not
told apart and the log ratio is 0. A document's log importance is the sum of its n-grams' log ratios over the square root of its
number of words, so that the noise of long texts, which grows with that root, doesn't outweigh what is said in them.

Selection is Gumbel top-k: keys log importance / temperature + Gumbel noise (from a hash of the id), of which the k largest are
kept; this samples k documents without replacement with chances in proportion to importance ** (1 / temperature). k is `share` of
all rows, by default the share of good ones among the labelled. The k-th largest key is found by counting keys in ever narrower
ranges.

`fit_rows` bounds the labelled rows (the lowest hashes of their ids) that make the target model and the default share; raw counts
and scores cover all documents. Defined results: a null or empty text has log importance 0; a null id hashes as 0; repeated rows
are kept or dropped alike; keys equal to the k-th are all kept, so there can be more than k; a document labelled several times
counts once and is good if all its labels say so; labels with nulls are ignored; very long texts are summed whole; an empty table
gives an empty table; without labels of good documents nothing is rejected. Extra columns are ignored (`keep_good` returns them,
whatever their names).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, blocks, ensure_checkpoints, id_text, pair_hash

CHUNKS = 32
SEED = 20_240_229


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 20
    spread: float = 4.0
    fit_rows: int = 50_000
    temperature: float = 0.1
    share: float | None = None  # of all rows that are kept; None: the share of good ones among the labelled


_HASHES: list[WordHashes] = []


def features(text: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of the pairs of words."""
    if not _HASHES:
        _HASHES.append(WordHashes(1))
    h = _HASHES[0].of(text.lower().split())
    m = np.uint64(buckets - 1)
    return (h & m).astype(np.int64), (pair_hash(h[:-1], h[1:]) & m).astype(np.int64) if len(h) > 1 else np.zeros(0, np.int64)


def labelled(labels: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, good), one row for each id, `fit_rows` at most."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    rows = rows.where("doc_id is not null and good is not null").groupBy("doc_id").agg(F.min("good").alias("good"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.fit_rows)


def counts(rows: DataFrame, settings: Settings) -> np.ndarray:
    """[order, raw or target, bucket], from rows (doc_id, text, good)."""
    buckets, step = settings.buckets, settings.buckets // CHUNKS
    fan = max(2, int(rows.rdd.getNumPartitions() ** 0.5) + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen = np.zeros((2, 2, buckets), np.int64)

        def good() -> Iterator[pa.RecordBatch]:
            for b in batches:
                flags.extend(b.column(2).to_pylist())
                yield b

        flags: list = []
        done = 0
        for ids, texts in blocks(good()):
            found = [features(t, buckets) for t in texts]
            for order in (0, 1):
                np.add.at(seen[order, 0], np.concatenate([f[order] for f in found]), 1)
                target = [f[order] for k, f in enumerate(found) if flags[done + k]]
                if target:
                    np.add.at(seen[order, 1], np.concatenate(target), 1)
            done += len(ids)
        if done:
            yield packed(seen.reshape(4, CHUNKS, step), TaskContext.get().partitionId() % fan)

    def packed(seen: np.ndarray, part: int) -> pa.RecordBatch:
        z = zstandard.ZstdCompressor(level=1)
        return pa.RecordBatch.from_pydict({"chunk": pa.array(range(CHUNKS), pa.int32()), "part": pa.array([part] * CHUNKS, pa.int32()), "blob": [z.compress(np.ascontiguousarray(seen[:, c]).tobytes()) for c in range(CHUNKS)]})

    def add(group: pa.Table) -> pa.Table:
        z = zstandard.ZstdDecompressor()
        total = sum(np.frombuffer(z.decompress(b), np.int64) for b in group.column("blob").to_pylist())
        return pa.Table.from_pydict({"chunk": group.column("chunk")[:1], "part": group.column("part")[:1], "blob": [zstandard.ZstdCompressor(level=1).compress(total.tobytes())]})

    kind = "chunk int, part int, blob binary"
    some = rows.mapInArrow(count, kind).groupBy("chunk", "part").applyInArrow(add, kind).groupBy("chunk").applyInArrow(add, kind)
    out = np.zeros((4, CHUNKS, step), np.int64)
    for r in some.collect():  # CHUNKS rows, 32 bytes a bucket before compression
        out[:, r.chunk] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r.blob)), np.int64).reshape(4, step)
    return out.reshape(2, 2, buckets)


def log_ratios(seen: np.ndarray, spread: float) -> np.ndarray:
    """[order, bucket] as float32: target over raw, 0 where the two are not told apart."""
    out = []
    for raw, target in seen.astype(float):
        expected = raw * (target.sum() / max(raw.sum(), 1))
        ratio = np.log((target + 1) / (expected + 1))
        ratio[np.abs(target - expected) < spread * np.sqrt(expected + 1)] = 0
        out.append(ratio)
    return np.array(out, np.float32)


def log_importance(texts: list[bytes], ratios: np.ndarray) -> np.ndarray:
    out = np.zeros(len(texts))
    for k, t in enumerate(texts):
        found = features(t, ratios.shape[1])
        out[k] = sum(ratios[order][f].sum(dtype=float) for order, f in enumerate(found)) / max(1, len(found[0])) ** 0.5
    return out


@dataclass(frozen=True)
class Model:
    ratios: np.ndarray
    share: float  # of all rows that are kept


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """docs: (doc_id, text)."""
    known = labelled(labels, settings)
    n, good = known.agg(F.count("*"), F.count_if("good")).first()
    share = settings.share if settings.share is not None else good / n if good else 1.0
    if not good:
        return Model(np.zeros((2, settings.buckets), np.float32), share)
    rows = docs.join(F.broadcast(known), "doc_id", "left").select("doc_id", "text", "good")  # fit_rows rows of two numbers at most
    return Model(log_ratios(counts(rows, settings), settings.spread), share)


def importance(model: Model, docs: DataFrame, text: Column) -> Column:
    sent = docs.sparkSession.sparkContext.broadcast(model.ratios)  # 8 bytes a bucket

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(log_importance([(t or "").encode() for t in texts], sent.value))

    return of(text)


def gumbel_key(weight: Column, doc_id: Column, temperature: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.coalesce(doc_id.cast("long"), F.lit(0)), F.lit(SEED)), 12)
    u = (bits.cast("double") + 0.5) / float(1 << 52)
    return weight / temperature - F.log(-F.log(u))


def kth_largest(keys: DataFrame, key: str, k: int, bins: int = 4096, small: int = 4096) -> float | None:
    """Exact; counts in `bins` ranges, then in the one that holds it, until it has at most `small` rows or one value."""
    low, high, n = keys.agg(F.min(key), F.max(key), F.count(key)).first()
    if k <= 0 or not n:
        return None
    if k >= n:
        return low
    above = 0  # keys over `high`
    while low < high:
        width = (high - low) / bins
        inside = keys.where((F.col(key) >= low) & (F.col(key) <= high))
        if n <= small or low + width == low:
            return sorted((r[0] for r in inside.select(key).collect()), reverse=True)[k - above - 1] if n <= small else low
        at = F.least(F.floor((F.col(key) - low) / width), F.lit(bins - 1))
        found = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
        for r in sorted(found, key=lambda r: -r.bin):
            if above + r.n >= k:
                low, high, n = r.low, r.high, r.n
                break
            above += r.n
    return low


def _keyed(docs: DataFrame, model: Model, text: Column, doc_id: Column, settings: Settings, row: list[Column]) -> DataFrame:
    """`row` with the log importance and the Gumbel key."""
    scored = docs.select(*row, doc_id.alias("id"), importance(model, docs, text).alias("importance"))
    return scored.withColumn("gumbel_key", gumbel_key(F.col("importance"), F.col("id"), settings.temperature))


def _cut(keys: DataFrame, model: Model) -> float | None:
    """The least key that is kept."""
    return kth_largest(keys, "gumbel_key", round(model.share * keys.count()))


def selected(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, importance, gumbel_key, keep) of the documents that are kept; importance is the log."""
    rows = id_text(docs, id_col, text_col)
    ensure_checkpoints(docs.sparkSession)
    model = fit(rows, labels, settings)
    scored = _keyed(rows, model, F.col("text"), F.col("doc_id"), settings, [F.col("doc_id")]).drop("id").checkpoint()
    least = _cut(scored, model)
    kept = scored.where("false") if least is None else scored.where(F.col("gumbel_key") >= F.lit(least))
    return kept.withColumn("keep", F.lit(True))


def keep_good(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The kept rows of docs with all their columns. Keys are small and are kept for the count; whole rows are scored again
    instead of being written."""
    rows = id_text(docs)
    ensure_checkpoints(docs.sparkSession)
    model = fit(rows, labels, settings)
    least = _cut(_keyed(rows, model, F.col("text"), F.col("doc_id"), settings, []).select("gumbel_key").checkpoint(), model)
    if least is None:
        return docs.where("false")
    again = _keyed(docs, model, F.col("text").cast("string"), F.col("doc_id"), settings, [F.struct("*").alias("row")])
    return again.where(F.col("gumbel_key") >= F.lit(least)).select("row.*")
