"""Shared parts of the two exact repeat finders.

Documents are dealt into groups of a few MB by a hash of id and text. A window of `size` units (bytes or words) is named by one of
its k-unit strings, the one with the least hash (the leftmost of equals): its anchor. Equal windows have equal anchors at equal
places, so repeats are looked for among anchors only, a small share of all places. In a first exchange groups send a 32-bit
fingerprint of each distinct anchor to the bucket of its hash, and get back a bit for each: whether it may occur elsewhere.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, mix, partitions, window_min

LOW31, LOW32 = np.uint64((1 << 31) - 1), np.uint64((1 << 32) - 1)
S31 = np.uint64(31)
BLOB = "bucket int, p int, blob binary"


@dataclass(frozen=True)
class Plan:
    parts: int
    groups: int
    buckets: int


def dealt(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Plan]:
    """(p, doc_id, text) in groups p. All later passes read this one exchange.

    Groups and buckets follow the size of the input (about 12 MB a bucket), not the number of shuffle partitions: a group sends
    one row to each bucket it has anchors for, at most as many as it has anchors. Texts count in the hash, so that rows without
    an id, or different texts under one id, are spread.
    """
    rows, spark = id_text(docs, id_col, text_col), docs.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(spark.sparkContext.defaultParallelism, partitions(spark, docs, 12 << 20, least=1))
    plan = Plan(max(n, shuffle), 4 * n, n)
    cut = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(plan.groups)).cast("int").alias("p"), "doc_id", "text")
    return cut.repartition(plan.parts, "p"), plan


def load(group: pa.Table) -> tuple[list[int | None], list[bytes]]:
    """Documents in an order that every pass repeats: by id, then text; null ids last."""
    ids = group.column("doc_id").to_pylist()
    texts = [t or b"" for t in group.column("text").cast(pa.binary()).to_pylist()]
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, texts[k]))
    return [ids[k] for k in order], [texts[k] for k in order]


def batches(sizes: list[int], limit: int) -> list[tuple[int, int]]:
    """Runs of documents of at most `limit` units together, or one document."""
    out, begin, total = [], 0, 0
    for k, n in enumerate(sizes):
        if k > begin and total + n > limit:
            out.append((begin, k))
            begin, total = k, 0
        total += n
    if begin < len(sizes):
        out.append((begin, len(sizes)))
    return out


@dataclass
class Anchors:
    doc: np.ndarray
    at: np.ndarray  # place of the anchor in the array
    hash: np.ndarray
    first: np.ndarray  # first and last window start that it names
    last: np.ndarray


def anchors(hashes: np.ndarray, start: np.ndarray, size: np.ndarray, window: int, k: int) -> Anchors:
    """hashes: of the k units from each place on (at least one for each place of a window); start, size: of the documents."""
    none = np.zeros(0, np.int64)
    key = (hashes & ~LOW31) | np.arange(len(hashes), dtype=np.uint64)
    low = window_min(key, window - k + 1)
    valid = np.zeros(len(low) + 1, np.int32)
    long = size >= window
    np.add.at(valid, start[long], 1)
    np.add.at(valid, np.minimum((start + size - window + 1)[long], len(low)), -1)
    s = np.flatnonzero(np.cumsum(valid[:-1]))
    if not len(s):
        return Anchors(none, none, hashes[:0], none, none)
    a = (low[s] & LOW31).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1))))
    ends = np.append(new[1:], len(s)) - 1
    at = a[new]
    filled = np.flatnonzero(size > 0)
    return Anchors(filled[np.searchsorted(start[filled], at, "right") - 1], at, hashes[at], s[new], s[ends])


def bucketed(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """bucket << 32 | 32-bit fingerprint"""
    g = mix(hashes)
    return ((g >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (g & LOW32)


def distinct(keys: np.ndarray, owner: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, whether a key has two owners (two places if owner is None), place of each key among the distinct)"""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(k)) - 1 if len(first) else first
    many = last > first if owner is None else owner[order][first] != owner[order][last]
    place = np.empty(len(k), np.int64)
    place[order] = np.cumsum(new) - 1
    return k[first], many, place


def sends(keys: np.ndarray, many: np.ndarray, p: int, buckets: int, cut_at: np.ndarray, width: str) -> dict:
    """One row for each bucket with keys; cut_at: ends of the buckets' stretches in `keys`."""
    cuts = np.concatenate(([0], cut_at))
    filled = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
    blobs = [struct.pack("<I", cuts[b + 1] - cuts[b]) + keys[cuts[b] : cuts[b + 1]].astype(width).tobytes() + np.packbits(many[cuts[b] : cuts[b + 1]]).tobytes() for b in filled]
    return {"bucket": pa.array(filled, pa.int32()), "p": pa.array([p] * len(filled), pa.int32()), "blob": pa.array(blobs, pa.binary())}


def ends_by_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(keys, np.arange(1, buckets + 1, dtype=np.uint64) << np.uint64(32))


def settle(group: pa.Table, width: str) -> pa.Table:
    """A bucket's answer to every group: a bit for each key sent, set if the key was sent twice or marked as repeated."""
    kind = np.dtype(width)
    sent = []
    for blob in group.column("blob").to_pylist():
        n = struct.unpack("<I", blob[:4])[0]
        sent.append((np.frombuffer(blob, kind, n, 4), np.unpackbits(np.frombuffer(blob, np.uint8, -1, 4 + n * kind.itemsize), count=n).astype(bool)))
    every, times = np.unique(np.concatenate([k for k, _ in sent]), return_counts=True)
    twice = times > 1
    for k, m in sent:
        twice[np.searchsorted(every, k[m])] = True
    bits = [np.packbits(twice[np.searchsorted(every, k)]).tobytes() for k, _ in sent]
    return pa.Table.from_pydict({"bucket": group.column("bucket"), "p": group.column("p"), "blob": pa.array(bits, pa.binary())})


def answers(replies: dict[int, bytes], cut_at: np.ndarray) -> np.ndarray:
    """Bits of all keys that a group sent, in their order."""
    sizes = np.diff(np.concatenate(([0], cut_at)))
    parts = [np.unpackbits(np.frombuffer(replies[b], np.uint8), count=int(n)).astype(bool) for b, n in enumerate(sizes.tolist()) if n]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def replies_of(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table.column("bucket").to_pylist(), table.column("blob").to_pylist(), strict=True))
