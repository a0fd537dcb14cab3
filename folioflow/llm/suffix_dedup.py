"""Exact substring dedup over a sparse suffix array.

A byte is removed if it is covered by a `WINDOW`-byte string that also starts in a document with a smaller id. Only suffixes that
begin at anchors (see repeat_groups) are sorted: every window contains its anchor, and equal windows have it at the same place.
Anchors that may occur elsewhere are sent as records: the suffix's WINDOW leading bytes, and the LEFT bytes before the anchor read
backwards, as far as its windows use them. Records that are equal, byte for byte, are sent once by each group, for the smallest
id, with the places of all.

Sampled splitters cut the sorted records (suffix, then bytes before) into buckets, so a common passage with many contexts is cut
where the contexts differ. A bucket sorts its suffixes by multikey quicksort over 8-byte words and takes the common prefixes of
neighbours; the same is done for the bytes before the anchors. Two windows that hold d bytes before the anchor are equal if the
suffixes share WINDOW - d bytes and the bytes before share d, so a class of equal windows is a run of suffixes cut by the bytes
before. A class whose suffix prefix is also that of a splitter next to its bucket may go on in another bucket: such classes are
compared across the boundary, each bucket sending the window and its smallest id once, and the smallest of all comes back.

Splitters come from a sample of `SAMPLE` documents, or of one document for each bucket if these are more; they balance the buckets
and don't change results. Defined results: a null or empty text has no bytes; texts under WINDOW bytes lose nothing; repeated rows
(equal ids) don't count against each other; null ids come after all others and don't count against each other; a very long text is
cut in pieces only for its anchors; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import C1, C2, blocks, id_text, mix
from .repeat_groups import BLOB, Anchors, anchors, answers, batches, bucketed, dealt, distinct, ends_by_bucket, load, replies_of, sends, settle

WINDOW, K = 50, 16
LEFT, RIGHT = WINDOW - K, WINDOW
SAMPLE = 4000
LAST = (1 << 63) - 1
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with room around, start, size); the first text begins LEFT bytes in."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(b"\0" * LEFT + b"".join(texts) + b"\0" * (RIGHT + 16), np.uint8)
    return raw, np.cumsum(size) - size + LEFT, size


def leading(raw: np.ndarray) -> np.ndarray:
    """8 bytes from each place on, as a number that sorts like them."""
    return np.ndarray(len(raw) - 7, ">u8", raw, strides=(1,)).astype(np.uint64)


def byte_anchors(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[Anchors, np.ndarray]:
    lead = leading(raw)
    h = lead[:-8] * C1
    h ^= lead[8:] * C2
    return anchors(mix(h), start, size, WINDOW, K), lead


def all_anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, Anchors, np.ndarray]]:
    for begin, end in batches([len(t) for t in texts], 1 << 20):
        raw, start, size = laid_out(texts[begin:end])
        found, lead = byte_anchors(raw, start, size)
        yield raw, start, begin, size, found, lead


def offered(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    keys, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, _, begin, _, found, _ in all_anchors(texts):
        keys.append(bucketed(found.hash, buckets))
        docs.append(found.doc + begin)
    own, many, place = distinct(np.concatenate(keys), np.concatenate(docs))
    return own, many, place, ends_by_bucket(own, buckets)


def contexts(raw: np.ndarray, found: Anchors, some: np.ndarray) -> np.ndarray:
    """[n, LEFT + RIGHT + 4]: the bytes that the windows of each anchor use, zeros outside, then the range of d and padding."""
    at, high, low = found.at[some], (found.at - found.first)[some], (found.at - found.last)[some]
    place = np.arange(-LEFT, RIGHT)
    out = np.zeros((len(at), LEFT + RIGHT + 4), np.uint8)
    out[:, : LEFT + RIGHT] = raw[at[:, None] + place]
    out[:, : LEFT + RIGHT][(place < -high[:, None]) | (place >= RIGHT - low[:, None])] = 0
    out[:, LEFT + RIGHT], out[:, LEFT + RIGHT + 1] = low, high
    return out


def distinct_records(records: np.ndarray, by: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each distinct record, in the order `by` if given; each row's place among the distinct)"""
    order = np.arange(len(records)) if by is None else np.argsort(by, kind="stable")
    own = np.ascontiguousarray(records[order])
    h = np.zeros(len(own), np.uint64)
    for word in own.view("<u8").T:
        h = mix(h * C1 + word)
    _, first, same = np.unique(h, return_index=True, return_inverse=True)
    if (own[first[same]] != own).any():  # unlike records with one hash
        _, first, same = np.unique(own, axis=0, return_index=True, return_inverse=True)
    out = np.empty(len(own), np.int64)
    out[order] = same.ravel()
    return order[first], out


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of the rows of words (uint64, most significant first) by multikey quicksort: a segment is cut three ways by a pivot
    (median of three) in one word; what equals it goes on with the next word. All segments take a step at once."""
    n, width = words.shape
    order = np.arange(n)
    low, high, col = np.zeros(1, np.int64), np.full(1, n), np.zeros(1, np.int64)
    while len(low := low[open_ := (high - low > 1) & (col < width)]):
        high, col = high[open_], col[open_]
        size = high - low
        of = np.repeat(np.arange(len(low)), size)
        at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        own = order[at]
        key = words[own, col[of]]
        begin = np.cumsum(size) - size
        a, b, c = key[begin], key[begin + size // 2], key[begin + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[of]
        side = (key >= pivot).astype(np.int64) + (key > pivot)
        count = np.bincount(3 * of + side, minlength=3 * len(low)).reshape(-1, 3)
        edge = low[:, None] + np.cumsum(count, axis=1)
        for k in range(3):
            mine = np.flatnonzero(side == k)
            done = np.cumsum(count[:, k]) - count[:, k]
            order[(edge[:, k] - count[:, k] - done)[of[mine]] + np.arange(len(mine))] = own[mine]
        low, high, col = np.concatenate((low, edge[:, 0], edge[:, 1])), np.concatenate((edge[:, 0], edge[:, 1], high)), np.concatenate((col, col + 1, col))
    return order


def as_words(rows: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view(">u8").astype(np.uint64)


def neighbour_prefix(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before at their beginning (0 for the first)."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def shared_bytes(suffixes: np.ndarray, low: bytes | None, high: bytes | None) -> np.ndarray:
    """Leading bytes that each suffix has in common with one of the splitters around its bucket."""
    out = np.zeros(len(suffixes), np.int64)
    for edge in (low, high):
        if edge is not None:
            differ = suffixes != np.frombuffer(edge[:RIGHT].ljust(RIGHT, b"\0"), np.uint8)
            out = np.maximum(out, np.where(differ.any(axis=1), differ.argmax(axis=1), RIGHT))
    return out


class Classes:
    """The windows of distinct records: for each number d of bytes before the anchor, which are equal. `low` and `high` are the
    splitters around the bucket (None at either end)."""

    def __init__(self, records: np.ndarray, doc: np.ndarray, low: bytes | None, high: bytes | None):
        self.records, self.doc = records, doc
        self.right, self.left = records[:, LEFT : LEFT + RIGHT], np.ascontiguousarray(records[:, LEFT - 1 :: -1])
        self.order = multikey_order(as_words(self.right))
        self.prefix = neighbour_prefix(self.right[self.order])
        anchor = np.empty(len(records), np.int64)
        anchor[self.order] = np.cumsum(self.prefix < K)
        self.back = multikey_order(np.column_stack((anchor.astype(np.uint64), as_words(self.left))))
        self.before = neighbour_prefix(self.left[self.back])
        self.before[1:][anchor[self.back][1:] != anchor[self.back][:-1]] = -1
        self.before[:1] = -1
        self.alone = np.bincount(anchor, minlength=1)[anchor] < 2
        self.least, self.most = records[:, LEFT + RIGHT].astype(np.int64), records[:, LEFT + RIGHT + 1].astype(np.int64)
        self.shared = shared_bytes(self.right, low, high)

    def each(self, local: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(d, records, begins of their classes, smallest id of each class); records in order of class. Local classes of one
        record are left out if `local`, else all classes but those that may go on elsewhere are."""
        after, before = np.empty(len(self.doc), np.int64), np.empty(len(self.doc), np.int64)
        for d in range(LEFT + 1):
            own = (self.least <= d) & (d <= self.most)
            own = np.flatnonzero(own & ~self.alone if local else own & (self.shared >= WINDOW - d))
            if len(own) < 1 + local:
                continue
            after[self.order] = np.cumsum(self.prefix < WINDOW - d)
            before[self.back] = np.cumsum(self.before < d)
            key = after[own] << 32 | before[own]
            by = np.lexsort((self.doc[own], key))
            key, own = key[by], own[by]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            yield d, own, first, self.doc[own][first]

    def windows(self, d: int, own: np.ndarray) -> np.ndarray:
        """Bytes of the windows with d bytes before the anchor, of some records."""
        return self.records[own, LEFT - d : LEFT - d + WINDOW]

    def crossing(self) -> tuple[list[bytes], list[int]]:
        """(windows, smallest ids) of the classes that may go on in another bucket."""
        found, ids = [], []
        for d, own, first, least in self.each(False):
            found += [w.tobytes() for w in self.windows(d, own[first])]
            ids += least.tolist()
        return found, ids

    def removable(self, elsewhere: dict[bytes, int]) -> np.ndarray:
        """[n, LEFT + 1]: whether the window with d bytes before the anchor occurs in a smaller document."""
        out = np.zeros((len(self.doc), LEFT + 1), bool)
        for d, own, first, least in self.each(True):
            out[own, d] = np.repeat(least, np.diff(np.append(first, len(own)))) < self.doc[own]
        if elsewhere:
            for d, own, first, _ in self.each(False):
                least = np.array([elsewhere.get(w.tobytes(), LAST) for w in self.windows(d, own[first])], np.int64)
                out[own, d] |= np.repeat(least, np.diff(np.append(first, len(own)))) < self.doc[own]
        return out


def packed(*arrays: np.ndarray) -> bytes:
    body = zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))
    return struct.pack("<B", len(arrays)) + b"".join(struct.pack("<Q", a.nbytes) for a in arrays) + body


def unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = struct.unpack_from(f"<{blob[0]}Q", blob, 1)
    body = zstandard.ZstdDecompressor().decompress(blob[1 + 8 * blob[0] :])
    out, at = [], 0
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(body, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


def sort_keys(records: np.ndarray) -> np.ndarray:
    """What records are sorted by across buckets: the suffix, then the bytes before it read backwards."""
    return np.ascontiguousarray(np.concatenate((records[:, LEFT : LEFT + RIGHT], records[:, LEFT - 1 :: -1]), axis=1)).view(f"S{RIGHT + LEFT}").ravel()


def splitters(rows: DataFrame, buckets: int) -> np.ndarray:
    n = rows.count()
    if not n or buckets < 2:
        return np.zeros(0, f"S{RIGHT + LEFT}")

    def some(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in blocks(parts):
            raw, start, size = laid_out(texts)
            found, _ = byte_anchors(raw, start, size)
            few = np.arange(len(found.at))[:: max(1, len(found.at) // (16 * len(texts)))]
            yield pa.RecordBatch.from_pydict({"key": pa.array(sort_keys(contexts(raw, found, few)).tolist(), pa.binary())})

    sample = max(SAMPLE, buckets)
    kept = rows.sample(fraction=min(1.0, sample / n), seed=7).mapInArrow(some, "key binary").limit(40 * sample).collect()  # a sample
    keys = np.sort(np.array([bytes(r.key) for r in kept], f"S{RIGHT + LEFT}"))
    return np.unique(keys[(np.arange(1, buckets) * len(keys)) // buckets]) if len(keys) else keys


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    spread, plan = dealt(docs, id_col, text_col)
    cuts = splitters(id_text(docs, id_col, text_col), plan.buckets)
    blob = pa.schema([("bucket", pa.int32()), ("p", pa.int32()), ("blob", pa.binary())])

    def offer(group: pa.Table) -> pa.Table:
        _, texts = load(group)
        own, many, _, ends = offered(texts, plan.buckets)
        return pa.Table.from_pydict(sends(own, many, group.column("p")[0].as_py(), plan.buckets, ends, "<u4"))

    def describe(group: pa.Table, reply: pa.Table) -> pa.Table:
        if not group.num_rows:
            return blob.empty_table()
        ids, texts = load(group)
        _, _, place, ends = offered(texts, plan.buckets)
        flags = answers(replies_of(reply), ends)[place] if len(place) else np.zeros(0, bool)
        records, doc, at, done = [], [], [], 0
        for raw, start, begin, _, found, _ in all_anchors(texts):
            some = np.flatnonzero(flags[done : done + len(found.at)])
            done += len(found.at)
            records.append(contexts(raw, found, some))
            doc.append(found.doc[some] + begin)
            at.append(found.at[some] - start[found.doc[some]])
        if not records:
            return blob.empty_table()
        records, doc, at = map(np.concatenate, (records, doc, at))
        first, same = distinct_records(records)
        number = np.array([LAST if i is None else i for i in ids], np.int64)
        bucket = np.searchsorted(cuts, sort_keys(records[first]), "right")
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        first, bucket, same = first[order], bucket[order], rank[same]
        by = np.argsort(same, kind="stable")
        edge = np.searchsorted(bucket, np.arange(plan.buckets + 1))
        spots = np.searchsorted(same[by], edge)
        out = {"bucket": [], "p": [], "blob": []}
        for b in np.flatnonzero(np.diff(edge)).tolist():
            reps, occ = first[edge[b] : edge[b + 1]], by[spots[b] : spots[b + 1]]
            rep = (same[occ] - edge[b]).astype("<u4")
            over = number[doc[occ]] > number[doc[reps]][rep]
            out["bucket"].append(b)
            out["blob"].append(packed(records[reps], number[doc[reps]], rep, doc[occ].astype("<u4"), at[occ].astype("<u4"), over.astype("u1")))
        p = group.column("p")[0].as_py()
        return pa.Table.from_pydict({"bucket": pa.array(out["bucket"], pa.int32()), "p": pa.array([p] * len(out["bucket"]), pa.int32()), "blob": pa.array(out["blob"], pa.binary())})

    def unpacked_parts(group: pa.Table) -> tuple[list, np.ndarray, np.ndarray, bytes | None, bytes | None]:
        parts = [unpacked(b, "u1", "<i8", "<u4", "<u4", "<u4", "u1") for b in group.column("blob").to_pylist()]
        records = np.concatenate([x[0].reshape(-1, LEFT + RIGHT + 4) for x in parts])
        b = group.column("bucket")[0].as_py()
        return parts, records, np.concatenate([x[1] for x in parts]), cuts[b - 1] if b else None, cuts[b] if b < len(cuts) else None

    def compare(group: pa.Table) -> pa.Table:
        _, records, doc, low, high = unpacked_parts(group)
        near = shared_bytes(records[:, LEFT : LEFT + RIGHT], low, high) >= K  # no other record is in a class that crosses
        records, doc = records[near], doc[near]
        own, _ = distinct_records(records, doc)
        found, ids = Classes(records[own], doc[own], low, high).crossing()
        return pa.Table.from_pydict({"bucket": pa.array([group.column("bucket")[0].as_py()] * len(ids), pa.int32()), "window": pa.array(found, pa.binary()), "least": pa.array(ids, pa.int64())})

    def decide(group: pa.Table, crossed: pa.Table) -> pa.Table:
        if not group.num_rows:
            return blob.empty_table()
        parts, records, doc, low, high = unpacked_parts(group)
        own, kind = distinct_records(records, doc)  # the copy with the smallest id
        doc = doc[own]
        classes = Classes(records[own], doc, low, high)
        pattern = classes.removable(dict(zip(crossed.column("window").to_pylist(), crossed.column("least").to_pylist(), strict=True)))
        low, high = records[own, LEFT + RIGHT].astype(np.int64), records[own, LEFT + RIGHT + 1].astype(np.int64)
        edges = np.diff(np.pad(pattern.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        which, begin = np.nonzero(edges == 1)
        stop = np.nonzero(edges == -1)[1] - 1
        run_first = np.searchsorted(which, np.arange(len(own) + 1))
        out, base = [], 0
        for x in parts:
            rep, d, a, over = x[2].astype(np.int64), x[3], x[4].astype(np.int64), x[5] > 0
            k = kind[base + rep]
            full = over | (x[1][rep] > doc[k])
            base += len(x[1])
            n = np.where(full, 0, run_first[k + 1] - run_first[k])
            occ = np.repeat(np.arange(len(rep)), n)
            run = np.repeat(run_first[k], n) + np.arange(len(occ)) - np.repeat(np.cumsum(n) - n, n)
            starts = np.concatenate(((a - high[k])[full], a[occ] - stop[run]))
            ends = np.concatenate(((a - low[k])[full], a[occ] - begin[run])) + WINDOW
            out.append(packed(np.concatenate((d[full], d[occ])), starts.astype("<u4"), ends.astype("<u4")))
        return pa.Table.from_pydict({"bucket": group.column("bucket"), "p": group.column("p"), "blob": pa.array(out, pa.binary())})

    def cut(group: pa.Table, reply: pa.Table) -> pa.Table:
        ids, texts = load(group)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        start = np.cumsum(size + 1) - size - 1
        cover = np.zeros(int(size.sum()) + len(size) + 1, np.int32)
        for b in reply.column("blob").to_pylist():
            d, s, e = unpacked(b, "<u4", "<u4", "<u4")
            np.add.at(cover, start[d] + s, np.int32(1))
            np.add.at(cover, start[d] + e, np.int32(-1))
        gone = np.cumsum(cover) > 0
        out = []
        for i, t, a in zip(ids, texts, start.tolist(), strict=True):
            mark = gone[a : a + len(t)]
            n = int(mark.sum())
            kept = np.frombuffer(t, np.uint8)[~mark].tobytes() if n else t
            out.append((i, len(t), n, int(mark[:1].sum() + (mark[1:] & ~mark[:-1]).sum()) if n else 0, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*out, strict=True)) or [()] * 5
        return pa.Table.from_arrays([pa.array(c, pa.string() if k == 4 else pa.int64()) for k, c in enumerate(cols)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    first = spread.groupBy("p").applyInArrow(offer, BLOB).groupBy("bucket").applyInArrow(lambda g: settle(g, "<u4"), BLOB)
    sent = spread.groupBy("p").cogroup(first.groupBy("p")).applyInArrow(describe, BLOB)
    crossing = sent.groupBy("bucket").applyInArrow(compare, "bucket int, window binary, least long")
    least = crossing.groupBy("window").agg(F.min("least").alias("least"), F.count("*").alias("n")).where("n > 1").select("window", "least")
    crossed = crossing.select("bucket", "window").join(least, "window").select("bucket", "window", "least")
    second = sent.groupBy("bucket").cogroup(crossed.groupBy("bucket")).applyInArrow(decide, BLOB)
    return spread.groupBy("p").cogroup(second.groupBy("p")).applyInArrow(cut, SCHEMA)
