"""Benchmark decontamination by the q-gram lemma.

Texts are compared as UTF-8 bytes with A-Z in lower case and white space as spaces. An item of m bytes that occurs in a text with
at most e edits shares at least m - q + 1 - q * e of its q-grams with it, all on neighbouring diagonals (place in the text less
place in the item). Shared q-grams are counted in diagonal bands of `band` diagonals that overlap by e, so that any e + 1
diagonals lie in one band; bands that reach the bound are verified by banded alignment of the whole item within the region.

The edit budget is e = edit_share * m, or less where the bound would fall under 1; items shorter than q must occur unchanged.
The benchmark is broadcast in blocks of `block_bytes`; a larger one takes more blocks, each against all rows. A block's index takes
about 16 bytes for each of its bytes and as much again for the filter before it; `clean` has at most CHAIN indexes in one task, and
writes the rows left (checkpoint) before it goes on with the next ones. Shared q-grams are
summed by band in runs of `RUN` at most, so a long text that repeats what an item repeats takes time, not memory; regions are
verified in the order of their places until one without an edit is found.

Defined results: null or empty items match nothing; null or empty texts match nothing; repeated rows are reported each; very long
and repetitive texts are searched whole; an empty table on either side gives no rows (`clean` keeps all). Of several regions the
one with the fewest edits, then the first, is reported. Extra columns are ignored (`clean` returns them, whatever their names).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import C1, C2, blocks, ensure_checkpoints, id_text, mix

Q = 10
BITS = 22
RUN = 1 << 20  # shared q-grams that are held at once
CHAIN = 4  # blocks whose indexes are held by one task
FOLD = bytes(32 if b in b"\t\n\r\x0b\x0c" else b for b in range(256)).lower()


@dataclass(frozen=True)
class Settings:
    edit_share: float = 0.08
    band: int = 32
    block_bytes: int = 8 << 20


def budget(m: int, share: float) -> tuple[int, int]:
    """(edits, q-grams that must be shared)"""
    e = max(0, min(int(m * share), (m - Q) // Q))
    return e, m - Q + 1 - Q * e


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hash of the Q bytes from each place on; raw has 16 spare bytes at its end."""
    n = len(raw) - 16
    eight = np.ndarray(n, "<u8", raw, strides=(1,))
    two = np.ndarray(n, "<u2", raw, offset=8, strides=(1,))
    x = eight * C1
    x ^= two * C2
    return mix(x)


def spare(text: bytes) -> np.ndarray:
    return np.frombuffer(text + b"\0" * 16, np.uint8)


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, bytes]], settings: Settings):
        self.settings = settings
        self.items = [(i, t.translate(FOLD)) for i, t in items]
        self.short = [n for n, (_, t) in enumerate(self.items) if len(t) < Q]
        found = [budget(len(t), settings.edit_share) for _, t in self.items]
        self.edits, self.least = np.array([x[0] for x in found] or [0]), np.array([x[1] for x in found] or [0])
        grams = [max(0, len(t) - Q + 1) for _, t in self.items]
        h = np.concatenate([gram_hashes(spare(t))[:n] for n, (_, t) in zip(grams, self.items, strict=True) if n] or [np.zeros(0, np.uint64)])
        order = np.argsort(h, kind="stable")
        self.item = np.repeat(np.arange(len(grams), dtype=np.int32), grams)[order]
        self.place = np.concatenate([np.arange(n, dtype=np.int32) for n in grams] or [np.zeros(0, np.int32)])[order]
        h = h[order]
        self.first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool))
        self.known, self.count = h[self.first], np.diff(np.append(self.first, len(h)))
        self.shift = np.uint64(64 - max(BITS, len(self.known).bit_length() + 2))  # at most a fourth of the filter is set
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.seen[(self.known >> self.shift).astype(np.int64)] = True

    def hits(self, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in the text, item, place in the item), in runs of at most RUN or of one place."""
        if not len(self.known) or len(raw) <= 16:
            return
        h = gram_hashes(raw)
        at = np.flatnonzero(self.seen[(h >> self.shift).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
        ok = self.known[k] == h[at]
        at, k = at[ok], k[ok]
        ends = np.cumsum(self.count[k])
        begin = 0
        while begin < len(at):
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + RUN, "right")))
            own, n = k[begin:stop], self.count[k[begin:stop]]
            entry = np.repeat(self.first[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(at[begin:stop], n), self.item[entry], self.place[entry]
            begin = stop

    def banded(self, at: np.ndarray, item: np.ndarray, place: np.ndarray, start: np.ndarray) -> np.ndarray:
        """[band, (text, item, band, hits, least diagonal, most)], a row for each band that is hit. start: of the texts."""
        text = np.searchsorted(start, at, "right") - 1
        diagonal = at - place - start[text]
        z, e = self.settings.band, self.edits[item]
        band = np.floor_divide(diagonal, z)
        keys = [(text, item, band, diagonal)]
        for back in range(1, -(-int(self.edits.max(initial=0)) // z) + 1):  # bands before, which reach e diagonals on
            again = diagonal - band * z < e - (back - 1) * z
            keys.append((text[again], item[again], band[again] - back, diagonal[again]))
        text, item, band, diagonal = map(np.concatenate, zip(*keys, strict=True))
        return summed(np.stack((text, item, band, np.ones(len(text), np.int64), diagonal, diagonal), axis=1))

    def matches(self, texts: list[bytes], any_item: bool = False) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, start, end, edits, shared q-grams) with places in bytes; the best of each text and item. If `any_item`,
        one match for each text is enough."""
        folded = [t.translate(FOLD) for t in texts]
        size = np.fromiter(map(len, folded), np.int64, len(folded)) + 1
        start = np.cumsum(size) - size
        best: dict[tuple[int, int], tuple] = {}
        found = [self.banded(*hit, start) for hit in self.hits(spare(b"\0".join(folded)))]
        settled: set[int] = set()
        for t, i, _, n, a, b in summed(np.concatenate(found)).tolist() if found else []:
            if n < self.least[i] or best.get((t, i), (1,))[0] == 0 or any_item and t in settled:
                continue
            e, pattern = int(self.edits[i]), self.items[i][1]
            begin = max(0, a - e)
            hit = aligned(pattern, folded[t][begin : max(0, b + len(pattern) + e)], e, (a - e) - begin, b - a + 2 * e)
            if hit and (hit[0], begin + hit[1]) < best.get((t, i), (1 << 60,))[:2]:
                best[t, i] = (hit[0], begin + hit[1], begin + hit[2], n)
                settled.add(t)
        for i in self.short:
            pattern = self.items[i][1]
            for t, x in enumerate(folded):
                if pattern and (p := x.find(pattern)) >= 0:
                    best[t, i] = (0, p, p + len(pattern), 0)
        return [(t, i, a, b, e, n) for (t, i), (e, a, b, n) in sorted(best.items())]


def summed(rows: np.ndarray) -> np.ndarray:
    """Rows of (text, item, band, hits, least, most), one for each band, sorted."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.flatnonzero(np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1))))
    return np.column_stack((rows[first, :3], np.add.reduceat(rows[:, 3], first), np.minimum.reduceat(rows[:, 4], first), np.maximum.reduceat(rows[:, 5], first)))


def aligned(pattern: bytes, region: bytes, edits: int, shift: int, width: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of the pattern in the region, if it needs at most `edits`; only diagonals
    shift .. shift + width (start in the region less start in the pattern) are computed."""
    if (p := region.find(pattern)) >= 0:
        return 0, p, p + len(pattern)
    m, n, far = len(pattern), len(region), 1 << 20
    lanes = np.arange(width + 1)
    text = np.frombuffer(region + b"\0", np.uint8)
    # row i, lane k: pattern[:i] against text ending at i + shift + k; cost and start are kept as one number
    end = lanes + shift
    cost = np.where((end >= 0) & (end <= n), 0, far) * (n + 2) + np.clip(end, 0, n)
    one = n + 2
    ramp = lanes * one
    for i, c in enumerate(pattern, 1):
        end = end + 1
        letter = text[np.clip(end - 1, 0, n)]
        stay = cost + np.where((letter == c) & (end >= 1) & (end <= n), 0, one)
        up = np.append(cost[1:], far * one) + one  # the pattern's letter is missing in the text
        now = np.minimum(stay, up)
        now = np.minimum.accumulate(now - ramp) + ramp  # extra letters in the text
        cost = np.where((end >= 0) & (end <= n), np.minimum(now, far * one), far * one)
    k = int(np.argmin(cost // one * (4 * one) + lanes))
    total = int(cost[k] // one)
    return (total, int(cost[k] % one), int(end[k])) if total <= edits else None


def item_blocks(benchmark: DataFrame, settings: Settings) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark's items in runs of at most `block_bytes` (or one item)."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null and text <> ''")
    for i, t in rows.toLocalIterator():
        raw = t.encode()
        if held and size + len(raw) > settings.block_bytes:
            yield held
            held, size = [], 0
        held.append((i, raw))
        size += len(raw)
    if held:
        yield held


SCHEMA = "doc_id long, item_id long, start long, end long, edits long, item_bytes long, shared_qgrams long"


def contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and item found in it; start and end are code points of the text."""
    rows = id_text(docs, id_col, text_col)
    out = None
    for items in item_blocks(benchmark, settings):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value, settings)
            for ids, texts in blocks(batches):
                found = []
                for t, i, a, b, e, n in index.matches(texts):
                    points = [len(texts[t][:x].decode("utf-8", "ignore")) for x in (a, b)]
                    found.append((ids[t], index.items[i][0], *points, e, len(index.items[i][1]), n))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        some = rows.mapInArrow(run, SCHEMA)
        out = some if out is None else out.unionByName(some)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def _found(sent, settings: Settings):
    """Scalar function: whether an item of the broadcast block occurs in the text."""
    held: list[Index] = []

    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(Index(sent.value, settings))
        out = np.zeros(len(texts), bool)
        raw = [(t or "").encode() for t in texts]
        at = 0
        while at < len(raw):
            size, end = 0, at
            while end < len(raw) and (end == at or size + len(raw[end]) <= 1 << 20):
                size += len(raw[end])
                end += 1
            out[[at + x[0] for x in held[0].matches(raw[at:end], True)]] = True
            at = end
        return pd.Series(out)

    return found


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows in which no item occurs, with all their columns."""
    for n, items in enumerate(item_blocks(benchmark, settings)):
        if n and n % CHAIN == 0:
            ensure_checkpoints(docs.sparkSession)
            docs = docs.checkpoint()
        found = _found(docs.sparkSession.sparkContext.broadcast(items), settings)
        docs = docs.where(~found(F.col("text").cast("string")))
    return docs
