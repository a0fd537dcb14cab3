"""Language-model scoring from a log-frequency Bloom filter.

An n-gram of count c is stored with its quantised count q = 1 + floor(log2 c), as the q items (n-gram, 1) ... (n-gram, q). A
probe asks for level 1, 2, ... until one is missing; the last level found stands for the weight w = 1.5 * 2^(q-1) (1 for q = 1).
With absolute discounting, P(b | a) = max(w(a, b) - discount, 0) / T(a) + discount * F(a) / T(a) * P(b), where T(a) is the sum of
the weights of all pairs that begin with a and F(a) their number, both exact; after an unknown a it is P(b). P(b) is additively
smoothed from the words' weights. So the probabilities after each word sum to 1 over all words and one unknown word, but for what
false positives of the filter add (tested with a filter that has none).

The filter is cut into segments by the hash of the n-gram's first word, of a size that follows the number of items
(`bits_per_item`), so the share of false positives is the same at any size. A small table's model (at most `max_bytes`, `max_bits`
and `max_words`) is built and broadcast. A larger one stays where it is: blocks of documents send their distinct n-grams to the
segments once, counts with them, and a segment builds its filters and sends back to each block its levels and counts. Both ways
give the same scores, but that the second spreads the pairs of the most frequent words over all segments, by the second word, and
adds up these words' numbers, which are exact; they are told by a sample of rows, and there are none in small tables.

Words are compared by 64-bit hashes, pairs by their first word and 48 bits of a hash of both. Defined results: a null or empty text is its end token alone; a null doc_id counts as the
text "" (held out); repeated rows are scored each and train each; a very long text is a block of its own; an empty table gives an
empty table; extra columns are ignored. With no training rows N = V = 0 and the scores are log10((0 + 0.1) / 0.1) = 0 a token.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import C3, S32, WordHashes, blocks, ensure_checkpoints, id_text, mix, pair_hash, partitions
from .repeat_groups import LOW32
from .repeat_groups import batches as runs_of

END, LOW48 = np.uint64(0x5EED0FE4D), np.uint64((1 << 48) - 1)
SMOOTH = 0.1


@dataclass(frozen=True)
class Settings:
    """max_bits, max_words: the largest model that is broadcast (256 MB of bits, 128 MB of words); max_bytes: the largest table, by
    the plan's estimate, for which that is tried. A word that may begin more than `spread` pairs has them in all segments."""

    discount: float = 0.75
    bits_per_item: int = 8
    hashes: int = 5
    max_bits: int = 1 << 31
    max_words: int = 4_000_000
    max_bytes: int = 64 << 20
    spread: int = 2_000_000
    block: int = 4_000_000


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def tokens(texts: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of all texts, each closed by END; first token of each text)."""
    words = [t.lower().split() for t in texts]
    size = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    start = np.cumsum(size) - size
    out = np.full(int(size.sum()), END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[start + size - 1] = False
    out[inner] = np.concatenate([hashes.of(w) for w in words]) if len(words) else []
    return out, start


def contexts(token: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The token before each; END also stands before the first."""
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[start] = END
    return before


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    small = np.minimum(counts, 255).astype(np.uint8)
    body = zstandard.ZstdCompressor(level=1).compress(small.tobytes() + counts[counts >= 255].astype("<i8").tobytes())
    return struct.pack("<I", len(keys)) + keys.astype("<u8").tobytes() + body


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = struct.unpack("<I", blob[:4])[0]
    keys = np.frombuffer(blob, "<u8", n, 4)
    body = zstandard.ZstdDecompressor().decompress(blob[4 + 8 * n :])
    counts = np.frombuffer(body, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(body, "<i8", -1, n)
    return keys, counts


def pair_key(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return pair_hash(before, token) & LOW48


def pack_pairs(context: np.ndarray, pair: np.ndarray, counts: np.ndarray) -> bytes:
    """Rows sorted by context; pairs take 6 bytes."""
    first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
    runs = np.diff(np.append(first, len(context))).astype("<u4")
    small = np.minimum(counts, 255).astype(np.uint8)
    body = zstandard.ZstdCompressor(level=1).compress(runs.tobytes() + small.tobytes() + counts[counts >= 255].astype("<i8").tobytes())
    keys = np.ascontiguousarray(pair.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
    return struct.pack("<II", len(first), len(pair)) + context[first].astype("<u8").tobytes() + keys.tobytes() + body


def unpack_pairs(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m = struct.unpack("<II", blob[:8])
    context, at = np.frombuffer(blob, "<u8", n, 8), 8 + 8 * n
    keys = np.zeros((m, 8), np.uint8)
    keys[:, :6] = np.frombuffer(blob, np.uint8, 6 * m, at).reshape(m, 6)
    body = zstandard.ZstdDecompressor().decompress(blob[at + 6 * m :])
    counts = np.frombuffer(body, np.uint8, m, 4 * n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(body, "<i8", -1, 4 * n + m)
    return np.repeat(context, np.frombuffer(body, "<u4", n)), keys.view("<u8").ravel(), counts


def summed_pairs(context: np.ndarray, pair: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by context, then pair."""
    order = np.lexsort((pair, context))
    context, pair, counts = context[order], pair[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (context[1:] != context[:-1])))) if len(pair) else np.zeros(0, np.int64)
    return context[first], pair[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def segment_of(words: np.ndarray, segments: int) -> np.ndarray:
    return (words >> np.uint64(64 - (segments.bit_length() - 1))).astype(np.int64) if segments > 1 else np.zeros(len(words), np.int64)


def by_segment(words: np.ndarray, segments: int) -> Iterator[tuple[int, slice]]:
    """Stretches of sorted words."""
    part = segment_of(words, segments)
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=False):
        yield int(part[a]), slice(a, b)


def count_ngrams(docs: DataFrame, segments: int, flush: int = 2_000_000) -> DataFrame:
    """(part, blob): part = segment for words, segments + segment for pairs; counts summed by task, or by `flush` n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        single: list[tuple[np.ndarray, ...]] = []
        double: list[tuple[np.ndarray, ...]] = []

        def out() -> Iterator[pa.RecordBatch]:
            if not single:
                return
            keys, counts = summed(*map(np.concatenate, zip(*single, strict=True)))
            parts = [(s, pack(keys[k], counts[k])) for s, k in by_segment(keys, segments)]
            context, pair, counts = summed_pairs(*map(np.concatenate, zip(*double, strict=True)))
            parts += [(segments + s, pack_pairs(context[k], pair[k], counts[k])) for s, k in by_segment(context, segments)]
            yield pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in parts], pa.int32()), "blob": pa.array([b for _, b in parts], pa.binary())})
            single.clear()
            double.clear()

        size = 0
        for ids, texts in blocks(batches):
            train = [t for i, t in zip(ids, texts, strict=True) if not held_out(i)]
            if not train:
                continue
            token, start = tokens(train, hashes)
            before = contexts(token, start)
            single.append(np.unique(token, return_counts=True))
            double.append((before, pair_key(before, token), np.ones(len(token), np.int64)))
            size += len(single[-1][0]) + len(token)
            if size > flush:
                yield from out()
                size = 0
        yield from out()

    return docs.mapInArrow(run, "part int, blob binary")


def level(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(counts)).astype(np.int64)


def weight(q: np.ndarray) -> np.ndarray:
    """The count that a level stands for."""
    return np.where(q <= 0, 0.0, np.where(q == 1, 1.0, 1.5 * np.exp2(q - 1.0)))


def addresses(keys: np.ndarray, at_level: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-th bit of an item is at one + k * two, of which the high 32 bits are scaled to the segment's size."""
    one = mix(keys ^ np.uint64(at_level * int(C3) & 0xFFFFFFFFFFFFFFFF))
    return one, mix(one) | np.uint64(1)


def scaled(at: np.ndarray, bits: np.ndarray | np.uint64) -> np.ndarray:
    """Places below `bits` (under 2^32)."""
    return (at >> S32) * bits >> S32


def build_segment(counts: np.ndarray, keys: np.ndarray, settings: Settings) -> np.ndarray:
    q = level(counts)
    bits = 8 * max(8, -(-int(q.sum()) * settings.bits_per_item // 8))
    out = np.zeros(bits, bool)
    for at_level in range(1, int(q.max(initial=0)) + 1):
        one, two = addresses(keys[q >= at_level], at_level)
        for k in range(settings.hashes):
            out[scaled(one + np.uint64(k) * two, np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little")


def levels(bits: np.ndarray, base: np.ndarray, size: np.ndarray, part: np.ndarray, keys: np.ndarray, hashes: int) -> np.ndarray:
    """Quantised counts by probing level after level. A part's bits begin at byte base[part]; size[part] is their number."""
    out, alive, q = np.zeros(len(keys), np.int64), np.flatnonzero(size[part] > 0), 0
    while len(alive):
        q += 1
        one, two = addresses(keys[alive], q)
        own = part[alive]
        for k in range(hashes):
            hit = _set(bits, base[own], size[own], one + np.uint64(k) * two)
            if not hit.all():
                alive, one, two, own = alive[hit], one[hit], two[hit], own[hit]
        out[alive] = q
    return out


def _set(bits: np.ndarray, base: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    at = scaled(at, size)
    return (bits[base + (at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


class Table:
    """Exact numbers by word: its count, and the sum of weights and the number of the pairs that begin with it. Every word begins a
    pair, as a text's last word is followed by the end; so one list of words does for all."""

    def __init__(self, key: np.ndarray, *values: np.ndarray):
        self.key, self.values = key, values

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        if not len(self.key):
            return tuple(np.zeros(len(keys), v.dtype) for v in self.values)
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        known = self.key[at] == keys
        return tuple(np.where(known, v[at], 0) for v in self.values)


@dataclass(frozen=True)
class Sums:
    """Training tokens, distinct ones, and the sum of their weights."""

    n: int
    v: int
    quantised: float


@dataclass(frozen=True)
class Lookup:
    """Columns by word: hash, count, level, sum of weights and number of pairs begun."""

    hash: np.ndarray
    count: np.ndarray
    level: np.ndarray
    total: np.ndarray
    follow: np.ndarray


def probabilities(words: Lookup, before: np.ndarray, token: np.ndarray, pair_level: np.ndarray, sums: Sums, settings: Settings) -> np.ndarray:
    """P(token | before), both as places in `words`."""
    alone = np.minimum((weight(words.level) + SMOOTH) / (sums.quantised + SMOOTH * (sums.v + 1)), 1.0)[token]
    total, follow = words.total[before], words.follow[before]
    seen = np.minimum(weight(pair_level), total)  # a false positive can't be more than all
    rest = np.divide(settings.discount * follow, total, out=np.ones(len(token)), where=total > 0)
    own = np.divide(np.maximum(seen - settings.discount, 0), total, out=np.zeros(len(token)), where=total > 0)
    return np.minimum(own + rest * alone, 1.0)


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def columns(ids: list, words: Lookup, before: np.ndarray, token: np.ndarray, start: np.ndarray, pair_level: np.ndarray, sums: Sums, settings: Settings) -> list:
    p = probabilities(words, before, token, pair_level, sums, settings)
    base = np.log10(words.count + SMOOTH) - np.log10(sums.n + SMOOTH * (sums.v + 1))
    size = np.diff(np.append(start, len(token)))
    known = np.add.reduceat((words.count > 0)[token].astype(np.int64), start)
    return [pa.array(ids, pa.int64()), pa.array(map(held_out, ids)), *map(pa.array, (size, known, np.full(len(ids), sums.n), np.add.reduceat(base[token], start), np.add.reduceat(np.log10(p), start)))]


class Model:
    """What workers get: the bits of all segments one after another, where each begins, and the exact numbers."""

    def __init__(self, settings: Settings, segments: int, parts: dict[int, bytes], sums: Sums, table: Table):
        self.settings, self.segments, self.sums, self.table = settings, segments, sums, table
        size = np.array([len(parts.get(k, b"")) for k in range(2 * segments)], np.int64)
        self.base = np.cumsum(size) - size
        self.size = (size * 8).astype(np.uint64)
        self.bits = np.frombuffer(b"".join(parts.get(k, b"") for k in range(2 * segments)), np.uint8)

    def levels(self, words: np.ndarray, keys: np.ndarray, order: int) -> np.ndarray:
        """`order` 0: of words, 1: of pairs that begin with the words."""
        return levels(self.bits, self.base, self.size, segment_of(words, self.segments) + order * self.segments, keys, self.settings.hashes)


class Lexicon(dict):
    """word -> place in this worker's columns; word lists are resolved together."""

    def __init__(self, model: Model, limit: int = 300_000):
        super().__init__()
        self.model, self.limit = model, limit
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.pending: list[bytes] = []
        self.words = self.found(np.array([END]))
        self[b""] = 0  # no word is empty: the end token
        self.used = 1

    def __missing__(self, word: bytes) -> int:
        self.pending.append(word)
        n = self[word] = self.used
        self.used += 1
        return n

    def found(self, keys: np.ndarray) -> Lookup:
        count, total, follow = self.model.table.of(keys)
        return Lookup(keys, count, self.model.levels(keys, keys, 0), total, follow)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        import xxhash

        if len(self) > self.limit:
            self.forget()
        out: list[int] = []
        start = []
        for t in texts:
            start.append(len(out))
            out += map(self.__getitem__, t.lower().split())
            out.append(0)
        if self.pending:
            new = self.found(np.fromiter((xxhash.xxh64_intdigest(w, 0) for w in self.pending), np.uint64, len(self.pending)))
            self.words = Lookup(*(np.concatenate((getattr(self.words, k), getattr(new, k))) for k in Lookup.__dataclass_fields__))
            self.pending = []
        return np.array(out, np.int64), np.array(start, np.int64)


BUILT = "part int, bits binary, n_bits long, words binary, begun binary, v long, n long, quantised double"


def build(part: int, blobs: list[bytes], segments: int, settings: Settings) -> dict:
    """A segment's row: its bits, and its words' counts or its pairs' sums by first word."""
    row = {"part": part, "words": None, "begun": None, "v": 0, "n": 0, "quantised": 0.0}
    if part < segments:
        keys, counts = summed(*map(np.concatenate, zip(*map(unpack, blobs), strict=True)))
        row |= {"words": pack(keys, counts), "v": len(keys), "n": int(counts.sum()), "quantised": float(weight(level(counts)).sum())}
    else:
        context, keys, counts = summed_pairs(*map(np.concatenate, zip(*map(unpack_pairs, blobs), strict=True)))
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        total = np.add.reduceat(weight(level(counts)), first)
        row["begun"] = struct.pack("<I", len(first)) + context[first].astype("<u8").tobytes() + total.astype("<f8").tobytes() + np.diff(np.append(first, len(context))).astype("<i8").tobytes()
    bits = build_segment(counts, keys, settings)
    return row | {"bits": bits.tobytes(), "n_bits": 8 * len(bits)}


def unpack_begun(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = struct.unpack("<I", blob[:4])[0]
    return np.frombuffer(blob, "<u8", n, 4), np.frombuffer(blob, "<f8", n, 4 + 8 * n), np.frombuffer(blob, "<i8", n, 4 + 16 * n)


def joined(parts: list[tuple], empty: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    return tuple(map(np.concatenate, zip(*parts, strict=True))) if parts else tuple(np.zeros(0, k) for k in empty)


WORD, BEGUN = ("<u8", "<i8"), ("<u8", "<f8", "<i8")


def tabled(words: list[tuple], begun: list[tuple]) -> Table:
    """Lists of equal order by segment."""
    (key, n), (_, total, follow) = joined(words, WORD), joined(begun, BEGUN)
    return Table(key, n, total, follow.astype("<u4"))


def train(docs: DataFrame, segments: int, settings: Settings = Settings()) -> tuple[DataFrame, Sums, bool]:
    """(a row for each segment as `build` makes it, sums over all, whether the model may be broadcast)"""
    kinds = [(f.split()[0], f.split()[1]) for f in BUILT.split(", ")]
    arrow = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}

    def made(group: pa.Table) -> pa.Table:
        row = build(group.column("part")[0].as_py(), group.column("blob").to_pylist(), segments, settings)
        return pa.Table.from_arrays([pa.array([row[k]], arrow[t]) for k, t in kinds], names=[k for k, _ in kinds])

    ensure_checkpoints(docs.sparkSession)
    built = count_ngrams(docs, segments).groupBy("part").applyInArrow(made, BUILT).checkpoint()
    n, v, quantised, bits = (x or 0 for x in built.agg(F.sum("n"), F.sum("v"), F.sum("quantised"), F.sum("n_bits")).first())
    return built, Sums(n, v, quantised), bits <= settings.max_bits and v <= settings.max_words


def gathered(built: DataFrame, segments: int, sums: Sums, settings: Settings) -> Model:
    """At most max_bits bits and max_words words."""
    parts, words, begun = {}, {}, {}
    for r in built.select("part", "bits", "words", "begun").toLocalIterator():
        parts[r.part] = bytes(r.bits)
        if r.words is not None:
            words[r.part] = unpack(bytes(r.words))
        else:
            begun[r.part] = unpack_begun(bytes(r.begun))
    return Model(settings, segments, parts, sums, tabled(*([x[k] for k in sorted(x)] for x in (words, begun))))


def score(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows, spark = id_text(docs, id_col, text_col), docs.sparkSession
    segments = 1 << max(0, (partitions(spark, docs) - 1).bit_length())
    if int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > settings.max_bytes:
        return _asked(rows, segments, settings)
    built, sums, small = train(rows, segments, settings)
    if not small:
        return _asked(rows, segments, settings)
    sent = spark.sparkContext.broadcast(gathered(built, segments, sums, settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        lexicon = Lexicon(m)
        for ids, texts in blocks(batches):
            token, start = lexicon.of(texts)
            before = np.concatenate((token[:1], token[:-1]))
            before[start] = 0
            first = lexicon.words.hash[before]
            found = m.levels(first, pair_key(first, lexicon.words.hash[token]), 1)
            yield pa.RecordBatch.from_arrays(columns(ids, lexicon.words, before, token, start, found, sums, settings), names=NAMES)

    return rows.mapInArrow(run, SCHEMA)


def spread_words(rows: DataFrame, settings: Settings, sample: int = 2000, chars: int = 4096) -> np.ndarray:
    """Sorted hashes of the words that may begin more than `spread` pairs, by the beginnings of about `sample` rows. Which words
    these are decides where their pairs go, not whether they count."""
    n = rows.count()
    share = min(1.0, sample / max(n, 1))
    found: Counter = Counter()
    picked = rows if share == 1 else rows.sample(share, seed=0)
    for r in picked.select(F.substring("text", 1, chars).alias("text"), F.length("text").alias("n")).collect():
        scale = max(1.0, (r.n or 0) / chars) / share
        for w, c in Counter((r.text or "").encode().lower().split()).items():
            found[w] += c * scale
    hot = [w for w, c in found.most_common(1 << 15) if c > settings.spread]
    hashes = [WordHashes().of(hot)] if hot else []
    return np.unique(np.concatenate([*hashes, np.array([END] if n > settings.spread else [], np.uint64)]))


class Numbered(dict):
    """word -> its number in order of first use; 0 is the end token."""

    def __init__(self):
        super().__init__({b"": 0})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n

    def hashes(self) -> np.ndarray:
        out = WordHashes(limit=len(self)).of(list(self))
        out[0] = END
        return out


def small_ints(x: np.ndarray) -> bytes:
    """Numbers from 0, a byte for most."""
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype("<i8").tobytes()


def from_small(blob: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    """(numbers, where the next ones begin)"""
    out = np.frombuffer(blob, np.uint8, n, at).astype(np.int64)
    large = out == 255
    more = int(large.sum())
    out[large] = np.frombuffer(blob, "<i8", more, at + n)
    return out, at + n + 8 * more


def pack_asked(words: np.ndarray, runs: np.ndarray, hot: np.ndarray, pair: np.ndarray, counts: np.ndarray) -> bytes:
    """runs: number of pairs of each word, then of each spread word in `hot` (places in the list of these); pairs take 6 bytes."""
    body = zstandard.ZstdCompressor(level=1).compress(small_ints(runs) + hot.astype("<u2").tobytes() + small_ints(counts))
    keys = np.ascontiguousarray(pair.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
    return struct.pack("<III", len(words), len(hot), len(pair)) + words.astype("<u8").tobytes() + keys.tobytes() + body


def unpack_asked(blob: bytes) -> tuple[np.ndarray, ...]:
    n, h, m = struct.unpack("<III", blob[:12])
    at = 12 + 8 * n
    keys = np.zeros((m, 8), np.uint8)
    keys[:, :6] = np.frombuffer(blob, np.uint8, 6 * m, at).reshape(m, 6)
    body = zstandard.ZstdDecompressor().decompress(blob[at + 6 * m :])
    runs, at = from_small(body, n + h, 0)
    counts, _ = from_small(body, m, at + 2 * h)
    return np.frombuffer(blob, "<u8", n, 12), runs, np.frombuffer(body, "<u2", h, at), keys.view("<u8").ravel(), counts


def places(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Place of each key in the sorted list, or -1."""
    if not len(among):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return np.where(among[at] == keys, at, -1)


def routed(first: np.ndarray, second: np.ndarray, part: np.ndarray, hot: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted pairs by segment, those of spread first words last in each; and where each half of a segment begins. A pair
    goes to its first word's segment, or if that word is spread to its second word's."""
    to = np.where(hot[first] >= 0, 2 * part[second] + 1, 2 * part[first])
    return np.argsort(to.astype(np.uint16 if segments < 1 << 15 else np.int64), kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(to, minlength=2 * segments))))


def block_rows(p: int, ids: list, size: np.ndarray, token: np.ndarray, lexicon: Numbered, spread: np.ndarray, segments: int) -> pa.RecordBatch:
    """A block's rows for the segments, with its distinct words and pairs and their counts in training texts; and one row, of part
    -1 - p, with the block itself: words by number."""
    hashes = lexicon.hashes()
    order = np.argsort(hashes, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    words, start = hashes[order], np.cumsum(size) - size
    key, _ = pair_places(rank[token], start, int(rank[0]))
    key <<= np.uint64(1)
    key |= np.repeat(np.fromiter(map(held_out, ids), bool, len(ids)), size)
    key.sort()
    pair = key >> np.uint64(1)
    new = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    counts = np.add.reduceat((~key & np.uint64(1)).astype(np.int64), new)
    first, second = (pair[new] >> S32).astype(np.int64), (pair[new] & LOW32).astype(np.int64)
    del key, pair, new
    part, hot = segment_of(words, segments), places(words, spread)
    at, begin = routed(first, second, part, hot, segments)
    first, second, counts = first[at], second[at], counts[at]
    keys = pair_key(words[first], words[second])
    runs = np.where(hot >= 0, 0, np.bincount(first, minlength=len(words)))
    out = []
    for s, k in by_segment(words, segments):
        a, mid, z = begin[2 * s : 2 * s + 3].tolist()
        place, n = np.unique(hot[first[mid:z]], return_counts=True)
        out.append((s, pack_asked(words[k], np.concatenate((runs[k], n)), place, keys[a:z], counts[a:z])))
    planes = np.ascontiguousarray(np.concatenate((token, order.astype(np.uint32))).astype("<u4").view(np.uint8).reshape(-1, 4).T)
    known = np.array([i is not None for i in ids])
    own = size.astype("<i8").tobytes() + known.astype(np.uint8).tobytes() + np.array([i or 0 for i in ids], "<i8").tobytes() + places(spread, words).astype("<i8").tobytes() + planes.tobytes()
    out.append((-1 - p, struct.pack("<III", len(ids), len(token), len(order)) + zstandard.ZstdCompressor(level=1).compress(own)))
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([p] * len(out), pa.int64()), pa.array([b for _, b in out], pa.binary())], names=["part", "p", "blob"])


def unpack_block(blob: bytes, spread: int) -> tuple:
    """(ids, sizes, tokens as places in order of hash, place of the end token, places of spread words or -1)"""
    d, t, w = struct.unpack("<III", blob[:12])
    own = zstandard.ZstdDecompressor().decompress(blob[12:])
    size, known, ids = np.frombuffer(own, "<i8", d), np.frombuffer(own, np.uint8, d, 8 * d), np.frombuffer(own, "<i8", d, 9 * d)
    hot = np.frombuffer(own, "<i8", spread, 17 * d)
    planes = np.ascontiguousarray(np.frombuffer(own, np.uint8, 4 * (t + w), 17 * d + 8 * spread).reshape(4, -1).T).view("<u4").ravel()
    rank = np.empty(w, np.uint32)
    rank[planes[t:]] = np.arange(w, dtype=np.uint32)
    return [i if k else None for i, k in zip(ids.tolist(), known.tolist(), strict=True)], size, rank[planes[:t]], int(rank[0]), hot


def pair_places(token: np.ndarray, start: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word before << 32 | place of the word, place of the word before)"""
    before = np.concatenate((token[:1], token[:-1]))
    before[start] = end
    key = before.astype(np.uint64)
    key <<= S32
    key |= token
    return key, before


def settle(blobs: list[bytes], spread: int, settings: Settings) -> tuple[list[bytes], dict]:
    """A segment: its filters are made from all blocks' words and pairs, and probed for each block's; (answers, sums)"""
    asked = [unpack_asked(b) for b in blobs]
    keys, place = np.unique(np.concatenate([x[0] for x in asked]), return_inverse=True)
    ends = np.cumsum([len(x[0]) for x in asked])
    own = [np.concatenate((w, len(keys) + x[2].astype(np.int64))) for w, x in zip(np.split(place, ends[:-1]), asked, strict=True)]
    first = np.concatenate([np.repeat(w, x[1]) for w, x in zip(own, asked, strict=True)])  # spread words stand behind the segment's own
    pair, counts = np.concatenate([x[3] for x in asked]), np.concatenate([x[4] for x in asked])
    sizes = np.cumsum([len(x[3]) for x in asked])
    del asked
    count = np.bincount(first, counts, len(keys) + spread).astype(np.int64)
    order = np.argsort(pair << np.uint64(16) | first.astype(np.uint64) & np.uint64(0xFFFF))  # pairs have 48 bits
    new = np.concatenate(([True], (pair[order[1:]] != pair[order[:-1]]) | (first[order[1:]] != first[order[:-1]])))[: len(order)]
    at = np.flatnonzero(new)
    counts = np.add.reduceat(counts[order], at) if len(at) else counts
    first, pair = first[order[at]], pair[order[at]]
    where = np.empty(len(order), np.int64)
    where[order] = np.cumsum(new) - 1
    del order, new, at
    trained = counts > 0
    total = np.bincount(first[trained], weight(level(counts[trained])), len(keys) + spread).astype(np.int64)
    follow = np.bincount(first[trained], minlength=len(keys) + spread)

    def probed(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        bits = build_segment(counts[counts > 0], keys[counts > 0], settings)
        return levels(bits, np.zeros(1, np.int64), np.array([8 * len(bits)], np.uint64), np.zeros(len(keys), np.int64), keys, settings.hashes)

    n = len(keys)  # among them are spread words, with no pairs and no count here
    single, double = probed(keys, count[:n]), probed(pair, counts).astype(np.uint8)[where]
    out = []
    for w, a, z in zip(own, [0, *sizes[:-1].tolist()], sizes.tolist(), strict=True):
        w = w[w < n]
        body = b"".join(small_ints(x[w]) for x in (single, count, total, follow)) + double[a:z].tobytes()
        out.append(struct.pack("<II", len(w), z - a) + zstandard.ZstdCompressor(level=1).compress(body))
    seen = count[:n][count[:n] > 0]
    return out, {"v": len(seen), "n": int(seen.sum()), "quantised": float(weight(level(seen)).sum()), "hot": np.stack((count[n:], total[n:], follow[n:])).astype("<i8").tobytes()}


def unpack_answer(blob: bytes) -> tuple[np.ndarray, ...]:
    """(level, count, sum of weights and number of pairs of each word; levels of the pairs)"""
    n, m = struct.unpack("<II", blob[:8])
    body, at, out = zstandard.ZstdDecompressor().decompress(blob[8:]), 0, []
    for _ in range(4):
        x, at = from_small(body, n, at)
        out.append(x)
    return *out, np.frombuffer(body, np.uint8, m, at)


def _asked(rows: DataFrame, segments: int, settings: Settings) -> DataFrame:
    """The same scores for a model of any size: it is not sent out, but asked. Texts are split into words once; a block of about
    `block` tokens sends its distinct words and pairs to their segments, each segment builds its filters and answers every block."""
    spark = rows.sparkSession
    ensure_checkpoints(spark)
    spread = spread_words(rows, settings)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId() << 24
        lexicon, ids, size, token, n = Numbered(), [], [], [], 0
        for some, texts in blocks(batches):
            found: list[int] = []
            for t in texts:
                at = len(found)
                found += map(lexicon.__getitem__, t.lower().split())
                found.append(0)
                size.append(len(found) - at)
            ids += some
            token.append(np.array(found, np.uint32))
            n += len(found)
            if n > settings.block:
                yield block_rows(p, ids, np.array(size), np.concatenate(token), lexicon, spread, segments)
                p, lexicon, ids, size, token, n = p + 1, Numbered(), [], [], [], 0
        if ids:
            yield block_rows(p, ids, np.array(size), np.concatenate(token), lexicon, spread, segments)

    def answer(group: pa.Table) -> pa.Table:
        part, p, blobs = (group.column(k) for k in ("part", "p", "blob"))
        answers, sums = ([], {}) if part[0].as_py() < 0 else settle(blobs.to_pylist(), len(spread), settings)
        once = lambda k, kind: pa.array([sums.get(k), *[None] * (len(part) - 1)], kind)
        return pa.Table.from_arrays([part, p, pa.array(answers, pa.binary()) if answers else blobs, once("v", pa.int64()), once("n", pa.int64()), once("quantised", pa.float64()), once("hot", pa.binary())], names=["part", "p", "blob", "v", "n", "quantised", "hot"])

    settled = rows.mapInArrow(ask, "part long, p long, blob binary").groupBy("part").applyInArrow(answer, "part long, p long, blob binary, v long, n long, quantised double, hot binary").checkpoint()
    n, v, quantised = (x or 0 for x in settled.agg(F.sum("n"), F.sum("v"), F.sum("quantised")).first())

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((3, len(spread)), np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                out += np.frombuffer(x, "<i8").reshape(out.shape)
        yield pa.RecordBatch.from_pydict({"hot": pa.array([out.tobytes()], pa.binary())})

    hot = np.zeros((3, len(spread)), np.int64)
    if len(spread):
        for r in settled.where("hot IS NOT NULL").select("hot").mapInArrow(added, "hot binary").collect():
            hot += np.frombuffer(r.hot, "<i8").reshape(hot.shape)
    seen = hot[0][hot[0] > 0]
    sums = Sums(n + int(seen.sum()), v + len(seen), quantised + float(weight(level(seen)).sum()))

    def tell(group: pa.Table) -> pa.Table:
        rest = sorted(zip(group.column("part").to_pylist(), group.column("blob").to_pylist(), strict=True))
        ids, size, token, end, own = unpack_block(rest.pop(0)[1], len(spread))
        parts, answers = [s for s, _ in rest], [unpack_answer(b) for _, b in rest]
        part = np.repeat(np.array(parts, np.int64), [len(x[0]) for x in answers])
        single, count, total, follow = (np.concatenate([x[k] for x in answers]) for k in range(4))
        here = np.flatnonzero(own >= 0)
        at = own[here]
        single[at] = np.where(hot[0][here] > 0, level(np.maximum(hot[0][here], 1)), 0)
        count[at], total[at], follow[at] = hot[:, here]
        place = np.full(len(part), -1, np.int64)
        place[at] = here
        start = np.cumsum(size) - size
        key, before = pair_places(token, start, end)
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        pair = key[new]
        where = np.empty(len(order), np.uint32)
        where[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
        del key, order, new
        double = np.empty(len(pair), np.uint8)
        double[routed((pair >> S32).astype(np.int64), (pair & LOW32).astype(np.int64), part, place, segments)[0]] = np.concatenate([x[4] for x in answers])
        del pair, answers, rest
        words, out = Lookup(np.zeros(0, np.uint64), count, single, total.astype(float), follow), []
        for a, z in runs_of(size.tolist(), 1 << 18):
            k = slice(start[a], start[z - 1] + size[z - 1])
            out.append(pa.Table.from_arrays(columns(ids[a:z], words, before[k], token[k], start[a:z] - start[a], double[where[k]].astype(np.int64), sums, settings), names=NAMES))
        return pa.concat_tables(out)

    return settled.select("part", "p", "blob").groupBy("p").applyInArrow(tell, SCHEMA)
