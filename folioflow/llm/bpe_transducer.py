"""Byte-level BPE with a minimal acyclic transducer as lexicon.

Words (pieces that the pre-tokenizer's pattern finds) are counted over all texts. The `lexicon_words` most frequent are compiled
into a minimal acyclic automaton with shared suffixes; the outputs on its arcs sum to the word's number, which leads to its token
ids. The file is memory-mapped by the workers and walked for all new words of a block at once; words that it lacks are merged
exactly by rank. Decoding turns ids back into bytes.

The vocabulary file is a parameter. Defined results: a null or empty text has no tokens (digests of nothing); repeated rows give
repeated rows; an empty table gives an empty table; extra columns are ignored. The special token's own string in a text becomes
its id, as the tokenizers library has it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import struct
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .common import blocks, id_text

#: Fixed value: the pre-tokenizer's pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEXICON_WORDS = 1 << 16


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_signs() -> dict[str, int]:
    """Sign that stands for a byte in the vocabulary -> byte: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Vocabulary:
    """Token bytes, special tokens, the ranks of the pairs of ids that merge (by first id), and the id that each rank makes."""

    def __init__(self, text: str):
        data, sign = json.loads(text), byte_signs()
        ids = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"] if t["special"]}
        self.token = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for t, n in ids.items():
            self.token[n] = bytes(sign[c] for c in t)
        for t, n in self.special.items():
            self.token[n] = t.encode()
        self.first = [ids[c] for c, _ in sorted(sign.items(), key=lambda x: x[1])]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"])
        pairs = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        self.ranks: list[dict[int, int]] = [{} for _ in self.token]
        for n, (a, b, _) in enumerate(pairs):
            self.ranks[a][b] = n
        self.merged = [c for _, _, c in pairs]

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Exact BPE: the pair of least rank is merged first, of equal ones the leftmost."""
        ids, never, all_ranks, merged = [self.first[b] for b in word], len(self.merged), self.ranks, self.merged
        if len(ids) > 48:
            return self._merge_long(ids)
        ranks = [all_ranks[a].get(b, never) for a, b in pairwise(ids)]
        while ranks and (least := min(ranks)) < never:
            k = ranks.index(least)
            ids[k : k + 2] = [merged[least]]
            del ranks[k]
            if k:
                ranks[k - 1] = all_ranks[ids[k - 1]].get(ids[k], never)
            if k < len(ranks):
                ranks[k] = all_ranks[ids[k]].get(ids[k + 1], never)
        return tuple(ids)

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same in n log n steps."""
        n = len(ids)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := self.ranks[ids[k]].get(ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = after[k] if live[k] else n
            if not live[k] or j >= n or ids[k] != a or ids[j] != b:
                continue
            ids[k], live[j], after[k] = self.merged[r], False, after[j]
            if after[j] < n:
                before[after[j]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (r := self.ranks[ids[x]].get(ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return tuple(i for i, ok in zip(ids, live, strict=True) if ok)


def compile_transducer(entries: dict[bytes, tuple[int, ...]]) -> bytes:
    """Sorted words are added one by one; states that are complete are replaced by equal ones that are known (shared suffixes)."""
    words = sorted(w for w in entries if w)
    known: dict[tuple, int] = {}
    arcs: list[tuple[tuple[int, int], ...]] = []
    final: list[bool] = []
    path: list[tuple[dict[int, int], list[bool]]] = [({}, [False])]

    def settle(depth: int, last: bytes) -> None:
        while len(path) - 1 > depth:
            out, end = path.pop()
            key = (tuple(sorted(out.items())), end[0])
            state = known.get(key)
            if state is None:
                state = known[key] = len(arcs)
                arcs.append(key[0])
                final.append(end[0])
            path[-1][0][last[len(path) - 1]] = state

    last = b""
    for w in words:
        same = os.path.commonprefix((w, last))
        settle(len(same), last)
        path.extend(({}, [False]) for _ in w[len(same) :])
        path[-1][1][0] = True
        last = w
    settle(0, last)
    root = len(arcs)
    arcs.append(tuple(sorted(path[0][0].items())))
    final.append(False)
    below = [0] * len(arcs)
    key, target, output = [], [], []
    for state, out in enumerate(arcs):  # states come after those they lead to
        number = int(final[state])
        for byte, to in out:
            key.append(state << 8 | byte)
            target.append(to)
            output.append(number)
            number += below[to]
        below[state] = number
    ids = [entries[w] for w in words]
    ends = np.cumsum([0, *map(len, ids)])
    parts = [np.array(key, "<i8"), np.array(target, "<i4"), np.array(output, "<i4"), np.array(final, np.uint8), ends.astype("<i4"), np.fromiter(chain.from_iterable(ids), "<i4")]
    return struct.pack("<7q", root, *map(len, parts)) + b"".join(p.tobytes() for p in parts)


class Transducer:
    """A compiled lexicon, used in place (from a memory map or bytes)."""

    def __init__(self, buffer):
        self.root, *sizes = struct.unpack_from("<7q", buffer, 0)
        at, parts = 56, []
        for n, kind in zip(sizes, ("<i8", "<i4", "<i4", "u1", "<i4", "<i4"), strict=True):
            parts.append(np.frombuffer(buffer, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self.key, self.target, self.output, self.final, self.ends, self.ids = parts

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 if the lexicon lacks it; all words take a step at once."""
        out = np.full(len(words), -1, np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        start = np.cumsum(size) - size
        alive = np.flatnonzero(size > 0) if len(self.key) else np.zeros(0, np.int64)
        state, total = np.full(len(alive), self.root, np.int64), np.zeros(len(alive), np.int64)
        step = 0
        while len(alive):
            want = state << 8 | text[start[alive] + step]
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            ok = self.key[at] == want
            alive, at = alive[ok], at[ok]
            state, total = self.target[at].astype(np.int64), total[ok] + self.output[at]
            step += 1
            done = size[alive] == step
            hit = done & (self.final[state] > 0)
            out[alive[hit]] = total[hit]
            alive, state, total = alive[~done], state[~done], total[~done]
        return out

    def lookup(self, words: list[bytes]) -> list[tuple[int, ...] | None]:
        return [tuple(self.ids[self.ends[n] : self.ends[n + 1]].tolist()) if n >= 0 else None for n in self.numbers(words).tolist()]


#: Texts of characters below this one are cut by a pattern with its letters, digits and spaces spelled out, in half the time.
NEAR = 0x250


def near_pattern() -> str:
    """PATTERN for characters below NEAR."""
    import regex

    def ranges(kind: str) -> str:
        return "".join(f"\\u{ord(run[0]):04x}-\\u{ord(run[-1]):04x}" for run in regex.findall(f"{kind}+", "".join(map(chr, range(NEAR)))))

    letters, digits, space = map(ranges, (r"\p{L}", r"\p{N}", r"\s"))
    return f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{space}{letters}{digits}]+|[{space}]+(?![^{space}])|[{space}]+"


def splitter(special: Iterable[str]) -> Callable[[str], list[str]]:
    """Cuts a text into the pre-tokenizer's pieces; special strings are pieces of their own."""
    import regex

    every, near, far = regex.compile(PATTERN).findall, re.compile(near_pattern()).findall, re.compile(f"[^\0-{chr(NEAR - 1)}]").search
    special = frozenset(special)

    def find(text: str) -> list[str]:
        return every(text) if far(text) else near(text)

    if not special:
        return find
    cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special))) + ")").split

    def pieces(text: str) -> list[str]:
        if not any(s in text for s in special):
            return find(text)
        return list(chain.from_iterable([p] if p in special else find(p) for p in cut(text)))

    return pieces


class Encoder:
    """Pieces of text to ids. `cache` holds the words seen by this worker; past `limit` words it is emptied."""

    def __init__(self, vocabulary: Vocabulary, lexicon: bytes | None = None, limit: int = 500_000):
        self.vocabulary, self.limit = vocabulary, limit
        self.pieces = splitter(vocabulary.special)
        self.decimal = list(map(str, range(len(vocabulary.token))))
        self.words: Transducer | None = None
        self.cache: dict[str, tuple[int, ...]] = {}
        if lexicon is not None:
            with tempfile.NamedTemporaryFile(prefix="lexicon-") as f:  # the map outlives the name
                f.write(lexicon)
                f.flush()
                self.words = Transducer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def learn(self, pieces: list[list[str]]) -> None:
        if len(self.cache) > self.limit:
            self.cache.clear()
        new = set().union(*pieces).difference(self.cache)
        special = self.vocabulary.special
        words = [w for w in new if w not in special]
        raw = [w.encode() for w in words]
        found = self.words.lookup(raw) if self.words else [None] * len(raw)
        self.cache.update((w, self.vocabulary.merge(b) if ids is None else ids) for w, b, ids in zip(words, raw, found, strict=True))
        self.cache.update((w, (special[w],)) for w in new if w in special)

    def encode(self, texts: list[str]) -> list[list[int]]:
        pieces = [self.pieces(t) for t in texts]
        self.learn(pieces)
        return [list(chain.from_iterable(map(self.cache.__getitem__, p))) for p in pieces]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, SHA-256 of the ids in decimal, SHA-256 of the decoded text)"""
        out = []
        for ids in self.encode(texts):
            written = ",".join(map(self.decimal.__getitem__, ids))
            out.append((len(ids), hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.vocabulary.token.__getitem__, ids)).decode("utf-8", "replace")


def frequent_words(docs: DataFrame, vocabulary: Vocabulary, words: int = LEXICON_WORDS) -> list[str]:
    """The most frequent pieces of all texts; ties go to the lesser string."""
    special = set(vocabulary.special)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = splitter(special)
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
            seen.clear()
            return batch

        for _, texts in blocks(batches):
            for t in texts:
                seen.update(pieces(t.decode()))
            if len(seen) > 300_000:
                yield out()
        yield out()

    counted = docs.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(~F.col("word").isin(*special) if special else F.lit(True))
    # Each task would send its own first words to the driver. A histogram of the counts, in eighths of an octave, tells which
    # counts can be among the first, so that little more than the lexicon is sent.
    counted = counted.withColumn("level", F.floor(F.log2("n") * 8)).persist(StorageLevel.DISK_ONLY)
    try:
        least, above = 0, 0
        for level, n in counted.groupBy("level").count().orderBy(F.desc("level")).collect():  # at most 8 * 63 levels
            least, above = level, above + n
            if above >= words:
                break
        first = counted.where(F.col("level") >= least).orderBy(F.desc("n"), "word").limit(words)  # a bounded lexicon is the feature
        return [r.word for r in first.collect()]
    finally:
        counted.unpersist()


def build_lexicon(docs: DataFrame, vocabulary: Vocabulary, words: int = LEXICON_WORDS) -> bytes:
    return compile_transducer({w.encode(): vocabulary.merge(w.encode()) for w in frequent_words(docs, vocabulary, words)})


#: The encoder of the query that this worker runs, with its cache, for all its tasks.
_HELD: dict[str, Encoder] = {}


def _encoders(docs: DataFrame, path: str | None, words: int):
    """A function that gives the worker's encoder."""
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        text = f.read()
    lexicon = build_lexicon(docs, Vocabulary(text), words)
    sent, name = docs.sparkSession.sparkContext.broadcast((text, lexicon)), uuid.uuid4().hex

    def get() -> Encoder:
        if name not in _HELD:
            _HELD.clear()
            source, compiled = sent.value
            _HELD[name] = Encoder(Vocabulary(source), compiled)
        return _HELD[name]

    return get


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, ids array<int>)"""
    rows = id_text(docs, id_col, text_col)
    get = _encoders(rows, vocabulary, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "ids": pa.array(get().encode([t.decode() for t in texts]), pa.list_(pa.int32()))})

    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids are an empty text."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        sent = tokens.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(sent.value))
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": [encoder.decode(i or []) for i in batch.column(1).to_pylist()]})

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, words: int = LEXICON_WORDS) -> DataFrame:
    """Encodes and decodes every text; one row of digests for each."""
    rows = id_text(docs, id_col, text_col)
    get = _encoders(rows, vocabulary, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches):
            n, written, back = zip(*get().digests([t.decode() for t in texts]), strict=True)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": list(written), "decoded_sha256": list(back)})

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
