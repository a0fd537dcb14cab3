"""Repeated phrases located by sharded Aho-Corasick automata.

A word is removed if it is covered by a window of `WINDOW` words whose sequence also starts anywhere else. Recurring passages are
confirmed first: a shard (a group of documents) sends one hash for each distinct window whose anchor (see repeat_groups, K words)
occurs twice to the hash's bucket, which answers whether the window occurs again. Of each confirmed window the shard keeps its
hash and its anchor phrase, not where it stands. It then compiles the phrases into an automaton and streams all its documents
through it, every word of each; what is removed follows from the automaton's hits alone: around each, the windows that hold the
phrase are looked up among the confirmed ones. Phrases go only to shards whose documents contain them.

pyahocorasick searches a node's edges one by one, so a word is spelled in `BASE` signs, of a width that the number of words in
phrases asks for; words of no phrase are spelled in a sign of their own. An automaton holds `PHRASES` phrases at most; a shard
with more makes several and streams its documents through each, so memory is bounded.

Windows are compared by 64-bit hashes of their words' hashes. Defined results: a null or empty text has no words; texts under
WINDOW words lose nothing; repeated rows count as occurrences elsewhere; null ids are kept apart like others; a very long text is
a group of its own size; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, pair_hash
from .repeat_groups import BLOB, Anchors, anchors, answers, bucketed, dealt, distinct, ends_by_bucket, load, mix, replies_of, sends, settle

WINDOW, K = 35, 8
PHRASES, BASE = 100_000, 32
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Words:
    """A group's words, their hashes, and hashes of the windows."""

    def __init__(self, texts: list[bytes]):
        self.words = [t.split() for t in texts]
        self.size = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.start = np.cumsum(self.size) - self.size
        cache = WordHashes(3)
        self.hash = np.concatenate([np.zeros(0, np.uint64), *map(cache.of, self.words)])
        one = np.concatenate((self.hash, np.zeros(WINDOW, np.uint64)))
        two = pair_hash(one[:-1], one[1:])
        four = pair_hash(two[:-2], two[2:])
        eight = pair_hash(four[:-4], four[4:])
        sixteen = pair_hash(eight[:-8], eight[8:])
        most = pair_hash(sixteen[:-16], sixteen[16:])
        n = len(self.hash)
        self.window = pair_hash(pair_hash(most[:n], two[32 : 32 + n]), one[34 : 34 + n])
        self.phrase = eight[:n]
        self.anchors: Anchors = anchors(self.phrase, self.start, self.size, WINDOW, K)

    def offered(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        own, many, place = distinct(bucketed(self.anchors.hash, buckets), None)
        return own, many, place, ends_by_bucket(own, buckets)

    def candidates(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window starts of flagged anchors, the anchors' places)"""
        a = self.anchors
        some = np.flatnonzero(flags)
        n = a.last[some] - a.first[some] + 1
        start = np.repeat(a.first[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return start, np.repeat(a.at[some], n)

    def windows(self, flags: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct hashes ordered by bucket, marks of repeated ones, ends of the buckets, an anchor's place for each)"""
        start, at = self.candidates(flags)
        own, first, times = np.unique(self.window[start], return_index=True, return_counts=True)
        bucket = (mix(own) >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(1, buckets + 1), "left")
        return own[order], times[order] > 1, ends, at[first[order]]


def automata(phrases: np.ndarray):
    """(automaton, sorted hashes of the words it knows, their spelling and that of all other words) for each PHRASES phrases;
    phrases: [n, K] word hashes, distinct."""
    import ahocorasick

    for at in range(0, len(phrases), PHRASES):
        known, code = np.unique(phrases[at : at + PHRASES], return_inverse=True)
        width = 1
        while BASE**width < len(known):
            width += 1
        signs = (ord("A") + np.arange(len(known) + 1)[:, None] // BASE ** np.arange(width) % BASE).astype(np.uint8)
        signs[-1] = ord("0")
        machine = ahocorasick.Automaton()
        for row in signs[code.reshape(-1, K)].reshape(-1, K * width):
            machine.add_word(row.tobytes().decode(), True)
        machine.make_automaton()
        yield machine, known, signs


def occurrences(words: Words, phrases: np.ndarray) -> np.ndarray:
    """Places where one of the phrases begins: every document is streamed, whole, through each automaton."""
    found: list[int] = []
    for machine, known, signs in automata(phrases):
        at = np.minimum(np.searchsorted(known, words.hash), len(known) - 1)
        spelled, width = signs[np.where(known[at] == words.hash, at, len(known))], signs.shape[1]
        for begin, n in zip(words.start.tolist(), words.size.tolist(), strict=True):
            for stop, _ in machine.iter(spelled[begin : begin + n].tobytes().decode()):
                if not (stop + 1) % width:  # else the signs of two words only look like another's
                    found.append(begin + (stop + 1) // width - K)
    return np.unique(np.array(found, np.int64))


def covered(words: Words, places: np.ndarray, confirmed: np.ndarray) -> np.ndarray:
    """Which words lie in a confirmed window around one of the places. confirmed: sorted hashes."""
    n = len(words.hash)
    cover = np.zeros(n + 1, np.int32)
    if not len(places) or not len(confirmed):
        return cover[:n] > 0
    filled = np.flatnonzero(words.size > 0)
    doc = filled[np.searchsorted(words.start[filled], places, "right") - 1]
    first, last = words.start[doc], words.start[doc] + words.size[doc] - WINDOW
    hit = np.zeros(n, bool)
    for d in range(WINDOW - K + 1):
        s = places - d
        s = s[(s >= first) & (s <= last)]
        s = s[~hit[s]]
        h = words.window[s]
        at = np.minimum(np.searchsorted(confirmed, h), len(confirmed) - 1)
        hit[s[confirmed[at] == h]] = True
    s = np.flatnonzero(hit)
    np.add.at(cover, s, 1)
    np.add.at(cover, s + WINDOW, -1)
    return np.cumsum(cover[:-1]) > 0


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    spread, plan = dealt(docs, id_col, text_col)
    blob = pa.schema([("bucket", pa.int32()), ("p", pa.int32()), ("blob", pa.binary())])

    def offer(group: pa.Table) -> pa.Table:
        own, many, _, ends = Words(load(group)[1]).offered(plan.buckets)
        return pa.Table.from_pydict(sends(own, many, group.column("p")[0].as_py(), plan.buckets, ends, "<u4"))

    def flags_of(words: Words, reply: pa.Table) -> np.ndarray:
        _, _, place, ends = words.offered(plan.buckets)
        return answers(replies_of(reply), ends)[place] if len(place) else np.zeros(0, bool)

    def describe(group: pa.Table, reply: pa.Table) -> pa.Table:
        if not group.num_rows:
            return blob.empty_table()
        words = Words(load(group)[1])
        own, many, ends, _ = words.windows(flags_of(words, reply), plan.buckets)
        return pa.Table.from_pydict(sends(own, many, group.column("p")[0].as_py(), plan.buckets, ends, "<u8"))

    def cut(group: pa.Table, reply: pa.Table) -> pa.Table:
        ids, texts = load(group)
        words = Words(texts)
        kind = reply.column("kind").to_numpy()
        one, two = (reply.filter(pa.array(kind == k)) for k in (1, 2))
        gone = np.zeros(len(words.hash), bool)
        flags = flags_of(words, one)
        if flags.any():
            own, _, ends, at = words.windows(flags, plan.buckets)
            again = answers(replies_of(two), ends)
            anchors_at = np.unique(at[again])
            _, first = np.unique(words.phrase[anchors_at], return_index=True)
            phrases = words.hash[anchors_at[first][:, None] + np.arange(K)]
            if len(phrases):
                gone = covered(words, occurrences(words, phrases), np.sort(own[again]))
        out = []
        for i, w, a in zip(ids, words.words, words.start.tolist(), strict=True):
            mark = gone[a : a + len(w)]
            n = int(mark.sum())
            kept = [x for x, m in zip(w, mark.tolist(), strict=True) if not m] if n else w
            out.append((i, len(w), n, hashlib.sha256(b" ".join(kept)).hexdigest()))
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.Table.from_arrays([pa.array(c, pa.string() if k == 3 else pa.int64()) for k, c in enumerate(cols)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    first = spread.groupBy("p").applyInArrow(offer, BLOB).groupBy("bucket").applyInArrow(lambda g: settle(g, "<u4"), BLOB)
    second = spread.groupBy("p").cogroup(first.groupBy("p")).applyInArrow(describe, BLOB).groupBy("bucket").applyInArrow(lambda g: settle(g, "<u8"), BLOB)
    both = first.withColumn("kind", F.lit(1)).unionByName(second.withColumn("kind", F.lit(2)))
    return spread.groupBy("p").cogroup(both.groupBy("p")).applyInArrow(cut, SCHEMA)
