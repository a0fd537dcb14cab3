"""SimHash near-duplicates: fingerprints, links at few differing bits, components.

Two fingerprints that differ in at most d bits share at least 8 - d of their 8 bytes in place. The inverted index has an entry for
each fingerprint under the bytes of each set of positions from a family such that every d positions are missed by some set (6
sets of 4 bytes for d = 2); so each pair to be linked meets under some entry. Pairs that meet are tallied by their positional
bytes in common, those that reach 8 - d stay, and the count of differing bits decides. Equal fingerprints are one entry. Runs
with more than `pair_limit` fingerprints under one entry are not paired: each one looks up all values within d bits among the
run's sorted fingerprints, which is linear in the run. Tasks return a star for each local component instead of pairs; the
components of the whole are found by alternating large-star and small-star steps over tables.

`keep_one` is for near copies: texts whose sets of five-word shingles have similarity 0.8 or more (`SIMILAR`). That is about 0.15
of the bits of a fingerprint, too many for 64, so the sets get fingerprints of 256 bits (`WORDS` of 64) and the same kind of index: the
sets of `WIDTH` = 2 byte positions inside each 64-bit word. Pairs that meet are tallied by their positional bytes in common; those
that reach `TALLY` of 32 and differ in at most `REACH` bits are proposed; the groups of what is proposed are then compared by their
shingle sets, and components are formed of the links of similarity 0.8 or more alone. A pair that shares more than 4 of its 32
bytes always meets; at similarity 0.8, where a byte is shared with chance 0.27, a pair meets with chance 0.989, at 0.85 with 0.998.
The chance doesn't depend on the number of texts; `WORDS` raises it. Entries with more than `pair_limit` fingerprints hold each
text only against those that nothing has reached yet; the work of an entry of unlike texts grows with its square, and an entry has
n / 65,536 texts, so for more than some 100 million texts a larger `WIDTH` with more `WORDS` is due.

Defined results: a null, empty or blank text has fingerprint 0, which is linked like any other; repeated rows each get the same
result; null ids don't count for the component's smallest id (a component of null ids only has id null); a very long text is
hashed in pieces; an empty table gives an empty table; extra columns are ignored (`keep_one` returns them, whatever their names).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import C1, blocks, ensure_checkpoints, id_text, mix, partitions

SEED = 42
WORDS, REACH, TALLY = 4, 62, 3  # 64-bit words of a wide fingerprint; most differing bits and least shared bytes of a proposal
WIDTH = 2  # byte positions of a set of the wide index
SIMILAR = (4, 5)  # least similarity of a near copy
BLOCK = 256  # texts that are held against each other in one step


def fingerprints(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """64-bit SimHash of each text as uint64."""
    import xxhash

    digest, join = xxhash.xxh64_intdigest, b" ".join
    size, hashes = np.zeros(len(texts), np.int64), []
    for k, t in enumerate(texts):
        words = t.lower().split()
        pieces = list(map(join, zip(*(words[n:] for n in range(shingle)), strict=False))) if len(words) >= shingle else [join(words)] if words else []
        size[k] = len(pieces)
        hashes += [digest(p, SEED) for p in pieces]
    out = np.zeros(len(texts), np.uint64)
    h = np.array(hashes, "<u8")
    ends = np.cumsum(size)
    for k in np.flatnonzero(size > 20_000).tolist():  # long texts in pieces
        own = h[ends[k] - size[k] : ends[k]]
        total = sum(np.unpackbits(own[a : a + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for a in range(0, len(own), 65_536))
        out[k] = np.packbits(2 * total > size[k], bitorder="little").view("<u8")[0]
    some = np.flatnonzero((size > 0) & (size <= 20_000))
    for at in range(0, len(some), 64):
        part = some[at : at + 64]
        own = np.concatenate([h[ends[k] - size[k] : ends[k]] for k in part.tolist()])
        bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total = np.add.reduceat(bits, np.cumsum(size[part]) - size[part], axis=0, dtype=np.int64)
        out[part] = np.packbits(2 * total > size[part][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint_rows(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) from (doc_id, text); fp is the fingerprint's signed reading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "fp": fingerprints(texts, shingle).view(np.int64)})

    return docs.mapInArrow(run, "doc_id long, fp long")


def position_sets(bits: int) -> list[int]:
    """Masks of the index: byte sets of which at least one is clear of any `bits` byte positions."""
    if not 0 <= bits <= 6:
        raise ValueError("links at 0 to 6 differing bits are supported")
    size = min(4, 8 - bits)
    missed = {frozenset(c) for c in combinations(range(8), bits)}
    sets = []
    while missed:
        best = max(combinations(range(8), size), key=lambda s: sum(not m & set(s) for m in missed))
        missed = {m for m in missed if m & set(best)}
        sets.append(sum(0xFF << 8 * p for p in best))
    return sets


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable number of each of 0..n-1 over the edges (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(up := root[root], root):
            root = up
        if np.array_equal(before, root):
            return root


def run_links(fp: np.ndarray, run: np.ndarray, bits: int, pair_limit: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Indices of linked pairs (each once or more) among fingerprints sorted by (run, fp)."""
    n = len(fp)
    first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    size = np.diff(np.append(first, n))
    left, right = [], []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        x = fp[i] ^ fp[j]
        shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        ok = shared >= 8 - bits
        ok[ok] = np.bitwise_count(x[ok]) <= bits
        left.append(i[ok])
        right.append(j[ok])

    of = np.repeat(size, size)
    end = np.repeat(first + size, size)
    small = np.flatnonzero((of > 1) & (of <= pair_limit))
    step = 1
    while len(small):
        small = small[small + step < end[small]]
        keep(small, small + step)
        step += 1
    flips = [np.uint64(sum(1 << b for b in c)) for d in range(1, bits + 1) for c in combinations(range(64), d)] if (size > pair_limit).any() else []
    for at, m in zip(first[size > pair_limit].tolist(), size[size > pair_limit].tolist(), strict=True):
        own = fp[at : at + m]
        same = ~np.bitwise_or.reduce(own ^ own[0])  # bits in which the whole run agrees need no flip
        for flip in flips:
            if flip & same:
                continue
            want = own ^ flip
            hit = np.minimum(np.searchsorted(own, want), m - 1)
            i = np.flatnonzero(own[hit] == want)
            i = i[hit[i] > i]
            keep(at + i, at + hit[i])
    return np.concatenate(left or [np.zeros(0, np.int64)]), np.concatenate(right or [np.zeros(0, np.int64)])


def link_stars(nodes: DataFrame, bits: int = 2) -> DataFrame:
    """(u, v): a star for each component that one task of the index sees. nodes: distinct fp."""
    masks = position_sets(bits)
    n_groups = 4 * partitions(nodes.sparkSession, nodes.select(F.explode(F.array(*[F.lit(k) for k in range(len(masks))]))), 4 << 20)

    def link(group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().view(np.uint64)
        kind = group.column("kind").to_numpy().astype(np.uint64)
        key = fp & np.array(masks, np.uint64)[kind.astype(np.int64)]
        order = np.lexsort((fp, key, kind))
        fp, key, kind = fp[order], key[order], kind[order]
        run = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])))) if len(fp) else key
        a, b = run_links(fp, run, bits)
        distinct, place = np.unique(fp, return_inverse=True)
        root = local_roots(len(distinct), place[a], place[b])
        own = np.flatnonzero(root != np.arange(len(root)))
        return pa.Table.from_pydict({"u": distinct[own].view(np.int64), "v": distinct[root[own]].view(np.int64)})

    index = nodes.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64)))).alias("h"), F.col("fp").alias("fp")) for k, m in enumerate(masks)])).alias("e"))
    index = index.select(F.pmod(F.col("e.h"), F.lit(n_groups)).alias("g"), "e.kind", "e.fp")
    return index.groupBy("g").applyInArrow(link, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(u, v): v is the smallest node of u's component, for each u that isn't. Alternates large-star and small-star steps."""
    ensure_checkpoints(edges.sparkSession)

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())

    def small_star(e: DataFrame) -> DataFrame:  # u > v in each row; a node has few smaller neighbours, so they fit a window
        low = F.min("v").over(W.partitionBy("u"))
        return e.select(F.when(F.col("v") > low, F.col("v")).otherwise(F.col("u")).alias("u"), low.alias("v")).distinct()

    def large_star(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct().checkpoint()
    before = state(now)
    while before[0]:
        now = small_star(large_star(now)).checkpoint()
        after = state(now)
        if after == before:
            break
        before = after
    return now


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    ensure_checkpoints(docs.sparkSession)
    rows = fingerprint_rows(id_text(docs, id_col, text_col), shingle).checkpoint()
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).checkpoint()
    return _named(rows, nodes, link_stars(nodes.select("fp"), bits))


def _named(rows: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    stars = components(links)
    rooted = nodes.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp")


def majority(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """[text, word]: bits that over half of a text's hashes have; h: [hash, word], `size` of them for each text."""
    out = np.zeros((len(size), h.shape[1]), np.uint64)
    ends = np.cumsum(size)
    filled = np.flatnonzero(size)
    for some in (filled[k : k + 1024] for k in range(0, len(filled), 1024)):
        cuts = [np.arange(e - n, e, 255) for e, n in zip(ends[some].tolist(), size[some].tolist(), strict=True)]  # sums of a stretch fit a byte
        owner = np.repeat(np.arange(len(some)), [len(c) for c in cuts])
        start = np.append(np.concatenate(cuts), ends[some[-1]])
        total = np.zeros((len(some), 64 * h.shape[1]), np.int64)
        for k in range(0, len(owner), 128):
            own = start[k : k + 129]
            bits = np.unpackbits(h[own[0] : own[-1]].view(np.uint8).reshape(own[-1] - own[0], -1), axis=1, bitorder="little")
            np.add.at(total, owner[k : k + 128], np.add.reduceat(bits, own[:-1] - own[0], axis=0, dtype=np.uint8).astype(np.int64))
        out[some] = np.packbits(2 * total > size[some][:, None], axis=1, bitorder="little").view("<u8")
    return out


def shingle_hashes(text: bytes, shingle: int = 5) -> np.ndarray:
    """Hashes of a text's shingles, repeats included."""
    import xxhash

    digest, join, w = xxhash.xxh64_intdigest, b" ".join, text.lower().split()
    pieces = map(join, zip(*(w[n:] for n in range(shingle)), strict=False)) if len(w) >= shingle else [join(w)] if w else []
    return np.fromiter((digest(p, SEED) for p in pieces), np.uint64)


def wide_fingerprints(hashes: list[np.ndarray], words: int = WORDS) -> np.ndarray:
    """[text, word] as uint64 from each text's shingle hashes; the first word is the fingerprint of 64 bits."""
    size = np.fromiter(map(len, hashes), np.int64, len(hashes))
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return majority(np.concatenate((h[:, None], mix(h[:, None] + C1 * np.arange(1, words, dtype=np.uint64))), axis=1), size)


def linked(x: np.ndarray) -> np.ndarray:
    """Of differences [..., word]: whether shared bytes and differing bits make a proposal."""
    ok = (x.view(np.uint8) == 0).sum(axis=-1) >= TALLY
    ok[ok] = np.bitwise_count(x[ok]).sum(axis=-1) <= REACH
    return ok


def spanning(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join each component of fp [node, word]. Each node is held only against those that nothing has reached yet."""
    left, a, b = np.arange(len(fp)), [], []
    while len(left):
        queue, left = [left[:1]], left[1:]
        while queue and len(left):
            front = queue.pop()
            at = 0
            while at < len(front) and len(left):
                part = front[at : at + max(1, (1 << 19) // len(left))]
                at += len(part)
                ok = linked(fp[part][:, None] ^ fp[left][None])
                hit = ok.any(axis=0)
                if hit.any():
                    a.append(part[ok.argmax(axis=0)[hit]])
                    b.append(left[hit])
                    queue.append(left[hit])
                    left = left[~hit]
    return np.concatenate(a or [left]), np.concatenate(b or [left])


def wide_roots(fp: np.ndarray, run: np.ndarray, place: np.ndarray, pair_limit: int = 64) -> np.ndarray:
    """Smallest node of the component of each of the nodes 0..max(place); entries (fp [entry, word], place of its node) are sorted by
    run, and proposed pairs of a run are links. Pairs that are joined already are not looked at, so copies cost next to nothing."""
    n = int(place.max(initial=-1)) + 1
    root = np.arange(n)

    def join(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return local_roots(n, root[place[i]], root[place[j]])[root] if len(i) else root

    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(run)), bool), run[1:] != run[:-1])))
    size = np.diff(np.append(first, len(run)))
    of, end = np.repeat(size, size), np.repeat(first + size, size)
    small = np.flatnonzero((of > 1) & (of <= pair_limit))
    step = 1
    while len(small):
        small = small[small + step < end[small]]
        apart = small[root[place[small]] != root[place[small + step]]]
        found = [part[linked(fp[part] ^ fp[part + step])] for part in (apart[k : k + (1 << 17)] for k in range(0, len(apart), 1 << 17))]
        if found:
            own = np.concatenate(found)
            root = join(own, own + step)
        step += 1
    for at, m in zip(first[size > pair_limit].tolist(), size[size > pair_limit].tolist(), strict=True):
        _, one = np.unique(root[place[at : at + m]], return_index=True)
        if len(one) > 1:
            a, b = spanning(fp[at : at + m])
            root = join(at + a, at + b)
    return root


ENTRY = np.dtype([("kind", "u1"), ("node", "<i8"), ("fp", "<u8", (WORDS,))])


def wide_stars(nodes: DataFrame, n: int) -> DataFrame:
    """(u, v): a star of nodes for each component that one task of the index sees. nodes: n rows of (node, fp); n sizes the tasks."""
    masks = np.array([sum(0xFF << 8 * p for p in c) for c in combinations(range(8), WIDTH)], np.uint64)
    kinds = WORDS * len(masks)
    groups = max(partitions(nodes.sparkSession), -(-n * kinds * ENTRY.itemsize >> 22))  # of 4 MB: few groups make few, large stars

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                fp = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u8").reshape(-1, WORDS)
                key = (fp[:, :, None] & masks).reshape(len(fp), kinds)
                g = (mix(key + C1 * np.arange(kinds, dtype=np.uint64)) % np.uint64(groups)).astype(np.int64).ravel()
                order = np.argsort(g, kind="stable")
                e = np.empty(len(order), ENTRY)
                e["kind"], e["node"], e["fp"] = order % kinds, part.column(0).to_numpy()[order // kinds], fp[order // kinds]
                cut = np.flatnonzero(np.diff(g[order], prepend=-1, append=groups))
                yield pa.RecordBatch.from_pydict({"g": pa.array(g[order][cut[:-1]]), "blob": pa.array([e[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary())})

    def link(group: pa.Table) -> pa.Table:
        e = np.concatenate([np.frombuffer(b, ENTRY) for b in group.column("blob").to_pylist()])
        kind = e["kind"].astype(np.int64)
        key = e["fp"][np.arange(len(e)), kind // len(masks)] & masks[kind % len(masks)]
        order = np.lexsort((key, kind))
        fp, node, key, kind = np.ascontiguousarray(e["fp"][order]), e["node"][order], key[order], kind[order]
        distinct, place = np.unique(node, return_inverse=True)
        root = wide_roots(fp, np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])))), place)
        own = np.flatnonzero(root != np.arange(len(root)))
        return pa.Table.from_pydict({"u": distinct[own], "v": distinct[root[own]]})

    return nodes.select("node", "fp").mapInArrow(entries, "g long, blob binary").groupBy("g").applyInArrow(link, "u long, v long")


def shingle_set(text: bytes, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(text, shingle))


def set_rows(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, tag, node, fp) from (doc_id, text): the hash of the text, the hash of its shingle set, and its wide fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for ids, texts in blocks(batches):
            sets = [shingle_set(t, shingle) for t in texts]
            tag = np.array([xxhash.xxh64_intdigest(t, 42) for t in texts], np.uint64)
            node = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64)
            fp = wide_fingerprints(sets)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "tag": tag.view(np.int64), "node": node.view(np.int64), "fp": pa.array([r.tobytes() for r in fp], pa.binary())})

    return docs.mapInArrow(run, "doc_id long, tag long, node long, fp binary")


def _stars(a: np.ndarray, b: np.ndarray) -> pa.Table:
    distinct, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = local_roots(len(distinct), place[: len(a)], place[len(a) :])
    own = np.flatnonzero(root != np.arange(len(root)))
    return pa.Table.from_pydict({"u": distinct[own], "v": distinct[root[own]]})


def similar_links(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links of exact similarity SIMILAR or more that join the components of sets. Each is held only against those not yet reached."""
    n, (num, den) = len(sets), SIMILAR
    size = np.array([len(s) for s in sets], np.int64)
    every, owner, left = np.concatenate(sets), np.repeat(np.arange(n), size), size > 0
    a, b = [], []
    for seed in range(n):
        if not left[seed]:
            continue
        left[seed], queue = False, [seed]
        while queue and left.any():
            one = queue.pop()
            own = sets[one]
            common = np.bincount(owner[own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every], minlength=n)
            hit = np.flatnonzero(left & ((num + den) * common >= num * (size[one] + size)))
            if len(hit):
                a.append(np.full(len(hit), one))
                b.append(hit)
                left[hit] = False
                queue += hit.tolist()
                stay = left[owner]
                every, owner = every[stay], owner[stay]
    none = np.zeros(0, np.int64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def similar_stars(held: DataFrame, n: int, key: list[str]) -> DataFrame:
    """(u, v): stars of links among the sets that share `key`. held: about n rows with node and own (the set's bytes)."""
    groups = max(4 * partitions(held.sparkSession), -(-n // (2 * BLOCK)))

    def link(group: pa.Table) -> pa.Table:
        k, node, own = group.column("k").to_numpy(), group.column("node").to_numpy(), group.column("own")
        order = np.lexsort((node, k))
        a, b = [], []
        for part in np.split(order, np.flatnonzero(np.diff(k[order])) + 1):
            part = part[np.concatenate(([True], node[part][1:] != node[part][:-1]))]
            if len(part) > 1:
                i, j = similar_links([np.frombuffer(x, "<u8") for x in own.take(pa.array(part)).to_pylist()])
                a.append(node[part[i]])
                b.append(node[part[j]])
        return _stars(np.concatenate(a), np.concatenate(b)) if a else pa.Table.from_pydict({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})

    k = F.xxhash64(*key)
    return held.select(F.pmod(k, F.lit(groups)).alias("g"), k.alias("k"), "node", "own").groupBy("g").applyInArrow(link, "u long, v long")


def similar_components(docs: DataFrame, nodes: DataFrame, shingle: int = 5) -> DataFrame:
    """(u, v): v is the smallest node of the component of links of similarity SIMILAR or more, for each u that isn't.

    What is proposed over the index is one group; within a group all texts are compared by their shingle sets. Groups over BLOCK
    texts are dealt in blocks, each with the group's smallest node; only what is not joined to that one by then is held against
    the other blocks. nodes: (node, doc_id, tag, fp), the text of a node being that of the row (doc_id, tag).
    """
    met = components(wide_stars(nodes, nodes.count()))
    member = met.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(met.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    big = member.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("n_blocks")).where("n_blocks > 1")
    member = member.join(F.broadcast(big), "root", "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
    member = member.withColumn("block", F.pmod(F.xxhash64("node"), "n_blocks")).join(nodes.select("node", "doc_id", "tag"), "node")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t or b"", shingle).tobytes() for t in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sets, pa.binary())], names=["node", "root", "block", "n_blocks", "own"])

    t, m = tagged(docs).select("doc_id", "tag", "text"), member.select(F.col("doc_id").alias("m_id"), F.col("tag").alias("m_tag"), "node", "root", "block", "n_blocks")
    held = t.join(m, t["tag"].eqNullSafe(m["m_tag"]) & t["doc_id"].eqNullSafe(m["m_id"])).select("node", "root", "block", "n_blocks", "text")
    held = held.mapInArrow(own, "node long, root long, block long, n_blocks long, own binary").checkpoint()
    n, n_big = held.agg(F.count("*"), F.count(F.when(F.col("n_blocks") > 1, 1))).first()
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    first = held.where("n_blocks > 1 and node = root").withColumn("block", every("n_blocks"))
    links = similar_stars(held.unionByName(first), n, ["root", "block"]).checkpoint()
    stars = components(links)
    if not n_big:
        return stars
    wide = held.where("n_blocks > 1").join(stars.select(F.col("u").alias("node"), "v"), "node", "left")
    loose = wide.where("coalesce(v, node) <> root").drop("v", "block").checkpoint()
    turns = loose.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("n_turns"))
    n_loose = loose.count()
    if not n_loose:
        return stars
    turns = F.broadcast(turns)
    loose = loose.join(turns, "root").select("node", "root", "own", F.pmod(F.xxhash64("node"), "n_turns").alias("turn"), every("n_blocks").alias("block"))
    rest = held.join(turns, "root").select("node", "root", "own", "block", every("n_turns").alias("turn"))
    return components(links.unionByName(similar_stars(loose.unionByName(rest), n_big + n_loose, ["root", "turn", "block"])))


def tagged(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the text's hash, as set_rows has it."""
    return id_text(docs).withColumn("tag", F.xxhash64(F.coalesce("text", F.lit(""))))


def least_of_similar(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, tag) of the row with the smallest doc_id in each component of near copies; null ids come last."""
    ensure_checkpoints(docs.sparkSession)
    rows = set_rows(id_text(docs), shingle)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    nodes = rows.groupBy("node").agg(F.min(row).alias("row"), F.min("fp").alias("fp")).select("node", "row", "row.doc_id", "row.tag", "fp").checkpoint()
    stars = similar_components(docs, nodes, shingle).select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.select("node", "row").join(stars, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("row").alias("row")).select("row.doc_id", "row.tag")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return grouped(docs, id_col, text_col).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One row of each component, that with the smallest doc_id, with all columns. Rows without an id can't be named as a copy and
    stay; of repeated rows (id and text) one stays, and of an id's different texts each is judged by itself."""
    keep = least_of_similar(docs, shingle).select(F.col("doc_id").alias("keep_id"), F.col("tag").alias("keep_tag"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("tag"), F.struct("*").alias("row"))
    known = rows.join(keep, (F.col("id") == F.col("keep_id")) & (F.col("tag") == F.col("keep_tag")), "left_semi")
    # rows of one id and text are copies; one is chosen by its place, as rows may hold columns that can't be compared
    known = known.groupBy("id", "tag").agg(F.any_value("row").alias("row"))
    return known.select("row.*").unionByName(rows.where("id is null").select("row.*"))
