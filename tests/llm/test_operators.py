"""Each operator against a plain version on a small table with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folioflow.llm.repeat_groups import dealt as dealt_
from folioflow.llm import (
    bloom_lm,
    bpe_transducer,
    importance_resampling,
    media_avi,
    phrase_automata,
    qgram_decontam,
    rendezvous_shards,
    secret_ledger,
    simhash_neardup,
    suffix_dedup,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, p int, blob string, shard int, fp long, score double"


def texts():
    r = random.Random(5)
    words = ["".join(r.choices("abcdeé", k=r.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(r.choices(words, k=n))
    passage = say(60)
    base = say(120)
    out = [(1, base), (2, base), (2, base), (3, base + " end"), (4, None), (5, ""), (6, " \t\n "), (None, base), (None, say(50)), (7, "Zß😀 " + passage), (8, say(30) + " " + passage + " " + say(9)), (9, passage + " " + passage)]
    out += [(10, say(4000)), (11, 'x token = "abcdefgh1" AKIA' + "A1" * 8 + " " + "0f" * 20 + " secret: short Password=secret=abcdefgh <|endoftext|> api_key:12345678"), (12, "a" * 120), (13, "\xa0 a\x1cb  c"), (14, "x" * 6000)]
    return out + [(20 + k, say(r.randint(1, 90))) for k in range(24)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, "b", 3, 4, 0.5) for i, t in texts()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def keyed(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append(r)
    return out


def each(df):
    """(row, text) of rows whose id is unique, and any row of the others' texts."""
    found = keyed(df)
    assert sum(map(len, found.values())) == len(texts())
    for i, t in texts():
        if i is not None:
            yield found[i][0], t or ""


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_media_is_read_back(docs, none):
    for r, t in each(media_avi.media_digest(docs)):
        raw = t.encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-16:]))
    assert media_avi.media_digest(none).count() == 0
    clips = media_avi.media_clips(media_avi.text_to_media(docs))
    assert clips.where("end_ms <= start_ms").count() == 0
    assert clips.agg(F.sum("n_frames")).first()[0] == media_avi.media_digest(docs).agg(F.sum("payload_bytes")).first()[0] / 192


def test_media_without_index_and_other_bytes():
    noise = random.Random(1).randbytes(192 * 7)
    file = media_avi.store_all([noise])[0]
    bare = file[: file.index(b"idx1")]
    bare = bare[:4] + (len(bare) - 8).to_bytes(4, "little") + bare[8:]
    assert all(media_avi.decode_media([f])[0][1].tobytes() == noise for f in (file, bare))
    still = np.zeros((30, 12, 16), np.uint8)
    still[15:] = 200
    assert media_avi.shots(still)[0].tolist() == [0, 15]
    assert media_avi.shots(still[:0])[0].tolist() == [] and media_avi.clips(40_000, still[:0]) == []
    for broken in (b"RIFFxxxx", b"", file[:300], file[:-200], bare[:-5], file[:400] + b"\0" * 100 + file[500:900]):
        try:
            media_avi.decode_media([broken])
        except ValueError:
            continue
        assert broken != b""


def chunk(name, body):
    return name + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)


def avi(frames, indexed, rate=10):
    """An AVI file of RIFF parts with a frame each; if `indexed`, with OpenDML indexes and junk that looks like a frame."""
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, rate, 0, len(frames), 0, 0, 0, 0, 0, 0, 0)

    def build(places):
        strl = chunk(b"strh", strh)
        if indexed:
            entries = b"".join(struct.pack("<QII", at, size, 1) for at, size in places)
            strl += chunk(b"indx", struct.pack("<HBBI4s3I", 4, 0, 0, len(frames), b"00dc", 0, 0, 0) + entries)
        out, found = b"", []
        for k, f in enumerate(frames):
            kind = b"AVIX" if k else b"AVI " + chunk(b"LIST", b"hdrl" + chunk(b"avih", bytes(56)) + chunk(b"LIST", b"strl" + strl))
            junk = chunk(b"00dc", b"junk") if indexed else chunk(b"JUNK", b"junk!")
            at = len(out) + 8 + len(kind) + 12 + len(junk)
            body = junk + chunk(b"00dc", f)
            if indexed:
                ix = chunk(b"ix00", struct.pack("<HBBI4sQI", 2, 0, 1, 1, b"00dc", at + 8, 0) + struct.pack("<II", 0, len(f) | 1 << 31))
                found.append((at + 8 + len(f) + len(f) % 2, len(ix)))
                body += ix
            out += chunk(b"RIFF", kind + chunk(b"LIST", b"movi" + body))
        return out, found

    _, places = build([(0, 0)] * len(frames))
    return build(places)[0]


def baseline(plane, chroma=False, restart=0):
    """A baseline JPEG of a grey plane, by the standard's formulas; with `chroma` in three parts, 2x1 sampled, of plain colour."""
    high, wide = plane.shape
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    code = {k: media_avi.codes(*t) for k, t in {"d0": media_avi.DEFAULT_TABLE, "a0": media_avi.DEFAULT_AC, "d1": media_avi.DEFAULT_CHROMA_DC, "a1": media_avi.DEFAULT_CHROMA_AC}.items()}
    bits, last, out = [], 0, b""

    def put(value, n):
        bits.extend(value >> (n - 1 - k) & 1 for k in range(n))

    def number(v):
        n = abs(v).bit_length()
        return n, (v if v > 0 else v + (1 << n) - 1)

    def flush():
        bits.extend([1] * (-len(bits) % 8))
        raw = bytes(int("".join(map(str, bits[k : k + 8])), 2) for k in range(0, len(bits), 8))
        bits.clear()
        return raw.replace(b"\xff", b"\xff\0")

    def block(y, x):
        nonlocal last
        z = []
        for r, c in order:
            cu, cv = (0.5**0.5 if k == 0 else 1 for k in (r, c))
            total = sum((int(plane[y + a, x + b]) - 128) * math.cos((2 * a + 1) * r * math.pi / 16) * math.cos((2 * b + 1) * c * math.pi / 16) for a in range(8) for b in range(8))
            z.append(round(cu * cv * total / 4 / 2))
        n, v = number(z[0] - last)
        last = z[0]
        put(*code["d0"][n])
        put(v, n)
        zeros = 0
        for v in z[1:]:
            if v == 0:
                zeros += 1
                continue
            while zeros > 15:
                put(*code["a0"][0xF0])
                zeros -= 16
            n, w = number(v)
            put(*code["a0"][zeros << 4 | n])
            put(w, n)
            zeros = 0
        if zeros:
            put(*code["a0"][0])

    step, unit = 16 if chroma else 8, 0
    for y in range(0, high, 8):
        for x in range(0, wide, step):
            if restart and unit and unit % restart == 0:
                out += flush() + bytes([0xFF, 0xD0 + (unit // restart - 1) % 8])
                last = 0
            unit += 1
            block(y, x)
            if chroma:
                block(y, x + 8)
                for _ in range(2):
                    put(*code["d1"][0])
                    put(*code["a1"][0])
    out += flush()
    parts = bytes([1, 0x21, 0, 2, 0x11, 0, 3, 0x11, 0]) if chroma else bytes([1, 0x11, 0])
    scan = bytes([1, 0, 2, 0x11, 3, 0x11]) if chroma else bytes([1, 0])
    seg = lambda mark, body: bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body
    head = seg(0xDB, bytes([0]) + bytes([2] * 64)) + seg(0xC0, struct.pack(">BHHB", 8, high, wide, len(parts) // 3) + parts)
    head += seg(0xDD, struct.pack(">H", restart)) if restart else b""
    return b"\xff\xd8" + head + seg(0xDA, bytes([len(scan) // 2]) + scan + bytes([0, 63, 0])) + out + b"\xff\xd9"


@pytest.mark.parametrize("indexed", [True, False])
@pytest.mark.parametrize(("chroma", "restart"), [(False, 0), (True, 0), (False, 3), (True, 1)])
def test_ordinary_motion_jpeg(indexed, chroma, restart):
    r = np.random.default_rng(4)
    planes = [np.clip(np.add.outer(np.arange(16) * 9, np.arange(32) * 3) + 40 * k + r.integers(0, 9, (16, 32)), 0, 255).astype(np.uint8) for k in range(3)]
    micros, got = media_avi.decode_media([avi([baseline(p, chroma, restart) for p in planes], indexed)])[0]
    assert micros == 100_000 and got.shape == (3, 16, 32)
    assert np.abs(got.astype(int) - np.array(planes)).max() <= 5


def plain_lossless(scan, n):
    """Samples of one stored frame, decoded bit by bit by the standard's rules."""
    bits = "".join(f"{b:08b}" for b in scan.replace(b"\xff\0", b"\xff"))
    table = {f"{code:0{n_}b}": s for s, (code, n_) in media_avi.codes(*media_avi.DEFAULT_TABLE).items()}
    out, at = [], 0
    for k in range(n):
        end = at + 1
        while bits[at:end] not in table:
            end += 1
        size = table[bits[at:end]]
        at = end + size
        v = int(bits[end:at], 2) if size else 0
        v = v if size == 0 or v >> (size - 1) else v - (1 << size) + 1
        out.append(v + (128 if k == 0 else out[k - 16] if k % 16 == 0 else out[k - 1]))
    return bytes(out)


def test_stored_form_by_a_plain_decoder(docs):
    noise = random.Random(2).randbytes(1000) + b"\xff" * 100 + "é".encode() * 200
    file = media_avi.store_all([noise])[0]
    at, back = file.index(b"movi") + 4, b""
    while file[at : at + 4] == b"00dc":
        size = int.from_bytes(file[at + 4 : at + 8], "little")
        jpeg = file[at + 8 : at + 8 + size]
        back += plain_lossless(jpeg[len(media_avi.HEAD) : -2], 192)
        at += 8 + size + size % 2
    assert back == noise.ljust(-(-len(noise) // 192) * 192) and file[at : at + 4] == b"idx1"
    same = {r.media_sha256: r.media_bytes for r in media_avi.media_digest(docs).collect()}
    files = {sha(bytes(r.media)): len(r.media) for r in media_avi.text_to_media(docs).collect()}
    assert same == files


def test_pieces_and_damaged_files(spark, docs, monkeypatch):
    monkeypatch.setattr(media_avi, "PIECE", 3)
    long = random.Random(3).randbytes(192 * 20)
    files = media_avi.store_all([long, b"", long[:500]])
    monkeypatch.undo()
    assert files == media_avi.store_all([long, b"", long[:500]])
    none = media_avi.write_avi([media_avi.encode_frames(np.zeros((1, 12, 16), np.uint8))[0]])
    none = none[: none.index(b"movi") + 4]
    none = none[:4] + (len(none) - 8).to_bytes(4, "little") + none[8:]
    none = none.replace(none[none.rindex(b"LIST") : none.rindex(b"LIST") + 8], b"LIST" + (4).to_bytes(4, "little"))
    rows = [(1, bytearray(files[0]), 5), (2, bytearray(b"no film"), 5), (3, None, 5), (4, bytearray(files[0][:700]), 5), (5, bytearray(none), 5), (5, bytearray(files[1]), 5)]
    out = keyed(media_avi.media_clips(spark.createDataFrame(rows, "doc_id long, media binary, error int")))
    assert set(out) == {1, 2, 4, 5} and [x.n_frames for x in out[5]] == [1] and sum(x.n_frames for x in out[1]) == 20
    assert out[2][0].error and out[4][0].error and out[1][0].error is None
    feature = {r.doc_id: r for r in media_avi.media_digest(docs).collect()}[14]
    assert feature.clips.count("-") == int(feature.feature.split(";")[1][6:])


KINDS = [("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")]


def secrets(t):
    out = []
    for n, (k, p) in enumerate(KINDS):
        for m in re.finditer(p, t, re.ASCII):
            if len(m.group(2) if k == "assign" else m.group()) >= {"assign": 8, "access": 16, "hex": 32}[k]:
                out.append((m.start(), n, k, m.end()))
    return sorted(out)


def test_secrets(docs, none):
    for r, t in each(secret_ledger.digest(docs)):
        found = secrets(t)
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in found).encode())
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, _, n, _ in found) for k in ("assign", "access", "hex"))
    assert secret_ledger.digest(none).count() == 0


def test_ledger_scans_only_what_is_unseen(docs):
    first = secret_ledger.ledger_entries(docs).cache()
    assert first.count() == len({t or "" for _, t in texts()})
    more = docs.unionByName(docs.limit(1).withColumn("text", F.lit("token=qwertyuiop")))
    assert secret_ledger.ledger_entries(more, first).count() == 1
    assert secret_ledger.ledger_entries(docs, first, rule_version="2").count() == first.count()
    assert secret_ledger.join_back(docs, first, ["doc_id"]).count() == docs.count()
    twice = first.unionByName(first)
    assert secret_ledger.join_back(docs, twice, ["doc_id"]).count() == docs.count()
    found = {r.doc_id: r.findings for r in secret_ledger.join_back(more, twice.withColumn("doc_id", F.lit(1)), ["doc_id", "text"]).where("text is null or text <> 'x'").collect()}
    assert found[5] == [] and len(found[11]) == 5
    assert secret_ledger.join_back(more, first, ["text"]).where("text = 'token=qwertyuiop' and findings is null").count() == 1


def test_redaction_keeps_rows_and_columns(docs):
    out = secret_ledger.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    clean = {r.doc_id: r.text for r in out.collect()}
    assert clean[11].count("[SECRET]") == 5 and "abcdefgh" not in clean[11] and "secret: short" in clean[11]
    assert clean[4] is None and clean[1] == dict(texts())[1]
    odd = docs.select("doc_id", "text", F.lit(1).alias("row"), F.lit(2).alias("findings"), F.create_map(F.lit("a"), F.lit(1)).alias("blob"))
    again = secret_ledger.redact(odd)
    assert again.columns == odd.columns and {r.doc_id: r.text for r in again.collect()} == clean
    assert secret_ledger.redact(docs.where("false")).count() == 0


def plain_model(rows, discount=0.75):
    """(base score, score) of a text, from exact dictionaries."""
    single, pairs = Counter(), Counter()
    for i, t in rows:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 10:
            w = [*(t or "").encode().lower().split(), None]
            single.update(w)
            pairs.update(zip([None, *w], w, strict=False))
    n, v = sum(single.values()), len(single)
    stands = lambda c: 0 if not c else 1 if c == 1 else 1.5 * 2 ** math.floor(math.log2(c))
    total, follow = Counter(), Counter()
    for (a, _), c in pairs.items():
        total[a] += stands(c)
        follow[a] += 1
    quantised = sum(map(stands, single.values()))

    def p(a, b):
        alone = (stands(single[b]) + 0.1) / (quantised + 0.1 * (v + 1))
        if not total[a]:
            return alone
        return max(stands(pairs[a, b]) - discount, 0) / total[a] + discount * follow[a] / total[a] * alone

    for a in [None, *list(single)[:20], b"never seen"]:
        assert math.isclose(sum(p(a, b) for b in single) + p(a, b"unknown"), 1)

    def score(t):
        w = [*(t or "").encode().lower().split(), None]
        return sum(math.log10((single[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), sum(math.log10(p(a, b)) for a, b in zip([None, *w], w, strict=False))

    return single, n, score


@pytest.mark.parametrize("broadcast", [True, False])
def test_language_model(docs, none, broadcast):
    count, n, score = plain_model(texts())
    settings = bloom_lm.Settings(bits_per_item=128, hashes=12, **({} if broadcast else {"max_bits": 0}))
    for r, t in each(bloom_lm.score(docs, settings)):
        words = [*t.encode().lower().split(), None]
        assert (r.n_tokens, r.train_tokens, r.n_known) == (len(words), n, sum(count[w] > 0 for w in words))
        base, own = score(t)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, own, rel_tol=1e-9)
    assert bloom_lm.score(none, settings).count() == 0


def test_both_ways_of_asking_give_one_score(docs):
    """Also with false positives, as the filter is the same; words alone can be too many for a broadcast."""
    one, two = (sorted(map(tuple, bloom_lm.score(docs, bloom_lm.Settings(bits_per_item=2, max_words=m)).collect()), key=str) for m in (4_000_000, 0))
    assert one == two and all(math.isfinite(r[-1]) and r[-1] <= 0 for r in one)


@pytest.mark.parametrize("spread", [10, 1 << 20])
def test_large_tables_are_asked_without_a_model_beside(docs, none, monkeypatch, spread):
    """Several blocks a task; words whose pairs are in all segments, the end token among them; no second pass over the texts."""
    count, n, score = plain_model(texts())
    monkeypatch.setattr(bloom_lm, "train", lambda *_: pytest.fail("a model was built beside"))
    settings = bloom_lm.Settings(bits_per_item=128, hashes=12, max_bytes=-1, spread=spread, block=300)
    spreads = bloom_lm.spread_words(bloom_lm.id_text(docs), settings)
    assert (bloom_lm.END in spreads and len(spreads) > 100) if spread == 10 else not len(spreads)
    for r, t in each(bloom_lm.score(docs, settings)):
        words = [*t.encode().lower().split(), None]
        assert (r.n_tokens, r.train_tokens, r.n_known) == (len(words), n, sum(count[w] > 0 for w in words))
        base, own = score(t)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, own, rel_tol=1e-9)
    assert bloom_lm.score(none, settings).count() == 0


def test_a_segment_is_probed_once_for_all_blocks(monkeypatch):
    """Not once for each block that asks: blocks times segments grow with the square of the table."""
    calls, probe = [], bloom_lm.levels
    monkeypatch.setattr(bloom_lm, "levels", lambda *a: calls.append(1) or probe(*a))
    word, none = np.array([7], np.uint64), np.zeros(0, np.int64)
    blobs = [bloom_lm.pack_asked(word, np.array([2]), none, np.array([k, 900], np.uint64), np.array([1, k % 2])) for k in range(300)]
    answers, sums = bloom_lm.settle(blobs, 0, bloom_lm.Settings(bits_per_item=128, hashes=12))
    assert len(calls) == 2 and (sums["n"], sums["v"]) == (450, 1)
    stands = 300 + 1.5 * 2 ** 7
    assert all([x.tolist() for x in bloom_lm.unpack_answer(b)] == [[9], [450], [stands], [301], [1, 8]] for b in answers)


def test_filter_counts_are_quantised_and_never_low():
    keys = np.unique(np.random.default_rng(0).integers(1, 1 << 63, 5000).astype(np.uint64))
    counts = np.random.default_rng(1).integers(1, 5000, len(keys))
    settings = bloom_lm.Settings(bits_per_item=16)
    bits = bloom_lm.build_segment(counts, keys, settings)
    model = bloom_lm.Model(settings, 1, {0: bits.tobytes()}, None, None)
    got = model.levels(keys, keys, 0)
    assert (got >= bloom_lm.level(counts)).all() and (got == bloom_lm.level(counts)).mean() > 0.95
    assert (model.levels(keys, keys + np.uint64(1), 0) > 0).mean() < 0.05
    assert len(bloom_lm.build_segment(np.ones(1 << 16, np.int64), np.arange(1 << 16, dtype=np.uint64), settings)) == 1 << 17  # no cap


def labelled_texts(vocabulary=200):
    r = random.Random(2)
    words = ["".join(r.choices("abcdefg", k=5)) for _ in range(vocabulary)]
    rows, labels = [], []
    for k in range(1200):
        t = r.choices(words, k=80)
        bad = k % 6 == 0
        if bad:
            t[10] = t[40] = "vile"
        rows.append((k, " ".join(t)))
        if k % 2 == 0:
            labels.append((k, 1, int(bad)))
    rows += [(5000, None), (5001, ""), (None, " ".join(words)), (5002, "vile " * 500), (5003, " ".join(words * 100)), (7, rows[7][1])]
    return rows, [*labels, (2, 1, 0), (2, 1, 0), (8, None, 0), (8, 1, 0), (None, 1, 0)]


def test_classifier_rejects_what_good_texts_avoid(spark):
    rows, labels = labelled_texts()
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {x.doc_id for x in importance_resampling.selected(d, lab).collect()}
    good, bad = [k for k in range(1200) if k % 6], [k for k in range(1200) if k % 6 == 0]
    assert sum(k in kept for k in bad) < 0.03 * len(bad) and 5002 not in kept
    all_good = importance_resampling.Settings(share=1000 / len(rows))
    kept = {x.doc_id for x in importance_resampling.selected(d, lab, all_good).collect()}
    assert sum(k in kept for k in good) > 0.97 * len(good) and sum(k in kept for k in bad) < 0.03 * len(bad)
    odd = d.withColumns({"score": F.lit(1), "row": F.lit(2), "importance": F.lit(3), "gumbel_key": F.lit("x"), "id": F.lit(0)})
    out = importance_resampling.keep_good(odd, lab, all_good)
    assert {x.doc_id for x in out.collect()} == kept and out.columns == odd.columns
    assert importance_resampling.selected(d.where("false"), lab).count() == 0 and importance_resampling.keep_good(d.where("false"), lab).count() == 0
    assert importance_resampling.selected(d, lab.where("false")).count() == len(rows)


def test_importance_sampling_by_a_plain_sampler(spark):
    rows, labels = labelled_texts(12)  # so few n-grams that no two share a bucket
    d, lab = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    settings = importance_resampling.Settings(temperature=0.5)
    state = {}
    for i, quality, toxic in labels:
        if i is not None and quality is not None:
            state[i] = state.get(i, True) and quality == 1 and toxic == 0
    bags = []
    for _, t in rows:
        w = (t or "").lower().split()
        bags.append([(1, x) for x in w] + [(2, *x) for x in zip(w, w[1:], strict=False)])
    raw, target = Counter(), Counter()
    for (i, _), bag in zip(rows, bags, strict=True):
        raw.update(bag)
        if state.get(i):
            target.update(bag)
    many = {o: (sum(c for g, c in raw.items() if g[0] == o), sum(c for g, c in target.items() if g[0] == o)) for o in (1, 2)}

    def ratio(g):
        e = raw[g] * many[g[0]][1] / many[g[0]][0]
        return math.log((target[g] + 1) / (e + 1)) if abs(target[g] - e) >= 4 * math.sqrt(e + 1) else 0.0

    noise = {r.doc_id: r.g for r in d.select("doc_id", importance_resampling.gumbel_key(F.lit(0.0), F.col("doc_id"), 1.0).alias("g")).collect()}
    want = {}
    for (i, t), bag in zip(rows, bags, strict=True):
        w = sum(map(ratio, bag)) / max(1, len((t or "").split())) ** 0.5
        want[i] = (w, w / 0.5 + noise[i])
    keys = sorted((want[i][1] for i, _ in rows), reverse=True)
    least = keys[round(sum(state.values()) / len(state) * len(rows)) - 1]
    got = {r.doc_id: (r.importance, r.gumbel_key) for r in importance_resampling.selected(d, lab, settings).collect()}
    assert set(got) == {i for i, x in want.items() if x[1] >= least - 1e-6}
    assert all(abs(a - b) < 1e-3 for i in got for a, b in zip(got[i], want[i], strict=True))


def test_kth_largest_is_exact(spark):
    values = [random.Random(3).gauss(0, 1) for _ in range(500)] + [0.25] * 100
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 7, 250, 599, 600):
        assert importance_resampling.kth_largest(df, "v", k, bins=8, small=3) == sorted(values, reverse=True)[k - 1]


def test_bpe_equals_the_library(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_transducer.default_vocabulary())
    for r, text in each(bpe_transducer.digest(docs, words=100)):
        ids = t.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(t.decode(ids, skip_special_tokens=False).encode()))
    assert bpe_transducer.digest(none, words=10).count() == 0
    back = {r.doc_id: r.text for r in bpe_transducer.decode(bpe_transducer.encode(docs, words=10)).collect()}
    assert all(back[i] == (x or "") for i, x in texts() if i)


def test_transducer_is_minimal_and_exact():
    entries = {w.encode(): (k, k + 1) for k, w in enumerate(["stop", "top", "tops", "stops", "é", "ab", "cab"])}
    t = bpe_transducer.Transducer(bpe_transducer.compile_transducer(entries))
    asked = [*entries, b"st", b"", b"stopss", b"zz"]
    assert t.lookup(asked) == [entries.get(w) for w in asked]
    plain = bpe_transducer.Transducer(bpe_transducer.compile_transducer({w: (0,) for w in (b"stop", b"top")}))
    assert len(plain.final) == 5  # root, after s, and the shared after t, to, top
    assert bpe_transducer.Transducer(bpe_transducer.compile_transducer({})).lookup([b"a"]) == [None]


def test_shards(docs, none):
    rows = rendezvous_shards.digest(docs).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(rows) == len(texts())
    one = {r.doc_id: r for r in rows}
    for i, t in texts():
        if i is not None:
            raw = (t or "").encode()
            assert (one[i].size, one[i].text_crc32) == (len(raw) + 8, zlib.crc32(raw))
            score = [int(hashlib.md5(f"{i}:{s}".encode()).hexdigest()[:13], 16) for s in range(24)]
            assert one[i].shard == score.index(max(score))
    assert rendezvous_shards.digest(none).count() == 0


def test_slots_in_many_blocks_and_clashing_names(spark):
    df = spark.range(2000).select("id", (F.col("id") % 3).alias("shard"), F.lit(1).alias("block"), F.lit(2).alias("row"), F.lit(3).alias("by"))
    out = rendezvous_shards.with_slots(df, ["id"], blocks=500)
    slots = defaultdict(list)
    for r in out.collect():
        slots[r.shard].append(r.slot)
    assert out.columns == [*df.columns, "slot"] and all(sorted(s) == list(range(len(s))) for s in slots.values())
    with pytest.raises(ValueError):
        rendezvous_shards.assign(df, "id")


def test_weighted_shards_fill_by_weight(spark):
    n = {r.shard: r.n for r in rendezvous_shards.assign(spark.range(6000), "id", weights=[1, 2, 3]).groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert all(abs(n[k] - 1000 * (k + 1)) < 200 for k in range(3))


def test_substrings(docs, none):
    rows = [(math.inf if i is None else i, (t or "").encode()) for i, t in texts()]
    first = {}
    for i, t in rows:
        for s in range(len(t) - 49):
            first[t[s : s + 50]] = min(i, first.get(t[s : s + 50], math.inf))
    found = keyed(suffix_dedup.removed(docs))
    for i, t in rows:
        mark = bytearray(len(t))
        for s in range(len(t) - 49):
            if first[t[s : s + 50]] < i:
                mark[s : s + 50] = b"\1" * 50
        want = (len(t), sum(mark), sum(1 for k in range(len(t)) if mark[k] and not (k and mark[k - 1])), sha(bytes(c for c, m in zip(t, mark) if not m)))
        assert want in [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found[None if i == math.inf else i]]
    assert suffix_dedup.removed(none).count() == 0


def test_multikey_quicksort():
    r = np.random.default_rng(0)
    for n, values in ((0, 3), (1, 3), (500, 2), (3000, 5), (2000, 1 << 60)):
        words = r.integers(0, values, (n, 4)).astype(np.uint64)
        order = suffix_dedup.multikey_order(words)
        assert sorted(order.tolist()) == list(range(n)) and words[order].tolist() == sorted(words.tolist())


def test_common_passage_is_cut_between_buckets(spark, monkeypatch):
    """One line in all texts: its records are spread over buckets by what follows and precedes, and compared across them."""
    r = random.Random(6)
    say = lambda n: "".join(r.choices("abcdefgh ", k=n))
    line = say(70)
    rows = [(k, say(60) + line + say(60)) for k in range(120)] + [(200 + k, say(30) + "q" * r.randint(50, 90) + say(30)) for k in range(20)]
    monkeypatch.setattr(suffix_dedup, "dealt", lambda docs, a, b: (lambda x, plan: (x, type(plan)(plan.parts, plan.groups, 40)))(*dealt_(docs, a, b)))
    found = {x.doc_id: x for x in suffix_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {}
    for i, t in rows:
        for s in range(len(t) - 49):
            first.setdefault(t[s : s + 50], i)
    for i, t in rows:
        mark = bytearray(len(t))
        for s in range(len(t) - 49):
            if first[t[s : s + 50]] < i:
                mark[s : s + 50] = b"\1" * 50
        assert found[i].n_removed == sum(mark)


def test_unlike_records_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "mix", lambda x: x * np.uint64(0))
    rows = np.array([[1] * 88, [2] * 88, [1] * 88], np.uint8)
    first, same = suffix_dedup.distinct_records(rows)
    assert len(first) == 2 and same[0] == same[2] != same[1]


def test_phrases(docs, none):
    rows = [(i, (t or "").encode().split()) for i, t in texts()]
    count = Counter(tuple(w[s : s + 35]) for _, w in rows for s in range(len(w) - 34))
    found = keyed(phrase_automata.removed(docs))
    for i, w in rows:
        mark = [0] * len(w)
        for s in range(len(w) - 34):
            if count[tuple(w[s : s + 35])] > 1:
                mark[s : s + 35] = [1] * 35
        want = (len(w), sum(mark), sha(b" ".join(x for x, m in zip(w, mark) if not m)))
        assert want in [(r.n_words, r.n_removed, r.kept_sha256) for r in found[i]]
    assert phrase_automata.removed(none).count() == 0


def test_removal_follows_from_the_automata(docs, monkeypatch):
    """Without hits nothing is removed, and every word of every text is streamed."""
    seen = []

    def deaf(phrases):
        for machine, known, signs in automata_(phrases):

            class Deaf:
                def iter(self, text, width=signs.shape[1]):
                    seen.append(len(text) // width)
                    return []

            yield Deaf(), known, signs

    automata_ = phrase_automata.automata
    monkeypatch.setattr(phrase_automata, "automata", deaf)
    own = phrase_automata.Words([(t or "").encode() for _, t in texts()])
    assert len(phrase_automata.occurrences(own, own.hash[:8][None])) == 0 and sum(seen) == len(own.hash)
    monkeypatch.undo()
    assert 0 in phrase_automata.occurrences(own, own.hash[:8][None])


def test_several_automata(docs, monkeypatch):
    own = phrase_automata.Words([(t or "").encode() for _, t in texts()])
    places = np.array([0, 3, 11, 300, 700])
    phrases = own.hash[places[:, None] + np.arange(8)]
    every = phrase_automata.occurrences(own, phrases)
    monkeypatch.setattr(phrase_automata, "PHRASES", 2)
    assert set(places) <= set(every.tolist()) and (phrase_automata.occurrences(own, phrases) == every).all()


def fingerprint(t):
    w = t.encode().lower().split()
    pieces = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, none):
    rows = [(i, fingerprint(t or "")) for i, t in texts()]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 2:
                root[top(a)] = top(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[top(k)] += [] if i is None else [i]
    found = keyed(simhash_neardup.digest(docs))
    for k, (i, f) in enumerate(rows):
        assert (f"{f:016x}", min(least[top(k)], default=None)) in [(r.fingerprint, r.component_id) for r in found[i]]
    assert simhash_neardup.digest(none).count() == 0
    kept = simhash_neardup.keep_one(docs, shingle=3)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and len(ids) == len({x for x in ids if x is not None}) + 2 and 2 not in ids


@pytest.mark.parametrize("bits", [1, 2, 3, 4])
def test_links_are_complete(bits):
    r = random.Random(bits)
    base = [r.getrandbits(64) for _ in range(6)]
    every = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(120)})
    fp = np.array(every, np.uint64)
    want = {(a, b) for a in range(len(fp)) for b in range(a + 1, len(fp)) if (every[a] ^ every[b]).bit_count() <= bits}
    for limit in (8, 1000):  # both ways within a run
        got = set()
        for m in simhash_neardup.position_sets(bits):
            key = fp & np.uint64(m)
            order = np.lexsort((fp, key))
            a, b = simhash_neardup.run_links(fp[order], np.cumsum(np.concatenate(([0], key[order][1:] != key[order][:-1]))), bits, limit)
            got |= {(min(x, y), max(x, y)) for x, y in zip(order[a].tolist(), order[b].tolist())}
        assert got == want


def test_wide_fingerprints_by_their_definition():
    own = [(t or "").encode() for _, t in texts()]
    wide = simhash_neardup.wide_fingerprints([simhash_neardup.shingle_hashes(t, 3) for t in own])
    assert (wide[:, 0] == simhash_neardup.fingerprints(own, 3)).all()
    assert not wide[4:7].any() and len(np.unique(wide[:, 1:], axis=0)) == len(np.unique(wide, axis=0))


@pytest.mark.parametrize("n", [40, 3000])
def test_wide_links_join_what_all_pairs_join(spark, n):
    r = random.Random(n)
    base = [r.getrandbits(256) for _ in range(5)]
    every = sorted({r.choice(base) ^ sum(1 << k for k in r.sample(range(256), r.choice((2, 9, 20)))) for _ in range(n)})
    fp = np.frombuffer(b"".join(x.to_bytes(32, "little") for x in every), "<u8").reshape(-1, 4)
    a, b = np.triu_indices(len(fp), 1)
    ok = np.concatenate([simhash_neardup.linked(fp[a[k : k + 100_000]] ^ fp[b[k : k + 100_000]]) for k in range(0, len(a), 100_000)])
    want = simhash_neardup.local_roots(len(fp), a[ok], b[ok])
    for limit in (8, 10_000):
        if n * limit < 1_000_000:
            assert (simhash_neardup.wide_roots(fp, np.zeros(len(fp), np.int64), np.arange(len(fp)), limit) == want).all()
    nodes = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(fp)], "node long, fp binary").repartition(3)
    root = {x.u: x.v for x in simhash_neardup.components(simhash_neardup.wide_stars(nodes, len(fp))).collect()}
    assert [root.get(k, k) for k in range(len(fp))] == want.tolist()


def test_wide_index_finds_the_same_pairs_at_any_size(spark):
    r = random.Random(8)
    base = [r.getrandbits(256) for _ in range(150)]
    every = base + [b ^ sum(1 << k for k in r.sample(range(256), 40)) for b in base]  # as at similarity 0.8
    nodes = spark.createDataFrame([(k, bytearray(x.to_bytes(32, "little"))) for k, x in enumerate(every)], "node long, fp binary").cache()
    few, many = ({(x.u, x.v) for x in simhash_neardup.components(simhash_neardup.wide_stars(nodes, n)).collect()} for n in (300, 1 << 20))
    assert few == many and len(few) > 140


def test_near_copies_go_and_other_texts_stay(spark):
    r = random.Random(3)
    words = ["".join(r.choices("abcdefgh", k=6)) for _ in range(5000)]
    rows, other = [], []
    for k in range(60):
        own = r.choices(words, k=150)
        rows.append((k, " ".join(own)))
        near = own[:]
        near[r.randrange(150)] = "new"
        rows.append((1000 + k, " ".join(near)))  # similarity 0.93 or more
        other.append((2000 + k, " ".join(own[:50] + r.choices(words, k=100))))  # similarity 0.2
    docs = spark.createDataFrame(rows + other, "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash_neardup.keep_one(docs).collect()) == [*range(60), *range(2000, 2060)]


def shingles(t):
    w = t.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def kept_of(rows):
    """Ids that stay of (id, text): the least of each component of links of similarity 0.8 or more, by all pairs."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(i, least.get(top(k), i))
    return sorted(least.values())


def pairs_of_all_similarities(seed, n):
    """Texts and copies with words replaced: similarities 0.4 to 1, lengths 8 to 300."""
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefgh", k=6)) for _ in range(5000)]
    rows = []
    for k in range(n):
        own = r.choices(words, k=r.choice((8, 14, 30, 120, 300)))
        near = own[:]
        for at in r.sample(range(len(own)), max(1, round(len(own) * r.choice((0, 0.01, 0.02, 0.03, 0.05))))):
            near[at] = "new"
        rows += [(k, " ".join(own)), (1000 + k, " ".join(near))]
    return rows


@pytest.mark.parametrize("block", [256, 8])
def test_near_copies_are_decided_by_exact_similarity(spark, monkeypatch, block):
    """Nothing goes that all pairs would keep; what the index misses (see test_recall) is next to nothing here."""
    monkeypatch.setattr(simhash_neardup, "BLOCK", block)
    rows = pairs_of_all_similarities(6, 200)
    r, own = random.Random(4), [f"w{k}" for k in range(100)]
    for k in range(90):  # a chain: each differs from the one before in a word, and few are like the first
        own = own[:]
        own[r.randrange(100)] = f"n{k}"
        rows.append((3000 + k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got, want = {x.doc_id for x in simhash_neardup.keep_one(docs).collect()}, set(kept_of(rows))
    assert want <= got and len(got - want) <= 0.03 * (len(rows) - len(want))


@pytest.mark.parametrize("words", [24, 60, 400])
def test_recall(spark, words):
    """Pairs of similarity 0.8 to 0.85 that the index proposes, against all pairs: 0.95 or more."""
    r = random.Random(words)
    vocabulary = ["".join(r.choices("abcdefgh", k=6)) for _ in range(5000)]
    sets, n = [], 0
    while n < 1500:
        own = r.choices(vocabulary, k=words)
        near = own[:]
        for at in r.sample(range(words), r.randint(1, max(1, words // 40))):
            near[at] = "new"
        cut = r.choice((0, 0, 1, 2, words // 20))
        a, b = (simhash_neardup.shingle_set(" ".join(x).encode()) for x in (own[cut:], near))
        share = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        if 0.8 <= share < 0.85:
            sets += [a, b]
            n += 1
    x = simhash_neardup.wide_fingerprints(sets)
    x = x[::2] ^ x[1::2]
    equal = (x.view(np.uint8).reshape(n, -1, 8) == 0).sum(axis=2)
    assert ((equal >= simhash_neardup.WIDTH).any(axis=1) & simhash_neardup.linked(np.ascontiguousarray(x))).mean() >= 0.95


def test_different_texts_of_one_id_both_stay(spark):
    one, two = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(1, one), (1, two), (2, two + " end"), (3, one), (3, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"tag": F.lit(7), "row": F.lit(1), "id": F.lit(2), "fp": F.create_map(F.lit("a"), F.lit(1))})
    out = simhash_neardup.keep_one(docs)
    assert sorted((x.doc_id, x.text) for x in out.collect()) == [(1, one), (1, two)] and out.columns == docs.columns


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 201), (201, 200), (300, 300)]
    out = {r.u: r.v for r in simhash_neardup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {k: 0 for k in range(1, 41)} | {100 + k: 100 for k in range(1, 30)} | {201: 200}


def edit_distance(p, t):
    """Of p to the best substring of t."""
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark, monkeypatch):
    r = random.Random(9)
    say = lambda n: "".join(r.choices("abcdefgh ", k=n))
    items = [(1, say(120)), (2, say(250)), (3, "shortie"), (4, None), (5, ""), (6, say(90))]
    rows = [(0, None), (1, ""), (2, say(5000))]
    for k in range(60):
        i, p = items[[0, 1, 5][k % 3]]
        p = list(p)
        for _ in range(k // 3):
            at = r.randrange(len(p))
            p[at : at + 1] = r.choice([["z"], [], [p[at], "q"]])
        rows.append((10 + k, say(r.randint(0, 400)) + "".join(p).upper() + say(r.randint(0, 400))))
    rows += [(90, "é" * 3 + " shortie"), (90, "é" * 3 + " shortie")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(9))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.edits for x in qgram_decontam.contaminated(d, b).collect()}
    want = {}
    for i, t in rows:
        for n, p in items:
            if p and t:
                e = edit_distance(p.lower(), t.lower())
                if e <= qgram_decontam.budget(len(p), 0.08)[0]:
                    want[i, n] = e
    assert got == want and len(want) > 20 and max(want.values()) > 3
    small = qgram_decontam.Settings(block_bytes=100)  # several blocks
    assert {(x.doc_id, x.item_id) for x in qgram_decontam.contaminated(d, b, small).collect()} == set(want)
    assert len(list(qgram_decontam.item_blocks(b, small))) == 3
    monkeypatch.setattr(qgram_decontam, "CHAIN", 2)  # rows are written between blocks
    assert sorted(qgram_decontam.clean(d, b, small).collect()) == sorted(qgram_decontam.clean(d, b).collect())
    clean = qgram_decontam.clean(d, b)
    assert {x.doc_id for x in clean.collect()} == {i for i, _ in rows} - {i for i, _ in want} and clean.columns == d.columns
    assert qgram_decontam.contaminated(d, b.where("false")).count() == 0 and qgram_decontam.clean(d, b.where("false")).count() == len(rows)
    assert qgram_decontam.contaminated(d.where("false"), b).count() == 0


def test_long_and_repetitive_texts_are_searched_in_runs(monkeypatch):
    phrase = b"all work and no play "
    item = phrase * 57
    long = phrase * 3000
    index = qgram_decontam.Index([(1, item), (2, b"x" * 40 + b"quite another item" * 5)], qgram_decontam.Settings())
    assert max(len(h[0]) for h in index.hits(qgram_decontam.spare(long))) <= qgram_decontam.RUN
    assert index.matches([long, b"", long[:100]]) == [(0, 0, 0, len(item), 0, index.matches([long])[0][5])]
    other = b"y" * 300 + item[:500] + b"?" + item[501:] + b"z" * 90
    whole = index.matches([other, long], False)
    monkeypatch.setattr(qgram_decontam, "RUN", 50)
    assert index.matches([other, long], False) == whole and {x[0] for x in whole} == {0, 1} and whole[0][4] == 1
    assert [x[0] for x in index.matches([other, long], True)] == [0, 1]


def test_pipeline_on_the_smallest_tables(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf).cache()
        assert 0 < docs.count() <= before
        assert docs.columns == (names if k < 4 else ["doc_id", "n_tokens", "ids"])
        before = docs.count()


def test_pipeline_rows_by_a_plain_version(spark, tmp_path):
    """run() on a table with bad texts, near copies of several similarities, benchmark passages, secrets, nulls and clashing names."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    r = random.Random(12)
    words = ["".join(r.choices("abcdefghij", k=6)) for _ in range(400)]
    rows, labels = [], []
    for k in range(600):
        t = r.choices(words, k=60)
        bad = k % 5 == 0
        if bad:
            t[7] = t[21] = t[33] = "vile"
        rows.append((k, " ".join(t)))
        if k < 500:
            labels.append((k, 1, int(bad)))
    rows += [(1000 + k, rows[k][1]) for k in range(1, 21)]  # exact copies
    for k in range(21, 61):  # near copies: one word of 60 (0.85), or three apart (0.6)
        t = rows[k][1].split()
        for at in (20,) if k % 2 else (10, 30, 50):
            t[at] = "changed"
        rows.append((1000 + k, " ".join(t)))
    passage = " ".join(r.choices(words, k=40))
    rows += [(2000 + k, " ".join(r.choices(words, k=20)) + " " + passage + " " + " ".join(r.choices(words, k=20))) for k in range(5)]
    rows += [(2100, "token = abcdefgh1 " + rows[100 + 1][1]), (2101, rows[103][1] + " AKIA" + "A1" * 8), (3000, None), (3001, ""), (None, " ".join(r.choices(words, k=50))), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "k") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))

    kept = {(x.doc_id, x.text) for x in importance_resampling.keep_good(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))).select("doc_id", "text").collect()}
    assert not any("vile" in (t or "") for _, t in kept) and len(kept) > 0.9 * sum("vile" not in (t or "") for _, t in rows)
    named = [(i, t or "") for i, t in kept if i is not None]
    left = set(kept_of(named))
    out = [(i, t) for i, t in kept if i is None or i in left]
    out = [(i, t) for i, t in out if passage not in (t or "")]
    library = Tokenizer.from_file(bpe_transducer.default_vocabulary())
    want = Counter()
    for i, t in out:
        t = t or ""
        for a, _, _, b in reversed(secrets(t)):
            t = t[:a] + "[SECRET]" + t[b:]
        want[i, tuple(library.encode(t, add_special_tokens=False).ids)] += 1
    assert Counter((x.doc_id, tuple(x.ids)) for x in got.collect()) == want and got.columns == ["doc_id", "n_tokens", "ids"]


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_cluster_needs_a_shared_folder(spark):
    from folioflow.llm import common

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = type("C", (), {"get": lambda self, k, d: None})(), Context()

    with pytest.raises(ValueError):
        common.shared_dir(Session())


@pytest.mark.parametrize("name", ["op2_secret_ledger", "op7_suffix_dedup", "op10_phrase_automata"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from folioflow.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = queries.queries()[name](spark, sf)
    rel = con.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()[name]})")
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())
