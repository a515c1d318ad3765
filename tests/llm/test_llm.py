"""Each operator against brute force, exact round trips or held-out accuracy, and its edge cases."""

import math
import os
import re
import struct
import subprocess
import sys
import time
import zlib
from collections import Counter, defaultdict
from itertools import product

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from riskengine.llm import decontamination as de
from riskengine.llm import langid_crf as crf
from riskengine.llm import license_scan as ls
from riskengine.llm import lm_kneser_ney as lm
from riskengine.llm import media_audio as ma
from riskengine.llm import packing as pk
from riskengine.llm import preference_format as pf
from riskengine.llm import queries as q
from riskengine.llm import simhash_anchor as sh
from riskengine.llm import toxicity_ftrl as tox
from riskengine.llm import url_filter as uf
from riskengine.llm import words as wd

ODD = [None, "", " \n\t ", "a", "A b", "ÉCOLE été", "1234 5678!", "😀😀", "x" * 5000, "word " * 3000, "same text here", "same text here"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and columns whose names clash with the operators' own."""
    rows = [(k if k != 3 else None, t, "en" if k % 2 else None, "s", len(t or ""), 7, "e") for k, t in enumerate(ODD)] + [(4, ODD[4], None, "s", 3, 7, "e")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `offset` int, toxicity string")


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def words_of(text, lower=True):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def test_words_are_split_and_hashed_as_bytes():
    got = wd.split_words(pa.array(ODD))
    want = [w for t in ODD for w in words_of(t)]
    assert [got.lower[a:b].tobytes() for a, b in zip(got.start, got.end, strict=True)] == want
    assert got.doc.tolist() == [k for k, t in enumerate(ODD) for _ in words_of(t)]
    h = got.hashes()
    assert len({(w, int(x)) for w, x in zip(want, h, strict=True)}) == len(set(want)) == len(set(h.tolist()))


# --- 1 packing


def check_packing(rows, texts, encode, capacity=2048):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d, text in texts.items():
        ids = [*encode(text or ""), 1]
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            part = ids[r.start : r.start + r.length]
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r.length
        assert at == len(ids)
    for of in by_seq.values():
        at = 0
        for r in sorted(of, key=lambda r: r.offset):
            assert r.offset == at and r.length >= 1
            at += r.length
        assert at <= capacity


def test_packing_keeps_every_id(spark, small, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(q.tokenizer_path())
    t.encode_special_tokens = True
    rows = q.op1_packing(spark, small).collect()
    check_packing(rows, texts, lambda x: t.encode(x, add_special_tokens=False).ids)
    used, sequences = sum(r.length for r in rows), len({r.sequence_id for r in rows})
    assert used / (2048 * sequences) > 0.98


def test_both_encoders_agree():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(q.tokenizer_path())
    t.encode_special_tokens = True
    encode = pk.load_encoder(q.tokenizer_path())
    for x in [*filter(None, ODD), "<|endoftext|> a", "don't  stop\n\n now ", " " * 9000 + "z", "日本語"]:
        assert encode(x).tolist() == t.encode(x, add_special_tokens=False).ids


def test_first_fit_is_first_fit():
    sizes = np.sort(np.random.default_rng(1).integers(1, 101, 300))[::-1]
    bins, offsets = pk.first_fit(sizes, 100)
    room: list[int] = []
    for s, b, o in zip(sizes, bins, offsets, strict=True):
        k = next((k for k, r in enumerate(room) if r >= s), len(room))
        if k == len(room):
            room.append(100)
        assert (b, o) == (k, 100 - room[k])
        room[k] -= s
    assert pk.first_fit(np.zeros(0, np.int64), 10)[0].tolist() == []
    with pytest.raises(ValueError):
        pk.first_fit(np.array([11]), 10)


def test_packing_edges(odd):
    rows = q.packed_pieces(odd).collect()
    assert sum(r.doc_tokens == 1 for r in rows) == 2 and len(rows) >= odd.count()
    assert q.packed_pieces(odd.limit(0)).count() == 0
    kept = pk.pack(odd.withColumn("length", F.lit(3)), 5, keys=("doc_id",))
    assert kept.columns == [*[c for c in odd.columns if c != "offset"], "length", "sequence_id", "offset", "padded_length"] and kept.count() == odd.count()


def test_packing_keeps_large_and_null_ids(spark):
    big = [9007199254740993, 9007199254740995, None, None, -(2**63), 2**63 - 1]
    rows = q.packed_pieces(spark.createDataFrame([(k, "some text") for k in big], "doc_id long, text string").coalesce(1)).collect()
    key = lambda x: (x is None, x or 0)
    assert sorted((r.doc_id for r in rows), key=key) == sorted(big, key=key)
    named = q.packed_pieces(spark.createDataFrame([("a", "x"), (None, "y")], "doc_id string, text string")).collect()
    assert {r.doc_id for r in named} == {"a", None}


# --- 2 audio


@pytest.mark.parametrize("n", [0, 1, 63, 64, 937, 938, 30000])
def test_audio_round_trip(n):
    raw = np.random.default_rng(n).bytes(n)
    payload = raw + bytes(-n % 64 or (0 if n else 64))
    b = ma.encode(payload, n)
    a = ma.parse(b)
    assert ma.payload_of(b, a) == (payload, n)
    assert a.good == a.checked == len(a.frame_offset) + 1 and a.skipped_bytes == 0
    assert a.duration == len(a.frame_offset) * 1152 / ma.Fraction(48000) and a.vbr["frames"] == len(a.frame_offset)
    assert all(ma.read_header(b, o).size == s for o, s in zip(a.frame_offset, a.frame_size, strict=True))


def test_audio_damage_and_other_formats():
    b = ma.encode(bytes(50000), 50000)
    whole = ma.parse(b)
    cut = b[:4000] + b"\xff\xfb\x00garbage" * 40 + b[4000:]
    a = ma.parse(cut)
    assert a.resyncs >= 1 and a.skipped_bytes > 0 and len(a.frame_offset) >= len(whole.frame_offset) - 1
    bad = bytearray(b)
    bad[whole.frame_offset[3] + 4] ^= 1
    assert ma.parse(bytes(bad)).good == whole.good - 1
    layer1 = bytes((0xFF, 0xFF, 0x10, 0xC0)) + bytes(28)  # MPEG-1 Layer I, 32 kbit/s, 44.1 kHz
    h = ma.read_header(layer1, 0)
    assert (h.layer, h.samples, h.size, h.rate) == (1, 384, 32, 44100)
    mpeg2 = ma.read_header(bytes((0xFF, 0xF3, 0x10, 0xC0)), 0)
    assert (mpeg2.samples, mpeg2.rate, mpeg2.size) == (576, 22050, 26)
    vbri = bytes((0xFF, 0xFB, 0x90, 0xC0)) + bytes(32) + b"VBRI" + struct.pack(">HHHIIHHH", 1, 0, 0, 999, 7, 0, 1, 2) + bytes(2)
    assert ma._vbr(vbri, 0, ma.read_header(vbri, 0)) | {"toc": b""} == {"kind": "VBRI", "frames": 7, "bytes": 999, "toc": b"", "scale": 1}
    assert ma.parse(b"").duration == 0 and ma.parse(b"\xff" * 100).frame_offset == []


def frame(header, size, bits, body):
    """A frame whose checksum, over ``bits`` bits of its body, is worked out bit by bit."""
    c = 0xFFFF
    for x in [int(i) for i in "".join(f"{i:08b}" for i in header[2:])] + [int(i) for i in "".join(f"{i:08b}" for i in body)][:bits]:
        c = ((c << 1) ^ (0x8005 if (c >> 15) ^ x else 0)) & 0xFFFF
    return header + struct.pack(">H", c) + body + bytes(size - 6 - len(body))


def test_audio_checksums_of_all_layers():
    draw = np.random.default_rng(5)
    # Layer I, 448 kbit/s, 48 kHz: mono, stereo and joint stereo from subband 8
    for last, bits in ((0xC0, 128), (0x00, 256), (0x50, 4 * (32 + 8))):
        f = frame(bytes((0xFF, 0xFE, 0xE4, last)), 448, bits, draw.bytes(32))
        a = ma.parse(f * 3)
        assert (len(a.frame_offset), a.checked, a.good) == (3, 3, 3)
        assert ma.parse((f[:8] + bytes((f[8] ^ 1,)) + f[9:]) * 3).good == 0
    # Layer II: with all allocations zero and with all set, each set one adds two bits a channel
    for head, size, sums, subbands in (
        ((0xFF, 0xFC, 0xA4, 0x00), 576, 2 * (44 + 36 + 8), 54),  # 192 kbit/s, 48 kHz, stereo: 27 subbands
        ((0xFF, 0xFC, 0xC0, 0x00), 835, 2 * (44 + 36 + 14), 60),  # 256 kbit/s, 44.1 kHz, stereo: 30 subbands
        ((0xFF, 0xFC, 0x28, 0xC0), 216, 8 + 30, 12),  # 48 kbit/s, 32 kHz, mono: 12 subbands
        ((0xFF, 0xFC, 0x24, 0xC0), 144, 8 + 18, 8),  # 48 kbit/s, 48 kHz, mono: 8 subbands
        ((0xFF, 0xF4, 0x84, 0xC0), 384, 16 + 21 + 38, 30),  # MPEG-2, 64 kbit/s, 24 kHz, mono
    ):
        assert ma.read_header(bytes(head), 0).size == size
        for body, extra in ((bytes(100), 0), (b"\xff" * 100, 2 * subbands)):
            a = ma.parse(frame(bytes(head), size, sums + extra, body) * 3)
            assert (a.checked, a.good) == (3, 3)
    joint = frame(bytes((0xFF, 0xFC, 0xA4, 0x40)), 576, 4 * 4 * 2 + (7 * 4 + 12 * 3 + 4 * 2) + 2 * 54, b"\xff" * 100)  # from subband 4 on both channels share
    assert ma.parse(joint * 2).good == 2


def test_audio_delay_free_format_and_tags():
    silent = ma._SILENT[5]
    lame = silent + b"Info" + struct.pack(">III", 11, 4, 0) [:4] + struct.pack(">II", 4, 960) + struct.pack(">I", 50) + b"LAME3.100" + bytes(12) + bytes((0x24, 0x03, 0x00)) + bytes(20)
    b = lame + bytes(192 - len(lame)) + (silent + bytes(192 - len(silent))) * 4
    a = ma.parse(b)
    assert (a.vbr["delay"], a.vbr["padding"], a.trimmed, a.vbr["encoder"]) == (576, 768, 1344, "LAME3.100")
    assert a.duration == ma.Fraction(4 * 1152 - 1344, 48000) and a.first_sample == [0, 1152, 2304, 3456]
    free = bytes((0xFF, 0xFB, 0x04, 0xC0)) + b"x" * 996  # no bit rate, 48 kHz
    padded = bytes((0xFF, 0xFB, 0x06, 0xC0)) + b"x" * 997
    a = ma.parse(free * 3 + padded + free)
    assert a.frame_size == [1000, 1000, 1000, 1001, 1000] and a.skipped_bytes == 0 and a.duration == ma.Fraction(5 * 1152, 48000)
    text = b"\x00A\xff\x00B"  # unsynchronised: 0xFF 0x00 stands for 0xFF
    tags = {
        "2.2": b"ID3\x02\x00\x00" + ma._syncsafe(6 + 3) + b"TT2\x00\x00\x03\x00ab",
        "2.3": b"ID3\x03\x00\xc0" + ma._syncsafe(10 + 10 + 5) + struct.pack(">I", 6) + bytes(6) + b"TIT2" + struct.pack(">I", 4) + bytes(2) + text,
        "2.4": b"ID3\x04\x00\x40" + ma._syncsafe(6 + 10 + 9) + ma._syncsafe(6) + bytes(2) + b"TIT2" + ma._syncsafe(9) + b"\x00\x03" + ma._syncsafe(4) + text,
    }
    said = {k: ma.parse(t + b) for k, t in tags.items()}
    assert {k: next(iter(a.tags.values())) for k, a in said.items()} == {"2.2": "ab", "2.3": "A\xffB", "2.4": "A\xffB"}
    assert all(a.frame_offset[0] == len(tags[k]) + 192 for k, a in said.items())


def test_audio_table(spark, small, texts, odd):
    import hashlib

    for r in q.op2_media_audio(spark, small).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        n = len(r.seek_offsets)
        assert ma.Fraction(r.duration_num, r.duration_den) == ma.Fraction(1152 * n, 48000) and r.seek_samples == [1152 * k for k in range(n)]
    media = ma.store_texts(odd)
    assert ma.digest_media(media).filter("n_bytes = 0").count() == 2 and ma.read_media(media).count() == odd.count()
    assert ma.digest_media(ma.store_texts(odd.limit(0))).count() == 0


# --- 3 language model


def brute_model(train, order=2):
    """Interpolated modified Kneser-Ney of any order, with dictionaries."""
    seqs = [["<s>"] * (order - 1) + [*words_of(t), "</s>"] for t in train]
    count = Counter(w for s in seqs for w in s[order - 1 :])
    grams = {order: Counter(tuple(s[i - order + 1 : i + 1]) for s in seqs for i in range(order - 1, len(s)))}
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    of = lambda values: lm._discounts(np.array([sum(v == k for v in values) for k in (1, 2, 3, 4)]))
    d = {k: of(g.values()) for k, g in grams.items()}
    cut = lambda n, k: 0.0 if n == 0 else d[k][min(n, 3) - 1]
    behind = {k: defaultdict(list) for k in grams}
    for k, g in grams.items():
        for x, n in g.items():
            behind[k][x[:-1]].append(n)
    mass = {k: {c: (sum(cut(x, k) for x in after), sum(after)) for c, after in b.items()} for k, b in behind.items()}

    def p(*gram):
        k, n, (spare, total) = len(gram), grams[len(gram)][gram], mass[len(gram)].get(gram[:-1], (0, 0))
        low = p(*gram[1:]) if k > 1 else 1 / (len(count) + 1)
        return (n - cut(n, k) + spare * low) / total if total else low

    return p, count


@pytest.mark.parametrize(("order", "file_bits"), [(1, 10), (2, 10), (3, 10), (4, 10), (1, 1), (3, 1)])
def test_model_is_kneser_ney(spark, texts, order, file_bits, monkeypatch):
    monkeypatch.setattr(lm, "HOT_SHARE", 300)
    train = [t for k, t in texts.items() if k % 4 == 0]
    model = lm.train(spark.createDataFrame([(t,) for t in train], "text string"), order=order, bytes_per_shard=20000, file_bits=file_bits)
    p, count = brute_model(train, order)
    n, v = sum(count.values()), len(count)
    assert (model.n_tokens, model.n_words) == (n, v) and model.gram_bits > 2 and len(model.hot) > 3
    some = {k: t for k, t in texts.items() if k % 9 == 1 or k % 40 == 0} | {-1: "", -2: "never seen wordz"}
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(list(some.items()), "doc_id long, text string"), model).collect()}
    for k, t in some.items():
        s = ["<s>"] * (order - 1) + [*words_of(t), "</s>"]
        grams = [s[i - order + 1 : i + 1] for i in range(order - 1, len(s))]
        assert got[k].score == pytest.approx(sum(math.log10(p(*g)) for g in grams))
        assert got[k].base_score == pytest.approx(sum(math.log10((count[g[-1]] + 0.5) / (n + 0.5 * (v + 1))) for g in grams))
        assert (got[k].n_tokens, got[k].n_known) == (len(grams), sum(g[-1] in count for g in grams))
    for a in ([], ["<s>"] * 3, [b"the"] * 3, ["nothing"] * 3):
        assert sum(p(*a[: order - 1], b) for b in count) + p(*a[: order - 1], "unseen") == pytest.approx(1) if len(a) >= order - 1 else True


def test_files_are_bounded_whatever_the_shards(spark, texts):
    model = lm.train(spark.createDataFrame([(t,) for t in texts.values()], "text string"), order=2, bytes_per_shard=2000, file_bits=1)
    assert model.word_bits > 4 and model.gram_bits > 5
    names = sorted(n for n in os.listdir(model.folder) if not n.endswith(".off.npy"))
    kinds = ["w{}.hash", "w{}.count", "w{}.left", "g2.{}.one", "g2.{}.many", "g2.{}.count", "c2.{}.one", "c2.{}.key", "c2.{}.stat", "h2.{}.one", "h2.{}.key", "h2.{}.stat"]
    assert set(names) <= {f"{k.format(f'f{f}')}.npy" for k in kinds for f in (0, 1)} and len(names) >= 18
    # a task that is run again finds its file done
    assert lm._put_together(model.folder, "w", "hash", 0, model.word_bits - 1) == len(np.load(f"{model.folder}/wf0.hash.npy"))


def test_lookups_do_not_grow_with_the_shards(tmp_path):
    """Words in 2^20 shards: a batch's needles take a small part of a second, and what they take is the shards' number's logarithm."""
    draw, took = np.random.default_rng(3), {}
    hashes = np.unique(draw.integers(0, 2**64, 2_000_000, dtype=np.uint64))
    needles = np.unique(np.concatenate([draw.choice(hashes, 150_000), draw.integers(0, 2**64, 150_000, dtype=np.uint64)]))
    for bits in (12, 20):
        folder = tmp_path / str(bits)
        folder.mkdir()
        shard = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        base = np.searchsorted(shard, np.arange((1 << bits) + 1))
        for f in range(1 << 10):
            a, b = base[f << (bits - 10)], base[(f + 1) << (bits - 10)]
            np.save(folder / f"wf{f}.hash.npy", hashes[a:b])
            np.save(folder / f"wf{f}.hash.off.npy", base[f << (bits - 10) : ((f + 1) << (bits - 10)) + 1] - a)
            np.save(folder / f"wf{f}.count.npy", np.arange(a, b, dtype=np.uint32))
        model = lm.Model(str(folder), 2, bits, bits, base, 1, np.zeros(0, np.int64))
        model.word_ids(needles)
        began = time.time()
        ids = model.word_ids(needles)
        took[bits] = time.time() - began
        known = np.isin(needles, hashes)
        assert (ids[known] == np.searchsorted(hashes, needles[known])).all() and (ids[~known] == len(hashes) + 1).all()
        assert (model.of_words(np.unique(ids), "count")[:-1] == np.unique(ids)[:-1]).all()
    assert took[20] < 2 * took[12] + 0.2 and took[20] < 2


def test_model_beats_base_on_held_out(spark, small):
    r = q.op3_lm_score(spark, small).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_model_edges(spark, odd):
    empty = lm.train(odd.limit(0))
    assert {r.score for r in lm.score(odd, empty).collect()} == {0.0}
    model = lm.train(odd)
    got = lm.score(odd, model)
    assert got.count() == odd.count() and got.filter("score > 0 OR isnan(score)").count() == 0
    assert lm.score(odd.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        lm.local_folder("hdfs://x/y")


# --- 4 urls


def brute_url(url):
    url = url or ""
    rest = url.partition("://")[2] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(r), r, v) for v, r in q.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_url_rules(spark, small):
    extra = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x", "http://example.com", "http://a.com?x=/en/", "http://x.net/es", "http://x.net/es/", "ftp://e.example.com/en/?q#f", "http://com/", "a://b://c.com/", "http://xcom/"]
    df = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame([(1000 + k, u) for k, u in enumerate(extra)], "page_id long, url string"))
    got = uf.judge(ruled := uf.apply_rules(df, [uf.Rule(*r) for r in q.RULES]), uf.train(ruled)).collect()
    urls = {r.page_id: r.url for r in df.collect()}
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, verdict = brute_url(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and verdict in (None, r.verdict)
    assert uf.judge(uf.apply_rules(df.limit(0), [uf.Rule(*r) for r in q.RULES]), None).count() == 0
    assert uf.train(ruled.limit(0)) is None


def test_url_models_tell_classes_apart():
    draw = np.random.default_rng(0)
    make = lambda a, n: [("http://" + "".join(draw.choice(list(a), 12)) + ".org/").encode() for _ in range(n)]
    model = uf.UrlModel(uf.MarkovModel.fit(make("abcdef", 200), 4), uf.MarkovModel.fit(make("uvwxyz", 200), 4))
    good, bad = (model.ratios(pa.array(make(a, 50), pa.binary())) for a in ("abcdef", "uvwxyz"))
    t = uf._best_threshold(good, bad)
    assert (good > t).all() and (bad < t).all()
    symbol, context, _ = uf._grams(pa.array([b"http://abc"], pa.binary()), 4)
    for k in (0, 5):  # each position's probabilities add up to one
        every = model.accepted.log_likelihoods(np.arange(256, dtype=np.uint64), np.full(256, context[k]))
        assert np.exp(every).sum() == pytest.approx(1)


def test_url_sample_keeps_rare_classes(spark):
    rows = [("http://allowed.org/a", "allow")] * 3000 + [(f"http://allowed.org/{k}", "allow") for k in range(40)]
    for k in range(5):  # whichever fifth its hash falls into
        one = spark.createDataFrame([*rows, (f"http://blocked.net/{k}", "block")], "_url string, rule_verdict string").repartition(3)
        model = uf.train(one, max_urls=30)
        good, bad = model.ratios(pa.array([b"http://allowed.org/zz", f"http://blocked.net/{k}".encode()], pa.binary()))
        assert good > 0 > bad


def test_markov_models_match_dictionaries():
    """Contexts of up to three bytes, each mixed with the next shorter one by the number of bytes seen after it."""
    draw = np.random.default_rng(6)
    urls = ["".join(draw.choice(list("ab/."), int(draw.integers(1, 12)))).encode() for _ in range(60)]
    model = uf.MarkovModel.fit(urls, 3)
    after: dict = defaultdict(Counter)
    padded = lambda u: [0, 0, 0, *u, 0]
    for u in urls:
        b = padded(u)
        for i in range(3, len(b)):
            for k in range(4):
                after[tuple(b[i - k : i])][b[i]] += 1

    def p(context, x, k=3):
        low = p(context, x, k - 1) if k else 1 / 256
        seen = after.get(tuple(context[3 - k :]), {})
        return (seen.get(x, 0) + len(seen) * low) / (sum(seen.values()) + len(seen)) if seen else low

    for u in [*urls[:20], b"zz", b"a" * 30]:
        b = padded(u)
        symbol, context, _ = uf._grams(pa.array([u], pa.binary()), 3)
        want = [math.log(p(b[i - 3 : i], b[i])) for i in range(3, len(b))]
        assert model.log_likelihoods(symbol, context).tolist() == pytest.approx(want)


def test_long_urls_are_learned_from(spark):
    rows = [(f"http://g{k}.org/" + "ab" * 2000, "allow") for k in range(20)] + [(f"http://h{k}.org/" + "yz" * 2000, "block") for k in range(20)]
    good, bad = uf.train(spark.createDataFrame(rows, "_url string, rule_verdict string")).ratios(pa.array([b"http://x.org/" + b"ab" * 50, b"http://x.org/" + b"yz" * 50], pa.binary()))
    assert good > 0 > bad


# --- 5 languages


def some_crf():
    draw = np.random.default_rng(3)
    windows = [(lang, " ".join("".join(draw.choice(list(a), 5)) for _ in range(24)).encode()) for lang, a in (("en", "abcde"), ("de", "defgh"), ("fr", "ghijk")) for _ in range(20)]
    return crf.fit_crf(windows, 12)


def test_word_features_match_loops(monkeypatch):
    """n-grams of 1 to 4 bytes between marks, and the word itself; scores are the same however bytes are cut into blocks."""
    model, texts = some_crf(), ["hello a é ñandú", "x" * 300 + " bb", ""]
    words = wd.split_words(pa.array(texts), crf.WORD_BYTES)
    h = words.hashes()
    features, first = crf.word_features(words.lower, words.start, words.end, h, 12)
    slot = lambda x: int(wd.mix(np.array([x], np.uint64))[0] >> np.uint64(52))
    spelled = [words.lower[a:b].tobytes() for a, b in zip(words.start, words.end, strict=True)]
    for k, w in enumerate(spelled):
        marked = b"\x01" + w + b"\x02"
        grams = [slot((int.from_bytes(marked[i : i + n], "little") * 8 + n) % 2**64) for n in range(1, 5) for i in range(len(marked) - n + 1)]
        assert Counter(features[first[k] : first[k + 1]].tolist()) == Counter([*grams, slot((int(h[k]) + 77) % 2**64)])
    want = model.emissions(features, first)
    for block in (5, 64, 1 << 16):
        monkeypatch.setattr(crf, "_BLOCK", block)
        assert model.word_scores(words.lower, words.start, words.end, h) == pytest.approx(want)


def test_gradient_is_that_of_the_likelihood():
    """A step of the fit moves each weight as the differences of the log-likelihood say."""
    windows = [("a", b"xy yx"), ("b", b"zz xz"), ("b", b"z")]
    model = crf.fit_crf(windows, 8, epochs=1, batch=1 << 10, rate=1e-3, l2=0.0)
    words = wd.split_words(pa.array([w for _, w in windows], pa.binary()), crf.WORD_BYTES)
    features, first = crf.word_features(words.lower, words.start, words.end, words.hashes(), 8)
    gold = np.array([0, 0, 1, 1, 1])
    flat = crf.CrfModel(["a", "b"], 8, np.zeros((256, 2)), np.zeros((2, 2)))

    def likelihood(weight):
        flat.weight = weight
        p = crf.marginals(flat.emissions(features, first), np.arange(6), np.zeros((2, 2)))
        return np.log(p[np.arange(5), gold]).sum()

    for slot in np.unique(features)[:12]:
        for k in range(2):
            step = np.zeros((256, 2))
            step[slot, k] = 1e-4
            slope = (likelihood(step) - likelihood(-step)) / 2e-4
            assert abs(slope) < 1e-9 or np.sign(model.weight[slot, k]) == np.sign(slope)


def test_long_texts_are_labelled_in_pieces():
    model, draw = some_crf(), np.random.default_rng(4)
    raw = " ".join("".join(draw.choice(list("abcdefghijk"), 4)) for _ in range(5000)).encode()
    texts = pa.array([raw], pa.binary())
    words, p = crf._word_marginals(model, texts)
    parts = list(crf.long_marginals(model, np.frombuffer(raw, np.uint8), 3000))
    assert len(parts) > 5 and np.concatenate([x for _, _, x in parts]) == pytest.approx(p)
    assert np.concatenate([w.start + at for at, w, _ in parts]).tolist() == words.start.tolist()


def test_distinct_words_of_a_long_text_take_little_memory():
    """20 MB of different words, labelled in a process that may hold 700 MB beyond what it begins with."""
    code = """
import resource, numpy as np, pyarrow as pa
from riskengine.llm import langid_crf as crf
model = crf.CrfModel(["a", "b", "c", "d"], 16, np.random.default_rng(0).normal(size=(1 << 16, 4)), np.zeros((4, 4)))
raw = np.frombuffer(b"".join(b"%09x " % (k * 7919) for k in range(2_000_000)), np.uint8)
texts = pa.array([raw.tobytes()], pa.binary())
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
total, letter = crf._language_sums(model, texts)
assert letter[0] and abs(total.sum() - total.sum(axis=1)[0]) < 1 and total.sum() > 1e6
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    got = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, check=True)
    assert int(got.stdout) < 200


def test_language_sample_counts_distinct_texts_of_each_language(spark, monkeypatch):
    rows = [("xx", "one text again and again")] * 3000 + [("yy", f"yy text {chr(97 + k % 26)}{chr(97 + k // 26)}") for k in range(30)] * 20
    rows += [("zz", "zz " + "".join(chr(97 + int(c)) for c in str(k))) for k in range(4000)] + [("nn", str(k)) for k in range(50)] + [("ww", "w"), (None, "no language")]
    monkeypatch.setattr(crf, "fit_crf", lambda windows, bits: Counter(lang for lang, _ in windows))
    got = crf.train(spark.createDataFrame(rows, "lang string, text string").repartition(3), max_windows=432)
    assert (got["xx"], got["yy"], got["ww"]) == (1, 30, 1) and set(got) == {"xx", "yy", "zz", "ww"}
    assert 320 < got["zz"] < 480


def test_forward_backward_is_exact():
    draw = np.random.default_rng(2)
    size, a = [1, 4, 0, 3], draw.normal(size=(3, 3))
    first = np.concatenate([[0], np.cumsum(size)])
    e = draw.normal(size=(first[-1], 3))
    got = crf.marginals(e, first, a)
    for i, n in enumerate(size):
        want = np.zeros((n, 3))
        for path in product(range(3), repeat=n):
            w = np.exp(sum(e[first[i] + t, s] for t, s in enumerate(path)) + sum(a[x, y] for x, y in zip(path, path[1:], strict=False))) * (np.exp(a)[:, path[0]].sum() if n else 1)
            for t, s in enumerate(path):
                want[t, s] += w
        if n:
            assert got[first[i] : first[i + 1]] == pytest.approx(want / want.sum(axis=1, keepdims=True))
    long = draw.normal(size=(1000, 3))
    chunks = crf.marginals(long, np.array([0, 1000]), a)
    f, b, t = np.ones(3), np.ones(3), np.exp(a)
    forward, backward = [], [b]
    for x in long:
        f = (f @ t) * np.exp(x)
        f /= f.sum()
        forward.append(f)
    for x in long[:0:-1]:
        b = t @ (np.exp(x) * b)
        b /= b.sum()
        backward.append(b)
    p = np.array(forward) * np.array(backward[::-1])
    assert chunks == pytest.approx(p / p.sum(axis=1, keepdims=True))


def test_languages_held_out(spark, small, docs):
    got = q.op5_language_id(spark, small).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_languages_edges(spark, odd, docs):
    model = crf.train(docs)
    got = {r.doc_id: r for r in crf.predict(odd, model).collect()}
    assert [got[k].lang_pred for k in (0, 1, 2, 6, 7)] == ["und"] * 5 and got[5].lang_pred != "und"
    assert all(0 <= r.lang_score <= 1 for r in got.values())
    assert {r.lang_pred for r in crf.predict(odd, crf.train(odd.limit(0))).collect()} == {"und"}
    assert crf.predict(odd.limit(0), model).count() == 0
    one = {r.lang: r.text for r in docs.filter("length(text) > 500").collect()}
    mixed = " ".join(one["de"].split()[:60] + one["es"].split()[:60])
    spans = crf.label_spans(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first().spans
    share = Counter()
    for s in spans:
        share[s.lang] += s.end - s.start
    assert spans[0].lang == "de" and spans[-1].lang == "es" and share["de"] + share["es"] > 0.95 * len(mixed.encode()) - 200


# --- 6 near duplicates


def brute_print(text):
    w = words_of(text)
    s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=2):
    up = {k: k for k in prints}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {k: root(k) for k in keys}


def test_near_duplicates_match_brute_force(spark, small, texts):
    prints = {k: brute_print(t) for k, t in texts.items()}
    comp = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in q.op6_simhash(spark, small).collect()}
    assert got == {k: (f"{prints[k]:016x}", comp[k]) for k in texts}


def test_replicas_are_not_broadcast(spark, tmp_path):
    """Spark sizes replicas like the fingerprints they come from; here those are a few KB, far below what it broadcasts."""
    spark.range(500).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "fp"))
    found = sh.links(spark.read.parquet(str(tmp_path / "fp")))
    found.collect()
    said = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in said and "Broadcast" not in said


def test_links_of_planted_fingerprints(spark):
    draw = np.random.default_rng(4)
    base = [int(x) for x in draw.integers(0, 2**63, 40)]
    prints = set(base)
    for x in base:
        for n in (1, 2, 3):
            y = x
            for b in draw.choice(64, n, replace=False):
                y ^= 1 << int(b)
            prints.add(y)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = {tuple(r) for r in sh.links(spark.createDataFrame([(signed(x),) for x in prints], "fp long")).collect()}
    want = {(signed(a), signed(b)) for a in prints for b in prints if signed(a) < signed(b) and (a ^ b).bit_count() <= 2}
    assert got == want


def test_a_worker_keeps_all_files_of_a_model_mapped_and_none_open(tmp_path):
    """A batch looks into every file of each kind; at 6 GB of text there are 10,752 of them."""
    assert lm._map.cache_info().maxsize >= 19 << lm.FILE_BITS
    stored = {"a": np.arange(5, dtype=np.uint64), "b.stat": np.arange(12, dtype=np.uint32).reshape(-1, 4), "c": np.zeros(0, np.uint64)}
    for n, x in stored.items():
        lm._save(f"{tmp_path}/{n}.npy", x)
    held = [lm._map(f"{tmp_path}/{n}.npy") for n in stored]
    assert all(h.dtype == x.dtype and h.shape == x.shape and (h == x).all() for h, x in zip(held, stored.values(), strict=True))
    assert lm._map(f"{tmp_path}/d.stat.npy").shape == (0, 4)
    assert not [f for f in os.listdir("/proc/self/fd") if os.path.realpath(f"/proc/self/fd/{f}").startswith(str(tmp_path))]


def test_near_duplicate_edges(odd):
    got = {r.doc_id: r for r in sh.near_duplicates(odd).filter("doc_id IS NOT NULL").collect()}
    assert got[0].fp == got[1].fp == got[2].fp == 0 and got[2].component_id == 0 and got[11].component_id == 10
    assert sh.near_duplicates(odd).count() == odd.count() and sh.near_duplicates(odd.limit(0)).count() == 0


# --- 7 toxicity


def test_toxicity_held_out(spark, small):
    big = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{big}/labels.parquet")
    got = q.op7_toxicity(spark, big).join(labels, "doc_id").filter("held_out")
    r = got.agg(F.sum(F.expr("predicted * toxic")) / F.sum("toxic"), F.sum(F.expr("predicted * (1 - toxic)")) / F.sum(1 - F.col("toxic"))).first()
    assert r[0] > 0.7 and r[1] < 0.01


def test_ftrl_is_sparse_and_learns():
    draw = np.random.default_rng(0)
    rows = [np.unique(np.concatenate([draw.integers(10, 1000, 20), [1] if k % 3 == 0 else [2]])).astype(np.uint32) for k in range(300)]
    m = tox.fit_ftrl(rows, [int(k % 3 == 0) for k in range(300)], 10)
    w = m.dense()
    assert w[1] > 0 > w[2] or w[1] > 1
    assert len(m.index) < 500


def test_toxicity_features_match_loops(monkeypatch):
    """Words, neighbours and words with one between; the same however a long text is cut."""
    texts = ["The cat, the HAT sat 9 é", "one", "", "a b"] + [" ".join(f"w{k % 37}{'x' * (k % 5)}" for k in range(400))]
    hashed = lambda w: wd.hash_spans(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))
    want = []
    for t in texts:
        words = re.findall(rb"[0-9a-z\x80-\xff]+", t.encode().lower())
        h = [hashed(w) for w in words]
        found = {int(wd.mix(x + np.uint64(1))[0] >> np.uint64(44)) for x in h}
        found |= {int(wd.combine(a, b + np.uint64(gap))[0] >> np.uint64(44)) for gap in (1, 2) for a, b in zip(h, h[gap:], strict=False)}
        want.append(found)
    who, what, n = tox.text_features(pa.array(texts), 20)
    assert n == len(texts) and [set(what[who == k].tolist()) for k in range(n)] == want
    for most in (60, 400):
        monkeypatch.setattr(tox, "_PIECE", most)
        monkeypatch.setattr(tox._cut, "__defaults__", (most,))
        assert set(tox.text_features(pa.array(texts[-1:]), 20)[1].tolist()) == want[-1]
        assert set(tox.text_features(pa.array(["q" * 500 + " r " + "s" * 700 + " t u " + "v" * 90]), 20)[1].tolist()) == set(tox._features(wd.split_words(pa.array(["q" * 500 + " r " + "s" * 700 + " t u " + "v" * 90]), tox.WORD_BYTES), 20)[1].tolist())


def test_ftrl_matches_a_plain_loop():
    draw = np.random.default_rng(7)
    rows = [np.unique(draw.integers(0, 60, 8)).astype(np.uint32) for _ in range(80)]
    labels = [int(3 in r or 5 in r) for r in rows]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.3, 0.1
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        cut = 0.0 if i == "bias" else l1
        return 0.0 if abs(z[i]) <= cut else (math.copysign(cut, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(3):
        for r, y in zip(rows, labels, strict=True):
            of = [*r.tolist(), "bias"]
            w = {i: weight(i) for i in of}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in of:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    m = tox.fit_ftrl(rows, labels, 6, alpha, beta, l1, l2, 3)
    assert m.dense().tolist() == pytest.approx([weight(i) for i in range(64)]) and m.intercept == pytest.approx(weight("bias"))


def test_long_labelled_texts_carry_the_signal(spark):
    """Only texts of over 16 KB are labelled; the sample in bytes keeps rows of both labels."""
    filler = " ".join(f"word{k}" for k in range(3000))
    docs = spark.createDataFrame([(k, filler + (" vile" if k % 2 else " kind")) for k in range(40)] + [(100, "vile"), (101, "kind")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    for sizes in ({}, {"max_bytes": 400_000}):
        model = tox.train(docs, labels, **sizes)
        got = {r.doc_id: r.toxicity for r in tox.score(docs, model).filter("doc_id >= 100").collect()}
        assert got[100] > got[101]


def test_toxicity_edges(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (5, None), (None, 1), (10, 0)], "doc_id long, toxic int")
    model = tox.train(odd, labels)
    got = tox.score(odd, model)
    assert got.count() == odd.count() and got.filter("NOT toxicity BETWEEN 0 AND 1").count() == 0
    none = tox.score(odd, tox.train(odd, labels.limit(0)))
    assert none.filter(tox.is_toxic()).count() == 0
    assert tox.score(odd.limit(0), model).count() == 0


# --- 8 benchmark passages


def brute_matches(texts, items):
    out = {}
    for k, text in texts.items():
        w = words_of(text)
        for i, item in items.items():
            v = words_of(item)
            width = min(5, len(v))
            if not v or len(w) < width:
                continue
            s = [tuple(v[j : j + width]) for j in range(len(v) - width + 1)]
            c, known, best = Counter(s), set(s), (0, 0)
            where = [tuple(w[j : j + width]) for j in range(len(w) - width + 1)]
            if not known & set(where):
                continue
            for a in range(max(0, len(w) - len(v)) + 1):
                win = Counter(where[a : a + len(v) - width + 1])
                best = max(best, (2 * sum((win & c).values()) / (win.total() + len(s)), -a))
            if best[0] >= 0.8:
                out[k, i] = (best[0], -best[1])
    return out


def test_benchmark_passages_match_brute_force(spark, small, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    some = dict(texts)
    item = items[3].split()
    some |= {-1: items[3], -2: "x y " + " ".join(item[:-2]) + " tail of text", -3: " ".join(item[: len(item) // 2]), -4: " ".join([*item[:10], "changed", *item[11:]]), -5: "three word item and on"}
    items |= {900: "three word item", 901: "", 902: None, 903: "on on on on on on on"}
    df = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in de.contaminated(df, bench).collect()}
    want = brute_matches(some, items)
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert {k: v[0] for k, v in got.items()} == pytest.approx({k: v[0] for k, v in want.items()})
    assert (-1, 3) in got and (-3, 3) not in got and (-5, 900) in got
    for most in (1 << 30, 9000):  # blocks of one pass, and several passes
        blocks = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in de.contaminated(df, bench, block_bytes=2000, pass_bytes=most).collect()}
        assert blocks == got
    for sizes in ({}, {"block_bytes": 4000, "pass_bytes": 20000}):
        left = {r.doc_id for r in de.remove_contaminated(df, bench, **sizes).collect()}
        assert left == set(some) - {k for k, _ in got}
    same = de.contaminated(df, bench.withColumnRenamed("item_id", "doc_id"), item_col="doc_id")
    assert {(r.doc_id, r.item_doc_id) for r in same.collect()} == set(got)


def test_matches_whose_fingerprints_may_lie_far_apart():
    """Two alternating shingles shifted by one, and passages whose last fifth is one word again and again."""
    alternating = [(f"on {w} on {w} on {w} on {w} on", f"{w} on {w} on {w} on {w} on {w}") for w in ("na", "la", "ha", "so", "oh", "ah")]
    items, texts = (dict(enumerate(x)) for x in zip(*alternating))
    find = lambda texts, items: de.find_items(pa.array([t.encode() for t in texts.values()], pa.binary()), de.ItemIndex.build([(k, i.encode()) for k, i in items.items()]))
    doc, who, _, _, alike = find(texts, items)
    got, want = dict(zip(zip(doc.tolist(), who.tolist()), alike.tolist())), brute_matches(texts, items)
    assert set(want) == {(k, k) for k in items}
    assert got == pytest.approx({k: v[0] for k, v in want.items()})
    passage = [[f"{w}p{k}" for k in range(37)] for w in range(100)]
    items, texts = (dict(enumerate(x)) for x in zip(*[(" ".join(p + [f"end{k}" for k in range(8)]), " ".join(p + ["tail"] * 8)) for p in passage]))
    doc, who, _, _, alike = find(texts, items)
    assert doc.tolist() == who.tolist() and len(doc) >= 90 and alike == pytest.approx(np.full(len(doc), 66 / 82))


def slid_matches(texts, items):
    """The highest similarity of each text and item over every start of a window."""
    out = {}
    for (k, text), (i, item) in product(texts.items(), items.items()):
        w, v = words_of(text), words_of(item)
        width = min(5, len(v))
        if v and len(w) >= width:
            c, where = Counter(tuple(v[j : j + width]) for j in range(len(v) - width + 1)), [tuple(w[j : j + width]) for j in range(len(w) - width + 1)]
            wins = [Counter(where[a : a + c.total()]) for a in range(max(0, len(w) - len(v)) + 1)]
            best = max(2 * (win & c).total() / (win.total() + c.total()) for win in wins)
            if best >= 0.8:
                out[k, i] = best
    return out


def test_windows_slide_over_every_start():
    """Passages with swapped halves or words put in, and random texts of few words against items cut from them."""
    around, body = [f"x{k}" for k in range(150)], [f"w{k}" for k in range(100)]
    inside = lambda v: " ".join(around + v + around)
    more = lambda v, n, m: [f"c{k}" for k in range(m)] + v[m : len(v) // 2] + [f"n{k}" for k in range(n)] + v[len(v) // 2 : len(v) - m] + [f"d{k}" for k in range(m)]
    items = {0: " ".join(body), 1: " ".join(body[:50])}
    texts = {0: inside(body[50:] + body[:50]), 1: inside(body[25:50] + body[:25]), 2: inside(more(body[:50], 4, 2)), 3: inside(more(body, 12, 6))}
    draw = np.random.default_rng(3)
    for k in range(10, 60):
        w = draw.integers(0, 1 + k % 4, 40).astype(str).tolist()
        at, n = draw.integers(0, 30), draw.integers(1, 30)
        v = w[at : at + n]
        items[k], texts[k] = " ".join(v[n // 3 :] + v[: n // 3]), " ".join(w)
    doc, who, start, end, alike = de.find_items(pa.array([t.encode() for t in texts.values()], pa.binary()), de.ItemIndex.build([(k, i.encode()) for k, i in items.items()]))
    names, of = list(texts), list(items)
    got = {(names[d], of[i]): x for d, i, x in zip(doc, who, alike, strict=True)}
    assert {k: got[k] for k in [(0, 0), (1, 1), (2, 1), (3, 0)]} == pytest.approx({(0, 0): 0.958, (1, 1): 0.913, (2, 1): 0.826, (3, 0): 0.833}, abs=5e-4)
    assert got == pytest.approx(slid_matches(texts, items))
    for d, i, a, b, x in zip(doc, who, start, end, alike, strict=True):
        assert slid_matches({0: " ".join(texts[names[d]].split()[a:b])}, {0: items[of[i]]})[0, 0] == pytest.approx(x)


def test_ten_thousand_labels_leave_the_samples_bounded(spark):
    from riskengine.llm.samples import draw_by_label

    rows = spark.range(13000).select(F.when(F.col("id") < 3000, F.concat(F.lit("main"), F.col("id") % 3)).otherwise(F.concat(F.lit("rare"), F.col("id"))).alias("lang"), F.concat(F.lit("some words of text "), F.col("id").cast("string"), F.lit(" and more")).alias("text"))
    hashed = rows.withColumn("h", F.xxhash64("text"))
    drawn = draw_by_label(hashed, "lang", "h", 600)
    assert drawn.count() < 700 and drawn.select("lang").distinct().count() == 37 and drawn.filter("lang LIKE 'main%'").select("lang").distinct().count() == 3
    model = crf.train(rows, max_windows=400, max_languages=8, epochs=1)
    assert len(model.languages) == 8 and {"main0", "main1", "main2"} <= set(model.languages)


def test_index_finds_all_within_the_radius():
    draw = np.random.default_rng(8)
    base = draw.integers(0, 2**64, 300, dtype=np.uint64)
    sizes = draw.integers(5, 9, 300)
    index = de.HammingIndex.build(base, sizes)
    for k in range(200):
        y = int(base[k])
        for b in draw.choice(64, int(draw.integers(0, 24)), replace=False):
            y ^= 1 << int(b)
        want = [i for i in range(300) if sizes[i] == sizes[k] and (int(base[i]) ^ y).bit_count() <= de.RADIUS]
        for search in (index.search, index.look_up):
            assert search(np.array([y], np.uint64), int(sizes[k])).tolist() == want


def test_window_fingerprints_are_majorities():
    s = np.random.default_rng(9).integers(0, 2**64, 400, dtype=np.uint64)
    for n, a, b in ((1, 0, 399), (7, 3, 100), (64, 10, 330), (400, 0, 0)):
        want = [sum(1 << bit for bit in range(64) if 2 * sum(int(x) >> bit & 1 for x in s[k : k + n]) > n) for k in range(a, b + 1)]
        assert de.window_prints(s, a, b, n).tolist() == want


def edited(draw, item: list[str], shared: int, clustered: bool) -> list[str]:
    """An item's words changed in one run, or here and there, until just ``shared`` of its five-word shingles are left."""
    n, words = len(item) - 4, list(item)
    left = lambda w: sum(w[k : k + 5] == item[k : k + 5] for k in range(n))
    if clustered:
        at = int(draw.integers(0, len(item) - (n - shared - 4)))
        for k in range(at, len(item)):
            if left(words) <= shared:
                break
            words[k] = f"new{k}"
        return words
    while left(words) > shared:
        words[int(draw.integers(0, len(item)))] = f"new{draw.integers(0, 1 << 30)}"
    return words


@pytest.mark.parametrize("clustered", [False, True])
def test_index_recall_without_any_shingle_filter(clustered):
    """All windows of a text against all items, by fingerprints alone: of edits down to a similarity of 0.8 at least 0.9 are found."""
    draw, hit, n = np.random.default_rng(11), 0, 0
    items = [[f"i{k}w{j}" for j in range(int(draw.integers(40, 90)))] for k in range(150)]
    index = de.ItemIndex.build([(k, " ".join(i).encode()) for k, i in enumerate(items)])
    for k, item in enumerate(items):
        m = len(item) - 4
        words = edited(draw, item, int(np.ceil(0.8 * m)) + int(draw.integers(0, 3)), clustered)
        shared = sum(words[j : j + 5] == item[j : j + 5] for j in range(m))
        if shared < 0.8 * m:  # one change too many
            continue
        text = wd.split_words(pa.array([" ".join([f"x{j}" for j in range(25)] + words + [f"y{j}" for j in range(25)]).encode()]))
        s = de.shingles(text.hashes(), 5)
        named = {int(x) for seed, h in zip(de.SEEDS, index.hamming) for x in h.look_up(np.unique(de.window_prints(de.seeded(s, seed), 0, len(s) - m, m)), len(item))}
        hit, n = hit + (k in named), n + 1
    assert n > 40 and hit / n >= 0.9


def test_results_come_through_the_index(monkeypatch):
    """An index that finds nothing leaves items of few different shingles only."""
    draw = np.random.default_rng(4)
    items = {k: " ".join(f"i{k}w{j}" for j in range(int(draw.integers(25, 60)))) for k in range(30)} | {100: "a b c d e f g", 101: "on on on on on on on on"}
    texts = {k: f"before {i} behind" for k, i in items.items()}
    index = de.ItemIndex.build([(k, i.encode()) for k, i in items.items()])
    run = lambda: {(list(texts)[d], index.ids[w]) for d, w in zip(*de.find_items(pa.array([t.encode() for t in texts.values()], pa.binary()), index)[:2])}
    assert run() == {(k, k) for k in items}
    monkeypatch.setattr(de.HammingIndex, "search", lambda self, prints, size: np.zeros(0, np.int32))
    assert run() == {(100, 100), (101, 101)}


def test_large_classes_of_equal_size_go_through_the_blocks(monkeypatch):
    monkeypatch.setattr(de, "_DIRECT", 3)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(30)).encode()) for k in range(40)]
    texts = [b"x " + i.replace(b"w29", b"other") + b" y" for _, i in items]
    doc, who, start, _, alike = de.find_items(pa.array(texts, pa.binary()), de.ItemIndex.build(items))
    assert doc.tolist() == who.tolist() == list(range(40)) and set(start) == {0} and alike == pytest.approx(np.full(40, 50 / 52))


def test_an_index_is_a_few_times_the_items_text():
    draw = np.random.default_rng(1)
    items = [(k, " ".join(draw.integers(0, 1 << 30, 20).astype(str)).encode()) for k in range(1000)]
    index = de.ItemIndex.build(items)
    arrays = [index.size, index.width, index.n_shingles, index.shingle, index.item, index.weight, index.plain, *[a for h in index.hamming for a in (h.prints, h.order, h.size, h.key, h.item)]]
    assert sum(a.nbytes for a in arrays) < 10 * sum(len(t) for _, t in items)


def test_repetitive_texts_take_linear_time():
    items = [(k, " ".join([f"w{k % 3}"] * 400).encode()) for k in range(20)]
    began = time.time()
    doc, _, start, end, alike = de.find_items(pa.array([" ".join(["w0"] * 8000).encode()], pa.binary()), de.ItemIndex.build(items))
    assert len(doc) == 7 and set(start) == {0} and set(end) == {400} and set(alike) == {1.0} and time.time() - began < 20


def test_decontamination_edges(spark, odd):
    bench = spark.createDataFrame([(1, "same text here"), (None, "zzz"), (2, None)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in de.contaminated(odd, bench).collect()) == [(10, 1), (11, 1)]
    assert de.remove_contaminated(odd, bench).count() == odd.count() - 2 and de.remove_contaminated(odd, bench).columns == odd.columns
    assert de.contaminated(odd, bench.limit(0)).count() == 0 and de.contaminated(odd.limit(0), bench).count() == 0


# --- 9 licences and 10 preferences


def duck(small):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        path = f"{small}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", ["op9_license_scan", "op10_preference_format"])
def test_sql_parity(spark, small, name):
    ours = q.queries()[name](spark, small)
    cols = sorted(ours.columns)
    theirs = duck(small).execute(f"SELECT {', '.join(cols)} FROM ({q.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(r) for r in ours.select(*cols).collect()) == sorted(theirs)


def test_license_edges(spark, odd):
    mit = ls.TEMPLATES[1][1]
    cases = {1: mit, 2: "code\n" + mit.replace("without", "with out") + "\nmore", 3: "\n".join(mit.split(",")), 4: "released UNDER the -- mit   license", 5: "under the license", 6: None, 7: ""}
    rows = ls.scan_licenses(spark.createDataFrame(list(cases.items()), "doc_id long, text string")).collect()
    got = {(r.doc_id, r.kind): r.license_id for r in rows if r.kind != "window"}
    assert {(r.doc_id, r.position, r.license_id) for r in rows if r.kind == "window"} == {(1, 0, "MIT"), (2, 1, "MIT"), (3, 0, "MIT"), (4, 0, "MIT")}
    assert got == {(1, "line"): "MIT", (2, "line"): "MIT", (2, "paragraph"): "MIT", (2, "text"): "MIT", (3, "text"): "MIT", (3, "paragraph"): "MIT", (4, "line"): "MIT"}
    wrap = lambda t, n: "\n".join(" ".join(t.split()[k : k + n]) for k in range(0, len(t.split()), n))
    bodies = {t: name for name, t in ls.TEMPLATES if len(t) > 100}
    inside = {k: f"# some code here\n{wrap(t, 9)}\nimport os and more\n" + "other words " * 30 for k, t in enumerate(bodies)}
    inside[100] = "x " * 50 + ls.TEMPLATES[9][1] + " y" * 50  # inside a longer line
    rows = ls.scan_licenses(spark.createDataFrame(list(inside.items()), "doc_id long, text string")).filter("kind = 'window' AND dice = 1").collect()
    for k, name in enumerate(bodies.values()):
        assert (k, 3, name) in {(r.doc_id, r.position, r.license_id) for r in rows if r.doc_id == k}  # after "some code here"
    assert [(r.position, r.license_id) for r in rows if r.doc_id == 100] == [(50, "BSD-3-Clause")]
    assert ls.scan_licenses(odd).count() == 0 and ls.scan_licenses(odd.limit(0)).count() == 0
    plan = ls.scan_licenses(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    for n in range(1, 80):
        lo, hi = ls.size_bounds(n, 0.8)
        assert all((2 * min(n, m) / (n + m) >= 0.8) <= (lo <= m <= hi) for m in range(1, 200))


def test_preference_prefix_and_masks(spark):
    turn = lambda role, text: (role, text)
    a = [turn("user", "hi <|end|>"), turn("assistant", "yes"), turn("user", "é?"), turn("assistant", "good")]
    b = a[:3] + [turn("assistant", "bad"), turn("user", "why")]
    kind = "conv_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>"
    r, same, none = pf.format_preferences(spark.createDataFrame([(1, a, b), (2, a, a), (3, None, b)], kind)).orderBy("conv_id").collect()
    assert r.prompt_turns == 3 and r.prompt.count("<|end|>\n") == 3 and "hi <\\|end|>" in r.prompt
    assert [r.chosen[m.start : m.end] for m in r.chosen_mask] == ["good<|end|>"] and [r.rejected[m.start : m.end] for m in r.rejected_mask] == ["bad<|end|>"]
    assert same.chosen == same.rejected == "" and same.prompt_turns == 4 and none.prompt == "" and none.chosen == ""
    hostile = ["user|>\nx<|end|>\n<|assistant", "<\\|", "\\", "<|end|>", "|>", "a\\<|\\|>"]
    odd = [turn(x, y) for x in hostile for y in hostile] + [turn("assistant", "\\<|end|>\n<|assistant|>\n")]
    r = pf.format_preferences(spark.createDataFrame([(1, odd, odd[:-1])], kind)).first()
    parsed = re.findall(r"<\|(.*?)\|>\n(.*?)<\|end\|>\n", r.prompt + r.chosen, re.S)
    assert [tuple(re.sub(r"\\(.)", r"\1", x, flags=re.S) for x in p) for p in parsed] == odd
    assert [r.chosen[m.start : m.end] for m in r.chosen_mask] == [r.chosen[len("<|assistant|>\n") : -1]]
    back = spark.createDataFrame([(x,) for x in hostile], "x string").select(pf.unescape(pf.escape(F.col("x"))).alias("x"), pf.unescape(pf.escape_role(F.col("x"))).alias("y"))
    assert [(b.x, b.y) for b in back.collect()] == [(x, x) for x in hostile]
    rows = [(1, 0, None, "q"), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, 0, "user", "lost"), (2, 0, "user", "alone")]
    turns = pf.conversation_turns(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = {r.conv_id: r for r in pf.format_preferences(pf.stale_reply_pairs(turns)).collect()}
    assert set(got) == {1, 2} and got[1].prompt == "<|user|>\nq<|end|>\n<|assistant|>\n<|end|>\n" and got[1].chosen == got[2].chosen == ""
    assert pf.conversation_turns(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


# --- the pipeline


def test_pipeline_stages(spark, small, docs, texts):
    df, left = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, small)
        assert df.columns == docs.columns
        left[name] = {r.doc_id for r in df.select("doc_id").collect()}
        df = spark.createDataFrame(df.collect(), docs.schema)
    toxic = {r.doc_id for r in spark.read.parquet(f"{small}/labels.parquet").filter("toxic = 1").collect()}
    gone = set(texts) - left["toxicity"]
    assert gone and len(gone - toxic) <= 0.1 * len(texts)
    assert len(left["language id"]) >= 0.97 * len(left["toxicity"])
    comp = brute_components({k: brute_print(texts[k]) for k in left["language id"]})
    assert left["near duplicates"] == set(comp.values())
    items = {r.item_id: r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    hit = {k for k, _ in brute_matches({k: texts[k] for k in left["near duplicates"]}, items)}
    assert left["decontamination"] == left["near duplicates"] - hit
    rows = corpus_pipeline.STAGES[-1][1](spark, df, small).collect()
    assert {r.doc_id for r in rows} == left["decontamination"]


def test_pipeline_stages_keep_odd_rows(spark, small, odd):
    once = corpus_pipeline.keep_one_of_near_duplicates(spark, odd, small)
    assert once.columns == odd.columns
    kept = [(r.doc_id, r.text) for r in once.collect()]
    assert len(kept) == len(set(kept)) and (None, "a") in kept and (10, "same text here") in kept and (11, "same text here") not in kept and kept.count((4, "A b")) == 1
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, small)
        assert out.columns == odd.columns, name
        assert stage(spark, odd.limit(0), small).count() == 0
