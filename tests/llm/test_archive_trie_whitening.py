"""The WARC archive, the prefix trie and whitening, held to brute force and round trips."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskengine.llm import prefix_trie, queries, skew, warc, whitening
from riskengine.session import shared_path


def same_rows(spark_df, sql: str, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    want = sorted(found.fetchall(), key=str)
    assert sorted((tuple(r[c] for c in names) for r in spark_df.collect()), key=str) == want and want


# --- joins by frequent keys


@pytest.mark.parametrize("how", ["inner", "left"])
def test_frequent_keys_join_like_others(spark, how):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 1500).alias("k"), "id")
    table = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = rows.join(table, "k", how)
    got = skew.join_by_key(rows, table, "k", how)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert [r.k for r in skew.frequent_keys(rows, "k").collect()] == [7]


# --- archive


@pytest.fixture(scope="module")
def pages(spark):
    long = "A" * 1500
    rows = [(1, "http://a/\r\nX: y", long), (2, None, long), (3, "u", long), (3, "u", long), (None, "u", long), (4, "u", None), (5, "ü\x7f", "é\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n"), (6, "u", "B" * 999), (7, "u", "B" * 999), (8, "u", "é" * 500), (9, "v", "é" * 500), (None, "u", "C" * 2000), (None, "u", "C" * 2000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.fixture(scope="module")
def archive(spark, pages):
    return warc.archive_pages(pages, shared_path(spark, "t"))


def test_read_back_says_who_revisits_whom(archive, pages):
    held = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    want = []
    for i, body in held:
        ids = [j for j, b in held if b == body and j is not None]
        revisit = len(body) >= 1000 and ids and i != max(ids)
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", max(ids) if revisit else None))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_back(archive).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[3] == "revisit" for r in want) == 4


def test_payloads_are_stored_once(spark, archive, pages):
    stored = [bytes(r.payload) for r in spark.read.parquet(archive.payloads).collect()]
    assert sorted(stored) == sorted({(r.html or "").encode() for r in pages.collect()})


def test_records_are_whole_warc_records(archive, pages):
    records = [bytes(r.record) for r in warc.original_records(archive).collect()]
    found = list(warc.parse_warc(io.BytesIO(b"".join(r + b"\r\n\r\n" for r in records))))
    assert [h + p for _, h, p in found] == records
    for _, header, payload in found:
        fields = dict(line.split(": ", 1) for line in header.split(b"\r\n\r\n")[0].decode().split("\r\n")[1:])
        assert int(fields["Content-Length"]) == len(header.split(b"\r\n\r\n", 1)[1]) + len(payload)
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        else:
            assert payload == b"" and fields["WARC-Refers-To"] == "<urn:page:3>" or fields["WARC-Refers-To"] == "<urn:page:9>"
    assert any(b"WARC-Target-URI: http://a/%0D%0AX: y\r\n" in r for r in records) and any(b"\xc3\xbc%7F\r\n" in r for r in records)


def test_files_round_trip_through_a_second_archive(spark, archive):
    records = warc.original_records(archive)
    want = sorted(bytes(r.record) for r in records.collect())
    path = shared_path(spark, "files")
    warc.write_warc(records, path, records_per_file=4)
    back = warc.read_warc(spark, path)
    assert sorted(bytes(r.header) + bytes(r.payload) for r in back.collect()) == want
    again = warc.original_records(warc.archive_records(back, shared_path(spark, "again")))
    assert sorted(bytes(r.record) for r in again.collect()) == want


def test_bytes_that_are_no_text_survive(spark):
    body = bytes(range(256)) * 8
    records = spark.createDataFrame([("a", b"WARC/1.1\r\nContent-Length: 2048\r\n\r\n", body), ("b", b"WARC/1.1\r\nContent-Length: 0\r\n\r\n", None)], "id string, header binary, payload binary")
    held = warc.archive_records(records, shared_path(spark, "bytes"))
    path = shared_path(spark, "raw")
    warc.write_warc(warc.original_records(held), path)
    assert sorted(bytes(r.payload) for r in warc.read_warc(spark, path).collect()) == [b"", body]


def test_members_of_a_gzip_file_are_read_one_by_one(tmp_path, spark):
    one = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:%d>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "x.warc.gz").write_bytes(b"".join(gzip.compress(one % k) for k in range(3)))
    (tmp_path / "y.warc").write_bytes(one % 9)
    assert sorted((r.id, bytes(r.payload)) for r in warc.read_warc(spark, str(tmp_path)).collect()) == [(f"<urn:x:{k}>", b"abc") for k in (0, 1, 2, 9)]
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse_warc(io.BytesIO(one[:-6] % 1)))


def test_a_wrong_payload_stops_the_reader(spark, pages):
    held = warc.archive_pages(pages, shared_path(spark, "t"))
    other = shared_path(spark, "bad")
    spark.read.parquet(held.payloads).withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(other)
    with pytest.raises(Exception, match="does not match its address"):
        warc.read_back(warc.Archive(spark, held.headers, other)).collect()


def test_a_page_that_a_third_of_all_rows_repeat(spark):
    rows = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, F.repeat(F.lit("x"), 1200)).otherwise(F.concat(F.repeat(F.lit("y"), 1200), (F.col("id") % 1000).cast("string"))).alias("html"))
    got = warc.read_back(warc.archive_pages(rows, shared_path(spark, "hot")))
    assert got.filter("record_type = 'revisit' AND refers_to = 2997").count() == 999
    assert got.filter("record_type = 'response'").count() == 1 + rows.filter("page_id % 3 <> 0").select("html").distinct().count()


def test_an_empty_table_gives_an_empty_archive(spark, pages):
    assert warc.read_back(warc.archive_pages(pages.limit(0), shared_path(spark, "none"))).count() == 0


def test_extra_columns_of_other_names_do_not_clash(spark, pages):
    odd = pages.select("*", F.lit(1).alias("address"), F.lit(2).alias("payload"), F.lit(3).alias("header"), F.lit(4).alias("n"), F.lit(5).alias("_id"))
    assert warc.read_back(warc.archive_pages(odd, shared_path(spark, "odd"))).count() == pages.count()


def test_archive_query_is_its_sql(spark, small):
    same_rows(queries.op11_warc(spark, small), warc.ORACLE, pages=f"{small}/pages.parquet")


# --- trie


def rebuilt(rows):
    own: dict[int, list] = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute_trie(rows):
    members: dict[tuple, list[int]] = {}
    whole = rebuilt(rows)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children: dict[tuple, int] = {}
    for p in members:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        own = (len(m) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += own
    ends: dict[tuple, list[int]] = {}
    for c, turns in whole.items():
        ends.setdefault(tuple(turns), []).append(c)
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p], digest(p)) for p, m in members.items()]


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_of(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3)
    return prefix_trie.build(prefix_trie.share_openings(prefix_trie.numbered_turns(df)))


def check_trie(spark, rows):
    found = trie_of(spark, rows).collect()
    assert sorted((tuple(r[n] for n in NODE) for r in found), key=str) == sorted(brute_trie(rows), key=str)
    # intervals: every node's is the union of its own place and its children's
    inside = {r.position: r for r in found}
    assert len(inside) == len(found)
    for r in found:
        below = [x for x in found if r.position <= x.position <= r.subtree_end]
        assert len([x for x in below if x.n_children == 0]) == r.n_leaves and all(x.subtree_end <= r.subtree_end for x in below)


def test_trie_is_brute_force_on_random_conversations(spark):
    draw = np.random.default_rng(5)
    rows = [(int(c), t, ["user", "assistant", None][int(draw.integers(0, 3))] if t % 2 else "user", "ab"[int(draw.integers(0, 2))] * int(draw.integers(0, 3))) for c in [*range(40), *range(95, 130), 305, 411] for t in range(int(draw.integers(1, 7)))]
    rows += [(200, None, "user", "a"), (200, 3, None, None), (200, 3, None, None), (200, 3, "user", "é" * 5), (None, 1, "user", "x"), (300, 0, "user", None), (300, 0, "user", None)]
    check_trie(spark, rows)


def test_trie_of_conversations_longer_than_a_block_of_blocks(spark):
    long = [(c, t, "user", f"t{t}" if t < 1500 - c else f"own {c} {t}") for c in (0, 1, 2, 60) for t in range(1000 + 30 * c if c < 3 else 40)]
    got = {tuple(r[n] for n in NODE) for r in trie_of(spark, long).collect()}
    assert got == set(brute_trie(long))


def test_trie_where_a_third_of_all_rows_are_one_conversation_or_opening(spark):
    rows = [(c, 0, "user", "hello") for c in range(0, 3000, 100)] + [(c, 1, "user", f"x{c % 7}") for c in range(0, 3000, 100)] + [(c, t, "user", "same") for c in range(1, 60) for t in range(7)] + [(4000, t, "user", "again") for t in range(300)]
    got = sorted((tuple(r[n] for n in NODE) for r in trie_of(spark, rows).collect()), key=str)
    assert got == sorted(brute_trie(rows), key=str)


def test_turnless_conversations_belong_to_the_root(spark):
    alone = [c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 1][:3]  # their hundred has no first conversation
    got = trie_of(spark, [(c, 0, "user", "gone") for c in alone]).collect()
    assert len(got) == 1 and got[0].n_convs == 3 and got[0].n_leaves == 1 and got[0].ends_sha256 == hashlib.sha256(",".join(map(str, alone)).encode()).hexdigest()


def test_long_lists_of_ends_are_hashed_in_order(spark):
    ids = spark.range(0, 30000).select(F.col("id").alias("c")).repartition(5)
    got = prefix_trie._digests(ids.select((F.col("c") % 2).alias("rank"), "c")).collect()
    assert {r.rank: r.ends_sha256 for r in got} == {k: hashlib.sha256(",".join(str(c) for c in range(k, 30000, 2)).encode()).hexdigest() for k in (0, 1)}


def test_a_trie_of_nothing_has_no_node(spark):
    assert trie_of(spark, [(None, 1, "a", "b")]).count() == 0


def test_trie_query_is_its_sql(spark, small):
    same_rows(queries.op12_prefix_trie(spark, small), prefix_trie.ORACLE, conversations=f"{small}/conversations.parquet")


# --- whitening


def brute_whitening(vectors):
    x = np.floor(256 * np.array(vectors, np.float64)).astype(np.int64)
    u = np.unique(x, axis=0)
    n, sums = len(u), u.sum(0)
    v = (u - sums / n).T @ (u - sums / n) / n
    value, axes = np.linalg.eigh(v)
    return x, n, sums, v, value[::-1], axes[:, ::-1]


def test_whitening_is_brute_force(spark):
    draw = np.random.default_rng(3)
    base = (draw.normal(size=(300, 12)) * np.linspace(0.1, 1.3, 12)).astype(np.float32)
    vectors = np.concatenate([base, base[:50], np.repeat(base[:1], 150, axis=0)]).tolist()
    bad = [None, [], [1.0] * 11 + [None], [1.0] * 11 + [float("nan")], [1.0] * 11 + [float("inf")], [1.0] * 5]
    df = spark.createDataFrame(list(enumerate(vectors + bad)), "vec_id long, embedding array<float>").repartition(7)
    model = whitening.fit(df)
    got = {(r.vec_id, r.component): r for r in whitening.transform(df, model).collect()}
    x, n, sums, v, value, axes = brute_whitening(vectors)
    assert set(got) == {(k, c) for k in range(len(vectors)) for c in (1, 2, 3, 4)}
    white = (x - sums / n) @ axes[:, :4] / np.sqrt(value[:4])
    for c in range(4):
        mine = np.array([got[k, c + 1].whitened for k in range(len(vectors))])
        assert min(np.abs(mine - white[:, c]).max(), np.abs(mine + white[:, c]).max()) < 1e-9
        assert abs(got[0, c + 1].explained - value[c] / np.trace(v)) < 1e-12
    assert [got[k, 1].deviation for k in range(len(vectors))] == [int(d) for d in ((n * x - sums) ** 2).sum(1)]
    assert {r.n for r in got.values()} == {n} and max(r.identity_error for r in got.values()) < 1e-9 and len({r.identity_error for r in got.values()}) == 1


@pytest.mark.parametrize("most", [1 << 3, 1 << 19, 1 << 21, 1 << 40, 1 << 61, (1 << 63) - 1])
def test_products_of_limbs_are_exact(most):
    draw = np.random.default_rng(1)
    y = draw.integers(-most, most, size=(70, 5), endpoint=True)
    y[0], y[1] = most, -most
    exact = y.astype(object)
    assert (whitening.exact_gram(y) == exact.T @ exact).all()
    assert sum((part.astype(np.int64).astype(object) * (1 << (whitening.LIMB * k)) for k, part in enumerate(whitening.limbs(y))), 0).tolist() == exact.tolist()
    big = exact * (1 << 70)
    assert (whitening.exact_gram(big) == big.T @ big).all()


def test_full_blocks_stay_below_the_exact_integers_of_float64():
    y = np.full((whitening.ROWS * 2 + 5, 2), (1 << whitening.LIMB) - 1)
    assert whitening.exact_gram(y)[0, 1] == len(y) * ((1 << whitening.LIMB) - 1) ** 2
    assert whitening.ROWS * ((1 << whitening.LIMB) - 1) ** 2 < 1 << 53


def test_covariance_is_exact_where_floats_would_cancel(spark):
    # a large common offset leaves nothing of the variance in float64 products that are not centred
    rows = [(k, [float(1 << 40) + k / 256, float(k % 3)]) for k in range(50)]
    model = whitening.fit(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    x = [((1 << 48) + k, 256 * (k % 3)) for k in range(50)]
    mean = [Fraction(sum(r[j] for r in x), 50) for j in (0, 1)]
    want = [[float(sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in x) / 50) for j in (0, 1)] for i in (0, 1)]
    assert model.covariance.tolist() == want


def test_values_beyond_a_long_and_rows_without_variance(spark):
    huge = whitening.transform(df := spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>"), whitening.fit(df)).collect()
    assert len(huge) == 6 and {r.deviation for r in huge if r.vec_id == 1} == {None} and {r.n for r in huge} == {3}
    one = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], "vec_id long, embedding array<float>")
    assert {(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.transform(one, whitening.fit(one)).collect()} == {(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)}
    flat = spark.createDataFrame([(k, [k / 4.0, 1.0, 2.0]) for k in range(8)], "vec_id long, embedding array<float>")
    got = whitening.transform(flat, whitening.fit(flat)).collect()
    assert len(got) == 24 and {r.whitened is None for r in got if r.component > 1} == {True} and all(r.identity_error < 1e-12 for r in got)


def test_whitening_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")
    got = whitening.transform(df, whitening.fit(df))
    assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_query_covers_its_table(spark, small):
    got = queries.op13_whitening(spark, small)
    assert got.count() == 4 * spark.read.parquet(f"{small}/embeddings.parquet").count()
