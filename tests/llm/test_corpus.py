"""Language ID, quality, packing, mixing, archives, URL reputation and the pipeline."""

import base64
import gzip
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest

from trialframe.llm import langid, mixing, packing, quality, url_reputation, warc
from trialframe.llm.common import store, word_hashes

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_word_hashes_follow_words():
    texts = ["a bb  a", None, "", "x" * 3_000_000 + " a", "A a"]
    h, first = word_hashes(texts)
    assert first.tolist() == [0, 3, 3, 3, 5, 7] and h[0] == h[2] == h[4] == h[6] and h[5] != h[6]
    folded, _ = word_hashes(["A a"], fold=True)
    assert folded[0] == folded[1]


# language ID ------------------------------------------------------------------

def test_packed_grams_are_plain_grams():
    got = [(g, d) for gram, doc, _ in langid.packed_grams(["Ab, c", None, "x"], 3)
           for g, d in zip(gram.tolist(), doc.tolist())]
    a, b, c, x = map(ord, "abcx")
    s = langid.CLASS

    def pack(*v):
        return sum(n << (s * (len(v) - 1 - i)) for i, n in enumerate(v))

    assert [g for g, d in got if d == 0] == [pack(0, 0, a), pack(0, a, b), pack(a, b, 0), pack(b, 0, c),
                                             pack(0, c, 0)]
    assert pack(0, 0, x) in [g for g, d in got if d == 2]


def test_language_accuracy_and_edges(spark, docs_of, documents):
    from pyspark.sql import functions as F

    odd = docs_of([(10_001, None, "en", "s"), (10_002, "123 !?", "en", "s"), (10_003, "", None, "s")])
    docs = documents.unionByName(odd)
    found = langid.identify(docs, F.col("doc_id") % 4 != 2).collect()
    truth = {r.doc_id: r.lang for r in documents.collect()}
    held = [r for r in found if r.doc_id % 4 == 2 and r.doc_id < 10_000]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in found)
    assert {(r.lang_pred, r.score, r.accepted) for r in found if r.doc_id > 10_000} == {("und", 0.0, False)}
    assert {r.lang_pred for r in langid.identify(documents, F.lit(False)).collect()} == {"und"}
    assert langid.identify(docs.limit(0), F.lit(True)).count() == 0


def test_kneser_ney_sums_to_one(spark):
    df = spark.createDataFrame([("x", "abab abba"), ("y", "ccc cac")], "lang string, text string")
    m = langid.learn(df, order=3)
    classes = [0, *range(4096)][1:]
    context = (ord("a") << langid.CLASS) | ord("b")
    grams = np.array([(context << langid.CLASS) | c for c in classes], np.uint64)
    assert np.allclose(np.exp(m.lookup(grams)).sum(0), 1, atol=1e-3)


def test_every_gram_has_its_own_key(spark):
    rng = np.random.default_rng(5)
    alphabet = np.array(list("abcdefghijklmnopqrstuvwxyz漢字語文한글날\U00020000\U00020001"))
    texts = ["".join(rng.choice(alphabet, 4000)) for _ in range(30)]
    df = spark.createDataFrame([("xy"[i % 2], t) for i, t in enumerate(texts)], "lang string, text string")
    m = langid.learn(df)
    units = []
    for t in texts:
        raw = np.frombuffer(f" {t} ".encode("utf-16-le"), np.uint16).tolist()
        units.append([0, 0, *(0 if u == 32 else u for u in raw)])
    for k in range(1, 5):
        want = {tuple(u[i - k + 1:i + 1]) for u in units for i in range(3, len(u))}
        assert len(m.keys[k]) == len(want)
        assert set(m.keys[k].tolist()) == {sum(c << 16 * (k - 1 - j) for j, c in enumerate(w)) for w in want}


# quality ----------------------------------------------------------------------

def test_quality_features_come_in_small_batches():
    """A large Arrow batch is worked and sent on in parts, with the features of every row."""
    import pyarrow as pa

    n = 2 * quality.ROWS + 5
    texts = [None if i % 50 == 0 else f"text {i} of many " * (i % 9) for i in range(n)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n), pa.int64()), pa.array([i % 2 for i in range(n)], pa.int32()), pa.array(range(n), pa.int64()),
         pa.array(texts), pa.array(["s"] * n), pa.array([None] * n, pa.string()), pa.array(range(n), pa.int64())],
        names=["doc_id", "quality", "key", "text", "source", "lang", "n_chars"])
    out = list(quality._features(iter([batch, batch.slice(0, 0)])))
    assert [b.num_rows for b in out] == [quality.ROWS, quality.ROWS, 5]
    rows = pa.Table.from_batches(out)
    assert rows.column("doc_id").to_pylist() == list(range(n))
    got = np.frombuffer(b"".join(rows.column("xt").to_pylist()), np.float32).reshape(n, -1)
    assert (got == quality.text_features(texts)).all()


def test_quality_on_documents_kept_aside(spark, sf, documents):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(documents, labels.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r.keep for r in quality.score_quality(documents, model).collect()}
    aside = labels.where("doc_id % 5 = 0").collect()
    assert np.mean([got[r.doc_id] == bool(r.quality) for r in aside]) > 0.85


def test_exchange_covers_all_unlabelled_documents(spark):
    docs = spark.range(40_000).selectExpr(
        "id as doc_id", "if(id % 2 = 0, 'a calm line of words ', '!!## 00 ') || id as text", "'en' as lang",
        "if(id % 2 = 0, 'book', 'spam') as source", "if(id % 2 = 0, 30L, 12L) as n_chars")
    labels = docs.where("doc_id < 400").selectExpr("doc_id", "cast(1 - doc_id % 2 as int) as quality")
    model = quality.train(docs, labels)
    share = int(39_600 * 0.02)
    # Both views are sure of all; equal scores are drawn by a hash, and few rows twice wanted.
    assert 5 * 2 * share * 0.9 < model.given < 5 * 2 * share * 1.1
    assert model.given > 5 * 2 * int(12_000 * 0.02)  # all that a pool of 12 000 could give


def test_refit_is_newton_over_all_rows(spark):
    rng = np.random.default_rng(3)
    xt, xm = (rng.normal(size=(300, n)).astype(np.float32) * 0.2 for n in (quality.TEXT_WIDTH, quality.META_WIDTH))
    xt[:, -1] = xm[:, -1] = 1
    y = (xt[:, 0] + xm[:, 0] + rng.normal(scale=0.2, size=300) > 0).astype(int)
    by = rng.integers(0, 2, 300)
    own = np.arange(300) < 80
    given = spark.createDataFrame([(int(b), int(q), bytearray(a.tobytes()), bytearray(m.tobytes())) for b, q, a, m in
                                   zip(by[~own], y[~own], xt[~own], xm[~own])], "by int, label int, xt binary, xm binary")
    w = quality._refit([given], [xt[own], xm[own], y[own].astype(float)],
                       [np.zeros(quality.TEXT_WIDTH), np.zeros(quality.META_WIDTH)])
    for k, x in enumerate((xt, xm)):
        rows = own | (by == 1 - k)
        assert np.allclose(w[k], quality.fit_logistic(x[rows], y[rows].astype(float)), atol=1e-4)


def test_quality_exchange_takes_all_documents_not_fitted_on(spark, sf, documents, monkeypatch):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    seen = {}
    learn = quality.co_train

    def watched(xt, xm, y, pool, aside, rounds):
        seen.update(fitted=len(y), pool=pool.count())
        return learn(xt, xm, y, pool, aside, rounds)

    monkeypatch.setattr(quality, "co_train", watched)
    model = quality.train(documents, labels, max_labelled=40, rounds=1)
    assert seen == {"fitted": 40, "pool": documents.count() - 40}
    assert quality.score_quality(documents, model).where("score between 0 and 1").count() == documents.count()


def test_quality_edges(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    docs = docs_of([(1, None, None, None), (1, "", "", ""), (None, "a", "en", "s")])
    model = quality.train(docs, labels)
    rows = quality.score_quality(docs.selectExpr("*", "1 as score"), model).collect()
    assert [r.keep for r in rows] == [True] * 3 and len(rows[0]) == 9
    assert quality.score_quality(docs_of([]), model).count() == 0
    assert quality.text_features(["x" * 3_000_000, None, ""]).shape == (3, quality.TEXT_WIDTH)


# packing ----------------------------------------------------------------------

def test_fast_encoder_has_the_ids_of_the_tokenizer(documents):
    from tokenizers import Tokenizer

    own, fast = Tokenizer.from_file(TOKENIZER), packing.encoder(TOKENIZER)
    texts = [r.text for r in documents.limit(60).collect()]
    texts += ["", " ", "a<|endoftext|>b", "naïve 漢字 \u200b\u00a0x", "  lead\n\n\ttabs  ", "It's 12345's"]
    for t in texts:
        assert list(fast(t)) == own.encode(t, add_special_tokens=False).ids


def test_packing_round_trip(spark, docs_of, documents):
    odd = docs_of([(9001, None, "", ""), (9002, "", "", ""), (9003, "word " * 5000, "", ""),
                   (9003, "word " * 5000, "", "")])
    docs = documents.unionByName(odd)
    got = packing.pack(docs, TOKENIZER).collect()
    encode = packing.encoder(TOKENIZER)
    ids = {r.doc_id: np.array([*encode(r.text or ""), 2], "<u4") for r in docs.collect()}
    by_seq, total = {}, {}
    for r in got:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        assert r.length == 1024 or r.piece == 0
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert all(total[i] == len(ids[i]) * (2 if i == 9003 else 1) for i in ids)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    bound = -(-sum(r.length for r in got) // 1024)
    assert len(by_seq) <= bound * 1.02 + 2
    assert packing.pack(docs_of([]), TOKENIZER).count() == 0


def test_patterns_hold_every_piece():
    rng = np.random.default_rng(1)
    for counts in ({1024: 3, 700: 5, 330: 4, 3: 7}, {600: 1}, {400: 5}, {},
                   dict(zip(rng.integers(1, 1025, 300).tolist(), rng.integers(1, 40, 300).tolist()))):
        patterns = packing.pack_counts(counts, 1024)
        back = {}
        for p, c in patterns:
            assert sum(p) <= 1024 and sum(3 * n > 1024 for n in p) <= 2
            for n in p:
                back[n] = back.get(n, 0) + c
        assert back == counts


# mixing -----------------------------------------------------------------------

def mixed(spark, sizes):
    rows = [(i, "w " * 10, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mixing_meets_entropy_and_budget(spark):
    docs = mixed(spark, {"a": 6000, "b": 1000, "c": 500})
    out = mixing.mix_sources(docs, target_entropy=0.9)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    p = np.array(list(n.values())) / sum(n.values())
    assert abs(-(p * np.log(p)).sum() / np.log(3) - 0.9) < 0.01 and abs(sum(n.values()) - 7500) < 100
    copies = out.where("source = 'c'").groupBy("doc_id").count().agg({"count": "max"}).first()[0]
    assert copies == -(-n["c"] // 500) or copies == -(-n["c"] // 500) + 1


def test_mixing_limits_repetition_and_keeps_all(spark):
    docs = mixed(spark, {"a": 4000, "b": 400, None: 300})
    out = mixing.mix_sources(docs, max_repeat=1.5, keep_all=True)
    assert out.select("doc_id").distinct().count() == 4700
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert n["a"] == 4000 and 400 <= n["b"] <= 600 and 430 <= n[None] <= 450
    limited = mixing.mix_sources(docs, max_repeat=2.0).groupBy("doc_id").count().agg({"count": "max"}).first()[0]
    assert limited <= 2


def test_pipeline_mixes_uneven_sources(spark):
    """The smallest source is passed four times, the largest once; none is cut."""
    from pyspark.sql import functions as F

    import corpus_pipeline as c

    docs = mixed(spark, {"a": 3000, "b": 1000, "c": 100}).withColumn("lang", F.lit("en")).withColumn("n_chars", F.lit(1))
    out = c.temperature_mixing(spark, docs, "").groupBy("source").agg(
        F.count("*").alias("n"), F.countDistinct("doc_id").alias("d")).collect()
    got = {r["source"]: (r["n"], r["d"]) for r in out}
    assert {k: d for k, (_, d) in got.items()} == {"a": 3000, "b": 1000, "c": 100}
    assert got["a"][0] == 3000 and 3.5 < got["c"][0] / 100 <= 4


def test_mixing_edges(spark, docs_of):
    assert mixing.mix_sources(docs_of([]), target_entropy=0.5).count() == 0
    odd = docs_of([(None, None, None, None), (1, "", None, None), (2, "a b", None, "x")])
    assert mixing.mix_sources(odd.selectExpr("*", "9 as epoch"), max_repeat=1.0, keep_all=True).count() == 3
    with pytest.raises(ValueError):
        mixing.mix_sources(odd)


# archives ---------------------------------------------------------------------

def test_archive_round_trip(spark, tmp_path):
    long = "é" * 50_000 + "\r\n\r\nWARC/1.1\r\n\r\n"
    pages = spark.createDataFrame(
        [(1, "http://a/", "same"), (2, "http://b/ x\r\ny", "same"), (3, None, None), (4, "http://c/", ""),
         (5, "http://d/", long), (6, "http://d/", long), (7, "http://e/", "x" * 700), (None, "http://f/", "same"),
         (8, "http://g/", "same2"), (8, "http://g/", "same2")],
        "page_id long, url string, html string")
    path = warc.write_archives(pages.selectExpr("*", "'c' as value"), str(tmp_path / "w"), segment_bytes=512,
                               chunk_bytes=100)
    got = warc.archive_report(warc.read_archives(spark, path)).collect()
    assert len(got) == 10 and all(r.verified for r in got)
    by_id = {r.page_id: r for r in got}
    texts = {1: "same", 2: "same", 3: "", 4: "", 5: long, 6: long, 7: "x" * 700, 8: "same2", None: "same"}
    for i, t in texts.items():
        assert by_id[i].payload_bytes == len(t.encode())
        assert by_id[i].payload_digest == base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    refers = {i: r.refers_to for i, r in by_id.items()}
    assert refers == {1: 2, 2: None, 3: 4, 4: None, 5: 6, 6: None, 7: None, None: 2, 8: None}
    small = warc.write_archives(pages, str(tmp_path / "v"), min_bytes=1)
    kinds = {r.page_id: r.record_type for r in warc.archive_report(warc.read_archives(spark, small)).collect()}
    assert kinds[3] == kinds[4] == "response" and kinds[1] == "revisit"


def test_broken_archives(spark, tmp_path):
    def rec(fields, block):
        return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields)
                + f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    whole = http + b"3;x=1\r\nabc\r\n2\r\nde\r\n0\r\nT: 1\r\n\r\n"
    cont = [("WARC-Type", "continuation"), ("WARC-Segment-Origin-ID", "<a>")]
    data = rec([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<i>")], b"x")
    data += rec([*cont, ("WARC-Segment-Number", 2), ("WARC-Segment-Total-Length", len(whole))], whole[60:])
    data += rec([("WARC-Type", "response"), ("WARC-Record-ID", "<a>"), ("WARC-Segment-Number", 1)], whole[:60])
    data += rec([("WARC-Type", "response"), ("WARC-Record-ID", "<b>"), ("WARC-Segment-Number", 1)], whole)
    data += rec([("WARC-Type", "response"), ("WARC-Record-ID", "<c>")], http + b"zz\r\nabc")
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(data[:100]) + gzip.compress(data[100:]))
    got = {r.record_id: r for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert bytes(got["<a>"].payload) == b"abcde" and got["<a>"].intact and got["<a>"].segment == 2
    assert not got["<b>"].intact and not got["<c>"].intact and len(got) == 3


def test_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    path = warc.write_archives(none, str(tmp_path / "n"))
    assert warc.archive_report(warc.read_archives(spark, path)).count() == 0


# URL reputation ---------------------------------------------------------------

def test_hosts_and_rules(spark):
    urls = ["http://User@A.Example.ORG:80/es/x?q#f", "https://example.org?x", "no scheme", None, "x://", "a://b://c/d",
            "http://myexample.org/es/", "http://w.example.org/en/12"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1")]
    none = spark.createDataFrame([], "host string, bad int")
    got = {r.page_id: r for r in url_reputation.filter_urls(pages.selectExpr("*", "1 as rule"), none, rules).collect()}
    assert [got[i].host for i in range(8)] == ["user@a.example.org:80", "example.org", "", "", "", "b:", "myexample.org",
                                              "w.example.org"]
    assert [got[i].path for i in range(8)] == ["/es/x", "", "", "", "", "//c/d", "/es/", "/en/12"]
    assert [got[i].rule for i in range(8)] == [None, None, None, None, None, None, "org/", "example.org/en/1"]
    assert got[7].verdict == "block" and got[6].verdict == "allow"
    assert url_reputation.filter_urls(pages.limit(0), none, rules).count() == 0


def test_reputation_shrinks_and_blocks(spark):
    hosts = [("bad.x.com", 1, 40), ("bad.x.com", 0, 2), ("good.x.com", 0, 40), ("one.y.com", 1, 1),
             ("z.y.com", 0, 30), (None, 1, 5)]
    outcomes = spark.createDataFrame([(h, b) for h, b, n in hosts for _ in range(n)], "host string, bad int")
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(
        ["bad.x.com", "good.x.com", "one.y.com", "new.x.com", "new.net"])], "page_id int, url string")
    got = {r.host: r for r in url_reputation.filter_urls(pages, outcomes, max_bad=0.5).collect()}
    assert {h: r.verdict for h, r in got.items() if h != "new.x.com"} == {
        "bad.x.com": "block", "good.x.com": "allow", "one.y.com": "allow", "new.net": "allow"}
    assert got["one.y.com"].bad_mean < 1 and 0 < got["new.x.com"].bad_mean < 1


# queries and pipeline ---------------------------------------------------------

def test_pipeline_stages_take_effect(spark, sf):
    import corpus_pipeline as c

    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in c.STAGES[:-1]:
        docs = store(stage(spark, docs, sf), name)
        assert docs.columns == c.COLUMNS
        kept.append((docs.count(), docs.select("doc_id").distinct().count()))
    assert kept[0][0] < spark.read.parquet(f"{sf}/documents.parquet").count() and kept[1][0] < kept[0][0]
    assert kept[3][1] == kept[2][1]
    packed = c.STAGES[-1][1](spark, docs, sf)
    assert packed.groupBy("doc_id").count().count() == kept[3][1]
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in c.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_all_queries_are_registered(spark):
    import __spark_entry__ as e

    names = set(e.queries())
    assert {"pipeline"} | {n for n in names if n.startswith("op")} >= {"pipeline"}
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))
