"""Jaccard join and substring removal against brute force, with edge cases."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from trialframe.llm import jaccard, substring
from trialframe.llm.common import store
from trialframe.llm.fmindex import FMIndex
from trialframe.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_jaccard(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j:j + n]) for j in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(rng, n_base=6, copies=12):
    vocabulary = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for _ in range(n_base):
        base = rng.choices(vocabulary, k=rng.randint(20, 80))
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((k, " ".join(w)))
            k += 1
    return rows


@pytest.mark.parametrize("pivots,block", [(512, 256), (2, 4)])
def test_jaccard_is_brute_force(spark, docs_of, pivots, block):
    rng = random.Random(5)
    rows = near_copies(rng) + [(900, ""), (901, None), (902, "A b"), (903, "a B"), (904, "  \t\n")]
    rows += [(910, "common line of words here again"), (911, "common line of words here again")]
    docs = docs_of([(i, t, None, None) for i, t in rows])
    got = jaccard.near_duplicates(docs, n=4, percent=85, fragments=3, round_pivots=pivots,
                                  block_rows=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_jaccard(rows, 4, 85)


@pytest.mark.parametrize("paired,percent", [(1, 85), (3, 70), (16, 60)])
def test_jaccard_candidates_are_brute_force(spark, docs_of, monkeypatch, paired, percent):
    """Links are found whether their grams are rare, often or both."""
    rng = random.Random(paired)
    rows = near_copies(rng, 4, 6) + [(1000 + i, t) for i, t in near_copies(rng, 2, 30)]
    shared = " ".join(f"licence{i}" for i in range(60))
    rows += [(2000 + i, f"{shared} tail{i} of{i}") for i in range(20)]
    rows += [(3000 + i, " ".join([shared, *(f"own{i}x{j}" for j in range(3 * i))])) for i in range(20)]
    rng.shuffle(rows)
    monkeypatch.setattr(jaccard, "PAIRED", paired, raising=False)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(
        docs_of([(*r, "en", "s") for r in rows]), n=4, percent=percent, fragments=3, round_pivots=4, block_rows=8).collect()}
    assert got == brute_jaccard(rows, 4, percent)


def test_jaccard_compares_only_what_shares_enough(spark, docs_of, monkeypatch):
    """Texts that share one short passage each with many others are no cluster; their own grams are not sent."""
    compared, stored, kept = [], {}, jaccard.store
    monkeypatch.setattr(jaccard, "_compare", lambda *a: compared.append(a))

    def watched(df, name, *more):
        stored[name] = kept(df, name, *more)
        return stored[name]

    monkeypatch.setattr(jaccard, "store", watched)
    monkeypatch.setattr(jaccard, "release", lambda *tables: None)
    many, passages = 24, {}
    for a in range(many):  # a passage of thirty words for every two texts
        for b in range(a):
            passages[a, b] = passages[b, a] = " ".join(f"p{a}x{b}y{i}" for i in range(30))
    rows = [(a, " ".join([*(passages[a, b] for b in range(many) if b != a), f"only{a} this{a} has{a}"]))
            for a in range(many)]
    out = jaccard.near_duplicates(docs_of([(*r, "en", "s") for r in rows]), n=5, percent=80, fragments=2).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in out) == [(a, a) for a in range(many)]
    assert not compared
    grams = stored["grams"].groupBy("gram").count()
    assert grams.count() and not grams.where("count = 1").count()


def test_jaccard_rounds_grow(spark, docs_of, monkeypatch):
    """A cluster without links takes fewer rounds than pivots allow in the first."""
    many = []
    compare = jaccard._compare
    monkeypatch.setattr(jaccard, "_compare", lambda p, m, pivots, *a: (
        many.append(pivots.count()), compare(p, m, pivots, *a))[1])
    shared = " ".join(f"s{i}" for i in range(70))
    rows = [(a, f"{shared} " + " ".join(f"o{a}x{i}" for i in range(26))) for a in range(44)]
    out = jaccard.near_duplicates(
        docs_of([(*r, "en", "s") for r in rows]), n=1, percent=70, round_pivots=4, block_rows=8).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_jaccard(rows, 1, 70)
    assert many == [4, 8, 16, 16]


def test_jaccard_edges(spark, docs_of):
    assert jaccard.near_duplicates(docs_of([])).count() == 0
    same = "one two three four five six seven"
    got = jaccard.near_duplicates(docs_of([(3, same, "x", "y"), (3, same, "x", "y"), (None, same, "", ""),
                                           (1, "other words entirely in this one", "", "")])).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 3), (1, 1), (3, 3), (3, 3)]
    alone = jaccard.near_duplicates(docs_of([(None, same, "", ""), (None, None, "", "")])).collect()
    assert [r.component_id for r in alone] == [None, None]


def test_jaccard_counts_overlaps_in_bounded_memory():
    """A block of near copies has millions of matches; they are counted some at a time."""
    rng = np.random.default_rng(0)
    common = rng.integers(0, 1 << 60, 60)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 1 << 60, 20)])) for _ in range(768)]
    t = pa.table({"bin": [0] * 768, "block": [0] * 768, "fragment": [0] * 768, "cid": range(768),
                  "size": [len(s) for s in sets], "grams": jaccard._long_lists(sets),
                  "pivot": [i >= 256 for i in range(768)]})
    tracemalloc.start()
    out = jaccard._overlaps(t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(np.frombuffer(out.column("counts")[0].as_py(), np.uint32)) == {60}
    assert peak < 32e6, peak


def test_jaccard_workers_get_few_texts_at_a_time(spark):
    """Both steps that read texts get and send on parts; the session's setting stays as it was."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(b)]})

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = store(spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long"), "sizes", jaccard.ROWS).collect()
    assert sum(r.n for r in got) == 5000 and max(r.n for r in got) <= jaccard.ROWS
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    parts = list(jaccard._parts(iter([pa.RecordBatch.from_pydict({"a": list(range(2500))})])))
    assert [v for p in parts for v in p.column("a").to_pylist()] == list(range(2500))
    assert max(map(len, parts)) == jaccard.ROWS


def test_jaccard_ignores_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e", 5, "x"), (2, "a b c d e", 6, "y")],
                               "doc_id long, text string, component_id long, size string")
    assert {r.component_id for r in jaccard.near_duplicates(df).collect()} == {1}


def brute_repeats(rows, m=13):
    seen, out = {}, {}
    words = {i: WORD.findall(t or "") for i, t in rows}
    for i in sorted(words):
        for j in range(len(words[i]) - m + 1):
            seen.setdefault(tuple(words[i][j:j + m]), i)
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - m + 1):
            if seen[tuple(w[j:j + m])] < i:
                gone.update(range(j, j + m))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("often", [10_000, 3])
def test_repeats_are_brute_force(spark, docs_of, often):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(60)]
    passage = rng.choices(vocabulary, k=40)
    rows = []
    for i in range(40):
        w = rng.choices(vocabulary, k=rng.randint(0, 60))
        if i % 3 == 0:
            a = rng.randrange(20)
            w[10:10] = passage[a:a + rng.randint(10, 20)]
        if i % 7 == 0:
            w += ["same"] * 30
        rows.append((i, "  ".join(w)))
    rows += [(50, rows[3][1]), (51, rows[3][1]), (52, None), (53, ""), (54, "\u00a0a b")]
    got = substring.remove_repeats(docs_of([(i, t, "en", "s") for i, t in rows]), often=often,
                                   shard_stretches=20).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == brute_repeats(rows)


def test_repeats_edges(spark, docs_of):
    text = " ".join(map(str, range(30)))
    assert substring.remove_repeats(docs_of([])).count() == 0
    got = substring.remove_repeats(docs_of([(4, text, "", ""), (4, text, "", ""), (None, text, "", ""),
                                            (2, "short", "", "")])).collect()
    assert {r.n_removed for r in got} == {0} and len(got) == 4
    df = spark.createDataFrame([(1, text, 7, "c"), (2, text, 8, "d")],
                               "doc_id long, text string, n_words int, covered string")
    got = {r.doc_id: r for r in substring.remove_repeats(df).collect()}
    assert got[2].n_removed == 30 and got[2].kept_text == "" and got[1].n_words == 30
    long_text = " ".join(f"x{i % 977}" for i in range(200_000))
    big = substring.remove_repeats(docs_of([(1, long_text, "", ""), (2, "q " + long_text, "", "")])).collect()
    assert {r.doc_id: r.n_removed for r in big} == {1: 0, 2: 200_000}


def test_backward_search_counts():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 4, 400), 0)
    index = FMIndex(text, 4)
    patterns = np.array([text[i:i + 6] for i in range(300)])
    lo, hi, length = index.intervals(patterns)
    for p, a, b, n in zip(patterns, lo, hi, length):
        tail = p[6 - n:]
        count = sum(bool((text[i:i + n] == tail).all()) for i in range(len(text) - n)) if n else 0
        assert n == 0 or count > 1
        if n == 6:
            assert b - a == count
            assert all((text[s:s + 6] == p).all() for s in index.suffix[a:b])


def test_digest_of_kept_words(spark, docs_of, tmp_path):
    from trialframe.llm.q02 import op2_substring_dedup

    docs_of([(1, " a  b ", "", "")]).write.parquet(str(tmp_path / "documents.parquet"))
    row = op2_substring_dedup(spark, str(tmp_path)).first()
    assert row.kept_sha256 == hashlib.sha256(b"a b").hexdigest()


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(400)] + [(900, 900), (901, 900), (900, 901), (None, 3)],
    [(7, i) for i in range(8, 300)] + [(5, 299), (1000, 1001)],
    [((i * 7919) % 500, (i * 104729 + 3) % 500) for i in range(300)],
    [],
])
def test_components_are_brute_force(spark, edges):
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in edges:
        if a is not None and b is not None and a != b:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = components(df).collect()
    assert sorted((r.node, r.root) for r in got) == sorted((v, find(v)) for v in list(root))
