"""Near-duplicate vectors and learned partitions against brute force, with edge cases."""

import numpy as np

from trialframe.llm import hnsw, partitions

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)


def planted(n=700, d=16, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    for i in range(0, 300, 3):
        x[i + 1] = x[i] + rng.normal(scale=0.1, size=d)
    x[400:520] = x[400] + rng.normal(scale=0.15, size=(120, d))
    x[600:610] = x[600]
    return x


def test_near_duplicates_are_brute_force(spark):
    x = planted()
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0] * 15 + [None]),
           (905, [float("inf")] * 16), (906, [1.0, 2.0]), (907, [1.0, 2.0])]
    got = {r.vec_id: r for r in hnsw.near_duplicates(frame(spark, rows + odd), min_shards=3).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min(root[i], root[link[i]].min(initial=len(x))) for i in range(len(x))])
        if (new == root).all():
            break
        root = new
    assert [got[i].n_links for i in range(len(x))] == link.sum(1).tolist()
    assert [got[i].component_id for i in range(len(x))] == root.tolist()
    assert all(got[i].kept == (root[i] == i) for i in range(len(x)))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(900, 906))
    assert [(got[i].n_links, got[i].component_id) for i in (906, 907)] == [(1, 906), (1, 906)]


def test_graph_of_three_layers_finds_neighbours():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4400, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph(x)
    assert [len(k) for k in graph.links] == [4400, 275, 18]
    ids, sims = graph.near(x[:200], 32)
    want = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, want)]) > 0.95
    assert (ids[:, 0] == np.arange(200)).all()


def test_links_of_a_graph_that_lost_nodes():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(1500, 16))
    x[1::50] = x[::50] + rng.normal(scale=0.05, size=(30, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, uid = hnsw.Graph(x.astype(np.float32)), np.arange(1500)
    for links in graph.links:
        links[(links >= 0) & (links % 50 == 1)] = -1
    ids, _ = graph.near(x[::50].astype(np.float32), 32)
    assert not (ids == np.arange(1, 1500, 50)[:, None]).any()  # beams alone miss these links
    a, b = hnsw._matches(graph, x, uid, x, uid, 0.9, 32, 8, 0.99)
    want = np.argwhere((x @ x.T >= 0.9) & ~np.eye(1500, dtype=bool))
    assert sorted(zip(a.tolist(), b.tolist())) == [tuple(w) for w in want.tolist()]


def test_near_duplicates_edges(spark):
    assert hnsw.near_duplicates(frame(spark, [])).count() == 0
    got = hnsw.near_duplicates(frame(spark, [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [1.0, 0.0])])).collect()
    assert sorted((r.n_links, r.component_id) for r in got) == [(2, 5)] * 3


def test_search_recall_and_scores(spark):
    x = planted(1500, 16, 4).astype(float)
    rows = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    hits = 0
    # One level of 8 parts, then two levels of at most 6 x 6 in bundles, blocks and halves.
    for leaf_rows, fan, more in ((200, 128, {}), (40, 6, {"block_rows": 150, "query_rows": 30})):
        got = partitions.search(rows, rows.where("vec_id % 20 = 0"), k=10, leaf_rows=leaf_rows, fan=fan,
                                **more).collect()
        assert recall(x.astype(np.float32).astype(float), got) >= 0.9


def recall(x, got, k=10):
    """Share of the true nearest found; ranks, scores and order are checked on the way."""
    hits = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, k + 1))
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hits += len(set(np.argsort(-s)[:k]) & {r.vec_id for r in own})
    return hits / (len(range(0, len(x), 20)) * k)


def test_tree_of_two_levels_has_small_leaves(spark):
    x = planted(3000, 8, 9).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    tree = partitions.fit_tree(rows, 8, 3000, leaf_rows=60, fan=8, sample=1000)
    assert tree.parts == 8 and len(tree.subs) >= 6
    leaf = tree.leaf(x)
    names = tree.leaves()
    assert len(set(names.tolist())) == len(names) >= 30 and set(leaf.tolist()) <= set(names.tolist())
    assert np.bincount(leaf).max() <= 600
    ranked = tree.ranked(x[:50])
    assert all(sorted(r) == list(range(len(names))) for r in ranked.tolist())


def test_search_compares_every_length_and_fills_short_answers(spark):
    rng = np.random.default_rng(3)
    sets = {8: (0, rng.normal(size=(300, 8))), 5: (1000, rng.normal(size=(100, 5))), 3: (2000, rng.normal(size=(7, 3))),
            2: (3000, rng.normal(size=(40, 2)))}
    x = {start + i: v.astype(np.float32).astype(float) for start, m in sets.values() for i, v in enumerate(m)}
    # Leaves smaller than k, two lengths with routers, two without; one id comes forty times.
    many = [(0, (np.ones(8) * j).tolist()) for j in range(2, 42)]
    rows = frame(spark, [(i, v.tolist()) for i, v in x.items()] + many)
    asked = frame(spark, [(i, v.tolist()) for i, v in x.items() if i % 20 == 0])
    got = partitions.search(rows, asked, k=20, leaf_rows=16, sample=200, lengths=2).collect()
    for q in (i for i in x if i % 20 == 0):
        others = [i for i in x if i != q and len(x[i]) == len(x[q])]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, min(20, len(others)) + 1))
        if len(x[q]) in (2, 3):
            want = sorted(others, key=lambda i: (-(x[i] * x[q]).sum(), i))[:20]
            assert [r.vec_id for r in own] == want
        assert len(x[q]) != 8 or q == 0 or all(len(x[r.vec_id]) == 8 for r in own)


def test_search_edges(spark):
    empty = frame(spark, [])
    assert partitions.search(empty, empty).count() == 0
    few = frame(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]),
                        (5, [float("nan"), 1.0]), (None, [1.0, 1.0])])
    got = partitions.search(few, few.where("vec_id = 0"), k=20).collect()
    assert sorted((r.rank, r.vec_id) for r in got) == [(1, 1), (2, 2)]
    assert partitions.search(few, empty).count() == 0
