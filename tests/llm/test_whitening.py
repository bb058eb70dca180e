"""Whitening against plain numpy over the distinct vectors."""

import math

import numpy as np
import pytest

from trialframe.llm import whitening


def brute(rows, components=4, scale=256, weights="one"):
    """(id, component) -> values, by the definition."""
    xs = [(i, tuple(math.floor(scale * float(c)) for c in v)) for i, v in rows
          if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for p in {len(x) for _, x in xs}:
        own = [(i, x) for i, x in xs if len(x) == p]
        each = sorted({x for _, x in own})
        copies = [sum(x == y for _, y in own) if weights == "copies" else 1 for x in each]
        listed = [x for x, c in zip(each, copies) for _ in range(c)]
        n, total = len(listed), [sum(c) for c in zip(*listed)]
        z = np.array(listed, float).reshape(n, p) - np.array(total) / n
        v = z.T @ z / n
        e, u = np.linalg.eigh(v)
        e, u = e[::-1], u[:, ::-1]
        for i, x in own:
            dev = sum((n * a - s) ** 2 for a, s in zip(x, total))
            for k in range(min(components, p)):
                w = (np.array(x) - np.array(total) / n) @ u[:, k] / math.sqrt(e[k]) if e[k] > 1e-9 else None
                out.append((i, k + 1, n, dev, w, e[k] / np.trace(v) if np.trace(v) else None))
    return out


def same(got, want):
    assert len(got) == len(want)
    got = sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r.component, r.n))
    want = sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    sign = {}
    for g, w in zip(got, want):
        assert (g[0], g.component, g.n, g.deviation) == w[:4]
        assert (g.whitened is None) == (w[4] is None) and (g.explained is None) == (w[5] is None)
        if w[5] is not None:
            assert g.explained == pytest.approx(w[5], rel=1e-9, abs=1e-12)
        if w[4] is not None and abs(w[4]) > 1e-6:
            assert sign.setdefault((g.n, g.component), np.sign(g.whitened * w[4])) == np.sign(g.whitened * w[4])
            assert abs(g.whitened) == pytest.approx(abs(w[4]), rel=1e-7)
        assert g.identity_error is None or g.identity_error < 1e-9


@pytest.mark.parametrize("weights", ["one", "copies"])
def test_whole_table_with_copies(spark, sf, weights):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id as id", "embedding as v")
    rows = [(r.id, r.v) for r in e.collect()][:300]
    rows += [(10_000 + i, rows[0][1]) for i in range(400)] + [(20_000 + i, rows[1][1]) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, v array<float>").selectExpr("*", "1 as x", "2 as n", "3 as p", "4 as z")
    found = whitening.whiten(df, "id", "v", weights=weights).collect()
    same(found, brute(rows, weights=weights))
    assert len({r.identity_error for r in found}) == 1


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(20)]
    rows += [(100, None), (101, [1.0, None, 2.0]), (102, [nan, 0.0, 0.0]), (103, [0.0, -inf, 0.0]), (104, []),
             (None, rows[0][1]), (5, rows[0][1]), (5, rows[0][1]), (105, [-0.0, 0.0, 0.0])]
    rows += [(200 + i, [0.5, float(i)]) for i in range(4)]      # one dimension without variance
    rows += [(300, [1.0]), (301, [1.0])]                        # one distinct vector
    df = spark.createDataFrame(rows, "id long, v array<double>")
    found = whitening.whiten(df, "id", "v").collect()
    want = brute(rows)
    same(found, want)
    assert {r.id for r in found} == {w[0] for w in want} and 104 not in {r.id for r in found}
    assert [r.whitened for r in found if r.id == 300] == [None]
    assert {r.identity_error is None for r in found if r.id in (300, 301)} == {True}
    assert whitening.whiten(df.limit(0), "id", "v").count() == 0
    with pytest.raises(ValueError, match="weights"):
        whitening.whiten(df, "id", "v", weights="all")


def test_whole_numbers_of_any_size(spark):
    rows = [(i, [float(i) * 2.0**40, float(i * i), 1e300 if i == 3 else -1e300]) for i in range(6)]
    found = whitening.whiten(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v").collect()
    assert {r.deviation for r in found} == {None} and len(found) == 18
    small = [(i, [float(i) * 2.0**14, float(i)]) for i in range(6)]
    found = whitening.whiten(spark.createDataFrame(small, "id long, v array<double>"), "id", "v").collect()
    same(found, brute(small))
