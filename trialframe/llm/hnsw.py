"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Equal vectors are one unit.  Units are dealt to shards, each shard builds a graph, and every
block of units queries every shard.  A beam is widened while all it holds are links, and a
whole block's beams until a recall audit against all of the shard passes for every class of
group sizes; what no beam finds is scored by matrix products.  Links are verified
by cosine in double precision; what leaves a task is a count per unit and a spanning forest.
"""

from __future__ import annotations

import io
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.llm.common import mix, store
from trialframe.llm.graph import components

MANY, FEW = 32, 16  # neighbours kept on the lowest layer and above
SEED = 256
AT_ONCE = 4  # beam members expanded per step


def usable(v: Column) -> Column:
    """Not null, not empty, not zero, and no component null or not finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _select(x: np.ndarray, of: np.ndarray, cand: np.ndarray, sim: np.ndarray, m: int) -> np.ndarray:
    """Diverse neighbours: a candidate is passed over if it is nearer to one already chosen.

    Rows of ``cand`` are sorted by falling similarity, -1 for none.  Places left are filled with
    the nearest of those passed over.
    """
    b, c = cand.shape
    vectors = x[np.maximum(cand, 0)]
    between = np.einsum("bid,bjd->bij", vectors, vectors)
    chosen, closest = np.zeros((b, c), bool), np.full((b, c), -2.0, np.float32)
    count = np.zeros(b, int)
    valid = cand >= 0
    for i in range(c):
        take = valid[:, i] & (count < m) & (sim[:, i] > closest[:, i])
        chosen[:, i] = take
        count += take
        rows = np.flatnonzero(take)
        if len(rows):
            closest[rows] = np.maximum(closest[rows], between[rows, i])
    rank = np.where(chosen, 0, np.where(valid, 1, 2)) * c + np.arange(c)
    order = np.argsort(rank, axis=1, kind="stable")[:, :m]
    out = np.take_along_axis(np.where(valid, cand, -1), order, 1)
    if out.shape[1] < m:
        out = np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)
    return out.astype(np.int32)


class Graph:
    """Layers over vectors ordered by level: layer k holds the first ``len(links[k])`` of them."""

    def __init__(self, x: np.ndarray, ef: int = 48):
        self.x, self.links = x, []
        n = len(x)
        sizes = [n]
        while sizes[-1] > SEED:
            sizes.append(-(-sizes[-1] // 16))
        for size in reversed(sizes):  # the top layer first; each enters through those above
            self.links.insert(0, self._layer(size, MANY if size == n else FEW, ef))

    def _layer(self, size: int, m: int, ef: int) -> np.ndarray:
        links = np.full((size, m), -1, np.int32)
        done = min(SEED, size)
        sim = self.x[:done] @ self.x[:done].T
        np.fill_diagonal(sim, -2)
        k = min(done - 1, 2 * m)
        if k > 0:
            cand = np.argsort(-sim, axis=1, kind="stable")[:, :k]
            links[:done] = _select(self.x, np.arange(done), cand, np.take_along_axis(sim, cand, 1), m)
            self._back(links, np.arange(done))
        while done < size:
            new = np.arange(done, min(size, 2 * done, done + SEED))
            q = self.x[new]
            cand, sim = self._beam(links, done, q, self._enter(q, done), ef)
            own = q @ q.T
            np.fill_diagonal(own, -2)
            near = np.argsort(-own, axis=1, kind="stable")[:, :min(len(new) - 1, m)]
            cand = np.concatenate([cand, new[near]], 1)
            sim = np.concatenate([sim, np.take_along_axis(own, near, 1)], 1)
            order = np.argsort(-sim, axis=1, kind="stable")[:, :2 * m]
            cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
            links[new] = _select(self.x, new, cand, sim, m)
            self._back(links, new)
            done = new[-1] + 1
        return links

    def _back(self, links: np.ndarray, new: np.ndarray) -> None:
        """Add the reverse of the new links, and choose again where a node has too many."""
        m = links.shape[1]
        src = np.repeat(new, m)
        dst = links[new].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        score = np.einsum("ij,ij->i", self.x[src], self.x[dst])
        order = np.lexsort((-score, dst))
        src, dst = src[order], dst[order]
        nodes, first, counts = np.unique(dst, return_index=True, return_counts=True)
        place = np.arange(len(dst)) - np.repeat(first, counts)
        fits = place < m
        added = np.full((len(nodes), m), -1, np.int64)
        added[np.repeat(np.arange(len(nodes)), counts)[fits], place[fits]] = src[fits]
        both = np.concatenate([links[nodes], added], 1).astype(np.int64)
        ordered = np.sort(both, 1)
        twice = np.zeros(both.shape, bool)
        twice[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
        cand = np.where(twice, -1, ordered)
        for i in range(0, len(nodes), SEED):
            at, c = nodes[i:i + SEED], cand[i:i + SEED]
            s = np.einsum("bd,bkd->bk", self.x[at], self.x[np.maximum(c, 0)])
            s = np.where(c >= 0, s, -2).astype(np.float32)
            order = np.argsort(-s, axis=1, kind="stable")
            links[at] = _select(self.x, at, np.take_along_axis(c, order, 1),
                                np.take_along_axis(s, order, 1), m)

    def _enter(self, q: np.ndarray, inserted: int) -> np.ndarray:
        """The nearest node found on the layers above, among those inserted so far."""
        at = np.zeros(len(q), np.int64)
        for links in reversed(self.links):
            found, _ = self._beam(links, min(len(links), inserted), q, at, 8)
            at = found[:, 0]
        return at

    def _beam(self, links: np.ndarray, size: int, q: np.ndarray, at: np.ndarray,
              ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``ef`` nearest nodes found from the entry points, nearest first; -1 for none."""
        b = len(q)
        ids = np.full((b, ef), -1, np.int64)
        sims = np.full((b, ef), -2.0, np.float32)
        open_ = np.zeros((b, ef), bool)
        ids[:, 0], open_[:, 0] = at, True
        sims[:, 0] = np.einsum("bd,bd->b", q, self.x[at])
        seen = np.zeros((b, size + 1), bool)  # the last column stands for "no neighbour"
        seen[np.arange(b), at] = True
        seen[:, size] = True
        active = np.arange(b)
        while len(active):
            o = open_[active]
            # The nearest open members: places are sorted, so the first open ones.
            rank = np.where(o, np.arange(ef), ef)
            pick = np.sort(np.partition(rank, min(AT_ONCE, ef) - 1, 1)[:, :AT_ONCE], 1)
            has = pick < ef
            pick = np.minimum(pick, ef - 1)
            rows = active[:, None]
            nodes = np.where(has, ids[rows, pick], -1)
            open_[np.repeat(active, has.sum(1)), pick[has]] = False
            near = np.where(nodes[:, :, None] >= 0, links[np.maximum(nodes, 0)], -1).reshape(len(active), -1)
            near = np.where((near < 0) | (near >= size), size, near)
            near.sort(1)
            fresh = ~seen[rows, near]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            seen[rows, near] = True
            s = np.full(near.shape, -2.0, np.float32)
            i, j = np.nonzero(fresh)
            s[i, j] = np.einsum("kd,kd->k", q[active[i]], self.x[near[i, j]])
            allids = np.concatenate([ids[active], np.where(fresh, near, -1)], 1)
            allsim = np.concatenate([sims[active], s], 1)
            allopen = np.concatenate([open_[active], fresh], 1)
            order = np.argsort(-allsim, axis=1, kind="stable")[:, :ef]
            ids[active] = np.take_along_axis(allids, order, 1)
            sims[active] = np.take_along_axis(allsim, order, 1)
            open_[active] = np.take_along_axis(allopen, order, 1)
            active = active[open_[active].any(1)]
        return ids, sims

    def near(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        return self._beam(self.links[0], len(self.x), q, self._enter(q, len(self.x)), ef)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _exact(near: np.ndarray, exact: np.ndarray, q: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """All (query, node) with cosine of at least ``t``: matrix products in blocks, verified."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i in range(0, len(q), SEED):
        part = q[i:i + SEED].astype(np.float32)
        for j in range(0, len(exact), 16_384):
            a, node = np.nonzero(part @ near[j:j + 16_384].T >= t - 1e-4)
            a, node = a + i, node + j
            sure = np.concatenate([np.zeros(0, bool)] + [
                np.einsum("ij,ij->i", q[a[k:k + 65_536]], exact[node[k:k + 65_536]]) >= t
                for k in range(0, len(a), 65_536)])
            out.append((a[sure], node[sure]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _links(graph: Graph, exact: np.ndarray, q: np.ndarray, t: float, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) with cosine of at least ``t``, widening beams that are full of links.

    A beam with empty places has run out of reachable nodes; it and one that would have to hold
    an eighth of the shard are replaced by exact scores.
    """
    n = len(exact)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    step = max(16, min(SEED, (1 << 24) // max(1, n)))
    todo, width, rest = np.arange(len(q)), ef, []
    while len(todo) and 8 * width < n:
        again = []
        for i in range(0, len(todo), step):
            part = todo[i:i + step]
            ids, sims = graph.near(q[part].astype(np.float32), width)
            short = (ids < 0).any(1)
            hit = (sims >= t - 1e-4) & (ids >= 0)
            full = hit.all(1)
            rest.append(part[short])
            again.append(part[full & ~short])
            a, k = np.nonzero(hit & ~(full | short)[:, None])
            node = ids[a, k]
            sure = np.einsum("ij,ij->i", q[part[a]], exact[node]) >= t
            out.append((part[a][sure], node[sure]))
        todo, width = np.concatenate(again), 2 * width
    rest = np.concatenate([*rest, todo])
    a, b = _exact(graph.x, exact, q[rest], t)
    out.append((rest[a], b))
    return tuple(np.concatenate(x) for x in zip(*out))


def _matches(graph: Graph, exact: np.ndarray, uid: np.ndarray, q: np.ndarray, own: np.ndarray, t: float,
             ef: int, audits: int, recall: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) linked in a shard, without a query's own node, by an audited graph.

    Queries are scored exactly, in the order of a hash, until ``audits`` with 1 to 3 links and as
    many of every other class seen (by powers of two of the links) are known; if there are not so
    many, that is all of them.  The others are searched with beams that find ``recall`` of the
    links of the audited queries, each query counting alike, in every class; if none short of an
    eighth of the shard does, they are scored exactly too.
    """
    def others(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = uid[b] != own[at[a]]
        return at[a[keep]], b[keep]

    order = np.argsort(mix(own.view(np.uint64) ^ np.uint64(uid[0])), kind="stable")
    out, done, links = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0, np.zeros(len(q), np.int64)
    while done < len(order):
        at = order[done:done + SEED]
        out.append(others(*_exact(graph.x, exact, q[at], t)))
        links += np.bincount(out[-1][0], minlength=len(q))
        done += len(at)
        size = np.maximum(1, np.log2(np.maximum(1, links)).astype(int))
        seen = np.bincount(size[links > 0], minlength=2)
        if seen[1] >= audits and (seen[seen > 0] >= audits).all():
            break
    if done < len(order):
        audited = np.concatenate([np.flatnonzero((links > 0) & (size == c))[:audits] for c in np.flatnonzero(seen)])
        width = ef
        while 8 * width < len(exact):
            at = audited
            found = np.bincount(others(*_links(graph, exact, q[at], t, width))[0], minlength=len(q))
            share = found[audited] / links[audited]
            if all(share[size[audited] == c].mean() >= recall for c in np.flatnonzero(seen)):
                break
            width *= 2
        at = order[done:]
        out.append(others(*_links(graph, exact, q[at], t, width)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the edges."""
    parent: dict[int, int] = {}

    def find(v: int) -> int:
        while (p := parent.setdefault(v, v)) != v:
            parent[v] = parent.setdefault(p, p)
            v = parent[v]
        return v

    out = []
    for u, v in zip(a.tolist(), b.tolist()):
        ru, rv = find(u), find(v)
        if ru != rv:
            parent[max(ru, rv)] = min(ru, rv)
            out.append((u, v))
    return out


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def build_index(units: DataFrame, shards: int, ef: int = 48) -> DataFrame:
    """(dim, shard, index): a pickled graph with unit ids and copies, one row per shard."""
    def build(t: pa.Table) -> pa.Table:
        dim, shard = t.column("dim")[0].as_py(), t.column("shard")[0].as_py()
        t = t.sort_by("uid")
        uid = t.column("uid").to_numpy()
        order = np.argsort(mix(uid.view(np.uint64)), kind="stable")
        x = _unit(_matrix(t.column("v"), dim))[order]
        graph = Graph(x.astype(np.float32), ef)
        out = io.BytesIO()
        pickle.dump((uid[order], t.column("copies").to_numpy()[order], x, graph.links), out)
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()),
                         "index": pa.array([out.getvalue()], pa.binary())})

    dealt = units.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int"))
    return dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, index binary")


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, ef: int = 32, min_shards: int = 6,
    shard_rows: int = 500_000, block_rows: int = 100_000, audits: int = 64, recall: float = 0.99,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding).

    ``n_links`` counts other rows with cosine of at least ``threshold``; ``component_id`` is the
    smallest vec_id reachable over links; ``kept`` says that it is the row's own.  Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing, as do
    vectors of different lengths with each other.  Repeated rows count as rows; rows without an
    id have the component of those they link with, null if these have no id either, and are
    kept only then.  Other columns are not used.

    A shard has about ``shard_rows`` units, or one of ``min_shards`` parts of all if fewer; a task holds
    one shard and at most about ``block_rows`` queries.  Per task, ``audits`` queries of each class
    of group sizes are compared with the whole shard, and beams doubled until ``recall`` of their
    links to others is found; where there are too few such queries or no beam is wide enough, the
    task is scored exactly.
    """
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    good = v.where(usable(F.col("v")))
    units = store(
        good.groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
        .select(F.monotonically_increasing_id().alias("uid"), F.size("v").alias("dim"), "*"),
        "units",
    )
    n = units.count()
    shards = max(min_shards, -(-n // shard_rows))
    blocks = max(1, -(-n // block_rows))
    index = store(build_index(units, shards, ef), "index")

    def query(indexed: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table({"uid": pa.array([], pa.int64()), "links": pa.array([], pa.int64()),
                          "other": pa.array([], pa.int64())})
        if not len(indexed) or not len(asked):
            return empty
        asked = asked.sort_by("uid")
        uid, copies, x, links = pickle.loads(indexed.column("index")[0].as_py())
        graph = Graph.__new__(Graph)
        graph.x, graph.links = x.astype(np.float32), links
        own = asked.column("uid").to_numpy()
        q = _unit(_matrix(asked.column("v"), x.shape[1]))
        a, b = _matches(graph, x, uid, q, own, threshold, ef, audits, recall)
        count = np.bincount(a, copies[b], minlength=len(own)).astype(np.int64)
        forest = _forest(own[a], uid[b])
        has = np.flatnonzero(count)
        return pa.table({
            "uid": pa.array(np.concatenate([own[has], np.array([e[0] for e in forest], np.int64)])),
            "links": pa.array(np.concatenate([count[has], np.zeros(len(forest), np.int64)])),
            "other": pa.array([None] * len(has) + [e[1] for e in forest], pa.int64())})

    block = F.pmod(F.xxhash64(F.col("uid") + 1), F.lit(blocks)).cast("int").alias("block")
    each = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    asked = units.select("dim", "uid", "v", block, each.alias("shard"))
    held = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    keys = ["dim", "shard", "block"]
    found = store(held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(
        query, "uid long, links long, other long"), "links")
    counts = found.groupBy("uid").agg(F.sum("links").alias("links"))
    edges = found.where("other is not null").select(F.col("uid").alias("a"), F.col("other").alias("b"))
    parts = components(edges)
    placed = units.join(counts, "uid", "left").join(
        parts.select(F.col("node").alias("uid"), "root"), "uid", "left").select(
        "v", "copies", "first", F.coalesce("root", "uid").alias("root"),
        F.coalesce("links", F.lit(0)).alias("links"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component"))
    known = placed.join(smallest, "root").select(
        F.col("v").alias("u"), (F.col("links") + F.col("copies") - 1).alias("links"), "component")
    out = v.join(known, F.col("v") == F.col("u"), "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("u").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
