"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts; a small neural classifier
learns the part of a vector, deals every row of the index to its most probable part, and routes
a query to several parts, all of whose rows are scored exactly.  Large tables get a second level:
every part is cut again by a graph and a classifier of its own, so that leaves stay small.  How
many leaves are searched follows from an audit: bounded sample queries against all rows, by
brute force in blocks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialframe.llm.common import mix, release, store
from trialframe.llm.hnsw import _matrix, usable


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest others of each row by inner product."""
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 1024):
        s = x[i:i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i:i + 1024] = np.argpartition(-s, k - 1, 1)[:, :k]
    return out


def cut_balanced(x: np.ndarray, near: np.ndarray, parts: int, sweeps: int = 12,
                 slack: float = 0.1) -> np.ndarray:
    """Parts of a neighbour graph, none beyond its share by more than ``slack``.

    Starts from balanced centres and moves vertices to the part that most of their neighbours
    are in, those with the largest gain first, while there is room.
    """
    n = len(x)
    room = int(np.ceil(n / parts * (1 + slack)))
    centres = x[np.linspace(0, n - 1, parts).astype(int)]
    for _ in range(8):
        d = -2 * x @ centres.T + (centres ** 2).sum(1)
        part, size = np.full(n, -1), np.zeros(parts, int)
        best = np.sort(d, 1)
        for v in np.argsort(best[:, 0] - best[:, min(1, parts - 1)], kind="stable"):
            for p in np.argsort(d[v], kind="stable"):
                if size[p] < room:
                    part[v], size[p] = p, size[p] + 1
                    break
        centres = np.array([x[part == p].mean(0) if size[p] else centres[p] for p in range(parts)])
    src = np.repeat(np.arange(n), near.shape[1])
    a, b = np.concatenate([src, near.ravel()]), np.concatenate([near.ravel(), src])
    for _ in range(sweeps):
        votes = np.bincount(a * parts + part[b], minlength=n * parts).reshape(n, parts)
        want = votes.argmax(1)
        gain = votes[np.arange(n), want] - votes[np.arange(n), part]
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if size[want[v]] < room:
                size[part[v]] -= 1
                size[want[v]] += 1
                part[v] = want[v]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """One hidden layer; ``logits`` scores the parts of each row."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(0, ((x - self.mean) / self.scale) @ self.w1 + self.b1)
        return h @ self.w2 + self.b2

def train_router(x: np.ndarray, near: np.ndarray, part: np.ndarray, parts: int, hidden: int = 128,
                 epochs: int = 40, rate: float = 2e-3, seed: int = 7) -> Router:
    """Learn the share of a vector's neighbours in each part, by Adam on the cross-entropy."""
    rng = np.random.default_rng(seed)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1.0)
    target[np.arange(len(x)), part] += near.shape[1] / 2
    target /= target.sum(1, keepdims=True)
    r = Router(x.mean(0), x.std(0) + 1e-9, rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)),
               np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts))
    names = ("w1", "b1", "w2", "b2")
    m = {k: np.zeros_like(getattr(r, k)) for k in names}
    v = {k: np.zeros_like(getattr(r, k)) for k in names}
    z, step = (x - r.mean) / r.scale, 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 256):
            rows = order[i:i + 256]
            pre = z[rows] @ r.w1 + r.b1
            h = np.maximum(0, pre)
            o = h @ r.w2 + r.b2
            p = np.exp(o - o.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - target[rows]) / len(rows)
            dh = (d @ r.w2.T) * (pre > 0)
            grads = {"w2": h.T @ d + 1e-4 * r.w2, "b2": d.sum(0), "w1": z[rows].T @ dh + 1e-4 * r.w1,
                     "b1": dh.sum(0)}
            step += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                setattr(r, k, getattr(r, k) - rate * (m[k] / (1 - 0.9 ** step))
                        / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8))
    return r


@dataclass
class Tree:
    """Two levels of routers; ``leaf`` numbers are part * fan + subpart, unsplit parts have subpart 0."""

    top: Router
    subs: dict[int, Router]
    parts: int
    fan: int

    def leaves(self) -> np.ndarray:
        return np.concatenate([p * self.fan + np.arange(len(self.subs[p].b2) if p in self.subs else 1)
                               for p in range(self.parts)])

    def part(self, x: np.ndarray) -> np.ndarray:
        return self.top.logits(x).argmax(1) if len(x) else np.zeros(0, np.int64)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        part = self.part(x)
        out = part * self.fan
        for p in np.unique(part):
            if int(p) in self.subs:
                at = part == p
                out[at] += self.subs[int(p)].logits(x[at]).argmax(1)
        return out

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Positions in ``leaves`` per row, by falling joint probability of part and subpart."""
        top = _log_softmax(self.top.logits(x))
        joint = np.concatenate([top[:, p:p + 1] + (_log_softmax(self.subs[p].logits(x)) if p in self.subs else 0.0)
                                for p in range(self.parts)], axis=1)
        return np.argsort(-joint, axis=1, kind="stable")


def _log_softmax(o: np.ndarray) -> np.ndarray:
    o = o - o.max(1, keepdims=True)
    return o - np.log(np.exp(o).sum(1, keepdims=True))


def fit_router(x: np.ndarray, parts: int) -> Router:
    """Neighbour graph, balanced cut and router of sampled rows; fewer parts where rows are few."""
    parts = max(1, min(parts, len(x) // 32))
    near = neighbour_graph(x, min(10, len(x) - 1)) if len(x) > 1 else np.zeros((1, 1), np.int64)
    r = train_router(x, near, cut_balanced(x, near, parts) if parts > 1 else np.zeros(len(x), int), parts)
    for name in ("mean", "scale", "w1", "b1", "w2", "b2"):
        setattr(r, name, getattr(r, name).astype(np.float32))
    return r


def fit_tree(rows: DataFrame, dim: int, n: int, leaf_rows: int, fan: int, sample: int) -> Tree:
    """Routers for ``n`` rows (vec_id, v) of one length, with about ``n / leaf_rows`` leaves.

    Up to ``fan`` leaves one level is fitted on at most ``sample`` rows; beyond it every part gets a
    router of its own, fitted in a task of its own on about ``sample`` of the part's rows.
    """
    want = -(-n // leaf_rows)
    first = [F.xxhash64("vec_id"), F.col("vec_id"), F.col("v")]
    x = _matrix(rows.select("vec_id", "v").orderBy(*first).limit(sample).toArrow().column("v"), dim)
    top = fit_router(x, min(want, fan))
    tree = Tree(top, {}, len(top.b2), fan)
    if want <= fan:
        return tree
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.part(_matrix(batch.column("v"), dim))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(p, pa.int32())],
                                             names=["vec_id", "v", "part"])

    dealt = "vec_id long, v array<double>, part int"
    counts = {r["part"]: r["count"] for r in rows.select("vec_id", "v").mapInArrow(parts, dealt)
              .groupBy("part").count().collect()}  # at most ``fan`` rows
    split = {p: c for p, c in counts.items() if c > leaf_rows}
    if not split:
        return tree
    # A row's place in [0, 1) by a hash of id and vector; each part takes the share it needs.
    place = (F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    rate = {p: min(1.0, sample / c) for p, c in split.items()}
    wanted = F.create_map(*[F.lit(z) for p, s in rate.items() for z in (p, s)])
    drawn = rows.select("vec_id", "v").where(place < max(rate.values())).mapInArrow(parts, dealt) \
        .where(place < wanted[F.col("part")]).distinct()

    def fit(key: tuple, t: pa.Table) -> pa.Table:
        p = key[0].as_py()
        order = np.argsort(mix(t.column("vec_id").to_numpy().view(np.uint64)), kind="stable")[:sample]
        r = fit_router(_matrix(t.column("v"), dim)[order], min(fan, -(-split[p] // leaf_rows)))
        return pa.table({"part": pa.array([p], pa.int32()), "router": pa.array([pickle.dumps(r)], pa.binary())})

    for r in drawn.groupBy("part").applyInArrow(fit, "part int, router binary").collect():
        tree.subs[r["part"]] = pickle.loads(r["router"])  # at most ``fan`` small networks
    return tree


def best_of(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int):
    """Per query the positions and scores of the ``k`` rows of the largest inner product.

    Rows with the query's own id are left out.  Candidates come from a matrix product; their
    scores are summed again row by row, so that equal vectors have equal scores and ties go to
    the smaller id.
    """
    s = q @ x.T
    for i in range(len(q)):
        row = s[i]
        m = k + int((xid == qid[i]).sum())
        if len(row) > m:
            edge = np.partition(row, len(row) - m)[len(row) - m]
            cand = np.flatnonzero(row >= edge - 1e-9 * (1 + abs(edge)))
        else:
            cand = np.arange(len(row))
        cand = cand[xid[cand] != qid[i]]
        score = (x[cand] * q[i]).sum(1)
        order = np.lexsort((xid[cand], -score))[:k]
        yield cand[order], score[order]


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, leaf_rows: int = 1024, sample: int = 8192,
    audit: int = 128, target: float = 0.97, block_rows: int = 16_384, query_rows: int = 4_096,
    fan: int = 128, lengths: int = 4,
) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest of ``vectors`` found for each of ``queries``.

    Both have vec_id and embedding; other columns are not used.  Nearness is the inner product in
    double precision; ties go to the smaller vec_id; rows with the query's own id are left out.
    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor
    rows without id.  A query is compared with the vectors of its own length.  Equal rows among
    the queries are asked once; repeated rows of ``vectors`` are found as often as they come.

    The number of leaves grows with the rows (about ``leaf_rows`` each), in two levels of at most
    ``fan`` parts; beyond ``fan`` squared leaves these grow instead.  Routers are fitted on at most
    ``sample`` rows for the top and about as many per part; every row is indexed.  The ``lengths``
    most frequent lengths of vectors have routers, any other is searched in full.  ``audit``
    queries of a length are compared with all its rows by brute force, and as many leaves are
    searched as give a recall of ``target`` there, or more where they hold too few rows; a query
    that still has fewer than ``k`` results is compared with all other leaves.  Neighbouring leaves
    are scored in one task, which gives one answer per query; a task holds about ``block_rows`` rows
    (a larger leaf is cut) and ``query_rows`` queries.

    Broadcast: ``lengths`` trees of at most ``fan`` + 1 networks, each 512 bytes for every
    dimension and part (59 MB a tree at 768 dimensions), and one count per leaf.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    v = F.col("embedding").cast("array<double>")

    def prepared(df: DataFrame) -> DataFrame:
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dim")) \
            .where(usable(F.col("v")) & F.col("vec_id").isNotNull())

    rows, asked = prepared(vectors), prepared(queries).distinct()
    common = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(lengths).collect()
    trees = {r["dim"]: fit_tree(rows.where(F.col("dim") == r["dim"]), r["dim"], r["count"], leaf_rows, fan, sample)
             for r in common if r["count"] > leaf_rows}
    shared = spark.sparkContext.broadcast(trees)

    def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            if int(dim) in shared.value:
                at = np.flatnonzero(dims == dim)
                yield int(dim), at, _matrix(batch.column("v").take(pa.array(at)), int(dim))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = np.zeros(len(batch), np.int32)
            for dim, at, x in by_length(batch):
                leaf[at] = shared.value[dim].leaf(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    # The salt is stored with the row, so a lost task deals it to the same block again.
    index = store(rows.mapInArrow(deal, "vec_id long, v array<double>, dim int, leaf int")
                  .withColumn("salt", F.xxhash64(F.monotonically_increasing_id())), "index")
    # Neighbouring leaves make a bundle of about block_rows rows: one task, one answer per query.
    before = Window.partitionBy("dim").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    sizes = store(index.groupBy("dim", "leaf").agg(F.count("*").alias("rows")).withColumn(
        "bundle", F.floor(F.coalesce(F.sum("rows").over(before), F.lit(0)) / block_rows).cast("int")), "sizes")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    plan = {dim: _audit(index, asked, sizes, tree, dim, k, audit, target, nearest) for dim, tree in trees.items()}
    planned = spark.sparkContext.broadcast(plan)
    sent_schema = "vec_id long, v array<double>, dim int, bundle int, leaves array<int>"

    def route(batches: Iterator[pa.RecordBatch], others: bool = False) -> Iterator[pa.RecordBatch]:
        """A row for every query and bundle with the leaves to search there, or with all others."""
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            plain = [] if others else [i for i, d in enumerate(dims) if int(d) not in shared.value]
            row, bundle, leaves = list(plain), [0] * len(plain), [[0]] * len(plain)
            for dim, at, x in by_length(batch):
                tree, (probes, counts) = shared.value[dim], planned.value[dim]
                names = tree.leaves()
                home = (np.cumsum(counts) - counts) // block_rows
                for i in range(0, len(at), 256):
                    order = tree.ranked(x[i:i + 256])
                    # The query itself may be among the rows, hence one more than k.
                    enough = (np.cumsum(counts[order], axis=1) <= k).sum(1) + 1
                    for j, o, m in zip(at[i:i + 256], order, np.maximum(enough, probes)):
                        o = np.sort(o[m:] if others else o[:m])
                        for part in np.split(o, np.flatnonzero(np.diff(home[o])) + 1) if len(o) else []:
                            row.append(j)
                            bundle.append(int(home[part[0]]))
                            leaves.append(names[part].tolist())
            if row:
                yield pa.RecordBatch.from_arrays(
                    [*batch.take(pa.array(row, pa.int64())).columns, pa.array(bundle, pa.int32()),
                     pa.array(leaves, pa.list_(pa.int32()))], names=[*batch.schema.names, "bundle", "leaves"])

    sent = store(asked.mapInArrow(route, sent_schema), "queries")
    found = store(_scored(index, sizes, sent, k, block_rows, query_rows, nearest), "found")
    full = found.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    rest = store(asked.join(full, "vec_id", "left_anti").mapInArrow(
        lambda batches: route(batches, True), sent_schema), "rest")
    if rest.isEmpty():
        release(sent, rest)
        return found
    more = _scored(index, sizes, rest, k, block_rows, query_rows, nearest)
    return found.unionByName(more).withColumn("rank", F.row_number().over(nearest)) \
        .where(F.col("rank") <= k).select(*[c.split()[0] for c in schema.split(", ")])


def _audit(index: DataFrame, asked: DataFrame, sizes: DataFrame, tree: Tree, dim: int, k: int, audit: int,
           target: float, nearest) -> tuple[int, np.ndarray]:
    """Leaves to search for the wanted recall, and the rows of each leaf in the order of ``leaves``."""
    spark = index.sparkSession
    names = tree.leaves()
    own = {r["leaf"]: r["rows"] for r in sizes.where(F.col("dim") == dim).collect()}  # fan squared at most
    counts = np.array([own.get(int(z), 0) for z in names], np.int64)
    some = asked.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(audit).toArrow()
    if not len(some):
        return 1, counts
    q = _matrix(some.column("v"), dim)
    known = spark.sparkContext.broadcast((some.column("vec_id").to_numpy(), q))

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q_ = known.value
        for batch in batches:
            if not len(batch):
                continue
            xid, leaf = batch.column("vec_id").to_numpy(), batch.column("leaf").to_numpy()
            found = list(best_of(q_, qid, _matrix(batch.column("v"), dim), xid, k))
            at = np.concatenate([f[0] for f in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(qid)), [len(f[0]) for f in found])), pa.array(xid[at]),
                 pa.array(np.concatenate([f[1] for f in found])), pa.array(leaf[at], pa.int32())],
                names=["query_id", "vec_id", "score", "leaf"])

    # The best k of each batch, then the best k of all; query_id is the place in the audit here.
    truth = index.where(F.col("dim") == dim).select("vec_id", "v", "leaf") \
        .mapInArrow(brute, "query_id long, vec_id long, score double, leaf int") \
        .withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k) \
        .select("query_id", "leaf").toArrow()
    if not len(truth):
        return 1, counts
    place = np.empty((len(q), len(names)), np.int64)
    np.put_along_axis(place, tree.ranked(q), np.arange(len(names))[None, :], axis=1)
    at = {int(z): i for i, z in enumerate(names)}
    places = place[truth.column("query_id").to_numpy(), [at[z] for z in truth.column("leaf").to_pylist()]]
    share = np.cumsum(np.bincount(places, minlength=len(names))) / len(places)
    return int(np.argmax(share >= target)) + 1, counts


def _scored(index: DataFrame, sizes: DataFrame, sent: DataFrame, k: int, block_rows: int, query_rows: int,
            nearest) -> DataFrame:
    """The best ``k`` of the leaves that each query (vec_id, v, dim, bundle, leaves) is sent to.

    Only bundles that are asked are dealt, in as many copies as their own queries need.
    """
    home = ["dim", "bundle"]
    cut = store(sizes.groupBy(*home).agg(F.sum("rows").alias("rows")).join(
        sent.groupBy(*home).agg(F.count("*").alias("asked")), home).select(
        *home, F.ceil(F.col("rows") / block_rows).cast("int").alias("blocks"),
        F.ceil(F.col("asked") / query_rows).cast("int").alias("halves")), "cut")

    def each(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    held = index.join(sizes.select("dim", "leaf", "bundle"), ["dim", "leaf"]).join(cut, home).select(
        *home, "vec_id", "v", "leaf", F.pmod("salt", F.col("blocks").cast("long")).cast("int").alias("block"),
        each("halves").alias("half"))
    to = sent.join(cut, home).select(
        *home, "vec_id", "v", "leaves",
        F.pmod(F.xxhash64("vec_id", "v"), F.col("halves").cast("long")).cast("int").alias("half"),
        each("blocks").alias("block"))

    def score(key: tuple, rows_: pa.Table, asked_: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(rows_) and len(asked_):
            dim = key[0].as_py()
            xid, leaf = rows_.column("vec_id").to_numpy(), rows_.column("leaf").to_numpy()
            x = _matrix(rows_.column("v"), dim)
            qid, q = asked_.column("vec_id").to_numpy(), _matrix(asked_.column("v"), dim)
            wanted = asked_.column("leaves").combine_chunks()
            asker = np.repeat(np.arange(len(qid)), wanted.value_lengths().to_numpy())
            wanted = wanted.flatten().to_numpy()
            best: list[list[tuple]] = [[] for _ in qid]
            for z in np.unique(leaf):
                at, who = np.flatnonzero(leaf == z), asker[wanted == z]
                for i in range(0, len(who), 512):
                    w = who[i:i + 512]
                    for a, (pos, s) in zip(w, best_of(q[w], qid[w], x[at], xid[at], k)):
                        best[a].append((xid[at[pos]], s))
            for a, parts in enumerate(best):
                ids, s = (np.concatenate([c[i] for c in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1))
                top = np.lexsort((ids, -s))[:k]
                if len(top):
                    out.append((int(qid[a]), ids[top].tolist(), s[top].tolist()))
        return pa.table({"query_id": pa.array([o[0] for o in out], pa.int64()),
                         "ids": pa.array([o[1] for o in out], pa.list_(pa.int64())),
                         "scores": pa.array([o[2] for o in out], pa.list_(pa.float64()))})

    keys = [*home, "block", "half"]
    found = held.groupBy(*keys).cogroup(to.groupBy(*keys)).applyInArrow(
        score, "query_id long, ids array<long>, scores array<double>")
    return found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("z")).select(
        "query_id", F.col("z.ids").alias("vec_id"), F.col("z.scores").alias("score")) \
        .withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
