"""Jaccard self-join of word n-gram sets by vertical partitioning, down to its components.

1. Equal sets are one class.  Of each class the first grams by hash are looked at: by the prefix
   theorem a class that shares too few of them with any other cannot link, and drops out.
2. Over the rest, grams are put in one global order, the rarest first, and the order is cut into
   fragments.  Classes that share enough grams of their prefixes in that order form clusters; no link
   leads out of one.
3. Clusters are compared block by block.  Every fragment counts its part of the overlaps of a
   block on its own, as one matrix; the matrices of all fragments are summed, and the sums give
   the exact similarity.  Only a spanning forest of the links leaves a task.
4. In a cluster larger than a round's pivots, links found merge components, and a class is
   compared further only while classes outside its component are left.  So a large group of
   near copies costs a few rows of blocks, not all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialframe.llm.common import chunks, distinct, gram_hashes, mix, release, store, word_hashes
from trialframe.llm.graph import components
from trialframe.llm.hnsw import _forest

#: Prefixes are longer than the theorem's shortest by one gram in so many, and as many must match.
EXTRA = 25
#: Texts that a worker holds at a time, grams of the whole sets it sends on at a time, and matches of
#: grams that it counts at a time: its memory follows these, not the rows of a task.
ROWS, SENT_GRAMS, MATCHES = 1_024, 1 << 18, 1 << 18
#: A round has twice the pivots of the one before, up to so many times those of the first.
MOST_PIVOTS = 4
#: Classes with a gram in their prefixes that are paired with each other; of more, each goes with the first.
PAIRED = 16


def gram_sets(texts: list[str | None], n: int, fold: bool) -> Iterator[np.ndarray]:
    """The sorted distinct gram hashes of each text; a shorter text is one gram; no words, none."""
    for i, j in chunks(texts):
        words, first = word_hashes(texts[i:j], fold)
        for a, b in zip(first[:-1], first[1:]):
            w = words[a:b]
            yield distinct(gram_hashes(w, n) if len(w) >= n else
                           mix(gram_hashes(w, len(w)) + np.uint64(len(w))) if len(w) else w)


_KEYS = np.array([[0x1B873593CC9E2D51], [0x85EBCA6BC2B2AE35]], np.uint64)


def set_keys(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit fingerprint of a set."""
    return tuple(mix(s ^ _KEYS).sum(axis=1, dtype=np.uint64).view(np.int64).tolist())


def least_overlap(n: Column | int, percent: int):
    """The overlap that a set of ``n`` needs with any partner: ceil(percent * n / 100)."""
    if isinstance(n, Column):
        return F.ceil(n * percent / 100).cast("long")
    return -(-percent * n // 100)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), ROWS):
            yield batch.slice(i, ROWS)


def _long_lists(arrays: list[np.ndarray]) -> pa.Array:
    """Arrays of 64 bits as a list<long> column, without Python numbers."""
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(ends, pa.array(flat))


def fingerprints(docs: DataFrame, n: int, percent: int, fold: bool) -> DataFrame:
    """doc_id, size, k1, k2 and the first grams by hash, long enough for the first filter."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            sizes, k1, k2, prefixes = [], [], [], []
            for s in gram_sets(batch.column("text").to_pylist(), n, fold):
                a, b = set_keys(s)
                m = len(s)
                sizes.append(m)
                k1.append(a)
                k2.append(b)
                prefixes.append(s[:m - least_overlap(m, percent) + max(1, m // EXTRA)].copy())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(k1, pa.int64()),
                 pa.array(k2, pa.int64()), _long_lists(prefixes)],
                names=["doc_id", "size", "k1", "k2", "prefix"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(
        apply, "doc_id long, size long, k1 long, k2 long, prefix array<long>")


def _eligible(classes: DataFrame, percent: int) -> DataFrame:
    """Classes with enough grams of their prefix in a second class."""
    grams = classes.select("cid", F.explode("prefix").alias("gram"))
    shared = grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select(
        F.col("gram").alias("g"))
    hits = grams.join(shared.hint("shuffle_hash"), F.col("gram") == F.col("g")).groupBy("cid").agg(F.count("*").alias("hits"))
    need = F.greatest(F.lit(1), F.floor(least_overlap(F.col("size"), percent) / EXTRA))
    return classes.drop("prefix").join(hits, "cid").where(F.col("hits") >= need).drop("hits")


def _whole_sets(docs: DataFrame, wanted: DataFrame, n: int, fold: bool) -> DataFrame:
    """(cid, size, grams) of the wanted classes, from the text of one document of each."""
    def sent(cids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(cids, pa.int64()), pa.array([len(g) for g in sets], pa.int64()), _long_lists(sets)],
            names=["cid", "size", "grams"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            keys = list(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist()))
            cids, found, sets, held = batch.column("cid").to_pylist(), [], [], 0
            for i, s in enumerate(gram_sets(batch.column("text").to_pylist(), n, fold)):
                if set_keys(s) == keys[i]:
                    found.append(cids[i])
                    sets.append(s)
                    held += len(s)
                if held > SENT_GRAMS:
                    yield sent(found, sets)
                    found, sets, held = [], [], 0
            yield sent(found, sets)

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = d.join(wanted.select("cid", "k1", "k2", "first"), d["doc_id"].eqNullSafe(F.col("first")))
    return rows.select("cid", "k1", "k2", "text").mapInArrow(
        apply, "cid long, size long, grams array<long>").dropDuplicates(["cid"])


def _ordered(sets: DataFrame, fragments: int) -> tuple[DataFrame, DataFrame]:
    """The stored grams behind it, and (cid, grams): (place, gram, fragment) in global order.

    Only of grams that several sets have: the others come first in the order, so that their number says
    where a prefix ends, and they add to no overlap.
    """
    grams = sets.select("cid", F.explode("grams").alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select(F.col("gram").alias("g"), "n")
    # The order: by number of sets, then by hash.
    place = (F.col("n") * F.lit(1 << 20) + F.shiftrightunsigned("gram", 44)).alias("place")
    placed = store(grams.join(counts.hint("shuffle_hash"), F.col("gram") == F.col("g")).select(
        "cid", "gram", place), "grams")
    cuts = placed.agg(F.percentile_approx(
        "place", [i / fragments for i in range(1, fragments)], 1000)).first()[0] or []
    fragment = sum((F.when(F.col("place") > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    return placed, placed.groupBy("cid").agg(F.array_sort(F.collect_list(
        F.struct("place", "gram", fragment.alias("fragment")))).alias("grams"))


def _candidates(ordered: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) so that the classes of a link have a path between them; few others have.

    Prefixes longer by e grams than the theorem's shortest, less one, share the lesser e of the two at
    least.  Classes with a gram that is rare among prefixes are paired, and so many must be shared;
    those that may share none but often found grams are tied to the first class of each.
    """
    least = least_overlap(F.col("size"), percent)

    def longer(overlap: Column) -> Column:
        return F.greatest(F.lit(1), F.floor(overlap / EXTRA))

    extra = longer(least)
    # What stands before the shared grams in the order is in the prefix as well.
    into = F.size("grams") - least
    seen = ordered.where(into >= 0).select(
        "cid", "size", F.explode(F.slice("grams", F.lit(1), (into + extra).cast("int"))["gram"]).alias("gram"))
    heads = seen.groupBy("gram").agg(F.count("*").alias("many"), F.min("cid").alias("head")).where(
        "many > 1").select(F.col("gram").alias("g"), "many", "head")
    marked = store(seen.join(heads.hint("shuffle_hash"), F.col("gram") == F.col("g")).drop("g"), "prefixes")
    often = marked.where(F.col("many") > PAIRED)
    of_often = often.groupBy("cid").agg(F.count("*").alias("often")).select(F.col("cid").alias("c"), "often")
    one = F.struct("cid", "size", extra.alias("extra"), F.coalesce("often", F.lit(0)).alias("often"))
    paired = marked.where(F.col("many") <= PAIRED).join(of_often, F.col("cid") == F.col("c"), "left").groupBy(
        "gram").agg(F.collect_list(one).alias("row")).select("row", F.explode("row").alias("a")).select(
        "a", F.explode("row").alias("b")).where("a.cid < b.cid").where(
        (F.col("a.size") >= least_overlap(F.col("b.size"), percent))
        & (F.col("b.size") >= least_overlap(F.col("a.size"), percent)))
    enough = F.least("a.extra", "b.extra") - F.least("a.often", "b.often")
    rare = paired.groupBy("a.cid", "b.cid").agg(F.count("*").alias("n"), F.first(enough).alias("enough")).toDF(
        "a", "b", "n", "enough").where("n >= enough").select("a", "b")
    # A partner has ``least`` grams at least.
    tied = often.join(of_often, F.col("cid") == F.col("c")).where(
        F.col("often") >= longer(least_overlap(least, percent))).where("cid <> head")
    return rare.unionByName(tied.select(F.col("cid").alias("a"), F.col("head").alias("b")).distinct())


def _overlaps(t: pa.Table) -> pa.Table:
    """The counts of one fragment in one block: a matrix of pivots by members."""
    pivot = t.filter(t.column("pivot")).sort_by("cid")
    member = t.filter(pa.compute.invert(t.column("pivot"))).sort_by("cid")
    p, m = len(pivot), len(member)
    counts = np.zeros(p * m, np.int64)

    def flat(side: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        lists = side.column("grams").combine_chunks()
        size = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
        return lists.flatten().to_numpy(), np.repeat(np.arange(len(side)), size)

    if p and m:
        (ga, ia), (gb, ib) = flat(pivot), flat(member)
        oa, ob = np.argsort(ga, kind="stable"), np.argsort(gb, kind="stable")
        ga, ia, gb, ib = ga[oa], ia[oa], gb[ob], ib[ob]
        lo, hi = np.searchsorted(gb, ga, "left"), np.searchsorted(gb, ga, "right")
        many = hi - lo
        ends = np.cumsum(many)
        at = 0
        while at < len(ga):  # so many matches at a time that memory stays bounded
            base = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, base + MATCHES)))
            k = many[at:upto]
            where = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo[at:upto], k)
            counts += np.bincount(np.repeat(ia[at:upto], k) * m + ib[where], minlength=p * m)
            at = upto
    return pa.table({
        "bin": t.column("bin")[:1], "block": t.column("block")[:1],
        "pivots": pa.array([pivot.column("cid").to_pylist()], pa.list_(pa.int64())),
        "pivot_sizes": pa.array([pivot.column("size").to_pylist()], pa.list_(pa.int64())),
        "members": pa.array([member.column("cid").to_pylist()], pa.list_(pa.int64())),
        "member_sizes": pa.array([member.column("size").to_pylist()], pa.list_(pa.int64())),
        "counts": pa.array([counts.astype(np.uint32).tobytes()], pa.binary())})


def _verified(percent: int):
    def apply(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py(), np.uint32).astype(np.int64) for c in t.column("counts"))
        a = np.array(t.column("pivots")[0].as_py(), np.int64)
        b = np.array(t.column("members")[0].as_py(), np.int64)
        na = np.array(t.column("pivot_sizes")[0].as_py(), np.int64)[:, None]
        nb = np.array(t.column("member_sizes")[0].as_py(), np.int64)[None, :]
        both = total.reshape(len(a), len(b))
        i, j = np.nonzero((100 * both >= percent * (na + nb - both)) & (a[:, None] != b[None, :]))
        edges = _forest(a[i], b[j])
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()),
                         "b": pa.array([e[1] for e in edges], pa.int64())})

    return apply


def _compare(parts: DataFrame, members: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """Forest edges between pivots and all members of their bins.

    ``parts`` (cid, size, fragment, grams), ``members`` (cid, bin, block, blocks), ``pivots`` (cid).
    """
    own = members.join(parts, "cid")
    side = own.select("bin", "block", "fragment", "cid", "size", "grams", F.lit(False).alias("pivot"))
    sent = own.join(pivots, "cid").select(
        "bin", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "fragment", "cid",
        "size", "grams", F.lit(True).alias("pivot"))
    counted = side.unionByName(sent).groupBy("bin", "block", "fragment").applyInArrow(
        _overlaps, "bin long, block long, pivots array<long>, pivot_sizes array<long>, "
        "members array<long>, member_sizes array<long>, counts binary")
    return counted.groupBy("bin", "block").applyInArrow(_verified(percent), "a long, b long")


def _link(sets: DataFrame, percent: int, fragments: int, round_pivots: int, block_rows: int) -> DataFrame:
    """(cid, root) for the classes that link with another."""
    placed, arranged = _ordered(sets, fragments)
    ordered = store(arranged.join(sets.select("cid", "size"), "cid"), "ordered")
    release(placed)
    clusters = components(_candidates(ordered, percent))
    # Small clusters share bins of about a block; a large one has a bin of its own.
    sizes = clusters.groupBy("root").agg(F.count("*").alias("many"))
    total = clusters.count()
    bins = max(1, -(-total // block_rows))
    binned = clusters.join(sizes, "root").select(
        F.col("node").alias("cid"), F.when(F.col("many") <= block_rows // 2, F.pmod(
            F.xxhash64("root"), F.lit(bins))).otherwise(F.col("root") + bins).alias("bin"))
    amount = binned.groupBy("bin").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
    members = store(binned.join(amount, "bin").withColumn(
        "block", F.pmod(F.xxhash64("cid"), F.col("blocks"))), "members")
    # Every set has a row for every fragment, so that the ids of a block agree in all of them.
    every = F.explode(F.sequence(F.lit(0), F.lit(fragments - 1))).alias("fragment")
    parts = ordered.join(members.select("cid"), "cid").select("cid", "size", "grams", every).select(
        "cid", "size", "fragment",
        F.filter("grams", lambda g: g["fragment"] == F.col("fragment"))["gram"].alias("grams"))

    state = members.select("cid", "bin", F.col("cid").alias("root"), F.lit(False).alias("done"))
    linked: DataFrame | None = None
    many = round_pivots
    while True:
        # A bin has work while its classes not yet done lie in more than one component.
        active = state.where("not done").groupBy("bin").agg(
            F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("bin")
        todo = state.join(active, "bin")
        weight = todo.groupBy("bin", "root").agg(F.count("*").alias("weight"))
        order = Window.partitionBy("bin").orderBy("weight", F.xxhash64("cid"), "cid")
        chosen = store(todo.where("not done").join(weight, ["bin", "root"]).withColumn(
            "nth", F.row_number().over(order)).where(F.col("nth") <= many).select("cid", "bin"), "pivots")
        if chosen.isEmpty():
            break
        many = min(2 * many, MOST_PIVOTS * round_pivots)
        found = store(_compare(parts, members.join(chosen.select("bin").distinct(), "bin"),
                               chosen.select("cid"), percent), "links")
        linked = components(found if linked is None else found.unionByName(
            linked.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))))
        state = store(
            members.select("cid", "bin").join(linked.select(F.col("node").alias("cid"), "root"), "cid", "left")
            .join(state.where("done").select("cid").unionByName(chosen.select("cid"))
                  .withColumn("done", F.lit(True)), "cid", "left")
            .select("cid", "bin", F.coalesce("root", "cid").alias("root"),
                    F.coalesce("done", F.lit(False)).alias("done")), "state")
    return state.select("cid", "root")


def near_duplicates(
    docs: DataFrame, n: int = 5, percent: int = 80, fold: bool = True, fragments: int = 8,
    round_pivots: int = 512, block_rows: int = 256,
) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text).

    A set holds the distinct runs of ``n`` words ``[^\\x20\\x09-\\x0D]+``; with fewer words, the
    whole sequence; without words or text it is empty and links with nothing.  ``fold``
    lower-cases A-Z.  Sets link when 100 * intersection >= ``percent`` * union, exactly; grams
    are 64-bit hashes.  ``component_id`` is the smallest doc_id reachable over links.  Repeated
    rows and ids are classed with their sets; rows without an id have the component of their
    set, null if no row in it has an id.  Other columns are not used.

    Everything is summed before it is shuffled, groups hold one set or one block, and rows of one
    hot set or gram meet in joins that Spark splits.
    """
    prints = store(fingerprints(docs, n, percent, fold), "fingerprints", ROWS)
    classes = store(
        prints.where("size > 0").groupBy("k1", "k2", "size").agg(
            F.min("doc_id").alias("first"), F.first("prefix").alias("prefix"))
        .select(F.monotonically_increasing_id().alias("cid"), "*"), "classes")
    slim = store(prints.drop("prefix"), "fingerprints")
    release(prints)
    wanted = store(_eligible(classes, percent), "eligible")
    named = store(classes.drop("prefix"), "classes")
    release(classes)
    linked = _link(store(_whole_sets(docs, wanted, n, fold), "sets", ROWS), percent, fragments,
                   round_pivots, block_rows)
    placed = named.join(linked, "cid", "left").select(
        "k1", "k2", "size", "first", F.coalesce("root", "cid").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component"))
    known = placed.join(smallest, "root").select(
        F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("size").alias("cs"), "component")
    same = (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("size") == F.col("cs"))
    return slim.join(known, same, "left").select(
        "doc_id", F.col("size").alias("n_shingles"),
        F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))
