"""Removal of passages that repeat an earlier document, by FM-indexes of content-defined shards.

Every window of ``threshold`` words has an anchor: its word 5-gram of the least hash.  Equal
windows have equal anchors, so documents need to be compared only where an anchor occurs in two
of them.  The stretches of windows around such anchors are dealt to shards by the anchor.  A
shard holds each different stretch once, with the smallest document that has it; its words are
indexed by a compressed FM-index, and all stretches are streamed against it by backward search.
Windows whose match reaches the threshold learn the smallest document they occur in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.llm.common import WORD, chunks, distinct, gram_hashes, release, store, word_hashes
from trialframe.llm.fmindex import FMIndex

ANCHOR = 5
WORDS = re.compile(WORD)


def stretches(texts: list[str | None], threshold: int):
    """Per text: (anchor, first word, number of windows) of its runs of windows with one anchor."""
    span = threshold - ANCHOR + 1
    for i, j in chunks(texts):
        words, first = word_hashes(texts[i:j])
        n = len(words) - threshold + 1
        none = np.zeros(0, np.int64)
        if n <= 0:
            yield from ((none.astype(np.uint64), none, none) for _ in range(i, j))
            continue
        grams = gram_hashes(words, ANCHOR)
        best, place = grams[:n].copy(), np.zeros(n, np.int64)
        for o in range(1, span):
            less = grams[o:o + n] < best
            best[less], place[less] = grams[o:o + n][less], o
        at = np.arange(n)
        doc = np.searchsorted(first, at, "right") - 1
        valid = at + threshold <= first[doc + 1]
        at, doc, place, best = at[valid], doc[valid], place[valid] + at[valid], best[valid]
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
        start = np.flatnonzero(new)
        many = np.diff(start, append=len(at))
        bounds = np.searchsorted(doc[start], np.arange(j - i + 1))
        for d in range(j - i):
            s = slice(bounds[d], bounds[d + 1])
            yield best[start[s]], at[start[s]] - first[d], many[s]


def _anchors(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [distinct(a).view(np.int64) for a, _, _ in
                 stretches(batch.column("text").to_pylist(), threshold)]
        flat = np.concatenate(found) if found else np.zeros(0, np.int64)
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(flat))],
            names=["doc_id", "anchors"])


def _cut(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """(place, stretch, start, doc_id, key) around anchors that are shared.

    ``place`` deals stretches to shards: the anchor, or for an anchor of very many documents the
    hash of a single window, so that no place gathers more than equal windows.
    """
    for batch in batches:
        texts = batch.column("text").to_pylist()
        ids, keys = batch.column("doc_id").to_pylist(), batch.column("key").to_pylist()
        shared, hot = batch.column("shared"), batch.column("hot")
        out: list[tuple] = []
        for i, (anchor, start, many) in enumerate(stretches(texts, threshold)):
            wanted = np.asarray(shared[i].values.to_numpy(), np.int64)
            often = np.asarray(hot[i].values.to_numpy(), np.int64)
            signed = anchor.view(np.int64)
            take = np.flatnonzero(np.isin(signed, wanted))
            if not len(take):
                continue
            words = WORDS.findall(texts[i])
            single = np.isin(signed, often)
            hashes = gram_hashes(word_hashes([texts[i]])[0], threshold).view(np.int64) \
                if single.any() else None
            for k in take:
                a, n = int(start[k]), int(many[k])
                if single[k]:
                    out += [(int(hashes[a + w]), " ".join(words[a + w:a + w + threshold]), a + w,
                             ids[i], keys[i]) for w in range(n)]
                else:
                    out.append((int(signed[k]), " ".join(words[a:a + n + threshold - 1]), a, ids[i], keys[i]))
            if len(out) > 20_000:
                yield _stretch_batch(out)
                out = []
        if out:
            yield _stretch_batch(out)


def _stretch_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                      names=["place", "stretch", "start", "doc_id", "key"])


def _search(threshold: int):
    def apply(t: pa.Table) -> pa.Table:
        """One shard: index the stretches, search every window of each, give its first document."""
        t = t.sort_by([("place", "ascending"), ("stretch", "ascending")])
        texts = [s.split(" ") for s in t.column("stretch").to_pylist()]
        ids: dict[str, int] = {}
        sizes = np.array([len(w) for w in texts])
        flat = np.array([ids.setdefault(w, len(ids) + 1) for ws in texts for w in ws], np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])
        text = np.zeros(begin[-1], np.int64)
        inner = np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)
        text[inner] = flat
        index = FMIndex(text, len(ids) + 1)
        many = sizes - threshold + 1
        owner = np.repeat(np.arange(len(sizes)), many)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin[:-1], many)
        docs = t.column("first").to_numpy()
        found = docs[owner].copy()
        by_suffix = np.append(docs[np.repeat(np.arange(len(sizes)), sizes + 1)][index.suffix],
                              np.iinfo(np.int64).max)
        for i in range(0, len(at), 1 << 18):
            part = slice(i, i + (1 << 18))
            lo, hi, length = index.intervals(text[at[part][:, None] + np.arange(threshold)])
            hit = np.flatnonzero(length >= threshold)
            if len(hit):
                low, first, back = np.unique(lo[hit], return_index=True, return_inverse=True)
                edges = np.column_stack([low, hi[hit][first]]).ravel()
                least = np.minimum.reduceat(by_suffix, edges)[::2]
                found[i + hit] = least[back]
        ends = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
        return pa.table({"place": t.column("place"), "stretch": t.column("stretch"),
                         "firsts": pa.ListArray.from_arrays(ends, pa.array(found))})

    return apply


def _keep(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, removed, kept = [], [], []
        for text, covered in zip(batch.column("text").to_pylist(), batch.column("covered").to_pylist()):
            words = WORDS.findall(text or "")
            total.append(len(words))
            if covered:
                gone = np.zeros(len(words) + 1, np.int64)
                starts = np.unique(np.array(covered, np.int64))
                gone[starts] += 1
                np.subtract.at(gone, starts + threshold, 1)
                stay = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
                removed.append(len(words) - len(stay))
                words = [words[k] for k in stay]
            else:
                removed.append(0)
            kept.append(" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in batch.schema.names if c != "covered"),
             pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
            names=[*(c for c in batch.schema.names if c != "covered"), "n_words", "n_removed", "kept_text"])


def repeated_windows(docs: DataFrame, threshold: int = 13, often: int = 10_000,
                     shard_stretches: int = 50_000) -> DataFrame:
    """(doc_id, key, covered): first words of the windows that begin in a document of a smaller id.

    ``key`` is xxhash64 of the text, so that rows of one id with different texts stay apart.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .where("doc_id is not null and text is not null")
    anchors = store(base.mapInArrow(lambda b: _anchors(b, threshold), "doc_id long, anchors array<long>"),
                    "anchors")
    each = anchors.select("doc_id", F.explode("anchors").alias("anchor"))
    shared = each.groupBy("anchor").agg(
        F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")) \
        .where("a < b").select(F.col("anchor").alias("of"), "n")
    hits = store(each.join(shared, F.col("anchor") == F.col("of")).groupBy("doc_id").agg(
        F.collect_set("anchor").alias("shared"),
        F.collect_set(F.when(F.col("n") > often, F.col("anchor"))).alias("hot")), "hits")
    found = store(base.withColumn("key", F.xxhash64("text")).join(hits, "doc_id").select(
        "doc_id", "key", "text", "shared", "hot").mapInArrow(
        lambda b: _cut(b, threshold), "place long, stretch string, start int, doc_id long, key long")
        .withColumn("name", F.xxhash64("stretch")),
        "stretches")
    release(anchors, hits)
    different = store(found.groupBy("place", "stretch").agg(F.min("doc_id").alias("first")), "different")
    shards = max(1, -(-different.count() // shard_stretches))
    answers = store(different.withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(shards)))
                    .groupBy("shard").applyInArrow(
        _search(threshold), "place long, stretch string, firsts array<long>")
                    .select("place", F.xxhash64("stretch").alias("name"), "firsts"), "answers")
    release(different)
    earlier = F.filter(F.transform("firsts", lambda d, i: F.when(d < F.col("doc_id"), F.col("start") + i)),
                       lambda x: x.isNotNull())
    # Within a place, a stretch is named by a 64-bit hash: its text was needed for the index only.
    return found.drop("stretch").join(answers, ["place", "name"]).select("doc_id", "key", earlier.alias("c")) \
        .where(F.size("c") > 0).groupBy("doc_id", "key").agg(F.flatten(F.collect_list("c")).alias("covered"))


def remove_repeats(docs: DataFrame, threshold: int = 13, often: int = 10_000,
                   shard_stretches: int = 50_000) -> DataFrame:
    """All columns of ``docs`` plus n_words, n_removed and kept_text.

    Words are ``[^\\x20\\x09-\\x0D]+``.  A word goes if it lies in a window of ``threshold`` words
    (5 to 16) that also begins in a document with a smaller doc_id, judged on the input;
    ``kept_text`` has the others, joined by one blank.  A null text has no words.  Rows without
    an id and rows of one id are never earlier than each other; repeated rows get equal results.
    An empty table gives an empty result; columns of these names are replaced.

    Anchors found in more than ``often`` documents are split by window.  A shard holds about
    ``shard_stretches`` different stretches, whatever the number of documents.
    """
    names = ("n_words", "n_removed", "kept_text")
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (*names, "covered")])
    marked = own.withColumn("__id", F.col("doc_id").cast("long")).withColumn(
        "__key", F.xxhash64(F.col("text").cast("string")))
    covered = repeated_windows(docs, threshold, often, shard_stretches).select(
        F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "covered")
    joined = marked.join(covered, ["__id", "__key"], "left").select(
        *[F.col(f"`{c}`") for c in own.columns], "covered")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    return joined.mapInArrow(lambda b: _keep(b, threshold),
                             f"{schema}, n_words long, n_removed long, kept_text string")
