"""Best-fit packing with large-item matching, over the histogram of piece lengths.

How many pieces have each length decides everything a packing needs, and there are at most
``capacity`` lengths.  So texts are cut into pieces once, lengths are counted, the packing is
made from the counts, and each piece finds its place by its rank among pieces of its length.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialframe.llm.common import chunks, store

END = 2
#: Longer texts go to the tokenizer itself, whose pattern stands runs of any length.
LONG_TEXT = 1_000_000

_encoders: dict[str, object] = {}


def encoder(path: str):
    """text -> ids of the tokenizer file, without special tokens added.

    Byte-level files whose ids follow the order of their merges are run by tiktoken on the same
    vocabulary, which gives the same ids several times faster; texts that hold the string of a
    special token, very long ones, and all other files are run by the tokenizer itself.
    """
    if path in _encoders:
        return _encoders[path]
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)

    def plain(text: str):
        return own.encode(text, add_special_tokens=False).ids

    _encoders[path] = plain
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    vocab = model["vocab"]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    fits = (
        model.get("type", "BPE") == "BPE" and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        and not spec.get("normalizer") and len(vocab) - len(special & set(vocab)) == 256 + len(merges)
        and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
    )
    if fits:
        import public_tokenizers
        import tiktoken

        # The printable stand-ins of bytes: printable Latin-1 stands for itself, others follow 255.
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in keep]
        byte = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
        fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                 special_tokens={}).encode_ordinary

        def ids(text: str):
            if len(text) > LONG_TEXT or any(s in text for s in special):
                return plain(text)
            return fast(text)

        _encoders[path] = ids
    return _encoders[path]


PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, "
          "task long, nth long")


def cut(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document: ids and the end id, cut so that only the first may be short.

    A null text is empty.  ``task`` and ``nth`` number the pieces of one length within a task;
    store the result before using them.  ``keep_ids`` adds the ids themselves.
    """
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, counts = encoder(tokenizer_path), TaskContext.get().partitionId(), {}
        for batch in batches:
            names, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for i, j in chunks(texts.to_pylist()):
                rows: list[tuple] = []
                for name, text in zip(names[i:j], texts[i:j].to_pylist()):
                    ids = np.array([*encode(text or ""), END], "<u4")
                    first = len(ids) % capacity or capacity
                    edges = [0, *range(first, len(ids) + 1, capacity)]
                    for k in range(len(edges) - 1):
                        part = ids[edges[k]:edges[k + 1]]
                        nth = counts.get(len(part), 0)
                        counts[len(part)] = nth + 1
                        rows.append((name, k, edges[k], len(part), zlib.crc32(part.tobytes()), task,
                                     nth, *([part.tolist()] if keep_ids else [])))
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.list_(pa.int32())]
                heads = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", "ids"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, kinds)], names=heads[:len(cols)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")
                       .alias("text")).mapInArrow(pieces, PIECES + (", ids array<int>" if keep_ids else ""))


def pack_counts(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences have each, for so many pieces of each length.

    Pieces above a third of the capacity are matched greedily, the longest first, each with the
    longest that still fits, so that a sequence holds two at most.  Smaller ones, the longest
    first, go where the least room is left.  The work depends on the number of lengths only.
    """
    left = {n: c for n, c in counts.items() if c}
    large = sorted(n for n in left if 3 * n > capacity)
    open_: dict[int, list[list]] = {}

    def add(room: int, pattern: tuple[int, ...], count: int):
        if count:
            open_.setdefault(room, []).append([pattern, count])

    for a in reversed(large):
        while left[a]:
            i = bisect.bisect_right(large, min(a, capacity - a)) - 1
            while i >= 0 and not left[large[i]]:
                i -= 1
            b = large[i] if i >= 0 else None
            if b is None or (b == a and left[a] == 1):
                while b == a and (i := i - 1) >= 0 and not left[large[i]]:
                    pass
                b = large[i] if b == a and i >= 0 else None
            if b is None:
                add(capacity - a, (a,), left[a])
                left[a] = 0
                continue
            k = left[a] // 2 if a == b else min(left[a], left[b])
            add(capacity - a - b, (a, b), k)
            left[a] -= k
            left[b] -= k
    rooms = sorted(open_)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            i = bisect.bisect_left(rooms, n)
            if i == len(rooms):
                each = capacity // n
                full, last = divmod(left[n], each)
                for k, c in ((each, full), (last, 1)):
                    if k and c:
                        room = capacity - k * n
                        if room not in open_:
                            bisect.insort(rooms, room)
                        add(room, (n,) * k, c)
                left[n] = 0
                break
            room = rooms[i]
            pattern, count = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            k = min(count, left[n])
            for r, p, c in ((room - n, (*pattern, n), k), (room, pattern, count - k)):
                if c:
                    if r not in open_:
                        bisect.insort(rooms, r)
                    add(r, p, c)
            left[n] -= k
    return [(tuple(p), c) for r in sorted(open_) for p, c in open_[r]]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> (first rank, first sequence, offset) of each run of pieces of that length."""
    taken: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for pattern, count in patterns:
        offset = 0
        for n in pattern:
            out.setdefault(n, []).append((taken.get(n, 0), sequence, offset))
            taken[n] = taken.get(n, 0) + count
            offset += n
        sequence += count
    return {n: tuple(np.array(x, np.int64).T) for n, x in out.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of ``docs``.

    Other columns of ``docs`` are not used.  A null or empty text is one piece with the end id.
    Repeated rows and ids are packed as often as they come.  An empty table gives no piece.
    The packing is made on the driver from at most ``capacity`` counts, whatever the number of
    documents; pieces learn their rank from a table of (task, length) counts.
    """
    spark = docs.sparkSession
    found = store(cut(docs, tokenizer_path, capacity), "pieces")
    per_task = found.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = store(per_task.select("length", "task", "n",
                                 F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "ranks")
    counts = {r["length"]: r["n"] for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(slots(pack_counts(counts, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            seq, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                own = length == n
                start, sequence, off = plan.value[int(n)]
                i = np.searchsorted(start, rank[own], "right") - 1
                seq[own] = sequence[i] + rank[own] - start[i]
                offset[own] = off[i]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(seq), pa.array(offset)],
                names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = found.join(base.drop("n"), ["length", "task"]).select(
        *names, (F.col("nth") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, "
                             "ids_crc32 long, sequence_id long, offset long")
