"""Quality by co-training a text view and a metadata view.

Two logistic models, one on what the text looks like and one on source, language and length,
are fitted on labelled documents.  Over some rounds each labels the unlabelled documents that it
is surest of for the other.  Both are then calibrated on labelled documents kept aside, and a
logistic combination of the calibrated views scores every document.

Labelled documents are a bounded sample, taken by a hash of the id; the exchange covers every
unlabelled document.  Their features are stored once; per round one pass counts their scores in
cells, one takes the surest, and the views are refitted from gradients and Hessians summed over
the tasks.  Scoring covers all documents in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.llm.common import BLOCK, chunks, mix, release, store, word_hashes

PAIRS = 256
SHAPES = 14
SOURCES, LANGS, LENGTHS = 64, 16, 12
TEXT_WIDTH, META_WIDTH = PAIRS + SHAPES + 1, SOURCES + LANGS + LENGTHS + 1


def _classes() -> np.ndarray:
    kind = np.zeros(256, np.int64)  # 0 letters and bytes of other scripts
    for b in range(256):
        c = chr(b)
        if b < 128 and not c.isalpha():
            kind[b] = 1 if c.isdigit() else 2 if c == "\n" else 3 if c.isspace() else 4
        elif b < 128 and c.isupper():
            kind[b] = 5
    return kind


KIND = _classes()


def text_features(texts: list[str | None]) -> np.ndarray:
    """Square roots of byte-pair shares in 256 hashed cells, shares of character kinds, length.

    Texts are read whole, in blocks, so that memory does not grow with the length of one.
    """
    out = np.zeros((len(texts), TEXT_WIDTH), np.float32)
    for i, j in chunks(texts, BLOCK):
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts[i:j]]
        m = j - i
        pairs, kinds = np.zeros(m * PAIRS), np.zeros((m, 6))
        runs, words = np.zeros(m), np.zeros(m)
        buffer = np.frombuffer(b"".join(data), np.uint8)
        ends = np.cumsum([len(d) for d in data])
        for at in range(0, len(buffer), BLOCK):
            part = buffer[at:at + BLOCK + 1]
            n = min(BLOCK, len(part))
            doc = np.searchsorted(ends, np.arange(at, at + len(part)), "right")
            same = doc[:-1] == doc[1:]
            cell = (part[:-1].astype(np.int32) * 37 + part[1:].astype(np.int32) * 101) % 251
            cell = np.where(part[:-1] == part[1:], 251 + KIND[part[:-1]] % 5, cell)
            pairs += np.bincount((doc[:-1] * PAIRS + cell)[same], minlength=m * PAIRS)
            kind = KIND[part[:n]]
            kinds += np.bincount(doc[:n] * 6 + kind, minlength=m * 6).reshape(m, 6)
            blank = (KIND[part] == 2) | (KIND[part] == 3)
            words += np.bincount(doc[:-1][same & blank[1:] & ~blank[:-1]], minlength=m)
            odd = KIND[part] == 4
            runs += np.bincount(doc[:-1][same & odd[1:] & odd[:-1]], minlength=m)
        size = np.maximum(1, [len(d) for d in data])
        hashes, first = word_hashes(texts[i:j])
        of = np.repeat(np.arange(m), np.diff(first))
        again = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
        repeats = np.bincount(of[1:][again], minlength=m)
        n_words = np.maximum(1, np.diff(first))
        shares = pairs.reshape(m, PAIRS)
        out[i:j, :PAIRS] = np.sqrt(shares / np.maximum(1, shares.sum(1, keepdims=True))) * 4
        out[i:j, PAIRS:PAIRS + 6] = kinds / size[:, None] * 4
        out[i:j, PAIRS + 6] = runs / size * 8
        out[i:j, PAIRS + 7] = np.log1p(size) / 4
        out[i:j, PAIRS + 8] = np.minimum(4, size / (words + 1) / 8)
        out[i:j, PAIRS + 9] = words < 5
        out[i:j, PAIRS + 10] = size <= 1
        out[i:j, PAIRS + 12] = repeats / n_words * 4
        out[i:j, PAIRS + 13] = repeats > 3
        out[i:j, PAIRS + 11] = np.sqrt(kinds[:, 4] / (words + 1))
    out[:, -1] = 1
    return out


def meta_features(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Hashed source and language, and the length in powers of two; a null is a value of its own."""
    def cell(values: list, width: int) -> np.ndarray:
        raw = np.array([0 if v is None else 1 + sum(
            (k + 1) * 1_000_003 * b for k, b in enumerate(str(v).encode())) for v in values], np.uint64)
        return (mix(raw) % np.uint64(width)).astype(int)

    rows = np.arange(len(source))
    out = np.zeros((len(source), META_WIDTH), np.float32)
    out[rows, cell(source, SOURCES)] = 1
    out[rows, SOURCES + cell(lang, LANGS)] = 1
    size = np.array([0 if v is None else max(0, v) for v in n_chars], float)
    out[rows, SOURCES + LANGS + np.minimum(LENGTHS - 1, np.log2(1 + size) / 1.5).astype(int)] = 1
    out[:, -1] = 1
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 12) -> np.ndarray:
    """Newton's method with a ridge, which the last column (the constant) is spared."""
    x = x.astype(np.float64)
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 10 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    """Weights of the views, their calibration (slope, shift) and the combination."""

    text: np.ndarray | None = None
    meta: np.ndarray | None = None
    platt: list[np.ndarray] = field(default_factory=list)
    joint: np.ndarray | None = None
    constant: float = 1.0
    given: int = 0  # pseudo-labels exchanged

    def scores(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None:
            flat = np.full(len(xt), self.constant)
            return flat, flat, flat
        views = [a * (x @ w) + b for x, w, (a, b) in
                 zip((xt.astype(np.float64), xm.astype(np.float64)), (self.text, self.meta), self.platt)]
        both = self.joint[0] * views[0] + self.joint[1] * views[1] + self.joint[2]
        return sigmoid(views[0]), sigmoid(views[1]), sigmoid(both)


CELLS = 4096  # of confident scores, by log odds up to 40


def _cells(z: np.ndarray, confidence: float) -> np.ndarray:
    """Cell of the sureness of log odds, 0 below ``confidence``; larger is surer."""
    least = np.log(confidence / (1 - confidence))
    at = 1 + ((np.minimum(np.abs(z), 40) - least) / (40 - least) * (CELLS - 2)).astype(int)
    return np.where(np.abs(z) >= least, at, 0)


def _cut(counts: np.ndarray, n: int) -> tuple[int, float]:
    """The cell from which ``n`` are the surest, and the share of it that is taken."""
    above = np.cumsum(counts[::-1])[::-1]  # in this cell and surer
    cell = int(np.flatnonzero(above > n).max(initial=0))
    if cell == 0:
        return 0, 0.0
    return cell, (n - (above[cell] - counts[cell])) / counts[cell]


def _given(x: tuple[np.ndarray, np.ndarray], key: np.ndarray, history: list, confidence: float) -> np.ndarray:
    """Per row the round, giving view and label of its pseudo-label; round -1 for none.

    ``history`` has per round the weights of both views and the cuts by view and label.  A
    row is given once; of two views that want it in one round the text view is first.
    """
    out = np.full((len(key), 3), -1)
    for r, (w, cuts) in enumerate(history):
        chance = (mix(key.view(np.uint64) ^ mix(np.array([r + 1], np.uint64)))) / 2.0 ** 64
        for k in (0, 1):
            z = x[k] @ w[k]
            cell = _cells(z, confidence)
            for label in (1, 0):
                at, share = cuts[k][label]
                take = (out[:, 0] < 0) & (cell > 0) & ((z > 0) == bool(label)) & (
                    (cell > at) | ((cell == at) & (chance < share)))
                out[take] = r, k, label
    return out


ROWS = 1024  # of which a worker holds features and their products at once


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``ROWS``, so that matrices do not grow with Arrow's batches."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def _matrices(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(b"".join(batch.column(c).to_pylist()), np.float32).reshape(-1, n)
                 .astype(np.float64) for c, n in (("xt", TEXT_WIDTH), ("xm", META_WIDTH)))


def _slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hessian and, as the last column, gradient of the log loss."""
    p = sigmoid(x @ w)
    return np.column_stack([(x * (p * (1 - p))[:, None]).T @ x, x.T @ (p - y)])


def _refit(given: list[DataFrame], view: list, w: list[np.ndarray], steps: int = 12) -> list[np.ndarray]:
    """Newton's method from ``w`` on the labelled rows of ``view`` and all rows given to it."""
    rows = given[0]
    for g in given[1:]:
        rows = rows.unionByName(g)
    w = [v.copy() for v in w]

    def sums(batches: Iterator[pa.RecordBatch], at: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(v), len(v) + 1)) for v in at]
        for batch in _parts(batches):
            x, y = _matrices(batch), batch.column("label").to_numpy().astype(float)
            to = 1 - batch.column("by").to_numpy()
            for k in (0, 1):
                if (to == k).any():
                    total[k] += _slopes(x[k][to == k], y[to == k], at[k])
        for k in (0, 1):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * len(total[k]), pa.int32()), pa.array(range(len(total[k])), pa.int32()),
                 pa.array([r.tobytes() for r in total[k]], pa.binary())], names=["view", "i", "v"])

    def add(t: pa.Table) -> pa.Table:
        v = np.sum([np.frombuffer(b) for b in t.column("v").to_pylist()], axis=0)
        return pa.table({"view": t.column("view")[:1], "i": t.column("i")[:1], "v": pa.array([v.tobytes()], pa.binary())})

    schema = "view int, i int, v binary"
    for _ in range(steps):
        now = [v.copy() for v in w]
        found = rows.mapInArrow(lambda b, now=now: sums(b, now), schema) \
            .groupBy("view", "i").applyInArrow(add, schema).toArrow().sort_by([("view", "ascending"), ("i", "ascending")])
        most = 0.0
        for k in (0, 1):
            of = found.filter(pa.array(found.column("view").to_numpy() == k)).column("v").to_pylist()
            total = _slopes(view[k].astype(np.float64), view[2], w[k])
            if of:
                total += np.array([np.frombuffer(b) for b in of])
            ridge = np.full(len(w[k]), 1.0)
            ridge[-1] = 1e-3
            step = np.linalg.solve(total[:, :-1] + np.diag(ridge), total[:, -1] + ridge * w[k])
            size = np.abs(step).max()
            w[k] -= step * min(1.0, 10 / max(1e-9, size))
            most = max(most, size)
        if most < 1e-3:  # the next step would be about its square
            break
    return w


def co_train(
    xt: np.ndarray, xm: np.ndarray, y: np.ndarray, pool: DataFrame,
    aside: np.ndarray, rounds: int = 5, share: float = 0.02, confidence: float = 0.9,
) -> Model:
    """Fit on the rows not ``aside``, exchange pseudo-labels over the pool, calibrate on ``aside``.

    Per round each view gives the other about ``share`` of the pool (key, xt, xm), split by its
    own prior, of the rows on which it is surest, if at least ``confidence`` sure; of a cell of
    equal scores a part is drawn by a hash.  Without both classes on either side the model is a
    constant: the share of good labels, 1 without labels.
    """
    fit = ~aside
    if min(len(set(y[fit])), len(set(y[aside]))) < 2:
        return Model(constant=float(y.mean()) if len(y) else 1.0)
    view = [xt[fit], xm[fit], y[fit].astype(float)]
    prior = float(y[fit].mean())
    w = [fit_logistic(view[k], view[2]) for k in (0, 1)]
    pool = store(pool, "pool")
    many = int(pool.count() * share)
    history: list = []
    given: list[DataFrame] = []
    total = 0

    def count(batches: Iterator[pa.RecordBatch], past: list, now: list) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, 2, CELLS), np.int64)
        for batch in _parts(batches):
            x = _matrices(batch)
            free = _given(x, batch.column("key").to_numpy(), past, confidence)[:, 0] < 0
            for k in (0, 1):
                z = x[k][free] @ now[k]
                out[k] += np.bincount((z > 0) * CELLS + _cells(z, confidence), minlength=2 * CELLS).reshape(2, CELLS)
        k, label, cell = np.nonzero(out)
        yield pa.RecordBatch.from_arrays(
            [pa.array(k.astype(np.int32)), pa.array(label.astype(np.int32)), pa.array(cell.astype(np.int32)),
             pa.array(out[k, label, cell])], names=["view", "label", "cell", "n"])

    def take(batches: Iterator[pa.RecordBatch], past: list) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            g = _given(_matrices(batch), batch.column("key").to_numpy(), past, confidence)
            new = pa.array(g[:, 0] == len(past) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(g[:, 1].astype(np.int32)), pa.array(g[:, 2].astype(np.int32)),
                 batch.column("xt"), batch.column("xm")], names=["by", "label", "xt", "xm"]).filter(new)

    for _ in range(rounds):
        past, now = list(history), [v.copy() for v in w]
        counts = np.zeros((2, 2, CELLS), np.int64)
        for r in pool.mapInArrow(lambda b, past=past, now=now: count(b, past, now),
                                 "view int, label int, cell int, n long") \
                .groupBy("view", "label", "cell").agg(F.sum("n").alias("n")).collect():
            counts[r["view"], r["label"], r["cell"]] = r["n"]
        counts[:, :, 0] = 0
        good = round(many * prior)
        history.append((now, [{label: _cut(counts[k, label], n) for label, n in ((1, good), (0, many - good))}
                              for k in (0, 1)]))
        past = list(history)
        new = store(pool.mapInArrow(lambda b, past=past: take(b, past), "by int, label int, xt binary, xm binary"),
                    "given")
        given.append(new)
        n = new.count()
        total += n
        if not n:
            break
        w = _refit(given, view, w)
    release(pool, *given)
    target = y[aside].astype(float)
    raw = [xt[aside] @ w[0], xm[aside] @ w[1]]
    platt = [fit_logistic(np.column_stack([r, np.ones(len(r))]), target, 1e-2) for r in raw]
    logits = np.column_stack([a * r + b for r, (a, b) in zip(raw, platt)] + [np.ones(len(target))])
    return Model(w[0], w[1], platt, fit_logistic(logits, target, 1.0), given=total)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        xt = text_features(batch.column("text").to_pylist())
        xm = meta_features(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("quality"), batch.column("key"),
             pa.array([r.tobytes() for r in xt], pa.binary()),
             pa.array([r.tobytes() for r in xm], pa.binary())],
            names=["doc_id", "quality", "key", "xt", "xm"])


def _view(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"),
                       F.col("source").cast("string").alias("source"),
                       F.col("lang").cast("string").alias("lang"),
                       F.col("n_chars").cast("long").alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000, rounds: int = 5) -> Model:
    """Fit on the first labelled ids by hash; all other documents take part in the exchange.

    Labels beyond ``max_labelled`` are not used, their documents are like unlabelled ones.
    ``labels``: doc_id, quality (0/1).  Of several labels of an id the lowest counts; null ids
    and null labels are left out.  Every fourth labelled document is kept aside.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min(F.col("quality").cast("int")).alias("quality"))
    first = F.xxhash64("doc_id")
    ids = docs.select("doc_id").where("doc_id is not null")
    some = ids.join(known, "doc_id").select("doc_id", "quality").orderBy(first, "doc_id").limit(max_labelled)
    # At most max_labelled ids and labels: a proven bound for a broadcast.
    chosen = F.broadcast(some.dropDuplicates(["doc_id"]))
    schema = "doc_id long, quality int, key long, xt binary, xm binary"
    key = F.xxhash64("doc_id", "text").alias("key")
    rows = _view(docs).join(chosen, "doc_id").select("*", key).mapInArrow(_features, schema).toArrow().sort_by("doc_id")
    y = np.array(rows.column("quality").to_pylist(), int)

    def matrix(name: str, width: int) -> np.ndarray:
        return np.frombuffer(b"".join(rows.column(name).to_pylist()), np.float32).reshape(-1, width)

    xt, xm = matrix("xt", TEXT_WIDTH), matrix("xm", META_WIDTH)
    place = mix(np.array(rows.column("doc_id").to_pylist(), np.int64).view(np.uint64)) % np.uint64(4)
    pool = _view(docs).join(chosen.select("doc_id"), "doc_id", "left_anti") \
        .select("*", F.lit(None).cast("int").alias("quality"), key).mapInArrow(_features, schema)
    return co_train(xt, xm, y, pool.select("key", "xt", "xm"), place == 0, rounds)


def score_quality(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """All columns of ``docs`` plus text_score, meta_score, score (0 to 1) and keep.

    A null text is empty, a null source, language or length is a value of its own.  Rows and
    repeated rows are scored each on its own; columns of these names are replaced.
    """
    names = ["text_score", "meta_score", "score", "keep"]
    schema = [f for f in docs.schema.fields if f.name not in names]
    own = docs.select(*[F.col(f"`{f.name}`") for f in schema])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            xt = text_features(batch.column("text").to_pylist())
            xm = meta_features(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")))
            t, m, s = shared.value.scores(xt, xm)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *map(pa.array, (t, m, s, s >= threshold))],
                names=[*batch.schema.names, *names])

    scores = [T.StructField(n, T.DoubleType()) for n in names[:3]]
    return own.mapInArrow(apply, T.StructType([*own.schema.fields, *scores,
                                               T.StructField("keep", T.BooleanType())]))
