"""Language identification by interpolated Kneser-Ney character models.

Grams of the highest order are counted over all learning texts; lower orders count the distinct
grams that continue them.  Counts are summed in Spark.  A gram's key is the gram itself, its
UTF-16 units packed into 64 bits, so no two grams share an entry and the model grows with the
distinct grams of what it learns from; keys lie in sorted arrays, with the log probabilities of
all languages side by side.  A text gets the language of the lowest cross-entropy per gram; a logistic temperature
and a per-language bound for rejection are calibrated over the learning texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.llm.common import BLOCK, chunks, store

#: Bits per character class in a packed gram: a UTF-16 unit.  64 bits hold four.
CLASS = 16
#: Classes that probability is kept for if fewer are seen.
CLASSES = 4096
UNKNOWN = "und"

_tables: dict[str, np.ndarray] = {}


def _class_table() -> np.ndarray:
    """Of every code point 0 for what is no letter, else its lower-case form."""
    if "class" not in _tables:
        out = np.zeros(0x110000, np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                out[cp] = ord(c.lower()[0])
        _tables["class"] = out
    return _tables["class"]


def packed_grams(texts: list[str | None], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(grams, index of the text, number of texts in this range) in bounded pieces.

    Letters are lower-cased, every run of other characters is one blank, and blanks stand before
    and after a text.  A gram packs its ``order`` classes, the last in the low bits.  A letter
    beyond 16 bits is two classes, its UTF-16 surrogates, which no other letter has.
    """
    table = _class_table()
    for i, j in chunks(texts):
        whole = " ".join(["", *(t or "" for t in texts[i:j]), ""])
        starts = np.cumsum([1, *(len(t or "") + 1 for t in texts[i:j])])
        tail, before = np.zeros(max(0, order - 2), np.uint64), True
        tail_doc = np.full(len(tail), -1, np.int64)
        for at in range(0, len(whole), BLOCK):
            points = np.frombuffer(whole[at:at + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)
            cls = table[points].astype(np.uint64)
            blank = cls == 0
            keep = ~(blank & np.concatenate(([before and at > 0], blank[:-1])))
            before = bool(blank[-1])
            doc, cls = np.searchsorted(starts, np.flatnonzero(keep) + at, "right") - 1, cls[keep]
            wide = cls >> np.uint64(16) > 0
            if wide.any():
                times = 1 + wide
                place, rest = (np.cumsum(times) - times)[wide], cls[wide] - np.uint64(0x10000)
                cls, doc = np.repeat(cls, times), np.repeat(doc, times)
                cls[place] = np.uint64(0xD800) + (rest >> np.uint64(10))
                cls[place + 1] = np.uint64(0xDC00) + (rest & np.uint64(0x3FF))
            cls, doc = np.concatenate([tail, cls]), np.concatenate([tail_doc, doc])
            m = len(cls) - order + 1
            if m > 0:
                gram = np.zeros(m, np.uint64)
                for k in range(order):
                    gram = (gram << np.uint64(CLASS)) | cls[k:k + m]
                last = doc[order - 1:]
                own = (last >= 0) & (last < j - i)
                # A gram that reaches into the text before stands for its blank-padded start.
                for k in range(1, order):
                    foreign = doc[order - 1 - k:order - 1 - k + m] != last
                    gram[foreign] &= np.uint64((1 << (CLASS * k)) - 1)
                yield gram[own], last[own] + i, j
            tail, tail_doc = cls[len(cls) - order + 1:], doc[len(cls) - order + 1:]


def _count(batches: Iterator[pa.RecordBatch], order: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) summed per task; a language is passed on when it has ``limit`` grams."""
    held: dict[str, list] = {}

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in parts])
        values, back = np.unique(keys, return_inverse=True)
        return values, np.bincount(back, np.concatenate([c for _, c in parts])).astype(np.int64)

    def out(lang: str, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 1 << 16):
            part = keys[i:i + (1 << 16)].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(part)), pa.array(part), pa.array(n[i:i + (1 << 16)])],
                names=["lang", "gram", "n"])

    for batch in batches:
        texts = np.array(batch.column("text").to_pylist(), object)
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            for gram, _, _ in packed_grams(list(texts[langs == lang]), order):
                parts = held.setdefault(lang, [])
                parts.append(np.unique(gram, return_counts=True))
                if sum(len(k) for k, _ in parts) > limit:
                    keys, n = merged(parts)
                    held[lang] = [(keys, n)]
                    if len(keys) > limit // 2:
                        yield from out(lang, keys, n)
                        held[lang] = []
    for lang, parts in held.items():
        if parts:
            yield from out(lang, *merged(parts))


class Model:
    """Sorted arrays of grams per order: log probabilities of seen grams, log back-off weights."""

    def __init__(self, langs: list[str], order: int):
        self.langs, self.order = langs, order
        self.keys: dict[int, np.ndarray] = {}
        self.logp: dict[int, np.ndarray] = {}
        self.contexts: dict[int, np.ndarray] = {}
        self.backoff: dict[int, np.ndarray] = {}
        self.floor = np.zeros(len(langs), np.float32)

    def lookup(self, gram: np.ndarray, k: int | None = None) -> np.ndarray:
        """Log probability of the last character of each gram under every language."""
        k = self.order if k is None else k
        if k == 0:
            return np.broadcast_to(self.floor, (len(gram), len(self.langs)))
        at = np.minimum(np.searchsorted(self.keys[k], gram), max(0, len(self.keys[k]) - 1))
        seen = self.keys[k][at] == gram if len(self.keys[k]) else np.zeros(len(gram), bool)
        out = self.logp[k][at] if len(self.keys[k]) else np.zeros((len(gram), len(self.langs)), np.float32)
        if not seen.all():
            rest = gram[~seen]
            low = self.lookup(rest & np.uint64((1 << (CLASS * (k - 1))) - 1), k - 1).copy()
            if len(self.contexts[k]):
                key = rest >> np.uint64(CLASS)
                at = np.minimum(np.searchsorted(self.contexts[k], key), len(self.contexts[k]) - 1)
                hit = self.contexts[k][at] == key
                low[hit] += self.backoff[k][at[hit]]
            out[~seen] = low
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean negative log probability per gram and language, and the number of grams."""
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for gram, doc, _ in packed_grams(texts, self.order):
            if len(gram):
                edge = np.flatnonzero(np.diff(doc, prepend=-1))
                total[doc[edge]] -= np.add.reduceat(self.lookup(gram), edge, axis=0, dtype=np.float64)
                n[doc[edge]] += np.diff(edge, append=len(doc))
        return total / np.maximum(1, n)[:, None], n


def learn(texts: DataFrame, order: int = 4) -> Model:
    """A model of ``texts`` (lang, text); rows with a null in either are left out.

    The driver receives the counts by gram: a row per distinct gram and order with one count per
    language, never the texts.
    """
    if not 1 <= order <= 64 // CLASS:
        raise ValueError(f"order must be 1 to {64 // CLASS}")
    spark = texts.sparkSession
    raw = texts.where("lang is not null and text is not null").select("lang", "text").mapInArrow(
        lambda b: _count(b, order), "lang string, gram long, n long")
    grams = store(raw.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    langs = [r[0] for r in grams.select("lang").distinct().orderBy("lang").collect()]
    model = Model(langs, order)
    if not langs:
        return model
    levels, level = {order: grams}, grams
    for k in range(order - 1, 0, -1):
        low = F.col("gram").bitwiseAND(F.lit((1 << (CLASS * k)) - 1))
        level = level.groupBy("lang", low.alias("gram")).agg(F.count("*").alias("n"))
        levels[k] = level
    spark_langs = [F.lit(x) for x in langs]
    below_keys: np.ndarray | None = None
    for k in range(1, order + 1):
        sums = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}")
                for i, x in enumerate(spark_langs)]
        rows = levels[k].groupBy("gram").agg(*sums).toArrow()
        gram = rows.column("gram").to_numpy().view(np.uint64)
        by_gram = np.argsort(gram)
        gram = gram[by_gram]
        n = np.column_stack([rows.column(f"n{i}").to_numpy()[by_gram] for i in range(len(langs))]).astype(float)
        contexts, of = np.unique(gram >> np.uint64(CLASS), return_inverse=True)
        once, twice = (n == 1).sum(0), (n == 2).sum(0)
        discount = np.where(once > 0, once / np.maximum(1, once + 2 * twice), 0.5).clip(0.1, 0.95)
        mass, kinds = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
        np.add.at(mass, of, n)
        np.add.at(kinds, of, n > 0)
        weight = np.where(mass > 0, discount * kinds / np.maximum(1, mass), 1.0)
        if below_keys is None:
            probs = np.full((1, len(langs)), 1.0 / max(CLASSES, len(gram) + 1))
            model.floor = np.log(probs[0]).astype(np.float32)
            low = np.repeat(probs, len(gram), 0)
        else:
            low_key = gram & np.uint64((1 << (CLASS * (k - 1))) - 1)
            low = probs[np.searchsorted(below_keys, low_key)]
        probs = np.maximum(n - discount, 0) / np.maximum(1, mass[of]) + weight[of] * low
        below_keys = gram
        model.keys[k], model.logp[k] = below_keys, np.log(np.maximum(probs, 1e-30)).astype(np.float32)
        model.contexts[k], model.backoff[k] = contexts, np.log(weight).astype(np.float32)
    return model


BETAS = [2.0 ** (i / 2) for i in range(-6, 18)]


def identify(docs: DataFrame, learnable: Column, order: int = 4, spread: float = 4.0) -> DataFrame:
    """doc_id, lang, text columns' verdicts: doc_id, learned, lang_pred, score, entropy, accepted.

    ``learnable`` marks the rows of ``docs`` (doc_id, text, lang) whose text and language may be
    learned from.  ``score`` is the calibrated probability of the predicted language against the
    others; ``accepted`` is false for texts whose entropy is more than ``spread`` deviations
    above what is usual for that language, or for ``und``.  Texts that are null or have no
    letter are ``und`` with score 0; so is everything if there is nothing to learn from.  Ties
    go to the first language by name.  Rows are scored each on its own, whole texts, without a
    shuffle; a table of the scores is stored once, and calibration reads sums of it.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"),
                       F.coalesce(learnable, F.lit(False)).alias("learned"))
    model = learn(rows.where("learned"), order)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            h, n = m.entropies(texts) if m.langs else (np.zeros((len(texts), 1)), np.zeros(len(texts)))
            letters = np.array([bool(m.langs) and t is not None and any(map(str.isalpha, t)) for t in texts])
            best = h.argmin(1)
            # A difference of mean entropies, times the root of the length, is what is calibrated.
            gap = (h - h.min(1, keepdims=True)) * np.sqrt(np.maximum(1, n))[:, None]
            names = [m.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
            gaps = [sorted(g)[1:] for g in gap.tolist()]
            own = [None if (not ok or x not in m.langs) else g[m.langs.index(x)] for ok, x, g in
                   zip(letters, batch.column("lang").to_pylist(), gap.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("learned"), pa.array(names),
                 pa.array(h.min(1)), pa.array(gaps, pa.list_(pa.float64())), pa.array(own, pa.float64())],
                names=["doc_id", "learned", "lang_pred", "entropy", "gaps", "own_gap"])

    scored = store(rows.select("doc_id", "text", "learned", F.when(F.col("learned"), F.col("lang"))
                               .alias("lang")).mapInArrow(
        apply, "doc_id long, learned boolean, lang_pred string, entropy double, "
        "gaps array<double>, own_gap double"), "langid")
    known = scored.where("learned and own_gap is not null")

    def odds(beta: float) -> Column:
        return F.aggregate("gaps", F.lit(1.0), lambda s, g: s + F.exp(-beta * g))

    losses = known.agg(*[F.avg(beta * F.col("own_gap") + F.log(odds(beta))).alias(f"l{i}")
                         for i, beta in enumerate(BETAS)]).first()
    beta = min((x, b) for x, b in zip(losses, BETAS))[1] if losses[0] is not None else 1.0
    usual = {r["lang_pred"]: r["m"] + spread * (r["s"] or 0.0) for r in known.where("own_gap = 0")
             .groupBy("lang_pred").agg(F.avg("entropy").alias("m"), F.stddev("entropy").alias("s")).collect()}
    bound = F.lit(None).cast("double")
    for name, value in usual.items():
        bound = F.when(F.col("lang_pred") == name, F.lit(float(value))).otherwise(bound)
    sure = F.col("lang_pred") != UNKNOWN
    return scored.select(
        "doc_id", "learned", "lang_pred",
        F.when(sure, 1.0 / odds(beta)).otherwise(0.0).alias("score"),
        F.when(sure, F.col("entropy")).alias("entropy"),
        F.coalesce(sure & (F.col("entropy") <= bound), F.lit(False)).alias("accepted"))
