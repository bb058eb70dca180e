"""Shared helpers: intermediate tables in the shared folder, bounded batches, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Whitespace bytes of the word pattern ``[^\x20\x09-\x0D]+``.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step works on.
BLOCK = 1 << 20
#: Bytes of text that words are hashed of at once: the arrays of a step stay in a core's cache.
CUT = 1 << 16

_local: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on one machine without it, a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local:
        _local[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="trialframe-llm-")
    return _local[sc.applicationId]


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def store(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, computes once.

    A lost executor costs only tasks of the running stage, since the files are shared.  The
    shuffle files of the write are given back when it ends.  ``batch_rows`` bounds the rows that go to
    a Python worker at a time, for long texts or lists.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before, rows = spark.conf.get(CLEANUP, "false"), spark.conf.get(BATCH_ROWS)
    spark.conf.set(CLEANUP, "true")
    if batch_rows and not 0 < int(rows) <= batch_rows:
        spark.conf.set(BATCH_ROWS, str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
        spark.conf.set(BATCH_ROWS, rows)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``store`` that no later step reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def chunks(texts: list, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``limit`` characters; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_VALUE_FOLDED = _VALUE[_FOLD]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


_pow = [_powers(_BASE, 1024), _powers(_INVERSE, 1024)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        size = 1 << (n - 1).bit_length()
        _pow[:] = [_powers(_BASE, size), _powers(_INVERSE, size)]
    return _pow[0], _pow[1]


def word_hashes(texts: Iterable[str | None], fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of several texts, and where each text's words begin.

    Words are ``[^\\x20\\x09-\\x0D]+``; ``fold`` lower-cases A-Z.  The bytes are hashed by a
    polynomial through prefix sums, block by block, so that memory follows the number of words.
    """
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(data) + 1, np.int64)
    offsets[1:] = np.cumsum([len(d) + 1 for d in data]) if data else []
    buffer = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    value = _VALUE_FOLDED if fold else _VALUE
    hashes, places = [], []
    start = 0
    while start < len(buffer):
        end = min(start + CUT, len(buffer))
        while end < len(buffer):  # cut at white space, so that no word is torn
            blank = np.flatnonzero(_IS_SPACE[buffer[max(start, end - 4096):end]])
            if len(blank):
                end = max(start, end - 4096) + int(blank[-1]) + 1
                break
            end = min(end + CUT, len(buffer))
        part = buffer[start:end]
        space = np.ones(len(part) + 2, bool)
        space[1:-1] = _IS_SPACE[part]
        edge = np.flatnonzero(space[1:] != space[:-1])
        s, e = edge[::2], edge[1::2]
        if len(s):
            power, inverse = _grown(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            terms = value[part]
            terms *= power[:len(part)]
            np.cumsum(terms, out=sums[1:])
            hashes.append(mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)))
            places.append(s + start)
        start = end
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    return words, np.searchsorted(place, offsets)


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values; for a few hundred of them sorting costs less than ``np.unique``."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of ``n`` words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    power = _grown(n)[0]
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out += words[i:i + m] * power[n - 1 - i]
    return mix(out)
