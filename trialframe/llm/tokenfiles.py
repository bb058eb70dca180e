"""Token ids as flat unsigned integers in files that training jobs map into memory.

A folder holds, per part, ``<part>.ids`` (ids back to back, 16 bits each where the vocabulary
allows, else 32), ``<part>.docs`` (the doc_id of each document, 64 bits) and ``<part>.offsets``
(64 bits: the place of each document's first id in the whole corpus, and of the part's end);
``bases`` has one row of five 64-bit counts per part, and ``manifest.json``, written last, names
the width.  All numbers are little-endian.  Parts follow each other by ascending doc_id.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm.common import chunks, shared_folder

#: Cuts at blanks, which every tokenizer pattern knows; others stay inside a word.
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
#: Cuts also between an ASCII letter or digit and ASCII punctuation but for the apostrophe.
_N, _P = rb"[a-z0-9]+", rb"[!-&(-/:-@\[-`{-~]+"
_O = rb"[^\x20\x09-\x0Da-z0-9!-&(-/:-@\[-`{-~]+"
PARTS = re.compile(rb"(?:%s|%s|%s(?:%s|%s)?)(?:%s(?:%s|%s)?)*" % (_N, _P, _O, _N, _P, _O, _N, _P))
#: Parts of a generation that a worker remembers, and the longest of them in bytes.
MEMORY, LONG_PART = 1 << 18, 64

_encoders: dict[tuple[str, int], Encoder] = {}


def _cuts(spec: dict) -> bool:
    """Whether parts can be encoded one by one, after folding A-Z.

    The normaliser folds letters and works within runs of non-blanks; the pattern takes runs of
    letters, single digits, runs of other characters, or contractions.  No match then goes across
    a blank or from a letter or digit to punctuation, and none looks around itself.
    """
    def listed(x: dict | None, key: str) -> list[dict]:
        return [] if x is None else x[key] if x["type"] == "Sequence" else [x]

    normal = listed(spec.get("normalizer"), "normalizers")
    split = listed(spec.get("pre_tokenizer"), "pretokenizers")
    # Patterns made of literals without blanks and runs of letters, digits or other non-blanks.
    runs = re.compile(r"('\w+|\[\\p\{L\}\]\+?|\[\\p\{N\}\]\+?|\[\^\\s\\p\{L\}\\p\{N\}\]\+)"
                      r"(\|('\w+|\[\\p\{L\}\]\+?|\[\\p\{N\}\]\+?|\[\^\\s\\p\{L\}\\p\{N\}\]\+))*")
    return (
        any(n["type"] == "Lowercase" for n in normal)
        and all(n["type"] in ("NFC", "Lowercase") or (
            n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " ")
            for n in normal)
        and len(split) == 2 and split[0]["type"] == "Split" and split[0]["behavior"] == "Removed"
        and split[0]["invert"] and bool(runs.fullmatch(split[0]["pattern"].get("Regex", "")))
        and split[1]["type"] == "ByteLevel" and not split[1]["add_prefix_space"]
        and not split[1].get("use_regex", True) and spec.get("post_processor") is None
        and not spec.get("truncation") and not spec.get("padding")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])
                    for t in spec.get("added_tokens", []))
        and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        and not spec["model"].get("fuse_unk")
    )


class Encoder:
    """Texts to ids through the tokenizers library, as bytes of ``dtype``.

    Where the tokenizer's file allows it, each different part of the texts (a word, or a run of
    punctuation) is encoded once and remembered: a text's ids are those of its parts in order
    (tested against encoding the text as a whole).  Parts of ASCII letters go to the library's
    model, since nothing else would change them.  Otherwise every text is encoded as a whole.
    Parts are remembered in two generations; when the younger is full the older, not met since,
    is forgotten.
    """

    def __init__(self, path: str, top: int = 0):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.in_parts = _cuts(spec)
        self.special = [t["content"].lower().encode() for t in spec.get("added_tokens", [])]
        last = max([top, *self.own.get_vocab(with_added_tokens=True).values()])
        self.dtype = np.dtype("<u2" if last < 1 << 16 else "<u4")
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.own.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in found]

    def _learn(self, parts: set[bytes]) -> None:
        young, old, other = self.young, self.old, []
        tokenize, kind = self.own.model.tokenize, self.dtype.char
        for w in parts:
            if w in old:
                young[w] = old[w]
            elif w.isalpha() and w.islower():
                ids = [t.id for t in tokenize(w.decode())]
                young[w] = struct.pack(f"<{len(ids)}{kind}", *ids)
            else:
                other.append(w)
        young.update(zip(other, self._whole([w.decode("utf-8") for w in other])))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.in_parts:
            return self._whole([t or "" for t in texts])
        split = []
        for t in texts:
            data = (t or "").encode("utf-8")
            low = data.lower()
            plain = any(s in low for s in self.special)  # cut at blanks, unfolded
            split.append(WORDS.findall(data) if plain else PARTS.findall(low))
        new = set().union(*split) - self.young.keys()
        self._learn(new)
        out = [b"".join(map(self.young.__getitem__, parts)) for parts in split]
        for w in new:
            if len(w) > LONG_PART:
                del self.young[w]
        if len(self.young) > MEMORY:
            self.young, self.old = {}, self.young
        return out


def encoder(path: str, top: int = 0) -> Encoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, top) not in _encoders:
        _encoders[path, top] = Encoder(path, top)
    return _encoders[path, top]


def mounted(folder: str) -> str:
    """The path of a folder that driver and workers mount; other file systems can't be mapped."""
    name, colon, rest = folder.partition(":")
    if not colon or "/" in name:
        return folder
    if name != "file":
        raise ValueError(f"memory-mapped files need a mounted folder, not {folder}")
    return "/" + rest.lstrip("/")


class _Part:
    """Writes one part under temporary names and renames it when it is whole."""

    def __init__(self, folder: str, part: int):
        os.makedirs(folder, exist_ok=True)
        self.names = [f"{folder}/{part}.{kind}" for kind in ("ids", "docs", "lengths")]
        mark = uuid.uuid4().hex
        self.files = [open(f"{n}.{mark}", "wb") for n in self.names]

    def commit(self) -> None:
        for f, name in zip(self.files, self.names):
            f.flush()
            os.fsync(f.fileno())
            f.close()
            os.replace(f.name, name)


def _replace(path: str, data: bytes) -> None:
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 1,
                 bytes_per_file: int = 1 << 28) -> str:
    """Encode every whole text, append ``end_id`` and write the files; returns their folder.

    ``docs`` needs doc_id and text; other columns are ignored.  A null or empty text is its end id
    alone.  Documents are written by ascending doc_id, null ids first; rows with one id by the
    length and a hash of their text, so repeated rows stand together.  An empty table gives a
    folder without parts.  ``folder`` must be mounted by driver and workers; the default is a new
    one in ``spark.checkpoint.dir``.  ``bytes_per_file`` is the text aimed at per part.

    One pass reads the text's size, one shuffle by range orders the documents, and each task
    encodes and writes its part as a stream.  Only three counts per part come to the driver,
    where prefix sums turn them into bases; each part then gets its 64-bit offsets from its base.
    A task that runs twice writes the same bytes and renames them into place.
    """
    spark = docs.sparkSession
    where = mounted(folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}")
    os.makedirs(where, exist_ok=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 8).alias("n")).first()["n"] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bytes_per_file))
    ordered = (
        rows.select("doc_id", "text", F.coalesce(F.length("text"), F.lit(-1)).alias("length"),
                    F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
        .repartitionByRange(parts, "doc_id", "length", "hash", "place")
        .sortWithinPartitions("doc_id", "length", "hash", "place").select("doc_id", "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, code = TaskContext.get().partitionId(), encoder(tokenizer_path, end_id)
        end, width = np.array([end_id], code.dtype).tobytes(), code.dtype.itemsize
        out, counts = _Part(where, part), [0, 0, 0]
        ids, names, lengths = out.files
        for batch in batches:
            doc, texts = batch.column("doc_id"), batch.column("text")
            names.write(doc.fill_null(0).to_numpy().astype("<i8").tobytes())
            plain = texts.to_pylist()
            for i, j in chunks(plain):
                found = code.encode(plain[i:j])
                lengths.write(np.array([len(x) // width + 1 for x in found], "<i8").tobytes())
                for x in found:
                    ids.write(x)
                    ids.write(end)
                counts[2] += sum(len(x) // width + 1 for x in found)
            counts[0] += len(doc)
            counts[1] += doc.null_count
        out.commit()
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "docs", "nulls", "ids"), (part, *counts)))])

    found = sorted(tuple(r) for r in ordered.mapInArrow(
        write, "part long, docs long, nulls long, ids long").collect())
    table = np.zeros((len(found), 5), "<i8")  # docs, null ids, ids, first document, first id
    table[:, :3] = [r[1:] for r in found] if found else table[:, :3]
    table[1:, 3] = np.cumsum(table[:-1, 0])
    table[1:, 4] = np.cumsum(table[:-1, 2])
    _replace(f"{where}/bases", table.tobytes())

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases = np.fromfile(f"{where}/bases", "<i8").reshape(-1, 5)
        for batch in batches:
            for part in batch.column("id").to_pylist():
                own = np.zeros(bases[part, 0] + 1, "<u8")
                np.cumsum(np.fromfile(f"{where}/{part}.lengths", "<i8"), out=own[1:])
                _replace(f"{where}/{part}.offsets", (own + np.uint64(bases[part, 4])).tobytes())
            yield batch

    if [r[0] for r in found] != list(range(len(found))):
        raise RuntimeError(f"parts of {where} are missing")
    _over_parts(spark, len(found)).mapInArrow(index, "id long").count()
    _replace(f"{where}/manifest.json", json.dumps({
        "dtype": encoder(tokenizer_path, end_id).dtype.str, "end_id": end_id, "parts": len(found),
        "documents": int(table[:, 0].sum()), "ids": int(table[:, 2].sum()),
        "tokenizer": os.path.basename(tokenizer_path)}).encode())
    return where


def _over_parts(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(0, n, 1, max(1, min(n, 20_000)))


class TokenFiles:
    """Memory-mapped reading of a folder: single documents, or any window of the whole corpus."""

    def __init__(self, folder: str):
        self.folder = mounted(folder)
        self.manifest = json.loads(Path(f"{self.folder}/manifest.json").read_text())
        self.dtype = np.dtype(self.manifest["dtype"])
        self.bases = np.fromfile(f"{self.folder}/bases", "<i8").reshape(-1, 5)
        self._maps: dict[tuple[int, str], np.ndarray] = {}

    def __len__(self) -> int:
        return self.manifest["documents"]

    @property
    def n_ids(self) -> int:
        return self.manifest["ids"]

    def part(self, part: int, kind: str) -> np.ndarray:
        if (part, kind) not in self._maps:
            dtype = {"ids": self.dtype, "docs": "<i8", "offsets": "<u8"}[kind]
            path = f"{self.folder}/{part}.{kind}"
            self._maps[part, kind] = (
                np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype))
        return self._maps[part, kind]

    def document(self, i: int) -> tuple[int | None, np.ndarray]:
        """doc_id and ids of the i-th document in file order."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        part = int(np.searchsorted(self.bases[:, 3] + self.bases[:, 0], i, "right"))
        _, nulls, _, first, base = self.bases[part].tolist()
        offsets = self.part(part, "offsets")
        a, b = int(offsets[i - first]) - base, int(offsets[i - first + 1]) - base
        name = None if i - first < nulls else int(self.part(part, "docs")[i - first])
        return name, self.part(part, "ids")[a:b]

    def window(self, start: int, length: int) -> np.ndarray:
        """``length`` ids from place ``start`` of the corpus on, across parts; shorter at its end."""
        out, at, end = [], max(0, start), min(start + length, self.n_ids)
        while at < end:
            part = int(np.searchsorted(self.bases[:, 4] + self.bases[:, 2], at, "right"))
            base = int(self.bases[part, 4])
            out.append(self.part(part, "ids")[at - base:end - base])
            at += len(out[-1])
        return np.concatenate(out) if out else np.zeros(0, self.dtype)


def _read(spark: SparkSession, folder: str, ddl: str, last: pa.Field, value) -> DataFrame:
    """doc_id, start, n_tokens and ``value(ids)`` of every document, one task per part."""
    where = mounted(folder)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), last])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = TokenFiles(where)
        for batch in batches:
            for part in batch.column("id").to_pylist():
                ids, docs = files.part(part, "ids"), files.part(part, "docs")
                offsets = files.part(part, "offsets").astype(np.int64)
                nulls, base = int(files.bases[part, 1]), int(files.bases[part, 4])
                i = 0
                while i < len(docs):  # about a million ids, 8192 documents at most, a batch
                    j = int(np.searchsorted(offsets, offsets[i] + (1 << 20), "right")) - 1
                    j = min(max(j, i + 1), i + 8192, len(docs))
                    cut = offsets[i:j + 1] - base
                    found = [value(ids[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs[i:j], mask=np.arange(i, j) < nulls), pa.array(offsets[i:j]),
                         pa.array(np.diff(cut)), pa.array(found, last.type)], schema=schema)
                    i = j

    return _over_parts(spark, TokenFiles(where).manifest["parts"]).mapInArrow(
        documents, f"doc_id long, start long, n_tokens long, {ddl}")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (array<long>, the end id last) of every document."""
    return _read(spark, folder, "ids array<long>", pa.field("ids", pa.list_(pa.int64())),
                 lambda x: x.astype(np.int64))


def token_report(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32 bits) per document."""
    return _read(spark, folder, "ids_crc32 long", pa.field("ids_crc32", pa.int64()),
                 lambda x: zlib.crc32(x.astype("<u4").tobytes()))
