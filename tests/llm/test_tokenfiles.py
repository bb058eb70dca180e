"""Flat token files: ids as the library gives them, order, offsets, windows."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trialframe.llm import tokenfiles

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def own():
    return Tokenizer.from_file(WORD)


def test_words_give_the_ids_of_the_whole_text(own):
    rng = random.Random(3)
    bits = ["a", "B", "é", "e\u0301", "\u0301", "İ", "ß", "Σ", "'s", "'LL", "don't", "12", "٣", "漢字", "한", "\u1100\u1161",
            " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\u200d", "🙂", "!?", "--",
            "<|endoftext|>", "<|startoftext|>", "<|", "<|EndOfText|>", "<|startoftext|", "\u0338", "=", "'", "a'", "_", "~", "\x7f", "\x00", "\x01", "</w>", "ﬁ", "\u2126"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    code = tokenfiles.Encoder(WORD)
    assert code.in_parts and code.dtype == np.dtype("<u2")
    want = [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u2").tolist() for x in code.encode(texts)] == want
    plain = [t.replace("<|", "") for t in texts]
    want = [own.encode(t, add_special_tokens=False).ids for t in plain]
    again = tokenfiles.Encoder(WORD)
    assert [np.frombuffer(x, "<u2").tolist() for i in range(0, 3000, 7) for x in again.encode(plain[i:i + 7])] == want
    assert max(map(len, code.young)) <= tokenfiles.LONG_PART
    plain = tokenfiles.Encoder(BYTE, 70_000)
    assert not plain.in_parts and plain.dtype == np.dtype("<u4")


def test_memory_of_words_is_bounded(own, monkeypatch):
    monkeypatch.setattr(tokenfiles, "MEMORY", 5)
    code = tokenfiles.Encoder(WORD)
    for text in ("a b c d", "e f g", "a h i j k l m n o", "a b"):
        got = np.frombuffer(code.encode([text])[0], "<u2").tolist()
        assert got == own.encode(text, add_special_tokens=False).ids
        assert len(code.young) <= 5 and len(code.old) <= 12


def test_every_document_comes_back(spark, sf, own, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    folder = tokenfiles.write_tokens(docs, WORD, str(tmp_path / "t"), bytes_per_file=1 << 14)
    got = {r.doc_id: r for r in tokenfiles.token_report(spark, folder).collect()}
    files, place = tokenfiles.TokenFiles(folder), 0
    assert len(files) == len(got) == docs.count() and len(files.bases) > 8
    flat = []
    for i, r in enumerate(sorted(docs.collect(), key=lambda r: r.doc_id)):
        ids = [*own.encode(r.text or "", add_special_tokens=False).ids, 1]
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (
            place, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        name, mapped = files.document(i)
        assert name == r.doc_id and isinstance(mapped, np.memmap) and mapped.tolist() == ids
        flat += ids
        place += len(ids)
    assert files.n_ids == place
    for start, n in ((0, 10), (place - 5, 100), (place // 2, 9000), (place, 3), (7, 0), (0, place)):
        assert files.window(start, n).tolist() == flat[start:start + n]
    rows = tokenfiles.read_tokens(spark, folder).orderBy("start").collect()
    assert [i for r in rows for i in r.ids] == flat
    with pytest.raises(IndexError):
        files.document(len(files))


def test_edges(spark, own, tmp_path):
    long = "word " * 300_000
    rows = [(5, "b", 1), (None, "x y", 2), (5, "b", 3), (3, None, 4), (3, "", 5), (None, None, 6), (-9, long, 7),
            (5, "a longer one", 8), (2**62, "<|endoftext|>", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").selectExpr(
        "*", "'x' as part", "1 as start", "2 as length", "3 as hash")
    folder = tokenfiles.write_tokens(docs, WORD, f"file://{tmp_path}/e")
    got = tokenfiles.read_tokens(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -9, 3, 3, 5, 5, 5, 2**62]
    word = own.encode("word").ids
    texts = [own.encode(t, add_special_tokens=False).ids + [1] for t in ("", "x y")]
    assert [r.ids for r in got[:2]] == texts and got[2].ids == word * 300_000 + [1]
    assert [r.ids for r in got[3:5]] == [[1], [1]] and got[5].ids == got[6].ids and got[8].ids == [49407, 1]
    assert [r.start for r in got] == np.concatenate(([0], np.cumsum([len(r.ids) for r in got])[:-1])).tolist()
    empty = tokenfiles.write_tokens(docs.limit(0), WORD, str(tmp_path / "z"))
    assert tokenfiles.token_report(spark, empty).count() == 0 and len(tokenfiles.TokenFiles(empty)) == 0
    assert tokenfiles.TokenFiles(empty).window(0, 5).tolist() == []
    with pytest.raises(ValueError, match="mounted"):
        tokenfiles.write_tokens(docs, WORD, "s3a://bucket/x")


def test_other_tokenizers_are_run_on_whole_texts(spark, tmp_path):
    texts = ["Hello  world", " a\n\nb ", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = tokenfiles.write_tokens(docs, BYTE, str(tmp_path / "b"), end_id=50256)
    own = Tokenizer.from_file(BYTE)
    got = tokenfiles.read_tokens(spark, folder).orderBy("doc_id").collect()
    assert [r.ids for r in got] == [own.encode(t or "", add_special_tokens=False).ids + [50256] for t in texts]
