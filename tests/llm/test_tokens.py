from __future__ import annotations

import glob
import os
import zlib

import numpy as np
import pytest

from scriptorium.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "Hello  world!\n\nÉté it's 12ab  \t x", "a!!! !", "<|endoftext|> a", "x\x1cy\x85z", "naïve café " * 3000, "!", "tail \n "]


def test_round_trip_against_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    df = spark.createDataFrame([(7 * i % 10, x, "y") for i, x in enumerate(TEXTS)] + [(3, "again", "y")], "doc_id long, text string, start string")
    rows = tokens.encode_corpus(df, PATH, str(tmp_path / "t"), files=3).collect()
    want = sorted((7 * i % 10, x) for i, x in enumerate([x or "" for x in TEXTS]))
    at = 0
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([d for d, _ in want] + [3])
    texts = {d: [x] for d, x in want}
    texts[3].append("again")
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        options = {zlib.crc32(np.array(t.encode(x, add_special_tokens=False).ids + [0], "<u4").tobytes()) for x in texts[r.doc_id]}
        assert r.ids_crc32 in options
    names = [os.path.basename(f) for f in glob.glob(str(tmp_path / "t" / "kind=ids" / "part-*"))]
    assert len(names) == 3 and {r.file for r in rows} == set(names)
    for name in names:
        ids, offsets, docs, _ = tokens.open_range(str(tmp_path / "t"), name)
        assert ids.dtype == np.uint16 and os.path.getsize(tmp_path / "t" / "kind=ids" / name) == 2 * len(ids)
        assert os.path.getsize(tmp_path / "t" / "kind=offsets" / name) == 8 * len(offsets)
        assert offsets[-1] == len(ids) and len(docs) + 1 == len(offsets)
        assert all(ids[int(o) - 1] == 0 for o in offsets[1:])


def test_files_that_only_spark_reads_give_the_same_index(spark, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.tokens.link./in", f"file://{tmp_path}")
    df = spark.createDataFrame([(i if i else None, x) for i, x in enumerate(TEXTS)], "doc_id long, text string")
    mapped = tokens.encode_corpus(df, PATH, str(tmp_path / "t"), files=4)
    sent = tokens.read_index(spark, "viewfs://tokens/in/t")
    key = lambda r: (r.start, r.doc_id, r.n_tokens, r.ids_crc32)
    assert sorted(map(key, sent.collect()), key=str) == sorted(map(key, mapped.collect()), key=str)
    assert min(mapped.collect(), key=lambda r: r.start).doc_id is None


def test_wide_ids_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "id_dtype", lambda path: "<u4")
    df = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "doc_id long, text string")
    wide = {r.doc_id: r.ids_crc32 for r in tokens.encode_corpus(df, PATH, str(tmp_path / "w"), files=2).collect()}
    monkeypatch.undo()
    assert wide == {r.doc_id: r.ids_crc32 for r in tokens.encode_corpus(df, PATH, str(tmp_path / "n"), files=3).collect()}


def test_long_texts_are_encoded_in_pieces(monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    monkeypatch.setattr(tokens, "_PIECE", 3000)
    monkeypatch.setattr(tokens, "_BLOCK", 1000)
    text = ("naïve  café\n\nit's, 12 " * 2000) + "x" * 20_000 + " " * 9000 + "end"
    assert np.frombuffer(tokens.ChunkEncoder(PATH, "<u2").encode([text, "a"])[0], "<u2").tolist() == t.encode(text, add_special_tokens=False).ids


def test_chunks_give_the_ids_of_whole_texts():
    import random

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    e = tokens.ChunkEncoder(PATH, "<u2")
    rng = random.Random(3)
    parts = ["a", "the", "É", "é", "ß", "'s", "'", "'ll", " ", "  ", "\n", "\t", ".", ",", "!", "*#", "12", "3", "_", "-", "\u00a0", "\u2003", "\u200b", "😀", "中文", "½", "²", "ª", "µ", "\x1d", "\u0301"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(8000)]
    for text, got, want in zip(texts, e.encode(texts), t.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(got, "<u2").tolist() == want.ids, repr(text)
    long = "".join(rng.choices(parts, k=600_000)).replace("\x1d", "")
    assert np.frombuffer(e.encode([long])[0], "<u2").tolist() == t.encode(long, add_special_tokens=False).ids


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.encode_corpus(df, PATH, str(tmp_path / "e"), files=2).collect() == []
