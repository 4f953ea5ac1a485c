import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strata.llm import packing as p

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def full():
    return tokenizers.Tokenizer.from_file(p.default_tokenizer())


def texts():
    rng = random.Random(1)
    fixed = [None, "", "  ", "a b", "é́ x", "a ́b", "A'S don't  we'll", "日本語 テスト　x", "Σίσυφος ΟΔΟΣ ", "x​y <|endoftext|>z", "a b\x85c", "İstanbul ŞŞ", "word###\nword...", "naïve, Ünï! x-y_z", "w" * 500, "word " * 5000]
    letters = " \t\n\x0b\x0c\ŕ abcABC'sStlLéΣß12,.!<|>endoftext_‍日🙂İ \x1c\x85"
    return fixed + ["".join(rng.choice(letters) for _ in range(40)) for _ in range(500)]


def test_ids_equal_whole_texts(full):
    tok = p.WordTokenizer(p.default_tokenizer())
    for part in (texts(), texts()[:3], [], ["plain words, only.", "More of them!"]):
        ids, counts = tok.ids(pa.array(part, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])][: len(part)] == [full.encode(t or "", add_special_tokens=False).ids for t in part]


def test_query(spark, full):
    rows = list(enumerate(texts())) + [(5, texts()[5])]
    out = p.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    ids = {i: full.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
        own = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(own) == r["length"] and zlib.crc32(own.tobytes()) == r["ids_crc32"]
    for i, pieces in by_doc.items():
        pieces = sorted(pieces, key=lambda r: r["piece"])
        if i != 5:
            assert [r["piece"] for r in pieces] == list(range(len(pieces))) and sum(r["length"] for r in pieces) == len(ids[i])
            assert all(r["length"] == 2048 for r in pieces[:-1])
    assert len(by_doc[5]) == 2
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    total = sum(r["length"] for r in out)
    assert len(by_seq) <= -(-total // 2048) + 2


def test_pack_is_near_the_least():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 2049, 3000), rng.integers(1, 700, 3000), rng.integers(1000, 1100, 200), np.array([2048, 1, 1]), np.full(50, 683), np.zeros(0, np.int64)):
        bins, offsets = p.pack(lengths)
        used = np.bincount(bins, lengths, int(bins.max(initial=-1)) + 1)
        assert (used <= 2048).all() and (used > 0).all()
        for b in range(min(len(used), 200)):
            own = np.flatnonzero(bins == b)
            own = own[np.argsort(offsets[own])]
            assert (offsets[own] == np.cumsum(lengths[own]) - lengths[own]).all()
            assert (3 * lengths[own] > 2048).sum() <= 2
        least = max(-(-int(lengths.sum()) // 2048), int((2 * lengths > 2048).sum()), -(-int((3 * lengths > 2048).sum()) // 2))
        assert len(used) <= 1.02 * least + 2


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(p, "SHARD", 50)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"))
    out = p.pack_documents(docs)
    assert out.count() == 400 and out.select("sequence_id").distinct().count() <= 16
    assert p.pack_documents(docs.where("false")).count() == 0
