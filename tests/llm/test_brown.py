import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strata.llm import brown as b


def corpus():
    rng = random.Random(8)
    groups = [[f"{c}{i}" for i in range(12)] for c in "abc"]
    rows = []
    for i in range(300):
        words = [rng.choice(groups[k % 3]) if rng.random() < 0.95 else f"rare{rng.randrange(400)}" for k in range(rng.randrange(1, 60))]
        rows.append((i, " ".join(words).upper() if i % 5 == 0 else "\n".join(words)))
    return rows + [(1000, None), (1001, ""), (1002, "é É unseenword"), (3, rows[3][1]), (1003, "x" * 90 + " " + "x" * 90)]


def words(text):
    return (text or "").encode().lower().split()


@pytest.mark.parametrize("head", [1 << 18, 20])
def test_scores(spark, head, monkeypatch):
    monkeypatch.setattr(b.fit, "__defaults__", (head, 30, 4))
    rows = corpus()
    out = b.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in rows if not held(i) for w in [*words(t), "end"])
    n, v = sum(c.values()), len(c)
    text = dict(rows)
    assert len(out) == len(rows)
    for r in out:
        own = [*words(text[r["doc_id"]]), "end"]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(own), sum(c[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
    new = [r for r in out if r["held_out"]]
    if head > 20:
        assert sum(r["score"] for r in new) > sum(r["base_score"] for r in new) + 0.1 * sum(r["n_tokens"] for r in new)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").where("text is not null").select("text")
    counts = b.word_counts(docs)
    model = b.fit(docs, counts, 25, 20, 4)
    c = {r["word"].encode(): r["n"] for r in counts.collect()}
    of = {w: k for w, k in zip(model.words, model.classes, strict=True)}
    for before in range(len(model.gain)):
        total = sum((n + 0.5) / model.norm * 10 ** model.gain[before, of.get(w, model.rest)] for w, n in c.items())
        total += (model.ends + 0.5) / model.norm * 10 ** model.gain[before, model.end]
        total += 0.5 / model.norm * 10 ** model.gain[before, model.rest]  # all unknown words
        assert total == pytest.approx(1)


def mutual(pairs, of):
    n = of.max() + 1
    m = np.zeros((n, n))
    np.add.at(m, (of[:, None], of[None, :]), pairs)
    f = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()
    return f(m) - f(m.sum(axis=0)) - f(m.sum(axis=1))


def test_exchange_finds_classes():
    rng = np.random.default_rng(1)
    k, classes = 24, 3
    true = np.arange(k) // 8
    pairs = np.zeros((k + 2, k + 2))
    for _ in range(6000):
        a = rng.integers(k)
        pairs[a, rng.choice(np.flatnonzero(true == (true[a] + 1) % 3))] += 1
    of = b.exchange(pairs, classes, 20)
    assert all(len(set(of[:k][true == t])) == 1 for t in range(3)) and len(set(of[:k])) == 3
    best = mutual(pairs, of)
    for w in range(k):  # no single move is better
        for to in range(classes):
            moved = of.copy()
            moved[w] = to
            assert mutual(pairs, moved) <= best + 1e-6


def test_head_words(spark):
    counts = spark.createDataFrame([("a", 9), ("b", 5), ("c", 5), ("d", 1), ("e" * 40, 100)], "word string, n long")
    assert b.head_words(counts, 10) == [(b"a", 9), (b"b", 5), (b"c", 5), (b"d", 1)]
    assert b.head_words(counts, 2) == [(b"a", 9)] and b.head_words(counts, 0) == []
    assert b.head_words(counts.where("false"), 5) == []


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert b.score_documents(docs.where("false")).count() == 0
    alone = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = b.score_documents(docs.withColumn("doc_id", F.lit(alone))).head()  # nothing to learn from
    assert (r["n_known"], r["train_tokens"]) == (0, 0) and r["base_score"] == pytest.approx(0) and r["score"] == pytest.approx(0)


@pytest.mark.parametrize("head", [1 << 18, 30])
def test_every_word_has_a_class(spark, head):
    """Tail words of three kinds, held or joined as rows, one of them long, go to the classes of their neighbours."""
    rng = random.Random(3)
    groups = [[f"{c}{i}" for i in range(8)] for c in "abc"]
    tails = [[f"tail{c}{i}" for i in range(40)] + [c * 50] for c in "abc"]
    texts = [" ".join(rng.choice(groups[k % 3] if k % 4 or rng.random() < 0.3 else tails[k % 3]) for k in range(60)) for _ in range(200)]
    texts += ["", " ".join([tails[0][0], tails[1][0], tails[2][0]]), tails[1][3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.select("doc_id", F.lit(False).alias("held_out"), "text").unionAll(spark.createDataFrame([(900, True, "a1 unseen unseen b1"), (901, True, "taila1 tailb1")], "doc_id long, held_out boolean, text string"))
    counts = b.word_counts(docs)
    first = b.fit(docs, counts, head, 24, 3)
    seen = b.read(rows, first)
    model, tail, linked = b.extend(seen, first, 24)
    c = Counter(w.encode() for t in texts for w in t.split())
    of = dict(zip(model.words, model.classes.tolist(), strict=True)) | {r["word"].encode(): r["class"] for r in tail.collect()}
    assert set(of) == set(c) and max(of.values()) < model.rest and {r["word"].encode(): r["n"] for r in tail.collect()}.items() <= c.items()
    kinds = [Counter(of[w.encode()] for w in t).most_common(1)[0] for t in tails]
    assert len({k for k, _ in kinds}) == 3 and all(n >= 38 for _, n in kinds) and all(of[t[-1].encode()] == k for t, (k, _) in zip(tails, kinds, strict=True))
    for before in range(len(model.gain)):
        total = sum((n + 0.5) / model.norm * 10 ** model.gain[before, of[w]] for w, n in c.items())
        total += (model.ends + 0.5) / model.norm * 10 ** model.gain[before, model.end] + 0.5 / model.norm * 10 ** model.gain[before, model.rest]
        assert total == pytest.approx(1)
    m = np.zeros_like(model.gain)  # the model from all adjacent classes, by brute force
    for t in texts:
        ids = [model.end, *(of[w.encode()] for w in t.split()), model.end]
        for x, y in zip(ids, ids[1:]):
            m[x, y] += 1
    z = np.bincount([of[w] for w in c], [n + 0.5 for n in c.values()], len(m))
    z[model.end], z[model.rest] = model.ends + 0.5, 0.5
    assert np.allclose(model.gain, b.estimate(m, z, model.norm))
    text = {r["doc_id"]: r["text"] for r in rows.collect()}
    out = b.score(seen, linked, model).collect()
    assert len(out) == len(text)
    for r in out:
        own = text[r["doc_id"]].encode().split()
        ids = [model.end, *(of.get(w, model.rest) for w in own), model.end]
        want = sum(math.log10((c[w] + 0.5) / model.norm) for w in own) + math.log10((model.ends + 0.5) / model.norm)
        assert r["base_score"] == pytest.approx(want) and r["n_known"] == sum(c[w] > 0 for w in own) + 1
        assert r["score"] == pytest.approx(want + sum(model.gain[x, y] for x, y in zip(ids, ids[1:])))


def test_sizes_grow_with_the_corpus():
    assert b.sizes(1000) == (b.CLUSTERED, b.CLASSES) and b.sizes(0) == (b.CLUSTERED, b.CLASSES)
    more = b.sizes(100 * b.TOKENS)
    assert more[0] > 2 * b.CLUSTERED and more[1] > 2 * b.CLASSES


def test_long_frequent_words_are_held(spark):
    counts = spark.createDataFrame([("e" * 40, 100), ("a", 9), ("f" * 90000, 50)], "word string, n long")
    docs = spark.createDataFrame([("a",)], "text string")
    assert b.fit(docs, counts, 1 << 18, 2, 2).words == [b"e" * 40, b"a"]


def test_clashing_names(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    odd = docs.withColumns({c: F.lit(1) for c in ("row", "word", "n", "held_out", "score", "base", "ids")})
    score = lambda d: sorted((r["doc_id"], round(r["score"], 9)) for r in b.score_documents(d).collect())
    assert score(odd) == score(docs)


def test_tokens_of_slices(monkeypatch):
    """Parts of a batch, with nulls, empty texts and spaces of all kinds, give the words of plain Python."""
    monkeypatch.setattr(b, "PART", 40)
    rng = random.Random(2)
    parts = ["Word", "É", "a\u0305b", "x\u00a0y", "q\u0085z", "\x1c", "ſ", " ", "  ", "\t", "\n", "\x0b", "\x0c\r", "İK"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(300)] + [None, "", " ", "z" * 100]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    held = b.word_array([b"word", b"x\xc2\xa0y"])
    got = []
    for part in b.slices(batch.slice(3), 0):
        flat, starts, found, places = b.numbers(part.column(0), held)
        assert [flat[i] for i in places] == [{"word": 0, "x\u00a0y": 1}.get(w, 2) for w in found.to_pylist()] and (np.delete(flat, places) == 3).all()
        split = np.split(np.array(found.cast(pa.binary()).to_pylist(), object), np.searchsorted(places, starts)[1:])
        got += [list(x) for x in split]
    assert got == [words(t) for t in texts[3:]]
    assert list(b.slices(batch.slice(0, 0), 0)) == []
