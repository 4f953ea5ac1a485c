import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strata.llm import quadratic as q


def corpus(n=600):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(5, 120))]
        good = rng.random() < 0.6
        rows.append((i, " ".join(words if good else [w + "###" for w in words])))
        if i % 2:
            labels.append((i, int(good)))
    return rows, labels


def test_scores(spark):
    rows, labels = corpus()
    rows += [(9001, None), (9002, ""), (9003, "x " * 20000), (1, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (3, None), (9002, 7), labels[0]], "doc_id long, quality int")
    out = q.score_documents(docs, known).collect()
    assert len(out) == len(rows)
    truth = dict(labels)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in out if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 40 and sum(a == b for a, b in held) / len(held) > 0.95
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_moments_equal_numpy(spark):
    rows, labels = corpus(120)
    stats = q.document_statistics(spark.createDataFrame(rows, "doc_id long, text string"))
    known = spark.createDataFrame([(i, y) for i, y in labels], "doc_id long, y int")
    sums = q.moments(stats.join(known, "doc_id").select("y", "x"))
    text = dict(rows)
    for k in (0, 1):
        x = np.array([q.statistics(text[i]) for i, y in labels if y == k])
        assert sums[k][0] == len(x) and np.allclose(sums[k][1], x.sum(axis=0)) and np.allclose(sums[k][2], x.T @ x)


def test_density_by_brute_force():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, len(q.NAMES)))
    x[:150] += 1
    sums = {k: (150, p.sum(axis=0), p.T @ p) for k, p in ((0, x[150:]), (1, x[:150]))}
    model = q.fit(sums)
    logs = []
    for m, f, _ in zip(model.means, model.factors, model.logs, strict=True):
        inverse = f.T @ f
        d = x - m
        logs.append(-0.5 * (d @ inverse * d).sum(axis=1) + 0.5 * np.linalg.slogdet(inverse)[1])
    want = 1 / (1 + np.exp(-(logs[1] - logs[0]) / q.TEMPERATURE))
    assert np.allclose(model.scores(x), want)


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {round(r["score"], 6) for r in q.score_documents(docs, none).collect()} == {0.5}
    assert q.score_documents(docs.where("false"), none).count() == 0
    one_class = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in q.score_documents(docs, one_class).collect())


def test_statistics_are_finite():
    for t in (None, "", " ", "\n\n", "a", "a\na\na", "#", "é" * 10, "🙂 " * 9, "A" * 100_000):
        assert np.isfinite(q.statistics(t)).all() and len(q.statistics(t)) == len(q.NAMES)


def plain_statistics(text):
    """The statistics by counting in plain Python, in the order of NAMES."""
    raw = (text or "").encode()
    logit = lambda p: math.log((p + 0.005) / (1.005 - p))
    words = [w for w in re.split(rb"[ \t-\r]+", raw) if w]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    solid = max(1, sum(b not in b" \t\n\x0b\x0c\r" for b in raw))
    count = lambda some: sum(b in some for b in raw)
    upper = sum(65 <= b <= 90 for b in raw)
    letters = max(1, upper + sum(97 <= b <= 122 or b >= 192 for b in raw))
    sizes = [len(w) for w in words]
    mean = sum(sizes) / len(sizes) if sizes else 0.0
    spread = math.sqrt(sum((s - mean) ** 2 for s in sizes) / len(sizes)) if sizes else 0.0
    pairs = list(zip(words, words[1:]))
    shares = [n / len(raw) for n in Counter(raw).values()]
    packed = sum(len(zlib.compress(raw[i : i + q.BLOCK], 1)) for i in range(0, len(raw), q.BLOCK))
    return [
        math.log1p(len(words)), math.log1p(mean), math.log1p(spread), logit(upper / letters), logit(sum(48 <= b <= 57 for b in raw) / solid),
        logit(count(b"#*$%&<>@^~=+_{}[]/\\") / solid), logit(count(b".,;:?") / solid), logit(count(b"!") / solid), logit(count(b"|") / solid), logit(count(b"\"'()-`") / solid),
        logit(len(set(words)) / len(words) if words else 1.0), logit(1 - len(set(lines)) / len(lines) if lines else 0.0), math.log((packed + 1) / (len(raw) + 1)) if raw else 0.0,
        -sum(p * math.log2(p) for p in shares), logit(sum(s <= 3 for s in sizes) / len(sizes) if sizes else 0.0), math.log1p(len(words) / max(1, len(lines))),
        logit(1 - len(set(pairs)) / len(pairs) if pairs else 0.0),
    ]


def test_rows_by_brute_force(spark):
    """Statistics, moments, shrinkage and scores from scratch, on a table of the driver and made-up texts."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality")
    rows = [tuple(r) for r in table.collect()] + [(90_001, None), (90_002, ""), (90_003, "é É\n\x0b#!|'\n1 2"), (90_004, "a " * 70_000)]
    x = {i: np.array(plain_statistics(t)) for i, t in rows}
    known = {}
    for i, y in labels.collect():
        if y in (0, 1) and zlib.crc32(str(i).encode()) % 4 != 2 and i in x:
            known[i] = min(y, known.get(i, y))
    by = {k: np.array([x[i] for i, y in known.items() if y == k]) for k in (0, 1)}
    every = np.concatenate([by[0], by[1]])
    scale = np.sqrt(np.maximum(every.var(axis=0), 1e-6))
    covs = {k: np.cov(v.T, bias=True) / np.outer(scale, scale) for k, v in by.items()}
    pooled = sum(len(by[k]) * covs[k] for k in by) / len(every) + 1e-3 * np.eye(len(scale))
    want = {}
    for i, v in x.items():
        logs = []
        for k in (0, 1):
            cov = 0.6 * covs[k] + 0.3 * pooled + 0.1 * np.diag(np.diag(pooled))
            d = (v - by[k].mean(axis=0)) / scale
            logs.append(-0.5 * d @ np.linalg.solve(cov, d) - 0.5 * np.linalg.slogdet(cov)[1] + math.log((len(by[k]) + 1) / (len(every) + 2)))
        want[i] = 1 / (1 + math.exp(-max(-500, min(500, (logs[1] - logs[0]) / q.TEMPERATURE))))
    out = q.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert len(out) == len(rows) and all(abs(r["score"] - want[r["doc_id"]]) < 1e-6 for r in out)


def test_clashing_names_and_ties(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    odd = docs.withColumns({c: F.lit(1) for c in ("x", "y", "score", "held_out", "predicted", "quality")})
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    both = known.union(known.withColumn("quality", F.lit(1))).withColumns({"x": F.lit(0), "text": F.lit("n")})  # each twice: the smallest label counts
    score = lambda d, k: sorted((r["doc_id"], round(r["score"], 9)) for r in q.score_documents(d, k).collect())
    assert score(odd, both) == score(docs, known)
