"""The pipeline's stages against plain Python, and what each of them must keep."""

import inspect

import pytest
from pyspark.sql import functions as F

cp = pytest.importorskip("corpus_pipeline")

from strata.llm import mixing, quality_rules, secrets, simhash  # noqa: E402
from strata.llm.common import materialize  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "simhash_near_dedup", "secret_scans", "mixing", "best_fit_packing"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in cp.STAGES)


def least_of_near_copies(texts):
    """The smallest id of each group, by comparing all pairs: close fingerprints of which some segment differs in one bit at most."""
    scheme = simhash.SIMILAR
    fps = {i: sum(int(w) << 64 * k for k, w in enumerate(simhash.fingerprint(t, scheme))) for i, t in texts.items()}
    group = {i: i for i in fps}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in fps.items():
        for j, b in fps.items():
            if i < j and (a ^ b).bit_count() <= scheme.distance and any(((a ^ b) >> at & (1 << n) - 1).bit_count() <= 1 for at, n in scheme.cuts):
                x, y = root(i), root(j)
                group[max(x, y)] = min(x, y)
    return sorted(i for i in group if root(i) == i)


def test_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows, steps = {r["doc_id"]: r for r in docs.collect()}, []
    for _, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, DATA), "step")
        steps.append(docs.collect())
    assert all(d[0].asDict().keys() == next(iter(rows.values())).asDict().keys() for d in steps[:-1])
    source = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r["doc_id"] for r in quality_rules.score_documents(source).where("kept").collect()}
    assert sorted(r["doc_id"] for r in steps[0]) == sorted(kept)
    assert sorted(r["doc_id"] for r in steps[1]) == least_of_near_copies({i: rows[i]["text"] for i in kept})
    dirty = {r["doc_id"] for r in secrets.report(source).where("spans <> ''").collect()}
    assert sorted(r["doc_id"] for r in steps[2]) == sorted(r["doc_id"] for r in steps[1])
    for r in steps[2]:
        assert (r["text"] != rows[r["doc_id"]]["text"]) == (r["doc_id"] in dirty)
    before = spark.createDataFrame(steps[2])
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.summary(before).collect() if r["size"]}
    assert {i: sum(r["doc_id"] == i for r in steps[3]) for i in want} == want
    lengths = {}
    for r in steps[4]:
        lengths[r["sequence_id"]] = lengths.get(r["sequence_id"], 0) + r["length"]
    assert max(lengths.values()) <= 2048 and sum(r["piece"] == 0 for r in steps[4]) == len(steps[3])
    assert cp.run(spark, DATA).count() == len(steps[4])


def odd_documents(spark):
    """Nulls in each column, empty and long texts, repeated rows and ids, and columns of clashing names."""
    text = " ".join(f"word{i}" for i in range(90))
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (2, text, None, None), (None, text + " more", "en", "a"), (3, None, "en", "b"), (4, "", None, "b")]
    rows += [(5, " ".join(f"w{i}" for i in range(30_000)), "en", "b"), (6, " ".join(f"v{i}" for i in range(80)) + " token=abcdefghijklmnop", "de", None)]
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit("own") for c in ("_row", "_text", "_t", "_key", "_keep", "_size", "copies", "kept", "secrets", "rate")})


def test_odd_documents_pass_all_stages(spark):
    docs, counts = odd_documents(spark), []
    names = docs.columns
    for k, (_, stage) in enumerate(cp.STAGES):
        docs = materialize(stage(spark, docs, DATA), "odd")
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == names and all(r["kept"] == r["_row"] == "own" for r in docs.collect())
        if k == 1:  # of equal texts one; the row without an id stays
            assert sorted(r["doc_id"] or 0 for r in docs.collect()) == [0, 1, 5, 6]
        if k == 2:
            assert "abcdefghijklmnop" not in next(r["text"] for r in docs.collect() if r["doc_id"] == 6)
    assert counts[:3] == [6, 4, 4] and counts[4] > 0


def test_empty_table_passes_all_stages(spark):
    docs = odd_documents(spark).where("false")
    for _, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, DATA), "none")
        assert docs.count() == 0
