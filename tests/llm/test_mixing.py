import random

from pyspark.sql import functions as F

from strata.llm import mixing


def brute(sizes):
    """Targets by repeated resharing of what full sources leave."""
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), [n for n in names if sizes[n]]
    left = 1.5 * sum(sizes.values())
    while open_:
        unit = left / sum(weight[n] for n in open_)
        full = [n for n in open_ if unit * weight[n] >= 2 * sizes[n]]
        for n in full or open_:
            target[n] = min(2.0 * sizes[n], unit * weight[n])
            left -= target[n]
        open_ = [n for n in open_ if n not in full] if full else []
    return target


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_and_draws(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("x" * rng.randrange(1, 60)), s) for i, s in enumerate(rng.choices(["a", "b", "ä", "Z", None, "z"], [50, 5, 3, 2, 1, 30], k=3000))]
    rows += [(9000, None, "empty"), (9001, "", "empty"), (1, rows[1][1], rows[1][2])]
    out = mixing.summary(docs(spark, rows)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute(sizes)
    by_id = {i: (len((t or "").split()), s) for i, t, s in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        size, source = by_id[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size, sizes[source]) and abs(r["target"] - want[source]) < 1e-6 * max(1, want[source])
        assert r["taken"] in (0, size, 2 * size)
        taken[source] += r["taken"]
    assert len(out) == len(rows)
    assert abs(sum(want.values()) - 1.5 * sum(sizes.values())) < 1e-3
    assert all(abs(taken[s] - want[s]) <= max(0.15 * want[s], 120) for s in sizes)
    again = {(r["doc_id"], r["taken"]) for r in mixing.summary(docs(spark, rows).repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in out}


def test_emit_repeats_rows(spark):
    rows = [(i, "one two", "a" if i % 3 else "b") for i in range(300)]
    base = docs(spark, rows).withColumns({"copies": F.lit("own"), "rate": F.lit(0), "_size": F.lit(9)})
    out = mixing.emit(base)
    assert out.columns == base.columns
    want = {r["doc_id"]: r["taken"] // 2 for r in mixing.summary(docs(spark, rows)).collect()}
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_empty(spark):
    none = docs(spark, [(1, "x", "a")]).where("false")
    assert mixing.summary(none).count() == 0 and mixing.emit(none).count() == 0
    blank = mixing.summary(docs(spark, [(1, None, None), (2, "", "a")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in blank] == [(0, 0.0, 0)] * 2


def test_many_sources_without_a_single_task(spark, monkeypatch):
    """Ranks and the level of 3,000 sources equal the plain way; no window or sort has them all in one partition."""
    monkeypatch.setattr(mixing.ranked, "__defaults__", (100,))
    rng = random.Random(5)
    sizes = {f"s{rng.randrange(10**9)}": int(10 ** rng.uniform(0, 6)) for _ in range(3000)} | {None: 77, "": 5}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
    want = brute(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-9 * max(1, want[s]) for s in want)
    order = sorted(mixing.ranked(frame).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in order] == list(range(len(sizes))) and [r["source"] for r in order] == sorted(x for x in sizes if x is not None) + [None]
    assert "SinglePartition" not in mixing.ranked(frame)._jdf.queryExecution().executedPlan().toString()


def test_a_very_long_text(spark):
    got = {r["doc_id"]: r["size"] for r in mixing.summary(docs(spark, [(1, "word " * 400_000, "a"), (2, "x", "b")])).collect()}
    assert got == {1: 400_000, 2: 1}
