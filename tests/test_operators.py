import random

import pytest
from pyspark.sql import functions as F

from strata.operators import batch, blocks, cache, compact, files, fold, mvcc, order
from strata.plans import compaction
from strata.plans.compaction import FileRow

LOG = "user_key string, seq long, vtype int, value string"


def test_versions(spark):
    log = spark.createDataFrame([("foo", 1, 1, "v1"), ("foo", 2, 1, "v2"), ("foo", 3, 0, None), ("bar", 4, 1, "")], LOG)
    assert [r["value"] for r in mvcc.get(log, "foo", 1).collect()] == ["v1"]
    assert [r["value"] for r in mvcc.get(log, "foo", 2).collect()] == ["v2"]
    assert mvcc.get(log, "foo").collect() == []
    assert [r["value"] for r in mvcc.get(log, "bar").collect()] == [""]
    asked = spark.createDataFrame([("foo",), ("bar",), ("baz",), ("bar",)], "user_key string")
    got = sorted((r["user_key"], r["status"]) for r in mvcc.multi_get(log, asked).collect())
    assert got == [("bar", "FOUND"), ("bar", "FOUND"), ("baz", "NOT_FOUND"), ("foo", "DELETED")]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_as_of(spark, width):
    rng = random.Random(3)
    log = [(rng.choice("aaab"), s, rng.choice([0, 1]), str(s)) for s in range(1, 200)]
    probes = [(rng.choice("abc"), rng.randrange(0, 220)) for _ in range(80)]
    got = mvcc.as_of(spark.createDataFrame(log, LOG), spark.createDataFrame(probes, "user_key string, snapshot long"), width).collect()
    want = [(k, s, max((e[1] for e in log if e[0] == k and e[1] <= s), default=None)) for k, s in probes]
    assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == sorted(want, key=str)


def test_drop_table(spark):
    rows = [
        ("a", 50, 0, 0), ("b", 110, 0, 0), ("c", 60, 1, 0), ("d", 120, 1, 0), ("e", 100, 1, 0), ("e", 99, 1, 1), ("e", 98, 1, 1), ("f", 103, 1, 0),
        ("f", 102, 0, 0), ("f", 97, 0, 0), ("g", 105, 0, 0), ("g", 104, 0, 0), ("g", 96, 0, 1), ("g", 95, 1, 1),
    ]
    log = spark.createDataFrame([(k, s, t, "") for k, s, t, _ in rows], LOG)
    deeper = spark.createDataFrame([(k, k) for k in "abf"], "smallest string, largest string")
    got = {(r["user_key"], r["seq"]) for r in compact.drop_obsolete(log, 100, deeper).collect()}
    assert got == {(k, s) for k, s, _, dropped in rows if not dropped}


def test_corrupt_keys_break_runs(spark):
    rows = [(0, "a", 9, True), (1, "a", 8, True), (2, None, None, False), (3, "a", 7, True), (4, "a", 6, True)]
    log = spark.createDataFrame(rows, "pos long, user_key string, seq long, is_valid boolean")
    assert sorted(r["pos"] for r in compact.with_corrupt(log, 100).collect()) == [0, 2, 3]


def test_order_helpers(spark):
    keys = sorted({f"{random.Random(i).randrange(10**6):06d}" for i in range(300)})
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r["rank"] for r in order.rank_all(df, "k").orderBy("k").collect()] == list(range(1, len(keys) + 1))
    assert [r["rank"] for r in order.rank_all(df, "k", descending=True).orderBy("k").collect()] == list(range(len(keys), 0, -1))
    near = {r["k"]: (r["prev_k"], r["next_k"]) for r in order.neighbours(df, "k").collect()}
    assert near == {k: (p, n) for k, p, n in zip(keys, [None, *keys], [*keys[1:], None], strict=False)}


def frame(spark, rows):
    return spark.createDataFrame(rows, "level long, file_no long, smallest string, largest string, file_size long, n_entries long")


def test_file_ranges(spark):
    f = frame(spark, [(1, 1, "150", "200", 1, 1), (1, 2, "200", "250", 1, 1), (1, 3, "300", "350", 1, 1), (1, 4, "400", "450", 1, 1)])
    asked = spark.createDataFrame([(1, k) for k in ("200", "201", "251", "449", "451")], "level long, user_key string")
    got = {r["user_key"]: r["file_no"] for r in files.find_file(asked, f).collect()}
    assert got == {"200": 1, "201": 2, "251": 3, "449": 4, "451": None}
    assert [r["file_no"] for r in files.overlapping(f, "a", None).collect()] == []
    assert {r["file_no"] for r in files.overlapping(f, None, None).collect()} == {1, 2, 3, 4}


def test_level_zero_closure(spark):
    f = frame(spark, [(0, 1, "a", "g", 1, 1), (0, 2, "e", "n", 1, 1), (0, 3, "o", "t", 1, 1)])
    assert files.closure(f, "k", "l") == [1, 2]
    assert files.closure(f, "u", None) == []


def test_many_level_zero_files(spark):
    f = frame(spark, [(0, i, "a", "z", 1, 1) for i in range(1, 61)] + [(0, i, f"z{i}", f"z{i + 1}", 1, 1) for i in range(61, 99)])
    assert files.closure(f, "k", "l") == list(range(1, 61)) and files.closure(f, "z61", None) == list(range(61, 99))
    out = files.files_to_search(spark.createDataFrame([("k",)], "user_key string"), f).orderBy("probe_order").collect()
    assert [r["file_no"] for r in out] == list(range(60, 0, -1))


def test_scores(spark):
    two = frame(spark, [(0, 1, "a", "b", 5, 1), (0, 2, "a", "b", 5, 1)])
    r = files.pick_level(two).head()
    assert (r["level"], r["score"], r["due"]) == (0, 0.5, False)
    full = two.unionByName(frame(spark, [(1, 3, "a", "b", 10 * 1048576, 1)]))
    r = files.pick_level(full).head()
    assert (r["level"], r["score"], r["due"]) == (1, 1.0, True)


def test_input_expansion():
    rows = [
        FileRow(0, 1, "d", "k", 1), FileRow(0, 2, "a", "c", 1), FileRow(1, 3, "a", "g", 1), FileRow(1, 4, "h", "n", 1), FileRow(1, 5, "o", "t", 1),
        FileRow(2, 6, "x", "y", 1), FileRow(2, 7, "b", "c", 1),
    ]
    plan = compaction.set_up(rows, 0, [rows[0]])
    assert (len(plan.inputs), len(plan.below), len(plan.grandparents)) == (2, 2, 1)
    assert compaction.pick([], {}) is None
    assert compaction.overlaps(rows, 1, "k", "m") == [rows[3]]


def test_group_commit(spark):
    rows = [("q", 0, 100 << 10, False), ("q", 1, 100 << 10, False), ("q", 2, 100 << 10, False), ("q", 3, 10, True), ("q", 4, 900 << 10, True), ("q", 5, 10, False)]
    out = batch.group_commit(spark.createDataFrame(rows, "queue string, pos long, n_bytes long, sync boolean")).orderBy("pos").collect()
    assert [r["group_no"] for r in out] == [0, 0, 1, 2, 3, 3]


def test_blocks(spark):
    rows = spark.createDataFrame([(0, f"key{i:05d}", "v" * 50) for i in range(500)], "grp long, user_key string, value string")
    cut = blocks.cut_blocks(rows, "grp", size=1024)
    index = blocks.block_index(cut, "grp").orderBy("block_no").collect()
    assert len(index) > 20 and sum(r["n_entries"] for r in index) == 500
    assert all(a["last_key"].encode() <= bytes(a["index_key"]) < b["first_key"].encode() for a, b in zip(index, index[1:], strict=False))


def test_lru_model(spark):
    rng = random.Random(5)
    trace = [(t % 2, t, rng.randrange(30)) for t in range(600)]
    got = {(r["shard"], r["t"]): r["state"] for r in cache.lru_trace(spark.createDataFrame(trace, "shard int, t long, key long"), 10).collect()}
    for shard in (0, 1):
        held, seen = cache.LruCache(10), set()
        for _, t, k in (x for x in trace if x[0] == shard):
            h = held.lookup(k)
            assert got[shard, t] == ("hit" if h else "miss" if k in seen else "cold")
            held.release(h or held.insert(k, None))
            seen.add(k)


def test_lru_pins_and_weights():
    c = cache.LruCache(10)
    pinned = c.insert("a", 1, 8)
    c.release(c.insert("b", 2, 8))
    assert c.lookup("b") is None and c.total_charge == 8
    c.release(pinned)
    c.prune()
    assert c.total_charge == 0
    none = cache.LruCache(0)
    none.release(none.insert("a", 1))
    assert none.lookup("a") is None


def test_flush_level():
    rows = [FileRow(0, 9, "p", "q", 1), FileRow(1, 1, "a", "c", 1), FileRow(2, 2, "m", "n", 1), FileRow(2, 3, "x", "z", 30 << 20)]
    assert [compaction.flush_level(rows, *r) for r in (("p", "p"), ("b", "b"), ("m", "m"), ("d", "e"), ("y", "y"))] == [0, 0, 1, 2, 0]
    assert [f.file_no for f in compaction.search_order([*rows, FileRow(0, 12, "a", "z", 1)], "p")] == [12, 9]


def test_corrupt_runs_by_bucket(spark):
    rows = [(i, "k", 100 - i, i % 5 != 3) for i in range(40)]
    log = spark.createDataFrame(rows, "pos long, user_key string, seq long, is_valid boolean")
    kept = sorted(r["pos"] for r in compact.with_corrupt(log, 1000).collect())
    assert kept == sorted({0} | {i for i in range(40) if i % 5 in (3, 4)})


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    log = spark.createDataFrame([(bytearray(b"a"), 1, 1, bytearray(b"v"))], "user_key binary, seq long, vtype int, value binary")
    log.withColumn("unused", F.lit(1)).write.parquet(f"{tmp_path}/log")
    read = spark.read.parquet(f"{tmp_path}/log")
    for df in (mvcc.get(read, bytearray(b"a"), 5), mvcc.scan(mvcc.key_range(read, bytearray(b"a"), bytearray(b"c")), 5)):
        text = plan(df)
        assert "GreaterThanOrEqual(user_key" in text or "EqualTo(user_key" in text
        assert "<= 5)" in text.split("FileScan")[0] and "unused" not in text
        assert "Window" not in text and text.count("Exchange hashpartitioning") <= (1 if "EqualTo(user_key" in text else 2)


def test_no_global_windows(spark):
    log = spark.range(100).select(F.format_string("user%05d", "id").alias("user_key"))
    for df in (order.rank_all(log, "user_key"), order.neighbours(log, "user_key")):
        # the only single partition holds one row per bucket
        assert plan(df).count("SinglePartition") <= 2


@pytest.mark.parametrize("keys", ["url", "same prefix", "hot", "few"])
def test_buckets_are_even(spark, keys):
    """Rows of a bucket, whatever the keys: long common prefixes, one key with most rows, fewer keys than buckets."""
    n = 20_000
    key = {
        "url": F.format_string("https://www.example.org/pages/%08d.html", "id"), "same prefix": F.format_string("%0200d", "id"),
        "hot": F.when(F.col("id") % 10 > 0, F.lit("hot")).otherwise(F.format_string("k%05d", "id")), "few": F.format_string("%d", F.col("id") % 3),
    }[keys]
    rows = spark.range(n).select(key.alias("user_key"), (-F.col("id")).alias("neg"))
    sizes = [r["count"] for r in order.bucketed(rows, ["user_key", "neg"]).groupBy("_b").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * n / 8
    alone = [r["count"] for r in order.bucketed(rows, ["user_key"]).groupBy("_b").count().collect()]
    assert len(alone) == {"hot": len(alone), "few": 3}.get(keys, 8) and sum(alone) == n


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 66, 200, 1000])
def test_buckets_count_the_places_before(spark, n):
    cuts = [(3 * i,) for i in range(n)]
    rows = spark.range(-2, 3 * n + 3).withColumn("b", order.bucket_of(cuts, ["id"], {"id": "bigint"}))
    assert all(r["b"] == sum(c <= r["id"] for (c,) in cuts) for r in rows.collect())


@pytest.mark.parametrize("buckets", [1, 2, 9])
def test_merged_order_equals_search(spark, buckets, monkeypatch):
    monkeypatch.setattr(order, "PER_PARTITION", buckets)
    rng = random.Random(buckets)
    bounds = sorted(rng.sample(range(1000), 60))
    held = [(1, i, f"{a:03d}", f"{b:03d}", 1, 1) for i, (a, b) in enumerate(zip(bounds[::2], bounds[1::2], strict=True))]
    asked = [f"{rng.randrange(1000):03d}" for _ in range(200)]
    got = {r["user_key"]: r["file_no"] for r in files.find_file(spark.createDataFrame([(1, k) for k in asked], "level long, user_key string"), frame(spark, held)).collect()}
    assert got == {k: next((no for _, no, _, b, *_ in held if b >= k), None) for k in asked}
    ranges = [(f"{a:03d}", f"{a + rng.randrange(40):03d}") for a in rng.sample(range(900), 25)]
    inside = files.covered(spark.createDataFrame([(k,) for k in asked], "user_key string"), spark.createDataFrame(ranges, "smallest string, largest string"))
    assert {r["user_key"] for r in inside.collect()} == {k for k in asked if any(a <= k <= b for a, b in ranges)}
    keys = spark.createDataFrame([(k,) for k in asked], "user_key string")
    outside = compact.at_base_level(keys, spark.createDataFrame(ranges, "smallest string, largest string"))
    assert sorted(r["user_key"] for r in outside.collect()) == sorted(k for k in asked if not any(a <= k <= b for a, b in ranges))


def test_newest_is_hashed(spark):
    log = spark.range(100).select(F.format_string("k%d", F.col("id") % 7).alias("user_key"), F.col("id").alias("seq"), F.lit(1).alias("vtype"), F.lit("v").alias("value"))
    text = plan(mvcc.scan(log))
    assert "SortAggregate" not in text and "HashAggregate" in text and "Window" not in text
    assert sorted(r["seq"] for r in mvcc.scan(log, 50).collect()) == list(range(44, 51))


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_newer_versions_by_stretch(spark, width):
    rng = random.Random(width)
    log = [(rng.choice("aaaaab"), s, 1, None) for s in rng.sample(range(300), 150)]
    got = {r["seq"]: r["newer_seq"] for r in mvcc.all_versions(spark.createDataFrame(log, LOG), width).collect()}
    assert got == {s: min((t for j, t, *_ in log if j == k and t > s), default=None) for k, s, *_ in log}


@pytest.mark.parametrize("per", [1, 5, 1000])
def test_ranges_meet_files_in_buckets(spark, per, monkeypatch):
    """Against all pairs: wide and narrow ranges, open bounds, overlapping files, by level or not; no nested loop."""
    monkeypatch.setattr(files, "PER_BUCKET", per)
    rng = random.Random(per)
    key = lambda x: f"{x:04d}"
    held = [(rng.randrange(3), i, key(a := rng.randrange(900)), key(a + rng.choice([0, 3, 40, 600])), 1, 1) for i in range(70)]
    asked = [(i, rng.randrange(3), None if i % 9 == 0 else key(a := rng.randrange(900)), None if i % 7 == 0 else key((a if i % 9 else 300) + rng.choice([0, 5, 500]))) for i in range(60)]
    ranges = spark.createDataFrame(asked, "range_no long, level long, low string, high string")
    found = files.met(ranges, frame(spark, held), ("level",))
    near = lambda r, f: (r[2] is None or f[3] >= r[2]) and (r[3] is None or f[2] <= r[3])
    assert sorted((r["range_no"], r["file_no"]) for r in found.collect()) == sorted((r[0], f[1]) for r in asked for f in held if r[1] == f[0] and near(r, f))
    assert "NestedLoop" not in plan(found)
    pairs = files.range_matches(ranges.drop("level"), frame(spark, held)).collect()
    assert sorted((r["range_no"], r["file_no"]) for r in pairs) == sorted((r[0], f[1]) for r in asked for f in held if near(r, f))


def test_groups_stay_whole_after_a_join(spark):
    """A join by the group's column that turns into a broadcast as it runs leaves no shuffle that may be read by its writers."""
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "64k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 4000, 1, 4).select((F.col("id") % 100).alias("g"), "id", F.sha2(F.col("id").cast("string"), 512).alias("text"))
        joined = rows.join(rows.groupBy("g").agg(F.max("id").alias("end")), "g")

        def begin():
            n = 0

            def step(_) -> tuple:
                nonlocal n
                n += 1
                return (n,)

            return step

        counted = fold.fold(joined, "g", ["id"], ["text"], begin, "n long").where("id = end")
        assert {r["n"] for r in counted.collect()} == {40}
        each = fold.unfold(joined, "g", ["id"], ["text"], lambda: (lambda step: lambda x: [step(x)])(begin()), "n long")
        assert each.where("n = 40").count() == 100
    finally:
        for k in changed:
            spark.conf.unset(k)


@pytest.mark.parametrize("n", [3, 40, 700])
def test_ranges_meet_files_at_every_size_of_nodes(spark, n):
    """Open, reversed and wide ranges over files of one key, of some and of all, with places for nodes of 1, 16 and 256 buckets."""
    rng = random.Random(n)
    key = lambda i: f"k{i:04d}"
    held = [(i, *sorted((key(a := rng.randrange(1000)), key(min(999, a + rng.choice([0, 3, 40, 900])))))) for i in range(150)]
    ranges = [(i, rng.choice([None, key(rng.randrange(1000)), key(rng.randrange(1000))]), rng.choice([None, key(rng.randrange(1000)), key(rng.randrange(1000))])) for i in range(150)]
    r, f = spark.createDataFrame(ranges, "range_no long, low string, high string"), spark.createDataFrame(held, "file_no long, smallest string, largest string")
    meets = lambda low, high, a, b: (low is None or b >= low) and (high is None or a <= high)
    want = sorted((i, no) for i, low, high in ranges for no, a, b in held if meets(low, high, a, b))
    cuts = [(key(i),) for i in sorted(rng.sample(range(1000), n))]
    found = files.met(r, f, (), cuts)
    assert sorted((x["range_no"], x["file_no"]) for x in found.collect()) == want
    assert sorted(x["range_no"] for x in files.some_overlap(r, f.select("smallest", "largest")).collect()) == sorted({i for i, _ in want})
    assert files.some_overlap(r, f.where("false")).count() == 0


def test_ranges_are_placed_once_each(spark):
    """The place of a range is not looked up for each of the entries that the ranges come from."""
    entries = spark.range(0, 20000, 1, 4).select(F.format_string("k%02d", F.col("id") % 50).alias("low"))
    looked = spark.sparkContext.accumulator(0)

    def counted(x):
        looked.add(1)
        return [0]

    files._with_nodes(entries.distinct(), ["low"], lambda n, low: counted(low)).count()
    assert looked.value == 50
    plan = files.met(entries.distinct().withColumn("high", F.col("low")), spark.createDataFrame([("k01", "k02")], "smallest string, largest string"), (), [("k20",)])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("k20") == 0
