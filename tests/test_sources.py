import dataclasses
import itertools
import os
import random
import shutil
import threading

import pytest
from pyspark.sql import functions as F

from strata.schema import Options
from strata.operators import manifest
from strata.sources import edits, filterblock, sst, wal
from strata.sources.store import _HELD, Store, StoreError
from strata.streaming import live


def records(data):
    return [x[0] for x in wal.decode(data) if x[0] is not None]


def drops(data):
    return [x[2] for x in wal.decode(data) if x[0] is None]


def test_log_round_trip():
    rng = random.Random(1)
    rows = [rng.randbytes(rng.choice([0, 1, 100, 32761, 32768, 70000])) for _ in range(40)]
    assert records(wal.encode(rows)) == rows
    first = wal.encode(rows[:20])
    assert records(first + wal.encode(rows[20:], len(first))) == rows


def test_log_trailer_is_padded():
    head = b"x" * (wal.BLOCK - 2 * wal.HEADER)
    data = wal.encode([head, b"next"])
    assert records(data) == [head, b"next"]
    assert list(wal.fragments([len(head), 4]))[1][1:3] == (wal.FIRST, wal.BLOCK - wal.HEADER)


def test_log_damage():
    data = bytearray(wal.encode([b"a" * 100, b"b" * 100]))
    data[50] ^= 1
    assert records(bytes(data)) == [] and drops(bytes(data)) == ["checksum mismatch"]
    assert records(wal.encode([b"a" * 100, b"b" * 100])[:-3]) == [b"a" * 100]
    assert drops(wal.encode([b"a" * 100, b"b" * 100])[:-3]) == []
    long = wal.encode([b"c" * 100000, b"d"])
    assert drops(long[wal.BLOCK :])[0] == "missing start of fragmented record"
    assert records(long[wal.BLOCK :]) == [b"d"]


def test_batches():
    data = wal.encode_batch(100, [(1, b"foo", b"bar"), (0, b"box", None), (1, b"baz", b"boo")])
    assert wal.decode_batch(data) == [(100, 1, b"foo", b"bar"), (101, 0, b"box", None), (102, 1, b"baz", b"boo")]
    for broken, why in ((data[:5], "too small"), (data[:-1], "bad batch put"), (data[:8] + b"\x09" + data[9:], "wrong count"), (data[:12] + b"\x07" + data[13:], "unknown")):
        with pytest.raises(ValueError, match=why):
            wal.decode_batch(broken)


def test_initial_offset(spark, tmp_path):
    rows = [b"a" * 100, b"b" * (2 * wal.BLOCK), b"", b"c" * 50, b"d" * 40000, b"e"]
    data = wal.encode(rows)
    begins = {}
    for record, _, at, _, _ in wal.fragments(map(len, rows)):
        begins.setdefault(record, at)
    for offset in sorted({0, len(data), len(data) + wal.BLOCK, *range(0, len(data), 997), *(b + d for b in begins.values() for d in (0, 1) if b + d)}):
        assert list(wal.decode(data, offset)) == [(r, 0, None) for i, r in enumerate(rows) if begins[i] >= offset]
    hurt = bytearray(data)
    hurt[begins[3] + wal.HEADER] ^= 1  # damage after the offset is still told
    assert [x[2] for x in wal.decode(bytes(hurt), begins[2]) if x[2]][:1] == ["checksum mismatch"]
    (tmp_path / "000001.log").write_bytes(data)
    out = wal.read_logs(spark, f"{tmp_path}/*.log", begins[3]).orderBy("record_no").collect()
    assert [bytes(r["payload"]) for r in out] == rows[3:]


def test_logs_as_a_source(spark, tmp_path):
    payloads = [wal.encode_batch(1 + 2 * i, [(1, f"k{i}".encode(), b"v"), (0, b"gone", None)]) for i in range(50)]
    (tmp_path / "000003.log").write_bytes(wal.encode(payloads))
    logs = wal.read_logs(spark, f"{tmp_path}/*.log")
    assert logs.count() == 50
    rows = wal.replay(logs)
    assert rows.where("reason is null").count() == 100 and rows.agg(F.max("seq")).head()[0] == 100


@pytest.mark.parametrize("compress", [False, True])
def test_table_round_trip(spark, tmp_path, compress):
    entries = [(f"key{i:05d}".encode() + (i << 8 | 1).to_bytes(8, "little"), b"value" * (i % 9)) for i in range(2000)]
    data = sst.encode_table(entries, compress=compress)
    assert [(k, v) for _, k, v in sst.decode_table(data)] == entries
    (tmp_path / "000007.ldb").write_bytes(data)
    spark.dataSource.register(sst.TableSource)
    df = spark.read.format("strata_table").load(str(tmp_path))
    assert df.count() == 2000 and df.where(F.col("seq") == 77).head()["user_key"] == b"key00077"
    broken = bytearray(data)
    broken[100] ^= 1
    with pytest.raises(sst.TableError, match="checksum"):
        list(sst.decode_table(bytes(broken)))
    with pytest.raises(sst.TableError, match="short"):
        list(sst.decode_table(b"x"))
    with pytest.raises(sst.TableError, match="magic"):
        list(sst.decode_table(data[:-1] + b"\0"))


def content(store, snapshot=None):
    return {bytes(r["user_key"]): bytes(r["value"]) for r in store.scan(snapshot=snapshot).collect()}


def test_store(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    with Store.open(spark, at) as s:
        assert s.get(b"foo") is None
        s.put(b"foo", b"v1")
        old = s.snapshot()
        s.write_rows([(1, b"foo", b"v2"), (1, b"bar", b""), (0, b"foo", None)])
        assert s.get(b"foo") is None and s.get(b"foo", old) == b"v1" and s.get(b"bar") == b""
        s.compact()
        assert s.get(b"foo", old) == b"v1" and s.property("num-files-at-level0") == "0"
        s.release(old)
        s.put(b"baz", b"v5")
        s.compact()
        assert s.vacuum() == [] and len(s.vacuum(0)) > 0
        assert content(s) == {b"bar": b"", b"baz": b"v5"}
        assert s.property("num-files-at-level7") is None and 0 < int(s.property("approximate-memory-usage")) < 5 << 20
        assert s.approximate_sizes([(b"a", b"z"), (b"bb", b"bz"), (b"x", b"y")]) == [3 + 8 + 3 + 8 + 2, 0, 0]
        s.checkpoint()
    again = Store.open(spark, at)
    assert content(again) == {b"bar": b"", b"baz": b"v5"} and again.last_seq == 5
    with pytest.raises(StoreError, match="exists"):
        Store.open(spark, at, Options(error_if_exists=True))
    other = Store.open(spark, at)
    again.put(b"x", b"y")
    with pytest.raises(StoreError, match="another writer"):
        other.put(b"x", b"z")
    with pytest.raises(StoreError, match="comparator"):
        Store.open(spark, at, Options(comparator="reverse"))
    Store.destroy(spark, at)
    Store.destroy(spark, at)
    with pytest.raises(StoreError, match="does not exist"):
        Store.open(spark, at, Options(create_if_missing=False))


def test_store_equals_a_dict(spark, tmp_path):
    rng, model, snaps = random.Random(11), {}, []
    store = Store.open(spark, f"file://{tmp_path}/model")
    alphabet = [0, 1, *b"abcde", 253, 254, 255]
    for step in range(8):
        rows = []
        for _ in range(40):
            key = bytes(rng.choice(alphabet) for _ in range(rng.randrange(3)))
            value = rng.randbytes(rng.randrange(5)) if rng.random() < 0.6 else None
            rows.append((int(value is not None), key, value))
            model.pop(key, None)
            if value is not None:
                model[key] = value
        store.write_rows(rows)
        assert content(store) == model
        if step in (2, 5):
            snaps.append((store.snapshot(), dict(model)))
        if step in (3, 6):
            store.compact()
        for at, held in snaps:
            assert content(store, at) == held
    assert store.maintain() >= 0
    assert content(store) == model


def test_stream(spark, tmp_path):
    schema = "user_key string, seq long, vtype int, value string"
    log = spark.createDataFrame([(f"k{i % 7}", i, int(i % 5 > 0), str(i)) for i in range(1, 200)], schema)
    log.repartition(6).write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    live.follow(stream, f"{tmp_path}/table", f"{tmp_path}/state").awaitTermination()
    want = {}
    for i in range(1, 200):
        want[f"k{i % 7}"] = str(i) if i % 5 else None
    assert {r["user_key"]: r["value"] for r in live.live(spark, f"{tmp_path}/table").collect()} == {k: v for k, v in want.items() if v}


def test_edits(spark, tmp_path):
    one = [("comparator", b"bytewise"), ("log", 3), ("next_file", 9), ("last_seq", 100), ("add", 0, 4, 100, b"a", b"c"), ("add", 1, 5, 10, b"d", b"e")]
    two = [("compact_ptr", 1, b"e"), ("del", 0, 4), ("add", 1, 6, 70, b"a", b"c"), ("prev_log", 0), ("last_seq", 130)]
    assert edits.decode(edits.encode(one)) == one and edits.decode(edits.encode(two)) == two
    for bad, why in ((b"\x63", "unknown tag"), (edits.encode(two)[:-1], "bad last_seq"), (edits.encode(one)[:5], "bad comparator")):
        with pytest.raises(ValueError, match=why):
            edits.decode(bad)
    (tmp_path / "MANIFEST-000001").write_bytes(wal.encode([edits.encode(one), edits.encode(two), b"\x63"]))
    rows = edits.read_edits(wal.read_logs(spark, f"{tmp_path}/MANIFEST-*"))
    assert [r["reason"] for r in rows.where("reason is not null").collect()] == ["unknown tag"]
    assert sorted(r["file_no"] for r in manifest.replay(rows).collect()) == [5, 6]
    assert {r["kind"]: r["num"] for r in manifest.numbers(rows).collect()} == {"log": 3, "next_file": 9, "last_seq": 130, "prev_log": 0}
    assert manifest.missing(rows).count() == 0 and manifest.pointers(rows).head()["pointer"] == b"e".hex()


def test_filter_blocks():
    assert filterblock.encode([]).hex() == "000000000b"
    keys = [[b"foo", b"bar"], [b"box"], [], [b"hello"]]
    data = filterblock.encode(list(zip((0, 2000, 3100, 9000), keys, strict=True)))
    assert filterblock.block_may_match(data, 0, b"foo") and filterblock.block_may_match(data, 2000, b"box") and filterblock.block_may_match(data, 9000, b"hello")
    assert not filterblock.block_may_match(data, 0, b"hello") and not filterblock.block_may_match(data, 4100, b"foo") and not filterblock.block_may_match(data, 9000, b"foo")
    assert filterblock.block_may_match(data, 10**6, b"x") and filterblock.block_may_match(b"abc", 0, b"x")
    many = [f"key{i}".encode() for i in range(5000)]
    held = filterblock.make_filter(many)
    assert all(filterblock.may_match(k, held) for k in many)
    assert sum(filterblock.may_match(f"other{i}".encode(), held) for i in range(10000)) < 200


def test_paranoid_recovery(spark, tmp_path):
    data = bytearray(wal.encode([wal.encode_batch(i, [(1, b"k", b"v")]) for i in range(1, 5)]))
    (tmp_path / "000002.log").write_bytes(bytes(data))
    (tmp_path / "000001.log").write_bytes(bytes(data))
    assert wal.recover(spark, str(tmp_path), 2).count() == 4 and wal.recover(spark, str(tmp_path), 2, 1).count() == 8
    data[9] ^= 1
    (tmp_path / "000002.log").write_bytes(bytes(data))
    assert wal.recover(spark, str(tmp_path), 2).count() == 0
    with pytest.raises(Exception, match="log damaged"):
        wal.recover(spark, str(tmp_path), 2, paranoid=True).count()


def names_of(folder):
    return sorted(os.path.join(d, x) for d, _, found in os.walk(folder) for x in found if not x.endswith(".crc"))


def test_crash_between_any_two_file_operations(spark, tmp_path, monkeypatch):
    """Whatever operation is the last one, the store opens with the batches that were acknowledged, or one more."""
    from strata.sources.store import _Files

    class Crash(Exception):
        pass

    operations = ("create", "replace", "delete", "open_log", "_temporary", "_rename")
    for stop in range(1, 30):
        at, left, done = f"file://{tmp_path}/{stop}", [stop], 0
        with monkeypatch.context() as m:

            def counted(f, left=left):
                def run(*args):
                    left[0] -= 1
                    if left[0] < 0:
                        raise Crash
                    return f(*args)

                return run

            for name in operations:
                m.setattr(_Files, name, counted(getattr(_Files, name)))
            store = None
            try:
                store = Store.open(spark, at, Options(wal=True))
                for i in range(3):
                    store.put(b"k%d" % i, b"v%d" % i)
                    done = i + 1
                store.flush()
                store.checkpoint()
                store.compact()
                left[0] = 10**9
            except Crash:
                pass
            finished = left[0] > 10**8
            _HELD.clear()  # the process is gone
        with Store.open(spark, at, Options(wal=True)) as again:
            want = {b"k%d" % i: b"v%d" % i for i in range(3)}
            found = content(again)
            assert found in [dict(list(want.items())[:n]) for n in (done, min(3, done + 1))], stop
            assert again.last_seq == len(found)
            again.put(b"more", b"x")
            assert content(again) == found | {b"more": b"x"}
        if finished:
            break
    assert finished and stop > 10


def test_two_writers_commit_once(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    Store.open(spark, at).put(b"a", b"0")
    io = [Store.open(spark, at).io for _ in range(2)]
    won = []

    def race(i):
        for n in range(20):
            try:
                io[i].create(f"race/{n}", str(i))
                won.append((n, i))
            except StoreError:
                pass

    threads = [threading.Thread(target=race, args=(i,)) for i in range(2)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert sorted(n for n, _ in won) == list(range(20)) and all(io[0].read(f"race/{n}") == str(i) for n, i in won)
    assert not [x for x in names_of(tmp_path) if x.endswith(".dbtmp")]


def test_log_and_lock(spark, tmp_path):
    at, options = f"file://{tmp_path}/store", Options(wal=True)
    s = Store.open(spark, at, options)
    s.write_rows([(1, b"a", b"1"), (1, b"b", b"2"), (0, b"a", None)], sync=True)
    assert s.get(b"a") is None and s.get(b"b") == b"2" and s.property("num-files-at-level0") == "0" and content(s) == {b"b": b"2"}
    with pytest.raises(StoreError, match="LOCK"):
        Store.open(spark, at, options)
    with pytest.raises(StoreError, match="LOCK"):
        Store.destroy(spark, at)
    s.close()
    kept = Store.open(spark, at, Options(wal=True, reuse_logs=True))  # goes on with the log
    assert kept.last_seq == 3 and len(kept.waiting) == 3 and content(kept) == {b"b": b"2"}
    kept.put(b"c", b"3")
    kept.close()
    with Store.open(spark, at, options) as s:  # flushes it
        assert s.last_seq == 4 and not s.waiting and not s.io.list("log") and content(s) == {b"b": b"2", b"c": b"3"}
        s.put(b"d", b"4")
        snap = s.snapshot()
        s.write(spark.createDataFrame([(0, bytearray(b"d"), 1, bytearray(b"5"))], "pos long, user_key binary, vtype int, value binary"))
        assert (s.get(b"d"), s.get(b"d", snap)) == (b"5", b"4")
        s.put(b"e", b"6")
    log = next(x for x in names_of(tmp_path) if x.endswith(".log"))
    data = bytearray(open(log, "rb").read())
    data[9] ^= 1
    open(log, "wb").write(bytes(data))
    with pytest.raises(StoreError, match="checksum"):
        Store.open(spark, at, Options(wal=True, paranoid=True))
    with Store.open(spark, at, options) as s:
        assert s.get(b"e") is None and s.get(b"d") == b"5"
    Store.destroy(spark, at)
    assert not names_of(tmp_path)


def test_back_pressure_and_write_buffer(spark, tmp_path):
    """Under repeated overwriting level 0 stays short; a full buffer becomes a file."""
    with Store.open(spark, f"file://{tmp_path}/a", Options(wal=True, write_buffer=64 << 10)) as s:
        for i in range(100):
            s.put(b"key", bytes([i]) * 7000)
            assert len(s.files) < 19 and int(s.property("num-files-at-level0")) <= 12
        assert len(s.files) > 1 and s.get(b"key") == bytes([99]) * 7000
    with Store.open(spark, f"file://{tmp_path}/b", Options(back_pressure=False)) as s:
        for i in range(14):
            s.put(b"key", b"%d" % i)
        assert int(s.property("num-files-at-level0")) >= 12
        s.options = dataclasses.replace(s.options, back_pressure=True)
        s.put(b"key", b"last")
        assert int(s.property("num-files-at-level0")) <= 4 and s.get(b"key") == b"last"
        assert "1 1 " in s.property("stats") and s.property("sstables").count("\n") == len(s.files)


def test_vacuum_spares_what_is_in_use(spark, tmp_path):
    with Store.open(spark, f"file://{tmp_path}/store") as s:
        for i in range(3):
            s.put(b"k", b"%d" % i)
        view, frame = s.view(), s.scan()
        other = Store.open(spark, s.path)
        added = other._write_files(other.log(), 0, 1)  # written, not yet committed
        s.compact()
        assert s.vacuum() == []  # young: another writer's, or read by a frame
        assert frame.count() == 1 and not {f["path"] for f in added} & set(other.vacuum(0)) and content(s) == {b"k": b"2"}
        view = s.view()
        s.put(b"k", b"9")
        s.compact()
        s.vacuum(0)
        assert [bytes(r["value"]) for r in view.scan().collect()] == [b"2"] and s.take(5) == [(b"k", b"9")]
        view.close()
        assert s.vacuum(0) and content(s) == {b"k": b"9"}


def test_failed_compaction_is_sticky(spark, tmp_path, monkeypatch):
    s = Store.open(spark, f"file://{tmp_path}/store")
    for i in range(3):
        s.put(b"k", b"%d" % i)
    with monkeypatch.context() as m:
        m.setattr(Store, "_write_files", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            s.compact()
    with pytest.raises(StoreError, match="earlier compaction"):
        s.put(b"k", b"x")
    assert content(s) == {b"k": b"2"}
    again = Store.open(spark, s.path)
    again.put(b"k", b"x")
    assert content(again) == {b"k": b"x"}


def test_seeks_trigger_a_compaction(spark, tmp_path):
    with Store.open(spark, f"file://{tmp_path}/store") as s:
        s.write_rows([(1, b"a", b"1"), (1, b"m", b"1"), (1, b"z", b"1")])
        s.write_rows([(1, b"a", b"2"), (1, b"z", b"2")])
        assert s.get(b"m") == b"1" and s.victim is None and sum(s.seeks.values()) == 99
        assert s.get(b"a") == b"2" and sum(s.seeks.values()) == 99  # found in the first file
        for _ in range(99):
            assert s.record_read_sample(b"m")
        assert s.victim is not None and s.maintain() == 1 and s.property("num-files-at-level0") == "0"
        assert s.maintain() == 0 and not s.record_read_sample(b"m") and s.get(b"m") == b"1"
        assert s.take(2) == [(b"a", b"2"), (b"m", b"1")] and s.take(1, reverse=True) == [(b"z", b"2")]


def test_sizes_by_metadata(spark, tmp_path):
    with Store.open(spark, f"file://{tmp_path}/store", Options(partitions=4)) as s:
        s.write(spark.range(1000).select(F.col("id").alias("pos"), F.format_string("k%04d", "id").cast("binary").alias("user_key"), F.lit(1).alias("vtype"), F.lit("12345").cast("binary").alias("value")))
        assert len(s.files) == 4
        assert s.approximate_sizes([(b"a", b"z"), (b"k0100", b"k0900"), (b"k0000", b"k0001"), (b"x", b"z"), (b"k0999", b"l")]) == [18000, 14400, 18, 0, 18]


@pytest.mark.parametrize("bits", [0, 10])
def test_table_seeks(bits):
    """Gets, seeks, backward scans and offsets against a sorted list; a get reads one block or none."""
    rng = random.Random(bits)
    names = sorted({bytes(rng.choice(b"abc\xff") for _ in range(rng.randrange(1, 7))) for _ in range(900)})
    rows = sorted([(k, s, rng.randrange(2), rng.randbytes(rng.randrange(30))) for k in names for s in rng.sample(range(50), rng.randrange(1, 4))], key=lambda r: (r[0], -r[1]))
    data = sst.encode_table([(k + (s << 8 | t).to_bytes(8, "little"), v) for k, s, t, v in rows], 256, interval=4, bits_per_key=bits)
    table = sst.Table(data)
    assert len(table.index) > 50 and (table.filter is not None) == bool(bits)
    parts = [(*sst.split_internal_key(k), v) for _, k, v in table.scan()]
    assert parts == rows and [(*sst.split_internal_key(k), v) for _, k, v in table.backward()] == rows[::-1]
    misses = 0
    for k in [*rng.sample(names, 200), *(bytes(rng.choice(b"abcd\xff") for _ in range(rng.randrange(1, 7))) for _ in range(300))]:
        for seq in (None, rng.randrange(50)):
            want = [r for r in rows if r[0] == k and (seq is None or r[1] <= seq)]
            before = table.blocks_read
            assert table.get(k, seq) == (want[0][1:] if want else None)
            misses += table.blocks_read == before
            assert table.blocks_read - before <= 2
            after = [(*sst.split_internal_key(x), v) for _, x, v in itertools.islice(table.seek(k, seq), 3)]
            assert after == [r for r in rows if r[0] > k or (r[0] == k and (seq is None or r[1] <= seq))][:3]
    assert (misses > 100) == bool(bits)
    offsets = [table.offset(k) for k in names]
    assert offsets == sorted(offsets) and table.offset(b"") == 0 and len(data) > table.offset(b"\xff" * 9) >= offsets[-1]
    last = [list(sst.Block(table._contents(handle)).entries())[-1][0] for _, handle in table.index]
    assert all(sst.sort_key(k) >= sst.sort_key(x) for (k, _), x in zip(table.index, last, strict=True)) and sum(len(k) for k, _ in table.index) <= sum(map(len, last))


def test_index_keys():
    tag = lambda s: (s << 8 | 1).to_bytes(8, "little")
    assert sst.index_key(b"abcdef" + tag(3), b"abzz" + tag(9)) == b"abd" + sst.NEWEST.to_bytes(8, "little")
    assert sst.index_key(b"abc" + tag(3), b"abc" + tag(2)) == b"abc" + tag(3) and sst.index_key(b"a" + tag(3), None) == b"a" + tag(3)
    assert sst.index_key(b"foo" + tag(1), None) == b"g" + sst.NEWEST.to_bytes(8, "little") and sst.index_key(b"\xff" + tag(1), None) == b"\xff" + tag(1)


def test_filters_reach_the_tables(spark, tmp_path):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        entries = [(f"key{i:05d}".encode() + (i << 8 | 1).to_bytes(8, "little"), b"v" * 50) for i in range(3000)]
        (tmp_path / "000007.ldb").write_bytes(sst.encode_table(entries, bits_per_key=10))
        spark.dataSource.register(sst.TableSource)
        df = spark.read.format("strata_table").option("pushdown", "true").load(str(tmp_path))
        low, high = bytearray(b"key00100"), bytearray(b"key00200")
        assert df.where((F.col("user_key") >= F.lit(low)) & (F.col("user_key") < F.lit(high))).count() == 100
        assert [r["seq"] for r in df.where(F.col("user_key") == F.lit(low)).collect()] == [100] and df.where(F.col("user_key") == F.lit(bytearray(b"key00100x"))).count() == 0
        reader = sst.FilteredTableReader({"path": str(tmp_path)})
        assert len(list(reader.pushFilters([sst.EqualTo(("user_key",), bytes(low)), sst.LessThan(("seq",), 5)]))) == 2 and reader.equal == bytes(low)
        assert [r[1] for r in reader.read(reader.partitions()[0])] == [100]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_stream_is_compacted_and_survives_a_replay(spark, tmp_path):
    schema = "user_key string, seq long, vtype int, value string"
    log = spark.createDataFrame([(f"k{i % 11}", i, int(i % 4 > 0), str(i)) for i in range(1, 300)], schema)
    log.repartition(8).write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    table, state = f"{tmp_path}/table", f"{tmp_path}/state"
    live.follow(stream, table, state, every=3).awaitTermination()
    want = {}
    for i in range(1, 300):
        want[f"k{i % 11}"] = str(i) if i % 4 else None
    want = {k: v for k, v in want.items() if v}
    read = lambda: {r["user_key"]: r["value"] for r in live.live(spark, table).collect()}
    assert read() == want and len([n for n in os.listdir(table) if n.startswith("batch=")]) < 8
    last = max(int(n) for n in os.listdir(f"{state}/commits") if n.isdigit())
    for n in (f"{last}", f".{last}.crc"):  # the last batch was written, its commit was not: it runs again
        os.remove(f"{state}/commits/{n}")
    live.follow(stream, table, state, every=3).awaitTermination()
    assert read() == want
    live.compact(spark, table)
    assert len([n for n in os.listdir(table) if n.startswith("batch=")]) == 2 and read() == want and live.compact(spark, table) == 0
    shutil.copytree(f"{table}/batch={last}", f"{table}/batch={last + 1}")
    merged = next(n for n in os.listdir(table) if n.endswith("-merged"))
    shutil.copytree(f"{table}/{merged}", f"{table}/{merged.removesuffix('-merged')}")  # a run that ended before its deletions
    assert read() == want and live.compact(spark, table) >= 1 and read() == want


def test_table_cache(tmp_path):
    from pyarrow import fs

    for number, name in ((1, "000001.ldb"), (2, "000002.sst"), (3, "000003.ldb")):
        (tmp_path / name).write_bytes(sst.encode_table([(b"k" + (number << 8 | 1).to_bytes(8, "little"), b"v%d" % number)], bits_per_key=10))
    held = sst.TableCache(fs.LocalFileSystem(), str(tmp_path), capacity=2)
    assert [held.get(i, b"k") for i in (1, 2, 3)] == [(i, 1, b"v%d" % i) for i in (1, 2, 3)] and set(held.held.table) == {2, 3}
    with pytest.raises(FileNotFoundError):
        held.get(4, b"k")
    (tmp_path / "000004.ldb").write_bytes(b"short")
    with pytest.raises(sst.TableError):
        held.get(4, b"k")
    (tmp_path / "000004.ldb").write_bytes(sst.encode_table([]))
    assert held.get(4, b"k") is None and list(held.scan(3, b"a"))[0][2] == b"v3"
    cursor = held.scan(2)
    next(cursor)
    held.evict(2)
    assert 2 not in held.held.table and list(cursor) == []


def test_batch_visitor():
    seen = []
    data = wal.encode_batch(7, [(1, b"a", b"1"), (0, b"b", None), (1, b"c", b"")])
    assert wal.visit_batch(data, lambda k, v: seen.append((k, v)), seen.append) == 7 and seen == [(b"a", b"1"), b"b", (b"c", b"")]
    seen.clear()
    with pytest.raises(ValueError, match="put"):
        wal.visit_batch(wal.encode_batch(7, [(1, b"a", b"1"), (1, b"c", b"xyz")])[:-1], lambda k, v: seen.append(k), seen.append)
    assert seen == [b"a"]
