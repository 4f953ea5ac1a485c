import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata.functions import bloom, codec, keys
from strata.schema import Options
from strata.sources import bytesum, filterblock


def one(spark, expr, **columns):
    row = spark.createDataFrame([tuple(v for v, _ in columns.values())], ", ".join(f"{k} {t}" for k, (_, t) in columns.items()))
    return row.select(expr.alias("x")).head()["x"]


@pytest.mark.parametrize(
    ("data", "want"),
    [("", 0xBC9F1D34), ("62", 0xEF1345C4), ("c397", 0x5B663814), ("e299a5", 0x323C078F), ("e180b932", 0xED21633A)],
)
def test_hash(spark, data, want):
    assert one(spark, codec.hash32(F.col("b")), b=(bytearray.fromhex(data), "binary")) == want


@pytest.mark.parametrize(
    ("data", "want"),
    [(bytes(32), 0x8A9136AA), (bytes(range(32)), 0x46DD794E), (bytes(range(31, -1, -1)), 0x113FDB5C), (b"\xff" * 32, 0x62A8AB43), (b"", 0)],
)
def test_crc(spark, data, want):
    b = {"b": (bytearray(data), "binary")}
    assert one(spark, codec.crc32c(F.col("b")), **b) == want == bytesum.crc32c(data)
    assert one(spark, codec.unmask_crc(codec.mask_crc(codec.crc32c(F.col("b")))), **b) == want
    assert one(spark, codec.mask_crc(codec.crc32c(F.col("b"))), **b) == bytesum.masked(want)


def test_crc_extends(spark):
    whole = codec.crc32c(F.lit("hello world").cast("binary"))
    parts = codec.crc32c(F.lit("world").cast("binary"), codec.crc32c(F.lit("hello ").cast("binary")))
    assert spark.range(1).select(whole == parts).head()[0]


def test_varints(spark):
    numbers = [0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**32 - 1, 2**35, 2**55 - 2, 2**63 - 1, -1, -(2**63)]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long")
    n = F.col("n")
    out = rows.select("n", codec.varint(n).alias("v"), codec.varint_length(n).alias("k"), codec.fixed(n, 8).alias("f"), codec.read_fixed(codec.fixed(n, 8), 8).alias("back")).collect()
    for r in out:
        assert bytes(r["v"]) == bytesum.put_varint(r["n"] % 2**64)
        assert r["k"] == len(r["v"])
        assert bytes(r["f"]) == (r["n"] % 2**64).to_bytes(8, "little")
    some = [n for n in numbers if 0 <= n < 2**56]
    back = spark.createDataFrame([(n,) for n in some], "n long").select("n", codec.read_varint(codec.varint(n)).alias("b")).collect()
    assert all(r["n"] == r["b"] for r in back)
    cut = one(spark, codec.read_varint(F.col("b")), b=(bytearray(b"\x80\x80"), "binary"))
    assert cut is None


def test_length_prefixed(spark):
    rows = spark.createDataFrame([(bytearray(x),) for x in (b"", b"a", b"x" * 200)], "b binary")
    back = rows.select("b", codec.read_length_prefixed(codec.length_prefixed(F.col("b"))).alias("r"), codec.read_length_prefixed(F.lit(b"\x05ab")).alias("cut")).collect()
    assert all(bytes(r["b"]) == bytes(r["r"]) and r["cut"] is None for r in back)


@pytest.mark.parametrize(("a", "b", "want"), [(b"abcdef", b"abghijk", b"abd"), (b"xcvmnz", b"z", b"y"), (b"foo", b"foobar", b"foo"), (b"foobar", b"foo", b"foobar"), (b"\xff\xff", b"\xff\xff\xff", b"\xff\xff")])
def test_separator(spark, a, b, want):
    got = one(spark, keys.shortest_separator(F.col("a"), F.col("b")), a=(bytearray(a), "binary"), b=(bytearray(b), "binary"))
    assert bytes(got) == want


@pytest.mark.parametrize(("a", "want"), [(b"abcde", b"b"), (b"\xff", b"\xff"), (b"\x00", b"\x01"), (b"\xff\x7fa", b"\xff\x80"), (b"", b"")])
def test_successor(spark, a, want):
    assert bytes(one(spark, keys.short_successor(F.col("a")), a=(bytearray(a), "binary"))) == want


def test_internal_keys(spark):
    key = keys.internal_key(F.lit(b"foo"), F.lit(100).cast("long"), F.lit(1))
    r = spark.range(1).select(keys.parse_internal_key(key).alias("k"), keys.parse_internal_key(F.lit(b"short")).alias("s")).head()
    assert (bytes(r["k"]["user_key"]), r["k"]["seq"], r["k"]["vtype"], r["k"]["is_valid"]) == (b"foo", 100, 1, True)
    assert not r["s"]["is_valid"]


def test_comparators(spark):
    rows = spark.createDataFrame([("[10]",), ("[0xa]",), ("[9]",), ("[0x14]",)], "k string").withColumn("s", keys.sort_key("numeric", F.col("k").cast("binary")))
    by = {r["k"]: bytes(r["s"]) for r in rows.collect()}
    assert by["[10]"] == by["[0xa]"] and by["[9]"] < by["[10]"] < by["[0x14]"]
    back = spark.createDataFrame([(bytearray(b"ab"),)], "k binary").select(keys.sort_key("reverse", F.col("k")).alias("s")).head()["s"]
    assert bytes(back) == b"ba"


def test_bloom_never_misses(spark):
    held = spark.range(2000).select((F.col("id") % 3).alias("g"), F.format_string("key%d", "id").alias("user_key"))
    filters = bloom.bitmaps(held, ["g"])
    assert bloom.probe(held, filters, ["g"]).where("not may_match").count() == 0
    absent = spark.range(3000).select((F.col("id") % 3).alias("g"), F.format_string("other%d", "id").alias("user_key"))
    assert bloom.probe(absent, filters, ["g"]).where("may_match").count() < 60
    missing = spark.createDataFrame([(9, "key1")], "g long, user_key string")
    assert not bloom.probe(missing, filters, ["g"]).head()["may_match"]


def test_bloom_encoded(spark):
    held = spark.createDataFrame([(b"hello",), (b"world",)], "k binary")
    bits = [p for r in held.select(bloom.positions(F.col("k"), F.lit(64).cast("long"), 10).alias("p")).collect() for p in r["p"]]
    encoded = bloom.encode(bits, 64)
    asked = spark.createDataFrame([("hello",), ("world",), ("x",), ("foo",)], "k string")
    got = {r["k"]: r["m"] for r in asked.select("k", bloom.may_match(F.col("k").cast("binary"), F.lit(encoded)).alias("m")).collect()}
    assert got == {"hello": True, "world": True, "x": False, "foo": False}
    assert not one(spark, bloom.may_match(F.lit(b"a"), F.col("f")), f=(None, "binary"))


def test_options_are_clamped():
    o = Options(max_open_files=1, write_buffer=1, max_file_size=1, block_size=1 << 30).clamped()
    assert (o.max_open_files, o.write_buffer, o.max_file_size, o.block_size) == (74, 64 << 10, 1 << 20, 4 << 20)


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 2**64 - 1))
def test_python_varints(n):
    data = bytesum.put_varint(n)
    assert bytesum.take_varint(data, 0) == (n, len(data))


def test_file_names(spark):
    for kind, want in (("log", "000192.log"), ("table", "000192.ldb"), ("temp", "000192.dbtmp"), ("manifest", "MANIFEST-000192")):
        row = spark.createDataFrame([(192,), (12345678,)], "n long").select("n", keys.file_name(kind, F.col("n")).alias("name"))
        out = {r["n"]: r for r in row.select("n", "name", keys.file_kind(F.col("name")).alias("k"), keys.file_number(F.col("name")).alias("b")).collect()}
        assert out[192]["name"] == want and all(r["k"] == kind and r["b"] == n for n, r in out.items())
    names = ["foo", "foo-dx-100.log", ".log", "manifest", "CURREN", "MANIFEST", "MANIFEST-", "XMANIFEST-3", "MANIFEST-3x", "LOC", "100", "100.", "100.lop", "184467440737095516150.log"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    assert all(r[0] is None for r in rows.select(keys.file_number(F.col("n"))).collect())


def test_status_and_records(spark):
    rows = spark.createDataFrame([("OK", ""), ("NOT_FOUND", "k"), ("CORRUPTION", "x"), ("?", "")], "c string, m string")
    assert [r[0] for r in rows.select(keys.status_text(F.col("c"), F.col("m"))).collect()] == ["OK", "NotFound: k", "Corruption: x", None]
    codes = spark.range(6).select(codec.record_type(F.col("id")))
    assert [r[0] for r in codes.collect()] == ["zero", "full", "first", "middle", "last", "unknown"]
    handle = spark.range(1).select(codec.block_handle(F.lit(300), F.lit(5)).alias("h")).head()["h"]
    assert bytes(handle) == bytesum.put_varint(300) + bytesum.put_varint(5)


def test_checksums_by_lanes_and_columns():
    """Long strings by lanes and many strings side by side equal the byte-by-byte definition."""
    rng = random.Random(6)
    rows = [rng.randbytes(n) for n in (*range(40), 2047, 2048, 2049, 5000, 70_001)] * 2 + [None, b""]

    def plain(data, crc=0):
        crc ^= bytesum.MASK32
        for b in data:
            crc = bytesum._TABLE[(crc ^ b) & 255] ^ (crc >> 8)
        return crc ^ bytesum.MASK32

    want = [plain(r or b"") for r in rows]
    assert [bytesum.crc32c(r or b"") for r in rows] == want == bytesum.crc32c_of(pa.array(rows, pa.binary())).tolist()
    assert bytesum.crc32c(rows[44], 77) == plain(rows[44], 77)
    starts = np.array([rng.getrandbits(32) for _ in rows])
    sliced = pa.array([b"zz", *rows], pa.binary()).slice(1)
    assert bytesum.crc32c_of(sliced, starts).tolist() == [plain(r or b"", int(s)) for r, s in zip(rows, starts, strict=True)]
    assert bytesum.hash32_of(sliced).tolist() == [filterblock.hash32(r or b"") for r in rows]
    assert len(bytesum.crc32c_of(pa.array([], pa.binary()))) == 0 == len(bytesum.hash32_of(pa.array([], pa.binary())))


def test_bloom_in_parts(spark):
    """A filter that is larger than one bitmap."""
    held = spark.range(10_000).select(F.lit(1).alias("g"), F.format_string("key%d", "id").alias("user_key"))
    filters = bloom.bitmaps(held, ["g"])
    assert filters.count() == 4
    assert bloom.probe(held, filters, ["g"]).where("not may_match").count() == 0
    absent = held.select("g", F.concat("user_key", F.lit("x")).alias("user_key"))
    assert bloom.probe(absent, filters, ["g"]).where("may_match").count() < 200


def test_null_bytes(spark):
    assert one(spark, codec.crc32c(F.col("b")), b=(None, "binary")) is None and one(spark, codec.hash32(F.col("b")), b=(None, "binary")) is None


def test_internal_keys_are_taken_apart_without_lambdas(spark):
    """Functions over arrays are interpreted, and with them all of their arguments, for each row."""
    seqs = [0, 1, 255, 256, (1 << 40) + 77, (1 << 55) - 2]
    rows = spark.createDataFrame([(s, t, b"k" * (s % 12)) for s in seqs for t in (0, 1, 7)], "s long, t int, u binary")
    whole = keys.internal_key(F.col("u"), F.col("s"), F.col("t"))
    for column in (F.lit(None).cast("binary"), F.substring(whole, 1, 7)):
        for r in rows.where("length(u) = 0").select(keys.parse_internal_key(column).alias("k")).collect():
            assert (r["k"]["seq"], r["k"]["vtype"], r["k"]["is_valid"]) == (None, None, False)
    found = rows.select("s", "t", "u", keys.parse_internal_key(whole).alias("k"))
    for r in found.collect():
        assert (bytes(r["k"]["user_key"]), r["k"]["seq"], r["k"]["vtype"], r["k"]["is_valid"]) == (bytes(r["u"]), r["s"], r["t"], r["t"] < 2)
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    words = spark.createDataFrame([(-1,), (-(1 << 63),), ((1 << 63) - 1,), (0x1234,)], "x long")
    both = words.select("x", codec.fixed(F.col("x"), 4).alias("a"), codec.fixed(F.col("x"), 8).alias("b"), codec.read_fixed(codec.fixed(F.col("x"), 8), 8).alias("y"), codec.read_fixed(codec.fixed(F.col("x"), 4), 4).alias("z"))
    for r in both.collect():
        assert bytes(r["b"]) == (r["x"] % (1 << 64)).to_bytes(8, "little") and bytes(r["a"]) == (r["x"] % (1 << 32)).to_bytes(4, "little")
        assert r["y"] == r["x"] and r["z"] == r["x"] % (1 << 32)
