import base64
import gzip
import hashlib
import io

import pytest

from strata.llm import warc as w

SCHEMA = "page_id long, url string, html string"


def test_round_trip(spark):
    rows = [(1, "http://a/é x", "<p>é</p>"), (2, "u", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "u\r\nX: y", "z" * 300_000), (7, "u", "\r\n\r\n"), (9, "u", "<p>é</p>"), (9, "u", "<p>é</p>"), (None, "u", "q")]
    got = w.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
    html = {i: (h or "").encode() for i, _, h in rows}
    assert len(got) == len(rows)
    for r in got:
        data = html[r["page_id"]]
        last = max((i for i, d in html.items() if d == data and i is not None), default=None)
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        if r["page_id"] == last or last is None:
            assert (r["record_type"], r["refers_to"]) == ("response", None)
        else:
            assert (r["record_type"], r["refers_to"]) == ("revisit", last)


def test_least_and_payloads(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], SCHEMA)
    paths = w.write_archives(pages, f"file://{tmp_path}/warc", least=3)
    out = {int(r["page_id"]): r for r in w.read_archives(paths, payloads=True).collect()}
    assert [out[i]["record_type"] for i in (1, 2, 3, 4)] == ["response", "response", "revisit", "response"]
    assert bytes(out[1]["payload"]) == b"ab" and bytes(out[4]["payload"]) == b"abc" and bytes(out[3]["payload"]) == b""


def test_empty(spark):
    assert w.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_members_are_gzip():
    one, two = w.record(1, "u", b"hello", None), w.record(2, "u", b"hello", 1)
    assert gzip.decompress(one + two).count(b"WARC/1.1") == 2
    got = list(w.read_records(io.BytesIO(one + two), payloads=True))
    assert [r.payload for r in got] == [b"hello", b""] and got[1].payload_bytes == 5


def test_damage():
    good = w.record(1, "u", b"hello" * 100, None)
    plain = gzip.decompress(good)
    for bad, why in (
        (good[:-20], "ends within|shorter"),
        (gzip.compress(plain.replace(b"hellohello", b"hellohullo", 1)), "digest"),
        (gzip.compress(plain.replace(b"\r\n\r\n", b"\r\n", 1)), "."),
        (gzip.compress(plain + b"x"), "does not end"),
        (gzip.compress(b"no record here\r\n\r\n\r\n\r\n"), "begin"),
    ):
        with pytest.raises((w.WarcError, KeyError, ValueError), match=why):
            list(w.read_records(io.BytesIO(bad)))


def test_very_long_headers(spark):
    url = "é" * 200_000  # over 1 MiB once it is quoted
    got = w.round_trip(spark.createDataFrame([(1, url, "x"), (2, url, "x")], SCHEMA)).collect()
    assert sorted((r["page_id"], r["record_type"], r["payload_bytes"]) for r in got) == [(1, "revisit", 1), (2, "response", 1)]
    r = next(iter(w.read_records(io.BytesIO(w.record(1, url, b"y", None)))))
    assert len(r.fields["warc-target-uri"]) == 1_200_000
