import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strata.llm import simhash as s
from strata.llm.components import connected_components


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = [None, "", " \t ", "One", "one two THREE", "a b c d", "A b c d e f g", "É é   x y z w v", "w " * 10_000, "İ K ſ a b c d"]


def test_fingerprints():
    for t in TEXTS:
        assert s.fingerprint(t) == brute(t), t
    s.CHUNK, old = 7, s.CHUNK
    try:
        assert s.fingerprint("a b c d e f g h i j k l m n o p q r s t") == brute("a b c d e f g h i j k l m n o p q r s t")
    finally:
        s.CHUNK = old


def classes(ids, fps):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in zip(ids, fps, strict=True):
        for j, b in zip(ids, fps, strict=True):
            if i < j and (a ^ b).bit_count() <= 4:
                a_, b_ = root(i), root(j)
                parent[max(a_, b_)] = min(a_, b_)
    return {i: root(i) for i in ids}


def crowd(seed, n=250):
    """Fingerprints in chains and balls of near ones, with equal ones among them."""
    rng = random.Random(seed)
    out = []
    for _ in range(n // 10):
        at = rng.getrandbits(64)
        for _ in range(10):
            out.append(at)
            for _ in range(rng.choice([0, 1, 3, 4, 5])):
                at ^= 1 << rng.randrange(64)
    return out


@pytest.mark.parametrize("block", [1 << 12, 8])
def test_components(spark, block, monkeypatch):
    fps = crowd(block)
    base = fps[0]
    fps += [base ^ (1 << i) for i in range(64)] + [base ^ (1 << i) ^ (1 << (i + 1) % 64) for i in range(64)]  # a ball that fills its variants
    monkeypatch.setattr(s, "BLOCK", block)
    rows = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in s.components(rows).collect()}
    assert got == classes(list(range(len(fps))), fps)


def test_null_ids_take_part(spark):
    rows = [(None, 0b0), (4, 0b1111), (9, 0b11111111), (None, 1 << 40 | (1 << 62))]
    got = s.components(spark.createDataFrame(rows, "doc_id long, fp long")).collect()
    assert {(r["doc_id"], r["fp"]): r["component_id"] for r in got} == {(None, 0): 4, (4, 15): 4, (9, 255): 4, (None, 1 << 40 | 1 << 62): 4}


def test_query_columns(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)]
    got = s.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fps = {i: brute(t) for i, t in rows}
    want = classes(list(fps), list(fps.values()))
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, f"{fps[i]:016x}", want[i]) for i in fps}
    assert len(got) == len(rows)


def test_keep_one(spark):
    rows = [(5, "same words in this text here", "x"), (3, "same words in this text here", "y"), (3, "same words in this text here", "y"), (9, None, "z"), (8, "", "z"), (None, "", "n"), (None, "alone", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("_keep", F.lit(1))
    out = s.keep_one(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 0, 3, 8]
    assert s.keep_one(docs.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_connected_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(500, i) for i in range(501, 560)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert {i: got.get(i, i) for i in parent} == {i: root(i) for i in parent}


def test_wide_fingerprints():
    scheme = s.Scheme(5, 128, 8, 22)
    words = [f"w{i % 97}" for i in range(300)]
    parts = [" ".join(words[i : i + 5]).encode() for i in range(296)]
    low = np.array([xxhash.xxh64_intdigest(p, 42) for p in parts], np.uint64)
    want = [sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > 296) for h in (low, s._mixed(low))]
    assert s.fingerprint(" ".join(words), scheme).tolist() == want
    assert s.fingerprint("one", scheme).tolist()[0] == xxhash.xxh64_intdigest(b"one", 42)
    assert scheme.cuts == [(16 * i, 16) for i in range(8)] and s.EXACT.cuts == [(0, 22), (22, 21), (43, 21)]
    assert s.Scheme(5, 128, 3, 5).cuts == [(0, 43), (43, 43), (86, 42)]


@pytest.mark.parametrize(("segments", "block"), [(8, 1 << 12), (8, 8), (3, 1 << 12)])
def test_all_pairs_within_the_segments_reach(spark, segments, block, monkeypatch):
    """Up to 2 s - 1 unequal bits no pair is lost, also where a segment spans two words and where runs go by tiles."""
    monkeypatch.setattr(s, "BLOCK", block)
    scheme = s.Scheme(5, 128, segments, 2 * segments - 1)
    rng = random.Random(segments)
    values = []
    for _ in range(12):
        at = rng.getrandbits(128)
        for _ in range(12):
            values.append(at)
            for b in rng.sample(range(128), rng.choice([1, segments, 2 * segments - 1, 2 * segments + 1])):
                at ^= 1 << b
    signed = lambda x: int(np.uint64(x & (1 << 64) - 1).view(np.int64))
    rows = [(signed(v), signed(v >> 64), 1000 + i) for i, v in enumerate(values)]
    links = s.close_pairs(spark.createDataFrame(rows, "fp long, fp1 long, node long"), scheme)
    got = {r["node"]: r["component"] for r in connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).collect()}
    parent = {i: i for i in range(len(values))}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(values):
        for j, b in enumerate(values[:i]):
            if (a ^ b).bit_count() <= scheme.distance:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    assert {i: got.get(1000 + i, 1000 + i) - 1000 for i in parent} == {i: root(i) for i in parent}


def test_stage_takes_near_copies_and_leaves_others(spark):
    """Of pairs with a five-word similarity from 0.9 on nearly all, of pairs below 0.5 hardly any."""
    rng = random.Random(1)
    rows, want = [], 0
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join([*words[:200], "new", *words[201:]])), (3 * i + 2, " ".join(x if j % 8 else "other" for j, x in enumerate(words)))]
    kept = {r["doc_id"] for r in s.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {3 * i for i in range(60)} <= kept
    assert sum(3 * i + 1 in kept for i in range(60)) <= 2 and sum(3 * i + 2 in kept for i in range(60)) >= 55


def apart(rng, value, bits):
    """The value with so many bits turned, evenly over its eight pieces of 16 bits."""
    turned = [b for k, n in enumerate([bits // 8 + (i < bits % 8) for i in range(8)]) for b in rng.sample(range(16 * k, 16 * k + 16), n)]
    return value ^ sum(1 << b for b in turned)


def groups_of(values, distance):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(values):
        for j, b in enumerate(values[:i]):
            if (a ^ b).bit_count() <= distance:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in parent]


def as_words(values):
    return np.array([[v & (1 << 64) - 1, v >> 64] for v in values], np.uint64)


@pytest.mark.parametrize(("alone", "tiles", "tile"), [(1 << 12, 16, 1 << 19), (8, 3, 1 << 19), (8, 1, 40)])
def test_close_pairs_without_a_common_variant_are_linked(spark, alone, tiles, tile, monkeypatch):
    """Pairs of 16 to 22 bits, two or more in each segment, are close; those of 23 are not."""
    for name, x in (("ALONE", alone), ("TILES", tiles), ("TILE", tile)):
        monkeypatch.setattr(s, name, x)
    rng = random.Random(tiles)
    values = [v for bits in [*range(15, 24), 22, 23, 30] for at in [rng.getrandbits(128)] for v in (at, apart(rng, at, bits), apart(rng, apart(rng, at, 12), 12))]
    rows = [(*(int(w) for w in row.view(np.int64)), 1000 + i) for i, row in enumerate(as_words(values))]
    links = s.close_pairs(spark.createDataFrame(rows, "fp long, fp1 long, node long"), s.SIMILAR)
    got = {r["node"]: r["component"] for r in connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).collect()}
    assert [got.get(1000 + i, 1000 + i) - 1000 for i in range(len(values))] == groups_of(values, 22)


@pytest.mark.parametrize("lookup", [0, 1 << 34])
@pytest.mark.parametrize("split", [None, 0, 150, 400])
def test_joined_is_what_all_pairs_join(lookup, split, monkeypatch):
    """By looking pieces up as by comparing all, with a crowd of near ones, chains, and ones that meet at 22 bits or miss at 23."""
    monkeypatch.setattr(s, "LOOKUP", lookup)
    monkeypatch.setattr(s, "PAIRS", 1 << 9)
    rng = random.Random(3)
    crowd = rng.getrandbits(128)
    values = [crowd ^ sum(1 << b for b in rng.sample(range(128), rng.randrange(1, 7))) for _ in range(120)]
    for bits in [*range(14, 25)] * 4:
        at = rng.getrandbits(128)
        values += [at, apart(rng, at, bits), apart(rng, apart(rng, at, bits), 22)]
    values += [apart(rng, crowd, 21) for _ in range(8)] + [rng.getrandbits(128) for _ in range(140)]
    values = list(dict.fromkeys(values))
    rng.shuffle(values)
    found = s._joined(as_words(values), s.SIMILAR, split)
    assert all((values[a] ^ values[b]).bit_count() <= 22 for x, y in found.links for a, b in zip(x, y, strict=True))
    if split is None:
        assert found.label.tolist() == groups_of(values, 22) and sum(len(x) for x, _ in found.links) == len(values) - len(set(found.label.tolist()))
    else:
        assert all(found.label[i] == found.label[j] for i in range(split) for j in range(split, len(values)) if (values[i] ^ values[j]).bit_count() <= 22)


def test_radii_reach_the_distance():
    for scheme in (s.SIMILAR, s.EXACT, s.Scheme(5, 128, 8, 3), s.Scheme(5, 256, 8, 40)):
        assert sum(r + 1 for r in s._radii(scheme)) == scheme.distance + 1 and len(s._radii(scheme)) == scheme.bits // 16
    assert [len(s._masks(r)) for r in (-1, 0, 1, 2)] == [0, 1, 17, 137]


def test_keep_one_on_pairs_without_a_common_variant(spark):
    """Documents of 18 to 20 unequal bits, of which every segment has two or more."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id in (571, 5622, 736, 4389, 2734, 9602)")
    assert sorted(r["doc_id"] for r in s.keep_one(docs).collect()) == [571, 736, 2734]
