"""SimHash near-duplicates: deletion-variant signatures over few segments.

Two 64-bit fingerprints that differ in at most four bits differ in at most one bit in at
least one of three segments. Every fingerprint is therefore indexed under, per segment, each
variant of the segment with one bit replaced by a wildcard (64 variants in all). Fingerprints
under an equal variant are compared in full; a variant with m fingerprints yields at most
m - 1 links, a spanning forest of its close pairs, which leaves the components unchanged.

A ``Scheme`` says how wide fingerprints are, how they are cut and which are close. With s segments
all pairs of up to 2 s - 1 unequal bits share a variant. Where close ones may differ in more, blocks of
fingerprints meet in tiles instead, and a tile looks up, for each piece of 16 bits, the pieces in reach:
radii that add up to the distance, so that a pair beyond its radius in every piece is not close. No
close pair is lost either way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.common import materialize
from strata.llm.components import connected_components, with_least

SEED = 42
#: Shingles whose bits are counted at a time, and fingerprints of one variant compared in one task.
CHUNK, BLOCK = 1 << 15, 1 << 12
#: Where blocks of fingerprints meet in tiles: there are so many blocks, or more that none holds much over so many, but one of
#: few fingerprints; pairs that are compared at a time, and pairs of a tile from which on it looks pieces up.
TILES, TILE, ALONE, PAIRS, LOOKUP = 16, 1 << 19, 1 << 12, 1 << 16, 1 << 34


@dataclass(frozen=True)
class Scheme:
    """Words in a shingle; bits of a fingerprint, a multiple of 64; the number of its segments, the longer ones
    first; unequal bits of close fingerprints."""

    shingle: int = 4
    bits: int = 64
    segments: int = 3
    distance: int = 4

    @property
    def columns(self) -> list[str]:
        """A fingerprint's 64-bit words, the lowest first."""
        return ["fp", *(f"fp{i}" for i in range(1, self.bits // 64))]

    @property
    def cuts(self) -> list[tuple[int, int]]:
        """(first bit, bits) of each segment; a segment may span two words."""
        sizes = [self.bits // self.segments + (i < self.bits % self.segments) for i in range(self.segments)]
        return list(zip(accumulate(sizes, initial=0), sizes, strict=False))


#: Four bits of 64 over four-word shingles, and for whole corpora five-word shingles and a similarity from 0.8 on: two sets
#: of shingles of similarity s have directions of cosine 2 s / (1 + s), which at 0.8 differ in 0.15 of all bits on average.
EXACT, SIMILAR = Scheme(), Scheme(5, 128, 8, 22)


def fingerprint(text: str | None, scheme: Scheme = EXACT) -> np.ndarray:
    """The fingerprint as 64-bit words; a null text or one without words has 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return np.zeros(scheme.bits // 64, np.uint64)
    width = min(scheme.shingle, len(words))
    n = len(words) - width + 1
    ones = np.zeros(scheme.bits, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, CHUNK):
        upto = min(at + CHUNK, n)
        shifted = [words[at + i : upto + i] for i in range(width)]
        hashes = np.fromiter((digest(join(x), SEED) for x in zip(*shifted, strict=True)), np.uint64, upto - at)
        for k in range(scheme.bits // 64):
            hashes = _mixed(hashes) if k else hashes
            ones[64 * k : 64 * k + 64] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, bitorder="little").view(np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Further 64 bits of hashes, by odd multipliers and shifts."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", scheme: Scheme = EXACT) -> DataFrame:
    """``(doc_id, fp...)``, its words as signed longs, for every row."""
    names = scheme.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), scheme) for t in b.column(1)], np.uint64).reshape(-1, len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(fps[:, i]) for i in range(len(names)))], ["doc_id", *names])

    made = ", ".join(f"{c} long" for c in names)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id long, {made}")


def _variants(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """One row per node and wildcard bit: the segment without that bit, under the bit's number."""
    keys = []
    for first, bits in scheme.cuts:
        word, low = divmod(first, 64)
        segment = F.shiftrightunsigned(scheme.columns[word], low)
        if low + bits > 64:
            segment = segment.bitwiseOR(F.shiftleft(scheme.columns[word + 1], 64 - low))
        keys += [F.lit((first + i) << 32) + segment.bitwiseAND(F.lit(((1 << bits) - 1) & ~(1 << i))) for i in range(bits)]
    return nodes.select(*nodes.columns, F.explode(F.array(*keys)).alias("key"))


def _unequal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unequal bits of fingerprints, row by row."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _forest(values: np.ndarray, nodes: np.ndarray, distance: int, split: int | None = None) -> list[tuple[int, int]]:
    """Links that join what close pairs join: among all ``values``, or between the first ``split`` and the others."""
    parent = np.arange(len(values))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for i in range(len(values) if split is None else split):
        lo = i + 1 if split is None else split
        near = lo + np.flatnonzero(_unequal(values[lo:], values[i]) <= distance)
        near = near[parent[near] != parent[i]]
        for j in near:
            a, b = root(i), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((int(nodes[i]), int(nodes[j])))
    return links


class _Groups:
    """What links have joined so far: a label per row, the least row of its group, and the links that joined groups."""

    def __init__(self, n: int):
        self.label, self.links = np.arange(n), []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            at = np.flatnonzero(low != high)
            if not len(at):
                return
            at = at[np.lexsort((low[at], high[at]))]
            one = at[np.r_[True, high[at[1:]] != high[at[:-1]]]]  # of the links of a label the one to the least
            to = np.arange(len(self.label))
            to[high[one]] = low[one]
            while (to[to] != to).any():
                to = to[to]
            self.label = to[self.label]
            self.links.append((a[one], b[one]))
            a, b = a[at], b[at]


def _masks(radius: int) -> np.ndarray:
    """The numbers of 16 bits of which at most ``radius`` are set, those of fewer first."""
    every = np.arange(1 << 16)
    ones = np.bitwise_count(every)
    return np.concatenate([every[ones == r] for r in range(radius + 1)]) if radius >= 0 else every[:0]


def _radii(scheme: Scheme) -> list[int]:
    """Per piece of 16 bits the unequal bits that are looked up; -1 for none. Each radius and one more make distance + 1."""
    n = scheme.bits // 16
    most, more = divmod(scheme.distance + 1, n)
    return [most - (i >= more) for i in range(n)]


def _by_piece(key: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows in the order of their pieces, of a piece by group and its largest group last; per piece the first row and the
    end, and the largest group's rows and label."""
    by = np.lexsort((label, key))
    runs = np.flatnonzero(np.r_[True, (key[by[1:]] != key[by[:-1]]) | (label[by[1:]] != label[by[:-1]])])
    sizes = np.diff(np.r_[runs, len(by)])
    size = np.empty(len(by), np.int64)
    size[by] = np.repeat(sizes, sizes)
    by = np.lexsort((label, size, key))
    counts = np.bincount(key, minlength=1 << 16)
    ends, held = np.cumsum(counts), np.flatnonzero(counts)
    most, whose = np.zeros(1 << 16, np.int64), np.full(1 << 16, -1)
    most[held], whose[held] = size[by[ends[held] - 1]], label[by[ends[held] - 1]]
    return by, ends - counts, ends, most, whose


def _joined(values: np.ndarray, scheme: Scheme, split: int | None = None) -> _Groups:
    """Groups that all close pairs join: among all ``values``, or between the first ``split`` and the others, where close
    pairs on one side may be joined too."""
    groups, found, held = _Groups(len(values)), [], 0
    first = np.arange(len(values) if split is None else split)
    other = first if split is None else np.arange(split, len(values))
    if not len(first) or not len(other):
        return groups
    sums = np.uint8 if scheme.bits < 256 else np.uint16

    def flush() -> None:
        nonlocal held
        if found:
            groups.join(*(np.concatenate(x) for x in zip(*found, strict=True)))
            found.clear()
            held = 0

    def compare(a: np.ndarray, b: np.ndarray, words: list[np.ndarray], among: np.ndarray | slice) -> None:
        """Every row of ``a`` with those of ``b``, whose words are given, ``among`` which it looks."""
        nonlocal held
        words = [w[among] for w in words]
        n = len(words[0])
        step = max(1, PAIRS // n)
        for at in range(0, len(a), step):
            own = values[a[at : at + step]]
            apart = np.bitwise_count(own[:, :1] ^ words[0]).astype(sums, copy=False)
            for k in range(1, len(words)):
                apart += np.bitwise_count(own[:, k : k + 1] ^ words[k])
            near = apart <= scheme.distance
            if near.any():
                i, j = np.divmod(np.flatnonzero(near), n)
                i, j = a[at + i], b[among][j]
                found.append((i[i != j], j[i != j]))
                held += len(found[-1][0])
                if held > PAIRS:
                    flush()

    if len(first) * len(other) <= LOOKUP:
        step, words = max(1, len(first) // 16), list(values[other].T.copy())
        for at in range(0, len(first), step):
            compare(first[at : at + step], other, words, slice(at if split is None else 0, None))  # each pair once, nearly
        flush()
        return groups
    pieces = values.view(np.uint16)  # the order of the bytes only says which bits are a piece
    for piece in pieces.T:  # neighbours first, so that a crowd is one group before its pairs are looked up
        by = np.argsort(piece, kind="stable")
        for d in (1, 2):
            near = _unequal(values[by[:-d]], values[by[d:]]) <= scheme.distance
            groups.join(by[:-d][near], by[d:][near])
    for piece, radius in zip(pieces.T, _radii(scheme), strict=True):
        masks, steps = _masks(radius), np.arange(len(other))
        rows, begin, end, most, whose = right = _by_piece(piece[other], groups.label[other])
        rows_, begin_, end_, most_, whose_ = right if split is None else _by_piece(piece[first], groups.label[first])
        left, right, words = first[rows_], other[rows], list(values[other[rows]].T.copy())
        for g in np.flatnonzero(end_ > begin_).tolist():
            there = masks ^ g
            if split is None:
                there = there[there >= g]  # each pair of pieces once
            there = there[end[there] > begin[there]]
            crowd = end_[g] - (most_[g] if most_[g] > 32 else 0)
            for at, to in ((begin_[g], crowd), (crowd, end_[g])):
                if at == to:
                    continue
                count = end[there] - begin[there]
                if at == crowd:  # a large group passes over its own rows
                    count -= np.where(whose[there] == whose_[g], most[there], 0)
                ends = count.cumsum()
                if len(ends) and ends[-1]:
                    compare(left[at:to], right, words, steps[: ends[-1]] + (begin[there] - ends + count).repeat(count))
        flush()
    return groups


def _close_in_runs(scheme: Scheme):
    """Rows ``(key, fp..., node)`` sorted by key -> links, and the rows of runs over BLOCK to be compared by tiles.
    Without a column for it, the node is the fingerprint's only word.

    Short runs are compared at once for all runs of a batch, by the distance in the sorted
    order; the last run of a batch waits for the next batch.
    """
    words, most = len(scheme.columns), scheme.distance
    names = ["a", "b", "key", "block", *scheme.columns]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 2
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), *(pa.nulls(len(rows), pa.int64()) for _ in names[2:])], names)

    def passed_on(fps: np.ndarray, nodes: np.ndarray, key: int, block: int) -> pa.RecordBatch:
        n = len(nodes)
        own = [pa.array(fps[:, i].view(np.int64)) for i in range(words)]
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.nulls(n, pa.int64()), pa.array(np.full(n, key)), pa.array(np.full(n, block)), *own], names)

    def within(keys: np.ndarray, fps: np.ndarray, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        short = np.repeat(sizes <= 32, sizes)
        rows = []
        for d in range(1, min(32, int(sizes[sizes <= 32].max(initial=1)))):
            i = np.flatnonzero(short[:-d] & (keys[d:] == keys[:-d]))
            if not len(i):
                break
            i = i[_unequal(fps[i], fps[i + d]) <= most]
            rows += zip(nodes[i].tolist(), nodes[i + d].tolist(), strict=True)
        for at, n in zip(starts[sizes > 32], sizes[sizes > 32], strict=True):
            rows += _forest(fps[at : at + n], nodes[at : at + n], most)
        if rows:
            yield out(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, done = None, [], 0  # the run that is still open; blocks of it that have been passed on

        def held() -> tuple[np.ndarray, np.ndarray]:
            return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal parts, done
            if parts:
                fps, nodes = held()
                if done:
                    yield passed_on(fps, nodes, key, done)
                elif len(nodes) > 1:
                    yield from within(np.zeros(len(nodes), np.int64), fps, nodes)
            parts, done = [], 0

        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).to_numpy()
            fps = np.stack([b.column(1 + i).to_numpy() for i in range(words)], axis=1).view(np.uint64)
            nodes = b.column(b.num_columns - 1).to_numpy()
            head = int(np.searchsorted(keys, keys[0], "right")) if keys[0] == key else 0
            tail = int(np.searchsorted(keys, keys[-1], "left"))
            if head:
                parts.append((fps[:head], nodes[:head]))
            if head < len(keys):
                yield from close()
                if head < tail:
                    yield from within(keys[head:tail], fps[head:tail], nodes[head:tail])
                at = max(head, tail)
                key, parts = int(keys[-1]), [(fps[at:], nodes[at:])]
            while sum(len(x) for x, _ in parts) > BLOCK:
                fps_, nodes_ = held()
                yield passed_on(fps_[:BLOCK], nodes_[:BLOCK], key, done)
                parts, done = [(fps_[BLOCK:], nodes_[BLOCK:])], done + 1
        yield from close()

    return run


def _tile(scheme: Scheme):
    """Tiles of a run whose rows share a variant -> links."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("own", "descending")])
        values = np.stack([group[c].to_numpy() for c in scheme.columns], axis=1).view(np.uint64)
        own = int(np.count_nonzero(group["own"].to_numpy()))
        links = _forest(values, group["node"].to_numpy(), scheme.distance, own if own < len(values) else None)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def _whole_tile(scheme: Scheme):
    """Tiles of any two blocks, or of one with itself -> links."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("own", "descending")])
        values = np.stack([group[c].to_numpy() for c in scheme.columns], axis=1).view(np.uint64)
        nodes, own = group["node"].to_numpy(), int(np.count_nonzero(group["own"].to_numpy()))
        links = _joined(values, scheme, own if own < len(values) else None).links
        a, b = (np.concatenate([x[k] for x in links]) if links else np.zeros(0, np.int64) for k in (0, 1))
        if own < len(values):  # what is close within a block is found where the block meets itself
            across = (a < own) != (b < own)
            a, b = a[across], b[across]
        return pa.table({"a": pa.array(nodes[a], pa.int64()), "b": pa.array(nodes[b], pa.int64())})

    return run


def _tiled_pairs(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """As ``close_pairs``, of all close pairs whatever they share: every two blocks of fingerprints are compared."""
    n = nodes.count()
    blocks = max(TILES if n > ALONE else 1, -(-n // TILE))
    cut = nodes.select(*scheme.columns, F.col(nodes.columns[-1]).alias("node"), F.pmod(F.xxhash64(*scheme.columns), F.lit(blocks)).alias("block"))
    met = cut.select("*", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("other"))
    met = met.select("node", *scheme.columns, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("own"))
    return met.groupBy("i", "j").applyInArrow(_whole_tile(scheme), "a long, b long").distinct()


def close_pairs(nodes: DataFrame, scheme: Scheme = EXACT) -> DataFrame:
    """Distinct fingerprints ``(fp...)`` or ``(fp..., node)`` -> links ``(a, b)`` of nodes whose components are those of
    all close pairs."""
    if scheme.distance >= 2 * scheme.segments:  # close pairs need not share a variant
        return _tiled_pairs(nodes, scheme)
    kinds = ", ".join(f"{c} long" for c in ["a", "b", "key", "block", *scheme.columns])
    spread = _variants(nodes, scheme).repartition("key").sortWithinPartitions("key").select("key", *nodes.columns)
    found = materialize(spread.mapInArrow(_close_in_runs(scheme), kinds), "close")
    large = found.where("b is null").select(F.col("a").alias("node"), "key", "block", *scheme.columns)
    links = found.where("b is not null").select("a", "b")
    if not large.isEmpty():
        last = large.groupBy("key").agg(F.max("block").alias("last"))
        met = large.join(last, "key").select("*", F.explode(F.expr("sequence(0L, last)")).alias("other"))
        met = met.select("node", *scheme.columns, "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("own"))
        links = links.union(met.groupBy("key", "i", "j").applyInArrow(_tile(scheme), "a long, b long"))
    return links.distinct()


def components(fps: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` -> ``(doc_id, fp, component_id)``, with the smallest doc_id reachable.

    Equal fingerprints are one class, so copies are never compared with each other. A null
    doc_id takes part by its fingerprint and is never a component's id unless all are null.
    """
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "classes")
    reached = connected_components(close_pairs(classes.select("fp")).select(F.col("a").alias("u"), F.col("b").alias("v")))
    labelled = materialize(classes.join(reached.withColumnRenamed("node", "fp"), "fp", "left"), "labelled")
    # most classes are their own; the others meet the least id of their component by way of its root, salted
    moved, own = labelled.where("component is not null"), labelled.where("component is null")
    groups = moved.groupBy("component").agg(F.min("least_id").alias("among"), F.lit(True).alias("shared"))
    roots = materialize(own.join(groups.withColumnRenamed("component", "fp"), "fp", "left").select("fp", F.least("least_id", "among").alias("component_id"), "shared"), "roots")
    found = with_least(moved.select(F.col("component").alias("u"), F.col("fp").alias("v")), roots.where("shared").select(F.col("fp").alias("u"), F.col("component_id").alias("m")))
    by_class = materialize(roots.select("fp", "component_id").union(found.select(F.col("v").alias("fp"), F.col("m").alias("component_id"))), "byclass")
    return fps.join(by_class, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``. Repeated rows come back
    as often as they occur; an empty table gives an empty one."""
    fps = materialize(fingerprints(docs, key, text), "fingerprints")
    return components(fps).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", scheme: Scheme = SIMILAR) -> DataFrame:
    """One row of each group of near copies: that with the smallest key; of rows that repeat a key, one.
    Rows without a key cannot be told apart and stay, all of them. Null and empty texts are copies of each
    other; an empty table stays empty; columns of any name are kept."""
    fps = materialize(fingerprints(docs, key, text, scheme), "fingerprints")
    nodes = materialize(fps.where("doc_id is not null").groupBy(*scheme.columns).agg(F.min("doc_id").alias("node")), "nodes")
    reached = connected_components(close_pairs(nodes, scheme).select(F.col("a").alias("u"), F.col("b").alias("v")))
    first = nodes.join(reached, "node", "left_anti").select(F.col("node").alias("_keep")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{key}`").cast("long").alias("_key"))
    own = F.col(f"_row.`{text}`")  # within the row: a text is shuffled once
    one = F.row_number().over(Window.partitionBy("_keep").orderBy(F.length(own), F.xxhash64(own)))
    kept = rows.join(first, F.col("_key") == F.col("_keep")).withColumn("_n", one).where("_n = 1")
    return kept.select("_row.*").union(docs.where(F.col(f"`{key}`").isNull()))
