"""Language-model scores by Brown classes.

Words are counted over all training texts. The most frequent ones, the seeds, are put into
classes by the exchange algorithm, which moves one word at a time to the class where the
average mutual information of adjacent classes is largest. All other words of the training
texts follow by frequency in windows: first those that every worker holds, then the rest, each
to the class where its own counts of neighbouring classes make that information largest. Seeds
and classes grow with the corpus. A token's probability is that of its class after the previous
token's class times the word's share of its class, interpolated with the word's own smoothed
share:

    p(w | v) = L * p(C(w) | C(v)) * (c(w) + 0.5) / Z(C(w)) + (1 - L) * (c(w) + 0.5) / Z

Both terms hold the factor c(w) + 0.5. Rare words, whose counts and classes no driver or worker
could hold, are rows: each of their tokens meets its word's count and class in a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import crc_bucket, materialize

FOLDS, HELD_OUT = 5, 1
#: Words that every worker holds with their counts, and the bytes of such a word on average: at most
#: HEAD * LONGEST = 8 MiB of words whatever the corpus. All other words are joined as rows.
HEAD, LONGEST = 1 << 18, 32
#: Seeds and classes of a corpus of TOKENS tokens, and the most sweeps over the seeds. Seeds and classes grow
#: with the sixth root of the tokens; seeds stay below MOST, as their pairs are held as a square of numbers.
CLUSTERED, CLASSES, SWEEPS = 1024, 40, 8
TOKENS, MOST = 4_000_000, 4096
#: Times that the words held by every worker choose a class: by neighbours among the seeds first, then by all held.
ROUNDS = 2
#: Words that a task counts before it passes them on, and contexts before it adds them up; bytes of text that it takes at a time.
FLUSH, PAIRS, PART = 1_000_000, 1 << 21, 8 << 20


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about PART bytes of text; a longer text is a part of its own."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, with A-Z in lower case, and how many each text has; null texts have none."""
    # the type stays as it is: cast slices keep their first offset, which ascii_lower then overlooks
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))  # the six ASCII spaces
    words, counts = split.flatten(), pc.list_value_length(split).to_numpy()
    solid = pc.greater(pc.binary_length(words), 0)
    if not pc.all(solid).as_py():  # what is before leading and after trailing spaces
        ends = np.r_[0, np.cumsum(solid.to_numpy(zero_copy_only=False))]
        upto = np.cumsum(counts)
        words, counts = words.filter(solid), ends[upto] - ends[upto - counts]
    return words, counts.astype(np.int64)


def numbers(texts: pa.Array, held: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """All texts as the numbers of their words, in a row, each with an end before and after it; where each text starts
    there; the words; and their places there. Words that are not held have the number after the last one, ends the next."""
    words, counts = tokens(texts)
    starts = np.cumsum(counts + 2) - counts - 2
    flat = np.full(int(counts.sum()) + 2 * len(counts), len(held) + 1, np.int32)
    places = np.arange(len(words)) + np.repeat(2 * np.arange(len(counts)) + 1, counts)
    flat[places] = pc.fill_null(pc.index_in(words, held), len(held)).to_numpy()
    return flat, starts, words, places


def word_array(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def word_counts(training: DataFrame) -> DataFrame:
    """``(text)`` -> ``(word, n)`` over all rows; counted within tasks before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            whole = pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")])
            yield from pa.table({"word": whole["word"], "n": whole["n_sum"]}).to_batches(max_chunksize=100_000)

        for b in batches:
            for part in slices(b, 0):
                found = pc.value_counts(tokens(part.column(0))[0])
                parts.append(pa.table({"word": found.field(0), "n": found.field(1)}))
                size += len(found)
                if size > FLUSH:
                    yield from out()
                    parts, size = [], 0
        if size:
            yield from out()

    return training.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def class_pairs(training: DataFrame, words: list[bytes]) -> np.ndarray:
    """Counts of adjacent symbols: the words given, all other words as one, and the end of a text,
    which also stands before its first word. At most (words + 2) ** 2 numbers reach the driver."""
    spark = training.sparkSession
    side = len(words) + 2
    held = spark.sparkContext.broadcast(word_array(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(side * side, np.int64)
        for b in batches:
            for part in slices(b, 0):
                flat, starts, _, _ = numbers(part.column(0), held.value)
                pair = flat[:-1].astype(np.int64) * side + flat[1:]
                within = np.ones(len(pair), bool)
                within[starts[1:] - 1] = False  # from one text's end to the next one's
                np.add(total, np.bincount(pair[within], minlength=side * side), out=total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    rows = training.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(side * side, np.int64)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    held.unpersist()
    return out.reshape(side, side)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each word, from counts of adjacent symbols whose last two are not clustered and
    keep classes of their own, ``classes`` and ``classes + 1``. Ties go to the lowest class."""
    k = len(pairs) - 2
    n = classes + 2
    of = np.r_[np.arange(k) % classes, classes, classes + 1]
    pairs = pairs.astype(np.float64)
    onehot = np.zeros((k + 2, n))
    onehot[np.arange(k + 2), of] = 1
    m = onehot.T @ pairs @ onehot
    after, before = pairs @ onehot, (onehot.T @ pairs).T  # of each word: counts to and from each class
    rows, cols = pairs.sum(axis=1), pairs.sum(axis=0)
    diag = np.arange(n)
    for _ in range(sweeps):
        moved = 0
        for w in range(k):
            a, own = of[w], pairs[w, w]
            right, left = after[w].copy(), before[w].copy()
            right[a] -= own
            left[a] -= own
            m[a, :] -= right
            m[:, a] -= left
            m[a, a] -= own
            out, into = m.sum(axis=1), m.sum(axis=0)
            gain_r = _xlogx(m + right[None, :]) - _xlogx(m)
            gain_l = _xlogx(m + left[:, None]) - _xlogx(m)
            gain = gain_r.sum(axis=1) - gain_r[diag, diag] + gain_l.sum(axis=0) - gain_l[diag, diag]
            gain += _xlogx(m[diag, diag] + right + left + own) - _xlogx(m[diag, diag])
            gain -= _xlogx(out + rows[w]) - _xlogx(out) + _xlogx(into + cols[w]) - _xlogx(into)
            best = int(np.argmax(gain[:classes]))
            if gain[best] <= gain[a] + 1e-9:
                best = a
            m[best, :] += right
            m[:, best] += left
            m[best, best] += own
            if best != a:
                moved += 1
                of[w] = best
                after[:, a] -= pairs[:, w]
                after[:, best] += pairs[:, w]
                before[:, a] -= pairs[w, :]
                before[:, best] += pairs[w, :]
        if not moved:
            break
    return of


@dataclass(frozen=True)
class Model:
    """words: those held by every worker, the most frequent first, with log10(count + 0.5) and class.
    gain: log10 of what the classes make of a token's smoothed share, by previous and own class."""

    words: list[bytes]
    logs: np.ndarray
    classes: np.ndarray
    gain: np.ndarray
    tokens: int
    norm: float  # Z
    ends: int

    @property
    def rest(self) -> int:
        return len(self.gain) - 2

    @property
    def end(self) -> int:
        return len(self.gain) - 1


def head_words(counts: DataFrame, most: int = HEAD, longest: int = LONGEST) -> list[tuple[bytes, int]]:
    """The most frequent words of at most ``longest`` bytes and their counts, ``most`` words and
    ``most * LONGEST`` bytes at most.

    The least count is found from a histogram over bands of counts, some thousands of rows at
    most, so that no task sorts the words; words of one band come in together or not at all.
    """
    size = F.octet_length("word")
    short = counts.where(size <= longest).withColumn("band", F.floor(F.log2("n") * 64).cast("int"))
    total, held, least = 0, 0, None
    bands = short.groupBy("band").agg(F.count(F.lit(1)).alias("words"), F.sum(size).alias("bytes")).collect()
    for r in sorted(bands, key=lambda r: -r["band"]):
        total, held = total + r["words"], held + r["bytes"]
        if total > most or held > most * LONGEST:
            break
        least = r["band"]
    if least is None:
        return []
    rows = short.where(F.col("band") >= least).select("word", "n").toArrow()
    pairs = zip((w.encode() for w in rows["word"].to_pylist()), rows["n"].to_pylist(), strict=True)
    return sorted(pairs, key=lambda x: (-x[1], x[0]))


def sizes(tokens: int) -> tuple[int, int]:
    """Seeds and classes of a corpus of so many tokens."""
    grown = max(1.0, tokens / TOKENS) ** (1 / 6)
    return min(MOST, round(CLUSTERED * grown)), round(CLASSES * grown)


def estimate(m: np.ndarray, z: np.ndarray, norm: float) -> np.ndarray:
    """``gain`` from the counts of adjacent classes and the classes' parts of Z."""
    p = (m + 0.1 * (z / norm)) / (m.sum(axis=1, keepdims=True) + 0.1)
    ratio = np.divide(p * norm, z, out=np.ones_like(p), where=z > 0)
    weight = 0.5
    for _ in range(50):  # the share of tokens that the class term explains better, by expectation and maximisation
        weight = float((m * (weight * ratio / (weight * ratio + 1 - weight))).sum() / m.sum()) if m.sum() else 0.0
    weight = min(weight, 0.95)
    return np.log10(weight * ratio + 1 - weight)


def fit(training: DataFrame, counts: DataFrame, head: int = HEAD, clustered: int | None = None, classes: int | None = None) -> Model:
    """The model of the seeds, ``clustered`` of them; all other words are one class until ``extend``."""
    ends = training.count()
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).head()
    n, v = (total["n"] or 0) + ends, total["v"] + bool(ends)
    norm = n + 0.5 * (v + 1)
    grown = sizes(n)
    classes = classes or grown[1]
    top = head_words(counts, head, max(LONGEST, head * LONGEST >> 10))
    words, c = [w for w, _ in top], np.array([x for _, x in top], np.float64)
    k = min(clustered or grown[0], len(words))
    pairs = class_pairs(training, words[:k])
    of = exchange(pairs, classes)
    m = np.zeros((classes + 2, classes + 2))
    np.add.at(m, (of[:, None], of[None, :]), pairs)
    # Z of each class: its words' counts + 0.5; the class of all other words has what remains, unknown words included
    z = np.bincount(of[:k], c[:k] + 0.5, classes + 2).astype(float)  # of no words it is whole numbers
    z[classes + 1] = ends + 0.5 * bool(ends)
    z[classes] = norm - z.sum()
    all_classes = np.r_[of[:k], np.full(len(words) - k, classes)].astype(np.int32)
    return Model(words, np.log10(c + 0.5), all_classes, estimate(m, z, norm), n, norm, ends)


READ = "row long, doc_id {}, held_out boolean, n_tokens long, n_known long, base double, ids binary, word string, at long, before int, after int"


def read(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, text)`` -> two kinds of rows, by one pass over the texts: every text as the numbers
    of its words, with an end at both ends, and every token of a rare word with its neighbours' numbers.
    Rare words all have the number after the last held word, the end has the next one."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((word_array(model.words), model.logs, math.log10(model.ends + 0.5), math.log10(model.norm), bool(model.ends)))
    kind = dict(docs.dtypes)["doc_id"]
    names = [x.split()[0] for x in READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, logs, end_log, log_norm, ends = held.value
        none = len(words)
        logs = np.r_[logs, 0.0, end_log]  # each text has two ends, of which one is its token
        first = TaskContext.get().partitionId() << 33

        def part_of(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal first
            flat, starts, found, places = numbers(b.column(2), words)
            sizes = np.diff(np.r_[starts, len(flat)])
            row = first + np.arange(len(b))
            first += len(b)
            base = np.add.reduceat(logs[flat], starts) - end_log - log_norm * (sizes - 1)
            known = np.add.reduceat((flat < none).astype(np.int64), starts) + ends
            n = len(b)
            whole = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(4 * np.r_[starts, len(flat)].astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
            cols = [pa.array(row), b.column(0), b.column(1), pa.array(sizes - 1), pa.array(known), pa.array(base), whole]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.nulls(n, t) for t in (pa.string(), pa.int64(), pa.int32(), pa.int32()))], names)
            rare = np.flatnonzero(flat[places] == none)
            for k in range(0, len(rare), 100_000):
                some = rare[k : k + 100_000]
                at = places[some]
                text = np.searchsorted(starts, at, "right") - 1
                m = len(some)
                cols = [pa.array(row[text]), pa.nulls(m, b.schema.field(0).type), b.column(1).take(pa.array(text)), *(pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.binary()))]
                cols += [found.take(pa.array(some)), pa.array(at - starts[text] - 1), pa.array(flat[at - 1]), pa.array(flat[at + 1])]
                yield pa.RecordBatch.from_arrays(cols, names)

        for b in batches:
            for part in slices(b, 2):
                yield from part_of(part)

    return materialize(docs.select("doc_id", "held_out", "text").mapInArrow(run, READ.format(kind)), "read")


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of a batch of texts in one array, where each text starts, and which places begin a pair."""
    texts = column.to_pylist()
    lengths = np.array([len(x) // 4 for x in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    ids = np.frombuffer(b"".join(texts), np.int32)
    pair = np.ones(len(ids), bool)
    pair[starts + lengths - 1] = False
    return ids, starts, pair


def class_of(model: Model) -> np.ndarray:
    """The class of each number: held words, rare words together, the end."""
    return np.r_[model.classes, model.rest, model.end].astype(np.int64)


def transitions(texts: DataFrame, model: Model) -> np.ndarray:
    """Counts of adjacent classes over ``texts(ids)``, all rare words as one class."""
    n = len(model.gain)
    held = texts.sparkSession.sparkContext.broadcast(class_of(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, np.int64)
        for b in batches:
            if b.num_rows:
                ids, _, pair = _joined(b.column(0))
                c = held.value[ids]
                total += np.bincount((c[:-1] * n + c[1:])[pair[:-1]], minlength=n * n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    rows = texts.select("ids").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    held.unpersist()
    return _square(rows, n)


def _square(rows: pa.Table, n: int) -> np.ndarray:
    m = np.zeros(n * n)
    m[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return m.reshape(n, n)


def contexts(texts: DataFrame, model: Model, first: int) -> DataFrame:
    """``(word, context, n)`` of the held words from number ``first`` on: how often a class precedes the word, and,
    as class + len(gain), how often it follows."""
    n = len(model.gain)
    held = texts.sparkSession.sparkContext.broadcast(class_of(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = held.value
        parts, size = [], 0

        def out() -> pa.RecordBatch:
            keys, times = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((keys // (2 * n)).astype(np.int32)), pa.array((keys % (2 * n)).astype(np.int32)), pa.array(times)], ["word", "context", "n"])

        for b in batches:
            if b.num_rows:
                ids, _, _ = _joined(b.column(0))
                c = of[ids]
                at = np.flatnonzero((ids >= first) & (ids < len(of) - 2))
                key = ids[at].astype(np.int64) * (2 * n)
                parts += [key + c[at - 1], key + n + c[at + 1]]
                size += 2 * len(at)
            if size > PAIRS:
                yield out()
                parts, size = [], 0
        if size:
            yield out()

    return texts.select("ids").mapInArrow(run, "word int, context int, n long")


def rare_contexts(rare: DataFrame, model: Model) -> DataFrame:
    """The same of rare words, from ``rare(word, before, after)``; rare neighbours are one class."""
    n = len(model.gain)
    held = rare.sparkSession.sparkContext.broadcast(class_of(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            before, after = (held.value[b.column(i).to_numpy()].astype(np.int32) for i in (1, 2))
            words = pa.concat_arrays([b.column(0), b.column(0)])
            yield pa.RecordBatch.from_arrays([words, pa.array(np.r_[before, after + n].astype(np.int32)), pa.array(np.ones(len(words), np.int64))], ["word", "context", "n"])

    return rare.select("word", "before", "after").mapInArrow(run, "word string, context int, n long")


def best_classes(starts: np.ndarray, context: np.ndarray, n: np.ndarray, own: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The class of each word, given its counts of contexts from ``starts`` on, by the largest gain of mutual
    information over classes ``m`` without the word, which is now in class ``own``."""
    k = len(m) - 2
    right, j = context >= len(m), context % len(m)
    held = np.where(right[:, None], m[:k, j].T, m[j, :k])
    word = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(context)]))
    at = np.flatnonzero(own[word] < k)
    held[at, own[word[at]]] -= n[at]
    held = np.maximum(held, 0)
    gain = np.add.reduceat(_xlogx(held + n[:, None]) - _xlogx(held), starts)
    for side, total in ((right, m.sum(axis=1)[:k]), (~right, m.sum(axis=0)[:k])):
        times = np.add.reduceat(np.where(side, n, 0), starts)
        out = np.repeat(total[None, :], len(starts), axis=0)
        mine = np.flatnonzero(own < k)
        out[mine, own[mine]] -= times[mine]
        out = np.maximum(out, 0)
        gain -= _xlogx(out + times[:, None]) - _xlogx(out)
    return np.argmax(gain, axis=1)


def assign(cells: DataFrame, m: np.ndarray, own: np.ndarray | None = None) -> DataFrame:
    """``(word, context, n)`` -> ``(word, n, class)``: the class of each word and how often it occurs. ``own`` has the
    classes that numbered words are in now."""
    kind = dict(cells.dtypes)["word"]
    held = cells.sparkSession.sparkContext.broadcast((m, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, own = held.value
        n = len(m)

        def chosen(t: pa.Table) -> pa.RecordBatch:
            words = t["word"].combine_chunks()
            numbers = words.dictionary_encode().indices.to_numpy()  # rows of a word are next to each other
            starts = np.flatnonzero(np.r_[True, np.diff(numbers) != 0])
            words = words.take(pa.array(starts))
            context, times = t["context"].to_numpy(), t["n"].to_numpy()
            now = np.full(len(starts), n) if own is None else own[words.to_numpy()]
            total = np.add.reduceat(np.where(context < n, times, 0), starts)
            of = best_classes(starts, context, times, now, m)
            return pa.RecordBatch.from_arrays([words, pa.array(total), pa.array(of.astype(np.int32))], ["word", "n", "class"])

        kept = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if kept is None else pa.concat_tables([kept, t])
            if not len(t):
                continue
            numbers = t["word"].combine_chunks().dictionary_encode().indices.to_numpy()
            cut = int(np.flatnonzero(numbers == numbers[-1])[0])  # the last word may go on in the next batch
            if cut:
                yield chosen(t.slice(0, cut))
            kept = t.slice(cut)
        if kept is not None and len(kept):
            yield chosen(kept)

    # one shuffle: the sums keep the partitions by word
    sums = cells.repartition("word").groupBy("word", "context").agg(F.sum("n").alias("n"))
    return sums.sortWithinPartitions("word").mapInArrow(run, f"word {kind}, n long, class int")


def extend(seen: DataFrame, model: Model, seeds: int) -> tuple[Model, DataFrame, DataFrame]:
    """The model with a class for every word of the training texts, from the rows of ``read``; then the rare words
    ``(word, n, class)`` and the tokens of rare words with classes, ``(row, held_out, n, a, b, c)``: pairs (a, b) and, unless c is
    null, (b, c)."""
    spark = seen.sparkSession
    texts = seen.where("word is null and not held_out")
    rare = seen.where("word is not null")
    seeds = min(seeds, len(model.words))
    if seeds < len(model.words):
        for _ in range(ROUNDS):
            m = transitions(texts, model)
            rows = assign(contexts(texts, model, seeds), m, class_of(model)).select("word", "class").toArrow()
            classes = model.classes.copy()
            classes[rows["word"].to_numpy()] = rows["class"].to_numpy()
            model = replace(model, classes=classes)
    m = transitions(texts, model)
    tail = materialize(assign(rare_contexts(rare.where("not held_out"), model), m), "tail")

    n, rest = len(model.gain), model.rest
    held = spark.sparkContext.broadcast(class_of(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [pa.array(held.value[b.column(i).to_numpy()].astype(np.int32)) for i in (4, 5)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *near], ["row", "held_out", "word", "at", "before", "after"])

    near = rare.select("row", "held_out", "word", "at", "before", "after").mapInArrow(run, "row long, held_out boolean, word string, at long, before int, after int")
    known = near.join(tail, "word", "left").select("row", "held_out", "at", "before", "after", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("class", F.lit(rest)).alias("b"))
    last = F.lag("b").over(Window.partitionBy("row").orderBy("at"))
    a = F.when(F.col("before") == rest, last).otherwise(F.col("before"))
    linked = materialize(known.select("row", "held_out", "n", a.alias("a"), "b", F.when(F.col("after") != rest, F.col("after")).alias("c")), "linked")

    learnt = linked.where("not held_out")
    pairs = learnt.select((F.col("a") * n + F.col("b")).cast("long").alias("pair")).unionAll(learnt.where("c is not null").select((F.col("b") * n + F.col("c")).cast("long").alias("pair")))
    m[rest, :] = m[:, rest] = 0
    m += _square(pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).toArrow(), n)
    z = np.bincount(model.classes, 10.0**model.logs, n).astype(float)
    for r in tail.groupBy("class").agg(F.sum(F.col("n") + 0.5).alias("z")).collect():
        z[r["class"]] += r["z"]
    z[model.end] = model.ends + 0.5 * bool(model.ends)
    z[rest] = 0.5  # unknown words
    return replace(model, gain=estimate(m, z, model.norm)), tail, linked


def score(seen: DataFrame, linked: DataFrame, model: Model) -> DataFrame:
    """The scores of every row of ``read``, whose rare tokens ``extend`` has linked."""
    spark = seen.sparkSession
    kind = dict(seen.dtypes)["doc_id"]
    held = spark.sparkContext.broadcast((class_of(model), model.gain, model.rest))
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "gain"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, gain, rest = held.value
        gain = gain.copy()
        gain[rest, :] = gain[:, rest] = 0.0  # pairs of rare words come from their rows
        for b in batches:
            if b.num_rows:
                ids, starts, pair = _joined(b.column(6))
                c = of[ids]
                g = np.append(gain[c[:-1], c[1:]], 0.0) * pair
                yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(np.add.reduceat(g, starts))], names)

    docs = seen.where("word is null").select(*names[:6], "ids")
    whole = docs.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, gain double")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, gain, _ = held.value
        for b in batches:
            if b.num_rows:
                rows, a, mid = (b.column(i).to_numpy() for i in (0, 2, 3))
                n = b.column(1).to_numpy()
                c = b.column(4).fill_null(-1).to_numpy()
                g = gain[a, mid] + np.where(c >= 0, gain[mid, np.maximum(c, 0)], 0.0)
                each, at = np.unique(rows, return_inverse=True)
                sums = [np.bincount(at, x, len(each)) for x in (np.log10(n + 0.5), g)] + [np.bincount(at, n > 0, len(each)).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(each), *map(pa.array, sums)], ["row", "more", "more_gain", "more_known"])

    parts = linked.select("row", "n", "a", "b", "c").mapInArrow(add_up, "row long, more double, more_gain double, more_known long")
    sums = parts.groupBy("row").agg(*(F.sum(x).alias(x) for x in ("more", "more_gain", "more_known")))
    more = lambda x: F.coalesce(x, F.lit(0))
    base = F.col("base") + more("more")
    return whole.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + more("more_known")).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain") + more("more_gain")).alias("score"),
    )


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Learn from the training folds of ``docs`` and score every row. Null and empty texts are their end
    alone; rows that repeat a key are scored each; an empty table gives an empty one."""
    rows = docs.select(F.col(key).alias("doc_id"), (crc_bucket(F.col(key), FOLDS) == HELD_OUT).alias("held_out"), F.col(text).alias("text"))
    training = rows.where("not held_out")
    counts = materialize(word_counts(training), "words")
    first = fit(training, counts)
    seen = read(rows, first)
    model, _, linked = extend(seen, first, int((first.classes < first.rest).sum()))
    return score(seen, linked, model)
