"""Best-fit packing of token sequences with large-item matching.

Texts are tokenized and cut only where they exceed the capacity. Pieces are dealt evenly
over shards of about ``SHARD`` pieces, each packed by itself: of pieces above a third of
the capacity, at most two fit a bin, so they are matched greedily, the longest with the
longest partner that fits; smaller pieces then go to the bin with the tightest gap.
"""

from __future__ import annotations

import gc
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import materialize

CAPACITY = 2048
SHARD = 1 << 16
END = 0
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a Python worker remembers, and code points of the longest such word.
REMEMBERED, LONGEST = 400_000, 64
#: Bytes of text tokenized at a time.
PART = 12 << 20

_tokenizers: dict[str, WordTokenizer] = {}


#: A plain word: letters of Latin-1, all stable under NFC, then ASCII marks without an apostrophe.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

#: Marks after a letter at the end of a word: there the pre-tokenizer cuts in any case.
LAST_MARKS = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-^`{-~]+)([\x20\x09-\x0D]|$)"


def _byte_letters() -> dict[int, str]:
    """How a byte-level tokenizer writes the UTF-8 bytes of the letters in PLAIN: printable bytes of
    Latin-1 stand for themselves, the others for the code points from 256, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    names = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}
    return {c: "".join(names[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class WordTokenizer:
    """Ids of whole texts by way of their words.

    The tokenizer's pre-tokenizer never joins what white space separates, nor letters and marks,
    so a text's ids are those of its words in order, and those of a plain word are the ids of its
    letters and of its marks. Letters go to the model at once, as lower-casing and the byte
    letters are all that the other steps do to them; any other word takes the full tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.full.model)
        self.letters = _byte_letters()
        self.known: dict[str, tuple[int, ...]] = {"": ()}
        self.cores: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _encode(tokenizer, words: list[str], into: dict, names: list[str]) -> None:
        for at in range(0, len(words), 4096):
            part = names[at : at + 4096]
            into.update(dict.fromkeys(part, ()))
            encoded = tokenizer.encode(words[at : at + 4096], is_pretokenized=True, add_special_tokens=False)
            ids, of = encoded.ids, encoded.word_ids
            start = 0
            for i in range(1, len(ids) + 1):
                if i == len(ids) or of[i] != of[start]:
                    into[part[of[start]]] = tuple(ids[start:i])
                    start = i

    def _learn(self, missing: list[str]) -> None:
        plain, others = [], {}
        for w in missing:
            if w.isascii() and w.isalpha():
                plain.append((w, w.lower(), ""))
            elif m := PLAIN.fullmatch(w):
                core, marks = m[1].lower(), m[2]
                plain.append((w, core, marks))
                if marks not in self.known:
                    others[marks] = None
            else:
                others[w] = None
        self._encode(self.full, list(others), self.known, list(others))
        new = list(dict.fromkeys(c for _, c, _ in plain if c not in self.cores))
        self._encode(self.bare, [c.translate(self.letters) for c in new], self.cores, new)
        known, cores = self.known, self.cores
        for w, core, marks in plain:
            known[w] = cores[core] + known[marks]

    def ids_of_words(self, words: list[str]) -> list[tuple[int, ...]]:
        found = list(map(self.known.get, words))
        if None in found:
            missing = [w for w, ids in zip(words, found, strict=True) if ids is None]
            self._learn(missing)
            found = list(map(self.known.__getitem__, words))
            if len(self.known) > REMEMBERED or len(max(missing, key=len)) > LONGEST:
                self.known = {"": ()}
            if len(self.cores) > REMEMBERED:
                self.cores = {}
        return found

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the number of ids of each text; null texts have none."""
        whole = pc.fill_null(texts, "").cast(pa.large_string())
        if not pc.any(pc.match_substring(whole, "<|")).as_py():  # the marks of special tokens stay with their letters
            whole = pc.replace_substring_regex(whole, LAST_MARKS, r"\1 \2 ")
            latin = pc.invert(pc.match_substring_regex(whole, r"[^\x00-\x{FF}]"))
            whole = pc.if_else(latin, pc.utf8_lower(whole), whole)  # within Latin-1 as the tokenizer does; it makes fewer words
        split = pc.split_pattern_regex(whole, r"[\x20\x09-\x0D]+")
        each = split.flatten().dictionary_encode()
        index, ids = each.indices.to_numpy(), self.ids_of_words(each.dictionary.to_pylist())
        lengths = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, lengths.sum())
        of_word = lengths[index]
        total = int(of_word.sum(dtype=np.int64))
        kind = np.int32 if total < 1 << 31 else np.int64
        ends = np.cumsum(of_word, dtype=kind)
        at = np.cumsum(lengths, dtype=kind) - lengths
        at = np.repeat(at[index] - ends + of_word, of_word)
        at += np.arange(total, dtype=kind)
        out = flat[at]
        words_before = np.r_[0, np.cumsum(pc.list_value_length(split).to_numpy())].astype(np.int64)
        return out, np.diff(np.r_[0, ends][words_before])


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every document's ids, followed by END, in pieces of at most ``capacity`` ids."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIECES.split(", ")]
        gc.disable()  # tuples of ids make no cycles, and there are many for the collector to walk
        try:
            for b in batches:
                tok, rows = _tokenizer(path), []
                for some in _slices(b):
                    ids, counts = tok.ids(some.column(1))
                    for key_, own in zip(some.column(0).to_pylist(), np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                        raw = np.append(own, np.uint32(END)).astype("<u4", copy=False)
                        for n, at in enumerate(range(0, len(raw), capacity)):
                            part = raw[at : at + capacity]
                            rows.append((key_, n, at, len(part), zlib.crc32(part)))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)
        finally:
            gc.enable()  # the worker may go on with other operators

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about PART bytes of text; a longer text is a part of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)) if len(batch) else []
    at = 0
    while at < len(batch):
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PART, "right")))
        yield batch.slice(at, upto - at)
        at = upto


class _Gaps:
    """Open bins by their gap; the tightest gap of at least some length in a few steps."""

    def __init__(self, capacity: int):
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.held = 0  # bit g is set if a bin has gap g

    def put(self, gap: int, bin_: int) -> None:
        self.bins[gap].append(bin_)
        self.held |= 1 << gap

    def tightest(self, length: int) -> tuple[int, int] | None:
        fits = self.held >> length
        if not fits:
            return None
        gap = length + (fits & -fits).bit_length() - 1
        bin_ = self.bins[gap].pop()
        if not self.bins[gap]:
            self.held ^= 1 << gap
        return gap, bin_


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The bin of every length and its offset there. Lengths are from 1 to ``capacity``."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order].tolist()
    large = sum(3 * n > capacity for n in sizes)
    gaps, made = _Gaps(capacity), 0
    taken = [False] * large
    # partners by length, so that the longest one that fits is found without a scan
    by_length = _Gaps(capacity)
    for i in range(large - 1, -1, -1):
        by_length.put(capacity - sizes[i], i)
    for i in range(large):
        if taken[i]:
            continue
        taken[i] = True
        bins[order[i]], used = made, sizes[i]
        # the longest unmatched piece of at most capacity - used, i.e. the least key of at least ``used``
        while partner := by_length.tightest(used):
            j = partner[1]
            if not taken[j]:
                taken[j] = True
                bins[order[j]], offsets[order[j]] = made, used
                used += sizes[j]
                break
        gaps.put(capacity - used, made)
        made += 1
    for i in range(large, len(sizes)):
        n = sizes[i]
        gap, bin_ = gaps.tightest(n) or (capacity, made)
        made += bin_ == made
        bins[order[i]], offsets[order[i]] = bin_, capacity - gap
        gaps.put(gap - n, bin_)
    return bins, offsets


def sequences(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces -> the same with ``sequence_id`` and ``offset``. Full pieces are sequences of
    their own (negative ids) and never move; the others' ids hold the shard and its bin."""
    whole = cut.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = cut.where(F.col("length") < capacity)
    shards = max(1, -(-rest.count() // SHARD))

    def run(group: pa.Table) -> pa.Table:
        bins, offsets = pack(group["length"].to_numpy(), capacity)
        shard = group["shard"][0].as_py()
        return group.drop_columns(["shard"]).append_column("sequence_id", pa.array((shard << 32) + bins)).append_column("offset", pa.array(offsets))

    dealt = rest.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)))
    return whole.unionByName(dealt.groupBy("shard").applyInArrow(run, f"{PIECES}, sequence_id long, offset long"))


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every row of ``docs``. Null and empty texts are the id END alone; rows
    that repeat a key are packed each; an empty table gives an empty one."""
    return sequences(materialize(pieces(docs, key, text, tokenizer, capacity), "pieces"), capacity)
