"""Quality classifier: a regularised quadratic discriminant over document statistics.

The statistics are taken from the whole text and brought to comparable scales by fixed
transforms. Class means and covariances come from sums over all labelled training rows; the
covariances are shrunk towards the pooled one and its diagonal. A document's score is the
logistic of the difference of the two log densities, each by way of the class's Cholesky
factor, which is computed once.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import crc_bucket, materialize

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
#: Weights of the pooled covariance and of its diagonal in a class's covariance.
POOL, DIAGONAL = 0.3, 0.1
#: Log-density differences are divided by this before the logistic: the densities are only roughly normal.
TEMPERATURE = 4.0
#: Bytes of a text that are compressed at a time; a text's ratio is over all of them.
BLOCK = 1 << 16

NAMES = (
    "words", "word_bytes", "word_spread", "upper", "digits", "symbols", "stops", "shouts", "bars",
    "other_marks", "distinct", "dup_lines", "compress", "entropy", "short_words", "line_words", "repeated",
)

_UPPER = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))
_LETTER = _UPPER | np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)) | (np.arange(256) >= 0xC0)
_DIGIT = np.isin(np.arange(256), np.frombuffer(b"0123456789", np.uint8))
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&<>@^~=+_{}[]/\\", np.uint8))
_STOP = np.isin(np.arange(256), np.frombuffer(b".,;:?", np.uint8))
_OTHER = np.isin(np.arange(256), np.frombuffer(b"\"'()-`", np.uint8))
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))


def _logit(share: float) -> float:
    return math.log((share + 0.005) / (1.005 - share))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text, in the order of NAMES; an empty text has values too."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    solid = max(1, len(raw) - int(counts[_SPACE].sum()))
    share = lambda mask, of=solid: min(1.0, float(counts[mask].sum()) / of)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    packed = sum(len(zlib.compress(raw[i : i + BLOCK], 1)) for i in range(0, len(raw), BLOCK))
    p = counts[counts > 0] / max(1, len(raw))
    pairs = list(zip(words, words[1:], strict=False))
    return [
        math.log1p(n),
        math.log1p(lengths.mean() if n else 0.0),
        math.log1p(lengths.std() if n else 0.0),
        _logit(share(_UPPER, max(1, int(counts[_LETTER].sum())))),
        _logit(share(_DIGIT)),
        _logit(share(_SYMBOL)),
        _logit(share(_STOP)),
        _logit(float(counts[33]) / solid),
        _logit(float(counts[124]) / solid),
        _logit(share(_OTHER)),
        _logit(len(set(words)) / n if n else 1.0),
        _logit(1 - len(set(lines)) / len(lines) if lines else 0.0),
        math.log((packed + 1) / (len(raw) + 1)) if raw else 0.0,
        float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
        _logit(float((lengths <= 3).mean()) if n else 0.0),
        math.log1p(n / max(1, len(lines))),
        _logit(1 - len(set(pairs)) / len(pairs) if pairs else 0.0),
    ]


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, x)`` for every row, x an array of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[key]}, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log terms of both classes; class 1 is good."""

    means: np.ndarray
    factors: np.ndarray
    logs: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The scores of rows of statistics."""
        if not len(x):
            return np.zeros(0)
        logs = []
        for mean, factor, log in zip(self.means, self.factors, self.logs, strict=True):
            z = (x - mean) @ factor.T
            logs.append(log - 0.5 * np.einsum("ij,ij->i", z, z))
        return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / TEMPERATURE, -500, 500)))


def fit(sums: dict[int, tuple[int, np.ndarray, np.ndarray]], dim: int = len(NAMES)) -> Discriminant:
    """From class -> (rows, sum of x, sum of x x'). A class without rows gets the pooled moments;
    without any row at all every score is one half."""
    total = sum(n for n, _, _ in sums.values())
    whole = sum((s for _, s, _ in sums.values()), np.zeros(dim)) / max(1, total)
    second = sum((q for _, _, q in sums.values()), np.zeros((dim, dim))) / max(1, total)
    scale = np.sqrt(np.maximum(np.diag(second - np.outer(whole, whole)), 1e-6))
    classes = []
    for k in (0, 1):
        n, s, q = sums.get(k, (0, np.zeros(dim), np.zeros((dim, dim))))
        mean = s / n if n else whole
        cov = q / n - np.outer(mean, mean) if n else second - np.outer(whole, whole)
        classes.append((n, mean, cov / np.outer(scale, scale)))
    pooled = sum(n * c for n, _, c in classes) / max(1, total)
    pooled = pooled + 1e-3 * np.eye(dim)
    means, factors, logs = [], [], []
    for n, mean, cov in classes:
        shrunk = (1 - POOL - DIAGONAL) * cov + POOL * pooled + DIAGONAL * np.diag(np.diag(pooled))
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.solve(lower, np.diag(1 / scale)))
        means.append(mean)
        logs.append(-np.log(np.diag(lower)).sum() + math.log((n + 1) / (total + 2)))
    return Discriminant(np.array(means), np.array(factors), np.array(logs))


def moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """``(y, x)`` -> the sums that ``fit`` takes: some hundreds of numbers, whatever the rows."""
    d = len(NAMES)
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    x = F.col("x")
    aggs = [F.sum(x[i]) for i in range(d)] + [F.sum(x[i] * x[j]) for i, j in upper]
    out = {}
    for r in rows.groupBy("y").agg(F.count(F.lit(1)), *aggs).collect():
        q = np.zeros((d, d))
        for (i, j), v in zip(upper, r[2 + d :], strict=True):
            q[i, j] = q[j, i] = v
        out[r[0]] = (r[1], np.array(r[2 : 2 + d]), q)
    return out


def train(statistics_: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """Fit on rows outside the held-out fold. Labels other than 0 and 1 are ignored; a document that is
    labelled more than once takes its smallest label."""
    known = labels.where(F.col(label).isin(0, 1) & (crc_bucket(F.col("doc_id"), FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    return fit(moments(statistics_.join(known, "doc_id").select("y", "x")))


def apply(statistics_: DataFrame, model: Discriminant) -> DataFrame:
    kind = dict(statistics_.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x))], ["doc_id", "score"])

    return statistics_.mapInArrow(run, f"doc_id {kind}, score double")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Null and empty texts have statistics and scores like any other; rows that repeat a key are scored each; an empty
    table gives an empty one. A document with unequal labels takes the smallest; without labels every score is one
    half. Other columns of ``docs`` and ``labels`` are left out.
    """
    stats = materialize(document_statistics(docs), "statistics")
    return apply(stats, train(stats, labels)).select(
        "doc_id", (crc_bucket(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
