"""Folds over rows in order, where each step depends on the last: one pass, with the state carried from row to row.

Rows are dealt by group and sorted within partitions, so a task streams its groups one after the
other and holds one batch and one state, however long a group is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

Step = Callable[..., tuple]


def dealt(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Rows dealt by group and sorted within partitions, each group whole in one of them.

    Rows are dealt by an expression of ``by``: after a join by the column itself the planner would leave this shuffle out,
    and, as a map over batches asks for no distribution, may then read the join's shuffle by its writers, which cuts groups.
    """
    return df.repartition(F.xxhash64(by)).sortWithinPartitions(by, *order)


def fold(df: DataFrame, by: str, order: list[str], uses: list[str], begin: Callable[[], Step], adds: str) -> DataFrame:
    """Add the columns ``adds``: for each group of ``by``, ``begin()`` gives a step that takes the columns ``uses`` of one
    row after the other, in ``order``, and returns the row's new values. ``order`` settles all ties that matter."""
    added = StructType.fromDDL(adds)
    kinds = [to_arrow_type(f.dataType) for f in added]
    out = StructType(df.schema.fields + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, step = None, None
        for b in batches:
            if not b.num_rows:
                continue
            rows = []
            for g, *values in zip(*(b.column(c).to_pylist() for c in (by, *uses)), strict=True):
                if step is None or g != group:
                    group, step = g, begin()
                rows.append(step(*values))
            new = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], out.names)

    return dealt(df, by, order).mapInArrow(run, out)


def unfold(df: DataFrame, by: str, order: list[str], uses: list[str], begin: Callable[[], Callable[..., list[tuple]]], adds: str, most: int = 10_000) -> DataFrame:
    """Like ``fold``, but a step returns any number of rows of the columns ``adds``, each given with its group."""
    out = StructType([df.schema[by], *StructType.fromDDL(adds).fields])
    kinds = [to_arrow_type(f.dataType) for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, step, rows = None, None, []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], out.names)

        for b in batches:
            for g, *values in zip(*(b.column(c).to_pylist() for c in (by, *uses)), strict=True):
                if step is None or g != group:
                    group, step = g, begin()
                rows += [(g, *r) for r in step(*values)]
                if len(rows) >= most:
                    yield batch()
                    rows = []
        if rows:
            yield batch()

    return dealt(df.select(by, *dict.fromkeys(c for c in (*order, *uses) if c != by)), by, order).mapInArrow(run, out)
