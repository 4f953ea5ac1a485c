"""Models of the caches and seek budgets over access traces."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.fold import fold


def lru_trace(trace: DataFrame, capacity: int, shard: str = "shard") -> DataFrame:
    """``(shard, t, key)`` -> ``(shard, t, state)``: cold, hit or miss of a least-recently-used cache.

    An access hits if fewer than ``capacity`` distinct keys came since the last one of its key. The first access
    of each key is found by an aggregate, so that the fold over a shard holds the keys in the cache and no others.
    """
    first = trace.groupBy(shard, "key").agg(F.min("t").alias("_first"))
    rows = trace.join(first, [shard, "key"]).select(shard, "t", "key", (F.col("t") == F.col("_first")).alias("_cold"))

    def begin():
        held: OrderedDict = OrderedDict()

        def step(key, cold: bool) -> tuple[str]:
            state = "cold" if cold else "hit" if key in held else "miss"
            held[key] = None
            held.move_to_end(key)
            if len(held) > capacity:
                held.popitem(last=False)
            return (state,)

        return step

    return fold(rows, shard, ["t"], ["key", "_cold"], begin, "state string").select(shard, "t", "state")


class LruCache:
    """A weighted cache: entries in use are never evicted, others leave by their oldest release."""

    def __init__(self, capacity: int):
        self.capacity, self.usage = capacity, 0
        self.table: dict = {}
        self.idle: OrderedDict = OrderedDict()

    def insert(self, key, value, charge: int = 1) -> list:
        """A handle that counts as in use until it is released."""
        handle = [key, value, charge, 1, self.capacity > 0]  # the last: held by the cache itself
        if self.capacity > 0:
            self.erase(key)
            self.table[key] = handle
            self.usage += charge
        self._evict()
        return handle

    def lookup(self, key) -> list | None:
        handle = self.table.get(key)
        if handle is not None:
            self.idle.pop(key, None)
            handle[3] += 1
        return handle

    def release(self, handle: list) -> None:
        handle[3] -= 1
        if handle[3] == 0 and handle[4]:
            self.idle[handle[0]] = handle
            self._evict()

    def erase(self, key) -> None:
        handle = self.table.pop(key, None)
        if handle is not None:
            self.idle.pop(key, None)
            handle[4] = False
            self.usage -= handle[2]

    def prune(self) -> None:
        for key in list(self.idle):
            self.erase(key)

    def _evict(self) -> None:
        while self.usage > self.capacity and self.idle:
            self.erase(next(iter(self.idle)))

    @property
    def total_charge(self) -> int:
        return self.usage


def seek_charges(probes: DataFrame, files: DataFrame) -> DataFrame:
    """``probes(probe_no, file_no, probe_order)`` -> per file the seeks charged and whether its budget is spent.

    A lookup that reads a second file charges the first one it read.
    """
    first = probes.groupBy("probe_no").agg(F.count(F.lit(1)).alias("n"), F.min_by("file_no", "probe_order").alias("file_no")).where("n > 1")
    charged = first.groupBy("file_no").agg(F.count(F.lit(1)).alias("charges"))
    return files.select("file_no", "allowed_seeks").join(charged, "file_no").withColumn("exhausted", F.col("charges") >= F.col("allowed_seeks"))
