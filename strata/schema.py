"""Row layouts, constants and options of the store."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

CHANGELOG = "user_key binary, seq long, vtype int, value binary"
DELETION, VALUE = 0, 1
MAX_SEQ = (1 << 55) - 2

# They decide results and must stay as they are.
LEVELS = 7
L0_COMPACTION, L0_SLOWDOWN, L0_STOP = 4, 8, 12
MAX_MEMTABLE_LEVEL = 2
LEVEL_ONE_BYTES = 10 * 1048576
TARGET_FILE_SIZE = 2 * 1048576
GRANDPARENT_FACTOR, EXPAND_FACTOR = 10, 25
SEEK_BYTES, MIN_SEEKS = 16384, 100


@dataclass(frozen=True)
class Options:
    """Settings of a store. ``clamped`` keeps the sizes in their allowed ranges.

    ``paranoid`` refuses damaged logs; ``block_size`` is the size of a Parquet page; files are of about ``max_file_size``
    bytes, and the budgets of levels grow with it; ``partitions`` overrides how many a write makes. ``wal`` lets small
    writes wait for ``write_buffer`` bytes behind a log, which ``sync`` forces to disk and ``reuse_logs`` goes on with after a
    crash. ``retain`` are the seconds that replaced files stay. ``restart_interval`` is for table files.
    """

    create_if_missing: bool = True
    error_if_exists: bool = False
    paranoid: bool = False
    compression: str = "snappy"
    comparator: str = "bytewise"
    bloom_bits: int = 0
    block_size: int = 4096
    restart_interval: int = 16
    max_open_files: int = 1000
    write_buffer: int = 4 * 1048576
    max_file_size: int = 128 * 1048576
    partitions: int = 0
    wal: bool = False
    sync: bool = False
    reuse_logs: bool = False
    take_lock: bool = False
    back_pressure: bool = True
    retain: float = 3600.0

    def clamped(self) -> Options:
        def clamp(x: int, low: int, high: int) -> int:
            return max(low, min(high, x))

        return replace(
            self,
            max_open_files=clamp(self.max_open_files, 74, 50000),
            write_buffer=clamp(self.write_buffer, 64 << 10, 1 << 30),
            max_file_size=clamp(self.max_file_size, 1 << 20, 1 << 30),
            block_size=clamp(self.block_size, 1 << 10, 4 << 20),
        )


def level_bytes(level: Column) -> Column:
    """The byte budget of a level from 1 on: ten times as much at each."""
    return F.lit(LEVEL_ONE_BYTES) * F.pow(F.lit(10.0), level - 1)


def allowed_seeks(size: Column) -> Column:
    return F.greatest(F.lit(MIN_SEEKS).cast("long"), F.floor(size / SEEK_BYTES).cast("long"))
