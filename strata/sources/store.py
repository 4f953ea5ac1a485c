"""A store on Parquet: data files, a manifest of edits, snapshots and, if asked for, a log of small writes.

A commit writes its data first and then one edit file that must not exist yet. Readers take
the live files from the manifest once and keep to them, so they see a batch whole or not at
all, and two writers cannot commit the same edit.

With ``Options.wal`` small writes wait in memory, behind a log, until there are enough of them for
a file; the store is then locked, and what its logs hold is recovered when it is opened.
"""

from __future__ import annotations

import base64
import json
import logging
import os
import socket
import time
import uuid
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import compact, mvcc
from strata.plans import compaction as policy
from strata.plans.compaction import FileRow
from strata.schema import CHANGELOG, DELETION, L0_COMPACTION, L0_SLOWDOWN, L0_STOP, LEVELS, MIN_SEEKS, SEEK_BYTES, VALUE, Options
from strata.sources import wal

info = logging.getLogger("strata.store")


class StoreError(RuntimeError):
    """A store that is missing, exists already, is damaged, locked or was changed by another writer."""


class _Files:
    """A folder by way of Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.gateway = spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)
        self.local = self.fs.getScheme() == "file"
        if self.local:  # without checksum files, which allow no flush within a block
            self.fs = self.fs.getRawFileSystem()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def list(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name))) if self.exists(name) else []

    def files(self, name: str) -> dict[str, float]:
        """All files below a folder by their paths from the root, with the seconds of their last change: one listing."""
        if not self.exists(name):
            return {}
        found, each = {}, self.fs.listFiles(self._path(name), True)
        top = self.fs.makeQualified(self._path("")).toUri().getPath().rstrip("/") + "/"
        while each.hasNext():
            s = each.next()
            found[s.getPath().toUri().getPath().removeprefix(top)] = s.getModificationTime() / 1000
        return found

    def read_bytes(self, name: str) -> bytes:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def read(self, name: str) -> str:
        return self.read_bytes(name).decode()

    def open_log(self, name: str):
        return self.fs.create(self._path(name), False)

    def _temporary(self, name: str, text: str):
        """A file of this writer alone."""
        temp = self._path(f"{name}.{uuid.uuid4().hex}.dbtmp")
        out = self.fs.create(temp, False)
        out.write(bytearray(text.encode()))
        out.hsync()
        out.close()
        return temp

    def _rename(self, source, target, how: str) -> None:
        options = self.gateway.new_array(getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename"), how)
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(source, target, options)

    def create(self, name: str, text: str) -> None:
        """Write a file that must not exist: it appears whole and at most once, however many try."""
        temp = self._temporary(name, text)
        try:
            if self.local:  # a link is refused if the name is taken; a rename would take its place
                where = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(where(self._path(name)), where(temp))
            else:
                self._rename(temp, self._path(name), "NONE")
        except Exception as e:
            if self.exists(name):
                raise StoreError(f"{name} exists: another writer committed first") from e
            raise
        finally:
            self.fs.delete(temp, False)

    def replace(self, name: str, text: str) -> None:
        """Write a file in place of one that may exist; at any time there is the old one or the new one."""
        self._rename(self._temporary(name, text), self._path(name), "OVERWRITE")

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def _key_text(key) -> str:
    return base64.b64encode(bytes(key)).decode()


def _bound(f: dict, name: str) -> bytes:
    return base64.b64decode(f[name])


#: Locks that stores of this process hold.
_HELD: set[str] = set()


@dataclass
class LevelStats:
    """What compactions and flushes into a level took and moved."""

    runs: int = 0
    seconds: float = 0.0
    read: int = 0
    written: int = 0

    def add(self, began: float, read: int, written: int) -> None:
        self.runs, self.seconds = self.runs + 1, self.seconds + time.time() - began
        self.read, self.written = self.read + read, self.written + written


@dataclass
class View:
    """A state of a store: its files, the rows that waited in memory, and its last sequence. While it is open, ``vacuum``
    keeps its files; a context manager."""

    store: Store
    files: list[dict]
    waiting: list[tuple]
    last_seq: int

    def __enter__(self) -> View:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.store.views.pop(id(self), None)

    def log(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """All entries of the files, and of those in memory, with keys of [low, high)."""
        names = [f["path"] for f in self.files if (low is None or _bound(f, "largest") >= low) and (high is None or _bound(f, "smallest") < high)]
        rows = [r for r in self.waiting if (low is None or r[0] >= low) and (high is None or r[0] < high)]
        low, high = (None if x is None else bytearray(x) for x in (low, high))
        spark = self.store.spark
        found = spark.read.schema(CHANGELOG).parquet(*[f"{self.store.path}/{n}" for n in names]) if names else spark.createDataFrame([], CHANGELOG)
        found = mvcc.key_range(found, low, high)
        return found.union(spark.createDataFrame([(bytearray(k), s, t, None if v is None else bytearray(v)) for k, s, t, v in rows], CHANGELOG)) if rows else found

    def scan(self, low: bytes | None = None, high: bytes | None = None, snapshot: int | None = None) -> DataFrame:
        return mvcc.scan(self.log(low, high), self.last_seq if snapshot is None else snapshot)

    def take(self, n: int, low: bytes | None = None, high: bytes | None = None, reverse: bool = False) -> list[tuple[bytes, bytes]]:
        """The first ``n`` live rows of a range, or the last ones from its end on."""
        key = F.col("user_key").desc() if reverse else F.col("user_key")
        return [(bytes(r["user_key"]), bytes(r["value"])) for r in self.scan(low, high).orderBy(key).limit(n).collect()]


class Store:
    """Open with ``Store.open``; a context manager. Keys and values are binary."""

    def __init__(self, spark: SparkSession, path: str, options: Options):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options.clamped()
        self.io = _Files(spark, path)
        self.snapshots: dict[int, int] = {}
        self.views: dict[int, set[str]] = {}
        self.pending: set[str] = set()  # folders that are being written
        self.stats = [LevelStats() for _ in range(LEVELS)]
        self.error: Exception | None = None
        self.seeks: dict[tuple[int, int], int] = {}
        self.victim: tuple[int, int] | None = None
        self.waiting: list[tuple] = []  # (key, seq, vtype, value) that the log holds and no file does
        self.waiting_bytes, self.lock = 0, None
        self._log, self._log_at, self._logs = None, 0, []
        self._load()

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options | None = None) -> Store:
        options = options or Options()
        io = _Files(spark, path)
        there = io.exists("CURRENT")
        if there and options.error_if_exists:
            raise StoreError(f"{path}: exists (error_if_exists is set)")
        if not there:
            if not options.create_if_missing:
                raise StoreError(f"{path}: does not exist (create_if_missing is not set)")
            if not io.exists("manifest/000001.json"):  # or a store whose creation was cut short here
                io.create("manifest/000001.json", json.dumps({"comparator": options.comparator, "last_seq": 0, "next_file": 2, "add": [], "del": [], "pointers": {}}))
            io.create("CURRENT", "000001\n")
        lock = cls._take_lock(io, options) if options.wal else None
        try:
            store = cls(spark, path, options)
            store.lock = lock
            if lock:
                store._recover()
            elif any(n.endswith(".log") for n in io.list("log")):
                info.warning("%s: logs are left to a store that is opened with wal", path)
        except BaseException:
            if lock:
                cls._drop_lock(io, lock)
            raise
        return store

    @staticmethod
    def destroy(spark: SparkSession, path: str) -> None:
        """Delete a store; a missing one is no error, a locked one is."""
        io = _Files(spark, path)
        if io.exists("LOCK"):
            Store._drop_lock(io, Store._take_lock(io, Options()))
        for name in ("data", "manifest", "log", "CURRENT", "LOCK"):
            io.delete(name)
        if not io.list():
            io.delete("")

    @staticmethod
    def _take_lock(io: _Files, options: Options) -> str:
        """One writer at a time. The lock of a process of this host that has ended is void; that of another host is
        taken over only with ``take_lock``."""
        own = uuid.uuid4().hex
        me = json.dumps({"id": own, "host": socket.gethostname(), "pid": os.getpid()})
        try:
            io.create("LOCK", me)
        except StoreError:
            held = json.loads(io.read("LOCK"))
            ended = held["host"] == socket.gethostname() and (held["id"] not in _HELD if held["pid"] == os.getpid() else not os.path.exists(f"/proc/{held['pid']}"))
            if not ended and not options.take_lock:
                raise StoreError(f"LOCK is held by process {held['pid']} of {held['host']}") from None
            io.replace("LOCK", me)
        _HELD.add(own)
        return own

    @staticmethod
    def _drop_lock(io: _Files, lock: str) -> None:
        _HELD.discard(lock)
        if io.exists("LOCK") and json.loads(io.read("LOCK"))["id"] == lock:
            io.delete("LOCK")

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Release snapshots and the lock. What waits in memory stays in the log for the next opening."""
        self.snapshots.clear()
        self.views.clear()
        if self._log is not None:
            self._log.close()
            self._log = None
        if self.lock:
            self._drop_lock(self.io, self.lock)
            self.lock = None

    # manifest

    def _load(self) -> None:
        current = self.io.read("CURRENT")
        if not current.endswith("\n"):
            raise StoreError("CURRENT does not end with a line end")
        first = current.strip()
        self.files: dict[tuple[int, int], dict] = {}
        self.removed: dict[str, float] = {}
        self.pointers: dict[int, bytes] = {}
        self.last_seq, self.next_file, self.edit = 0, 2, 0
        names = [n for n in self.io.list("manifest") if n.endswith(".json") and n >= f"{first}.json"]
        if not names:
            raise StoreError("the manifest that CURRENT names is missing")
        for name in names:
            edit = json.loads(self.io.read(f"manifest/{name}"))
            if edit.get("comparator", self.options.comparator) != self.options.comparator:
                raise StoreError(f"the store's comparator is {edit['comparator']}")
            self._apply(edit)
            self.edit = int(name.removesuffix(".json"))
        there = self.io.files("data")
        lost = sorted({f["path"] for f in self.files.values()} - there.keys())
        if lost:
            raise StoreError(f"{len(lost)} missing files; e.g. {lost[0]}")

    def _apply(self, edit: dict) -> None:
        for level, no in edit["del"]:
            if gone := self.files.pop((level, no), None):
                self.removed[gone["path"]] = edit.get("at", 0)
        for f in edit["add"]:
            self.files[f["level"], f["file_no"]] = f
            self.removed.pop(f["path"], None)
        self.removed |= edit.get("removed", {})
        self.pointers |= {int(k): base64.b64decode(v) for k, v in edit["pointers"].items()}
        self.last_seq, self.next_file = max(self.last_seq, edit["last_seq"]), max(self.next_file, edit["next_file"])

    def _commit(self, add: list[dict], delete: list[tuple[int, int]] = (), pointers: dict[int, bytes] | None = None, last_seq: int | None = None) -> None:
        edit = {
            "add": add, "del": [list(x) for x in delete], "pointers": {str(k): _key_text(v) for k, v in (pointers or {}).items()},
            "last_seq": 0 if last_seq is None else last_seq, "next_file": self.next_file, "at": time.time(),
        }
        self.io.create(f"manifest/{self.edit + 1:06d}.json", json.dumps(edit))
        self._apply(edit)
        self.edit += 1
        self.pending -= {f["path"].rsplit("/", 1)[0] for f in add}
        info.info("%s: edit %d adds %d files and removes %d; %s", self.path, self.edit, len(add), len(delete), self.level_summary())

    def checkpoint(self) -> None:
        """Write one edit with the whole state and make it the first to be read. At no time is there no first edit."""
        self.flush()
        whole = {
            "comparator": self.options.comparator, "add": list(self.files.values()), "del": [], "last_seq": self.last_seq, "next_file": self.next_file,
            "pointers": {str(k): _key_text(v) for k, v in self.pointers.items()}, "removed": self.removed,
        }
        self.io.create(f"manifest/{self.edit + 1:06d}.json", json.dumps(whole))
        self.edit += 1
        self.io.replace("CURRENT", f"{self.edit:06d}\n")

    def rows(self) -> list[FileRow]:
        return [FileRow(f["level"], f["file_no"], _bound(f, "smallest"), _bound(f, "largest"), f["file_size"]) for f in self.files.values()]

    def level_summary(self) -> str:
        return "files[ " + " ".join(str(self._count(i)) for i in range(LEVELS)) + " ]"

    def _count(self, level: int) -> int:
        return sum(x == level for x, _ in self.files)

    # writing

    def _check(self) -> None:
        if self.error is not None:
            raise StoreError(f"an earlier compaction failed: {self.error}") from self.error

    def _write_files(self, entries: DataFrame, level: int, size: int) -> list[dict]:
        """Write entries of ``size`` bytes in key order; one manifest row for each Parquet file."""
        folder = f"data/{self.next_file:06d}-{uuid.uuid4().hex[:8]}"  # writers may race for a number, never for a folder
        self.next_file += 1
        self.pending.add(folder)
        partitions = self.options.partitions or -(-size // self.options.max_file_size)
        placed = entries.repartitionByRange(partitions, "user_key") if partitions > 1 else entries.coalesce(1)
        writer = placed.sortWithinPartitions("user_key", F.col("seq").desc()).write.option("compression", self.options.compression).option("parquet.page.size", str(self.options.block_size))
        if self.options.bloom_bits:
            writer = writer.option("parquet.bloom.filter.enabled#user_key", "true")
        writer.parquet(f"{self.path}/{folder}")
        size = F.sum(F.octet_length("user_key") + 8 + F.coalesce(F.octet_length("value"), F.lit(0)))
        found = (
            self.spark.read.schema(CHANGELOG).parquet(f"{self.path}/{folder}")
            .groupBy(F.input_file_name().alias("f"))
            .agg(F.min("user_key").alias("lo"), F.max("user_key").alias("hi"), F.count(F.lit(1)).alias("n"), size.alias("size"))
        )
        out = []
        for r in sorted(found.collect(), key=lambda r: (bytes(r["lo"]), r["f"])):
            name = r["f"].rsplit("/", 1)[1]
            out.append({"level": level, "file_no": self.next_file, "path": f"{folder}/{name}", "smallest": _key_text(r["lo"]), "largest": _key_text(r["hi"]), "n_entries": r["n"], "file_size": r["size"]})
            self.next_file += 1
        return out

    def _flushed(self, rows: DataFrame, size: int, last_seq: int) -> None:
        """Commit new entries. The new files are disjoint, so each finds its level by itself."""
        began, held = time.time(), self.rows()
        added = self._write_files(rows, 0, size)
        for f in added:
            f["level"] = policy.flush_level(held, _bound(f, "smallest"), _bound(f, "largest"), self.options.max_file_size)
            self.stats[f["level"]].add(began, 0, f["file_size"])
            began = time.time()
        self._commit(added, last_seq=last_seq)

    def _make_room(self) -> None:
        """Keep level 0 short: from 8 files on, a writer runs one due compaction before it goes on; at 12 it runs
        them until no more than 4 are left."""
        self._check()
        if not self.options.back_pressure:
            return
        least = L0_COMPACTION if self._count(0) >= L0_STOP else self._count(0)
        while self._count(0) >= max(least, L0_COMPACTION) and self._count(0) >= (L0_COMPACTION if least == L0_COMPACTION else L0_SLOWDOWN):
            plan = policy.pick(self.rows(), self.pointers, target=self.options.max_file_size)
            if plan is None:
                return
            self.run_compaction(plan)

    def write(self, batch: DataFrame) -> int:
        """Commit ``batch(pos, user_key, vtype, value)`` as one atomic batch; the last sequence it got."""
        self.flush()
        self._make_room()
        base = self.last_seq
        # positions need not be dense: they are ranked by range, without a single task for all of them
        size = F.sum(F.octet_length("user_key") + 8 + F.coalesce(F.octet_length("value"), F.lit(0)))
        n, low, high, size = batch.agg(F.count(F.lit(1)), F.min("pos"), F.max("pos"), size).head()
        if not n:
            return base
        if dict(batch.dtypes)["pos"] in ("int", "bigint") and high - low + 1 == n:
            numbered = batch.withColumn("seq", F.col("pos").cast("long") - low + base + 1)
        else:
            from strata.operators.order import rank_all

            numbered = rank_all(batch, "pos", "seq").withColumn("seq", F.col("seq") + base)
        rows = numbered.select(F.col("user_key").cast("binary").alias("user_key"), F.col("seq").cast("long").alias("seq"), F.col("vtype").cast("int").alias("vtype"), F.col("value").cast("binary").alias("value"))
        self._flushed(rows, size, base + n)
        return self.last_seq

    def write_rows(self, rows: list[tuple], sync: bool | None = None) -> int:
        """A small batch of (vtype, key, value). With a log it waits in memory until ``write_buffer`` bytes do; ``sync``
        forces the log to disk before it returns. Without one it is committed at once, and always durable."""
        if not self.lock:
            data = [(i, bytearray(k), t, None if v is None else bytearray(v)) for i, (t, k, v) in enumerate(rows)]
            return self.write(self.spark.createDataFrame(data, "pos long, user_key binary, vtype int, value binary"))
        self._check()
        if not rows:
            return self.last_seq
        self._append(wal.encode_batch(self.last_seq + 1, rows), self.options.sync if sync is None else sync)
        self._remember([(k, self.last_seq + 1 + i, t, v) for i, (t, k, v) in enumerate(rows)])
        if self.waiting_bytes >= self.options.write_buffer:
            self.flush()
        return self.last_seq

    def put(self, key: bytes, value: bytes) -> int:
        return self.write_rows([(VALUE, key, value)])

    def delete(self, key: bytes) -> int:
        return self.write_rows([(DELETION, key, None)])

    # the log of small writes

    def _append(self, record: bytes, sync: bool) -> None:
        if self._log is None:
            self._logs.append(f"log/{self.next_file:06d}-{uuid.uuid4().hex[:8]}.log")
            self.next_file += 1
            self._log, self._log_at = self.io.open_log(self._logs[-1]), 0
        data = wal.encode([record], self._log_at)
        self._log.write(bytearray(data))
        self._log_at += len(data)
        self._log.hsync() if sync else self._log.hflush()

    def _remember(self, rows: list[tuple]) -> None:
        self.waiting += rows
        self.waiting_bytes += sum(len(k) + 8 + len(v or b"") for k, _, _, v in rows)
        self.last_seq = max([self.last_seq, *(s for _, s, _, _ in rows)])

    def _recover(self) -> None:
        """Take in what the logs of the last writer hold beyond the manifest. A record that its end cuts short was never
        acknowledged; damage is told, or with ``paranoid`` refused."""
        flushed, rows = self.last_seq, []
        for name in (n for n in self.io.list("log") if n.endswith(".log")):
            for payload, dropped, why in wal.decode(self.io.read_bytes(f"log/{name}")):
                try:
                    if why:
                        raise ValueError(f"{dropped} bytes: {why}")
                    rows += [(k, s, t, v) for s, t, k, v in wal.decode_batch(payload) if s > flushed]
                except ValueError as e:
                    if self.options.paranoid:
                        raise StoreError(f"{name}: {e}") from e
                    info.warning("%s: %s: %s", self.path, name, e)
            self._logs.append(f"log/{name}")
        self._remember(sorted(rows, key=lambda r: r[1]))
        info.info("%s: recovered %d rows of %d logs", self.path, len(rows), len(self._logs))
        if not self.options.reuse_logs or not rows:
            self.flush()

    def flush(self) -> None:
        """Write what waits in memory to files; its logs are then obsolete."""
        self._check()
        rows, logs = self.waiting, self._logs
        if rows:
            self._make_room()
            data = [(bytearray(k), s, t, None if v is None else bytearray(v)) for k, s, t, v in rows]
            self._flushed(self.spark.createDataFrame(data, CHANGELOG), self.waiting_bytes, self.last_seq)
        self.waiting, self.waiting_bytes, self._logs = [], 0, []
        if self._log is not None:
            self._log.close()
            self._log = None
        for name in logs:
            self.io.delete(name)

    # reading

    def view(self) -> View:
        """The store as it is now; close it, or ``vacuum`` keeps its files."""
        view = View(self, list(self.files.values()), list(self.waiting), self.last_seq)
        self.views[id(view)] = {f["path"] for f in view.files}
        return view

    def log(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """All entries that may have keys of [low, high). ``vacuum`` spares the files of such a frame for ``Options.retain``
        seconds after a compaction has replaced them; a ``view`` keeps them for as long as it is open."""
        with self.view() as view:
            return view.log(low, high)

    def snapshot(self) -> int:
        """Take a snapshot; ``release`` it, or compactions keep what it sees."""
        self.snapshots[self.last_seq] = self.snapshots.get(self.last_seq, 0) + 1
        return self.last_seq

    def release(self, snapshot: int) -> None:
        self.snapshots[snapshot] -= 1
        if not self.snapshots[snapshot]:
            del self.snapshots[snapshot]

    def scan(self, low: bytes | None = None, high: bytes | None = None, snapshot: int | None = None) -> DataFrame:
        with self.view() as view:
            return view.scan(low, high, snapshot)

    def take(self, n: int, low: bytes | None = None, high: bytes | None = None, reverse: bool = False) -> list[tuple[bytes, bytes]]:
        with self.view() as view:
            return view.take(n, low, high, reverse)

    def get(self, key: bytes, snapshot: int | None = None) -> bytes | None:
        """The value of a key: from memory if its newest visible version waits there, else from the files that may hold it, in one
        job. A key that is not in the first file of its search order charges that file with a seek."""
        upto = self.last_seq if snapshot is None else snapshot
        near = max((r for r in self.waiting if r[0] == key and r[1] <= upto), key=lambda r: r[1], default=None)
        if near is not None:  # entries in memory are newer than those of any file
            return near[3] if near[2] == VALUE else None
        order = policy.search_order(self.rows(), key)
        if not order:
            return None
        paths = {self.files[f.level, f.file_no]["path"]: (f.level, f.file_no) for f in order}
        held = self.spark.read.schema(CHANGELOG).parquet(*[f"{self.path}/{p}" for p in paths]).withColumn("file", F.input_file_name())
        best = F.max(F.struct("seq", "vtype", "value", "file"))
        row = held.where((F.col("user_key") == F.lit(bytearray(key))) & (F.col("seq") <= upto)).agg(best.alias("b")).head()["b"]
        found = row and next(no for p, no in paths.items() if row["file"].endswith(p))
        if len(order) > 1 and found != (order[0].level, order[0].file_no):
            self._charge((order[0].level, order[0].file_no))
        return bytes(row["value"]) if row and row["vtype"] == VALUE else None

    def _charge(self, at: tuple[int, int]) -> None:
        left = self.seeks.get(at, max(MIN_SEEKS, self.files[at]["file_size"] // SEEK_BYTES)) - 1
        self.seeks[at] = left
        if left <= 0 and self.victim not in self.files:
            self.victim = at

    def record_read_sample(self, key: bytes) -> bool:
        """What a cursor does once for about each MiB it reads: if a second file may hold the key, the first is charged."""
        some = list(islice(iter(policy.search_order(self.rows(), key)), 2))
        if len(some) == 2:
            self._charge((some[0].level, some[0].file_no))
        return len(some) == 2

    def multi_get(self, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
        return mvcc.multi_get(self.log(), keys, self.last_seq if snapshot is None else snapshot)

    def property(self, name: str) -> str | None:
        """``num-files-at-level<N>``, ``stats``, ``sstables``, ``approximate-size`` and ``approximate-memory-usage``; None for others.

        The memory is that of the entries which wait for a file and of the file table.
        """
        if name.startswith("num-files-at-level") and name[18:].isdigit() and int(name[18:]) < LEVELS:
            return str(self._count(int(name[18:])))
        if name == "approximate-memory-usage":
            return str(self.waiting_bytes + sum(96 + sum(len(f[k]) for k in ("path", "smallest", "largest")) for f in self.files.values()) + 4096)
        if name == "stats":
            lines = [(i, self._count(i), sum(f["file_size"] for f in self.files.values() if f["level"] == i), s) for i, s in enumerate(self.stats)]
            return "level files bytes runs seconds read written\n" + "".join(f"{i} {n} {size} {s.runs} {s.seconds:.3f} {s.read} {s.written}\n" for i, n, size, s in lines if n or s.runs)
        if name == "sstables":
            rows = sorted(self.rows(), key=lambda f: (f.level, f.file_no))
            return "".join(f"{f.level} {f.file_no} {f.file_size} [{f.smallest!r} .. {f.largest!r}]\n" for f in rows)
        return str(sum(f["file_size"] for f in self.files.values())) if name == "approximate-size" else None

    def approximate_sizes(self, ranges: list[tuple[bytes, bytes]]) -> list[int]:
        """Bytes stored in each [low, high). Files that lie within a range count by the manifest; only those that a bound
        cuts are read, in one pass."""
        sizes, cut = [0] * len(ranges), []
        for f in self.files.values():
            a, b = _bound(f, "smallest"), _bound(f, "largest")
            for i, (low, high) in enumerate(ranges):
                if low <= a and b < high:
                    sizes[i] += f["file_size"]
                elif a < high and b >= low:
                    cut.append((i, bytearray(low), bytearray(high), f["path"]))
        if cut:
            asked = self.spark.createDataFrame(cut, "range_no long, low binary, high binary, path string")
            names = sorted({c[3] for c in cut})
            rows = self.spark.read.schema(CHANGELOG).parquet(*[f"{self.path}/{n}" for n in names])
            path = F.concat(F.lit("data/"), F.substring_index(F.input_file_name(), "/data/", -1))
            size = F.octet_length("user_key") + 8 + F.coalesce(F.octet_length("value"), F.lit(0))
            each = rows.select("user_key", size.alias("size"), path.alias("path")).join(asked, "path").where((F.col("user_key") >= F.col("low")) & (F.col("user_key") < F.col("high")))
            for r in each.groupBy("range_no").agg(F.sum("size").alias("size")).collect():
                sizes[r["range_no"]] += r["size"]
        return sizes

    # maintenance

    def run_compaction(self, plan: policy.Plan) -> None:
        """Merge a plan's inputs into the next level, or only move a file that nothing overlaps. If it fails, writes are
        refused until the store is opened again."""
        self._check()
        try:
            self._run_compaction(plan)
        except Exception as e:
            self.error = e
            raise

    def _run_compaction(self, plan: policy.Plan) -> None:
        began = time.time()
        target, old = plan.level + 1, [(f.level, f.file_no) for f in plan.inputs + plan.below]
        pointer = {plan.level: policy.span(plan.inputs)[1]}
        for at in old:
            self.seeks.pop(at, None)
        if plan.trivial:
            f = self.files[old[0]]
            self._commit([f | {"level": target}], old, pointer)
            return
        rows = self.spark.read.schema(CHANGELOG).parquet(*[f"{self.path}/{self.files[k]['path']}" for k in old])
        deeper = [(bytearray(f.smallest), bytearray(f.largest)) for f in self.rows() if f.level > target]
        keep = min(self.snapshots, default=self.last_seq)
        kept = compact.drop_obsolete(rows, keep, self.spark.createDataFrame(deeper, "smallest binary, largest binary") if deeper else None)
        size = sum(self.files[k]["file_size"] for k in old)
        added = self._write_files(kept, target, size)
        self._commit(added, old, pointer)
        self.stats[target].add(began, size, sum(f["file_size"] for f in added))

    def compact(self, low: bytes | None = None, high: bytes | None = None) -> None:
        """Compact a range, level by level, down to the deepest level that holds it; level 0 always."""
        self.flush()
        deepest = max([1, *(f.level for f in self.rows() if policy.overlaps(self.rows(), f.level, low, high))])
        for level in range(deepest):
            if plan := policy.manual(self.rows(), level, low, high):
                self.run_compaction(plan)

    def maintain(self) -> int:
        """Run due compactions, those of files whose seeks are spent last; how many ran."""
        n = 0
        while True:
            victim = next((f for f in self.rows() if (f.level, f.file_no) == self.victim), None)
            plan = policy.pick(self.rows(), self.pointers, victim if victim and victim.level < LEVELS - 1 else None, self.options.max_file_size)
            if plan is None:
                return n
            self.run_compaction(plan)
            n += 1

    def vacuum(self, retain: float | None = None) -> list[str]:
        """Delete data files that no manifest row names, edits before the checkpoint, and temporary files.

        What is younger than ``retain`` seconds stays, whether it was written, so that another writer may be about to commit
        it, or replaced, so that a frame may still read it; by default ``Options.retain``. So do files of open views and
        folders that this store is writing, whatever their age.
        """
        oldest = time.time() - (self.options.retain if retain is None else retain)
        now = Store(self.spark, self.path, self.options)  # other writers may have committed since this store was opened
        keep = {f["path"] for s in (self, now) for f in s.files.values()}.union(*self.views.values())
        self.removed |= now.removed
        first = self.io.read("CURRENT").strip() + ".json"
        gone = []
        for path, changed in (self.io.files("data") | self.io.files("manifest")).items():
            folder, name = path.rsplit("/", 1)
            if folder == "manifest" and not (name.endswith(".dbtmp") or name < first):
                continue
            if path not in keep and folder not in self.pending and max(changed, self.removed.get(path, 0)) <= oldest:
                self.io.delete(path)
                self.removed.pop(path, None)
                gone.append(path)
        for folder in {p.rsplit("/", 1)[0] for p in gone} - {"manifest"}:
            if not self.io.list(folder):
                self.io.delete(folder)
        return sorted(gone)
