"""What the operators share: scratch tables, text batches, chunk caches and document splits."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a two-column id table may be broadcast (16 bytes a row in a hashed relation).
BROADCAST_ROWS = 500_000
#: Bytes of a batch of rows on its way to Python.
BATCH_BYTES = 2 << 20


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder that the cluster names in spark.checkpoint.dir.

    Where that is unset a temporary folder is made and set, but only if every executor runs on the driver's machine (local master).
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='onomast-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/onomast-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """The table written to the shared folder and read again: lineage ends there and executors may be lost."""
    path = scratch_dir(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table through Spark's own file system layer."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on the session hands rows to Python in batches of at most about `most` bytes.

    The default (10,000 rows, 64 MB) costs each task a multiple of that, on both sides, where texts are long.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > most:
        spark.conf.set(key, str(most))


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, with marks added until no column has them (in any case, as Spark compares names)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def others(columns: Iterable[str], *results: str) -> list[str]:
    """The columns that no result is named as, in any case, as Spark compares names."""
    taken = {r.lower() for r in results}
    return [c for c in columns if c.lower() not in taken]


def one_of(rows: DataFrame, column: str) -> Column:
    """One value of a group: the least, or the first met where values of that type have no order."""
    kind = rows.schema[column].dataType.simpleString()
    return F.first(column) if "map<" in kind or "variant" in kind else F.min(column)


def row_slices(batch: pa.RecordBatch, text: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows so that each piece holds about max_bytes of text (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, text: str) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]


def release() -> None:
    """Gives freed memory back at a task's end, since a worker process lives on for the tasks of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: What an operator keeps between the tasks of this worker process.
_held: dict = {}


def worker_state(key, make: Callable[[], object]):
    """The state made for `key`, kept for the next tasks of the same operator; a worker holds one operator's state at a time."""
    if key not in _held:
        _held.clear()
        release()
        _held[key] = make()
    return _held[key]


#: Longer pieces are kept for their batch only.
LONGEST_PIECE = 64


class ChunkCache(dict):
    """Maps the pieces between spaces to what an operator made of them.

    Text repeats its words, so most work is done once a word. Two generations bound the memory by bytes: a full
    young generation becomes the old one, and pieces met again move back to the young one. What the
    cache holds never changes a result.
    """

    def __init__(self, make=None, limit: int = 12 << 20, size: Callable[[object], int] = lambda value: 64):
        super().__init__()
        self.make, self.limit, self.size = make, limit, size
        self.old: dict = {}
        self.spent, self.brief = 0, []

    def keep(self, key, value) -> None:
        if len(key) > LONGEST_PIECE:
            self.brief.append(key)
        else:
            self.spent += 120 + len(key) + self.size(value)
        self[key] = value

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST_PIECE:
            self.keep(key, value)
        return value

    def learn(self, keys: set, make_all: Callable[[list], list]) -> None:
        """Afterwards all keys are known; the values of those that neither generation holds are made together."""
        missing = keys.difference(self)
        if not missing:
            return
        found = missing.intersection(self.old)
        fresh = list(missing.difference(found))
        keys, values = [*found, *fresh], [*map(self.old.__getitem__, found), *make_all(fresh)]
        self.update(zip(keys, values, strict=True))
        self.brief += [k for k in keys if len(k) > LONGEST_PIECE]
        self.spent += 120 * len(keys) + sum(map(len, keys)) + sum(map(self.size, values))

    def trim(self) -> None:
        """To be called between batches."""
        for key in self.brief:
            self.pop(key, None)
        self.brief.clear()
        if self.spent > self.limit:
            self.old = dict(self)
            self.clear()
            self.spent = 0


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
