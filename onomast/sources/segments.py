"""An index that grows by segments: rows are added, replaced by key and deleted without a rewrite, and every commit is a consistent whole.

Files below one folder:
  commits/<n>     one JSON line: the segments and tombstone folders that count, live rows, the next insertion number
  rows/<id>       a segment: the analysed columns, `_seq` (the insertion number, dense over all segments) and `<column>_norm`, a norm byte of each scored column
  dead/<id>       tombstones: block, bits. A bit for each of the block's 32,768 insertion numbers, set if the row is gone
  freqs/<id>      field, term, doc_freq: what an addition adds to document frequencies, or a deletion takes away, sorted by (field, term)

Insertion numbers need no shuffle: a row's place in its task, plus the number of rows of the tasks before it. A row that replaces another is inserted anew.
Additions and deletions touch the keys of the rows concerned and nothing else; frequencies stay exact, since those of rows that go are taken away when they
go. Readers see the last commit; what wasn't committed, or was lost on the way, is never read. Commits have one writer.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onomast.functions import similarity as sim
from onomast.sources.schema import index as analysed
from onomast.sources.store import removed

SEQ = "_seq"
#: Insertion numbers up to which the tombstones, a bit a row, are broadcast (128 MB); beyond it rows are shuffled to them.
BROADCAST_BITS = 1 << 30


@dataclass(frozen=True)
class State:
    """What a commit holds."""

    version: int = 0
    segments: tuple[str, ...] = ()
    dead: tuple[str, ...] = ()
    freqs: tuple[str, ...] = ()
    docs: int = 0
    next: int = 0


@dataclass
class Segments:
    """An index below `path`, whose rows have the key column `key`. counted: token columns with document frequencies and norms; boosts: their index-time boosts."""

    spark: SparkSession
    path: str
    key: str
    counted: tuple[str, ...] = ()
    synonyms: Mapping[str, dict] | None = None
    boosts: Mapping[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.state = self.pending = self._last()

    # --- commits

    def _files(self, folder: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []

    def _last(self) -> State:
        done = [int(name) for name in self._files("commits") if name.isdigit() and "_SUCCESS" in self._files(f"commits/{name}")]
        if not done:
            return State()
        row = json.loads(self.spark.read.text(f"{self.path}/commits/{max(done)}").first()["value"])
        return State(**{k: tuple(v) if isinstance(v, list) else v for k, v in row.items()})

    def commit(self) -> State:
        """What was added and deleted since the last commit becomes visible, all at once."""
        made = replace(self.pending, version=self.state.version + 1)
        line = json.dumps(made.__dict__)
        self.spark.range(1).select(F.lit(line).alias("value")).coalesce(1).write.text(f"{self.path}/commits/{made.version}")
        self.state = self.pending = made
        return made

    # --- changes

    def _write(self, df: DataFrame, kind: str) -> str:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/{kind}/{name}")
        return name

    def add(self, df: DataFrame, order: Sequence[str] = ()) -> None:
        """Adds the rows in their order, or in that of the columns `order` (a table's files are read in any order); of rows that share a key (of these, or of earlier ones) the last stays."""
        if order:
            df = df.orderBy(*order)
        made = analysed(df, self.synonyms)
        norms = {f"{c}_norm": sim.norm_code(sim.field_length(F.col(c)), self.boosts.get(c, 1.0)).cast("short") for c in self.counted}
        name = self._write(made.withColumns(norms).withColumn("_at", F.monotonically_increasing_id()), "staged")
        staged = self.spark.read.parquet(f"{self.path}/staged/{name}")
        part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
        sizes = {r["part"]: r["count"] for r in staged.groupBy(part.alias("part")).count().collect()}
        offsets, total = [], self.pending.next
        for k in range(max(sizes, default=-1) + 1):
            offsets.append(total)
            total += sizes.get(k, 0)
        seq = F.element_at(F.lit(offsets).cast("array<bigint>"), part.cast("int") + 1) + place if offsets else F.lit(0)
        at, name = name, self._write(staged.withColumn(SEQ, seq.cast("bigint")).drop("_at"), "rows")
        removed(self.spark, f"{self.path}/staged/{at}")
        rows = self.spark.read.parquet(f"{self.path}/rows/{name}")
        before = self.pending
        newest = rows.groupBy(self.key).agg(F.max(SEQ).alias("before"), F.count(F.lit(1)).alias("n")).where(F.col(self.key).isNotNull())
        old = self._live(before).select(self.key).where(F.col(self.key).isNotNull()).distinct().withColumn("old", F.lit(True)) if before.segments else None
        gone = newest if old is None else newest.join(old, self.key, "left")
        gone = gone.where(F.col("n") > 1 if old is None else (F.col("n") > 1) | F.col("old")).select(self.key, "before")
        self.pending = replace(before, segments=(*before.segments, name), docs=before.docs + total - before.next, next=total, freqs=(*before.freqs, *self._freqs(rows, 1)))
        self._bury(gone)

    def delete(self, keys: DataFrame) -> None:
        """Rows whose key is listed in the key column of `keys` go."""
        self._bury(keys.select(self.key).where(F.col(self.key).isNotNull()).distinct().withColumn("before", F.lit(self.pending.next).cast("bigint")))

    def _bury(self, gone: DataFrame) -> None:
        live = self._live(self.pending)
        dying = live.select(self.key, SEQ).join(gone, self.key).where(F.col(SEQ) < F.col("before")).select((F.col(SEQ) + 1).alias("at"))
        bits = dying.groupBy(F.bitmap_bucket_number("at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
        name = self._write(bits, "dead")
        bits = self.spark.read.parquet(f"{self.path}/dead/{name}")
        n = bits.agg(F.sum(F.bitmap_count("bits")).alias("n")).first()["n"]
        if n:
            freqs = self._freqs(self._marked(live, bits, "inner").where("_gone").drop("_gone"), -1)
            self.pending = replace(self.pending, dead=(*self.pending.dead, name), docs=self.pending.docs - n, freqs=(*self.pending.freqs, *freqs))

    def _marked(self, rows: DataFrame, bits: DataFrame, how: str) -> DataFrame:
        """The rows with `_gone`, whether their bit is set; only the bits move."""
        at = F.col(SEQ) + 1
        tests = bits.select(F.col("block").alias("_block"), F.col("bits").alias("_bits"))
        if self.pending.next <= BROADCAST_BITS:
            tests = F.broadcast(tests)
        place = F.bitmap_bit_position(at)
        byte = F.conv(F.hex(F.substr(F.col("_bits"), F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        met = rows.join(tests, F.bitmap_bucket_number(at) == F.col("_block"), how)
        return met.withColumn("_gone", F.coalesce(F.getbit(byte, place.bitwiseAND(7).cast("int")) == 1, F.lit(False))).drop("_block", "_bits")

    def _freqs(self, rows: DataFrame, sign: int) -> list[str]:
        if not self.counted:
            return []
        parts = [rows.select(F.lit(c).alias("field"), F.explode(F.array_distinct(F.transform(c, lambda t: t["token"]))).alias("term")) for c in self.counted]
        counted = reduce(DataFrame.union, parts).groupBy("field", "term").agg((F.count(F.lit(1)) * sign).alias("doc_freq"))
        return [self._write(counted.repartitionByRange("field", "term").sortWithinPartitions("field", "term"), "freqs")]

    def merge(self) -> None:
        """All live rows as one segment with their insertion numbers, and one table of frequencies."""
        before = self.pending
        if not before.segments:
            return
        rows = self._write(self._live(before), "rows")
        freqs = self._all_freqs(before)
        names = (self._write(freqs.repartitionByRange("field", "term").sortWithinPartitions("field", "term"), "freqs"),) if freqs is not None else ()
        self.pending = replace(before, segments=(rows,), dead=(), freqs=names)

    # --- reading

    def _live(self, state: State) -> DataFrame:
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self.spark.read.parquet(f"{self.path}/rows/{s}") for s in state.segments])
        if not state.dead:
            return rows
        dead = self.spark.read.parquet(*[f"{self.path}/dead/{d}" for d in state.dead]).groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))
        return self._marked(rows, dead, "left").where("not _gone").drop("_gone")

    def rows(self) -> DataFrame:
        """The live rows of the last commit; `_seq` is the order of ties."""
        if not self.state.segments:
            raise ValueError("nothing was committed")
        return self._live(self.state)

    def _all_freqs(self, state: State) -> DataFrame | None:
        if not state.freqs:
            return None
        rows = self.spark.read.parquet(*[f"{self.path}/freqs/{f}" for f in state.freqs])
        return rows.groupBy("field", "term").agg(F.sum("doc_freq").alias("doc_freq")).where("doc_freq <> 0")

    def frequencies(self, column: str, terms: Iterable[str]) -> tuple[int, dict[str, int]]:
        """Live rows and document frequencies of a few terms, from the rows of the frequency tables that name them; no document is read."""
        wanted = list(dict.fromkeys(terms))
        freqs = self._all_freqs(self.state)
        found = {} if freqs is None or not wanted else {r["term"]: r["doc_freq"] for r in freqs.where((F.col("field") == column) & F.col("term").isin(wanted)).collect()}
        return self.state.docs, {t: found.get(t, 0) for t in wanted}


def norm_columns(counted: Iterable[str]) -> dict[str, str]:
    """The columns that keep the norm bytes of scored columns."""
    return {c: f"{c}_norm" for c in counted}
