"""N-gram Jaccard join with MinHash banding, verified on full n-gram sets.

1. Every text becomes its set of hashed five-word shingles (a shorter text: one shingle of all its words). Texts with
   the same set are one representative with a count of copies; they are never compared with one another.
2. A representative's MinHash values are cut into bands. Bands and rows are chosen so that a pair at the threshold shares a
   band with the target recall. Representatives are shuffled by band hash, and each is tied to the least of
   its bucket - as many ties as rows, whatever the bucket's size. Tied representatives form candidate components.
3. Candidates are verified on the full sets. A component small enough is one block, all of whose pairs are compared. The
   members of a larger one are dealt out to blocks of bounded size, by size class and least band hash, so that members alike
   stand together; a least band hash that many members share is split by a hash of the member. Two blocks meet only if they share a band
   and their sizes can reach the threshold. A block pair is one group, compared by matrix products, and gives
   each member's link count and a spanning forest, not pairs. So every pair that shares a band is verified.
4. Links' components are the classes.

Result: class_id (least id of the class) and n_links (rows whose set has a Jaccard similarity at or above the threshold, copies included)
for each row. Words are runs of letters, digits and non-ASCII characters of the lower-cased text.

Defined results: null texts and texts without words are alone, with their own id as class and no links. Repeated rows are copies. Null ids
count as documents; a class whose ids are all null has a null class_id. Other columns play no part.
Very long texts are read whole: a text is one set, however large. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from onomast.llm.common import BROADCAST_ROWS, ChunkCache, one_of, release, row_slices, small_batches, unused, worker_state, written
from onomast.llm.components import connected
from onomast.llm.decontaminate import WORD_BYTES

SHINGLE, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 128
BATCH_BYTES = 2 << 20
#: Members and shingles of a block, about.
BLOCK_ROWS, BLOCK_SHINGLES = 128, 1 << 19


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, that reach the recall at the threshold with at most `most` hashes."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def _mixed(z: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def known_words() -> ChunkCache:
    return worker_state("word hashes", lambda: ChunkCache(word_hash))


def shingles(texts: list[str], known: ChunkCache, size: int = SHINGLE) -> list[np.ndarray]:
    """Each text's sorted set of shingle hashes."""
    split = [t.lower().encode().translate(WORD_BYTES).split() for t in texts]
    counts = [len(w) for w in split]
    flat = np.array([known[w] for ws in split for w in ws], np.uint64)
    known.trim()
    total = np.zeros(max(0, len(flat) - size + 1), np.uint64)
    factor = 1
    for k in range(size):
        total += flat[k : k + len(total)] * np.uint64(factor)
        factor = factor * 0x9E3779B97F4A7C15 % (1 << 64)
    total = _mixed(total)
    out, at = [], 0
    for n in counts:
        if n >= size:
            out.append(np.unique(total[at : at + n - size + 1]))
        elif n:
            short = 0
            for w in flat[at : at + n].tolist():
                short = (short * 0xD1B54A32D192ED03 + w + 1) % (1 << 64)
            out.append(_mixed(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def _prints(sets: list[np.ndarray]) -> list[bytes]:
    """A 128-bit fingerprint of each set."""
    return [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]


def _signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """A row of band hashes for each set, none of them empty."""
    flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    draw = np.random.default_rng(11)
    odd = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    out = np.zeros((len(sets), bands), np.uint64)
    for b in range(bands):
        hashed = np.full(len(sets), b + 1, np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            value = flat * odd[k]
            value ^= value >> np.uint64(32)
            value += plus[k]
            value *= np.uint64(0x9E3779B97F4A7C15)
            hashed = _mixed(hashed * np.uint64(0xD1B54A32D192ED03) + np.minimum.reduceat(value, starts))
        out[:, b] = hashed
    return out


def _field(part: pa.RecordBatch, name: str):
    return part.column(part.schema.get_field_index(name))


def signatures(docs: DataFrame, doc_id: str, text: str, bands: int, rows: int) -> DataFrame:
    """id, h (a hash of the text), n (shingles), print and bands of each row."""
    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), T.StructField("h", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("print", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_words()
        for batch in batches:
            for part in row_slices(batch, "t", BATCH_BYTES):
                sets = shingles([t or "" for t in _field(part, "t").to_pylist()], known)
                full = [s for s in sets if len(s)]
                made = iter(_signatures(full, bands, rows).astype(np.int64).tolist() if full else [])
                yield pa.RecordBatch.from_arrays([_field(part, "id"), _field(part, "h"), pa.array([len(s) for s in sets], pa.int32()), pa.array(_prints(sets), pa.binary()), pa.array([next(made) if len(s) else [] for s in sets], pa.list_(pa.int64()))], schema.names)
        release()

    small_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("t")).mapInArrow(run, schema)


def _sets(docs: DataFrame, text: str) -> DataFrame:
    """print and shingles of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_words()
        for batch in batches:
            for part in row_slices(batch, text, BATCH_BYTES):
                sets = shingles([t or "" for t in _field(part, text).to_pylist()], known)
                ends = np.cumsum([0] + [len(s) for s in sets])
                flat = np.concatenate(sets).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(_prints(sets), pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["print", "shingles"])
        release()

    return docs.select(text).mapInArrow(run, "print binary, shingles array<long>")


def overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many shingles each two sets share: products of incidence matrices over the shingles that two or more have."""
    n = len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    _, place, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(often > 1) - 1
    keep = often[place] > 1
    place, owner = shared[place[keep]], owner[keep]
    by = np.argsort(place, kind="stable")
    place, owner = place[by], owner[by]
    total = np.zeros((n, n), np.float32)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        a, z = np.searchsorted(place, [low, low + columns])
        part = np.zeros((n, columns), np.float32)
        part[owner[a:z], place[a:z] - low] = 1
        total += part @ part.T
    return total.astype(np.int64)


def _compared(ids: list[int], block: list[bool], copies: list[int], sets: list[np.ndarray], same: bool, threshold: float) -> tuple[list[int], list[int]]:
    """Links of each member to members of the other block (or its own), and the least member it is linked to, perhaps through others."""
    shared, sizes = overlaps(sets), np.array([len(s) for s in sets])
    linked = shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-9
    np.fill_diagonal(linked, False)
    if not same:
        side = np.array(block)
        linked &= side[:, None] != side[None, :]
    links = linked @ np.array(copies, np.int64)
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(np.triu(linked)), strict=True):
        a, b = find(int(i)), find(int(j))
        if a != b:
            root[max(a, b)] = min(a, b)
    return links.tolist(), [ids[find(k)] for k in range(len(ids))]


def _verified(members: DataFrame, threshold: float) -> DataFrame:
    """node, other, links - from members (node, comp, copies, i, j, first, shingles) dealt out by block pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def given():
            if len(rows) > 1:
                ids = [r[0] for r in rows]
                links, other = _compared(ids, [r[2] for r in rows], [r[1] for r in rows], [r[3] for r in rows], key[1] == key[2], threshold)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(other, pa.int64()), pa.array(links, pa.int64())], ["node", "other", "links"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("comp", "i", "j")), strict=True))
            plain = list(zip(*(batch.column(c).to_pylist() for c in ("node", "copies", "first")), strict=True))
            lists = batch.column("shingles")
            for k, now in enumerate(keys):
                if now != key:
                    yield from given()
                    key, rows = now, []
                rows.append((*plain[k], lists[k].values.to_numpy(zero_copy_only=False)))
        yield from given()
        rows.clear()
        release()

    dealt = members.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "node")
    return dealt.mapInArrow(run, "node long, other long, links long")


def _few(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _placed(tied: DataFrame) -> DataFrame:
    """tied (comp, n, bands and more) with block; 0 is the only block of its component."""
    weight = F.count(F.lit(1)) / BLOCK_ROWS + F.sum("n") / BLOCK_SHINGLES
    large = written(tied.groupBy("comp").agg(weight.alias("w")).where("w > 1").select("comp"), "ngram_large")
    spots = tied.join(_few(large), "comp", "left_semi").groupBy("comp", "size_class", "near").agg(weight.alias("w"))
    spots = written(spots, "ngram_spots")
    classes = written(spots.groupBy("comp", "size_class").agg(F.ceil(F.sum("w")).cast("long").alias("buckets")), "ngram_size_classes")
    spots = spots.join(_few(classes), ["comp", "size_class"]).select("comp", "size_class", "near", "buckets", F.ceil("w").cast("long").alias("parts"))
    spots = written(spots, "ngram_places")
    block = F.when(F.col("parts") > 1, F.xxhash64("size_class", "near", F.pmod(F.xxhash64("node"), F.col("parts")))).otherwise(F.xxhash64("size_class", F.pmod("near", F.col("buckets"))))
    placed = tied.join(_few(spots), ["comp", "size_class", "near"], "left")
    return placed.select("node", "print", "least", "copies", "n", "bands", "comp", F.coalesce(block, F.lit(0)).alias("block"))


def _meetings(placed: DataFrame, threshold: float) -> DataFrame:
    """comp, block, i, j, first: the block pairs in which a block of a large component takes part."""
    split = placed.where("block <> 0")
    blocks = written(split.groupBy("comp", "block").agg(F.min("n").alias("low"), F.max("n").alias("high")), "ngram_blocks")
    marks = split.select("comp", "block", F.explode("bands").alias("band")).distinct().join(_few(blocks), ["comp", "block"])
    marks = written(marks, "ngram_marks")
    a = marks.select("comp", "band", F.col("block").alias("i"), F.col("low").alias("a_low"), F.col("high").alias("a_high"))
    b = marks.select("comp", "band", F.col("block").alias("j"), F.col("low").alias("b_low"), F.col("high").alias("b_high"))
    reach = (F.col("i") < F.col("j")) & (F.col("a_high") >= F.col("b_low") * threshold - 1e-9) & (F.col("b_high") >= F.col("a_low") * threshold - 1e-9)
    pairs = written(a.join(b, ["comp", "band"]).where(reach).select("comp", "i", "j").distinct(), "ngram_block_pairs")
    own = blocks.select("comp", "block", F.col("block").alias("i"), F.col("block").alias("j"), F.lit(True).alias("first"))
    sides = [pairs.select("comp", F.col(side).alias("block"), "i", "j", F.lit(side == "i").alias("first")) for side in ("i", "j")]
    return written(own.union(sides[0]).union(sides[1]), "ngram_meetings")


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """id, h (a hash of the text), n (shingles), label (a number of the class, null without words), class_id and n_links for each row of docs."""
    bands, rows = bands_for(threshold, recall)
    signed = written(signatures(docs, doc_id, text, bands, rows), "ngram_signatures")
    full = signed.where("n > 0")
    reps = full.groupBy("print").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()), "ngram_representatives")

    banded = reps.select("node", F.explode("bands").alias("band"))
    # written, so that the join below can split a hot bucket
    buckets = written(banded.groupBy("band").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("band", "v"), "ngram_buckets")
    ties = banded.join(buckets, "band").where("node <> v").select(F.col("node").alias("u"), "v").distinct()
    candidates = connected(ties)

    size_class = F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold)).cast("int") if threshold < 1 else F.col("n")
    tied = reps.join(candidates, "node").select("node", "print", "least", "copies", "n", "bands", F.col("label").alias("comp"), size_class.alias("size_class"), F.array_min("bands").alias("near"))
    tied = written(tied, "ngram_tied")
    placed = written(_placed(tied), "ngram_candidates")
    meetings = _meetings(placed, threshold)

    key = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    wanted = written(placed.select(key(F.col("least")).alias("k")).distinct(), "ngram_wanted")
    again = docs.select(key(F.col(doc_id)).alias("k"), F.col(text).alias("t")).join(_few(wanted), "k", "left_semi")
    sets = _sets(again, "t").join(placed.select("node", "print", "comp", "block", "copies"), "print")
    # a document that stands in several rows gives its set once
    sets = sets.groupBy("node", "comp", "block", "copies").agg(F.first("shingles").alias("shingles"))
    members = sets.join(_few(meetings), ["comp", "block"], "left")
    members = members.select("node", "comp", "copies", F.coalesce("i", F.lit(0)).alias("i"), F.coalesce("j", F.lit(0)).alias("j"), F.coalesce("first", F.lit(True)).alias("first"), "shingles")
    found = written(_verified(members, threshold), "ngram_verified")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected(found.select(F.col("node").alias("u"), F.col("other").alias("v")))
    named = reps.join(links, "node", "left").join(classes, "node", "left").select("print", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "node").alias("label"))
    named = written(named, "ngram_named")
    # written, so that the join below can split a class with a large share of all representatives
    least = written(named.groupBy("label").agg(F.min("least").alias("class_id")), "ngram_least")
    named = named.join(least, "label").select("print", "label", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    out = signed.select("id", "h", "n", F.when(F.col("n") > 0, F.col("print")).alias("print")).join(named, "print", "left")
    alone = F.col("n") == 0
    return out.select("id", "h", "n", "label", F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, 0).otherwise(F.col("n_links")).cast("bigint").alias("n_links"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each class - that with the least id, null ids last - and every row without words, with their own columns."""
    classes = written(jaccard_classes(docs, doc_id, text, **options).where("n > 0"), "ngram_classes")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("h"))
    winners = classes.groupBy("label").agg(F.min(order).alias("w"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    k, h = unused(docs.columns, "k", "h")
    key = F.coalesce(F.col("id").cast("string"), F.lit("")).alias(k)
    sure = classes.join(written(winners, "ngram_winners"), "label").withColumn("wins", F.col("id").eqNullSafe(F.col("w.id")) & (F.col("h") == F.col("w.h")))
    judged = sure.select(key, F.col("h").alias(h), "wins").groupBy(k, h, "wins").agg(F.count(F.lit(1)).alias("times"))
    judged = written(judged, "ngram_judged")
    gone, again = judged.where("not wins or times > 1").select(k, h), judged.where("wins and times > 1").select(k, h)
    names = [F.col(f"`{c}`") for c in docs.columns]
    with_key = docs.withColumns({k: F.coalesce(F.col(doc_id).cast("string"), F.lit("")), h: F.xxhash64(text)})
    kept = with_key.join(_few(gone), [k, h], "left_anti").select(*names)
    if again.isEmpty():
        return kept
    # rows that repeat id and text: one of them
    twins = with_key.join(again, [k, h], "left_semi").select(F.col(k).alias("k"), F.col(h).alias("h"), F.struct(*names).alias("row"))
    one = twins.groupBy("k", "h").agg(one_of(twins, "row").alias("row"))
    return kept.unionByName(one.select("row.*"))
