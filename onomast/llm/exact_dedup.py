"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after every character of [\\x20\\x09-\\x0D] is deleted. A slim table holds
id, lengths and prefix hash of each row. Rows alone in their length, then rows alone in their prefix hash,
leave; only the survivors' full texts are read and hashed. Every count is pre-aggregated before its
shuffle, lengths are refined on the counts, and the groups are written before rows meet them, so that both sides of
the join are plain shuffles, which adaptive execution splits: a group with a third of all rows stays even. No text is shuffled to find the copies.

Defined results: null counts as empty, and empty texts are copies of one another. Of equal texts the row
with the most code points in the original text stays, then the smallest id (null ids last). Rows that repeat
the id as well as the text are one group and exactly one of them stays. Ids may be of any type that has an order. Other columns play no part.
Very long texts are hashed whole. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onomast.llm.common import BROADCAST_ROWS, one_of, written

PREFIX = 256


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def full_hash(text: Column) -> Column:
    return F.sha2(F.encode(normalised(text), "UTF-8"), 256)


def slim_rows(docs: DataFrame, doc_id: str, text: str, prefix: int = PREFIX) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("id"), F.char_length(F.coalesce(text, F.lit(""))).alias("n"), normalised(F.col(text)).alias("t"))
    return rows.select("id", "n", F.char_length("t").alias("len"), F.xxhash64(F.substring("t", 1, prefix)).alias("prefix"))


def _survivors(slim: DataFrame) -> DataFrame:
    """The ids of rows that share length and prefix hash with another row.

    Rows are first counted by both, map side and then by Spark, so that lengths are refined on the counts.
    """
    groups = slim.groupBy("len", "prefix").agg(F.count(F.lit(1)).alias("rows"))
    lengths = groups.groupBy("len").agg(F.sum("rows").alias("all")).where("all > 1")
    by_prefix = groups.join(lengths, "len", "left_semi").where("rows > 1").select("len", "prefix")
    return slim.join(by_prefix, ["len", "prefix"], "left_semi").select("id").distinct()


def find_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix: int = PREFIX) -> DataFrame:
    """One row for each distinct (id, full_hash, n) among the texts that occur more than once.

    Columns: id, full_hash, n (code points of the original text), rows (how often id, hash and n repeat),
    keep_id, keep_n, group_size.
    """
    slim = written(slim_rows(docs, doc_id, text, prefix), "dedup_slim")
    survivors = written(_survivors(slim), "dedup_survivors")
    # null ids take part under a key of their own, since a join drops null keys
    some = survivors.count()
    ids = survivors.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("k"))
    full = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).withColumn("k", F.coalesce(F.col("id").cast("string"), F.lit("")))
    hashed_ = [full_hash(F.col("t")).alias("full_hash"), F.char_length(F.coalesce("t", F.lit(""))).alias("n")]
    # too many ids to broadcast: texts are hashed where they are read, and hashes move instead of texts
    full = full.join(F.broadcast(ids), "k", "left_semi").select("id", *hashed_) if some <= BROADCAST_ROWS else full.select("id", "k", *hashed_).join(ids, "k", "left_semi").drop("k")
    hashed = written(full.groupBy("id", "full_hash", "n").agg(F.count(F.lit(1)).alias("rows")), "dedup_hashed")
    order = F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    best = hashed.groupBy("full_hash").agg(F.min(order).alias("best"), F.sum("rows").alias("group_size")).where("group_size > 1")
    best = written(best.select("full_hash", "group_size", F.negate("best.n").alias("keep_n"), F.col("best.id").alias("keep_id")), "dedup_groups")
    return hashed.join(best, "full_hash")


def annotate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: doc_id, keep_id, group_size, kept and text_sha256."""
    copies = written(find_copies(docs, doc_id, text), "dedup_copies")
    rows = docs.select(F.col(doc_id).alias("doc_id"), full_hash(F.col(text)).alias("text_sha256"), F.char_length(F.coalesce(text, F.lit(""))).alias("n"))
    found = copies.select(F.col("id").alias("c_id"), F.col("full_hash").alias("c_hash"), F.col("n").alias("c_n"), "rows", "keep_id", "keep_n", "group_size")
    out = rows.join(found, (F.col("text_sha256") == F.col("c_hash")) & F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("n") == F.col("c_n")), "left")
    alone = F.col("group_size").isNull()
    winner = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n"))
    cols = lambda kept: ["doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), kept.alias("kept"), "text_sha256"]
    if copies.where("rows > 1").isEmpty():
        return out.select(*cols(alone | winner))
    # rows that repeat id and text: the winner's first copy stays, by a number that is fixed when the rows are written
    numbered = written(out.withColumn("rid", F.monotonically_increasing_id()), "dedup_numbered")
    first = written(numbered.where("rows > 1").groupBy("doc_id", "text_sha256", "n").agg(F.min("rid").alias("first")).select("first"), "dedup_first")
    twins = numbered.join(first, F.col("rid") == F.col("first"), "left")
    return twins.select(*cols(alone | (winner & ((F.col("rows") == 1) | F.col("first").isNotNull()))))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with their own columns."""
    copies = written(find_copies(docs, doc_id, text), "dedup_copies")
    repeated = F.col("rows") > 1
    winner = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n"))
    gone = copies.where(~winner | repeated).select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("k"), F.col("full_hash").alias("h"), F.col("n").alias("m"))
    many = gone.count()
    with_key = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("k"), full_hash(F.col(text)).alias("h"), F.char_length(F.coalesce(text, F.lit(""))).alias("m"), F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("row"))
    kept = with_key.join(F.broadcast(gone) if many <= BROADCAST_ROWS else gone, ["k", "h", "m"], "left_anti").select("row.*")
    again = copies.where(winner & repeated).select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("k"), F.col("full_hash").alias("h"), F.col("n").alias("m"))
    if again.isEmpty():
        return kept
    one = with_key.join(again, ["k", "h", "m"], "left_semi").groupBy("k", "h", "m").agg(one_of(with_key, "row").alias("row"))
    return kept.unionByName(one.select("row.*"))
