"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources in the order of their names' code points (null last) have weights that repeat. The words of all documents are shared out by weight; a
source's target stops at `most` times its size, and the excess is shared again by weight among the others. The targets are
then turned into blocks of equally many words, given one by one to the source with the highest quotient target / (2k + 1), k being the
blocks that it has. A source's blocks go to its shards by the same rule, with the shards' sizes as votes: integer quotas for each shard.

A shard lays its documents out in the order of a seeded hash and cuts that stream, repeated up to `most` times, into blocks; the
quota takes the first ones. So whole rounds take every document once each, and the last round takes a random part of the documents, of
which one at most is cut.

How it scales: texts are read once, by one narrow pass that leaves id, source, size and hash. A shard holds about SHARD_ROWS documents of one
source, found by the hash, so a source with a third of all rows is spread over many shards. Only counts by (source, cell) meet the table of sources. The quotients that can
still decide are found by brackets on the divisor: two divisors between which the rule's own lies, so at most two a party and one more are ranked.
Sources are ranked and summed up by ranges (operators/ranks.py), with no window over all of them. Only DataFrame functions are used.

Defined results: a null or blank text has size 0 and nothing is taken of it; a source whose size is 0 has the target 0. Null and repeated ids are rows like
others; the hash is of id and text, so only rows that repeat both share their place, and which of them is taken makes no difference.
A very long text is a document like others, cut at most once a shard. Equal quotients: the earlier source or shard first. Other columns play no part, whatever their names. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onomast.llm.common import written
from onomast.operators.ranks import running

#: Words of a block; smaller where the least target is below LEAST blocks, so that rounding to blocks stays small.
BLOCK, LEAST = 256, 128
#: Documents of a shard, about.
SHARD_ROWS = 10_000
WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 20


def words_of(text: Column) -> Column:
    """Number of runs of characters other than [\\x20\\x09-\\x0D]; null has none. Each run leaves one mark, and marks are counted."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "x")
    return F.char_length(F.regexp_replace(marks, r"[\x20\x09-\x0D]+", "")).cast("bigint")


def sizes(docs: DataFrame, doc_id: str, source: str, text: str, seed: int) -> DataFrame:
    """doc_id, k (the source as a key that is never null), size, and the seeded hash `h` that orders documents."""
    own = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    key = F.when(F.col(source).isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), F.col(source).cast("string")))
    return docs.select(F.col(doc_id).alias("doc_id"), key.alias("k"), words_of(F.col(text)).alias("size"), F.md5(own.cast("binary")).alias("h"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """k, place, rows, source_size (given k, rows, source_size) and target.

    Water filling in closed form: sources saturate in the order of most * size / weight, so with running sums in that order each knows
    the level at which it would stop, and the first that stays below its own cap sets the level of all later ones.
    """
    placed = running(sources, [F.col("k").asc()], number="place")
    weight = F.element_at(F.lit(list(weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("bigint")
    placed = placed.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    whole = placed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    words, all_weight = whole["words"] or 0, whole["weight"] or 1
    filled = running(placed, [F.col("ratio").asc(), F.col("place").asc()], ["cap", "weight"], "rank")
    level = (F.lit(words) - F.col("cap_before")) / (F.lit(all_weight) - F.col("weight_before"))
    free = filled.where(F.col("ratio") >= level).agg(F.min(F.struct("rank", level.alias("level"))).alias("first")).first()["first"]
    at = free["level"] if free else 0.0
    target = F.when(F.col("rank") < (free["rank"] if free else 1 << 62), F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(at))
    return filled.select("k", "place", "rows", "source_size", target.alias("target"))


def _bracketed(votes: Column, all_votes: Column, parties: Column, seats: Column) -> tuple[Column, Column]:
    """Seats that a party surely has and at most has: rounding by divisors a little above and below the rule's own."""
    slack = parties / 2 + 1
    high = F.when(seats > slack, F.floor(votes / (all_votes / (seats - slack)) + 0.5)).otherwise(F.lit(0))
    low = F.floor(votes / (all_votes / (seats + slack)) + 0.5)
    return high.cast("bigint"), low.cast("bigint")


def apportion(parties: DataFrame, votes: str, place: str, seats: int) -> DataFrame:
    """parties with `quota`: `seats` in all, by highest quotients votes / (2k + 1), ties to the least (place, k)."""
    own = parties.where(F.col(votes) > 0)
    whole = own.agg(F.sum(votes).alias("v"), F.count(F.lit(1)).alias("n")).first()
    sure, most = _bracketed(F.col(votes), F.lit(whole["v"] or 1.0), F.lit(whole["n"]), F.lit(seats))
    own = own.withColumn("sure", sure).withColumn("open", most)
    rest = seats - (own.agg(F.sum("sure")).first()[0] or 0)
    asked = own.where("open > sure").select(place, votes, F.explode(F.sequence("sure", F.col("open") - 1)).alias("seat"))
    asked = asked.withColumn("q", F.col(votes) / (2 * F.col("seat") + 1))
    won = running(asked, [F.col("q").desc(), F.col(place).asc(), F.col("seat").asc()]).where(F.col("n_before") < rest)
    more = won.groupBy(place).agg(F.count(F.lit(1)).alias("more"))
    quota = F.coalesce("sure", F.lit(0)) + F.coalesce("more", F.lit(0))
    return parties.join(own.select(place, "sure"), place, "left").join(more, place, "left").withColumn("quota", quota).drop("sure", "more")


def shard_quotas(shards: DataFrame) -> DataFrame:
    """k, shard, z and quota (given also seats, the blocks of the source): the same rule within each source."""
    every = Window.partitionBy("k")
    own = shards.withColumn("v", F.sum("z").over(every)).withColumn("n", F.count(F.when(F.col("z") > 0, 1)).over(every))
    sure, most = _bracketed(F.col("z"), F.greatest("v", F.lit(1)), F.col("n"), F.col("seats"))
    own = own.withColumn("sure", sure).withColumn("open", most).withColumn("rest", F.col("seats") - F.sum("sure").over(every))
    asked = own.where("open > sure").select("k", "shard", "rest", "z", F.explode(F.sequence("sure", F.col("open") - 1)).alias("seat"))
    order = Window.partitionBy("k").orderBy((F.col("z") / (2 * F.col("seat") + 1)).desc(), "shard", "seat")
    more = asked.withColumn("r", F.row_number().over(order)).where("r <= rest").groupBy("k", "shard").agg(F.count(F.lit(1)).alias("more"))
    return own.join(more, ["k", "shard"], "left").select("k", "shard", "z", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("quota"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", block: int = BLOCK, shard_rows: int = SHARD_ROWS, seed: int = SEED) -> DataFrame:
    """For every row: doc_id, size, source_size, target, taken and the shard and quota (in blocks of `block_words`) it was taken by."""
    rows = written(sizes(docs, doc_id, source, text, seed), "mix_sizes")
    n_cells = max(1, -(-rows.count() // shard_rows))
    # cells: the finest parts that a shard can consist of, so that rows need no table of sources to know theirs
    rows = rows.withColumn("cell", F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") % n_cells)
    cells = written(rows.groupBy("k", "cell").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("z")), "mix_cells")
    sources = written(targets(cells.groupBy("k").agg(F.sum("rows").alias("rows"), F.sum("z").alias("source_size"))), "mix_targets")
    whole = sources.agg(F.sum("source_size").alias("words"), F.min(F.when(F.col("target") > 0, F.col("target"))).alias("least")).first()
    size = max(1, min(block, int((whole["least"] or 0) // LEAST)))
    quotas = apportion(sources, "target", "place", ((whole["words"] or 0) + size // 2) // size).withColumnRenamed("quota", "seats")
    quotas = quotas.withColumn("shards", F.ceil(F.col("rows") / shard_rows)).drop("rows", "place")
    dealt = cells.join(quotas, "k").withColumn("shard", F.col("cell") % F.col("shards"))
    dealt = written(dealt, "mix_dealt")
    shards = shard_quotas(dealt.groupBy("k", "shard").agg(F.sum("z").alias("z"), F.first("seats").alias("seats")))
    start = F.coalesce(F.sum("z").over(Window.partitionBy("k", "shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.select("k", "shard", "cell", "source_size", "target", start.alias("start"))
    words = F.least(F.col("quota") * size, MOST * F.col("z"))
    rounds = F.when(F.col("z") > 0, F.floor(words / F.greatest("z", F.lit(1)))).otherwise(F.lit(0))
    plan = placed.join(shards, ["k", "shard"]).select("k", "cell", "shard", "source_size", "target", "start", "quota", rounds.alias("rounds"), (words - rounds * F.col("z")).alias("part"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("k", "cell").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumn("before", before).join(written(plan, "mix_plan"), ["k", "cell"])
    left = F.least(F.greatest(F.col("part") - F.col("start") - F.col("before"), F.lit(0)), F.col("size"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("rounds") * F.col("size") + left).cast("bigint").alias("taken"), "shard", "quota", F.lit(size).alias("block_words"))
