"""Position payloads: the 1-based running number of a token, as an int and as four big-endian bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onomast.functions.similarity import Similarity


def with_payload(tokens: Column) -> Column:
    return F.transform(tokens, lambda t, i: F.struct(t["token"].alias("token"), t["pos"].alias("pos"), (i + 1).cast("int").alias("payload")))


def encode_int(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))


def decode_int(b: Column) -> Column:
    return F.conv(F.hex(b), 16, 10).cast("int")


def payload_score(tokens: Column, term: str, posn: int, mult: float = 1.0) -> Column:
    """The best mult / (distance + 1) of the term's payloads to posn; null without the term."""
    mine = F.filter(with_payload(tokens), lambda t: t["token"] == term)
    return F.array_max(F.transform(mine, lambda t: F.lit(float(mult)) / (F.abs(t["payload"] - posn) + 1)))


def doc_score(score: Column) -> Column:
    """A row's payload score, 1 if no payload was seen."""
    return F.coalesce(score, F.lit(1.0))


def payload_sum(tokens: Column, term: str, similarity: Similarity) -> Column:
    """What the payloads of a term's occurrences count together under a similarity."""
    mine = F.filter(with_payload(tokens), lambda t: t["token"] == term)
    return F.aggregate(mine, F.lit(0.0), lambda s, t: s + similarity.payload(t["payload"]).cast("double"))


def payload_query(df: DataFrame, tokens: str, term: str, posn, mult=None) -> DataFrame:
    """Rows that hold the term, with their score; posn must be an integer and mult, if given, a number."""
    try:
        posn, mult = int(posn), 1.0 if mult is None else float(mult)
    except (TypeError, ValueError) as e:
        raise ValueError("posn must be an integer and mult a number") from e
    return df.withColumn("score", payload_score(F.col(tokens), term, posn, mult)).where(F.col("score").isNotNull())
