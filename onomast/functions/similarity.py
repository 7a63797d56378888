"""Scoring: the flat similarity (no idf, no norms) and the classic one with length norms and explanations."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def tf(freq: Column) -> Column:
    return F.sqrt(freq)


def sloppy(distance: Column) -> Column:
    return 1.0 / (distance + 1)


def idf(doc_freq: Column, docs: Column) -> Column:
    return F.log(docs / (doc_freq + 1.0)) + 1.0


def coord(matched: Column, total: Column) -> Column:
    return matched / total


def query_norm(weights: list[float]) -> float:
    total = sum(w * w for w in weights)
    return 1 / math.sqrt(total) if total else 1.0


def decode_norm(code: int) -> float:
    """A byte whose low two bits are the fraction in quarters and whose other bits are the exponent, 31 for one."""
    return 0.0 if code == 0 else (1 + (code & 3) / 4) * 2.0 ** ((code >> 2) - 31)


def norm_table() -> list[float]:
    return [decode_norm(b) for b in range(256)]


def encode_norm(value: float) -> int:
    """The largest byte whose value is not above `value`."""
    if value <= 0:
        return 0
    return max([b for b in range(1, 256) if decode_norm(b) <= value * (1 + 1e-9)], default=1)


def length_norm(length: int, boost: float = 1.0) -> float:
    """1 / sqrt(length) as the norm byte keeps it."""
    return decode_norm(encode_norm(boost / math.sqrt(length))) if length else 0.0


def encoded(value: Column) -> Column:
    """The norm byte of a value: the largest whose own value is not above it (0 for 0 and less), computed from exponent and two bits of fraction."""
    safe = F.greatest(value.cast("double"), F.lit(1e-300)) * (1 + 1e-9)
    exponent = F.floor(F.log2(safe))
    # log2 may round up to the next power
    exponent = F.when(F.pow(F.lit(2.0), exponent) > safe, exponent - 1).otherwise(exponent)
    quarters = F.least(F.floor((safe / F.pow(F.lit(2.0), exponent) - 1) * 4), F.lit(3))
    return F.when(value <= 0, F.lit(0)).otherwise(F.greatest(F.least((exponent + 31) * 4 + quarters, F.lit(255)), F.lit(1))).cast("int")


def decoded(code: Column) -> Column:
    """The value of a norm byte, by table."""
    return F.element_at(F.lit(norm_table()), code.cast("int") + 1)


def norm_code(length: Column, boost: Column | float = 1.0) -> Column:
    """The norm byte of a field of so many tokens with an index-time boost; 0 for an empty one."""
    boost = boost if isinstance(boost, Column) else F.lit(float(boost))
    # the length is counted once, and the value computed once
    value = F.transform(F.array(length), lambda n: F.when(n > 0, boost / F.sqrt(F.greatest(n, F.lit(1)))))
    return F.transform(value, lambda v: F.when(v.isNotNull(), encoded(v)).otherwise(F.lit(0)))[0]


def norm_of(length: Column, boost: Column | float = 1.0) -> Column:
    """The kept norm of a length, whatever the length."""
    return decoded(norm_code(length, boost))


def field_length(tokens: Column, discount_overlaps: bool = True) -> Column:
    """Number of tokens; those at the place of an earlier one don't count if overlaps are discounted."""
    return F.size(F.array_distinct(F.transform(tokens, lambda t: t["pos"]))) if discount_overlaps else F.size(tokens)


def phrase_idf(doc_freqs: dict[str, int], docs: int) -> dict:
    """The summed idf of a phrase's terms, and what it is made of."""
    parts = {t: math.log(docs / (n + 1)) + 1 for t, n in doc_freqs.items()}
    return {"value": sum(parts.values()), "description": "idf(), sum of:", "details": [{"value": v, "description": f"idf(docFreq={doc_freqs[t]}, maxDocs={docs})"} for t, v in parts.items()]}


@dataclass(frozen=True)
class Similarity:
    """An exchangeable similarity: how frequencies, distances, document frequencies, lengths and payloads count."""

    tf: Callable[[Column], Column] = tf
    sloppy: Callable[[Column], Column] = sloppy
    idf: Callable[[Column, Column], Column] = idf
    coord: Callable[[Column, Column], Column] = coord
    norm: Callable[[Column], Column] = lambda length: norm_of(length)
    payload: Callable[[Column], Column] = lambda payload: F.lit(1.0)
    discount_overlaps: bool = True
    #: Neither document frequencies nor lengths count, so that neither is read.
    plain: bool = False

    def length_norm(self, tokens: Column) -> Column:
        return self.norm(field_length(tokens, self.discount_overlaps))


CLASSIC = Similarity()
#: Names: neither idf nor lengths count, and a payload counts as its number.
FLAT = Similarity(idf=lambda n, docs: F.lit(1.0), coord=lambda matched, total: F.lit(1.0), norm=lambda length: F.lit(1.0), payload=lambda payload: payload.cast("double"), plain=True)


def explain(freq: Column, idf_: Column, norm: Column, boost: float = 1.0, query_norm_: float = 1.0) -> Column:
    """value with its query weight (boost, idf, query norm) and field weight (tf of freq, idf, field norm)."""
    field = F.struct((tf(freq) * idf_ * norm).alias("value"), tf(freq).alias("tf"), freq.cast("double").alias("freq"), idf_.alias("idf"), norm.alias("field_norm"))
    weight = F.struct((F.lit(boost) * idf_ * query_norm_).alias("value"), F.lit(boost).alias("boost"), idf_.alias("idf"), F.lit(query_norm_).alias("query_norm"))
    # the weight of the query is left out where it is one
    same = weight["value"] == 1.0
    return F.struct(F.when(same, field["value"]).otherwise(field["value"] * weight["value"]).alias("value"), F.when(~same, weight).alias("query_weight"), field.alias("field_weight"))
