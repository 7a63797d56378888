"""Classic TF-IDF scoring with length norms over token arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onomast.functions import analysis as an
from onomast.functions import similarity as sim


def _words(df: DataFrame, text: str):
    """The words of a text column, or a stored array of words (or of tokens with places) as it is."""
    kind = df.schema[text].dataType.simpleString()
    if kind.startswith("array<struct"):
        return F.transform(text, lambda t: t["token"])
    return F.col(text) if kind.startswith("array") else an.words(F.col(text))


def term_statistics(df: DataFrame, text: str, terms: list[str]) -> tuple[int, dict[str, int]]:
    """Rows and document frequencies of the stated terms, in one pre-aggregated pass."""
    has = [F.sum(F.array_contains(_words(df, text), t).cast("int")).alias(f"t{k}") for k, t in enumerate(terms)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *has).first()
    return row["n"], {t: row[f"t{k}"] or 0 for k, t in enumerate(terms)}


def tfidf(df: DataFrame, text: str, terms: list[str], explained: bool = False, statistics: tuple[int, dict[str, int]] | None = None, norm: str | None = None) -> DataFrame:
    """The rows that hold any of the terms (of a text, or of a stored array of words), with their classic score: coord * query norm * sum of tf * idf^2 * norm.

    statistics: rows and document frequencies, where an index keeps them; else a pass over all rows counts them. norm: a column of stored norm bytes.
    """
    n, freqs = statistics or term_statistics(df, text, terms)
    idf = {t: sim.math.log(n / (freqs[t] + 1)) + 1 if n else 1.0 for t in terms}
    norm_q = sim.query_norm(list(idf.values()))
    out = df.withColumn("__w", _words(df, text)).withColumn("norm", sim.decoded(F.col(norm)) if norm else sim.norm_of(F.size("__w")))
    counts = {t: F.size(F.filter("__w", _is(t))).cast("double") for t in terms}
    total = sum((sim.tf(counts[t]) * (idf[t] ** 2) * F.col("norm") for t in terms), F.lit(0.0))
    matched = sum(((counts[t] > 0).cast("int") for t in terms), F.lit(0))
    out = out.withColumn("score", total * norm_q * sim.coord(matched, F.lit(len(terms))))
    if explained:
        out = out.withColumn("explanation", F.array(*[sim.explain(counts[t], F.lit(idf[t]), F.col("norm"), 1.0, norm_q) for t in terms]))
    return out.where(F.size(F.array_intersect("__w", F.array(*map(F.lit, terms)))) > 0).drop("__w")


def _is(term: str):
    return lambda w: w == term
