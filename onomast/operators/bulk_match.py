"""Many name queries at once: a clause table joined with postings on (field, term)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from onomast.plans.name_query import NameQuery
from onomast.sources.postings import Postings, matches, postings, term_keys
from onomast.sources.store import written

__all__ = ["bulk_match", "clause_rows", "clause_table", "expanded", "postings", "top_matches"]

CLAUSES = "query_id string, variant int, n_tok int, tok int, clause int, kind string, field string, term string, target int, boost double, guard boolean"
#: Clauses that are broadcast at once.
TOGETHER = 200_000
#: Rows of clauses met by postings that a task adds up.
ROWS = 250_000
#: Scores that differ by less are ties (sums may be added up in another order).
DIGITS = 9


def clause_table(spark: SparkSession, queries: Iterable[tuple[str, NameQuery]]) -> DataFrame:
    rows = []
    for query_id, query in queries:
        for k, c in enumerate(query.clauses()):
            rows.append((query_id, c.variant, c.n_tok, c.tok, k, c.kind, c.field, c.term, c.target, c.boost, c.guard))
    return spark.createDataFrame(rows, CLAUSES)


def clause_rows(names: DataFrame, name: str, options: dict) -> DataFrame:
    """The clauses of a query for each distinct value of a column; compiled where the values are."""
    schema = T._parse_datatype_string(CLAUSES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, c.variant, c.n_tok, c.tok, k, c.kind, c.field, c.term, c.target, c.boost, c.guard) for n in batch.column(0).to_pylist() if n is not None for k, c in enumerate(NameQuery(n, **options).clauses())]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], to_arrow_schema(schema))

    return names.select(name).distinct().mapInArrow(run, schema)


def _posted(index: DataFrame | Postings) -> DataFrame:
    return index.table("postings") if isinstance(index, Postings) else index


def expanded(clauses: DataFrame, index: DataFrame | Postings) -> DataFrame:
    """The clauses with `weight`; each wildcard or fuzzy one becomes one for each term of its field that it takes in (a fuzzy one for the best fifty).

    Patterns meet the keys of the dictionary, not the postings; a stored index has the keys ready.
    """
    plain = clauses.where(~F.col("kind").isin("wild", "fuzzy")).withColumn("weight", F.lit(1.0))
    open_ = clauses.where(F.col("kind").isin("wild", "fuzzy")).withColumnRenamed("term", "pattern")
    if isinstance(index, Postings):
        found = index.matches(open_)
    else:
        keys = term_keys(index.where(F.col("field") == "an").select("field", "term").distinct())
        found = matches(open_, keys, keys.where("kind = 'gram'").groupBy("field", "key").agg(F.count(F.lit(1)).alias("n")))
    met = open_.join(found, ["pattern", "kind", "field"])
    return plain.unionByName(met.select(*plain.columns))


def _tasks(clauses: DataFrame, index: DataFrame | Postings, parts: int = 1) -> int | None:
    """Tasks for what the clauses meet, so that a task's rows are as many at any size: counted by the dictionary, whose terms say how often they stand."""
    if not isinstance(index, Postings):
        return None
    asked = clauses.groupBy("field", "term").agg(F.count(F.lit(1)).alias("n"))
    met = asked.join(index.table("terms").select("field", "term", "total_freq"), ["field", "term"]).agg(F.sum(F.col("n") * F.col("total_freq")).alias("met")).first()["met"]
    return max(1, -(-(met or 0) // (ROWS * parts)))


def _clauses_by_query(candidates: DataFrame, every: DataFrame) -> int:
    """Rows that the candidates become when they meet their queries' clauses, from the numbers of both a query."""
    n = lambda df, name: df.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))
    return n(candidates, "docs").join(n(every, "clauses"), "query_id").agg(F.sum(F.col("docs") * F.col("clauses")).alias("rows")).first()["rows"] or 0


def _dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    return df.repartition(*keys) if tasks is None else df.repartition(tasks, *keys)


def _freed(found: DataFrame, excluded: DataFrame | None) -> DataFrame:
    """Without the guarded clauses of documents whose gender is excluded."""
    if excluded is None:
        return found
    out = excluded.select("doc", F.lit(True).alias("out")).distinct()
    return found.join(out, "doc", "left").where(~(F.col("guard") & F.coalesce("out", F.lit(False))))


def _best(c: str | Column, tie: float) -> Column:
    return F.max(c) + tie * (F.sum(c) - F.max(c))


def _by_word(found: DataFrame, tie: float) -> DataFrame:
    """query_id, doc, variant, n_tok, tok, s: what each word scores on a document."""
    near = F.when(F.col("target").isNull(), F.lit(1.0)).otherwise(1.0 / (F.abs(F.col("pos") - F.col("target")) + 1))
    by_term = found.groupBy("query_id", "doc", "variant", "n_tok", "tok", "clause", "kind", "boost", "weight", "term").agg(F.sum(near).alias("freq"))
    # a wildcard's terms count once, a fuzzy word's terms add up by their weights
    one = F.when(F.col("kind") == "half", F.sqrt(F.col("freq") / 2)).when(F.col("kind") == "wild", F.col("boost")).otherwise(F.col("boost") * F.col("weight") * F.sqrt("freq"))
    by_clause = by_term.groupBy("query_id", "doc", "variant", "n_tok", "tok", "clause").agg(F.when(F.first("kind") == "wild", F.max(one)).otherwise(F.sum(one)).alias("s"))
    return by_clause.groupBy("query_id", "doc", "variant", "n_tok", "tok").agg(_best("s", tie).alias("s"))


def _by_document(words: DataFrame, tie: float) -> DataFrame:
    """query_id, doc, score: all words of a variant must match and add up."""
    by_variant = words.groupBy("query_id", "doc", "variant", "n_tok").agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("words")).where("words = n_tok")
    return by_variant.groupBy("query_id", "doc").agg(_best("s", tie).alias("score"))


def bulk_match(clauses: DataFrame, index: DataFrame | Postings, tie: float = 0.0, excluded: DataFrame | None = None) -> DataFrame:
    """query_id, doc, score of every match. excluded: the doc ids whose gender guarded clauses skip.

    The optimizer broadcasts the clause table only while it is below its threshold. After the join rows are
    partial-aggregated, and all later steps group by supersets of (query_id, doc), dealt out once.
    """
    every = expanded(clauses, index)
    every = written(every, "clauses") if isinstance(index, Postings) else every
    found = _freed(every.join(_posted(index), ["field", "term"]), excluded)
    return _by_document(_by_word(_dealt(found, _tasks(every, index), "query_id", "doc"), tie), tie)


def _weak() -> Column:
    """Clauses that many documents meet and that say little: missing names, and initials of longer words."""
    return (F.col("kind").isin("term", "exact")) & (F.char_length("term") == 1) & (F.col("boost") < F.col("n_tok_boost"))


def top_matches(clauses: DataFrame, index: Postings, k: int, tie: float = 0.0, excluded: DataFrame | None = None) -> DataFrame:
    """query_id, doc, score, rank: the first k documents of each query, ties in the order of doc; the same as the full ranking's.

    Postings are dealt out by document once, and blocks of at most TOGETHER clauses are broadcast to them (their number is counted first), so a document is scored
    where it is and a task hands on at most k documents a query: the shuffle is at most queries x k x tasks.

    Strong clauses go first. What they score on the k-th document bounds the ranking from below; bounds of what each clause can score at most (from the
    dictionary's greatest frequencies) tell for which queries a document without a strong match of every word can still get there. Only
    these queries meet the long postings of missing names and initials; of the others only the documents that can still rank are scored again by all clauses.
    """
    factor = F.max(F.when(F.col("kind") == "term", F.col("boost"))).over(Window.partitionBy("query_id", "variant", "tok"))
    every = expanded(clauses, index).withColumn("n_tok_boost", F.coalesce(factor, F.lit(0.0))).withColumn("weak", _weak()).drop("n_tok_boost")
    often = index.table("terms").select("field", "term", "max_freq")
    freq = F.when((F.col("kind") == "exact") & F.col("target").isNotNull(), 1.0 / (F.col("target") + 1)).otherwise(F.col("max_freq").cast("double"))
    most = F.when(F.col("kind") == "half", F.sqrt(F.col("max_freq") / 2)).when(F.col("kind") == "wild", F.col("boost")).otherwise(F.col("boost") * F.col("weight") * F.sqrt(freq))
    every = written(every.join(often, ["field", "term"]).withColumn("most", most).drop("max_freq"), "clauses")

    # bounds of a word: by any clause, and by weak ones alone
    one = every.groupBy("query_id", "variant", "n_tok", "tok", "clause").agg(F.when(F.first("kind") == "wild", F.max("most")).otherwise(F.sum("most")).alias("m"), F.first("weak").alias("weak"))
    word = one.groupBy("query_id", "variant", "n_tok", "tok").agg(_best("m", tie).alias("any"), F.coalesce(_best(F.when(F.col("weak"), F.col("m")), tie), F.lit(0.0)).alias("weak"), F.max(F.when(~F.col("weak"), 1)).alias("strong"))
    sums = Window.partitionBy("query_id", "variant")
    word = written(word.withColumn("without", F.sum("any").over(sums) - F.col("any") + F.col("weak")), "clause_bounds")

    blocks = max(1, -(-every.count() // TOGETHER))
    by_doc = _dealt(index.table("postings"), _tasks(every, index, blocks), "doc")

    def blocks_of(those: DataFrame) -> list[DataFrame]:
        return [those if blocks == 1 else those.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) for b in range(blocks)]

    def met(those: DataFrame) -> list[DataFrame]:
        return [_freed(by_doc.join(F.broadcast(p), ["field", "term"]), excluded) for p in blocks_of(those)]

    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", DIGITS).desc(), "doc"))
    top = lambda scored: scored.withColumn("rank", first).where(F.col("rank") <= k)
    strong = [_by_word(p, tie) for p in met(every.where("not weak"))]
    least = reduce(DataFrame.union, [top(_by_document(w, tie)) for w in strong])
    least = top(least.drop("rank")).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    # the other variant may add tie times its score to the best one's
    reach = word.groupBy("query_id").agg(F.max("without").alias("reach")).join(least, "query_id", "left")
    open_ = F.col("least").isNull() | (F.col("reach") * (1 + tie) >= F.col("least") - 1e-6)
    judged = written(reach.select("query_id", "least", open_.alias("open")), "clause_reach")

    whole = [top(_by_document(_by_word(p, tie), tie)) for p in met(every.join(judged.where("open"), "query_id", "left_semi"))]
    closed = judged.where("not open").select("query_id", "least")
    able = []
    for w in strong:
        bounded = w.join(F.broadcast(word.select("query_id", "variant", "tok", F.col("weak").alias("w"))) if blocks == 1 else word.select("query_id", "variant", "tok", F.col("weak").alias("w")), ["query_id", "variant", "tok"])
        can = bounded.groupBy("query_id", "doc", "variant", "n_tok").agg(F.sum(F.col("s") + F.col("w")).alias("can"), F.count(F.lit(1)).alias("words")).where("words = n_tok")
        able.append(can.groupBy("query_id", "doc").agg(F.max("can").alias("can")).join(closed, "query_id").where(F.col("can") * (1 + tie) >= F.col("least") - 1e-6).select("query_id", "doc"))
    candidates = written(reduce(DataFrame.union, able), "candidates")
    # candidates and postings are dealt out by document and meet there, then the clauses, so that a task has as many rows at any size and these are not shuffled
    again = _clauses_by_query(candidates, every)
    tasks = max(_tasks(every, index, blocks), -(-again // ROWS))
    posted, mine = _dealt(index.table("postings"), tasks, "doc"), _dealt(candidates, tasks, "doc")
    rest = []
    for p in blocks_of(every):
        both = mine.join(posted, "doc").join(F.broadcast(p), ["query_id", "field", "term"])
        rest.append(top(_by_document(_by_word(_freed(both, excluded), tie), tie)))
    return top(reduce(DataFrame.union, [*whole, *rest]).drop("rank"))


#: Terms up to which one query's lookup is a filter that the scan of the postings prunes by; more are joined.
FEW = 500


def match_one(index: Postings, query: NameQuery, excluded: DataFrame | None = None) -> DataFrame:
    """doc, score of one query, from the postings of its own terms and no others."""
    clauses = expanded(clause_table(index.spark, [("", query)]), index)
    terms = clauses.select("field", "term").distinct().limit(FEW + 1).collect()
    posted = index.of([(r["field"], r["term"]) for r in terms]) if len(terms) <= FEW else index.table("postings")
    found = _freed(clauses.join(posted, ["field", "term"]), excluded)
    return _by_document(_by_word(found.repartition("query_id", "doc"), query.tie), query.tie).select("doc", "score")
