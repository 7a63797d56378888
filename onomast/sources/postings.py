"""A stored inverted index: postings in the order of (field, term), and a dictionary of the terms with the keys that fuzzy and wildcard words are found by.

Files below one folder, sorted by their first columns through all files, so that the row groups and pages of a term are read and no others; the keys, which
joins read whole, are written by kind as they are made:
  postings    field, term, doc, pos, payload (the 1-based number of the token in its field)
  terms       field, term, doc_freq, total_freq, max_freq (the most often that a document has it)
  keys        kind, field, key, term. Kinds: gram (the one to three letters that stand together somewhere in a term, its ends marked), length (the
              term's length), one and two (what is left of a term without up to one or two letters after its first two)
  key_counts  kind, field, key, n of the grams

A wildcard is looked up by the rarest of its grams of three letters (shorter ones where it has none), so a pattern that begins with a wildcard is as cheap
as any other. A fuzzy word within k edits (an exchange of neighbours is one) shares a key of k letters left out with every term it can match, if
the first two letters are the same. Both are then held against the term itself.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from onomast.functions.edits import edits_between

#: Most terms that a fuzzy word stands for, the best by weight, then in the order of the alphabet (a fixed value).
BEST = 50
#: Words longer than this may differ by two edits (a fixed value).
LONG = 8
#: Keys of patterns that are broadcast to those of the dictionary; more are shuffled.
FEW_KEYS = 500_000
#: Terms of a task that makes their keys, about.
TASK_TERMS = 50_000
START, END = "\x02", "\x03"


def postings(df: DataFrame, order: str, fields: dict[str, str | None]) -> DataFrame:
    """field, term, doc, pos, payload of all tokens; a plain value is one token at position 0. Fields whose column is None give nothing."""
    parts = []
    for name, column in fields.items():
        if column is None:
            continue
        if df.schema[column].dataType.typeName() == "array":
            rows = df.select(F.lit(name).alias("field"), F.col(order).alias("doc"), F.posexplode(column).alias("n", "t"))
            parts.append(rows.select("field", F.col("t.token").alias("term"), "doc", F.col("t.pos").alias("pos"), (F.col("n") + 1).alias("payload")))
        else:
            parts.append(df.select(F.lit(name).alias("field"), F.col(column).alias("term"), F.col(order).alias("doc"), F.lit(0).alias("pos"), F.lit(1).alias("payload")).where("term is not null"))
    return reduce(DataFrame.union, parts)


# --- keys ---------------------------------------------------------------------------------------------------


def _pieces(s: Column, n: int) -> Column:
    """The substrings of n characters; none of a shorter string."""
    last = F.char_length(s) - n + 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(s, i, F.lit(n))))


def _grams(term: Column) -> Column:
    marked = F.concat(F.lit(START), term, F.lit(END))
    return F.filter(F.array_distinct(F.concat(_pieces(marked, 1), _pieces(marked, 2), _pieces(marked, 3))), lambda g: ~g.isin(START, END))


def pattern_grams(pattern: Column) -> Column:
    """Grams that every match has: of three letters, of less only where the pattern has no three together; none of a pattern of wildcards."""
    marked = F.concat(F.lit(START), pattern, F.lit(END))
    runs = F.filter(F.split(marked, "[*?]+"), lambda s: (s != "") & ~s.isin(START, END))
    long = F.flatten(F.transform(runs, lambda s: _pieces(s, 3)))
    return F.array_distinct(F.when(F.size(long) > 0, long).otherwise(runs))


def _without_one(w: Column) -> Column:
    """The word without one letter after the first two, for each of them."""
    n = F.char_length(w)
    return F.when(n < 3, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(3), F.greatest(n, F.lit(3))), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1))))


def deletions(w: Column, edits: int) -> Column:
    """The word and what is left of it without up to `edits` letters after the first two."""
    found = last = F.array(w)
    for _ in range(edits):
        last = F.array_distinct(F.flatten(F.transform(last, _without_one)))
        found = F.array_union(found, last)
    return found


def term_keys(terms: DataFrame) -> DataFrame:
    """kind, field, key, term of distinct (field, term). A key of letters left out may be there twice."""
    n = F.char_length("term")
    kinds = {"gram": _grams(F.col("term")), "length": F.array(n.cast("string"))}
    listed = [terms.select(F.lit(kind).alias("kind"), "field", F.explode(keys).alias("key"), "term") for kind, keys in kinds.items()]
    return reduce(DataFrame.union, [*listed, _left(terms.where(n <= LONG + 1), "one", 1), _left(terms.where(n >= LONG - 1), "two", 2)])


def _left(terms: DataFrame, kind: str, edits: int) -> DataFrame:
    """What `deletions` gives, by rows: the places of the letters left out are exploded, so that no term's keys are held together."""
    at = lambda first: F.explode(F.concat(F.array(F.lit(0)), F.when(F.char_length("term") >= first, F.sequence(first, F.char_length("term"))).otherwise(F.array().cast("array<int>"))))
    # i is the last letter left out and j one before it; 0 is none
    rows = terms.select("field", "term", at(F.lit(3)).alias("i"))
    i, w = F.col("i"), F.col("term")
    if edits == 1:
        return rows.select(F.lit(kind).alias("kind"), "field", F.when(i == 0, w).otherwise(F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1))).alias("key"), "term")
    before = F.when(i > 3, F.concat(F.array(F.lit(0)), F.sequence(F.lit(3), i - 1))).otherwise(F.array(F.lit(0)))
    rows, j = rows.select("field", "term", "i", F.explode(before).alias("j")), F.col("j")
    one = F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1))
    two = F.concat(F.substr(w, F.lit(1), j - 1), F.substr(w, j + 1, i - j - 1), F.substr(w, i + 1))
    return rows.select(F.lit(kind).alias("kind"), "field", F.when(i == 0, w).when(j == 0, one).otherwise(two).alias("key"), "term")


def like_of(pattern: Column) -> Column:
    """A wildcard pattern as a LIKE pattern, escaped by a backslash."""
    out = pattern
    for old, new in (("\\", "\\\\"), ("%", "\\%"), ("_", "\\_"), ("*", "%"), ("?", "_")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def fits_wildcard(term: Column, pattern: Column) -> Column:
    """Whether a term matches a wildcard. Patterns of one run of letters are told by it, since a LIKE whose pattern is a column is compiled for each row."""
    run = F.translate(pattern, "*?", "")
    ended = F.endswith(term, run)
    return (
        F.when(pattern.rlike(r"^\*+[^*?]+$"), ended)
        .when(pattern.rlike(r"^\*+[^*?]+\*+$"), F.contains(term, run))
        .when(pattern.rlike(r"^[^*?]+\*+$"), F.startswith(term, run))
        .when(pattern.rlike(r"^\?+[^*?]+$"), ended & (F.char_length(term) == F.char_length(pattern)))
        .otherwise(F.like(term, like_of(pattern)))
    )


def matches(patterns: DataFrame, keys: DataFrame, key_counts: DataFrame, best: int = BEST, few: bool = False) -> DataFrame:
    """pattern, kind, field, term, weight: the terms that each distinct (pattern, kind, field) takes in; kind is wild or fuzzy.

    A wildcard's terms all weigh 1. A fuzzy word's weigh 1 - edits / length of the shorter of the two, and the best fifty count.
    few: the patterns' keys are broadcast.
    """
    asked = patterns.select("pattern", "kind", "field").distinct()
    wild = asked.where("kind = 'wild'").withColumn("grams", pattern_grams(F.col("pattern")))
    looked = wild.select("pattern", "kind", "field", F.explode("grams").alias("key")).join(key_counts.select("field", "key", "n"), ["field", "key"], "left")
    rarest = F.row_number().over(Window.partitionBy("pattern", "field").orderBy(F.coalesce("n", F.lit(0)), "key"))
    by_gram = looked.withColumn("r", rarest).where("r = 1").select("pattern", "kind", "field", F.lit("gram").alias("by"), "key")
    # patterns of wildcards alone: by length, or by every length that they leave open
    bare = wild.where(F.size("grams") == 0).withColumn("least", F.char_length(F.replace("pattern", F.lit("*"), F.lit(""))))
    lengths = keys.where("kind = 'length'").select("field", F.col("key").alias("length")).distinct()
    fits = F.when(F.contains("pattern", F.lit("*")), F.col("length").cast("int") >= F.col("least")).otherwise(F.col("length").cast("int") == F.col("least"))
    by_length = bare.join(lengths, "field").where(fits).select("pattern", "kind", "field", F.lit("length").alias("by"), F.col("length").alias("key"))
    fuzzy = asked.where("kind = 'fuzzy'").withColumn("long", F.char_length("pattern") > LONG)
    left = F.when(F.col("long"), deletions(F.col("pattern"), 2)).otherwise(deletions(F.col("pattern"), 1))
    by_letters = fuzzy.select("pattern", "kind", "field", F.when(F.col("long"), "two").otherwise("one").alias("by"), F.explode(left).alias("key"))
    def met(asked_: DataFrame, *kinds: str) -> DataFrame:
        of_kind = keys.where(F.col("kind").isin(*kinds)).withColumnRenamed("kind", "by")
        return of_kind.join(F.broadcast(asked_) if few else asked_, ["by", "field", "key"]).select("pattern", asked_["kind"], "field", "term")

    same = F.substring("term", 1, 2) == F.substring("pattern", 1, 2)
    near = edits_between(F.col("term"), F.col("pattern"), F.when(F.char_length("pattern") > LONG, 2).otherwise(1))
    fuzzy_weight = 1.0 - near / F.least(F.char_length("term"), F.char_length("pattern"))
    # held against the term before rows move; a wildcard has one key, so it meets a term once
    held = met(by_gram.union(by_length), "gram", "length").where(fits_wildcard(F.col("term"), F.col("pattern"))).withColumn("weight", F.lit(1.0))
    order = Window.partitionBy("kind", "pattern", "field").orderBy(F.col("weight").desc(), "term")
    close = met(by_letters, "one", "two").where(same).distinct().withColumn("weight", fuzzy_weight).where("weight > 0")
    ranked = close.withColumn("r", F.row_number().over(order)).where(F.col("r") <= best).drop("r")
    return held.union(ranked)


# --- files --------------------------------------------------------------------------------------------------


def _sorted(df: DataFrame, path: str, *order: str) -> None:
    """Written in one order through all files, in row groups and pages small enough to be left out."""
    made = df.repartitionByRange(*order).sortWithinPartitions(*order)
    made.write.mode("overwrite").option("parquet.block.size", 16 << 20).option("parquet.page.row.count.limit", 5000).parquet(path)


@dataclass(frozen=True)
class Postings:
    """An opened index."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def of(self, terms: Iterable[tuple[str, str]]) -> DataFrame:
        """The postings of a few (field, term): by equality with each, which the scan prunes by."""
        return self.table("postings").where(_any_of(terms))

    def frequencies(self, terms: Iterable[tuple[str, str]]) -> dict[tuple[str, str], int]:
        """Document frequencies of a few terms; those that don't occur are left out."""
        return {(r["field"], r["term"]): r["doc_freq"] for r in self.table("terms").where(_any_of(terms)).collect()}

    def matches(self, patterns: DataFrame) -> DataFrame:
        # at most so many: one of a wildcard, or the dictionary's lengths; what is left of a fuzzy word without one or two letters
        n = F.char_length("pattern").cast("bigint")
        keys = F.when(F.col("pattern").rlike("^[*?]*$"), 1000).when(F.col("kind") == "wild", 1).when(n > LONG, n * n / 2).otherwise(n)
        few = (patterns.agg(F.sum(keys)).first()[0] or 0) <= FEW_KEYS
        return matches(patterns, self.table("keys"), self.table("key_counts"), few=few)


def _any_of(terms: Iterable[tuple[str, str]]) -> Column:
    tests = [(F.col("field") == f) & (F.col("term") == t) for f, t in sorted(set(terms))]
    while len(tests) > 1:  # a balanced tree of ORs
        tests = [a | b for a, b in zip(tests[::2], tests[1::2], strict=False)] + tests[len(tests) // 2 * 2 :]
    return tests[0] if tests else F.lit(False)


def write_postings(df: DataFrame, path: str, order: str, fields: dict[str, str | None], fuzzy_fields: tuple[str, ...] = ("an",)) -> Postings:
    """The index of the token columns `fields` of df, whose rows are told apart by `order`; patterns can be looked up in fuzzy_fields."""
    index = Postings(df.sparkSession, path)
    _sorted(postings(df, order, fields), f"{path}/postings", "field", "term", "doc", "pos")
    of_doc = index.table("postings").groupBy("field", "term", "doc").agg(F.count(F.lit(1)).alias("n"))
    terms = of_doc.groupBy("field", "term").agg(F.count(F.lit(1)).alias("doc_freq"), F.sum("n").alias("total_freq"), F.max("n").alias("max_freq"))
    _sorted(terms, f"{path}/terms", "field", "term")
    _write_keys(index, fuzzy_fields)
    return index


def write_dictionary(uses: DataFrame, path: str) -> Postings:
    """The dictionary alone, of (field, term) once for each use: terms has field, term and total_freq, and all its fields can be looked up by patterns."""
    index = Postings(uses.sparkSession, path)
    _sorted(uses.groupBy("field", "term").agg(F.count(F.lit(1)).alias("total_freq")), f"{path}/terms", "field", "term")
    _write_keys(index)
    return index


def _write_keys(index: Postings, fields: tuple[str, ...] | None = None) -> None:
    terms = index.table("terms").select("field", "term")
    terms = terms if fields is None else terms.where(F.col("field").isin(*fields))
    n, most = terms.count(), index.spark.sparkContext.defaultParallelism
    keys = term_keys(terms.repartition(max(min(most, n // 500 + 1), -(-n // TASK_TERMS)), "field", "term"))
    for kind in ("gram", "length", "one", "two"):
        keys.where(F.col("kind") == kind).drop("kind").write.mode("overwrite").parquet(f"{index.path}/keys/kind={kind}")
    counts = index.table("keys").where("kind = 'gram'").groupBy("field", "key").agg(F.count(F.lit(1)).alias("n"))
    _sorted(counts, f"{index.path}/key_counts", "field", "key")
