"""Row-local scoring of a name query: higher-order functions over token arrays, no shuffle but the top-k merge."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from onomast.functions.edits import swapped
from onomast.functions.similarity import FLAT, Similarity
from onomast.plans.name_query import Clause, NameQuery, like, most_edits
from onomast.sources.postings import Postings


def fields_of(base: str, mv: bool = False, columns: list[str] | None = None) -> dict[str, str | None]:
    """The columns of a name field; those that `columns` lacks are None. Exact and null matches use the single-valued column."""
    tail = "_mv" if mv else ""
    out = {"an": f"{base}_an{tail}", "syn": f"{base}_syn{tail}", "rs": f"{base}_an_rs{tail}", "initial": f"{base}_an_initial{tail}", "exact": base}
    return {k: v if columns is None or v in columns else None for k, v in out.items()}


def proximity(tokens: Column, target: int | None, similarity: Similarity = FLAT) -> Column:
    """Sum over tokens of what the similarity makes of their distance to the target; without a target their number."""
    if target is None:
        return F.size(tokens).cast("double")
    return F.aggregate(tokens, F.lit(0.0), lambda s, t: s + similarity.sloppy(F.abs(t["pos"] - target)))


def position_score(tokens: Column, matches, target: int | None, boost: float = 1.0, similarity: Similarity = FLAT) -> Column:
    """boost times the similarity's tf of the proximity of the tokens that match; null without any."""
    mine = F.filter(tokens, matches)
    return F.when(F.size(mine) > 0, F.lit(boost) * similarity.tf(proximity(mine, target, similarity)))


def swaps(word: str) -> list[str]:
    """The word with two neighbours exchanged."""
    return sorted({word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)} - {word})


def edits(token: Column, word: str, most: int) -> Column:
    """Edit distance up to `most` (1 or 2) with exchanged neighbours as one edit, null beyond; the first two letters must agree."""
    near = lambda w, k: F.levenshtein(token, F.lit(w), k)
    plain = F.when(near(word, most) >= 0, near(word, most))
    once = [F.when(near(s, most - 1) >= 0, 1 + near(s, most - 1)) if most > 1 else F.when(token == s, F.lit(1)) for s in swaps(word)]
    twice = sorted({t for s in swaps(word) for t in swaps(s)} - {word}) if most > 1 else []
    once += [F.when(token.isin(twice), F.lit(2))] if twice else []
    if most > 1:  # a letter left out of the word may part the two that the token exchanges
        once += [F.when((F.char_length(token) == len(word) - 1) & F.exists(swapped(token), lambda w: F.levenshtein(w, F.lit(word), 1) >= 0), F.lit(2))]
    found = reduce(lambda a, b: F.least(a, b), once, plain) if once else plain
    return F.when(F.substring(token, 1, 2) == word[:2], found)


def fuzzy_weight(token: Column, word: str) -> Column:
    return 1.0 - edits(token, word, most_edits(word)) / F.least(F.char_length(token), F.lit(len(word)))


def clause_score(clause: Clause, fields: dict[str, str | None], similarity: Callable[[str], Similarity] = lambda column: FLAT) -> Column:
    """The clause's score on a row; null where it doesn't match. A column that doesn't exist matches nothing. similarity: of a column."""
    name = fields.get(clause.field)
    if name is None:
        return F.lit(None).cast("double")
    c = F.col(name)
    if clause.kind == "exact":
        freq = 1.0 if clause.target is None else 1.0 / (clause.target + 1)
        return F.when(c == clause.term, F.lit(clause.boost * freq**0.5))
    if clause.kind == "wild":
        return F.when(F.exists(c, lambda t: t["token"].like(like(clause.term))), F.lit(clause.boost))
    if clause.kind == "half":
        mine = F.filter(c, lambda t: t["token"] == clause.term)
        return F.when(F.size(mine) > 0, F.sqrt(F.size(mine) / 2.0))
    if clause.kind == "fuzzy" and clause.among is not None:
        if not clause.among:
            return F.lit(None).cast("double")
        terms, weights = F.lit([t for t, _ in clause.among]), F.lit([w for _, w in clause.among])
        mine = F.filter(c, lambda t: F.array_contains(terms, t["token"]))
        weight = lambda w: F.element_at(weights, F.array_position(terms, w).cast("int"))
        often = lambda w: F.size(F.filter(mine, lambda t: t["token"] == w)).cast("double")
        total = F.aggregate(F.array_distinct(F.transform(mine, lambda t: t["token"])), F.lit(0.0), lambda s, w: s + weight(w) * similarity(name).tf(often(w)))
        return F.when(F.size(mine) > 0, F.lit(clause.boost) * total)
    if clause.kind == "fuzzy":
        near = F.filter(c, lambda t: fuzzy_weight(t["token"], clause.term) > 0)
        terms = F.array_distinct(F.transform(near, lambda t: t["token"]))
        total = F.aggregate(terms, F.lit(0.0), lambda s, w: s + fuzzy_weight(w, clause.term) * F.sqrt(F.size(F.filter(near, lambda t: t["token"] == w)).cast("double")))
        return F.when(F.size(near) > 0, F.lit(clause.boost) * total)
    return position_score(c, lambda t: t["token"] == clause.term, clause.target, clause.boost, similarity(name))


def dismax(scores: list[Column], tie: float) -> Column:
    """The best score plus tie times the others; null where all are null."""
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    if not tie or len(scores) == 1:
        return best
    total = reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(0.0)) for s in scores])
    return best + tie * (total - best)


def _free(query: NameQuery, gender: str | None, kind: str = "string") -> Column:
    """Whether a row isn't of the excluded gender."""
    if not gender or not query.gender_value:
        return F.lit(True)
    c = F.col(f"`{gender}`")
    return ~F.coalesce(F.array_contains(c, query.gender_value) if kind.startswith("array") else c == query.gender_value, F.lit(False))


def clauses_of(query: NameQuery, dictionary: Postings | None) -> list[Clause]:
    """The query's clauses; with a dictionary a fuzzy word stands for its best fifty terms, at most fifty rows for each such word."""
    clauses = query.clauses()
    fuzzy = sorted({(c.term, c.field) for c in clauses if c.kind == "fuzzy"})
    if dictionary is None or not fuzzy:
        return clauses
    found: dict[tuple[str, str], list] = {key: [] for key in fuzzy}
    asked = dictionary.spark.createDataFrame([(t, "fuzzy", f) for t, f in fuzzy], "pattern string, kind string, field string")
    for r in dictionary.matches(asked).collect():
        found[r["pattern"], r["field"]].append((r["term"], r["weight"]))
    return [replace(c, among=tuple(sorted(found[c.term, c.field]))) if c.kind == "fuzzy" else c for c in clauses]


def _clause_scores(query: NameQuery, fields: dict[str, str | None], free: Column, similarity: Callable[[str], Similarity] = lambda column: FLAT, dictionary: Postings | None = None) -> list[tuple[Clause, Column]]:
    return [(c, F.when(free, s) if c.guard else s) for c in clauses_of(query, dictionary) for s in [clause_score(c, fields, similarity)]]


def query_score(query: NameQuery, fields: dict[str, str | None], gender: str | None = None, kind: str = "string", similarity: Callable[[str], Similarity] = lambda column: FLAT, dictionary: Postings | None = None) -> Column:
    """The query's score on a row, null where it doesn't match: every word must match, words add up."""
    scored = _clause_scores(query, fields, _free(query, gender, kind), similarity, dictionary)
    if not scored:
        return F.lit(None).cast("double")
    variants = []
    for v in sorted({c.variant for c, _ in scored}):
        words = [dismax([s for c, s in scored if (c.variant, c.tok) == (v, k)], query.tie) for k in sorted({c.tok for c, _ in scored if c.variant == v})]
        variants.append(reduce(lambda a, b: a + b, words))
    return dismax(variants, query.tie)


def fresh_score(df: DataFrame, score: str = "score") -> None:
    """Scores never replace a column of the caller's."""
    if score.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"the table has a column {score} already; rename it, or combine queries in one tree")


def gender_of(df: DataFrame, query: NameQuery, gender: str | None) -> tuple[str | None, str]:
    gender = gender or (query.gender_field if query.gender_field in df.columns else None)
    return gender, df.schema[gender].dataType.simpleString() if gender else "string"


def name_search(df: DataFrame, query: NameQuery, base: str, mv: bool = False, gender: str | None = None, dictionary: Postings | None = None) -> DataFrame:
    """The matching rows with their score. The excluded gender is sought in `gender`, or in the query's own field if there is one.

    dictionary: the stored terms of the field, by which a fuzzy word stands for its best fifty terms; without one, for every term within its edits.
    """
    fresh_score(df)
    fields = fields_of(base, mv, df.columns)
    return df.withColumn("score", query_score(query, fields, *gender_of(df, query, gender), dictionary=dictionary)).where(F.col("score").isNotNull())


def request(df: DataFrame, params: dict[str, str]) -> DataFrame:
    """A search by request parameters: v, f (with `_mv` for the multi-valued fields) and the options as strings."""
    query = NameQuery.of(params)
    return name_search(df, query, params["f"].removesuffix("_mv"), params["f"].endswith("_mv"))


ALTERNATIVE = "array<struct<variant:int,tok:int,kind:string,field:string,term:string,target:int,boost:double,score:double,k:int>>"


def explained(df: DataFrame, query: NameQuery, base: str, mv: bool = False, gender: str | None = None) -> DataFrame:
    """The matching rows with score and explanation: every alternative that matched, and whether it is the best of its word (the first of equals)."""
    fields = fields_of(base, mv, df.columns)
    scored = _clause_scores(query, fields, _free(query, *gender_of(df, query, gender)))
    lit = lambda v, kind: F.lit(v).cast(kind)
    rows = [F.struct(lit(c.variant, "int").alias("variant"), lit(c.tok, "int").alias("tok"), lit(c.kind, "string").alias("kind"), lit(c.field, "string").alias("field"), lit(c.term, "string").alias("term"), lit(c.target, "int").alias("target"), lit(c.boost, "double").alias("boost"), s.alias("score"), lit(k, "int").alias("k")) for k, (c, s) in enumerate(scored)]
    met = F.filter(F.array(*rows), lambda r: r["score"].isNotNull()) if rows else F.array().cast(ALTERNATIVE)

    def judged(all_: Column) -> Column:
        # the best of each word by one pass over the alternatives, as its number
        words = sorted({(c.variant, c.tok) for c, _ in scored})
        of = lambda v, w: F.filter(all_, lambda o: (o["variant"] == v) & (o["tok"] == w))
        best = F.array(*[F.array_min(F.transform(of(v, w), lambda o: F.struct((-o["score"]).alias("s"), o["k"].alias("k"))))["k"] for v, w in words]) if words else F.array().cast("array<int>")
        return F.transform(all_, lambda r: F.struct(*[r[c].alias(c) for c in ("variant", "tok", "kind", "field", "term", "target", "boost", "score")], F.array_contains(best, r["k"]).alias("best")))

    found = name_search(df, query, base, mv, gender)
    return found.withColumn("explanation", F.transform(F.array(met), judged)[0])


def ranked(df: DataFrame, order: str, k: int | None = None) -> DataFrame:
    """Best first, ties in the order of a stable key; the first k."""
    out = df.orderBy(F.round("score", 6).desc(), F.col(order).asc())
    return out if k is None else out.limit(k)


def sorted_by(df: DataFrame, column: str, order: str, descending: bool = False) -> DataFrame:
    """Rows in the order of a column, those without a value last whichever the direction, ties by a stable key."""
    c = F.col(column)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col(order).asc())


def term_query(df: DataFrame, tokens: str, term: str, target: int | None = None) -> DataFrame:
    return df.withColumn("score", position_score(F.col(tokens), lambda t: t["token"] == term, target)).where("score is not null")


def token_rule(kind: str, pattern: str) -> Callable[[Column], Column]:
    """Whether a token is the term, or one that a prefix, wildcard or fuzzy pattern takes in."""
    rules = {
        "term": lambda t: t["token"] == pattern, "prefix": lambda t: t["token"].startswith(pattern), "wildcard": lambda t: t["token"].like(like(pattern)),
        "fuzzy": lambda t: F.coalesce(edits(t["token"], pattern, most_edits(pattern)) >= 0, F.lit(False)),
    }
    return rules[kind]


def multi_term_query(df: DataFrame, tokens: str, pattern: str, kind: str, target: int | None = None, dictionary: Postings | None = None, field: str = "an") -> DataFrame:
    """Positions of all tokens that a prefix, wildcard or fuzzy pattern takes in, together; with a dictionary a fuzzy one takes in its best fifty terms of the field."""
    if dictionary is not None and kind == "fuzzy":
        asked = dictionary.spark.createDataFrame([(pattern, "fuzzy", field)], "pattern string, kind string, field string")
        terms = [r["term"] for r in dictionary.matches(asked).collect()]
        rule = lambda t: t["token"].isin(terms) if terms else F.lit(False)
        return df.withColumn("score", position_score(F.col(tokens), rule, target)).where("score is not null")
    return df.withColumn("score", position_score(F.col(tokens), token_rule(kind, pattern), target)).where("score is not null")


def field_query(df: DataFrame, tokens: str, words: list[str]) -> DataFrame:
    """Rows that hold any of the words; the words' square-root frequencies add up."""
    scores = [position_score(F.col(tokens), _equals(w), None) for w in words]
    total = reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(0.0)) for s in scores], F.lit(0.0))
    return df.withColumn("score", total).where("score > 0")


def _equals(word: str):
    return lambda t: t["token"] == word


def match_all(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.lit(1.0))


def with_total(df: DataFrame, order: str, k: int) -> tuple[list[Row], int]:
    """The first k rows and the number of all matches, which is counted while they are ranked: one job."""
    seen = Observation()
    rows = ranked(df.observe(seen, F.count(F.lit(1)).alias("n")), order, k).collect()
    return rows, seen.get["n"]


def response(df: DataFrame, order: str, k: int, path: str) -> int:
    """Writes a response as JSON lines below path: a line with numFound and the highest score, then the first k rows in their order. Returns numFound."""
    rows, total = with_total(df, order, k)
    spark = df.sparkSession
    best = max((r["score"] for r in rows), default=None)
    head = spark.range(1).select(F.to_json(F.struct(F.lit(total).alias("numFound"), F.lit(best).cast("double").alias("maxScore"))).alias("value"))
    body = spark.createDataFrame(rows, df.schema).select(F.to_json(F.struct("*")).alias("value"))
    head.union(body).coalesce(1).write.text(path)
    return total

