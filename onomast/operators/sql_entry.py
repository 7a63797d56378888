"""Name searches from SQL: a table function over an index, made of Spark's own expressions, so that no row passes through Python.

    register(spark, "people", "n__fname", surname=False)
    spark.sql("SELECT * FROM name_search('red widget', is_surname => false, gendervalue => 'male') ORDER BY score DESC LIMIT 10")

The options are those of a name query with the same defaults (fuzzy words need the stored dictionary and are left out). The query's text may be any
expression that is constant for the call; words, patterns and phonetic codes are taken from it once a call, not once a row.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from onomast.functions import analysis as an
from onomast.operators.name_search import fields_of
from onomast.plans.name_query import NameQuery

#: Options by name, with their SQL types; the defaults are the name query's.
OPTIONS = {
    "tie": "DOUBLE", "exactboost": "DOUBLE", "synboost": "DOUBLE", "initialboost": "DOUBLE", "phoneticboost": "DOUBLE", "nullboost": "DOUBLE", "wildboost": "DOUBLE",
    "useexact": "BOOLEAN", "usephonetic": "BOOLEAN", "usenull": "BOOLEAN", "useinitial": "BOOLEAN", "usesyn": "BOOLEAN", "is_surname": "BOOLEAN", "compat": "BOOLEAN",
}


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _fold(c: str) -> str:
    table = an.fold_table()
    out = f"translate({c}, {_text(''.join(table))}, {_text(''.join(table.values()))})"
    for k, v in an.FOLD_LONG.items():
        out = f"replace({out}, {_text(k)}, {_text(v)})"
    return out


def _split(c: str, kept: str = "") -> str:
    """The parts between delimiters, cut also where letters meet digits."""
    cut = rf"regexp_replace({c}, r'(?<=\p{{L}})(?=\p{{N}})|(?<=\p{{N}})(?=\p{{L}})', '-')"
    return rf"filter(split({cut}, r'[^\p{{L}}\p{{N}}{kept}]+'), p -> p <> '')"


def _code(c: str) -> str:
    letters = f"upper(regexp_replace({c}, '[^A-Za-z]', ''))"
    digits = rf"regexp_replace(translate({letters}, '{an.LETTERS}', '{an.PHONETIC}'), r'(.)\1+', '$1')"
    return f"if({letters} = '', {c}, concat(left({letters}, 1), {digits}))"


def _near(tokens: str | None, term: str, boost: str, at: str = "x.at") -> str:
    """The score of a term near its place; null where it doesn't stand."""
    if tokens is None:
        return "CAST(NULL AS DOUBLE)"
    mine = f"filter({tokens}, t -> t.token = {term})"
    return f"{boost} * sqrt(nullif(aggregate({mine}, 0D, (n, t) -> n + if({at} IS NULL, 1D, 1D / (abs(t.pos - {at}) + 1))), 0D))"


def _best(scores: str) -> str:
    """The best of an array of scores plus tie times the others; null where all are null."""
    return f"array_max({scores}) + q_.tie * (aggregate({scores}, 0D, (n, x) -> n + coalesce(x, 0D)) - array_max({scores}))"


def _once(value: str, name: str, of: str) -> str:
    """What `of` makes of a value that is computed once, however often its name stands there."""
    return f"get(transform(array({value}), {name} -> {of}), 0)"


def _alternatives(columns: dict[str, str | None], guard: str) -> str:
    """The scores of the alternatives of x, a word with its place (null: anywhere), factor and phonetic code."""
    guarded = lambda score: f"if(x.at IS NULL OR {guard}, {score}, NULL)"
    exact = columns["exact"] or "CAST(NULL AS STRING)"
    half = f"{_near(columns['initial'], 'left(x.word, 1)', '1D', 'CAST(NULL AS INT)')} / sqrt(2D)"
    first = guarded(_near(columns["initial"], "left(x.word, 1)", "q_.wildboost * x.factor"))
    wild = f"if({guard} AND exists({columns['an']}, t -> t.token LIKE x.like), q_.wildboost * x.factor, NULL)"
    is_half = "NOT q_.is_surname AND length(x.word) = 2 AND NOT left(x.word, 1) IN ('*', '?')"
    longer = "length(x.word) > 1"
    plain = [
        _near(columns["an"], "x.word", "x.factor"),
        f"if(q_.useexact AND {exact} = q_.exact, q_.exactboost * x.factor, NULL)",
        guarded(f"if(q_.usenull AND {exact} = '-', q_.nullboost * x.factor * sqrt(if(x.at IS NULL, 1D, 1D / (x.at + 1))), NULL)"),
        guarded(f"if(q_.useinitial AND NOT {longer}, {_near(columns['initial'], 'x.word', 'q_.initialboost * x.factor')}, NULL)"),
        f"if(q_.usesyn AND {longer}, {_near(columns['syn'], 'x.word', 'q_.synboost * x.factor')}, NULL)",
        guarded(f"if(q_.useinitial AND {longer}, {_near(columns['an'], 'left(x.word, 1)', 'q_.initialboost * x.factor')}, NULL)"),
        guarded(f"if(q_.usephonetic AND {longer}, {_near(columns['rs'], 'x.code', 'q_.phoneticboost * x.factor')}, NULL)"),
    ]
    return f"if(x.like IS NOT NULL, array(if({is_half}, if(q_.compat, {half}, {first}), {wild})), array({', '.join(plain)}))"


def function_sql(view: str, columns: list[tuple[str, str]], base: str, surname: bool, mv: bool = False, gender: str | None = None, name: str = "name_search") -> str:
    """CREATE FUNCTION over a view with the columns (name, type), for the name field `base`; gender: the column that gendervalue is compared with.

    The query is taken apart in a table of one row, `q_`, which rows meet.
    """
    fields = {k: f"v.`{c}`" if c else None for k, c in fields_of(base, mv, [c for c, _ in columns]).items()}
    query, words = NameQuery(""), _split("lower(q_folded)", "*?") if surname else r"filter(split(lower(q), r'\s+'), p -> p <> '')"
    defaults = ", ".join(f"{k} {kind} DEFAULT {str(getattr(query, k)).lower() + ('D' if kind == 'DOUBLE' else '')}" for k, kind in OPTIONS.items())
    guard = f"(q_.gendervalue IS NULL OR NOT coalesce(v.`{gender}` = q_.gendervalue, false))" if gender else "true"
    own = ", ".join(f"v.`{c}`" for c, _ in columns)
    table = ", ".join(f"`{c}` {kind}" for c, kind in columns)
    # the words, and all of them joined as one more, each with its place, factor, the code of its first part and, if it has wildcards, its pattern
    every = "concat(q_words, if(is_surname AND size(q_words) > 1, array(array_join(q_words, '')), CAST(array() AS ARRAY<STRING>)))"
    codes = f"transform(transform(q_all, w -> get({_split(f'lower({_fold("w")})')}, 0)), p -> {_code('p')})"
    like = r"if(w RLIKE '[*?]', replace(replace(replace(replace(replace(w, '\\', '\\\\'), '%', '\\%'), '_', '\\_'), '*', '%'), '?', '_'), NULL)"
    placed = f"transform(q_all, (w, i) -> named_struct('word', w, 'code', get(q_codes, i), 'like', {like}, 'at', if((is_surname AND size(q_words) = 1) OR i = size(q_words), CAST(NULL AS INT), i), 'factor', if(i = size(q_words), CAST(i AS DOUBLE), 1D)))"
    options = ", ".join(f"'{k}', {k}" for k in ("gendervalue", *OPTIONS))
    steps = [
        f"SELECT {_fold('q')} AS q_folded", f"SELECT *, {words} AS q_words, trim(lower(q_folded)) AS q_exact FROM (%)", f"SELECT *, {every} AS q_all FROM (%)", f"SELECT *, {codes} AS q_codes FROM (%)",
        f"SELECT named_struct({options}, 'n', size(q_words), 'exact', q_exact, 'placed', {placed}) AS q_ FROM (%)",
    ]
    asked = steps[0]
    for step in steps[1:]:
        asked = step.replace("(%)", f"({asked})")
    scores = f"transform(transform(q_.placed, x -> {_alternatives(fields, guard)}), a -> {_best('a')})"
    variants = "array(if(q_.n > 0 AND forall(slice(s, 1, q_.n), o -> o IS NOT NULL), aggregate(slice(s, 1, q_.n), 0D, (n, o) -> n + o), NULL), get(s, q_.n))"
    score = _once(scores, "s", _once(variants, "b", _best("b")))
    # one expression, so that a filter that the optimizer moves down computes it once more and not once for each of its uses
    body = f"SELECT * FROM (SELECT {own}, {score} AS score FROM {view} v CROSS JOIN ({asked})) WHERE score IS NOT NULL"
    return f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(q STRING, gendervalue STRING DEFAULT NULL, {defaults}) RETURNS TABLE ({table}, score DOUBLE) RETURN {body}"


def register(spark: SparkSession, view: str, base: str, surname: bool, mv: bool = False, gender: str | None = None, name: str = "name_search") -> None:
    """Makes the table function `name` over the view or table of an analysed index."""
    spark.sql(function_sql(view, spark.table(view).dtypes, base, surname, mv, gender, name))
