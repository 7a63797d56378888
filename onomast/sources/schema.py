"""Dynamic fields by name suffix, derived fields and synonym files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onomast.functions import analysis as an

#: Plain types by suffix (fixed values).
PLAIN = {"__string": "string", "__boolean": "boolean", "__binary": "binary", "__int": "int", "__year": "int", "__long": "bigint", "__float": "float", "__double": "double", "__date": "timestamp"}
#: Derived fields of a source column, by suffix.
FIRST = {"_an": "fname_an", "_syn": "fname_syn", "": "fname", "_an_rs": "fname_an_rs", "_an_initial": "fname_an_initial"}
LAST = {"_an": "lname_an", "_syn": "lname_syn", "": "lname", "_an_rs": "lname_an_rs"}


def read_synonyms(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Lines `word=>a,b,c`: the word becomes the listed ones. A dictionary, so small enough for the driver."""
    out = {}
    for row in spark.read.text(path).where("value like '%=>%'").collect():
        left, right = row["value"].split("=>", 1)
        out[left.strip().lower()] = [w.strip().lower() for w in right.split(",") if w.strip()]
    return out


#: Analysis by kind: words of generic text, one lower-case value, and the name fields.
ANALYSED = {
    "text": an.analysed, "facet": an.text_facet,
    "fname": an.first_an, "fname_string": an.name_string, "fname_syn": an.first_syn, "fname_an_rs": an.first_rs, "fname_an_initial": an.first_initial,
    "lname": an.last_an, "lname_string": an.name_string, "lname_syn": an.last_syn, "lname_an_rs": an.last_rs,
}
#: Kinds whose column names end otherwise.
ENDS = {"fname_an": "fname", "lname_an": "lname", "fname": "fname_string", "lname": "lname_string", "facet_text": "facet"}


def resolve(column: str) -> str | None:
    """The plain type, `location` or analysed kind of a column name, with `_mv` behind it for several values, or none."""
    if "__" not in column:
        return None
    end = column.rsplit("__", 1)[1]
    if end.startswith("facet_text"):
        end = end.removesuffix("_ordered")
    one, many = end.removesuffix("_mv"), end.endswith("_mv")
    kind = PLAIN.get(f"__{one}") or ENDS.get(one) or (one if one == "location" or (one in ANALYSED and one != "facet") else None)
    if kind is None or (many and kind in ("boolean", "binary", "location", "fname_an_initial")):
        return None
    return f"{kind}_mv" if many else kind


def derived(source: str, synonyms: dict[str, dict[str, list[str]]] | None = None, tokens: Column | None = None) -> dict[str, Column]:
    """The analysed columns of a name column `x__fname_an`, `x__lname_an` or either with `_mv`, by field name.

    The analysed source itself is `<field>_an` and so replaces the raw column. tokens: a single value's own tokens, where they were made before.
    """
    kind = resolve(source)
    if not kind or kind.removesuffix("_mv") not in ("fname", "lname"):
        raise ValueError(f"{source} is no name column")
    syn = (synonyms or {}).get(kind[:5], {})
    many = kind.endswith("_mv")
    base, c, mv = source.removesuffix("_mv").removesuffix("_an"), F.col(source), "_mv" if many else ""
    each = (lambda f: an.multi_valued(c, f)) if many else (lambda f: f(c))
    if tokens is not None:
        rest = {"_an_rs": an.first_rs(c), "_an_initial": an.initials(tokens)} if kind == "fname" else {"_an_rs": an.phonetic(tokens)}
        out = {"_an": tokens, "_syn": an.with_synonyms(tokens, syn), **rest}
    elif kind[:5] == "fname":
        out = {"_an": each(an.first_an), "_syn": each(lambda x: an.first_syn(x, syn)), "_an_rs": each(an.first_rs)}
        if not many:
            out["_an_initial"] = an.first_initial(c)
    else:
        out = {"_an": each(an.last_an), "_syn": each(lambda x: an.last_syn(x, syn)), "_an_rs": each(an.last_rs)}
    exact = F.transform(c, an.name_string) if many else an.name_string(c)
    return {f"{base}{k}{mv}": v for k, v in out.items()} | {f"{base}{mv}": exact}


def analyse(column: str, kind: str, synonyms: dict[str, dict[str, list[str]]] | None = None) -> Column:
    """A column's own analysis, whatever else is derived from it."""
    one, many = kind.removesuffix("_mv"), kind.endswith("_mv")
    step = ANALYSED[one]
    if one.endswith("_syn"):
        step = lambda c: ANALYSED[one](c, (synonyms or {}).get(one[:5], {}))
    if not many:
        return step(F.col(column))
    return F.transform(column, step) if one in ("facet", "fname_string", "lname_string") else an.multi_valued(F.col(column), step)


def index(df: DataFrame, synonyms: dict[str, dict[str, list[str]]] | None = None) -> DataFrame:
    """Casts plain columns by suffix, analyses the others, and adds the columns derived from every analysed name column (which replace columns of their names)."""
    made: dict[str, Column] = {}
    # a step of its own, so that the fields derived from a name's tokens don't make them again
    own = {name: f"__tokens_{name}" for name in df.columns if resolve(name) in ("fname", "lname")}
    columns, df = df.columns, df.withColumns({t: ANALYSED[resolve(name)](F.col(name)) for name, t in own.items()})
    for name in columns:
        kind = resolve(name)
        if kind is None:
            continue
        plain = kind.removesuffix("_mv")
        if plain in PLAIN.values():
            made.setdefault(name, F.unbase64(name) if kind == "binary" else F.col(name).cast(f"array<{plain}>" if kind.endswith("_mv") else kind))
        elif kind == "location":
            at = F.split(name, ",")
            made[name] = F.struct(F.trim(at[0]).cast("double").alias("lat"), F.trim(at[1]).cast("double").alias("lon"))
        elif plain in ("fname", "lname"):
            made |= derived(name, synonyms, F.col(own[name]) if name in own else None)
        else:
            made.setdefault(name, analyse(name, kind, synonyms))
    return df.withColumns(made).drop(*own.values())
