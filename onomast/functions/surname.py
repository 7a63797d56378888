"""A normalised surname key for ETL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = "#"


def surname_key(c: Column, regex: str, default_match: str | None = None) -> Column:
    """'#' for null, blank, a default match or no match; else the whole match of the regex in lower case.

    A pattern counts only if it has a capture group.
    """
    has_group = lambda p: bool(p) and re.compile(p).groups > 0
    out = F.when(c.isNull() | (F.regexp_replace(c, r"[\x00-\x20]+", "") == ""), F.lit(NONE))
    if has_group(default_match):
        out = out.when(c.rlike(default_match), F.lit(NONE))
    if has_group(regex):
        out = out.when(c.rlike(regex), F.lower(F.regexp_extract(c, regex, 0)))
    return out.otherwise(F.lit(NONE))


def transform_surnames(df: DataFrame, fields: dict[str, dict[str, str]]) -> DataFrame:
    """fields: source column to surname_col, regex and default_match; arrays are keyed element by element."""
    for source, rule in fields.items():
        key = lambda c, r=rule: surname_key(c, r["regex"], r.get("default_match"))
        made = F.transform(F.col(source), lambda x: key(x)) if df.schema[source].dataType.typeName() == "array" else key(F.col(source))
        df = df.withColumn(rule["surname_col"], made)
    return df
