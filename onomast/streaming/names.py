"""Arriving names scored against a fixed query: scoring is row-local, so a stream needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from onomast.operators.name_search import name_search
from onomast.plans.name_query import NameQuery
from onomast.sources.schema import index


def match_stream(names: DataFrame, query: NameQuery, base: str, synonyms: dict | None = None) -> DataFrame:
    """Works on batch and streaming frames with a raw `<base>_an` column."""
    return name_search(index(names, synonyms), query, base)
