"""Combined queries compiled to one projection: every node is an expression on the row, null where it doesn't match."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onomast.functions import payload
from onomast.functions import similarity as sim
from onomast.functions.similarity import Similarity
from onomast.operators.name_search import fields_of, fresh_score, gender_of, position_score, query_score, token_rule
from onomast.plans import query_tree as qt


@dataclass(frozen=True)
class Scoring:
    """How columns score: a similarity for each, flat unless named, and for those with idf the number of documents and each term's document frequency.

    norms: the column that keeps a token column's norm byte, where it is stored; else norms come from the tokens.
    """

    by_column: Mapping[str, Similarity] = field(default_factory=dict)
    default: Similarity = sim.FLAT
    docs: int = 0
    doc_freq: Callable[[str, str], int] = lambda column, term: 0
    norms: Mapping[str, str] = field(default_factory=dict)

    def of(self, column: str) -> Similarity:
        return self.by_column.get(column, self.default)

    def weight(self, column: str, term: str) -> Column:
        """What a term's frequency counts on a row: idf twice (query and field) and the field's norm."""
        own = self.of(column)
        if own.plain:
            return F.lit(1.0)
        idf = own.idf(F.lit(self.doc_freq(column, term)), F.lit(self.docs))
        norm = sim.decoded(F.col(self.norms[column])) if column in self.norms else own.length_norm(F.col(column))
        return idf * idf * norm


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def score_of(node: qt.Node, df: DataFrame, scoring: Scoring) -> Column:
    """The node's score on a row of df, null where it doesn't match. A column that doesn't exist matches nothing."""
    none = F.lit(None).cast("double")
    if isinstance(node, qt.All):
        return _combined(node, df, scoring)
    if isinstance(node, qt.Everything):
        return F.lit(1.0)
    if isinstance(node, qt.Name):
        return query_score(node.query, fields_of(node.base, node.mv, df.columns), *gender_of(df, node.query, None), similarity=lambda column: scoring.of(column))
    if node.column not in df.columns:
        return none
    column = F.col(f"`{node.column}`")
    if isinstance(node, qt.Value):
        kind = df.schema[node.column].dataType.typeName()
        return F.when(F.array_contains(column, node.value) if kind == "array" else column.cast("string") == node.value, F.lit(1.0))
    if isinstance(node, qt.Payload):
        return payload.payload_score(column, node.term, node.posn, node.mult)
    own = scoring.of(node.column)
    if isinstance(node, qt.Positioned):
        weight = scoring.weight(node.column, node.term) if node.kind == "term" else F.lit(1.0)
        return position_score(column, token_rule(node.kind, node.term), node.target, similarity=own) * weight
    found = [position_score(column, token_rule("term", w), None, similarity=own) * scoring.weight(node.column, w) for w in dict.fromkeys(node.words)]
    return F.when(F.coalesce(*found).isNotNull(), _sum([F.coalesce(s, F.lit(0.0)) for s in found])) if found else none


def _combined(node: qt.All, df: DataFrame, scoring: Scoring) -> Column:
    must, should, out = ([score_of(n, df, scoring) for n in part] for part in (node.must, node.should, node.must_not))
    if not must and not should:
        return F.lit(None).cast("double")
    # an alternative's expression stands once for its score and once for the test, which common subexpression elimination makes one
    tests = [s.isNotNull() for s in must] + [s.isNull() for s in out]
    least = max(node.at_least, 0 if must else 1)
    if least:
        tests.append(_sum([s.isNotNull().cast("int") for s in should] or [F.lit(0)]) >= least)
    total = _sum(must + [F.coalesce(s, F.lit(0.0)) for s in should])
    return F.when(reduce(lambda a, b: a & b, tests), total * F.lit(float(node.boost)))


def tree_search(df: DataFrame, node: qt.Node, scoring: Scoring | None = None, score: str = "score") -> DataFrame:
    """The matching rows with their score, by one pass over the columns that the tree names."""
    fresh_score(df, score)
    return df.withColumn(score, score_of(node, df, scoring or Scoring())).where(F.col(score).isNotNull())
