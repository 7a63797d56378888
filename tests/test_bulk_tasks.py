"""What a task of the bulk match adds up doesn't grow with the corpus."""

import re

from pyspark.sql import functions as F

from onomast.operators import bulk_match
from onomast.plans.name_query import NameQuery
from onomast.sources.postings import write_postings
from onomast.sources.schema import index


def test_tasks_grow_with_what_is_met(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bulk_match, "ROWS", 100)
    clauses = bulk_match.clause_table(spark, [("red", NameQuery("red", is_surname=False, surname_field=False))])
    tasks, found = [], []
    for n in (200, 800):
        df = index(spark.range(n).select("id", F.lit("red ring").alias("n__fname_an")))
        posted = write_postings(df, str(tmp_path / str(n)), "id", {"an": "n__fname_an"})
        out = bulk_match.bulk_match(clauses, posted)
        tasks.append(out.rdd.getNumPartitions())
        found.append((out.count(), bulk_match.top_matches(clauses, posted, 3).count()))
    assert tasks[1] >= 4 * tasks[0] and found == [(200, 3), (800, 3)]


def test_candidates_meet_their_clauses_where_they_were_dealt(spark, tmp_path, monkeypatch):
    """The clauses multiply candidates in as many tasks as the rows need; only the candidates themselves are shuffled."""
    words = ["red", "ring", "blue", "bolt"]
    names = F.concat_ws(" ", F.element_at(F.lit(words), (F.col("id") % 4 + 1).cast("int")), F.element_at(F.lit(words), (F.col("id") % 3 + 1).cast("int")))
    posted = write_postings(index(spark.range(300).select("id", names.alias("n__fname_an"))), str(tmp_path), "id", {"an": "n__fname_an", "initial": "n__fname_an_initial", "exact": "n__fname"})
    clauses = bulk_match.clause_table(spark, [(t, NameQuery(t, is_surname=False, surname_field=False)) for t in ("red ring", "blue", "bolt red", "r")])
    rows = lambda df: [tuple(r) for r in df.orderBy("query_id", "rank").collect()]
    want = rows(bulk_match.top_matches(clauses, posted, 3))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for together in (200_000, 30):
            monkeypatch.setattr(bulk_match, "TOGETHER", together)
            monkeypatch.setattr(bulk_match, "ROWS", 1000)
            found = bulk_match.top_matches(clauses, posted, 3)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert not re.search(r"hashpartitioning\(doc#\d+L?, field#\d+, term#\d+", plan)
            assert rows(found) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
