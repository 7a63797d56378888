"""Searches by the SQL table function against the same searches from Python."""

import pytest

from onomast.operators import name_search, sql_entry
from onomast.plans.name_query import NameQuery
from onomast.sources.schema import index
from tests.test_name_search import PEOPLE, SURNAMES, SYN


@pytest.fixture(scope="module")
def views(spark):
    df = spark.createDataFrame(PEOPLE, "Id string, name__fname_an string, name__lname_an string, Gender__facet_text string, name__fname_an_mv array<string>")
    more = spark.createDataFrame([(f"s{k}", None, n, None, None) for k, n in enumerate(SURNAMES)], df.schema)
    index(df.union(more), SYN).createOrReplaceTempView("people_view")
    for name, base, surname, mv in (("first_search", "name__fname", False, False), ("last_search", "name__lname", True, False), ("many_search", "name__fname", False, True)):
        sql_entry.register(spark, "people_view", base, surname, mv, "Gender__facet_text", name)
    return spark.table("people_view")


CASES = [
    ("first_search", "o two", {"is_surname": False, "tie": 0.25}), ("first_search", "three", {"is_surname": False, "gendervalue": "male"}), ("first_search", "One Two", {"is_surname": False, "useexact": True}),
    ("first_search", "o*", {"is_surname": False}), ("first_search", "o*", {"is_surname": False, "compat": False}), ("first_search", "*hre? one", {"is_surname": False}), ("first_search", " ", {"is_surname": False}),
    ("last_search", "smith-jones", {}), ("last_search", "o'connor", {"useinitial": False}), ("last_search", "bright j*", {}), ("many_search", "seven", {}), ("first_search", "one 100% it's_", {"is_surname": False}),
]


@pytest.mark.parametrize(("function", "text", "options"), CASES)
def test_sql_equals_python(spark, views, function, text, options):
    query = NameQuery(text, surname_field=function == "last_search", **{("gender_value" if k == "gendervalue" else k): v for k, v in options.items()})
    base = "name__lname" if function == "last_search" else "name__fname"
    want = name_search.name_search(views, query, base, function == "many_search", "Gender__facet_text")
    said = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}D" if isinstance(v, float) else str(v).lower()
    quoted = text.replace("'", "\\'")
    got = spark.sql(f"SELECT Id, score FROM {function}('{quoted}'{''.join(f', {k} => {said(v)}' for k, v in options.items())})")
    rows = lambda df: sorted((r["Id"], round(r["score"], 9)) for r in df.collect())
    assert rows(got) == rows(want)


def test_the_plan_has_no_python_and_joins_like_a_table(spark, views):
    got = spark.sql("SELECT s.*, p.name__fname AS whole FROM first_search('one', is_surname => false) s JOIN people_view p USING (Id) WHERE s.score > 0.5 ORDER BY s.score DESC, Id LIMIT 2")
    assert [r["Id"] for r in got.collect()] == ["1", "2"]
    assert "Python" not in spark.sql("SELECT * FROM first_search('one')")._jdf.queryExecution().toString()


def test_the_query_is_taken_apart_once_a_call(spark, tmp_path):
    index(spark.createDataFrame([("1", "one two"), ("2", "won")], "Id string, name__lname_an string"), SYN).write.parquet(f"{tmp_path}/names")
    spark.read.parquet(f"{tmp_path}/names").createOrReplaceTempView("stored_names")
    sql_entry.register(spark, "stored_names", "name__lname", True, name="stored_search")
    found = spark.sql("SELECT Id FROM stored_search('one two')")
    by_row = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "name__lname_an#" in line]
    assert by_row and not [line for line in by_row if "split(" in line]
    assert [r["Id"] for r in found.collect()] == ["1"]
