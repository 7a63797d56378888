"""Name search over small corpora: ids in order, number of matches and scores."""

import pytest
from pyspark.sql import functions as F

from onomast.functions import analysis as an
from onomast.operators import bulk_match, name_search
from onomast.plans.name_query import NameQuery, flag
from onomast.sources.schema import index, read_synonyms, resolve

SYN = {"fname": {"one": ["one", "won", "first"], "two": ["two", "too", "second"], "three": ["three", "free", "third"]}}
PEOPLE = [
    ("1", "one", "jones smith", "male", None), ("2", "one two", "smith-jones", "female", None), ("3", "two one", "bright", "unknown", None),
    ("4", "t o", None, "female", None), ("5", "o t", None, "male", None), ("6", "threee", None, "male", None),
    ("7", "three", None, None, ["seven"]), ("8", "-", None, "male", None),
]
SURNAMES = ["oconnor", "o'connor", "o connor", "o-connor", "connor", "o hagan", "o" + " " * 25 + "connor"]


@pytest.fixture(scope="module")
def people(spark):
    df = spark.createDataFrame(PEOPLE, "Id string, name__fname_an string, name__lname_an string, Gender__facet_text string, name__fname_an_mv array<string>")
    return index(df, SYN).cache()


def search(df, text, last=False, mv=False, **options):
    query = NameQuery(text, surname_field=last, **options)
    found = name_search.name_search(df, query, "name__lname" if last else "name__fname", mv, "Gender__facet_text")
    return [(r["Id"], round(r["score"], 6)) for r in name_search.ranked(found, "Id").collect()]


OFF = {"usesyn": False, "useinitial": False, "usephonetic": False, "usenull": False}


@pytest.mark.parametrize(
    ("text", "options", "want"),
    [
        ("j*", {"last": True, "useexact": True, **OFF}, [("1", 0.1), ("2", 0.1)]),
        ("seven", {"mv": True}, [("7", 1), ("8", 0.01)]),
        ("won", {}, [("1", 0.8), ("2", 0.8), ("3", 0.8), ("8", 0.01)]),
        ("brite", {"last": True}, []),
        ("one tw*", {"is_surname": False}, [("2", 1.1), ("3", 0.807107)]),
        ("tw* one", {"is_surname": False}, [("3", 1.1), ("2", 0.807107)]),
        ("tw*", {}, [("2", 0.1), ("3", 0.1)]),
        ("tw?", {}, [("2", 0.1), ("3", 0.1)]),
        ("t*", {"usefuzzy": True}, [(i, 0.1) for i in "234567"]),
        ("smith jones", {"last": True, "is_surname": False}, [("2", 2), ("1", 1.414214)]),
        ("", {"is_surname": False}, []),
        ("o t", {"is_surname": False}, [("5", 2), ("4", 1.414214), ("2", 0.84), ("3", 0.59397), ("8", 0.017071)]),
        ("o two", {"is_surname": False}, [("2", 1.42), ("5", 1.42), ("3", 1.004092), ("4", 1.004092), ("8", 0.017071)]),
        ("two one", {"is_surname": False}, [("3", 2), ("2", 1.414214), ("4", 0.84), ("5", 0.59397), ("8", 0.017071)]),
        ("one", {"is_surname": False}, [("1", 1), ("2", 1), ("3", 0.707107), ("5", 0.42), ("4", 0.296985), ("8", 0.01)]),
        ("three", {"is_surname": False}, [("7", 1), ("6", 0.75), ("4", 0.42), ("5", 0.296985), ("8", 0.01)]),
        ("three", {"is_surname": False, "usephonetic": False}, [("7", 1), ("4", 0.42), ("5", 0.296985), ("8", 0.01)]),
        ("one", {"is_surname": False, "gender_value": "female"}, [("1", 1), ("2", 1), ("3", 0.707107), ("5", 0.42), ("8", 0.01)]),
        ("one", {"is_surname": False, "gender_value": "male"}, [("1", 1), ("2", 1), ("3", 0.707107), ("4", 0.296985)]),
        ("three", {"is_surname": False, "gender_value": "male"}, [("7", 1), ("4", 0.42)]),
        ("o*", {"is_surname": False}, [("1", 0.707107), ("2", 0.707107), ("3", 0.707107), ("4", 0.707107), ("5", 0.707107)]),
    ],
)
def test_people(people, text, options, want):
    assert search(people, text, **options) == want


@pytest.mark.parametrize(("text", "want"), [("oconnor", "12347"), ("o connor", "12347"), ("o-connor", "12347"), ("o'connor", "12347"), ("connor", "23457"), ("o hagan", "6")])
def test_surnames(spark, text, want):
    df = index(spark.createDataFrame([(str(k + 1), n) for k, n in enumerate(SURNAMES)], "Id string, name__lname_an string"))
    query = NameQuery(text, useinitial=False)
    assert sorted(r["Id"] for r in name_search.name_search(df, query, "name__lname").collect()) == list(want)


def test_fields(people):
    count = lambda col, words: name_search.field_query(people, f"name__fname{col}", words).count()
    assert count("_an_initial", ["o"]) == 5 and count("_syn", ["too"]) == 2 and count("_an_rs", [an.code("thre")]) == 2
    rows = {r["Id"]: r for r in people.collect()}
    assert [(t["token"], t["pos"]) for t in rows["2"]["name__lname_an"]] == [("smith", 0), ("jones", 1), ("smithjones", 1)]
    assert rows["8"]["name__fname_an"] == [] and rows["8"]["name__fname"] == "-"


def test_bulk_equals_row_local(spark, people):
    texts = ["one", "o t", "two one", "three", "o two", "o*"]
    queries = [(t, NameQuery(t, is_surname=False, surname_field=False, gender_value="female", tie=0.25)) for t in texts]
    posted = bulk_match.postings(people, "Id", name_search.fields_of("name__fname", columns=people.columns))
    excluded = people.where(F.col("Gender__facet_text") == "female").select(F.col("Id").alias("doc"))
    got = {(r[0], r[1]): round(r[2], 9) for r in bulk_match.bulk_match(bulk_match.clause_table(spark, queries), posted, 0.25, excluded).collect()}
    want = {}
    for t, q in queries:
        found = name_search.name_search(people, q, "name__fname", gender="Gender__facet_text")
        want |= {(t, r["Id"]): round(r["score"], 9) for r in found.collect()}
    assert got == want


def scored(df, spark_rows):
    return [(r["text"], round(r["score"], 6)) for r in name_search.ranked(df, "k").collect()][: len(spark_rows)]


def words(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "k int, text string").withColumn("t", an.whitespace_words(F.col("text")))


@pytest.mark.parametrize(("target", "want"), [(0, [("one one two", 1.224745), ("one", 1), ("one two", 1)]), (1, [("one one two", 1.224745), ("two one", 1)]), (10, [("one one two", 0.436931), ("three two one", 0.333333), ("two one", 0.316228)])])
def test_target_position(spark, target, want):
    df = words(spark, ["two", "one", "one two", "two one", "one two three", "three two one", "one one two"])
    found = name_search.term_query(df, "t", "one", target)
    assert found.count() == 6 and scored(found, want) == want


@pytest.mark.parametrize(("pattern", "kind", "target", "first"), [("three", "fuzzy", 1, "two threx one"), ("tw", "prefix", 2, "threx one twp"), ("tw*", "wildcard", 2, "threx one twp")])
def test_multi_term(spark, pattern, kind, target, first):
    found = name_search.multi_term_query(words(spark, ["one two threx", "two threx one", "threx one twp"]), "t", pattern, kind, target)
    assert found.count() == 3 and name_search.ranked(found, "k", 1).first()["text"] == first


@pytest.mark.parametrize(("a", "b", "most", "want"), [("three", "trhee", 1, None), ("three", "thre", 1, 1), ("three", "three", 1, 0), ("three", "thrre", 1, 1), ("washington", "wahsingtno", 2, 2), ("washington", "washinton", 2, 1), ("washington", "wasxxxton", 2, None), ("three", "thereabout", 1, None)])
def test_edits(spark, a, b, most, want):
    assert spark.createDataFrame([(b,)], "b string").select(name_search.edits(F.col("b"), a, most)).first()[0] == want


def test_scores_never_rise_without_an_alternative(people):
    full = dict(search(people, "o two", is_surname=False))
    for name in ("usesyn", "useinitial", "usephonetic", "usenull"):
        assert all(s <= full[i] + 1e-9 for i, s in search(people, "o two", is_surname=False, **{name: False}))


def test_options():
    q = NameQuery.of({"v": " x y ", "f": "name__fname", "isSurname": "TRUE", "useexact": "yes", "synboost": "0.5", "gendervalue": "male"})
    assert (q.text, q.is_surname, q.useexact, q.synboost, q.gender_value, q.surname_field) == ("x y", True, False, 0.5, "male", False)
    assert flag("True") and not flag("1")


def test_analysis(spark, tmp_path):
    one = lambda c: spark.range(1).select(c).first()[0]
    codes = {"one": "O080", "won": "W08", "two": "T60", "threee": "T6090", "oconnor": "O030809", "bright": "B190406", "brite": "B19060"}
    for w, c in codes.items():
        assert an.code(w) == c and one(an.phonetic_code(F.lit(w))) == c
    assert one(an.fold(F.lit("Éßæ łŸ"))) == "Essae lY" == an.fold_text("Éßæ łŸ")
    many = one(an.multi_valued(F.array(F.lit("a b"), F.lit(None), F.lit("c")), an.first_an))
    assert [(t["token"], t["pos"]) for t in many] == [("a", 0), ("b", 1), ("c", 202)]
    assert one(an.first_an(F.lit(None).cast("string"))) == []
    path = tmp_path / "s.csv"
    path.write_text("One=>one,won\n\nbad line\n")
    assert read_synonyms(spark, str(path)) == {"one": ["one", "won"]}
    assert [resolve(x) for x in ("a__int", "b__lname_an_mv", "c__location", "d")] == ["int", "lname_mv", "location", None]
