"""Combined queries over small corpora, and the index that grows by segments against one that is written at once."""

import pytest
from pyspark.sql import functions as F

from onomast import corpus
from onomast.functions import similarity as sim
from onomast.operators import name_search, tfidf, tree_search
from onomast.plans import query_tree as qt
from onomast.sources.schema import index
from onomast.sources.segments import Segments, norm_columns
from tests.test_name_search import OFF, PEOPLE, SURNAMES, SYN, search


@pytest.fixture(scope="module")
def people(spark):
    df = spark.createDataFrame(PEOPLE, "Id string, name__fname_an string, name__lname_an string, Gender__facet_text string, name__fname_an_mv array<string>")
    return index(df, SYN).cache()


def ids(df, node, **more):
    return [(r["Id"], round(r["score"], 6)) for r in name_search.ranked(tree_search.tree_search(df, node, **more), "Id").collect()]


@pytest.mark.parametrize(
    ("request_", "text", "options"),
    [
        ("_query_:{!nameQuery useexact=true usesyn=false useinitial=false usephonetic=false usenull=false f=name__lname}j*", "j*", {"last": True, "useexact": True, **OFF}),
        ("_query_:{!nameQuery f=name__fname_mv }seven", "seven", {"mv": True}), ("_query_:{!nameQuery f=name__fname }won", "won", {}), ('_query_:"{!nameQuery f=name__fname }one tw*"', "one tw*", {}),
        ('_query_:"{!nameQuery f=name__lname isSurname=false}smith jones"', "smith jones", {"last": True, "is_surname": False}), ('_query_:"{!nameQuery f=name__fname isSurname=false}"', "", {"is_surname": False}),
        ("{!nameQuery gendervalue='female' isSurname=false f=name__fname }one", "one", {"is_surname": False, "gender_value": "female"}), ("{!nameQuery tie=0.5 synboost=\"0.25\" f=name__fname isSurname=false}o two", "o two", {"is_surname": False, "tie": 0.5, "synboost": 0.25}),
    ],
)
def test_requests(people, request_, text, options):
    assert ids(people, qt.of_request(request_)) == search(people, text, **options)


def test_surname_requests(spark):
    df = index(spark.createDataFrame([(str(k + 1), n) for k, n in enumerate(SURNAMES)], "Id string, name__lname_an string"))
    for text, want in {"oconnor": "12347", "o connor": "12347", "connor": "23457", "o hagan": "6"}.items():
        assert sorted(i for i, _ in ids(df, qt.of_request("{!nameQuery useinitial=false f=name__lname}" + text))) == list(want)
    for bad in ("one", "{!nameQuery tie=1}x"):
        with pytest.raises(ValueError, match="name"):
            qt.of_request(bad)


ONE, JONES = qt.of_request("{!nameQuery f=name__fname isSurname=false}one"), qt.of_request("{!nameQuery f=name__lname usenull=false}jones")
FEMALE = qt.Value("Gender__facet_text", "female")


def test_must_should_and_must_not(people):
    one, jones = dict(ids(people, ONE)), dict(ids(people, JONES))
    added = lambda keys: sorted(((i, round(one.get(i, 0) + jones.get(i, 0), 6)) for i in keys), key=lambda x: (-x[1], x[0]))
    assert ids(people, qt.All(must=(ONE, JONES))) == added(one.keys() & jones.keys())
    assert ids(people, qt.All(should=(ONE, JONES))) == added(one.keys() | jones.keys())
    assert ids(people, qt.All(must=(ONE,), should=(JONES,))) == added(one.keys())
    assert ids(people, qt.All(should=(ONE, JONES), at_least=2)) == added(one.keys() & jones.keys())
    assert [i for i, _ in ids(people, qt.All(must=(ONE,), must_not=(FEMALE,)))] == [i for i, _ in ids(people, ONE) if i not in "24"]
    assert ids(people, qt.All(must=(qt.Everything(),), must_not=(FEMALE,), boost=3)) == [(i, 3) for i in "135678"]
    assert ids(people, qt.All(must_not=(FEMALE,))) == [] == ids(people, qt.All()) == ids(people, qt.Words("no_column", ("one",)))
    nested = qt.All(must=(qt.All(should=(ONE, JONES), boost=0.5),), should=(qt.All(must=(FEMALE, JONES)),))
    assert ids(people, nested)[0] == ("2", round(0.5 * (one["2"] + jones["2"]) + 1 + jones["2"], 6))


def test_trees_say_what_they_are(people):
    node = qt.All(must=(ONE, qt.All(should=(qt.Words("a", ("x",)), qt.Positioned("b", "y", 2, "prefix")), boost=2)), must_not=(FEMALE,))
    assert str(node) == "+name__fname~(one) +(a:x targetPosition(b:y*, 2))^2 -Gender__facet_text=female"
    assert {("a", "x"), ("b", "y"), ("Gender__facet_text", "female"), ("name__fname.an", "one")} <= set(qt.terms(node)) and node == qt.All(node.must, node.should, node.must_not) and hash(node)
    with pytest.raises(ValueError, match="score"):
        tree_search.tree_search(people.withColumn("Score", F.lit(1)), ONE)
    with pytest.raises(ValueError, match="score"):
        name_search.name_search(people.withColumn("score", F.lit(1)), ONE.query, "name__fname")
    assert tree_search.tree_search(people.withColumn("score", F.lit(1)), ONE, score="points").count() == 6


DOCS = [(k, " ".join(f"w{(k * j) % 7}" for j in range(1, k % 5 + 2)), ["ann", "bob", None][k % 3]) for k in range(40)]
SCHEMA = "id long, body__text string, p__fname_an string"


def grown(spark, path):
    out = Segments(spark, path, "id", ("body__text",), boosts={"body__text": 2.0})
    rows = lambda those: spark.createDataFrame(those, SCHEMA)
    out.add(rows(DOCS[:25]).repartition(3))
    out.commit()
    out.add(rows([(k, "again " + t, "carl") for k, t, _ in DOCS[10:15]] + [(100, "twice", "x"), (100, "w1 twice", "y"), (None, "w2 no key", None)]))
    out.delete(spark.createDataFrame([(3,), (11,), (999,), (None,)], "id long"))
    out.commit()
    out.add(rows(DOCS[25:]))
    out.add(rows([(3, "w1 back", "ann")]))
    out.commit()
    return out


def state(segments):
    rows = {r["id"]: r for r in segments.rows().collect()}
    return {k: (" ".join(t["token"] for t in r["body__text"]), r["body__text_norm"], r["p__fname"]) for k, r in rows.items()}


def test_segments_equal_a_rewrite(spark, tmp_path):
    out = grown(spark, str(tmp_path / "i"))
    want = {k: (t, n) for k, t, n in DOCS} | {k: ("again " + t, "carl") for k, t, _ in DOCS[10:15]} | {100: ("w1 twice", "y"), None: ("w2 no key", None), 3: ("w1 back", "ann")}
    del want[11]
    assert {k: (t, n) for k, (t, _, n) in state(out).items()} == want and out.state.docs == len(want)
    assert all(code == sim.encode_norm(2 / len(t.split()) ** 0.5) for t, code, _ in state(out).values())
    terms = ["w1", "w2", "again", "twice", "absent"]
    assert out.frequencies("body__text", terms) == (len(want), {t: sum(t in text.split() for text, _ in want.values()) for t in terms})
    plain = spark.createDataFrame([(k, t) for k, (t, _) in want.items()], "id long, text string")
    scores = lambda df: {r["id"]: round(r["score"], 9) for r in df.collect()}
    whole = scores(tfidf.tfidf(index(plain.withColumnRenamed("text", "body__text")), "body__text", ["w1", "w2"]))
    n, freqs = out.frequencies("body__text", ["w1", "w2"])
    assert scores(tfidf.tfidf(out.rows(), "body__text", ["w1", "w2"], statistics=(n, freqs), norm="body__text_norm")).keys() == whole.keys()
    rows = out.rows().drop("body__text_norm")
    assert scores(tfidf.tfidf(rows, "body__text", ["w1", "w2"], statistics=(n, freqs))) == whole
    seqs = [r["_seq"] for r in out.rows().orderBy("_seq").collect()]
    assert len(set(seqs)) == len(seqs) and max(seqs) == out.state.next - 1
    before = state(out)
    out.merge()
    assert state(Segments(spark, out.path, "id", ("body__text",))) == before  # not committed yet
    out.commit()
    again = Segments(spark, out.path, "id", ("body__text",))
    assert state(again) == before and again.frequencies("body__text", terms) == out.frequencies("body__text", terms) and len(again.state.segments) == 1


def test_readers_see_commits_only(spark, tmp_path):
    out = Segments(spark, str(tmp_path / "i"), "id", ("body__text",))
    with pytest.raises(ValueError, match="committed"):
        out.rows()
    out.add(spark.createDataFrame(DOCS[:5], SCHEMA))
    assert Segments(spark, out.path, "id").state.docs == 0
    out.commit()
    out.add(spark.createDataFrame([], SCHEMA))
    out.delete(spark.createDataFrame([(0,)], "id long"))
    assert Segments(spark, out.path, "id").rows().count() == 5
    out.commit()
    assert Segments(spark, out.path, "id").rows().count() == 4


def test_one_scorer_flat_for_names_and_classic_for_text(spark, tmp_path):
    out = grown(spark, str(tmp_path / "i"))
    docs, freqs = out.frequencies("body__text", ["w1", "w3"])
    scoring = tree_search.Scoring({"body__text": sim.CLASSIC}, docs=docs, doc_freq=lambda c, t: freqs[t], norms=norm_columns(["body__text"]))
    ann = qt.Name(qt.NameQuery("ann", is_surname=False, surname_field=False), "p__fname")
    got = {r["id"]: r["score"] for r in tree_search.tree_search(out.rows(), qt.All(should=(ann, qt.Words("body__text", ("w1", "w3")))), scoring).collect()}
    want = {}
    for k, (text, code, name) in state(out).items():
        words = text.split()
        s = sum(words.count(t) ** 0.5 * (sim.math.log(docs / (freqs[t] + 1)) + 1) ** 2 * sim.decode_norm(code) for t in ("w1", "w3"))
        s += 1.0 if name == "ann" else 0.0
        want |= {k: s} if s else {}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
    reads = lambda df: [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "ReadSchema" in line]
    assert not any("norm" in line for line in reads(tree_search.tree_search(out.rows(), ann, scoring).select("id", "score")))
    assert any("norm" in line for line in reads(tree_search.tree_search(out.rows(), qt.Words("body__text", ("w1",)), scoring).select("id", "score")))


def test_rows_are_inserted_by_key_whatever_the_order_of_files(spark, tmp_path):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    docs.where("doc_id < 20").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs.where("doc_id >= 20").coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", 1 << 30)
    try:
        live = corpus.changed_documents(spark, str(tmp_path)).rows().select("doc_id", "_seq").orderBy("_seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    ids = [i for i in range(400) if i % 5 and (i % 3 or i % 2 == 0)]
    assert [r["doc_id"] for r in live] == sorted(ids, key=lambda i: (i % 2 == 0, i))
