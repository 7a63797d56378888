import threading
import time

import pytest
from pyspark.sql import functions as F

from onomast.functions import analysis as an
from onomast.functions import payload, surname
from onomast.functions import similarity as sim
from onomast.operators import hedge, tfidf
from onomast.plans.name_query import NameQuery
from onomast.streaming.names import match_stream


def test_norms():
    want = {1: 1, 2: 0.625, 3: 0.5, 4: 0.5, 5: 0.4375, 6: 0.375, 7: 0.375, 8: 0.3125, 10: 0.3125, 16: 0.25, 100: 0.09375}
    assert {n: sim.length_norm(n) for n in want} == want


def test_norms_as_columns(spark):
    lengths = [*range(3000), 1 << 24, (1 << 24) + 1, 1 << 40]
    df = spark.createDataFrame([(n,) for n in lengths], "n long").select("n", sim.norm_of(F.col("n")), sim.norm_of(F.col("n"), 2.5), sim.norm_code(F.col("n")))
    for n, plain, boosted, code in df.collect():
        assert (plain, boosted, code) == (sim.length_norm(n), sim.length_norm(n, 2.5), sim.encode_norm(1 / n**0.5) if n else 0)


def test_tfidf_and_explanation(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, None), (4, "c")], "id int, text string")
    rows = tfidf.tfidf(df, "text", ["a"], explained=True).collect()
    idf = sim.math.log(4 / 2) + 1
    assert [r["id"] for r in rows] == [1]
    assert rows[0]["score"] == pytest.approx(2**0.5 * idf**2 * 0.5 / idf)
    e = rows[0]["explanation"][0]
    assert e["value"] == pytest.approx(rows[0]["score"]) and e["field_weight"]["freq"] == 2


def test_payload(spark):
    df = spark.createDataFrame([("a b a",), ("b",)], "text string").withColumn("t", an.whitespace_words(F.col("text")))
    assert [r["score"] for r in payload.payload_query(df, "t", "a", "3", "2").collect()] == [2]
    assert [r["score"] for r in payload.payload_query(df, "t", "a", 2).collect()] == [0.5]
    for bad in ({"posn": None}, {"posn": "x"}, {"posn": 1, "mult": "y"}):
        with pytest.raises(ValueError, match="posn"):
            payload.payload_query(df, "t", "a", **bad)
    assert spark.range(1).select(payload.decode_int(payload.encode_int(F.lit(70_000)))).first()[0] == 70_000


def test_folding_of_forms(spark):
    text = "Ｇｒöße ²³ Ⓐⓑ ① ₂ “q” ‹x› é ﬀ ⑩ ½"
    want = 'Grosse 23 Ab 1 2 "q" \'x\' e ﬀ ⑩ ½'
    assert an.fold_text(text) == want and spark.createDataFrame([(text,)], "t string").select(an.fold(F.col("t"))).first()[0] == want


def test_similarities(spark):
    df = spark.createDataFrame([("a b a",)], "text string").withColumn("t", an.whitespace_words(F.col("text")))
    assert tuple(df.select(payload.payload_sum(F.col("t"), "a", sim.CLASSIC), payload.payload_sum(F.col("t"), "a", sim.FLAT), payload.doc_score(payload.payload_score(F.col("t"), "x", 1))).first()) == (2.0, 4.0, 1.0)
    e = spark.range(1).select(sim.explain(F.lit(4.0), F.lit(1.0), F.lit(0.5)).alias("e")).first()["e"]
    assert e["value"] == 1.0 and e["query_weight"] is None


def test_surname_key(spark):
    rule = {"surname_col": "k", "regex": "^([A-Za-z])", "default_match": r"(\d)"}
    df = spark.createDataFrame([(None,), ("",), ("  ",), ("Smith",), ("Sm1th",)], "n string")
    assert [r["k"] for r in surname.transform_surnames(df, {"n": rule}).collect()] == ["#", "#", "#", "s", "#"]
    assert {r["k"] for r in surname.transform_surnames(df, {"n": rule | {"regex": "^[A-Z]"}}).collect()} == {"#"}
    many = spark.createDataFrame([(["Smith", None],)], "n array<string>")
    assert surname.transform_surnames(many, {"n": rule}).first()["k"] == ["s", "#"]


def fake(delays, calls, errors=None):
    def call(server):
        calls.append(server)
        time.sleep(delays.get(server, 0))
        if errors and server in errors:
            raise errors[server]
        return server

    return call


def test_backup_beats_a_straggler():
    calls = []
    h = hedge.Hedge(hedge.HedgePolicy(delay_s=0.05))
    assert h.run(["slow", "fast"], fake({"slow": 0.4}, calls)) == "fast" and calls == ["slow", "fast"]


def test_both_slow_makes_two_requests():
    calls = []
    assert hedge.Hedge(hedge.HedgePolicy(delay_s=0.02)).run(["a", "b", "c"], fake({"a": 0.2, "b": 0.2}, calls)) in "ab" and calls == ["a", "b"]


def test_zero_delay_asks_all():
    calls, gate = [], threading.Event()

    def call(server):
        calls.append(server)
        gate.wait(1) if len(calls) < 5 else gate.set()
        return server

    hedge.Hedge(hedge.HedgePolicy(delay_s=0, most_at_once=5)).run(list("abcde"), call)
    assert len(calls) == 5


def test_failures():
    calls = []
    h = hedge.Hedge(hedge.HedgePolicy(delay_s=1, alive_check_s=0.2))
    assert h.run(["bad", "good"], fake({}, calls, {"bad": hedge.ServerError(500)})) == "good"
    assert h.run(["bad", "good"], fake({}, calls)) == "good" and calls == ["bad", "good", "good"]
    time.sleep(0.25)
    assert h.run(["bad", "good"], fake({}, calls)) == "bad" and not h.dead
    with pytest.raises(ValueError, match="query"):
        h.run(["a", "b"], fake({}, calls, {"a": ValueError("query")}))
    with pytest.raises(hedge.NoLiveServers):
        h.run(["x", "y"], fake({}, calls, {"x": OSError(), "y": hedge.ServerError(503)}))
    with pytest.raises(hedge.ServerError):
        h.run(["x2", "y2"], fake({}, calls, {"x2": hedge.ServerError(400)}))


def test_least_busy_first():
    f = hedge.Inflight()
    urls = [f"http://s{k}:80/" for k in (1, 2, 3)]
    f.counts = {"s1": 2, "s2": 1}
    assert [hedge.host_of(u) for u in f.ordered(urls)] == ["s3", "s2", "s1"]
    f.counts = {"s2": 1, "s3": 2}
    assert [hedge.host_of(u) for u in hedge.replicas("s1:80|s2:80|s3:80/", hedge.HedgePolicy(), f)] == ["s1", "s2", "s3"]
    f.add("http://unknown", -1)
    assert f.counts["unknown"] == 0


def test_stream_of_names(spark, tmp_path):
    spark.createDataFrame([("1", "red widget"), ("2", "blue")], "Id string, n__fname_an string").write.parquet(str(tmp_path / "in"))
    names = spark.readStream.schema("Id string, n__fname_an string").parquet(str(tmp_path / "in"))
    query = NameQuery("red", is_surname=False, surname_field=False)
    run = match_stream(names, query, "n__fname").select("Id", "score").writeStream.format("memory").queryName("found").start()
    run.processAllAvailable()
    run.stop()
    assert [tuple(r) for r in spark.sql("select * from found").collect()] == [("1", 1.0)]
