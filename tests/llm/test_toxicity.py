import random

import numpy as np

from onomast.llm import toxicity as tx

SCHEMA = "doc_id long, text string, score string"
BAD = ["grobax", "grobelu", "grobin", "vilest"]


def make(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abdeilmnost") for _ in range(r.randint(2, 7))) for _ in range(150)]
    docs = []
    for k in range(n):
        toxic = int(r.random() < 0.25)
        lines = [[r.choice(words) for _ in range(r.randint(3, 9))] for _ in range(r.randint(1, 6))]
        if toxic:
            lines[r.randrange(len(lines))].insert(1, r.choice(BAD))
        docs.append((k, ". ".join(" ".join(x) for x in lines) + ".\nend", toxic))
    return docs


def frames(spark, docs):
    return spark.createDataFrame([(d, t, "x") for d, t, _ in docs], SCHEMA), spark.createDataFrame([(d, y) for d, _, y in docs], "doc_id long, toxic int")


def test_held_out_accuracy_and_place(spark):
    docs = make(900, 1)
    df, labels = frames(spark, docs)
    model = tx.train(df, labels.where("doc_id < 600").union(spark.createDataFrame([(5000, 1), (3, None), (None, 1)], "doc_id long, toxic int")))
    text = {d: t for d, t, _ in docs}
    got = {r["doc_id"]: r for r in tx.predict(df, model).collect()}
    right = sum(got[d]["predicted"] == y for d, _, y in docs if d >= 600)
    assert right >= 285
    for d, t, y in docs:
        if y and got[d]["predicted"]:
            spans = [text[d][s["start"] : s["end"]] for s in got[d]["offending"]]
            assert any(b in x for x in spans for b in BAD)
            assert all("\n" not in x.strip("\n") for x in spans)
    assert any(not got[d]["offending"] for d in got)


def test_nulls_and_lengths(spark):
    df, labels = frames(spark, make(200, 2))
    model = tx.train(df, labels)
    odd = spark.createDataFrame([(1, None, None), (2, "", "s"), (3, "word " * 60_000 + "grobax", "s"), (3, "x", "s"), (3, "x", "s"), (None, "...", None)], SCHEMA)
    got = tx.predict(odd, model).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= tx.THRESHOLD) for r in got)
    assert len({r["score"] for r in got if r["text"] in (None, "", "...")}) == 1
    assert tx.predict(odd.limit(0), model).count() == 0


def test_nothing_to_learn(spark):
    df, labels = frames(spark, make(20, 3))
    model = tx.train(df, labels.where("toxic = 0"))
    assert {r["score"] for r in tx.predict(df, model).collect()} == {0.0}
    tx.train(df, labels.limit(0))


def sample_sizes(spark, monkeypatch, **options):
    """Rows and text bytes that training takes."""
    taken, plain = [], tx._collected

    def collected(rows):
        taken.append((rows.count(), rows.agg(tx.F.sum(tx.F.octet_length("text"))).first()[0]))
        return plain(rows)

    monkeypatch.setattr(tx, "_collected", collected)
    df, labels = frames(spark, make(400, 4))
    tx.train(df, labels, **options)
    return taken[0]


def test_sample_is_bounded(spark, monkeypatch):
    rows, size = sample_sizes(spark, monkeypatch)
    assert rows == 400
    assert 60 <= sample_sizes(spark, monkeypatch, sample=100)[0] <= 140
    assert sample_sizes(spark, monkeypatch, sample_bytes=size // 5)[1] <= size // 3


def test_noisy_or_equals_brute_force(spark):
    model = tx.Model(np.random.default_rng(1).normal(0, 0.3, 1 << tx.BITS).astype(np.float32), -2.0)
    docs = make(40, 5)
    df, _ = frames(spark, docs)
    got = {r["doc_id"]: r["score"] for r in tx.predict(df, model).collect()}
    for d, t, _ in docs:
        keep = 1.0
        for s in tx.sentences(t):
            z = model.bias + sum(float(model.weights[f]) for w in s for f in tx.features(w))
            keep *= 1 - 1 / (1 + np.exp(-z))
        assert abs(got[d] - (1 - keep)) < 1e-3


def test_repeated_rows_and_labels_stay_bounded(spark):
    df, labels = frames(spark, make(200, 6))
    once = tx.train(df, labels)
    many = tx.train(df.union(df.where("doc_id = 3")).union(df), labels.union(labels).union(labels.where("doc_id < 9")))
    assert np.array_equal(once.weights, many.weights) and once.bias == many.bias
    hot = spark.createDataFrame([(7, "one text", "x")] * 5000 + [(8, "other text", "x")], SCHEMA)
    assert len(tx._collected(hot.select(tx.F.xxhash64("doc_id", "text").alias("h"), "text", tx.F.lit(1).alias("y")).dropDuplicates(["h", "y"])).labels) == 2


def test_text_without_spaces_and_clashing_columns(spark):
    model = tx.train(*frames(spark, make(200, 7)))
    odd = spark.createDataFrame([(1, "漢字" * 20_000, "mine", 5), (2, '{"a":1},' * 6000, "mine", 6), (3, None, "mine", 7)], "doc_id long, text string, score string, offending int")
    got = tx.predict(odd, model)
    assert got.columns == ["doc_id", "text", "score", "predicted", "offending"] and all(0 <= r["score"] <= 1 for r in got.collect())


def test_offending_sentences_equal_brute_force(spark):
    model = tx.Model(np.random.default_rng(2).normal(0, 0.4, 1 << tx.BITS).astype(np.float32), -1.5)
    df, _ = frames(spark, make(60, 8))

    def chance(words):
        return 1 / (1 + np.exp(-(model.bias + sum(float(model.weights[f]) for w in words for f in tx.features(w)))))

    listed = 0
    for r in tx.predict(df, model).collect():
        if not r["predicted"]:
            assert r["offending"] == []
            continue
        found = [(s["score"], tx.sentences(r["text"][s["start"] : s["end"]])) for s in r["offending"]]
        assert all(len(own) == 1 and abs(chance(own[0]) - score) < 1e-3 for score, own in found)
        whole = sorted(tx.sentences(r["text"]), key=chance, reverse=True)
        hot = [w for w in whole if chance(w) >= tx.THRESHOLD] or whole[:1]
        assert sorted(own[0] for _, own in found) == sorted(hot)
        listed += len(found)
    assert listed > 20
