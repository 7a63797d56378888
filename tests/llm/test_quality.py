import random

import numpy as np
import pytest

from onomast.llm import quality as ql

SCHEMA = "doc_id long, text string, score string"


def corpus(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abdeilmnost") for _ in range(r.randint(2, 7))) for _ in range(300)]
    rows = []
    for k in range(n):
        w = [r.choice(words) for _ in range(r.randint(35, 90))]
        bad = r.random() < 0.25
        if not bad:
            text = " ".join(x + ("." if i % 9 == 8 else "") for i, x in enumerate(w))
        else:
            text = r.choice([" | ".join(w), "### ".join(w) + "###", "!! ".join(x.upper() for x in w) + "!!", " ".join(w[:2] * 30)])
        rows.append((k, text, bad))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x") for d, t, *_ in rows], SCHEMA)


def test_held_out_accuracy_without_labels(spark):
    labels, model = ql.train(frame(spark, corpus(600, 1)))
    assert 0.65 < labels.share < 0.85
    rows = corpus(300, 2)
    got = {r["doc_id"]: r for r in ql.predict(frame(spark, rows), labels, model).collect()}
    assert sum(got[d]["keep"] != bad for d, _, bad in rows) >= 290
    assert all(got[d]["keep"] for d, _, bad in rows if not bad)


def test_estimates_known_accuracies():
    r = np.random.default_rng(1)
    truth = r.random(20_000) < 0.75
    accuracy = np.linspace(0.7, 0.98, len(ql.LABELLERS))
    counts: dict[int, int] = {}
    for y in truth:
        v = [2 if r.random() < 0.2 else int(y if r.random() < a else not y) for a in accuracy]
        counts[ql.pattern(v)] = counts.get(ql.pattern(v), 0) + 1
    found = ql.estimate(counts)
    assert abs(found.share - 0.75) < 0.02
    assert np.abs(np.array(list(found.accuracy().values())) - accuracy).max() < 0.03


def test_patterns():
    for v in ([0, 1, 2] * 3, [2] * 9, [0] * 9):
        assert ql.unpacked(ql.pattern(v)) == v
    assert len(ql.votes(ql.measures(""))) == len(ql.LABELLERS)


def test_nulls_and_lengths(spark):
    labels, model = ql.train(frame(spark, corpus(200, 3)))
    odd = spark.createDataFrame([(1, None, None), (2, "", "s"), (3, "word " * 60_000, "s"), (3, "x", "s"), (3, "x", "s"), (None, "| | |", None)], SCHEMA)
    got = ql.predict(odd, labels, model).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 and r["keep"] == (r["score"] >= 0.5) for r in got)
    assert len({(r["weak_label"], r["score"]) for r in got if not r["text"]}) == 1


def test_empty_table(spark):
    empty = frame(spark, [])
    labels, model = ql.train(empty)
    assert not model.weights.any() and ql.predict(empty, labels, model).count() == 0
    assert labels.posterior([ql.pattern([0] * 9), ql.pattern([1] * 9)]) == pytest.approx([0, 1], abs=0.02)


def test_sample_is_bounded(spark):
    small, large = (ql.train(frame(spark, corpus(400, 4)), sample=n)[1] for n in (60, 1000))
    assert 0 < np.count_nonzero(small.weights) < np.count_nonzero(large.weights)


def test_repeated_rows_stay_bounded(spark):
    rows = corpus(200, 5)
    _, once = ql.train(frame(spark, rows))
    labels, many = ql.train(frame(spark, rows).union(frame(spark, rows[:1] * 3000)), sample=4000)
    # the row that stands 3,001 times is learned from once, though it counts as often among the votes
    assert np.count_nonzero(many.weights) == np.count_nonzero(once.weights)


def test_scores_equal_brute_force(spark):
    """Posteriors and scores by their definitions, a document at a time."""
    import math

    rows = corpus(120, 6) + [(900, "漢字" * 9000, False), (901, '{"a":1},' * 4000, False), (902, "", False)]
    labels, model = ql.train(frame(spark, rows))
    got = {r["doc_id"]: r for r in ql.predict(frame(spark, rows), labels, model).collect()}
    for d, t, _ in rows:
        m = ql.measures(t)
        good, poor = labels.share, 1 - labels.share
        for table, v in zip(labels.tables, ql.votes(m), strict=True):
            if v < 2:
                good *= table[1][v] / (table[1][0] + table[1][1])
                poor *= table[0][v] / (table[0][0] + table[0][1])
        assert got[d]["weak_label"] == pytest.approx(good / (good + poor), abs=1e-6)
        pieces = t.split()
        z = model.bias + sum(float(model.weights[f]) for f in ql.text_features(m))
        z += sum(float(model.weights[f]) for p in pieces for f in ql.piece_features(p)) * ql.SCALE / max(1, len(pieces))
        assert got[d]["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


def brute_estimate(votes, start, rounds):
    """Expectation-maximisation over single documents, in plain Python."""
    share, tables = start.share, start.tables.tolist()
    for _ in range(rounds):
        posts = []
        for v in votes:
            good, poor = share, 1 - share
            for t, x in zip(tables, v, strict=True):
                if x < 2:
                    good *= t[1][x] / (t[1][0] + t[1][1])
                    poor *= t[0][x] / (t[0][0] + t[0][1])
            posts.append(good / (good + poor))
        share = min(0.99, max(0.01, sum(posts) / len(posts)))
        new = []
        for k in range(len(tables)):
            both = []
            for c in (0, 1):
                n = [10 * float(start.tables[k][c][x]) + sum(p if c else 1 - p for p, v in zip(posts, votes, strict=True) if v[k] == x) for x in range(3)]
                both.append([x / sum(n) for x in n])
            new.append(both)
        tables = new
    return share, tables


def test_estimates_equal_brute_force():
    r = np.random.default_rng(2)
    votes = [[int(r.integers(0, 3)) for _ in ql.LABELLERS] for _ in range(80)] + [[1] * len(ql.LABELLERS)] * 60
    counts: dict[int, int] = {}
    for v in votes:
        counts[ql.pattern(v)] = counts.get(ql.pattern(v), 0) + 1
    found = ql.estimate(counts, rounds=8)
    share, tables = brute_estimate(votes, ql.estimate({}), 8)
    assert found.share == pytest.approx(share, abs=1e-9) and np.abs(found.tables - np.array(tables)).max() < 1e-9
