import random

import numpy as np

from onomast.llm import components
from onomast.llm import ngram_join as nj

SCHEMA = "doc_id long, text string, n string, label string"


def words(t):
    return [w.decode() for w in (t or "").lower().encode().translate(nj.WORD_BYTES).split()]


def brute(rows, threshold=0.8, roots=False):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i + 1, n):
            a, b = sets[i], sets[j]
            if a and b and 10 * len(a & b) >= 10 * threshold * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    if roots:
        return [find(i) for i in range(n) if sets[i]]
    return [(d, least.get(find(i)) if sets[i] else d, links[i]) for i, (d, _) in enumerate(rows)]


def corpus(seed=1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(2, 6))) for _ in range(400)]
    rows = []
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice([6, 30, 80, 200]))]
        for _ in range(r.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, len(w) // 10])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((" " if r.random() < 0.5 else ", ").join(w))
    rows += [None, "", "...", "one", "One!", "two words", "two  words", "words two", "long " * 20_000, "long " * 20_001]
    r.shuffle(rows)
    return [(k, t) for k, t in enumerate(rows)] + [(3, "repeated id with some other text here"), (None, "a text without an id but a twin here"), (None, "a text without an id but a twin here"), (7000, "Repeated row of one text"), (7000, "Repeated row of one text")]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", None) for d, t in rows], SCHEMA)


def got(spark, rows, **options):
    return sorted(((r["id"], r["class_id"], r["n_links"]) for r in nj.jaccard_classes(frame(spark, rows), **options).collect()), key=str)


def test_equals_brute_force(spark):
    rows = corpus()
    assert got(spark, rows) == sorted(brute(rows), key=str)


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_ROWS", 8)
    r = random.Random(2)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3])):
            w[r.randrange(120)] = f"x{r.randrange(1000)}"
        rows.append((k, " ".join(w)))
    assert got(spark, rows) == sorted(brute(rows), key=str)


def test_one_of_each_class_stays(spark):
    rows = corpus(3)
    kept = nj.keep_one(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "n", "label"]
    ids = [r["doc_id"] for r in kept.collect()]
    wordless = sum(not words(t) for _, t in rows)
    assert len(ids) == len(set(brute(rows, roots=True))) + wordless
    assert {c for (_, c, _), (_, t) in zip(brute(rows), rows, strict=True) if words(t) and c is not None} <= set(ids)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(nj, "BROADCAST_ROWS", 0)
    rows = corpus(4)
    assert got(spark, rows) == sorted(brute(rows), key=str)


def test_empty_table(spark):
    assert got(spark, []) == [] and nj.keep_one(frame(spark, [])).count() == 0


def test_bands():
    bands, rows = nj.bands_for()
    assert bands * rows <= nj.MOST_HASHES and 1 - (1 - 0.8**rows) ** bands >= nj.RECALL


def test_signatures_estimate_similarity():
    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:900], r.integers(0, 1 << 63, 100, dtype=np.uint64)])
    x, y = nj._signatures([np.sort(a), np.sort(b)], 2000, 1)
    assert abs((x == y).mean() - 900 / 1100) < 0.04


def test_components(spark):
    r = random.Random(6)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200)] + [(r.randrange(300, 360), r.randrange(300, 360)) for _ in range(40)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert dict(map(tuple, components.connected(spark.createDataFrame(edges, "u long, v long")).collect())) == root


def test_own_columns_stay(spark):
    df = spark.createDataFrame([(1, "one two three four five six", "mine", 7, "k"), (2, "one two three four five six", "yours", 8, "k")], "doc_id long, text string, k string, h long, __k string")
    assert [tuple(r) for r in nj.keep_one(df).collect()] == [(1, "one two three four five six", "mine", 7, "k")]


def test_text_without_spaces(spark):
    rows = [(1, "漢字" * 3000), (2, "漢字" * 3000), (3, "字漢" * 3000), (4, "漢 " * 3000)]
    assert got(spark, rows) == sorted(brute(rows), key=str)


def test_large_groups_of_many_sizes(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_ROWS", 6)
    monkeypatch.setattr(nj, "BLOCK_SHINGLES", 600)
    r = random.Random(12)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(90):
        w = base[: r.choice([100, 110, 130, 160, 200, 240, 300])]
        for _ in range(r.choice([0, 0, 1, 2])):
            w = w[:]
            w[r.randrange(len(w))] = f"x{r.randrange(1000)}"
        rows.append((k, " ".join(w)))
    assert got(spark, rows) == sorted(brute(rows), key=str)
