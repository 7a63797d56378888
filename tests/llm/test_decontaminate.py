import random
import re

from onomast.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, n_words string, dc_items string"
ITEMS = "item_id string, text string"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(docs, items, window=13):
    wins = []
    for i, t in items:
        w = WORD.findall(low(t))
        n = min(window, len(w))
        wins += [(i, tuple(w[k : k + n])) for k in range(len(w) - n + 1)] if w else []
    out = {}
    for d, t in docs:
        w = WORD.findall(low(t))
        hit, names = set(), set()
        for i, x in wins:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    names.add(i)
        out[d] = (len(w), len(hit), sorted(n for n in names if n is not None), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def found(spark, docs, items, **options):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], DOCS)
    bench = spark.createDataFrame(items, ITEMS)
    rows = dc.find_contamination(df, bench, **options).select("doc_id", "dc_words", dc.n_hit().alias("h"), "dc_items", dc.contaminated().alias("c"), "dc_longest").collect()
    return {r[0]: (r[1], r[2], r[3], r[4]) for r in rows}, rows


def cases(seed=3):
    r = random.Random(seed)
    words = ["a", "b", "é", "ab", "1"]
    items = [(str(k), " ".join(r.choice(words) for _ in range(r.choice([1, 3, 5, 14, 20, 40])))) for k in range(12)]
    items = [(i, t) for i, t in items if len(t.split()) > 1] + [("none", None), ("", " .,"), (None, "q r s"), ("dup", items[-1][1])]
    docs = [(k, " ".join(r.choice([*words, "z"]) for _ in range(r.randint(0, 60)))) for k in range(40)]
    docs += [(100 + k, f"Z,{t} zz {t.upper() if t else ''}!" * r.randint(1, 3)) for k, (_, t) in enumerate(items)]
    docs += [(200, None), (201, ""), (202, "... "), (203, "word " * 30_000 + (items[0][1] or ""))]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = cases()
    got, _ = found(spark, docs, items)
    want = brute(docs[:-1], items)
    assert {k: got[k] for k in want} == want


def test_blocks_give_the_same(spark):
    docs, items = cases(5)
    assert found(spark, docs, items, block_bytes=100)[0] == found(spark, docs, items)[0]


def test_longest_match_is_located(spark):
    text = " ".join(f"w{k}" for k in range(30))
    _, rows = found(spark, [(1, "x y " + " ".join(text.split()[4:22]) + " z")], [("i", text)])
    assert rows[0]["dc_longest"].asDict() == {"n_words": 18, "doc_word": 2, "item_id": "i", "item_word": 4}


def test_removes_and_keeps_columns(spark):
    text = " ".join(f"w{k}" for k in range(13))
    df = spark.createDataFrame([(1, text, "p", "q"), (2, "clean words", "r", "s"), (2, "clean words", "r", "s"), (3, None, None, None)], DOCS)
    kept = dc.decontaminate(df, spark.createDataFrame([("i", text)], ITEMS))
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == [(2, "clean words", "r", "s")] * 2 + [(3, None, None, None)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    bench = spark.createDataFrame([], ITEMS)
    assert dc.find_contamination(empty, bench).count() == 0
    assert found(spark, [(1, "a b")], [("i", None)])[0] == {1: (2, 0, [], False)}




def test_many_equal_short_items(spark):
    items = [(str(k), "the") for k in range(300)] + [("x", "the cat"), ("y", "sat on the cat mat now")]
    docs = [(k, "the cat sat on the cat mat now here " * 40) for k in range(30)] + [(99, "nothing")]
    got, rows = found(spark, docs, items)
    assert got == brute(docs, items)
    assert rows[0]["dc_longest"].asDict() == {"n_words": 6, "doc_word": 2, "item_id": "y", "item_word": 0}


def test_memory_of_equal_short_items():
    import tracemalloc

    text = (b"the cat sat on a mat " * 50_000)[: 1 << 20]

    def peak(n):
        bench = dc.Benchmark.of([(str(k), "the") for k in range(n)])
        tracemalloc.start()
        dc.match([text], bench)
        try:
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    assert peak(2000) < 1.2 * peak(1)


def brute_longest(docs, items):
    out = {}
    for d, t in docs:
        w, best = WORD.findall(low(t)), None
        for i, x in items:
            v = WORD.findall(low(x))
            for p in range(len(w)):
                for q in range(len(v)):
                    n = 0
                    while p + n < len(w) and q + n < len(v) and w[p + n] == v[q + n]:
                        n += 1
                    if n:
                        rank = (-n, p, i is not None, i or "", q)
                        best = min(best, rank) if best else rank
        out[d] = best
    return out


def test_longest_match_equals_brute_force(spark):
    docs, items = cases(7)
    docs, items = docs[:-1], [(i, t) for i, t in items if i != "dup"]
    for options in ({}, {"block_bytes": 150}):
        counts, rows = found(spark, docs, items, **options)
        want = brute_longest(docs, items)
        for r in rows:
            b = r["dc_longest"]
            if options:  # a block's own longest match may start where no window of the block hits
                assert (b is None) == (counts[r[0]][1] == 0) and (b is None or b["n_words"] <= -want[r[0]][0])
            else:
                assert (b is None) == (counts[r[0]][1] == 0)
                assert b is None or (-b["n_words"], b["doc_word"], b["item_id"] is not None, b["item_id"] or "", b["item_word"]) >= want[r[0]]
                assert b is None or b["n_words"] == -want[r[0]][0] or b["n_words"] < 13


def test_text_without_spaces(spark):
    long = "漢字" * 30_000
    docs = [(1, long), (2, '{"a":"b"}' * 5000), (3, f"x {long} y"), (4, "b")]
    items = [("i", long), ("j", "a b")]
    assert found(spark, docs, items)[0] == {k: v for k, v in brute(docs, items).items()}
