import hashlib
import re

from onomast.llm import exact_dedup as ed

SCHEMA = "doc_id long, text string, n long, k string"


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((d, t))
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        first = True
        for d, t in sorted(members, key=str):
            kept = first and d == best[0] and len(t or "") == len(best[1] or "")
            first = first and not kept
            out.append((d, best[0], len(members), kept, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [
    (1, "a b"), (2, "ab"), (3, "a  b"), (4, "ab "), (5, None), (6, ""), (7, " \t\r\n\x0b\x0c"), (8, "ab\xa0"), (9, "x" * 5000 + "1"), (10, "x" * 5000 + "2"),
    (11, "x" * 5000 + " 2"), (12, "😀é"), (13, "é😀"), (14, "😀 é"), (15, "only one"), (None, "null id"), (None, "nullid"), (17, "nullid"),
]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None, "z") for d, t in rows], SCHEMA)


def test_equals_brute_force(spark):
    got = sorted(map(tuple, ed.annotate(frame(spark, ROWS)).collect()), key=str)
    assert got == brute(ROWS)


def test_repeated_rows_keep_one(spark):
    rows = [*ROWS, (3, "a  b"), (3, "a  b"), (15, "only one"), (20, "t"), (20, "u")]
    assert sorted(map(tuple, ed.annotate(frame(spark, rows)).collect()), key=str) == brute(rows)
    kept = [(r["doc_id"], r["text"]) for r in ed.keep_first(frame(spark, rows)).collect()]
    want = [(d, k) for d, _, _, k, _ in brute(rows) if k]
    assert sorted(str(d) for d, _ in kept) == sorted(str(d) for d, _ in want)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ed, "BROADCAST_ROWS", 0)
    test_equals_brute_force(spark)
    test_repeated_rows_keep_one(spark)


def test_hot_group_and_empty(spark):
    rows = [(k, "same  text" if k % 3 else f"own {k}") for k in range(3000)]
    assert sorted(map(tuple, ed.annotate(frame(spark, rows)).collect()), key=str) == brute(rows)
    empty = frame(spark, [])
    assert ed.annotate(empty).count() == 0 and ed.keep_first(empty).columns == empty.columns


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("b", "x y", {"k": 1}), ("a", "xy ", {"k": 2}), (None, "x  y", None), ("c", "z", None), ("c", "z", None)], "doc_id string, text string, m map<string,int>")
    got = sorted(tuple(r)[:4] for r in ed.annotate(df).where("doc_id is not null").collect())
    assert got == [("a", None, 3, False), ("b", None, 3, False), ("c", "c", 2, False), ("c", "c", 2, True)]
    assert sorted(str(r["doc_id"]) for r in ed.keep_first(df).collect()) == ["None", "c"]


def test_own_columns_stay(spark):
    df = spark.createDataFrame([(1, "a", "p", "q"), (2, "a ", "r", "s"), (3, "b", "t", "u")], "doc_id long, text string, keep_id string, row string")
    assert sorted(map(tuple, ed.keep_first(df).collect())) == [(2, "a ", "r", "s"), (3, "b", "t", "u")]
