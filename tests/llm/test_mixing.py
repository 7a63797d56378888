import hashlib
import math
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from onomast.llm import mixing


def filled(sizes):
    """Targets by sharing the excess again and again."""
    weight = {k: 1 + n % 3 for n, k in enumerate(sizes)}
    total, free, out = sum(sizes.values()), list(sizes), {}
    while True:
        level = Fraction(total - sum(out.values()), sum(weight[k] for k in free) or 1)
        over = [k for k in free if level * weight[k] > 3 * sizes[k]]
        if not over:
            return out | {k: level * weight[k] for k in free}
        out |= {k: 3 * sizes[k] for k in over}
        free = [k for k in free if k not in over]


def seats(votes, n):
    """One block after the other to the highest quotient."""
    got = dict.fromkeys(votes, 0)
    for _ in range(n if any(votes.values()) else 0):
        best = max(votes, key=lambda k: votes[k] / (2 * got[k] + 1))  # the first of equals
        got[best] += 1
    return got


def brute(rows, block, shard_rows):
    docs = []
    for d, source, text in rows:
        h = hashlib.md5(f"{mixing.SEED}|{'' if d is None else d}|{text or ''}".encode()).hexdigest()
        docs.append((d, source, len(re.findall(r"[^\x20\x09-\x0D]+", text or "")), h))
    by = {}
    for k in sorted({s for _, s, _, _ in docs}, key=lambda s: (s is None, s or "")):
        by[k] = sorted((r for r in docs if r[1] == k), key=lambda r: r[3])
    n_cells = max(1, math.ceil(len(docs) / shard_rows))
    size = {k: sum(r[2] for r in v) for k, v in by.items()}
    target = {k: float(v) for k, v in filled(size).items()}
    block = max(1, min(block, int(min([t for t in target.values() if t > 0], default=0) // mixing.LEAST)))
    quota = seats(target, (sum(size.values()) + block // 2) // block)
    out = []
    for k, own in by.items():
        shards = defaultdict(list)
        for r in own:
            cell = int(r[3][:8], 16) % n_cells
            shards[cell % math.ceil(len(own) / shard_rows)].append((cell, r))
        z = {s: sum(r[2] for _, r in shards[s]) for s in sorted(shards)}
        for s, q in seats(z, quota[k]).items():
            stream = [j for j, (_, r) in enumerate(sorted(shards[s], key=lambda x: (x[0], x[1][3]))) for _ in range(r[2])] * 3
            taken = stream[: q * block]
            out += [(r[0], r[2], size[k], round(target[k], 6), taken.count(j)) for j, (_, r) in enumerate(sorted(shards[s], key=lambda x: (x[0], x[1][3])))]
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, source string, text string, Size int, K string, target string")


def got(spark, rows, **options):
    found = mixing.mix(frame(spark, rows), **options)
    return sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in found.collect()), key=str)


ROWS = [(d, "abcde"[d % 5 if d % 3 else 0], " ".join(["w"] * (d * 37 % 91))) for d in range(120)]
ODD = [(None, "a", "null id"), (None, None, "no source\x0b\x0cof its own\n"), (7, "a", None), (8, "z", ""), (9, "z", " \t"), (10, "é", "x " * 4000), (11, "A", "one"), (12, "", "empty name"), (1, "b", ROWS[1][2])]


@pytest.mark.parametrize(("rows", "options"), [(ROWS + ODD, {}), (ROWS + ODD, {"block": 4, "shard_rows": 7}), ([(1, "a", None), (2, None, "a b c"), (2, None, "a b c")], {})])
def test_equals_brute_force(spark, rows, options):
    found = got(spark, rows, **options)
    assert found == brute(rows, options.get("block", mixing.BLOCK), options.get("shard_rows", mixing.SHARD_ROWS))
    assert all(r[4] <= 3 * r[1] for r in found)


def test_no_rows_and_reruns(spark):
    assert got(spark, []) == []
    again = mixing.mix(frame(spark, ROWS + ODD).repartition(7)).select("doc_id", "size", "taken").collect()
    assert sorted(map(str, again)) == sorted(map(str, mixing.mix(frame(spark, ROWS + ODD)).select("doc_id", "size", "taken").collect()))


def test_sources_come_near_their_targets(spark):
    rows = [(d, "hot" if d % 3 == 0 else f"s{d % 40}", " ".join(["w"] * (20 + d % 13))) for d in range(3000)]
    source, took, size = {d: s for d, s, _ in rows}, defaultdict(int), defaultdict(int)
    for r in mixing.mix(frame(spark, rows), shard_rows=100).collect():
        took[source[r["doc_id"]]] += r["taken"]
        size[source[r["doc_id"]]] += r["size"]
    want = filled(dict(sorted(size.items())))
    assert all(took[s] == pytest.approx(float(want[s]), rel=0.02) for s in size)


def test_no_python_and_no_text_in_an_exchange(spark):
    plan = mixing.mix(frame(spark, ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan
