"""Edit distances against a plain computation, with letters left out between exchanged ones."""

import random

from pyspark.sql import functions as F

from onomast.functions.edits import edits_between
from onomast.operators.name_search import edits


def distance(a: str, b: str) -> int:
    """Unrestricted: exchanged neighbours may have letters between them."""
    last, far = {}, len(a) + len(b)
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    for i in range(1, len(a) + 1):
        at = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), at
            if a[i - 1] == b[j - 1]:
                at = j
            d[i, j] = min(d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def test_edits_are_the_same_in_both_directions(spark):
    rng = random.Random(7)
    pairs = [("chauauie", "chauaueni"), ("eniegeie", "eniegeeni")]
    for _ in range(400):
        a = list("ab" + "".join(rng.choice("abcd") for _ in range(8)))
        b = a.copy()
        for _ in range(2):
            i = rng.randrange(2, len(b) - 1)
            kind = rng.randrange(4)
            if kind == 0:
                del b[i]
            elif kind == 1:
                b.insert(i, rng.choice("abcd"))
            elif kind == 2:
                b[i] = rng.choice("abcd")
            else:
                b[i], b[i + 1] = b[i + 1], b[i]
        pairs.append(("".join(a), "".join(b)))
    pairs += [(b, a) for a, b in pairs]
    df = spark.createDataFrame(pairs, "a string, b string")
    for most in (1, 2):
        got = {(r["a"], r["b"]): r["d"] for r in df.select("a", "b", edits_between(F.col("a"), F.col("b"), F.lit(most)).alias("d")).collect()}
        assert got == {(a, b): d if (d := distance(a, b)) <= most else None for a, b in pairs}
    for word in ("chauaueni", "chauauie", *(b for _, b in pairs[2:12])):
        got = {(r["a"]): r["d"] for r in df.select("a", edits(F.col("a"), word, 2).alias("d")).collect()}
        assert got == {a: d if (d := distance(a, word)) <= 2 and a[:2] == word[:2] else None for a, _ in pairs}
