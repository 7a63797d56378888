import random
import re

from pyspark.sql import functions as F

from onomast.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def checked(digits):
    total = 0
    for k, c in enumerate(digits[::-1]):
        n = int(c) * (1 + k % 2)
        total += n // 10 + n % 10
    return total % 10 == 0


def brute(t):
    t = t or ""
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, rule, low, high in ((2, CARD, 13, 19), (3, PHONE, 9, 15)):
        for m in rule.finditer(t):
            d = re.sub("[^0-9]", "", m[0])
            if low <= len(d) <= high and (kind == 3 or checked(d)):
                out.append((kind, m.start(), m.end()))
    return out


def texts():
    r = random.Random(8)
    parts = ["a", "@", ".", "b-c", "x.com", "1", "23", "255", "256", "0001", " ", "-", "+1", "(017)", " 555-7713", "4111 1111 1111 1111", "378282246310005", "5500-0000-0000-0004", "é", "\n", "192.168.0.1", "_%", "+49 30 1234567", "x@y.zz", ")("]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(4000)] + [None, "", "a" * 50_000, "1" * 50_000, "+" * 2000 + "1" * 300, "@" * 5000, "a@" * 3000, "1." * 9000, "1 " * 9000]


def test_base_equals_brute_force():
    for t in texts():
        assert pii.base_spans(t or "") == brute(t), t


def words_of(t):
    return [(m.start(), m[0]) for m in re.finditer(r"[^\s:=]+[:=]*|[:=]+", t or "")]


def plain(w):
    w = w.lower()
    return "" if re.search("[0-9]", w) else w.strip(pii.EDGES) or w


def brute_context(texts):
    """All spans, by the definition in plain Python."""
    uses, totals = [], {}
    for d, t in enumerate(texts):
        t = t or ""
        found = words_of(t)
        flat = [plain(w) for _, w in found]
        before = lambda k, flat=flat: [x for x in ((flat[k - 1] if k else ""), (f"{flat[k - 2]} {flat[k - 1]}" if k > 1 and flat[k - 2] and flat[k - 1] else "")) if x and flat[k - 1]]
        for k in range(1, len(found)):
            for p in before(k):
                totals[p] = totals.get(p, 0) + 1
        base = brute(t)
        covered = {x for _, a, z in base for x in range(a, z)}
        every = [(m.start(), m.end()) for rule in (IP, PHONE) for m in rule.finditer(t)] + [(m.start(), m.end()) for m in CARD.finditer(t) if len(re.sub("[^0-9]", "", m[0])) >= 13]
        refused = {x for a, z in every if not any((a, z) == s[1:] for s in base) for x in range(a, z)}
        for _, a, z in base:
            k = max(i for i, (s, _) in enumerate(found) if s <= a)
            uses.append((d, a, z, t[a:z].lower(), 2, before(k)))
        for k, (s, w) in enumerate(found):
            if len(re.findall("[0-9]", w)) >= 5:
                a, z = s + len(w) - len(w.lstrip(pii.EDGES)), s + len(w.rstrip(pii.EDGES))
                if not covered & set(range(a, z)):
                    uses.append((d, a, z, t[a:z].lower(), 1 if refused & set(range(a, z)) else 0, before(k)))
    score = {i: 1.0 for *_, i, k, _ in uses if k == 2}
    while True:
        good, support = {}, {}
        for *_, i, k, ps in uses:
            if k != 1 and i in score:
                for p in ps:
                    good[p] = good.get(p, 0) + score[i]
                    support.setdefault(p, set()).add(i)
        accepted = {p: good[p] / (totals[p] + pii.PRIOR) for p in good if good[p] / (totals[p] + pii.PRIOR) >= pii.MIN_SCORE and len(support[p]) >= pii.MIN_SEEDS}
        grown = dict(score)
        for *_, i, k, ps in uses:
            for p in ps:
                if k == 0 and p in accepted:
                    grown[i] = max(grown.get(i, 0), accepted[p])
        if grown == score:
            break
        score = grown
    out = []
    for d, t in enumerate(texts):
        spans = [f"{pii.KINDS[k]}:{a}:{z}" for k, a, z in brute(t)]
        spans += [f"context:{a}:{z}" for e, a, z, i, k, _ in sorted(uses) if e == d and k == 0 and i in score]
        out.append(",".join(spans))
    return out, accepted


def context_texts():
    r = random.Random(3)
    words = [f"w{'abcdefghij'[k % 10]}{'klmnop'[k // 10]}" for k in range(60)]
    fill = lambda n: " ".join(r.choice(words) for _ in range(n))
    card = lambda good: next(str(x) for x in iter(lambda: r.randrange(10**15, 10**16), 0) if checked(str(x)) == good)
    texts = []
    for k in range(14):
        texts.append(f"{fill(6)} kunden nr 192.168.7.{k} {fill(4)} kunden nr 10.0.{k}.1, kunden nr: 10.1.{k}.2")
        texts.append(f"{fill(5)} card: {card(True)} the end")
        texts.append(f"the {fill(3)} the {card(False)} {fill(3)} the {card(True)}")
    # unseen identifiers beside good patterns, then beside patterns that only these make good
    texts += [f"{fill(3)} kunden nr AB-{55500 + k}X {fill(3)}" for k in range(5)]
    texts += [f"{fill(2)} akte ab-{55500 + k}x {fill(2)}" for k in range(5) for _ in range(6)] + [f"{fill(2)} akte QQ{77000 + k}, {fill(2)}" for k in range(3)]
    texts += [f"card: {card(False)} x", "ref " + "z" * 40 + "12345" + "9" * 70, "kunden nr " + "z" * 40 + "1a2b3c4d5e" * 10, "kunden" + " " * 300 + "nr" + " " * 200 + "12345678", "the 1234567 the 7654321", None, "", "漢字12345" * 300, "12345678"]
    return texts


def test_all_spans_equal_brute_force(spark):
    texts = context_texts()
    want, accepted = brute_context(texts)
    assert {"nr", "kunden nr", "card", "akte"} <= set(accepted) and "the" not in accepted
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(3)
    got = {r[0]: (r[1], r[2]) for r in pii.find_pii(df).select("doc_id", "spans", "n_context").collect()}
    for k, t in enumerate(texts):
        assert got[k] == (want[k], want[k].count("context:")), t
    # found: beside seeds' words, then beside words that only unseen identifiers have; not: decoys
    at = {t: k for k, t in enumerate(texts)}
    assert all(got[k][1] == 1 for t, k in at.items() if t and ("AB-" in t or "akte" in t)) and sum("QQ" in (t or "") for t in texts) == 3
    assert [got[len(texts) - k][1] for k in range(9, 0, -1)] == [0, 0, 1, 1, 0, 0, 0, 0, 1]


def test_null_ids_and_repeated_rows(spark):
    rows = [(k, f"bitte seine kunden nr 192.168.0.{k} merken", "s") for k in range(9)]
    rows += [(20, "text seine kunden nr X-77788812 ende", "s"), (21, "ohne bezug 99988877 da", "s"), (22, None, None), (None, "", None), (20, "text seine kunden nr X-77788812 ende", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.find_pii(df).select("doc_id", "n_ip", "spans", "n_context").collect()
    by = {(r[0], r[2]) for r in got}
    assert len(got) == len(rows)
    assert sum(r == (20, 0, "context:21:31", 1) for r in map(tuple, got)) == 2
    assert (21, "") in by and (22, "") in by and (None, "") in by
    assert all((k, f"ip:22:{22 + len(f'192.168.0.{k}')}") in by for k in range(9))


def test_counts_of_patterns_are_exact(spark, monkeypatch):
    texts = context_texts()
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    listed = spark.createDataFrame([(p,) for p in ("the", "kunden nr", "nr", "akte", "not there", "kunden")], "pattern string")
    got = dict(map(tuple, pii.count_patterns(df, listed).collect()))
    assert "not there" not in got and got["kunden nr"] == got["nr"] == 49 and got["akte"] == 33
    # a bitmap so small that everything passes gives the same
    monkeypatch.setattr(pii, "FILTER_BITS", 32768)
    assert dict(map(tuple, pii.count_patterns(df, listed).collect())) == got


def test_empty_table(spark):
    got = pii.find_pii(spark.createDataFrame([], "doc_id long, text string"))
    assert got.count() == 0 and got.select(F.sum("n_context")).first()[0] is None
