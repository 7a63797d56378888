import math
import random

from onomast.llm import language_id as li

WORDS = {"en": "the of and house water river stone little".split(), "de": "der und haus wasser fluss stein kleine über".split(), "fr": "le et maison eau rivière pierre petite où".split()}


def texts(n, seed):
    r = random.Random(seed)
    out = []
    for k in range(n):
        lang = r.choice(list(WORDS))
        out.append((k, " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(3, 30))), lang, "s"))
    return out


SCHEMA = "doc_id long, text string, lang string, score string"


def test_held_out_accuracy_and_undetermined(spark):
    train = spark.createDataFrame([*texts(300, 1), (900, None, "en", "s"), (901, "x", None, "s")], SCHEMA)
    model = li.train(train)
    assert model.langs == ["de", "en", "fr"]
    rows = [*texts(200, 2), (1000, None, "en", None), (1001, "", "en", None), (1002, "123 ... ² !", "en", None), (None, "der fluss", "de", None), (1003, "house " * 60_000, "en", None)]
    got = li.predict(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert len(got) == len(rows)
    good = sum(r["lang_pred"] == r["lang"] for r in got if r["doc_id"] is not None and r["doc_id"] < 900)
    assert good >= 198
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (1000, 1001, 1002))
    assert by[1003]["lang_pred"] == "en" and by[None]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got)


def test_unseen_words_back_off_to_characters(spark):
    model = li.train(spark.createDataFrame(texts(300, 3), SCHEMA))
    assert "wasserhaus" not in model.words[0]
    assert model.langs[int(model.vectors(["wasserhaus"]).argmax())] == "de"
    assert model.langs[int(model.vectors(["x", "rivièrex"])[1].argmax())] == "fr"
    assert model.vectors(["щ"]).tolist() == [[0, 0, 0]]


def test_counts_and_bounds(spark):
    rows = [(1, "a b a", "x", ""), (2, "a b, c", "x", ""), (3, "A", "y", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r[0], r[1]): r[2] for r in li.count_words(df, "text", "lang").collect()}
    assert got == {("x", "a"): 3, ("x", "b"): 2, ("x", "c"): 1, ("y", "a"): 1}
    # mean shares: a (3/6 + 1) / 2, b 1/6, c 1/12
    assert set(li.train(df, words=1).words[0]) == set()
    assert set(li.train(df, words=2).words[0]) == {"a"}
    assert set(li.train(df, words=6).words[0]) == {"a", "b"}
    assert set(li.train(df, words=12).words[0]) == {"a", "b", "c"}


def test_nothing_to_learn(spark):
    model = li.train(spark.createDataFrame([], SCHEMA))
    df = spark.createDataFrame([(1, "some text", "en", "")], SCHEMA)
    assert [(r["lang_pred"], r["score"]) for r in li.predict(df, model).collect()] == [("und", 0.0)]
    assert li.predict(df.limit(0), model).count() == 0


def test_words_of_pieces():
    for chunk in ["abc", "Abc,", "abc1", "ab²", "²", "l'eau", "a_b", "e\u0301", "", "1.", "x!!", "été.", "abc_"]:
        assert li.words_of(chunk) == [w for w in li.RUN.findall(chunk.lower()) if any(map(str.isalpha, w))]


def test_known_items_are_shares_at_any_size(spark):
    for times in (1, 1000, 10**9):
        rows = [(lang, f"{lang}{k}", (k + 1) * times) for lang in ("x", "y") for k in range(60)]
        counts = spark.createDataFrame(rows, "lang string, item string, n long")
        found, totals = li._frequent(counts, 100, li.F.lit(0))
        # two languages: a share of 2/100 of its language's words
        assert sorted(found.column("item").to_pylist()) == sorted(i for _, i, n in rows if n >= 0.02 * sum(range(1, 61)) * times)
        assert found.num_rows <= 100 and totals["x", 0] == (60, 1830 * times)


def brute(train, texts):
    """Word-first backoff from its definition, in plain Python."""
    from collections import Counter

    words, grams = {}, {}
    for _, t, lang, _ in train:
        for c in (t or "").split() if lang else ():
            for w in li.words_of(c):
                words.setdefault(lang, Counter())[w] += 1
                for o in li.ORDERS:
                    for g in li.grams_of(w, o):
                        grams.setdefault((lang, o), Counter())[g] += 1
    langs = sorted(words)

    def logs(item, tables):
        size = max(len(t) for t in tables)
        raw = [math.log((t[item] + 0.5) / (sum(t.values()) + 0.5 * size + 1)) for t in tables]
        return [max(x - max(raw), -li.CLIP) for x in raw]

    def word(w):
        if any(w in words[x] for x in langs):
            return logs(w, [words[x] for x in langs])
        for o in li.ORDERS:
            tables = [grams[x, o] for x in langs]
            known = [logs(g, tables) for g in li.grams_of(w, o) if any(g in t for t in tables)]
            if known:
                total = [sum(k[j] for k in known) * min(2, len(known)) / len(known) for j in range(len(langs))]
                return [max(x - max(total), -li.CLIP) for x in total]
        return [0.0] * len(langs)

    out = []
    for t in texts:
        found = [word(w) for c in (t or "").split() for w in li.words_of(c)]
        if not found:
            out.append(("und", 0.0))
            continue
        total = [sum(f[j] for f in found) for j in range(len(langs))]
        p = [math.exp(x - max(total)) for x in total]
        out.append((langs[p.index(max(p))], max(p) / sum(p)))
    return out


def test_equals_brute_force(spark):
    train = [*texts(60, 7), (900, "nur deutsch Über-Haus x9 ², l'eau", "de", "s"), (901, None, "fr", "s")]
    model = li.train(spark.createDataFrame(train, SCHEMA))
    rows = [*texts(40, 8), (1000, "wasserhaus pierreux fluss", None, None), (1001, "日本語のテキスト" * 50, None, None), (1002, '{"house":1,"eau":[2]}' * 40, None, None), (1003, "Q", None, None), (1004, "", None, None), (1005, "the der le", None, None)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in li.predict(spark.createDataFrame(rows, SCHEMA), model).collect()}
    for (d, *_), (lang, score) in zip(rows, brute(train, [r[1] for r in rows]), strict=True):
        assert got[d][0] == lang and abs(got[d][1] - score) < 1e-4, d


def test_result_columns_are_replaced(spark):
    model = li.train(spark.createDataFrame(texts(30, 1), SCHEMA))
    df = spark.createDataFrame([(1, "der fluss", "mine", "mine")], "doc_id long, text string, score string, lang_pred string")
    got = li.predict(df, model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"] and got.first()["lang_pred"] == "de"
