"""Words by the public word-break rules."""

import random

import pytest
from pyspark.sql import functions as F

from onomast.functions.standard import NOT_PLAIN, _plain_words, standard_words, words_of

CASES = {
    "The quick (\"brown\") fox can't jump 32.3 feet, right?": "the quick brown fox can't jump 32.3 feet right", "": "", "  ": "", "a.b a..b a. .b": "a.b a b a b", "A:B A::B a:1": "a:b a b a 1",
    "1,000.50 1,,2 1.a a.1 3a a3b4": "1,000.50 1 2 1 a a 1 3a a3b4", "snake_case __x_1__ _ ___": "snake_case __x_1__", "o'neil o’neil 'quoted' rock'n'roll ''": "o'neil o’neil quoted rock'n'roll",
    "user@host.example.org http://a.b/c?d=e": "user host.example.org http a.b c d e", "日本語 テキスト ひらがな ﾃｷｽﾄ": "日 本 語 テキスト ひ ら が な ﾃｷｽﾄ", "カタカナabc カ1 カ_a": "カタカナ abc カ 1 カ_a", "한국어 단어": "한국어 단어",
    "ภาษาไทย ไทยabc": "ภาษาไทย ไทย abc", "éa ño a­b x​y": "éa ño a­b x y", "á.b ́ ́c": "á.b c", "1;2 1:2 a;b a,b": "1;2 1 2 a b a b", "𝒜bc 😀 x": "𝒜bc x", "ÄÖ ΣΑΣ": None,
    "漢́字a": "漢́ 字 a", "3.2.1 v1.2.3 1.2a": "3.2.1 v1.2.3 1.2a", "dّ:b": "dّ:b",
}


@pytest.mark.parametrize("text", CASES)
def test_word_breaks(text):
    if CASES[text] is not None:
        assert words_of(text) == CASES[text].split()


def test_columns_and_strings_agree(spark):
    long = ["x" * 255, "y" * 256 + " z", "a" * 100_000 + " b", "1." * 20_000 + "1 c", "日" * 3000, "a." * 30_000]
    texts = [*CASES, *long, "z " + "_" * 5000, None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", standard_words(F.col("t")).alias("w")).collect()
    for k, found in rows:
        assert (found and [w["token"] for w in found]) == (texts[k] and words_of(texts[k])) or not found and not words_of(texts[k] or ""), texts[k][:50]
    placed = {texts[k]: found for k, found in rows}
    assert [tuple(w) for w in placed["y" * 256 + " z"]] == [("z", 1)]
    assert [w["token"] for w in placed["3.2.1 v1.2.3 1.2a"]] == ["3.2.1", "v1.2.3", "1.2a"]


def test_plain_texts_are_split_in_one_step(spark):
    """Every text of ASCII and common Latin letters is told as plain, no other is, and both ways give the same words."""
    r = random.Random(4)
    texts = ["".join(r.choices("aZéÜßŸſĲ09__.':,; \n-@\x00\x1f\x7f", k=r.randint(0, 40))) for _ in range(3000)]
    texts += ["x" * 256 + " y", " " * 100_000 + "a", "a.b" * 20_000, "_" * 5000 + " q"]
    other = [f"a{c}b" for c in "×÷İ\xaa\xad\xb7’日ΣƁ\u0301"]
    rows = spark.createDataFrame([(t,) for t in texts + other], "t string")
    found = rows.select("t", F.col("t").rlike(NOT_PLAIN).alias("other"), _plain_words(F.col("t")).alias("p"), standard_words(F.col("t")).alias("w")).collect()
    for t, not_plain, p, w in found:
        assert not_plain == (t in other)
        assert [x["token"] for x in w] == words_of(t), t[:60]
        assert not_plain or [x for x in p if len(x) <= 255] == words_of(t), t[:60]
