"""The corpus pipeline against a brute-force version of its stages."""

import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from onomast.llm import language_id
from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_exact_dedup import brute as copies
from tests.llm.test_ngram_join import brute as classes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefgé") for _ in range(r.randint(2, 7))) for _ in range(500)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(30))) for k in range(4)]
    texts = []
    for _ in range(60):
        w = [r.choice(vocabulary) for _ in range(r.randint(8, 120))]
        texts.append(" ".join(w))
        for _ in range(r.choice([0, 0, 1, 3])):
            v = list(w)
            if r.random() < 0.5:
                v[r.randrange(len(v))] = r.choice(vocabulary)
            texts.append((" " if r.random() < 0.5 else "  ").join(v))
    texts += [f"{' '.join(r.choice(vocabulary) for _ in range(20))} {t} end" for _, t in items] + [None, "", "1234 ...", "short"]
    return [(k, t, "en" if k % 2 else "fr", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)], items


def brute(rows, items):
    left = [(d, t) for d, t, *_ in rows if any(map(str.isalpha, t or ""))]
    kept = {d for d, _, _, k, _ in copies(left) if k}
    left = [(d, t) for d, t in left if d in kept]
    left = [(d, t) for (d, t), (_, c, _) in zip(left, classes(left), strict=True) if c == d]
    bad = contamination(left, [(str(i), t) for i, t in items])
    return [(d, t) for d, t in left if not bad[d][3]]


def test_equals_brute_force(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) for d, t in brute(rows, items)}
    assert len(want) < len(rows) - 20
    assert {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want


def test_stages_keep_the_columns(spark, tmp_path):
    rows, items = corpus()
    docs = spark.createDataFrame(rows[:40], DOCS)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][:3] == ["language id", "exact dedup", "n-gram join"]
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_language_model_learns_from_the_others_only(spark):
    from onomast.llm.queries import language_model

    docs = spark.createDataFrame([(k, "alpha beta" if k % 2 else "gamma delta", "x" if k % 2 else "y") for k in range(30)], "doc_id long, text string, lang string")
    assert isinstance(language_model(docs), language_id.Model)


def test_repeated_ids_nulls_and_long_texts(spark, tmp_path):
    long = " ".join(f"wort{k % 977}" for k in range(60_000))
    rows = [(1, "eins zwei drei", "de", "s", 1), (1, "eins zwei drei", "de", "t", 2), (1, "ganz andere worte hier", "de", "s", 3), (None, "ohne nummer steht das hier", "de", "s", 4), (2, None, "de", "s", 5), (3, "", None, None, None), (4, long, "de", "s", 6), (5, long + " ende", "de", "s", 7), (6, "漢字" * 9000, "zh", "s", 8), (7, "eins  zwei drei", "de", "s", 9), (0, "123 456", "de", "s", 10)]
    docs = spark.createDataFrame([(*r, "mine", "own", "k") for r in rows], f"{DOCS}, score string, lang_pred string, __k string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (None, "einige worte die nirgends stehen")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[-3:] == ["score", "lang_pred", "__k"]
    assert {tuple(r) for r in docs.select("score", "lang_pred", "__k").distinct().collect()} == {("mine", "own", "k")}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # "eins  zwei drei" (7) has more code points than the rows of id 1; 4 and 5 are near copies
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "4", "6", "7", "None"]
