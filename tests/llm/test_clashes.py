"""Columns named as an operator's own, in another case: replaced by the results, or kept where documents are filtered."""

import numpy as np
import pytest

import corpus_pipeline
from onomast.llm import decontaminate, exact_dedup, language_id, ngram_join, quality, toxicity

TEXT = "the quick brown fox jumps over the lazy dog and runs away from the very big bear today"


@pytest.fixture(scope="module")
def docs(spark):
    names = ["Score", "LANG_PRED", "Keep", "Weak_Label", "DC_ITEMS", "Dc_Spans", "Predicted", "OFFENDING", "Score__own", "K", "H", "Rows", "LABEL"]
    rows = [(d, t, "en", *[f"{n}{d}" for n in names]) for d, t in [(1, TEXT), (2, TEXT + " again"), (3, None), (4, TEXT)]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names))


def test_results_replace_columns_of_any_case(docs):
    made = {
        "lang_pred score": language_id.predict(docs, language_id.train(docs)),
        "score predicted offending": toxicity.predict(docs, toxicity.Model(np.zeros(1 << toxicity.BITS, np.float32), -1.0)),
        "weak_label score keep": quality.predict(docs, *quality.train(docs)),
        "dc_words dc_spans dc_items dc_longest": decontaminate.find_contamination(docs, docs.select("doc_id", "text").limit(0), item_id="doc_id"),
    }
    for results, df in made.items():
        lower = [c.lower() for c in df.columns]
        assert len(set(lower)) == len(lower) and set(results.split()) <= set(df.columns)
        assert df.count() == 4 and df.where("LABEL = 'LABEL1'").count() == 1


@pytest.mark.parametrize("stage", ["language", "exact", "near", "clean"])
def test_stages_keep_columns_of_any_case(spark, docs, stage):
    functions = {
        "language": lambda: corpus_pipeline.language(spark, docs, ""), "exact": lambda: exact_dedup.keep_first(docs), "near": lambda: ngram_join.keep_one(docs),
        "clean": lambda: decontaminate.decontaminate(docs, docs.where("doc_id = 2").select("doc_id", "text"), item_id="doc_id"),
    }
    got = functions[stage]()
    assert got.columns == docs.columns
    whole = {r["doc_id"]: r for r in docs.collect()}
    rows = got.collect()
    assert rows and all(r == whole[r["doc_id"]] for r in rows)


def test_no_text_moves_beyond_the_limit(spark, docs, monkeypatch):
    want = sorted(map(tuple, exact_dedup.annotate(docs).collect()), key=str)
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, exact_dedup.annotate(docs).collect()), key=str) == want
    long = "x" * 300_000
    many = spark.createDataFrame([(k, f"{long} {k // 2}") for k in range(40)], "doc_id long, text string")
    got = exact_dedup.find_copies(many)
    assert got.count() == 40
