import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from onomast.llm import token_store as ts
from onomast.llm.common import scratch_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab '\n\t s1.é\x1c\x85\xa0 "), st.characters(codec="utf-8")), max_size=50))
def test_pieces_equal_the_library(text):
    got = np.frombuffer(ts.encoder(PATH, "<u2").encode_all([text])[0], "<u2").tolist()
    assert got == LIBRARY.encode(text, add_special_tokens=False).ids


def test_special_strings():
    test = "a <|endoftext|> b<|endoftext|>"
    assert np.frombuffer(ts.encoder(PATH, "<u2").encode_all([test])[0], "<u2").tolist() == LIBRARY.encode(test, add_special_tokens=False).ids


def test_crc_of_parts():
    r = random.Random(2)
    parts = [r.randbytes(n) for n in (0, 1, 4, 0, 1000, 17)]
    assert ts.crc_joined([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_cuts_depend_on_the_document_alone():
    r = np.random.default_rng(1)
    docs = [r.integers(0, 50257, n).astype("<u2") for n in (1, 40, 5000, 20_000, 3)] + [np.full(20_000, 7, "<u2")]
    ends = np.cumsum([len(d) for d in docs])
    together = ts.cuts(np.concatenate(docs), ends)
    alone, base = [], 0
    for d in docs:
        alone += [base + c for c in ts.cuts(d, np.array([len(d)]))]
        base += len(d)
    assert together == alone
    sizes = np.diff([0, *together])
    assert sizes.max() <= ts.LONGEST and set(ends.tolist()) <= set(together)
    # an insertion at the front moves the later cuts only
    shifted = ts.cuts(np.concatenate([docs[3][:50], docs[3]]), np.array([20_050]))
    assert len({c - 50 for c in shifted} & set(ts.cuts(docs[3], np.array([20_000])))) > 10


ROWS = [(5, "the same passage " * 900), (1, "the same passage " * 900), (2, None), (3, ""), (3, ""), (None, "no id"), (9, "é  x\n\n y   "), (7, "word " * 50_000), (7, "other"), (1, "the same passage " * 900)]


def brute(rows):
    docs = []
    for d, t in rows:
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2]
        docs.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
    out, start = [], 0
    for d, n, crc, ids in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        out.append((d, start, n, crc))
        start += n
    return out


def test_round_trip(spark):
    rows = [(d, t, "x") for d, t in ROWS]
    store = ts.TokenStore(spark, scratch_dir(spark, "t"))
    store.write(spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3), PATH, 2)
    got = sorted(map(tuple, store.documents().select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    want = brute(ROWS)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sorted((str(d), n, c) for d, _, n, c in got) == sorted((str(d), n, c) for d, _, n, c in want)
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    assert store.verify()
    addresses = [r[0] for r in store._read("chunks").select("address").collect()]
    assert len(addresses) == len(set(addresses))
    ids = {r["start"]: r["ids"] for r in store.read_ids("doc_id = 5").collect()}
    assert list(ids.values()) == [[*LIBRARY.encode(ROWS[0][1], add_special_tokens=False).ids, 2]]


def test_damage_is_found(spark):
    path = scratch_dir(spark, "t")
    store = ts.TokenStore(spark, path)
    store.write(spark.createDataFrame([(1, "some text here")], "doc_id long, text string"), PATH, 2)
    bad = store._read("chunks").selectExpr("address", "n", "cast('zz' as binary) ids").toPandas()
    assert len(bad) == 1
    os.system(f"rm -r {path.removeprefix('file://')}/chunks")
    spark.createDataFrame([(bytes(a), n, bytes(i)) for a, n, i in bad.itertuples(index=False)], "address binary, n int, ids binary").write.parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="damaged"):
        store.documents().collect()


def test_empty_table(spark):
    store = ts.TokenStore(spark, scratch_dir(spark, "t"))
    store.write(spark.createDataFrame([], "doc_id long, text string"), PATH, 2)
    assert store.documents().count() == 0 and store.verify()


def _stored(spark, n=40):
    path = scratch_dir(spark, "t")
    store = ts.TokenStore(spark, path)
    rows = [(k, " ".join(f"w{k * j % 97}" for j in range(400))) for k in range(n)]
    store.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH, 2)
    return path, store


def _replaced(spark, store, table, rows):
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    os.system(f"rm -r {store.path.removeprefix('file://')}/{table}")
    rows.write.parquet(f"{store.path}/{table}")


@pytest.mark.parametrize("damage", ["lost chunk", "swapped chunks", "lost recipe", "lost file", "changed count", "lost manifest row"])
def test_every_loss_is_found(spark, monkeypatch, damage):
    monkeypatch.setattr(ts, "FILE_DOCS", 10)
    _, store = _stored(spark)
    assert store.documents().count() == 40 and store.verify()
    chunks, recipes, manifest = (store._read(t) for t in ("chunks", "recipes", "manifest"))
    if damage == "lost chunk":
        _replaced(spark, store, "chunks", chunks.limit(chunks.count() - 1))
    elif damage == "swapped chunks":
        a, b = chunks.limit(2).collect()
        rest = chunks.where(~chunks["address"].isin(bytes(a[0]), bytes(b[0]))).collect()
        _replaced(spark, store, "chunks", spark.createDataFrame([*rest, (a[0], a[1], b[2]), (b[0], b[1], a[2])], chunks.schema))
    elif damage == "lost recipe":
        _replaced(spark, store, "recipes", recipes.where("doc_id <> 7"))
    elif damage == "lost file":
        _replaced(spark, store, "recipes", recipes.where("file <> 1"))
    elif damage == "changed count":
        _replaced(spark, store, "recipes", recipes.selectExpr("file", "doc_id", "n_tokens + cast(doc_id = 3 as int) n_tokens", "file_start", "root", "addresses"))
    else:
        _replaced(spark, store, "manifest", manifest.where("file <> 2"))
    assert store.verify() == damage.endswith(("chunk", "chunks"))
    with pytest.raises(Exception, match=r"lacks the chunk|damaged|isn't as the manifest"):
        store.documents().collect()


def test_merkle_as_levels():
    import hashlib

    def levels(leaves):
        level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"\0").digest()]
        while len(level) > 1:
            level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    for n in range(40):
        leaves = [bytes([k]) for k in range(n)]
        assert ts.merkle(leaves) == levels(leaves)


def test_splitting_rules_agree():
    r, rule = random.Random(3), ts.regex.compile(ts.RULE)
    letters = [chr(c) for c in [*range(1, 0x600), *range(0x2000, 0x2070), *range(0x3040, 0x3100), 0x4E00, 0x9FA5, 0xE01, 0x1F600]]
    plain = 0
    for _ in range(20_000):
        t = "".join(r.choice(letters if r.random() < 0.3 else " ab's1.\n") for _ in range(r.randint(0, 12)))
        if ts.PLAIN.fullmatch(t):
            plain += 1
            assert ts.FAST.findall(t) == rule.findall(t), t
    assert plain > 5000
    assert ts.PLAIN.fullmatch("Größe, «été» ¿qué? – 漢字 かな don’t")


def test_text_without_spaces(spark):
    texts = ["漢字" * 20_000, '{"a":1,' * 8000, "abc" * 30_000]
    store = ts.TokenStore(spark, scratch_dir(spark, "t"))
    store.write(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), PATH, 2)
    got = {r["doc_id"]: r["ids_crc32"] for r in store.documents().collect()}
    assert got == {k: zlib.crc32(np.array([*LIBRARY.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for k, t in enumerate(texts)}
    own = ts.encoder(PATH, "<u2")
    own.encode_all(texts)
    assert max(map(len, own.words), default=0) <= 64


def test_sets_are_listed_and_printable_words_are_not_translated():
    assert ts.re.fullmatch(f"[{ts.NUMBER}]+", "09٣") and not ts.re.search(f"[{ts.LETTER}]", "0_ -٣") and ts.re.fullmatch(f"[{ts.OTHER}]+", "_]-^\\")
    own = ts.Encoder(public_tokenizers.path("byte_bpe_50k.json"), "<u2")
    words = [" the", "the", "\n", " ", "é", " ~", "\x7f", "\x00", " naïve", "  "]
    assert own._encoded(words) == [own.whole(w) for w in words]
