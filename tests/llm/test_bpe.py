import hashlib
import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from onomast.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def same(text):
    own, lib = bpe.codec(PATH), LIBRARY.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == lib
    assert own.decode(lib) == LIBRARY.decode(lib, skip_special_tokens=False)


def test_hard_characters():
    r = random.Random(1)
    letters = "aAé ÉßΣσİıﬁ́\n\t\x1c\x85 'sdt9²Ⅷ漢😀 -_.,ñ"
    for _ in range(500):
        same("".join(r.choice([*letters, "<|startoftext|>"]) for _ in range(r.randint(0, 30))))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(min_codepoint=1, max_codepoint=0x24F), max_size=60))
def test_equals_the_library(text):
    same(text)


def test_stale_entries_are_skipped():
    ranks = {("b", "c"): 0, ("a", "b"): 1, ("a", "bc"): 2, ("c", "d"): 3}
    assert bpe.merge(list("abcd"), ranks) == ["abc", "d"]
    assert bpe.merge(list("aaa"), {("a", "a"): 0}) == ["aa", "a"]
    assert bpe.merge([], ranks) == []


def test_frames(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "Hello, World", 5), (3, "Hello, World", 5), (4, "long " * 40_000, 5), (None, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = sorted(map(tuple, bpe.digests(df, PATH).collect()), key=str)
    want = []
    for d, t, _ in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    full = bpe.encode(df, PATH).where("doc_id = 3").first()
    assert full["decoded"] == LIBRARY.decode(full["token_ids"], skip_special_tokens=False)
    assert bpe.digests(df.limit(0), PATH).count() == 0
