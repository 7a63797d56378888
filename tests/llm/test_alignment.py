import hashlib
import random
from collections import defaultdict
from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from onomast.llm import alignment as al

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, N_A int, Pid string, block map<string,int>"


def tokens(text):
    """(id, end) of either tokenizer over the whole text, or nothing."""
    library, pieces = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    library.encode_special_tokens = True
    letters, names, out = al.byte_letters(), {k: t for t, k in library.get_vocab().items()}, []
    own = [(k, bytes(letters[c] for c in names[k])) for k in library.encode(" " + text, add_special_tokens=False).ids]
    other = [(k, bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" else p.replace("▁", " ").encode()) for k in pieces.encode(text) for p in [pieces.id_to_piece(k)]]
    for side in (own, other):
        if not text or b"".join(b for _, b in side) != (" " + text).encode():
            return [], []
        at, ends = 0, []
        for k, b in side:
            at += len(b)
            ends.append((k, at))
        out.append(ends)
    return out


def brute(rows):
    found, holds = [], defaultdict(set)
    for n, (d, text, *_) in enumerate(rows):
        a, b = tokens(text or "")
        cuts, groups, x, y = {e for _, e in a} & {e for _, e in b}, [], [], []
        merged = sorted([(e, 0, k) for k, e in a] + [(e, 1, k) for k, e in b])
        for j, (end, side, k) in enumerate(merged):
            (y if side else x).append(k)
            if end in cuts and (j + 1 == len(merged) or merged[j + 1][0] > end):
                groups.append((x, y))
                x, y = [], []
        links = [(p, q) for g in groups for p in g[0] for q in g[1]]
        for pair in links:
            holds[pair].add(n)
        found.append((d, len(a), len(b), groups, links))
    most = defaultdict(int)
    for (p, _), docs in holds.items():
        most[p] = max(most[p], len(docs))
    out = []
    for d, n_a, n_b, groups, links in found:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        n_best = sum(len(holds[p]) == most[p[0]] for p in links)
        out.append((d, n_a, n_b, len(groups), len(links), n_best, sum(len(holds[p]) for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a  ", "\n", "a\n b", "a \n b\n\n  c", "\ta\t\tb \t c", "the cat sat on the mat.", "The cat's hat; it'll don't", "naïve café Ünïcödé", "日本語 テキスト と ひらがな", "😀 👩‍👩‍👧 x", "<|endoftext|> <s> </s> <unk> <0x41>",
    "under▁score", "▁", "x\x00y \x01", "a b   c　 d", "=" * 300 + " " + "-=" * 77, "123456 3.14 1e-9 0x1F", "word " * 40, "http://example.org/a?b=c&d=%20 end", "a\r\nb\rc \x85 d \x1c e", "x" * 5000, " ".join(f"w{n}é" for n in range(900)),
]
ROWS = [(n, t, n, "z", None) for n, t in enumerate(TEXTS)] + [(None, "null id", 0, "", None), (3, "same id", 0, "", None), (5, "the cat sat", 1, "", None), (5, "the cat sat", 1, "", None)]


@pytest.mark.parametrize("most", [al.BLOCK_BYTES, 60])
def test_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(al, "BLOCK_BYTES", most)
    got = al.align(spark.createDataFrame(ROWS, SCHEMA).repartition(3), A, B).collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS)


def test_no_rows(spark):
    assert al.align(spark.createDataFrame([], SCHEMA), A, B).collect() == []


def test_texts_are_taken_whole_where_a_tokenizer_crosses_spaces(spark, monkeypatch):
    monkeypatch.setattr(al.Pieces, "cuts_at_spaces", staticmethod(lambda file: False))
    got = al.align(spark.createDataFrame(ROWS[:20], SCHEMA), A, B).collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS[:20])


def test_pieces_join_to_the_text():
    for t in filter(None, TEXTS):
        assert "".join(" " + p for p in al.pieces_of(t)) == " " + t
        assert "".join(" " + p for p in al.pieces_of(t, False)) == " " + t


def test_scratch_tables_stay_small(spark):
    """What is kept between the steps goes by pairs of ids, which repeat, and not by words, most of which don't."""
    draw = random.Random(1)
    rows = [(n, " ".join("".join(draw.choices(["ba", "ren", "thi", "so", "ing", "le"], k=4)) for _ in range(400))) for n in range(300)]
    files = lambda: set(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).rglob("*.parquet"))
    before = files()
    assert al.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(1), A, B).count() == 300
    assert 0 < 8 * sum(p.stat().st_size for p in files() - before) < sum(len(t) for _, t in rows)


@pytest.mark.parametrize("cut", [True, False])
def test_pieces_are_aligned_together_as_alone(monkeypatch, cut):
    """Also next to pieces that aren't given back, and when nothing is remembered."""
    monkeypatch.setattr(al, "CACHE_BYTES", 0)
    own, texts = al.Aligner(*(open(p, "rb").read() for p in (A, B)), cut), [t or "" for t in TEXTS]
    for part in (texts, texts[::-1], texts[:3], ["under▁score ok", "ok under then ▁"]):
        numbers, hashes, doc, pairs, times = own.documents(part)
        for n, t in enumerate(part):
            (_, *head, _, _, digest), links = brute([(0, t)])[0], times[doc == n].sum()
            assert (numbers[n].tolist(), hashes[n], links) == (head, digest, head[3])
