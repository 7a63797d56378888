"""Byte-pair encoding and decoding from a tokenizer file.

A word's symbols form a doubly linked list. Every neighbouring pair that has a merge rank waits in a priority
queue by (rank, position); a popped entry whose symbols have changed since it was pushed is stale and
skipped. Decoding concatenates vocabulary strings as the file's decoder says: byte-level files give bytes,
files without a decoder give their tokens joined by a space.

The file's normaliser (NFC, runs of white space to one space, lower case) and its splitting rule run before;
pieces between spaces never share a token, so each distinct piece is encoded once and remembered within bounds.

Defined results: null and empty texts have no ids and decode to the empty string. A special token's string
in a text is that token. Rows are encoded each on its own, so ties, repeated rows and other columns play no part.
Very long texts are encoded whole. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from onomast.llm.common import ChunkCache, release, row_slices, small_batches, texts_of, unused, worker_state

#: White space of the file's rules (Unicode White_Space); Python's own class has U+001C to U+001F besides.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
BATCH_BYTES = 2 << 20
#: Bytes of encoded pieces and words that a worker remembers, in each of two generations; less memory costs time, never a result.
CACHE_BYTES = 112 << 20


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Applies the merges in order of rank, then position. An entry of the queue is one number, rank above position."""
    n, get = len(symbols), ranks.get
    text = list(symbols)
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    queue = [r << 32 | i for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := get(pair)) is not None]
    heapify(queue)
    while queue:
        entry = heappop(queue)
        i = entry & 0xFFFFFFFF
        j = after[i]
        # stale: the symbols there are no longer the pair of this rank
        if j < 0 or get((text[i], text[j])) != entry >> 32:
            continue
        new = text[i] = text[i] + text[j]
        text[j] = ""
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            if (r := get((new, text[k]))) is not None:
                heappush(queue, r << 32 | i)
        h = before[i]
        if h >= 0 and (r := get((text[h], new))) is not None:
            heappush(queue, r << 32 | h)
    return [t for t in text if t]


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.ranks = {p: k for k, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_id = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.strings = [by_id.get(i, "") for i in range(max(by_id, default=-1) + 1)]
        self.letters = byte_letters()
        self.bytes = {c: b for b, c in self.letters.items()}
        kind = (spec.get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"decoder {kind} is not known")
        self.by_bytes = kind == "ByteLevel"
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("a normaliser of NFC, white space and lower case is expected")
        rule = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.rule = regex.compile(rule.replace("\\s", SPACE))
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.odd = regex.compile("[\x1c-\x1f]")
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        size = lambda made: 64 + len(made[0]) + 8 * len(made[1])
        self.pieces = ChunkCache(self._piece, cache_bytes * 3 // 5, size)
        self.words = ChunkCache(self._word, cache_bytes * 2 // 5, size)

    def encode_word(self, word: str) -> list[str]:
        symbols = [self.letters[b] for b in word.encode()]
        if symbols and self.suffix:
            symbols[-1] += self.suffix
        return merge(symbols, self.ranks)

    def _piece(self, piece: str) -> tuple[str, tuple[int, ...]]:
        """Ids of a piece without white space, as text joined by a space and as numbers."""
        found = self.rule.findall(piece)
        if len(found) == 1:
            return self.words[found[0]]
        parts = [self.words[w] for w in found]
        return " ".join([p[0] for p in parts]), tuple([i for p in parts for i in p[1]])

    def _word(self, word: str) -> tuple[str, tuple[int, ...]]:
        ids = tuple([self.vocab[t] for t in self.encode_word(word)])
        return " ".join(map(str, ids)), ids

    def trim(self) -> None:
        self.pieces.trim()
        self.words.trim()

    def normalise(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower-cased a character at a time: no final sigma
                return "".join(c.lower() for c in text)
        return text.lower()

    def _split(self, text: str) -> list[str]:
        text = self.normalise(text)
        return text.split() if not self.odd.search(text) else [p for p in self.spaces.split(text) if p]

    def pieces_of(self, text: str) -> list[tuple[str, tuple[int, ...]]]:
        pieces = self.pieces
        if self.specials and "<|" in text:
            out = []
            for k, part in enumerate(self.specials.split(text)):
                out += [(str(self.special[part]), (self.special[part],))] if k % 2 else [pieces[p] for p in self._split(part)]
            return out
        return [pieces[p] for p in self._split(text)]

    def encode(self, text: str) -> list[int]:
        return [i for _, ids in self.pieces_of(text) for i in ids]

    def decode(self, ids: list[int]) -> str:
        """Each id looked up in the vocabulary; the strings joined as the file's decoder says."""
        tokens = map(self.strings.__getitem__, ids)
        if not self.by_bytes:
            return " ".join(tokens)
        return bytes(self.bytes[c] for t in tokens for c in t).decode("utf-8", "replace")


def codec(path: str, cache_bytes: int = CACHE_BYTES) -> Codec:
    return worker_state(("bpe", path, cache_bytes), lambda: Codec(path, cache_bytes))


FOUND = ("token_ids", "decoded")


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with token_ids (array of int) and decoded (the text decoded from them); columns of these names are replaced."""
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in FOUND]
    schema = T.StructType([docs.schema[n] for n in names] + [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    texts = unused(names, "text")[0]
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in row_slices(batch, texts, BATCH_BYTES):
                ids = [own.encode(t) for t in texts_of(part, texts)]
                made = [pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(i) for i in ids], pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in names] + made, [*names, "token_ids", "decoded"])
                own.trim()

    return docs.select(*[F.col(f"`{c}`") for c in names], F.col(text).alias(texts)).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256; ids and decoded text leave no task."""
    schema = T.StructType([docs.schema[doc_id], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, cache_bytes)
        for batch in batches:
            for part in row_slices(batch, text, BATCH_BYTES):
                counts, ids, decoded = [], [], []
                for t in texts_of(part, text):
                    found = own.pieces_of(t)
                    numbers = list(chain.from_iterable([p[1] for p in found]))
                    counts.append(len(numbers))
                    ids.append(hashlib.sha256(" ".join([p[0] for p in found if p[1]]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(numbers).encode()).hexdigest())
                own.trim()
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(doc_id)), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], schema.names)
        release()

    small_batches(docs.sparkSession)
    return docs.select(doc_id, text).mapInArrow(run, schema)
