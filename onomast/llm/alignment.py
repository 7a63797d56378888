"""Cross-tokenizer alignment: the tokens of two tokenizers are cut into groups wherever both end at the same byte.

Running sums of the tokens' lengths give where they end, the ends that both sides have are the cuts, and the number of cuts before a token is its
group. Tokens of one group are linked by their different ids and counts, so that a group with many tokens costs its different ids and not all pairs
of occurrences.

Neither tokenizer has a token across the place between a character that isn't white space and a space (checked on the files; else texts are taken
whole), and both end a token there. So a text is the sequence of its pieces, and a task tokenizes and aligns each of the pieces that it remembers once, many of them as one
stream of bytes. Documents are packed into blocks of BLOCK_BYTES of text (one document at least) with a list of the block's different
id pairs and how many of its documents hold each; a document has its pairs as numbers in that list. What is shuffled are the blocks' pairs: their counts are added up over the
corpus by a groupBy, each id's best is found by another, and a join brings both back to the blocks, where they meet the documents in a cogroup. Pairs repeat
far more than words do, and a block holds a hot pair once. Texts are read once.

An id pair's count is the number of documents that hold it linked at least once, over all documents.

Defined results: texts that are null, empty, or whose joined bytes differ from space + text for either tokenizer have no tokens (zeros, and '' for the
hash) and count for no pair. Strings of special tokens are plain text. Null and repeated ids and repeated rows are documents of their own. Equal counts of an id's
pairs are all best. Very long texts, also without a space, are taken whole. Other columns play no part, whatever their names. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from onomast.llm.common import LONGEST_PIECE, release, row_slices, small_batches, texts_of, worker_state, written

#: Text of a block, about.
BLOCK_BYTES = 16 << 20
#: What a worker remembers of pieces, about, and pieces that go to the tokenizers as one text.
CACHE_BYTES, UNIT = 160 << 20, 64
#: Where a text is cut: at a space after a character that isn't white space, unless only spaces follow.
CUT = re.compile(r"(?<=\S) (?! *\Z)")
#: White space before a space, or spaces at the end: only then do cuts differ from all spaces.
ODD = re.compile(r"\s | \Z")
SPACE = "▁"


# --- tokenizers ---------------------------------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The byte that each printable character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level tokenizer of the tokenizers library; encodes space + piece."""

    def __init__(self, file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_str(file.decode())
        self.library.encode_special_tokens = True
        letters = byte_letters()
        self.bytes = [b""] * (max(self.library.get_vocab().values(), default=-1) + 1)
        for token, k in self.library.get_vocab().items():
            self.bytes[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast([f" {p}" for p in pieces], add_special_tokens=False)]

    @staticmethod
    def cuts_at_spaces(file: bytes) -> bool:
        made = json.loads(file)
        first = made.get("pre_tokenizer") or {}
        return not made.get("normalizer") and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")


class Pieces:
    """A sentencepiece tokenizer, which puts a space before the piece itself."""

    def __init__(self, file: bytes):
        self.library = SentencePieceProcessor(model_proto=file)
        names = [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(names)]

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return self.library.encode(pieces, num_threads=1)

    @staticmethod
    def cuts_at_spaces(file: bytes) -> bool:
        library = SentencePieceProcessor(model_proto=file)
        return not any(SPACE in p.lstrip(SPACE) for p in map(library.id_to_piece, range(library.get_piece_size())))


def pieces_of(text: str, cut: bool = True) -> list[str]:
    """The pieces of space + text, each without its first space."""
    if not cut:
        return [text]
    return CUT.split(text) if text[:1] == " " or ODD.search(text) else text.split(" ")


# --- alignment of pieces ------------------------------------------------------------------------------------


def room(array: np.ndarray, used: int, more: int) -> np.ndarray:
    """The array, or a longer copy of it, with place for more values after those used."""
    if used + more <= len(array):
        return array
    out = np.zeros((2 * (used + more), *array.shape[1:]), array.dtype)
    out[:used] = array[:used]
    return out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class Aligner:
    """What is known of the pieces met lately, a row each; each new one is tokenized and aligned once.

    numbers: n_a, n_b, n_groups, n_links, and 1 where a tokenizer doesn't give the piece's bytes back. texts: the groups, each with
    a semicolon after it. Links are an id pair (a * width + b) and how often, from first[row] on, held[row] of them.
    """

    def __init__(self, a_file: bytes, b_file: bytes, cut: bool):
        self.sides = ByteLevel(a_file), Pieces(b_file)
        self.cut = cut
        self.sizes = [np.fromiter(map(len, t.bytes), np.int64, len(t.bytes)) for t in self.sides]
        self.width = max(1, len(self.sizes[1]))
        #: Ids as text with what follows them: inside their side, and at its end.
        self.names = [[b"%d%s" % (k, mark) for mark in (b",", last) for k in range(len(s))] for s, last in zip(self.sizes, (b"|", b";"), strict=True)]
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.numbers, self.first, self.held = np.zeros((0, 5), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pairs, self.times, self.links, self.spent = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0

    def _add(self, pieces: list[str], texts: list[bytes], numbers: np.ndarray, held: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> None:
        at, n = len(self.texts), len(pieces)
        self.numbers, self.first, self.held = (room(x, at, n) for x in (self.numbers, self.first, self.held))
        self.pairs, self.times = (room(x, self.links, len(pairs)) for x in (self.pairs, self.times))
        self.numbers[at : at + n], self.held[at : at + n] = numbers, held
        self.first[at : at + n] = self.links + np.cumsum(held) - held
        self.pairs[self.links : self.links + len(pairs)], self.times[self.links : self.links + len(pairs)] = pairs, times
        self.links += len(pairs)
        self.texts += texts
        self.index.update(zip(pieces, range(at, at + n), strict=True))
        self.spent += 350 * n + sum(map(len, pieces)) + sum(map(len, texts)) + 32 * len(pairs)

    def _encoded(self, units: list[list[str]]) -> tuple[list[list[str]], list[list[int]], list[list[str]]]:
        """The units that both tokenizers give back, the ids of either side over them all, and the other units."""
        whole = [" ".join(u) for u in units]
        ids = [t.encode(whole) for t in self.sides]
        good, bad, flat = [], [], ([], [])
        for u, w, *own in zip(units, whole, *ids, strict=True):
            given = f" {w}".encode()
            if all(b"".join(map(t.bytes.__getitem__, x)) == given for t, x in zip(self.sides, own, strict=True)):
                good.append(u)
                for f, x in zip(flat, own, strict=True):
                    f += x
            else:
                bad.append(u)
        return good, list(flat), bad

    def learn(self, pieces: list[str]) -> None:
        """No token crosses a cut, so pieces that cuts can follow go to the tokenizers joined; where bytes differ, one by one."""
        joined = [p for p in pieces if self.cut and len(p) <= LONGEST_PIECE and not p[-1:].isspace()]
        units = [joined[k : k + UNIT] for k in range(0, len(joined), UNIT)]
        known = set(joined)
        units += [[p] for p in pieces if p not in known]
        for at in range(0, len(units), 500):
            good, ids, bad = self._encoded(units[at : at + 500])
            self._align(good, *ids)
            if bad:
                good, ids, bad = self._encoded([[p] for u in bad for p in u])
                self._align(good, *ids)
                none = np.zeros((len(bad), 5), np.int64)
                none[:, 4] = 1
                self._add([u[0] for u in bad], [b""] * len(bad), none, none[:, 0], none[:0, 0], none[:0, 0])

    def _align(self, units: list[list[str]], a_ids: list[int], b_ids: list[int]) -> None:
        """The pieces as one stream of bytes: tokens by where they end, a cut wherever both sides end, and the cuts before number the groups."""
        pieces = [p for u in units for p in u]
        if not pieces:
            return
        ids = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        ends = [np.cumsum(s[x]) for s, x in zip(self.sizes, ids, strict=True)]
        stops = np.cumsum(np.fromiter((len(p.encode()) + 1 for p in pieces), np.int64, len(pieces)))
        cuts = ends[0][ends[1][np.searchsorted(ends[1], ends[0])] == ends[0]]
        own = [np.searchsorted(cuts, e) for e in ends]
        counts = [np.bincount(g, minlength=len(cuts)) for g in own]
        last = np.searchsorted(cuts, stops) + 1
        of_piece = lambda x, stop=last: np.diff(np.concatenate([[0], np.cumsum(x)])[stop], prepend=0)

        # groups as text: a group's tokens of A, then those of B
        order, marked = np.empty(len(a_ids) + len(b_ids), np.int64), []
        tail = [np.cumsum(c) for c in counts]
        places = np.arange(len(a_ids)) + (tail[1] - counts[1])[own[0]], np.arange(len(b_ids)) + tail[0][own[1]]
        for side, (x, g, t) in enumerate(zip(ids, own, tail, strict=True)):
            marked.append(x + len(self.sizes[side]) * (np.arange(len(x)) + 1 == t[g]))
        order[places[0]], order[places[1]] = marked[0], marked[1] + len(self.names[0])
        parts = [self.names[0][k] if k < len(self.names[0]) else self.names[1][k - len(self.names[0])] for k in order.tolist()]
        lengths = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        whole, at = b"".join(parts), [0, *lengths[(tail[0] + tail[1])[last - 1] - 1].tolist()]
        texts = [whole[i:j] for i, j in zip(at, at[1:], strict=False)]

        # links: a group's different ids of A, each with the group's different ids of B
        (a_keys, a_n), (b_keys, b_n) = (np.unique(g * len(s) + x, return_counts=True) for g, s, x in zip(own, self.sizes, ids, strict=True))
        a_group, b_group = a_keys // len(self.sizes[0]), b_keys // len(self.sizes[1])
        kinds = np.bincount(b_group, minlength=len(cuts))
        each = kinds[a_group]
        a_at, b_at = np.repeat(np.arange(len(a_keys)), each), ranges((np.cumsum(kinds) - kinds)[a_group], each)
        pairs = (a_keys % len(self.sizes[0]))[a_at] * self.width + (b_keys % len(self.sizes[1]))[b_at]
        held = of_piece(np.bincount(a_group[a_at], minlength=len(cuts)))
        numbers = np.stack([of_piece(counts[0]), of_piece(counts[1]), np.diff(last, prepend=0), of_piece(counts[0] * counts[1]), np.zeros_like(last)], 1)
        self._add(pieces, texts, numbers, held, pairs, a_n[a_at] * b_n[b_at])

    def documents(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text its numbers and the hash of its groups; of each text's different pairs the text's number, the pair and how often."""
        if self.spent > CACHE_BYTES:
            self.forget()
        split = [pieces_of(t, self.cut) if t else [] for t in texts]
        self.learn(list(set().union(*split).difference(self.index)))
        flat = [list(map(self.index.__getitem__, s)) for s in split]
        stops = np.cumsum([len(r) for r in flat])
        rows = np.fromiter(itertools.chain.from_iterable(flat), np.int64, stops[-1])
        numbers = np.diff(np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(self.numbers[rows], 0)])[stops], axis=0, prepend=np.zeros((1, 5), np.int64))
        sound = (numbers[:, 4] == 0) & (numbers[:, 0] > 0)
        hashes = [hashlib.sha256(b"".join(map(self.texts.__getitem__, r))[:-1]).hexdigest() if s else "" for r, s in zip(flat, sound.tolist(), strict=True)]
        numbers[~sound] = 0
        doc = np.repeat(np.arange(len(flat)), [len(r) for r in flat])
        rows, doc = rows[sound[doc]], doc[sound[doc]]
        at = ranges(self.first[rows], self.held[rows])
        most = self.width * len(self.sizes[0])
        keys, back = np.unique(np.repeat(doc, self.held[rows]) * most + self.pairs[at], return_inverse=True)
        times = np.zeros(len(keys), np.int64)
        np.add.at(times, back, self.times[at])
        return numbers[:, :4], hashes, keys // most, keys % most, times


# --- blocks of documents ------------------------------------------------------------------------------------

NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def blocks(docs: DataFrame, doc_id: str, text: str, a_file: bytes, b_file: bytes, cut: bool) -> DataFrame:
    """Rows of two kinds. code null: a document, with the codes of its different pairs and how often it links each; else one different pair of the block and how many of the block's documents hold it."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = _parse_datatype_string(f"block bigint, code int, pair bigint, n bigint, doc_id {rows.dtypes[0][1]}, {', '.join(f'{n} bigint' for n in NUMBERS)}, groups_sha256 string, codes array<int>, times array<bigint>")
    arrow, most = to_arrow_schema(schema), BLOCK_BYTES

    def batch_of(block: int, size: int, **columns: pa.Array) -> pa.RecordBatch:
        columns["block"] = pa.array(np.full(size, block))
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in arrow], schema=arrow)

    def made(block: int, width: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """The block's pairs get their codes when all its documents are known."""
        pairs, codes, n = np.unique(np.concatenate([pairs for *_, pairs, _ in held]), return_inverse=True, return_counts=True)
        at = 0
        for ids, numbers, hashes, doc, own, times in held:
            stops = np.searchsorted(doc, np.arange(len(ids) + 1)).astype(np.int32)
            lists = {"codes": pa.array(codes[at : at + len(own)].astype(np.int32)), "times": pa.array(times)}
            at += len(own)
            yield batch_of(block, len(ids), doc_id=ids, groups_sha256=pa.array(hashes, pa.string()), **{k: pa.array(numbers[:, j]) for j, k in enumerate(NUMBERS)}, **{k: pa.ListArray.from_arrays(pa.array(stops), v) for k, v in lists.items()})
        ids = (pairs // width << 32) + pairs % width
        for at in range(0, len(ids), 50_000):
            k = min(50_000, len(ids) - at)
            yield batch_of(block, k, code=pa.array(np.arange(at, at + k, dtype=np.int32)), pair=pa.array(ids[at : at + k]), n=pa.array(n[at : at + k]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_state(("alignment", hash(a_file), hash(b_file), cut), lambda: Aligner(a_file, b_file, cut))
        base, n = TaskContext.get().partitionId() << 32, itertools.count()
        held, size = [], 0
        for batch in batches:
            for part in row_slices(batch, "text", most):
                texts = texts_of(part, "text")
                held.append((part.column(0), *own.documents(texts)))
                size += sum(map(len, texts))
                if size >= most:
                    yield from made(base | next(n), own.width, held)
                    held, size = [], 0
        if held:
            yield from made(base | next(n), own.width, held)
        del held
        release()

    return rows.mapInArrow(run, schema)


def summed(documents: pa.Table, pairs: pa.Table) -> pa.Table:
    """The documents of a block with n_best and count_sum, from what its pairs' counts are in the corpus."""
    known = np.zeros((2, len(pairs)), np.int64)
    known[:, pairs.column("code").to_numpy()] = pairs.column("best").to_numpy(), pairs.column("n").to_numpy()
    codes, times = (pc.list_flatten(documents.column(c)).to_numpy() for c in ("codes", "times"))
    stops = np.cumsum(pc.list_value_length(documents.column("codes")).to_numpy())
    totals = [pa.array(np.diff(np.concatenate([[0], np.cumsum(k[codes] * times)])[stops], prepend=0)) for k in known]
    columns = [documents.column(c) for c in ("doc_id", *NUMBERS)]
    return pa.Table.from_arrays([*columns, *totals, documents.column("groups_sha256")], ["doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    small_batches(docs.sparkSession)
    a_file, b_file = (open(p, "rb").read() for p in (a_path, b_path))  # noqa: SIM115
    raw = written(blocks(docs, doc_id, text, a_file, b_file, ByteLevel.cuts_at_spaces(a_file) and Pieces.cuts_at_spaces(b_file)), "alignment_blocks")
    documents = raw.where("code is null").select("block", "doc_id", *NUMBERS, "groups_sha256", "codes", "times")
    pairs = raw.where("code is not null").select("block", "code", "pair", "n")

    # a document is in one block, so the blocks' counts add up
    counts = written(pairs.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", 32)), "pair_counts")
    best = counts.groupBy("a").agg(F.max("n").alias("most"))
    counts = counts.join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("bigint").alias("best"))
    known = pairs.select("block", "code", "pair").join(counts, "pair").select(F.col("block").alias("of_block"), "code", "n", "best")

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{n} bigint' for n in (*NUMBERS, 'n_best', 'count_sum'))}, groups_sha256 string"
    return documents.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(summed, schema)
