"""A content-addressed store of token ids.

Documents are encoded with the tokenizers library. A rolling hash over the ids cuts each document's id stream
into chunks, so equal passages give equal chunks wherever they stand. A chunk's address is the SHA-256 of its
ids; every unique chunk is stored once. A document's recipe lists the addresses in order, with its first
id's place in the corpus and the Merkle root over the addresses; a manifest holds the Merkle root of each
recipe file and of the whole store.

Files, all below one folder:
  chunks/    address binary, n int, ids binary (little-endian unsigned, 2 or 4 bytes an id as the manifest says)
  recipes/   file int, doc_id, n_tokens long, file_start long, root binary, addresses array<binary>, in ascending
             order of doc_id through the files, n_tokens and root breaking ties of repeated rows
  manifest/  file int, n_docs, n_tokens, start long, root binary; file -1 is the whole store
A document's start is its file's start plus its file_start.

Reading holds the recipe files against the manifest, every chunk against its address and every recipe against its root. A
checksum per document needs no reassembly: the CRC-32 of a concatenation follows from the CRC-32s and lengths of its parts, so
ids are read once a unique chunk however often it is used. read_ids() reassembles the ids themselves.

Defined results: null texts count as empty; an empty text is a document of the end id alone. Null ids come
first. Repeated rows are documents of their own. Other columns are not stored. An empty table gives an empty store. Very long texts
are encoded whole, by words.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, pre_tokenizers

from onomast.llm.common import BROADCAST_ROWS, ChunkCache, release, removed, row_slices, small_batches, texts_of, worker_state, written

#: Ids under the rolling hash, and shortest, mean and longest chunk (the hash cuts with chance 1 / MEAN).
SPAN, SHORTEST, MEAN, LONGEST = 32, 64, 512, 4096
BATCH_BYTES = 4 << 20
#: Rows of a recipe file, about.
FILE_DOCS = 50_000
#: Hashes and ids hardly repeat, so dictionaries of them would be built for nothing.
PLAIN_FILES = {"parquet.enable.dictionary": "false"}


# --- encoding -----------------------------------------------------------------------------------------------


#: White space of the splitting rule (Unicode White_Space).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The fixed rule by which byte-level files split text before their merges.
RULE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def _listed(rule: str) -> str:
    """The characters that a rule matches, listed for a set: Python's engine looks such a set up once a character."""
    runs = re.findall(f"(?:{rule})+", "".join(map(chr, range(1 << 16))))
    return "".join(re.escape(x[0]) + ("-" + re.escape(x[-1]) if len(x) > 1 else "") for x in runs)


LETTER, NUMBER, OTHER, BLANK = map(_listed, (r"[^\W\d_]", r"\d", r"[^\s\w]|_", r"\s"))
#: The same rule for Python's own engine, which is faster, with the commonest case first, and the characters whose classes it sees otherwise.
FAST = re.compile(rf" ?[{LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{NUMBER}]+| ?[{OTHER}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
#: Blocks whose letters and marks are the same to all engines: Latin, Greek, Cyrillic, Thai, dashes and quotes, kana, common ideographs.
PLAIN = re.compile("[\\x00-\\x1b\\x20-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\u036f\u0400-\u0481\u048a-\u052f\u2010-\u2027\u2030-\u203e\u3040-\u3096\u30a1-\u30fa\u4e00-\u9fa5]*")


#: The printable character that stands for each byte in byte-level files.
LETTERS = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
LETTERS |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in LETTERS)}


class Encoder:
    """The tokenizers library over words, each given to it once and remembered within bounds.

    No token crosses the end of a word of the file's splitting rule, so texts are split by the rule and the new words of a batch
    go to the library together, in the file's letters for bytes. The ids of a word are told apart by their lengths in bytes. Texts
    with the string of a special token go to the library whole.
    """

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype(dtype)
        pre = str(self.library.pre_tokenizer)
        self.by_word = self.library.normalizer is None and pre.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in pre
        # for words that are split, and written in letters for bytes, already
        self.of_words = Tokenizer.from_file(path)
        self.of_words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.rule = regex.compile(RULE)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # every character of a byte-level vocabulary string stands for a byte
        self.sizes = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, k in self.library.get_vocab().items():
            self.sizes[k] = len(token)
        self.words = ChunkCache(None, 40 << 20, len)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _encoded(self, words: list[str]) -> list[bytes]:
        """The ids of each word, by one call of the library. A line end is no letter for a byte, so it parts the words."""
        if not words:
            return []
        letters = [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(LETTERS) for w in words]
        # of printable characters the space alone has another letter
        whole = "\n".join(letters).replace(" ", LETTERS[32])
        ids = np.array(self.of_words.encode_batch_fast([whole], add_special_tokens=False)[0].ids, self.dtype)
        at = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(np.fromiter(map(len, letters), np.int64, len(letters)))) + 1
        raw, ends = ids.tobytes(), (at * self.dtype.itemsize).tolist()
        return [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def split(self, text: str) -> list[str]:
        return FAST.findall(text) if PLAIN.fullmatch(text) else self.rule.findall(text)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        split = [self.split(t) if self.by_word and not any([s in t for s in self.special]) else None for t in texts]
        words = self.words
        words.learn(set().union(*[s for s in split if s]), self._encoded)
        out = [self.whole(t) if s is None else b"".join(map(words.__getitem__, s)) for t, s in zip(texts, split, strict=True)]
        words.trim()
        return out


def encoder(path: str, dtype: str) -> Encoder:
    return worker_state(("token store", path, dtype), lambda: Encoder(path, dtype))


# --- chunks -------------------------------------------------------------------------------------------------


@cache
def _gear(size: int = 1 << 16) -> np.ndarray:
    """A fixed pseudo-random 64-bit number for each id (modulo size): the splitmix64 sequence."""
    z = np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def rolling(ids: np.ndarray) -> np.ndarray:
    """At every place the sum of the last SPAN ids' numbers, each shifted once for every id after it."""
    h = _gear()[ids & 0xFFFF]
    width = 1
    while width < SPAN:
        h[width:] += h[:-width] << np.uint64(width)
        width *= 2
    return h


def cuts(ids: np.ndarray, ends: np.ndarray) -> list[int]:
    """Where chunks end, for documents that end at `ends` in one stream. A document's cuts depend on its own ids only."""
    marks = np.flatnonzero(rolling(ids) >> np.uint64(32) < np.uint64((1 << 32) // MEAN)) + 1
    out: list[int] = []
    start = 0
    for end, own in zip(ends.tolist(), np.split(marks, np.searchsorted(marks, ends[:-1], "right")), strict=True):
        first, last = start, start
        for m in own.tolist():
            if m - first < SPAN or m - last < SHORTEST or m >= end:
                continue
            while m - last > LONGEST:
                last += LONGEST
                out.append(last)
            if m - last >= SHORTEST:
                out.append(m)
                last = m
        while end - last > LONGEST:
            last += LONGEST
            out.append(last)
        out.append(end)
        start = end
    return out


class Merkle:
    """Root over leaves that come one by one; an odd node goes up as it is, leaves and inner nodes are hashed apart.

    Only the roots of the full subtrees so far are held, one for each bit of the leaves' number.
    """

    def __init__(self):
        self.n, self.peaks = 0, []

    def add(self, leaf: bytes) -> None:
        node, n = hashlib.sha256(b"\0" + leaf).digest(), self.n
        while n & 1:
            node = hashlib.sha256(b"\1" + self.peaks.pop() + node).digest()
            n >>= 1
        self.peaks.append(node)
        self.n += 1

    def root(self) -> bytes:
        if not self.peaks:
            return hashlib.sha256(b"\0").digest()
        node = self.peaks[-1]
        for left in self.peaks[-2::-1]:
            node = hashlib.sha256(b"\1" + left + node).digest()
        return node


def merkle(leaves: list[bytes]) -> bytes:
    tree = Merkle()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


# --- CRC-32 of a concatenation ------------------------------------------------------------------------------

_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC-32 one, bits reflected."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = (b >> 1) ^ (_POLY if b & 1 else 0)
    return out


@cache
def _shift(n_bytes: int) -> int:
    """x to the power 8 * n_bytes."""
    out, square, n = 0x80000000, 0x00800000, n_bytes
    while n:
        if n & 1:
            out = _times(square, out)
        square = _times(square, square)
        n >>= 1
    return out


def crc_joined(parts: list[tuple[int, int]]) -> int:
    """The CRC-32 of a concatenation, from (CRC-32, bytes) of its parts."""
    crc = 0
    for part, n in parts:
        crc = (_times(_shift(n), crc) if crc else 0) ^ part if n else crc
    return crc


# --- the store ----------------------------------------------------------------------------------------------


def _lists(sizes: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values)


def _staged(docs: DataFrame, path: str, dtype: str, end_id: int, doc_id: str, text: str) -> DataFrame:
    """A row a document: its recipe, and those of its chunks that its task has not given yet."""
    chunk = T.StructType([T.StructField("address", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("ids", T.BinaryType())])
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("root", T.BinaryType()), T.StructField("addresses", T.ArrayType(T.BinaryType())), T.StructField("task", T.IntegerType()), T.StructField("chunks", T.ArrayType(chunk))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, given, task = encoder(path, dtype), set(), TaskContext.get().partitionId()
        end, width = np.array([end_id], dtype).tobytes(), np.dtype(dtype).itemsize
        for batch in batches:
            for part in row_slices(batch, text, BATCH_BYTES):
                streams = [ids + end for ids in own.encode_all(texts_of(part, text))]
                counts = [len(s) // width for s in streams]
                stream, ends = b"".join(streams), np.cumsum(counts)
                del streams
                roots, sizes, addresses, fresh = [], [], [], []
                news, sums_, payloads = [], [], []
                recipe, new, last, k = [], 0, 0, 0
                stops = ends.tolist()
                for cut in cuts(np.frombuffer(stream, dtype), ends):
                    ids = stream[last * width : cut * width]
                    address = hashlib.sha256(ids).digest()
                    recipe.append(address)
                    if address not in given:
                        given.add(address)
                        new += 1
                        fresh.append(address)
                        sums_.append(cut - last)
                        payloads.append(ids)
                    last = cut
                    if cut == stops[k]:
                        roots.append(merkle(recipe))
                        sizes.append(len(recipe))
                        news.append(new)
                        addresses += recipe
                        recipe, new, k = [], 0, k + 1
                made = pa.StructArray.from_arrays([pa.array(fresh, pa.binary()), pa.array(sums_, pa.int32()), pa.array(payloads, pa.binary())], ["address", "n", "ids"])
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(doc_id)), pa.array(counts, pa.int64()), pa.array(roots, pa.binary()), _lists(sizes, pa.array(addresses, pa.binary())), pa.array(np.full(len(counts), task, np.int32)), _lists(news, made)], schema.names)
        del given
        release()

    small_batches(docs.sparkSession, BATCH_BYTES)
    return docs.select(doc_id, text).mapInArrow(run, schema)


class TokenStore:
    """A store below `path`, a folder that every executor can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}")

    def write(self, docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", dtype: str = "<u2") -> None:
        staging = f"{self.path}/staging"
        _staged(docs, tokenizer, dtype, end_id, doc_id, text).write.options(compression="snappy", **PLAIN_FILES).parquet(staging)
        staged = self.spark.read.parquet(staging)
        # a task gives an address once. Only addresses are shuffled; where several tasks have one, the least task's is stored
        uses = staged.select("task", F.explode("chunks.address").alias("address"))
        several = uses.groupBy("address").agg(F.min("task").alias("first"), F.count(F.lit(1)).alias("tasks")).where("tasks > 1").select("address", "first")
        several = written(several, "store_several")
        fresh = staged.select("task", F.explode("chunks").alias("c")).select("task", "c.*")
        fresh = fresh.join(F.broadcast(several) if several.count() <= BROADCAST_ROWS else several, "address", "left")
        fresh.where("first is null or first = task").select("address", "n", "ids").write.options(compression="zstd", **PLAIN_FILES).parquet(f"{self.path}/chunks")
        rows = staged.select("doc_id", "n_tokens", "root", "addresses")
        files = max(1, -(-rows.count() // FILE_DOCS))
        # rows that repeat id and text are dealt out at random, since no file may hold them all
        order = [F.col("doc_id").asc_nulls_first(), F.col("n_tokens").asc(), F.col("root").asc()]
        ordered = rows.repartitionByRange(files, *order, F.rand(7)).sortWithinPartitions(*order)
        schema = T.StructType([T.StructField("file", T.IntegerType()), T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("file_start", T.LongType()), T.StructField("root", T.BinaryType()), T.StructField("addresses", T.ArrayType(T.BinaryType()))])

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            at, file = 0, TaskContext.get().partitionId()
            for batch in batches:
                n = batch.column("n_tokens").to_numpy()
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), file, np.int32)), batch.column("doc_id"), batch.column("n_tokens"), pa.array(starts), batch.column("root"), batch.column("addresses")], schema.names)

        ordered.mapInArrow(placed, schema).write.options(compression="zstd", **PLAIN_FILES).parquet(f"{self.path}/recipes")
        self._manifest().write.parquet(f"{self.path}/manifest")
        removed(self.spark, staging)

    def _roots(self) -> DataFrame:
        """Of each recipe file its documents, ids and Merkle root, hashed as the rows come."""
        schema = "file int, n_docs long, n_tokens long, root binary"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            file, docs, tokens, tree = None, 0, 0, Merkle()

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((file, pa.int32()), (docs, pa.int64()), (tokens, pa.int64()), (tree.root(), pa.binary()))], ["file", "n_docs", "n_tokens", "root"])

            for b in batches:
                for f, n, root in zip(*(b.column(c).to_pylist() for c in ("file", "n_tokens", "root")), strict=True):
                    if f != file and file is not None:
                        yield made()
                        docs, tokens, tree = 0, 0, Merkle()
                    file, docs, tokens = f, docs + 1, tokens + n
                    tree.add(root)
            if file is not None:
                yield made()

        rows = self._read("recipes").select("file", "file_start", "n_tokens", "root")
        return rows.repartition("file").sortWithinPartitions("file", "file_start").mapInArrow(run, schema)

    def _manifest(self) -> DataFrame:
        """Bounded by the number of recipe files, so made on the driver."""
        files = sorted(map(tuple, self._roots().collect()))
        at, rows = 0, []
        for file, docs, tokens, root in files:
            rows.append((file, docs, tokens, at, bytes(root)))
            at += tokens
        rows.append((-1, sum(r[1] for r in rows), at, 0, merkle([r[4] for r in rows])))
        return self.spark.createDataFrame(rows, "file int, n_docs long, n_tokens long, start long, root binary").coalesce(1)

    def verified_chunks(self, dtype: str = "<u2") -> DataFrame:
        """address, n, crc and bytes of each chunk's ids as unsigned 32-bit ones, read from the files; a chunk that doesn't hash to its address fails the job."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                crcs, sizes = [], []
                for address, ids in zip(b.column("address").to_pylist(), b.column("ids").to_pylist(), strict=True):
                    if hashlib.sha256(ids).digest() != address:
                        raise ValueError(f"chunk {address.hex()} is damaged")
                    wide = np.frombuffer(ids, dtype).astype("<u4").tobytes()
                    crcs.append(zlib.crc32(wide))
                    sizes.append(len(wide) // 4)
                yield pa.RecordBatch.from_arrays([b.column("address"), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int64())], ["address", "crc", "n"])

        return self._read("chunks").select("address", "ids").mapInArrow(run, "address binary, crc long, n long")

    def _placed(self) -> DataFrame:
        """The recipes with each document's start; the manifest has one row a recipe file."""
        starts = self._read("manifest").where("file >= 0").select("file", F.col("start").alias("base"))
        recipes = self._read("recipes").join(F.broadcast(starts) if starts.count() <= BROADCAST_ROWS else starts, "file", "left")
        return recipes.withColumn("start", F.col("base") + F.col("file_start"))

    def documents(self, dtype: str = "<u2") -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 and n_chunks, from the files and verified.

        The recipe files are held against the manifest first, then chunks against addresses and recipes against roots and
        lengths; a lost or damaged file, recipe or chunk raises an error.
        """
        self.check()
        uses = self._placed().select("start", "doc_id", "n_tokens", "root", F.posexplode("addresses").alias("at", "address"))
        # the root is carried once a document
        uses = uses.withColumn("root", F.when(F.col("at") == 0, F.col("root")))
        parts = uses.join(self.verified_chunks(dtype), "address", "left")
        grouped = parts.groupBy("start", "doc_id", "n_tokens").agg(F.max("root").alias("root"), F.array_sort(F.collect_list(F.struct("at", "address", "crc", "n"))).alias("found"))
        field = grouped.schema["doc_id"]
        schema = T.StructType([field, T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("n_chunks", T.IntegerType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = b.column("found")
                flat = found.flatten()
                addresses, parts, sizes = (flat.field(c).to_pylist() for c in ("address", "crc", "n"))
                counts = pc.list_value_length(found)
                crcs, at = [], 0
                for start, n, root, k in zip(b.column("start").to_pylist(), b.column("n_tokens").to_pylist(), b.column("root").to_pylist(), counts.to_pylist(), strict=True):
                    own = slice(at, at + k)
                    if None in parts[own]:
                        raise ValueError(f"the document at {start} lacks the chunk {addresses[at + parts[own].index(None)].hex()}")
                    if merkle(addresses[own]) != root or sum(sizes[own]) != n:
                        raise ValueError(f"the document at {start} can't be rebuilt")
                    crcs.append(crc_joined([(c, 4 * m) for c, m in zip(parts[own], sizes[own], strict=True)]))
                    at += k
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crcs, pa.int64()), counts.cast(pa.int32())], schema.names)

        return grouped.mapInArrow(run, schema)

    def read_ids(self, where=None, dtype: str = "<u2") -> DataFrame:
        """doc_id, start and ids (array of long) of the documents, or of those a condition on doc_id picks."""
        recipes = self._placed()
        recipes = recipes if where is None else recipes.where(where)
        uses = recipes.select("doc_id", "start", F.posexplode("addresses").alias("at", "address"))
        parts = uses.join(self._read("chunks").select("address", "ids"), "address", "left")
        whole = parts.groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"))
        schema = T.StructType([whole.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                parts = b.column("parts").to_pylist()
                if any(x["ids"] is None for p in parts for x in p):
                    raise ValueError("a chunk is lost")
                ids = [np.frombuffer(b"".join(x["ids"] for x in p), dtype).astype(np.int64) for p in parts]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(ids, pa.list_(pa.int64()))], schema.names)

        return whole.mapInArrow(run, schema)

    def check(self) -> None:
        """Raises an error unless the recipe files give the manifest: the same files, documents, ids and roots, and the whole store's root."""
        key = lambda r: (r["file"], r["n_docs"], r["n_tokens"], r["start"], bytes(r["root"]))
        old, new = ({r["file"]: key(r) for r in rows.collect()} for rows in (self._read("manifest"), self._manifest()))
        for file in sorted(old.keys() | new.keys(), reverse=True):
            if old.get(file) != new.get(file):
                raise ValueError(f"recipe file {file} isn't as the manifest says" if file >= 0 else "the store isn't as the manifest says")

    def verify(self) -> bool:
        """Whether the recipe files still give the manifest."""
        try:
            self.check()
        except ValueError:
            return False
        return True
