"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its hashed words and word parts, and the document's
is their noisy-or: 1 - prod(1 - p). Only document labels are known; the loss on the noisy-or sends its gradient to
the sentences that explain the label, so the trained model locates offending sentences too.

With a = sum over sentences of softplus(z), the noisy-or is 1 - exp(-a): the loss of a document is
-log(1 - exp(-a)) or a, and its gradient by z is that by a times sigmoid(z).

Training takes a bounded sample, by a hash of id and text: about SAMPLE labelled rows, and at most about SAMPLE_BYTES of their text (stated
parameters; all of them if there are fewer). Their hashed sentences are made by Spark and meet on the driver, 4 bytes a
word. Scoring is a narrow pass over all rows.

Defined results: null and empty texts have one empty sentence, so they get the bias's score. A document with several
labels is learned from once a label; labels of unknown documents or null labels are ignored. Without labels of
both kinds every score is 0. Repeated rows are scored alike. Very long texts are scored whole. Other columns play
no part; columns named score, predicted or offending, in any case, are replaced. An empty table gives an empty result, and no model but zeros.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from onomast.llm.chunks import ChunkTable, sums
from onomast.llm.common import others, release, row_slices, small_batches, worker_state

BITS = 18
SAMPLE, SAMPLE_BYTES = 16_000, 48 << 20
#: Bytes of pieces that a worker remembers (in each of two generations).
CACHE = 48 << 20
BATCH_BYTES = 2 << 20
EPOCHS, BATCH, RATE, DECAY, SPARSITY, LEAST_DOCS = 10, 128, 0.2, 1e-3, 0.02, 5
THRESHOLD = 0.3
RUN = re.compile(r"\w+")
STOP = (".", "!", "?", "…", "。", "！", "？")


def pieces(text: str) -> list[str]:
    """Pieces between white space; line ends stand alone."""
    return text.replace("\n", " \n ").split(" ") if "\n" in text else text.split(" ")


def ends(piece: str) -> bool:
    return piece == "\n" or piece.rstrip("\"')]}»”*#$%&").endswith(STOP)


def features(word: str) -> list[int]:
    """Hashes of a word, its beginnings and its endings: unseen words share the parts of seen ones."""
    n = len(word)
    parts = [f"={word}", *(f"^{word[:k]}" for k in (3, 4, 5, 6) if n > k), *(f"{word[-k:]}$" for k in (3, 4, 5) if n > k)]
    return [zlib.crc32(x.encode()) & ((1 << BITS) - 1) for x in parts]


def words(piece: str) -> list[str]:
    return RUN.findall(piece.lower())


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence that has words, or one empty sentence. A piece counts once a sentence, a word once a piece."""
    out: list[list[str]] = []
    now: dict[str, set[str]] = {}

    def close() -> None:
        out.append(sorted(w for found in now.values() for w in found))
        now.clear()

    for p in pieces(text):
        if p not in now and (found := set(words(p))):
            now[p] = found
        if ends(p) and now:
            close()
    if now or not out:
        close()
    return out


@dataclass
class Bags:
    """Documents as words of a vocabulary, and the features of its words."""

    labels: np.ndarray
    n_sentences: np.ndarray  # of each document
    n_words: np.ndarray  # of each sentence
    words: np.ndarray
    n_features: np.ndarray  # of each word of the vocabulary
    features: np.ndarray

    def __post_init__(self) -> None:
        self.sentence_at = np.cumsum(self.n_sentences) - self.n_sentences
        self.word_at = np.cumsum(self.n_words) - self.n_words
        self.feature_at = np.cumsum(self.n_features) - self.n_features

    def features_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.n_features[words]
        return self.features[_ranges(self.feature_at[words], counts)], counts

    def batch(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, words of each sentence, sentences of each document."""
        per_doc = self.n_sentences[docs]
        lines = _ranges(self.sentence_at[docs], per_doc)
        counts = self.n_words[lines]
        return self.words[_ranges(self.word_at[lines], counts)], counts, per_doc


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def pieces(self, found: list[str]) -> np.ndarray:
        """Of each piece its words' weights, how many features they have, and whether it ends a sentence."""
        made = [[f for w in set(words(p)) for f in features(w)] for p in found]
        sizes = np.array([len(m) for m in made], np.int64)
        total = sums(self.weights[np.array([f for m in made for f in m], np.int64)], sizes)
        return np.stack([total, sizes, np.array([ends(p) for p in found], bool)], axis=1)

    def scores(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(bags: Bags, epochs: int = EPOCHS) -> Model:
    """Adaptive gradient steps over shuffled batches, with weights shrunk to zero where the data don't hold them."""
    size, labels = 1 << BITS, bags.labels
    w = np.zeros(size)
    if len(np.unique(labels)) < 2:
        return Model(w.astype(np.float32), -1e6)
    seen = np.zeros(size, np.int64)
    for d in range(len(labels)):
        seen[np.unique(bags.features_of(np.unique(bags.batch(np.array([d]))[0]))[0])] += 1
    usable = seen >= LEAST_DOCS
    b = float(np.log(labels.mean() / bags.n_sentences.mean()))
    cache, b_cache = np.ones(size), 1.0
    draw = np.random.default_rng(7)
    for _ in range(epochs):
        order = draw.permutation(len(labels))
        for k in range(0, len(order), BATCH):
            docs = order[k : k + BATCH]
            flat, counts, per_doc = bags.batch(docs)
            distinct, at = np.unique(flat, return_inverse=True)
            own, n_own = bags.features_of(distinct)
            z = b + sums(sums(w[own], n_own)[at], counts)
            a = np.maximum(sums(np.logaddexp(0, z), per_doc), 1e-9)
            by_a = np.where(labels[docs] == 1, -1 / np.expm1(np.minimum(a, 50)), 1.0)
            g = np.repeat(by_a, per_doc) / (1 + np.exp(-z))
            by_word = np.bincount(at, np.repeat(g, counts), minlength=len(distinct))
            grad = np.bincount(own, np.repeat(by_word, n_own), minlength=size)
            touched = np.unique(own)
            touched = touched[usable[touched]]
            step = grad[touched] + DECAY * w[touched]
            cache[touched] += step * step
            rate = RATE / np.sqrt(cache[touched])
            moved = w[touched] - rate * step
            w[touched] = np.sign(moved) * np.maximum(np.abs(moved) - rate * SPARSITY, 0)
            b_cache += g.sum() ** 2
            b -= RATE * g.sum() / np.sqrt(b_cache)
    return Model(w.astype(np.float32), b)


def _collected(rows: DataFrame) -> Bags:
    """(h, text, y) as bags: words travel as hashes, each with its features once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in batches:
            for part in row_slices(batch, "text", BATCH_BYTES):
                out: dict = {k: [] for k in ("n_words", "words", "fresh", "n_features", "features")}
                for t in part.column(part.schema.get_field_index("text")).to_pylist():
                    found = sentences(t or "")
                    ids = [zlib.crc32(w.encode()) - (1 << 31) for s in found for w in s]
                    new = {i: w for i, w in zip(ids, (w for s in found for w in s), strict=True) if i not in given}
                    given.update(new)
                    made = [features(w) for w in new.values()]
                    for k, v in zip(out, ([len(s) for s in found], ids, list(new), [len(m) for m in made], [f for m in made for f in m]), strict=True):
                        out[k].append(v)
                names = ("h", "y")
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in names] + [pa.array(v, pa.list_(pa.int32())) for v in out.values()], [*names, *out])

    lists = ", ".join(f"{k} array<int>" for k in ("n_words", "words", "fresh", "n_features", "features"))
    small_batches(rows.sparkSession)
    made = rows.select("h", "text", "y").mapInArrow(run, f"h long, y int, {lists}").toArrow().combine_chunks()
    flat = lambda t, c: pc.list_flatten(t.column(c)).combine_chunks().to_numpy()
    n_features, features_, ids = flat(made, "n_features"), flat(made, "features"), flat(made, "fresh")
    # one copy of each word's features, and the documents in an order that doesn't depend on the tasks
    vocabulary, first = np.unique(ids, return_index=True)
    starts = (np.cumsum(n_features) - n_features)[first]
    made = made.select(["h", "y", "n_words", "words"]).sort_by([("h", "ascending"), ("y", "ascending")])
    return Bags(
        made.column("y").to_numpy(), pc.list_value_length(made.column("n_words")).to_numpy(), flat(made, "n_words"),
        np.searchsorted(vocabulary, flat(made, "words")).astype(np.int32), n_features[first], features_[_ranges(starts, n_features[first])],
    )


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learns from about `sample` of the labelled rows, or fewer that hold about `sample_bytes` of text, picked by a hash of id and text."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("string").alias("id"), F.col(label).cast("int").alias("y")).distinct()
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id), F.col(text)).alias("h"))
    sizes = rows.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).join(known, "id")
    total, size = sizes.agg(F.count(F.lit(1)), F.sum("n")).first()
    share = min(1.0, sample / max(1, total), sample_bytes / max(1, size or 0))
    if share < 1:
        # the hash alone decides; texts are read again for the picked rows only
        rows = rows.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    return fit(_collected(rows.join(known, "id").dropDuplicates(["h", "y"])))


def predict(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The columns of docs with score, predicted and offending: for predicted documents the (start, end, score) of sentences at or above the threshold, else their best one."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    small_batches(docs.sparkSession)
    names = others(docs.columns, "score", "predicted", "offending")
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("offending", T._parse_datatype_string("array<struct<start:int,end:int,score:double>>"))])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        table = worker_state(key, lambda: ChunkTable(own.pieces, CACHE))
        for batch in batches:
            for part in row_slices(batch, text, BATCH_BYTES):
                split = [pieces(t or "") for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                counts = np.array([len(p) for p in split], np.int64)
                at = table.numbers([p for d in split for p in d])
                rows = table.rows[at]
                last = np.cumsum(counts) - 1
                stop = rows[:, 2] > 0
                stop[last] = True
                close = np.flatnonzero(stop)
                sizes = np.diff(np.concatenate([[-1], close]))
                # a piece counts once a sentence
                line = np.repeat(np.arange(len(close)), sizes)
                _, once = np.unique(line * (len(table.rows) + 1) + at, return_index=True)
                both = np.stack([np.bincount(line[once], rows[once, k], minlength=len(close)) for k in (0, 1)], axis=1)
                doc = np.searchsorted(last, close)
                z = own.bias + both[:, 0]
                # sentences without words say nothing, but for a document without any
                worded = both[:, 1] > 0
                some = np.bincount(doc, worded, minlength=len(split)) > 0
                first = np.concatenate([[True], np.diff(doc) != 0])
                counted = worded | (first & ~some[doc])
                a = np.bincount(doc, np.where(counted, np.logaddexp(0, z), 0), minlength=len(split))
                score = -np.expm1(-a)
                spans: list = [[] for _ in split]
                p = own.scores(z)
                for d in np.flatnonzero(score >= threshold).tolist():
                    mine = np.flatnonzero(doc == d)
                    mine = mine[counted[mine]]
                    hot = mine[p[mine] >= threshold]
                    hot = hot if len(hot) else mine[[int(p[mine].argmax())]]
                    begin = int(last[d] - counts[d] + 1)
                    for s in hot.tolist():
                        i, j = int(close[s] - sizes[s] + 1) - begin, int(close[s]) - begin
                        spans[d].append({"start": _place(split[d], i), "end": _place(split[d], j) + len(split[d][j]), "score": float(p[s])})
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in names] + [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32)), pa.array(spans, kind)], schema.names)
        release()

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def _place(split: list[str], k: int) -> int:
    """Where a piece starts in the text that pieces() split."""
    at = 0
    for i in range(k):
        at += len(split[i])
        # a space stood here unless pieces() put it beside a line end
        at += split[i] != "\n" and split[i + 1] != "\n"
    return at
