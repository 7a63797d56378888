"""A quality classifier from weak labels.

Overlapping heuristic labellers vote good (1), poor (0) or abstain (2) on every document. Expectation-maximisation
(the Dawid-Skene model) estimates each labeller's vote probabilities in either class and the classes' share, from the
counts of all vote patterns: there are at most 3 ** labellers of them whatever the corpus, so Spark counts
them over all rows and the driver iterates on the exact counts. A document's posterior follows from its pattern.

The posteriors of a bounded sample, by a hash of id and text (about SAMPLE rows and at most about SAMPLE_BYTES of their text, stated
parameters; rows that repeat both count once), then train a linear scorer on hashed words, word shapes and document measures, which scores every row.

Defined results: null and empty texts have no words; they are scored by their measures alone. Repeated rows are scored alike;
other columns play no part, and columns named weak_label, score or keep, in any case, are replaced by the results. Very long texts are measured and scored whole. An empty table gives a model
without weights and an empty result.
"""

from __future__ import annotations

import math
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
from onomast.llm.common import ChunkCache, others, release, row_slices, small_batches, worker_state, written

BITS, SAMPLE, SAMPLE_BYTES = 16, 16_000, 48 << 20
#: Bytes of pieces that a worker remembers (in each of two generations).
CACHE = 48 << 20
BATCH_BYTES = 2 << 20
EM_ROUNDS, EPOCHS, BATCH, RATE, DECAY, SCALE = 60, 8, 128, 0.2, 1e-4, 8.0
LABELLERS = ("bare_marks", "doubled_marks", "echoes", "bars", "sentence_ends", "repeated_lines", "distinct_words", "symbols", "capitals")
SYMBOLS = "#$%&*<>{}=~^\\"
BARE = re.compile(r"(?<!\S)[^\w\s]+(?!\S)")
DOUBLED = re.compile(r"([!#$%&*?=~^])\1")


def measures(text: str) -> dict[str, float]:
    """What the labellers look at."""
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n = max(1, len(words))
    return {
        "length": len(words),
        "line_words": len(words) / max(1, len(lines)),
        "bare_marks": len(BARE.findall(text)) / n,
        "doubled_marks": len(DOUBLED.findall(text)) / n,
        "echoes": sum(map(str.__eq__, words, words[1:])) / n,
        "bars": text.count("|") / n,
        "sentence_ends": sum(map(text.count, ".!?")) / n,
        "repeated_lines": 1 - len(set(lines)) / max(1, len(lines)),
        "distinct_words": len(set(words)) / n,
        "symbols": sum(map(text.count, SYMBOLS)) / n,
        "capitals": sum(map(str.isupper, words)) / n,
    }


def votes(m: dict[str, float]) -> list[int]:
    """One vote a labeller: 1 good, 0 poor, 2 abstains."""
    pick = lambda poor, good: 0 if poor else 1 if good else 2
    n = m["length"]
    return [
        pick(m["bare_marks"] > 0.1, m["bare_marks"] < 0.02),
        pick(m["doubled_marks"] > 0.1, m["doubled_marks"] < 0.01),
        pick(m["echoes"] > 0.1, n >= 30 and m["echoes"] < 0.04),
        pick(m["bars"] > 0.05, m["bars"] == 0),
        pick(n >= 20 and m["sentence_ends"] < 0.02, 0.04 <= m["sentence_ends"] <= 0.35),
        pick(m["repeated_lines"] > 0.2, False),
        pick(n >= 30 and m["distinct_words"] < 0.45, n >= 30 and m["distinct_words"] > 0.6),
        pick(m["symbols"] > 0.05, m["symbols"] < 0.01),
        pick(n >= 8 and m["capitals"] > 0.25, m["capitals"] < 0.05),
    ]


def pattern(found: list[int]) -> int:
    out = 0
    for v in found:
        out = out * 3 + v
    return out


def unpacked(code: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        code, v = divmod(code, 3)
        out.append(v)
    return out[::-1]


@dataclass
class Labels:
    """Share of good documents, and each labeller's vote probabilities in the poor and the good class."""

    share: float
    tables: np.ndarray  # labeller, class, vote

    def posterior(self, codes: list[int]) -> np.ndarray:
        """Of being good; a labeller that abstains says nothing."""
        v = np.array([unpacked(c) for c in codes], np.int64).reshape(len(codes), len(LABELLERS))
        voted = self.tables[:, :, :2] / self.tables[:, :, :2].sum(axis=2, keepdims=True)
        logs = np.concatenate([np.log(voted), np.zeros((len(LABELLERS), 2, 1))], axis=2)
        at = np.arange(len(LABELLERS))
        poor = math.log(1 - self.share) + logs[at, 0, v].sum(axis=1)
        good = math.log(self.share) + logs[at, 1, v].sum(axis=1)
        return 1 / (1 + np.exp(np.clip(poor - good, -500, 500)))

    def accuracy(self) -> dict[str, float]:
        """How often a labeller is right when it votes."""
        joint = self.tables * np.array([1 - self.share, self.share])[None, :, None]
        right = joint[:, 0, 0] + joint[:, 1, 1]
        return dict(zip(LABELLERS, (right / joint[:, :, :2].sum(axis=(1, 2))).tolist(), strict=True))


def estimate(counts: dict[int, int], rounds: int = EM_ROUNDS) -> Labels:
    """Expectation-maximisation from the counts of vote patterns. It begins with labellers that seldom call a good document poor."""
    n_labellers = len(LABELLERS)
    start = Labels(0.8, np.tile(np.array([[0.3, 0.4, 0.3], [0.004, 0.696, 0.3]]), (n_labellers, 1, 1)))
    if not counts:
        return start
    codes = sorted(counts)
    weight = np.array([counts[c] for c in codes], float)
    v = np.array([unpacked(c) for c in codes], np.int64)
    labels = start
    for _ in range(rounds):
        good = labels.posterior(codes)
        share = float(np.clip((weight * good).sum() / weight.sum(), 0.01, 0.99))
        tables = np.zeros((n_labellers, 2, 3))
        for c, q in ((0, 1 - good), (1, good)):
            for x in range(3):
                tables[:, c, x] = ((v == x) * (weight * q)[:, None]).sum(axis=0)
        # the start counts as ten documents, which keeps every probability above zero
        tables += 10 * start.tables
        labels = Labels(share, tables / tables.sum(axis=2, keepdims=True))
    return labels


def shape(piece: str) -> str:
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", "x", re.sub(r"[A-ZÀ-ÖØ-Þ]", "X", piece))))[:12]


def _hash(x: str) -> int:
    return zlib.crc32(x.encode()) & ((1 << BITS) - 1)


def piece_features(piece: str) -> tuple[int, int]:
    return _hash("w" + piece.lower()), _hash("s" + shape(piece))


def text_features(m: dict[str, float]) -> list[int]:
    """Hashed measures, each in steps."""
    out = [_hash(f"m:length:{int(math.log2(m['length'] + 1))}"), _hash(f"m:line_words:{int(2 * math.log2(m['line_words'] + 1))}")]
    return out + [_hash(f"m:{k}:{int(m[k] * 10)}") for k in LABELLERS]


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def pieces(self, found: list[str]) -> np.ndarray:
        at = np.array([piece_features(p) for p in found], np.int64).reshape(-1, 2)
        return self.weights[at].sum(axis=1, keepdims=True)


def fit(flat: np.ndarray, counts: np.ndarray, measured: np.ndarray, target: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Logistic regression on soft labels: words and shapes count by their share of the text times SCALE, measures by one."""
    size = 1 << BITS
    w, b = np.zeros(size), 0.0
    cache, b_cache = np.ones(size), 1.0
    starts = np.cumsum(counts) - counts
    draw = np.random.default_rng(5)
    for _ in range(epochs):
        order = draw.permutation(len(target))
        for k in range(0, len(order), BATCH):
            docs = order[k : k + BATCH]
            n = counts[docs]
            at = flat[np.arange(n.sum()) + np.repeat(starts[docs] - (np.cumsum(n) - n), n)]
            value = SCALE / np.maximum(n / 2, 1)
            z = b + sums(w[at], n) * value + w[measured[docs]].sum(axis=1)
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[docs]
            grad = np.bincount(at, np.repeat(g * value, n), minlength=size) + np.bincount(measured[docs].ravel(), np.repeat(g, measured.shape[1]), minlength=size)
            touched = np.flatnonzero(grad)
            step = grad[touched] + DECAY * w[touched]
            cache[touched] += step * step
            w[touched] -= RATE * step / np.sqrt(cache[touched])
            b_cache += g.sum() ** 2
            b -= RATE * g.sum() / np.sqrt(b_cache)
    return Model(w.astype(np.float32), float(b))


def vote(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, h (a hash of the text) and pattern of each row."""
    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), T.StructField("h", T.LongType()), T.StructField("pattern", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [pattern(votes(measures(t or ""))) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(codes, pa.int32())], schema.names)

    small_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("t")).mapInArrow(run, schema)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> tuple[Labels, Model]:
    """The labellers' model from all rows, and the scorer from the posteriors of at most about `sample` rows."""
    tally = written(vote(docs, doc_id, text), "quality_votes").groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {r["pattern"]: r["n"] for r in tally}
    labels = estimate(counts)
    total = sum(counts.values())
    if not total:
        return labels, Model(np.zeros(1 << BITS, np.float32), 0.0)
    rows = docs.select(F.col(text).alias("t"), F.xxhash64(F.col(doc_id), F.col(text)).alias("h"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    share = min(1.0, sample / total, sample_bytes / max(1, size))
    if share < 1:
        rows = rows.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = rows.dropDuplicates(["h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ChunkCache(piece_features)
        for batch in batches:
            for part in row_slices(batch, "t", BATCH_BYTES):
                known.trim()
                out: list[list] = [[], [], []]
                for t in part.column(0).to_pylist():
                    m = measures(t or "")
                    for x, v in zip(out, (pattern(votes(m)), text_features(m), [f for p in (t or "").split() for f in known[p]]), strict=True):
                        x.append(v)
                yield pa.RecordBatch.from_arrays([part.column(1), *(pa.array(x, k) for x, k in zip(out, (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True))], ["h", "pattern", "measured", "words"])

    # the hash bounds the rows, and every task of the scan makes its own share of the features
    made = rows.mapInArrow(run, "h long, pattern int, measured array<int>, words array<int>").toArrow().combine_chunks().sort_by("h")
    flat = lambda c: pc.list_flatten(made.column(c)).combine_chunks().to_numpy()
    target = labels.posterior(made.column("pattern").to_pylist())
    counts_ = pc.list_value_length(made.column("words")).to_numpy()
    return labels, fit(flat("words"), counts_, flat("measured").reshape(len(target), -1), target)


def predict(docs: DataFrame, labels: Labels, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The columns of docs with weak_label (the posterior), score and keep."""
    shared, key = docs.sparkSession.sparkContext.broadcast((labels, model)), uuid.uuid4().hex
    small_batches(docs.sparkSession)
    names = others(docs.columns, "weak_label", "score", "keep")
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("weak_label", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("keep", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weak, own = shared.value
        table = worker_state(key, lambda: ChunkTable(own.pieces, CACHE))
        for batch in batches:
            for part in row_slices(batch, text, BATCH_BYTES):
                texts = [t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                found = [measures(t) for t in texts]
                split = [t.split() for t in texts]
                counts = np.array([len(s) for s in split], np.int64)
                at = table.numbers([p for s in split for p in s])
                z = own.bias + sums(table.rows[at], counts)[:, 0] * (SCALE / np.maximum(counts, 1))
                z += own.weights[np.array([text_features(m) for m in found], np.int64)].sum(axis=1)
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                made = [pa.array(weak.posterior([pattern(votes(m)) for m in found])), pa.array(score), pa.array(score >= threshold)]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in names] + made, schema.names)
        release()

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)
