"""Language identification, word first with backoff to characters.

Training counts, over all learnable rows, how often each language uses each word; the character 1- to 4-grams of
every word (with its edges marked) are counted by the same weights. A known word is scored by its log
frequency in each language. An unseen word falls back to its 4-grams, or 3-, 2- and 1-grams where none of the
longer ones is known. A text's words add up, and the softmax over languages gives the score.

Counts are aggregated in each task, then by Spark, over all rows. A word is known if its share of a language's words, averaged over the
languages, is at least 1 / WORDS, an n-gram if its share of the n-grams of its order is at least 1 / GRAMS. Shares add up
to one, so at most WORDS words and GRAMS n-grams of each order are known whatever the corpus and the number of languages; that bounds
the broadcast model, and a share means the same at every size. Words of lesser share are scored by backoff.

Defined results: null text, and text without a letter, is `und` with score 0. Rows with null language
are not learned from; without any learnable row every text is `und`. Ties go to the language first in alphabetical order. Repeated
rows count as often as they stand. Other columns play no part; columns named lang_pred or score, in any case, are replaced by the
results. Very long texts are read whole. An empty table gives an empty result, and a model that knows no language.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from onomast.llm.chunks import ChunkTable, sums
from onomast.llm.common import others, release, row_slices, small_batches, worker_state, written

WORDS, GRAMS, ORDERS = 500_000, 200_000, (4, 3, 2, 1)
BATCH_BYTES = 2 << 20
#: Counted pieces that a task holds before it hands them on.
HELD = 100_000
#: Bytes of text after which it does so whatever their number.
HELD_BYTES = 32 << 20
RUN = re.compile(r"[^\W\d_]+")
#: Most that one word can say for one language against another.
CLIP = 7.0


def words_of(chunk: str) -> list[str]:
    """Runs of letters and numerals with a letter in them, lower case."""
    chunk = chunk.lower()
    if chunk.isalpha():
        return [chunk]
    if chunk[:-1].isalpha() and not chunk[-1].isalnum():
        return [chunk[:-1]]
    return [w for w in RUN.findall(chunk) if w.isalpha() or any(map(str.isalpha, w))]


def grams_of(word: str, order: int) -> list[str]:
    edged = f"^{word}$" if order > 1 else word
    return [edged[k : k + order] for k in range(len(edged) - order + 1)]


COUNTS = "lang string, item string, n long"


def _counted(counts: dict[str, dict[str, int]]) -> Iterator[pa.RecordBatch]:
    """The counts of each language, which are given away."""
    for name, own in counts.items():
        items, ns = list(own), list(own.values())
        own.clear()
        for k in range(0, len(items), 50_000):
            n = len(ns[k : k + 50_000])
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name), n), pa.array(items[k : k + 50_000], pa.string()), pa.array(ns[k : k + 50_000], pa.int64())], ["lang", "item", "n"])
    counts.clear()


def count_words(rows: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, item, n: how often each language uses each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        taken = 0

        def given() -> Iterator[pa.RecordBatch]:
            for name, chunks in held.items():
                words: dict[str, int] = {}
                get = words.get
                for chunk, n in chunks.items():
                    for w in words_of(chunk):
                        words[w] = get(w, 0) + n
                chunks.clear()
                yield from _counted({name: words})
            held.clear()

        for batch in batches:
            for part in row_slices(batch, text, BATCH_BYTES):
                for name, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    held.setdefault(name, Counter()).update((t or "").split())
                    taken += len(t or "")
                    if taken > HELD_BYTES or sum(map(len, held.values())) > HELD:
                        taken = 0
                        yield from given()
        yield from given()
        release()

    small_batches(rows.sparkSession)
    return rows.select(lang, text).mapInArrow(run, COUNTS).groupBy("lang", "item").agg(F.sum("n").alias("n"))


def count_grams(words: DataFrame) -> DataFrame:
    """lang, item, n of the character n-grams of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, int]] = {}
        for batch in batches:
            for name, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "item", "n")), strict=True):
                counts = held.setdefault(name, {})
                get = counts.get
                for order in ORDERS:
                    for g in grams_of(word, order):
                        counts[g] = get(g, 0) + n
                if len(counts) > HELD:
                    yield from _counted(held)
        yield from _counted(held)
        release()

    return words.mapInArrow(run, COUNTS).groupBy("lang", "item").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most: int, group: Column) -> tuple[pa.Table, dict]:
    """lang, item, n of the items whose mean share of their group's counts in a language is 1 / most or more, and (items, n) of each language and group."""
    tally = counts.groupBy("lang", group.alias("g")).agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("n"))
    totals = {(r["lang"], r["g"]): (r["items"], r["n"]) for r in tally.collect()}
    langs = len({lang for lang, _ in totals})
    of = counts.sparkSession.createDataFrame([(*k, n) for k, (_, n) in totals.items()], "lang string, g int, total long")
    # a row for each language and group
    shared = counts.withColumn("g", group.cast("int")).join(F.broadcast(of), ["lang", "g"])
    items = shared.groupBy("item").agg((F.sum(F.col("n") / F.col("total")) / max(1, langs)).alias("share"), F.collect_list(F.struct("lang", "n")).alias("of"))
    # 1e-9 for the rounding of sums
    known = items.where(F.col("share") >= (1 - 1e-9) / most).select("item", F.explode("of").alias("x")).select("x.lang", "item", "x.n")
    return known.toArrow(), totals


@dataclass
class Model:
    """Items' places in an array with a row of relative log scores for each."""

    langs: list[str]
    words: tuple[dict[str, int], np.ndarray]
    grams: tuple[dict[str, int], np.ndarray]
    stacked: np.ndarray | None = None

    def places(self, word: str) -> list[int]:
        """The word's row, or those of its longest known n-grams; n-grams' rows stand after the words'."""
        if (k := self.words[0].get(word)) is not None:
            return [k]
        get, base = self.grams[0].get, len(self.words[0])
        for order in ORDERS:
            known = [base + k for g in grams_of(word, order) if (k := get(g)) is not None]
            if known:
                return known
        return []

    def vectors(self, words: list[str]) -> np.ndarray:
        """Relative log scores; n-grams count as their mean, twice where there are two or more."""
        if self.stacked is None:
            self.stacked = np.concatenate([self.words[1], self.grams[1]])
        found = [self.places(w) for w in words]
        sizes = np.array([len(f) for f in found], np.int64)
        total = sums(self.stacked[np.array([k for f in found for k in f], np.int64)], sizes)
        total *= (np.minimum(sizes, 2) / np.maximum(sizes, 1))[:, None]
        return np.maximum(total - total.max(axis=1, keepdims=True), -CLIP) if total.size else total

    def chunks(self, chunks: list[str]) -> np.ndarray:
        """The summed vectors of each piece's words, then whether it has a letter."""
        found = [words_of(c) for c in chunks]
        sizes = np.array([len(f) for f in found], np.int64)
        scores = sums(self.vectors([w for f in found for w in f]), sizes)
        return np.concatenate([scores.reshape(len(chunks), len(self.langs)), (sizes > 0)[:, None]], axis=1)


def _vectors(found: pa.Table, totals: dict, langs: list[str], group) -> tuple[dict[str, int], np.ndarray]:
    at = {name: k for k, name in enumerate(langs)}
    index: dict[str, int] = {}
    place = np.array([index.setdefault(x, len(index)) for x in found.column("item").to_pylist()], np.int64)
    counts = np.zeros((len(index), len(langs)))
    counts[place, [at[x] for x in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
    of = [group(x) for x in index]
    sizes = {}
    for g in set(of):
        own = [totals.get((name, g), (0, 0)) for name in langs]
        sizes[g] = [t[1] + 0.5 * max(x[0] for x in own) + 1 for t in own]
    logs = np.log((counts + 0.5) / np.array([sizes[g] for g in of]).reshape(-1, max(1, len(langs)))[:, : len(langs)])
    best = logs.max(axis=1, keepdims=True) if logs.size else logs
    return index, np.maximum(logs - best, -CLIP).astype(np.float32)


def train(rows: DataFrame, text: str = "text", lang: str = "lang", words: int = WORDS, grams: int = GRAMS) -> Model:
    """Learns from all given rows that have a language."""
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counted = written(count_words(rows, text, lang), "lang_words")
    frequent, totals = _frequent(counted, words, F.lit(0))
    langs = sorted({k[0] for k in totals})
    char_counts = written(count_grams(counted), "lang_grams")
    often, char_totals = _frequent(char_counts, grams, F.char_length("item"))
    return Model(langs, _vectors(frequent, totals, langs, lambda _: 0), _vectors(often, char_totals, langs, len))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The columns of docs with lang_pred and score; columns of these names, in any case, are replaced."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    small_batches(docs.sparkSession)
    names = others(docs.columns, "lang_pred", "score")
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        table = worker_state(key, lambda: ChunkTable(own.chunks))
        for batch in batches:
            for part in row_slices(batch, text, BATCH_BYTES):
                chunks: list[str] = []
                counts = []
                for t in part.column(part.schema.get_field_index(text)).to_pylist():
                    found = (t or "").split()
                    counts.append(len(found))
                    chunks += found
                at = table.numbers(chunks)
                total = sums(table.rows[at], np.array(counts, np.int64))
                langs, scores = [], []
                for row in total:
                    if row[-1] == 0 or not own.langs:
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    p = np.exp(row[:-1] - row[:-1].max())
                    langs.append(own.langs[int(p.argmax())])
                    scores.append(float(p.max() / p.sum()))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in names] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema.names)
        release()

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)
