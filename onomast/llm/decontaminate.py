"""Benchmark decontamination with suffix arrays over shards of the training text.

Arrow batches of documents make shards. A shard's words become ids of the benchmark's vocabulary (0: a word
that no benchmark item has, which ends every match), the suffixes that can hold a window are sorted into a
suffix array, and every distinct benchmark window is binary-searched in it; equal windows of many items are searched
once. A document lies wholly inside one shard, so the matches need no shuffle: the operator is one narrow pass over the documents.

The longest match of a document follows in the benchmark's own suffix array: the range of a hit's window is narrowed word
by word while the document goes on alike.

A benchmark beyond BLOCK_BYTES is matched block by block. All passes but the last give only the finds of the texts that are hit,
under the text's hash; the last pass adds them to its own.

Defined results: null and empty texts have no words and are never contaminated; repeated rows are judged
each on its own; items without words (or null) match nothing; several items with the same id count once; a null item_id
still hits words but is listed nowhere. Of equally long matches the first in the document counts, then the least item id and word.
Other columns pass through untouched; columns named as the results, in any case, are replaced (by `decontaminate` kept). An empty table
gives an empty result, an empty benchmark hits nothing. Very long texts are read whole; a text of more than a shard's bytes is a shard of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from onomast.llm.common import others, release, row_slices, small_batches, unused, written

WINDOW = 13
#: Text bytes of one shard's suffix array.
SHARD_BYTES = 4 << 20
#: Bytes of benchmark text that one block broadcasts; a larger benchmark is matched block by block.
BLOCK_BYTES = 8 << 20
#: Item ids in a batch of results, about.
RESULT_ITEMS = 100_000

#: Lower-cases A-Z and turns every ASCII character that is neither a letter nor a digit into a space.
WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text: runs of ASCII letters, digits and all non-ASCII characters."""
    return text.translate(WORD_BYTES).split()


class Packed:
    """Token ids packed several to a 64-bit key, first word highest, so that keys compare as word runs."""

    def __init__(self, vocabulary: int):
        self.bits = 16 if vocabulary < 1 << 16 else 32
        self.per = 64 // self.bits

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        padded = np.concatenate([tokens, np.zeros(self.per, tokens.dtype)]).astype(np.uint64)
        out = np.zeros(len(tokens), np.uint64)
        for k in range(self.per):
            out |= padded[k : k + len(tokens)] << np.uint64(self.bits * (self.per - 1 - k))
        return out

    def mask(self, kept: np.ndarray) -> np.ndarray:
        """Keeps the first `kept` words of a key, 0 to per of them."""
        kept = np.clip(kept, 0, self.per)
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        shift = np.where(kept == 0, 0, 64 - self.bits * kept).astype(np.uint64)
        return np.where(kept == 0, np.uint64(0), full << shift)


def suffix_array(keys: np.ndarray, positions: np.ndarray, per: int, depth: int) -> np.ndarray:
    """The positions in the order of their suffixes, compared to `depth` words; only ties are compared further."""
    if not len(positions):
        return positions
    first = keys[positions]
    by = np.argsort(first, kind="stable")
    order, group = positions[by], np.cumsum(np.concatenate([[False], np.diff(first[by]) != 0]))
    for at in range(per, depth, per):
        same = np.diff(group) == 0
        tied = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        if not len(tied):
            break
        key, old = keys[np.minimum(order[tied] + at, len(keys) - 1)], group[tied]
        by = np.lexsort((key, old))
        order[tied] = order[tied][by]
        key, old = key[by], old[by]
        new = np.concatenate([[False], (np.diff(key) != 0) | (np.diff(old) != 0)])
        opens = np.concatenate([[False], np.diff(group) != 0])
        opens[tied] |= new
        group = np.cumsum(opens)
    return order


def search(keys: np.ndarray, order: np.ndarray, queries: np.ndarray, pack: Packed, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window the range of the suffix array whose suffixes begin with it, by binary search."""
    per = pack.per
    blocks = -(-int(lengths.max()) // per)
    wanted, masks = [], []
    for b in range(blocks):
        mask = pack.mask(lengths - b * per)
        masks.append(mask)
        wanted.append(queries[np.minimum(starts + b * per, len(queries) - 1)] & mask)

    def bound(upper: bool) -> np.ndarray:
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(order), np.int64)
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                return low
            mid = (low[live] + high[live]) // 2
            at = order[mid]
            less, open_ = np.zeros(len(live), bool), np.ones(len(live), bool)
            for b in range(blocks):
                have, want = keys[np.minimum(at + b * per, len(keys) - 1)] & masks[b][live], wanted[b][live]
                less |= open_ & (have < want)
                open_ &= have == want
            right = less | (open_ & upper)
            low[live[right]] = mid[right] + 1
            high[live[~right]] = mid[~right]

    return bound(False), bound(True)


@dataclass
class Benchmark:
    """The words of a block of benchmark items, their suffix array, and the distinct windows."""

    vocab: dict[bytes, int]
    names: list[str | None]
    tokens: np.ndarray  # all items, a 0 after each
    item_of: np.ndarray  # of each token
    first: np.ndarray  # token of each item
    order: np.ndarray  # the suffix array
    starts: np.ndarray  # of the distinct windows
    lengths: np.ndarray
    low: np.ndarray  # the windows' ranges in the suffix array
    high: np.ndarray
    item_at: np.ndarray  # where a window's items begin in `items`
    items: np.ndarray

    @staticmethod
    def of(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Benchmark:
        vocab: dict[bytes, int] = {}
        names, tokens, item_of, first = [], [], [], []
        windows: dict[bytes, tuple[int, int, list[int]]] = {}
        deepest = 0
        for name, text in sorted(items, key=lambda x: (x[0] is not None, x[0] or "", x[1] or "")):
            ids = [vocab.setdefault(w, len(vocab) + 1) for w in words((text or "").encode())]
            if not ids:
                continue
            n, at, size = len(ids), len(tokens), min(window, len(ids))
            raw = np.array(ids, np.int32).tobytes()
            for k in range(n - size + 1):
                _, _, own = windows.setdefault(raw[4 * k : 4 * (k + size)], (at + k, size, []))
                if not own or own[-1] != len(names):
                    own.append(len(names))
            deepest = max(deepest, n)
            first.append(at)
            tokens += [*ids, 0]
            item_of += [len(names)] * (n + 1)
            names.append(name)
        found = list(windows.values())
        small = lambda x: np.array(x, np.int32)
        whole, starts, lengths = small(tokens), small([f[0] for f in found]), small([f[1] for f in found])
        counts = [len(f[2]) for f in found]
        listed = small([i for f in found for i in f[2]])
        low = high = order = small([])
        if found:
            pack = Packed(len(vocab))
            keys = pack.keys(whole)
            order = suffix_array(keys, np.flatnonzero(whole), pack.per, deepest)
            low, high = search(keys, order, keys, pack, starts.astype(np.int64), lengths)
        return Benchmark(vocab, names, whole, small(item_of), small(first), small(order), starts, lengths, small(low), small(high), np.cumsum([0, *counts]), listed)

    def items_of(self, windows: np.ndarray) -> list[str]:
        """The names of the items that have one of the windows, sorted."""
        own = {i for w in windows.tolist() for i in self.items[self.item_at[w] : self.item_at[w + 1]].tolist()}
        return sorted({n for i in own if (n := self.names[i]) is not None})


def longest(bench: Benchmark, tokens: np.ndarray, at: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place that a window hits: the words of the longest match from there, and its range in the benchmark's suffix array."""
    size = bench.lengths[windows].astype(np.int64)
    low, high = bench.low[windows].astype(np.int64), bench.high[windows].astype(np.int64)
    last = len(bench.tokens) - 1
    live = np.arange(len(at))
    while len(live):
        word = tokens[at[live] + size[live]]
        bounds = []
        for upper in (False, True):
            a, z = low[live].copy(), high[live].copy()
            while len(open_ := np.flatnonzero(a < z)):
                mid = (a[open_] + z[open_]) // 2
                have = bench.tokens[np.minimum(bench.order[mid] + size[live[open_]], last)]
                right = (have <= word[open_]) if upper else (have < word[open_])
                a[open_[right]] = mid[right] + 1
                z[open_[~right]] = mid[~right]
            bounds.append(a)
        on = (bounds[0] < bounds[1]) & (word != 0)
        live = live[on]
        low[live], high[live] = bounds[0][on], bounds[1][on]
        size[live] += 1
    return size, low, high


def match(texts: list[bytes], bench: Benchmark) -> list[tuple[int, list[tuple[int, int]], np.ndarray, tuple | None]]:
    """Of each document: words, hit intervals, distinct windows that occur, and the longest verbatim match (words, document word, item, item word)."""
    get, counts, flat = bench.vocab.get, [], []
    for t in texts:
        found = words(t)
        counts.append(len(found))
        flat += [get(w, 0) for w in found]
        flat.append(0)
    none = np.zeros(0, np.int64)
    out = [(n, [], none, None) for n in counts]
    if not len(bench.starts):
        return out
    pack = Packed(len(bench.vocab))
    tokens = np.concatenate([np.array(flat, np.int32), np.zeros(pack.per, np.int32)])
    # words from each position to the next word that no item has
    index = np.arange(len(tokens), dtype=np.int32)
    ends = np.where(tokens == 0, index, np.int32(len(tokens)))
    run = np.minimum.accumulate(ends[::-1])[::-1] - index
    positions = np.flatnonzero(run >= int(bench.lengths.min()))
    if not len(positions):
        return out
    keys = pack.keys(tokens)
    order = suffix_array(keys, positions, pack.per, int(bench.lengths.max()))
    low, high = search(keys, order, pack.keys(bench.tokens), pack, bench.starts.astype(np.int64), bench.lengths)
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return out
    # distinct windows of one length don't overlap in the array, so a place is here at most once a length
    n_hits = (high - low)[hit]
    window = np.repeat(hit, n_hits)
    at = order[np.arange(len(window)) - np.repeat(np.cumsum(n_hits) - n_hits, n_hits) + np.repeat(low[hit], n_hits)]
    begins = np.concatenate([[0], np.cumsum(np.array(counts) + 1)])
    edge = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + bench.lengths[window], -1)
    covered = np.cumsum(edge) > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    opens, closes = turns[::2], turns[1::2]
    spans: dict[int, list] = {}
    for d, a, z in zip((np.searchsorted(begins, opens, "right") - 1).tolist(), opens.tolist(), closes.tolist(), strict=True):
        spans.setdefault(d, []).append((a - int(begins[d]), z - int(begins[d])))
    doc = np.searchsorted(begins, at, "right") - 1
    pairs = np.unique(doc * len(bench.starts) + window)
    of = dict(zip(*(lambda d, k: (d.tolist(), np.split(pairs % len(bench.starts), k[1:])))(*np.unique(pairs // len(bench.starts), return_index=True)), strict=True))
    # the longest window of each place
    by = np.lexsort((bench.lengths[window], at))
    final = by[np.concatenate([np.diff(at[by]) != 0, [True]])]
    at, doc = at[final], doc[final]
    size, lower, upper = longest(bench, tokens, at, window[final])
    by = np.lexsort((at, -size, doc))
    for k in by[np.concatenate([[True], np.diff(doc[by]) != 0])].tolist():
        d = int(doc[k])
        source = int(bench.order[lower[k] : upper[k]].min())
        item = int(bench.item_of[source])
        out[d] = (counts[d], spans[d], of[d], (int(size[k]), int(at[k] - begins[d]), bench.names[item], source - int(bench.first[item])))
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    done: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if done and a <= done[-1][1]:
            done[-1] = (done[-1][0], max(done[-1][1], z))
        else:
            done.append((a, z))
    return done


def _rank(best: tuple) -> tuple:
    """Longest first, then first in the document, then the least item."""
    n, word, item, place = best
    return -n, word, item is not None, item or "", place


LONGEST = "struct<n_words:bigint,doc_word:bigint,item_id:string,item_word:bigint>"
FOUND = {"dc_words": "bigint", "dc_spans": "array<struct<start:bigint,end:bigint>>", "dc_items": "array<string>", "dc_longest": LONGEST}


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
BEST = pa.struct([("n_words", pa.int64()), ("doc_word", pa.int64()), ("item_id", pa.string()), ("item_word", pa.int64())])
EARLIER = f"array<struct<spans:{FOUND['dc_spans']},items:{FOUND['dc_items']},longest:{LONGEST}>>"


def _shards(batches: Iterator[pa.RecordBatch], text: str, most: int = SHARD_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut and joined to about `most` bytes of text."""
    held, size = [], 0
    for batch in batches:
        for part in row_slices(batch, text, most):
            if held and size + part.nbytes > most:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
            held.append(part)
            size += part.nbytes
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _matched(batches: Iterator[pa.RecordBatch], text: str, bench: Benchmark) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of rows and their (words, spans, items, longest), cut so that a slice lists a bounded number of items (or is one row)."""
    for shard in _shards(batches, text):
        column = shard.column(shard.schema.get_field_index(text)).cast(pa.binary())
        start, rows, listed = 0, [], 0
        for n, spans, windows, best in match([t or b"" for t in column.to_pylist()], bench):
            items = bench.items_of(windows)
            if rows and listed + len(items) > RESULT_ITEMS:
                yield shard.slice(start, len(rows)), rows
                start, rows, listed = start + len(rows), [], 0
            rows.append((n, spans, items, best))
            listed += len(items)
        if rows:
            yield shard.slice(start, len(rows)), rows


def _arrays(rows: list) -> list[pa.Array]:
    """spans, items and longest of rows."""
    pairs = [[{"start": a, "end": z} for a, z in r[1]] for r in rows]
    best = [dict(zip(BEST.names, r[3], strict=True)) if r[3] else None for r in rows]
    return [pa.array(pairs, SPAN), pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array(best, BEST)]


def _finds(docs: DataFrame, block, text: str) -> DataFrame:
    """key, spans, items and longest of the texts that the block hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _matched(batches, "t", block.value):
            hit = [k for k, r in enumerate(rows) if r[1]]
            if hit:
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(hit)), *_arrays([rows[k] for k in hit])], ["key", "spans", "items", "longest"])

    texts = docs.select(F.sha2(F.col(text).cast("binary"), 256).alias("key"), F.col(text).alias("t")).where("t is not null")
    return texts.mapInArrow(run, f"key string, spans {FOUND['dc_spans']}, items {FOUND['dc_items']}, longest {LONGEST}")


def _pass(docs: DataFrame, block, text: str, earlier: str | None = None) -> DataFrame:
    """The columns of docs but `earlier` with the results; `earlier` holds what other blocks found."""
    kept = [docs.schema[c] for c in others(docs.columns, *FOUND) if c != earlier]
    schema = T.StructType(kept + [T.StructField(k, T._parse_datatype_string(v)) for k, v in FOUND.items()])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _matched(batches, text, block.value):
            if earlier:
                done = []
                for (n, spans, items, best), old in zip(rows, part.column(part.schema.get_field_index(earlier)).to_pylist(), strict=True):
                    for x in old or ():
                        spans = spans + [(s["start"], s["end"]) for s in x["spans"]]
                        items = items + x["items"]
                        best = min([b for b in (best, tuple(x["longest"].values())) if b], key=_rank)
                    done.append((n, _merged(spans), sorted(set(items)), best))
                rows = done
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in names] + [pa.array([r[0] for r in rows], pa.int64()), *_arrays(rows)], [*names, *FOUND])
        release()

    return docs.mapInArrow(run, schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of docs with dc_words, dc_spans (hit word ranges), dc_items (items with an occurring window) and dc_longest.

    The benchmark's size is measured first. Blocks of about block_bytes of it (or one item) are broadcast, one at a time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1

    def block(b: int):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == b)
        return spark.sparkContext.broadcast(Benchmark.of([(r[0], r[1]) for r in part.collect()], window))

    if blocks == 1:
        return _pass(docs, block(0), text)
    found = None
    for b in range(blocks - 1):
        one = _finds(docs, block(b), text).groupBy("key").agg(*[F.first(c).alias(c) for c in ("spans", "items", "longest")])
        one = written(one, "decontaminate_finds")
        found = one if found is None else found.union(one)
    found = written(found.groupBy("key").agg(F.collect_list(F.struct("spans", "items", "longest")).cast(EARLIER).alias("earlier")), "decontaminate_earlier")
    # texts are shuffled at most once, whatever the number of blocks
    key, earlier = unused([*docs.columns, *FOUND], "text_key", "earlier")
    found = found.withColumnsRenamed({"key": key, "earlier": earlier})
    joined = docs.withColumn(key, F.sha2(F.col(text).cast("binary"), 256)).join(found, key, "left").drop(key)
    return _pass(joined, block(blocks - 1), text, earlier)


def n_hit() -> F.Column:
    return F.aggregate("dc_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def contaminated(share: int = 20) -> F.Column:
    """A document is contaminated if a twentieth or more of its words are hit."""
    return (n_hit() > 0) & (n_hit() * share >= F.col("dc_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without the contaminated ones, with their own columns (also those named as this operator's)."""
    clashing = [c for c in docs.columns if c not in others(docs.columns, *FOUND)]
    own = dict(zip(clashing, unused([*docs.columns, *FOUND], *[f"{c}__own" for c in clashing]), strict=True))
    found = find_contamination(docs.withColumnsRenamed(own), benchmark, **options).where(~contaminated())
    return found.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])
