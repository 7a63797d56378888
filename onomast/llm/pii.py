"""Personal data by base rules and by bootstrapped contextual extraction.

The base rules find e-mail addresses, IP addresses, card numbers and phone numbers. Their matches are the seed instances.
The word and the two words before an instance are its lexical patterns; the other instances are the identifier-like
words (five digits or more). Spark scores the bipartite pattern-instance graph in rounds:

- a pattern's score is the sum of its instances' scores over ALL its occurrences in the corpus, whatever follows it (PRIOR more
  for little evidence). So a word that is seldom followed by an identifier scores low however many seeds it precedes, and what a
  base rule refused (a failed checksum, a part over 255) counts against the words before it.
- patterns that reach MIN_SCORE with MIN_SEEDS distinct accepted instances are accepted, and so are the instances beside them, with the
  best such pattern's score (1 for seeds). Refused strings are never accepted.
- accepted instances support the patterns of all their other occurrences in the next round, until nothing more is accepted.

Occurrences of accepted instances that no base rule covers are the spans of kind "context". Where no word goes with identifiers, none are.

The first pass over the texts writes a slim table (base spans and instances of each row). The second counts the patterns' occurrences,
pre-aggregated in the task; a bitmap of fixed size (FILTER_BITS) tells it which words can be a pattern, and the exact join that follows drops
what the bitmap let through for nothing. No text is shuffled and nothing but the bitmap and row counts reaches the driver.

Defined results: null counts as empty and has no spans. Repeated rows are scanned each on its own. Columns other than
the id and the text play no part. An empty table gives an empty result. Very long texts are scanned whole.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from onomast.llm.common import ChunkCache, release, row_slices, small_batches, texts_of, written

KINDS = ("email", "ip", "card", "phone", "context")
BATCH_BYTES = 2 << 20

MIN_SCORE, MIN_SEEDS, PRIOR = 0.6, 3, 2.0
#: Bits of the bitmap of patterns, a multiple of 32,768.
FILTER_BITS = 1 << 22
#: Counted patterns that a task holds before it hands them on.
HELD = 100_000
#: What an instance is: an identifier-like word, one that a base rule refused, a seed.
OTHER, REFUSED, SEED = 0, 1, 2

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
#: Words between white space; a colon or an equals sign ends one.
WORD = re.compile(r"[^\s:=]+[:=]*|[:=]+")
EDGES = "\"'`.,;:!?()[]{}<>|*#$%&=~"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from each @ outwards, which takes linear time; equal to the leftmost non-overlapping matches of the rule."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(free, at + 1))


Span = tuple[int, int, int]


def judged_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """(kind, start, end) of the base rules' matches, by kind, then start; and (start, end) of the strings that a rule refused."""
    out = [(0, a, z) for a, z in emails(text)] if "@" in text else []
    refused: list[tuple[int, int]] = []
    if not DIGITS.search(text):
        return out, refused

    def judge(kind: int, m: re.Match, good: bool) -> None:
        if good:
            out.append((kind, m.start(), m.end()))
        else:
            refused.append(m.span())

    for m in IP.finditer(text):
        judge(1, m, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")))
    for m in CARD.finditer(text):
        judge(2, m, len(m[0]) <= 40 and 13 <= len(d := DIGITS.findall(m[0])) <= 19 and luhn("".join(d)))
    if "+" in text:
        for m in PHONE.finditer(text):
            judge(3, m, 9 <= len(DIGITS.findall(m[0])) <= 15)
    return out, refused


def base_spans(text: str) -> list[Span]:
    return judged_spans(text)[0]


def plain(word: str) -> str:
    """A word as patterns have it; empty if it holds a digit, since numbers are no context."""
    word = word.lower()
    return "" if DIGITS.search(word) else word.strip(EDGES) or word


def patterns_of(two_back: str, back: str) -> list[str]:
    """The patterns that two plain words make with what follows them: the nearer one, and both."""
    return [x for x in (back, two_back and f"{two_back} {back}") if x] if back else []


def _overlaps(spans: list[tuple[int, int]], starts: list[int], reach: list[int], a: int, z: int) -> bool:
    """Whether one of some spans in order, with the furthest end up to each, overlaps (a, z)."""
    k = bisect_left(starts, z)
    return k > 0 and reach[k - 1] > a


def instances(text: str, base: list[Span], refused: list[tuple[int, int]]) -> list[dict]:
    """The seeds and the identifier-like words, each with its patterns."""
    if not base and not DIGITS.search(text):
        return []
    found = [m.span() for m in WORD.finditer(text)]
    starts = [a for a, _ in found]

    def before(k: int) -> list[str]:
        return patterns_of(*(plain(text[slice(*found[i])]) if i >= 0 else "" for i in (k - 2, k - 1)))

    out = []
    taken = sorted((a, z) for _, a, z in base)
    for a, z in taken:
        out.append({"start": a, "end": z, "instance": text[a:z].lower(), "kind": SEED, "patterns": before(bisect_right(starts, a) - 1)})
    lines = [(x, [a for a, _ in x], list(accumulate((z for _, z in x), max))) for x in (taken, sorted(refused))]
    for k, (a, z) in enumerate(found):
        word = text[a:z]
        if len(word) < 5 or len(DIGITS.findall(word)) < 5:
            continue
        while a < z and text[a] in EDGES:
            a += 1
        while z > a and text[z - 1] in EDGES:
            z -= 1
        if z > a and not _overlaps(*lines[0], a, z):
            out.append({"start": a, "end": z, "instance": text[a:z].lower(), "kind": REFUSED if _overlaps(*lines[1], a, z) else OTHER, "patterns": before(k)})
    return out


def say(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for k, a, z in spans)


INSTANCE = "struct<start:int,end:int,instance:string,kind:int,patterns:array<string>>"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts and spans of the base rules, and the instances; a narrow pass."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:4]], T.StructField("base_spans", T.StringType()), T.StructField("instances", T._parse_datatype_string(f"array<{INSTANCE}>"))])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("kind", pa.int32()), ("patterns", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, text, BATCH_BYTES):
                counts, spans, found = [[], [], [], []], [], []
                for t in texts_of(part, text):
                    base, refused = judged_spans(t)
                    for k in range(4):
                        counts[k].append(sum(1 for s in base if s[0] == k))
                    spans.append(say(base))
                    found.append(instances(t, base, refused))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(doc_id)), *[pa.array(c, pa.int64()) for c in counts], pa.array(spans, pa.string()), pa.array(found, kind)], schema.names)

    small_batches(docs.sparkSession)
    return docs.select(doc_id, text).mapInArrow(run, schema)


def bitmap_of(patterns: DataFrame) -> bytes:
    """A bit for each crc32 of a pattern, modulo FILTER_BITS; made by Spark, of fixed size."""
    at = F.pmod(F.crc32(F.col("pattern").cast("binary")), F.lit(FILTER_BITS))
    rows = patterns.select(at.alias("at")).groupBy(F.floor(F.col("at") / 32768).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits"))
    out = bytearray(FILTER_BITS // 8)
    for r in rows.collect():
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = r["bits"]
    return bytes(out)


def count_patterns(docs: DataFrame, patterns: DataFrame, text: str = "text") -> DataFrame:
    """pattern, total: how often each given pattern stands before a word."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(patterns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, counts = shared.value, Counter()

        def listed(pattern: str) -> bool:
            at = zlib.crc32(pattern.encode()) & (FILTER_BITS - 1) if pattern else -1
            return at >= 0 and bool(bits[at >> 3] >> (at & 7) & 1)

        def look(word: str) -> tuple[str, bool]:
            word = plain(word)
            return word, listed(word)

        known = ChunkCache(look)

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pattern", "total"])
            counts.clear()
            return out

        for batch in batches:
            for part in row_slices(batch, text, BATCH_BYTES):
                for t in texts_of(part, text):
                    found = [known[w] for w in WORD.findall(t)]
                    for k, (word, may) in enumerate(found[:-1]):
                        if may:
                            counts[word] += 1
                            if k and found[k - 1][0] and listed(two := f"{found[k - 1][0]} {word}"):
                                counts[two] += 1
                known.trim()
                if len(counts) > HELD:
                    yield given()
        yield given()
        release()

    small_batches(docs.sparkSession)
    found = docs.select(text).mapInArrow(run, "pattern string, total long").groupBy("pattern").agg(F.sum("total").alias("total"))
    return found.join(patterns.select("pattern").distinct(), "pattern", "left_semi")


def bootstrap(edges: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted patterns (pattern, score, support) and instances (instance, score) - from edges (pattern, instance, kind, n) and totals (pattern, total).

    Scores and the accepted sets only grow, so the rounds end.
    """
    seeds = edges.where(F.col("kind") == SEED).select("instance").distinct().withColumn("score", F.lit(1.0))
    accepted, before = written(seeds, "pii_instances"), (-1, -1)
    others = edges.where(F.col("kind") == OTHER).select("pattern", "instance")
    while True:
        support = edges.where(F.col("kind") != REFUSED).join(accepted, "instance").groupBy("pattern").agg(F.sum(F.col("n") * F.col("score")).alias("good"), F.count_distinct("instance").alias("support"))
        scored = support.join(totals, "pattern").select("pattern", (F.col("good") / (F.col("total") + PRIOR)).alias("score"), "support")
        patterns = written(scored.where((F.col("score") >= MIN_SCORE) & (F.col("support") >= MIN_SEEDS)), "pii_patterns")
        met = others.join(patterns, "pattern").groupBy("instance").agg(F.max("score").alias("score"))
        accepted = written(seeds.unionByName(met).groupBy("instance").agg(F.max("score").alias("score")), "pii_instances")
        now = (patterns.count(), accepted.count())
        if now == before:
            return patterns, accepted
        before = now


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans (kind:start:end by kind, then start) and n_context."""
    rows = written(scan(docs, doc_id, text).withColumn("rid", F.monotonically_increasing_id()), "pii_rows")
    found = rows.where(F.size("instances") > 0).select("rid", F.explode("instances").alias("c")).select("rid", "c.*")
    # an instance without a word before it still has a row, so that it can be accepted by its other occurrences
    uses = found.select("instance", "kind", F.explode("patterns").alias("pattern"))
    edges = written(uses.groupBy("pattern", "instance", "kind").agg(F.count(F.lit(1)).alias("n")), "pii_edges")
    if edges.where(F.col("kind") == OTHER).isEmpty():
        more = rows.select("rid", F.lit(None).cast("array<struct<start:int,end:int>>").alias("more")).limit(0)
    else:
        totals = written(count_patterns(docs, edges, text), "pii_totals")
        _, accepted = bootstrap(edges, totals)
        unseen = found.where(F.col("kind") == OTHER).join(accepted.select("instance"), "instance", "left_semi")
        more = unseen.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("more"))
    context = F.transform("more", lambda s: F.concat_ws(":", F.lit(KINDS[4]), s["start"], s["end"]))
    both = F.when(F.col("more").isNull(), F.col("base_spans")).otherwise(F.array_join(F.concat(F.filter(F.split("base_spans", ","), lambda s: s != ""), context), ","))
    out = rows.drop("instances").join(more, "rid", "left")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_spans", both.alias("spans"), F.coalesce(F.size("more"), F.lit(0)).cast("bigint").alias("n_context"))
