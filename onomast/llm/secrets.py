"""Secret scans with native Spark expressions.

Base rules find assignments, access keys and hex runs. The entropy scan adds high-entropy strings: every
candidate (a run of key characters) is one character class - hex, base32, or base64 - and a window of
WINDOW characters slides over it. A count is kept for each character that the candidate has; a character that comes in or goes
out changes one count, and with it S = sum of c * log2(c), so the entropy log2(WINDOW) - S / WINDOW costs a step the same whatever
the window. A candidate whose best window reaches its class's threshold is reported unless an
allow-list rule suppresses it (words, paths, dates, repeated characters, UUIDs). Long candidates are scanned in segments that
overlap by a window, until one reaches the threshold.

Positions come from splitting the text at the matches: the lengths of the parts and matches before a match
add up to its start, in code points; they are added up block by block, so that lists are not copied once a match. Everything is built from SQL functions; no row leaves the JVM. Texts that can hold no
match of a kind skip it after one regular-expression test.

Defined results: null counts as empty and has no spans. Rows are scanned each on its own, so ties, repeated
rows and other columns play no part; columns named as the results are replaced. Very long texts are
scanned whole. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onomast.llm.common import unused

#: Fixed patterns of the base rules.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Characters of a segment, and matches of a block.
SEGMENT, BLOCK = 2048, 64
#: Bits a character that the best window must reach, by class; the most that 20 characters can have is 4.32.
HEX_BITS, BASE32_BITS, BASE64_BITS = 3.0, 3.6, 3.9
#: Candidates that are no secrets: one case of letters only, numbers, words joined by - _ or /, UUIDs, one character repeated.
ALLOWED = [
    r"^[A-Z]?[a-z]+$|^[A-Z]+$",
    r"^[0-9]+$",
    r"^[A-Za-z][A-Za-z_/=+-]*$",
    r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"^(.)\1+$",
]

SPAN = "array<struct<start:int,end:int,match:string>>"


def spans(text: Column, pattern: str, has: Column) -> Column:
    """start, end (code points, end exclusive) and string of the leftmost non-overlapping matches, none of them empty."""
    none = F.array().cast(SPAN)
    zero = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.char_length(x["match"])
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match")))).alias("found"))

    def shift(acc: Column, block: Column) -> Column:
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["bases"], F.array(acc["at"])).alias("bases"))

    def moved(block: Column, base: Column) -> Column:
        return F.transform(block["found"], lambda s: F.struct((s["start"] + base).alias("start"), (s["end"] + base).alias("end"), s["match"].alias("match")))

    def blocks(pairs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(pairs) - 1, F.lit(BLOCK)), lambda k: F.aggregate(F.slice(pairs, k + 1, F.lit(BLOCK)), zero, step))

    def joined(made: Column) -> Column:
        bases = F.aggregate(made, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("bases")), shift, lambda a: a["bases"])
        return F.flatten(F.zip_with(made, bases, moved))

    matches = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    pairs = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: F.struct(g.alias("gap"), m.alias("match")))
    # one-element arrays name a value for the lambda that uses it several times
    found = F.transform(F.array(pairs), lambda p: F.when(F.size(p) > 0, F.transform(F.array(blocks(p)), joined)[0]).otherwise(none))[0]
    return F.when(has, found).otherwise(none)


def _steps(window: int) -> tuple[Column, Column]:
    """How n * log2(n) grows with the count n, from 0 to the window's size, by one more and by one less."""
    weight = [n * math.log2(n) if n else 0.0 for n in range(window + 2)]
    up = F.array(*[F.lit(weight[n + 1] - weight[n]) for n in range(window + 1)])
    down = F.array(*[F.lit(weight[max(0, n - 1)] - weight[n]) for n in range(window + 2)])
    return up, down


def best_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits a character, of a window over the candidate (null if it is shorter).

    Runs over the characters once; a character coming in and the one going out are two steps. The state holds the counts, one character
    ('0' and up) for each distinct character of the candidate, S, and the least S of a full window.
    """
    up, down = _steps(window)

    def run(letters: Column) -> Column:
        alphabet = F.array_join(F.array_distinct(letters), "")

        def scan(alphabet: Column) -> Column:
            places = F.transform(letters, lambda c: F.instr(alphabet, c))

            def events(places: Column) -> Column:
                def pair(p: Column, i: Column) -> Column:
                    into = F.struct(p.alias("p"), F.lit(1).alias("by"), (i == window - 1).alias("full"))
                    out = F.struct(F.get(places, i - window).alias("p"), F.lit(-1).alias("by"), F.lit(True).alias("full"))
                    return F.when(i < window, F.array(into)).otherwise(F.array(into, out))

                return F.flatten(F.transform(places, pair))

            def step(a: Column, x: Column) -> Column:
                n = F.ascii(F.substr(a["n"], x["p"], F.lit(1))) - 48
                s = a["s"] + F.when(x["by"] > 0, F.element_at(up, n + 1)).otherwise(F.element_at(down, n + 1))
                return F.struct(F.overlay(a["n"], F.chr(n + 48 + x["by"]), x["p"]).alias("n"), s.alias("s"), F.when(x["full"], F.least(a["least"], s)).otherwise(a["least"]).alias("least"))

            start = F.struct(F.repeat(F.lit("0"), F.char_length(alphabet)).alias("n"), F.lit(0.0).alias("s"), F.lit(1e9).alias("least"))
            least = F.transform(F.array(places), lambda p: F.aggregate(events(p), start, step, lambda a: a["least"]))[0]
            return F.when(F.size(letters) >= window, F.lit(math.log2(window)) - least / window)

        return F.transform(F.array(alphabet), scan)[0]

    return F.transform(F.array(F.filter(F.split(candidate, ""), lambda c: c != "")), run)[0]


def reaches(candidate: Column, bits: Column, window: int = WINDOW) -> Column:
    """Whether a window of the candidate has so many bits a character; segments after the first one that does aren't scanned."""
    starts = F.sequence(F.lit(0), F.greatest(F.char_length(candidate) - window, F.lit(0)), F.lit(SEGMENT))
    return F.exists(starts, lambda k: F.coalesce(best_entropy(F.substr(candidate, k + 1, F.lit(SEGMENT + window - 1)), window) >= bits, F.lit(False)))


def suspicious(match: Column) -> Column:
    """Whether a candidate's best window reaches its class's threshold and no allow-list rule holds."""
    bits = F.when(match.rlike("^[0-9a-fA-F]+$"), HEX_BITS).when(match.rlike("^[A-Z2-7=]+$"), BASE32_BITS).otherwise(BASE64_BITS)
    allowed = F.lit(False)
    for rule in ALLOWED:
        allowed = allowed | match.rlike(rule)
    return F.when(allowed, F.lit(False)).otherwise(reaches(match, bits))


def _listed(found: list[tuple[int, str]]) -> Column:
    """All spans as kind:start:end by start, then kind as listed."""

    def keyed(k: int):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end"))

    parts = [F.transform(F.col(f"`{name}`"), keyed(k)) for k, name in found]
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(F.concat(*parts)), lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"], s["end"])), ",")


FOUND = ("n_assign", "n_access", "n_hex", "n_entropy", "base_spans", "spans")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs with n_assign, n_access, n_hex, n_entropy, base_spans and spans (kind:start:end, comma-joined)."""
    own = unused([*docs.columns, *FOUND], *KINDS)
    t = F.coalesce(F.col(text), F.lit(""))
    # a rule's test runs once a text; its matches are sought in few texts
    rows = docs.withColumns(dict(zip(own, [spans(t, ASSIGN, t.rlike(ASSIGN)), spans(t, ACCESS, t.contains("AKIA")), spans(t, HEX, t.rlike(HEX)), spans(t, CANDIDATE, t.rlike(CANDIDATE))], strict=True)))
    kept = {own[0]: F.filter(own[0], lambda s: F.char_length(F.regexp_extract(s["match"], ASSIGN, 1)) >= 12), own[3]: F.filter(own[3], lambda s: suspicious(s["match"]))}
    rows = rows.withColumns(kept)
    found = list(enumerate(own))
    counts = {f"n_{kind}": F.size(own[k]).cast("bigint") for k, kind in enumerate(KINDS)}
    made = counts | {"base_spans": _listed(found[:3]), "spans": _listed(found)}
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in FOUND], *[made[c].alias(c) for c in FOUND])
