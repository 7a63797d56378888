"""Analyzer steps and chains: a string column becomes an array of struct<token,pos>; the same for query strings in Python."""

from __future__ import annotations

import re
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from onomast.functions.standard import standard_words, words_of

TOKENS = "array<struct<token:string,pos:int>>"

#: Letters that fold to several ASCII letters, or to one that decomposition does not give.
FOLD_LONG = {"ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH", "ĳ": "ij", "Ĳ": "IJ"}
FOLD_ODD = {
    "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i", "ŧ": "t", "Ŧ": "T",
    "’": "'", "‘": "'", "‚": "'", "‛": "'", "‹": "'", "›": "'", "′": "'", "“": '"', "”": '"', "„": '"', "«": '"', "»": '"', "″": '"',
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "⁻": "-", "₋": "-", "⁄": "/", "⁺": "+", "₊": "+", "⁼": "=", "₌": "=", "⁽": "(", "₍": "(", "⁾": ")", "₎": ")",
}
#: Fixed value: the refined phonetic digit of each letter from A to Z.
PHONETIC = "01360240043788015936020505"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GAP = 100


#: Blocks whose letters, digits and forms are folded: Latin, phonetic extensions, super- and subscripts, circled, full width.
FOLDED = (0xAA, 0xB2, 0xB3, 0xB9, 0xBA, *range(0xC0, 0x250), *range(0x1D2C, 0x1D6B), *range(0x1E00, 0x1F00), *range(0x2070, 0x20A0), *range(0x2460, 0x2500), *range(0xFF01, 0xFF5F))


@cache
def fold_table() -> dict[str, str]:
    """Characters that stand for one ASCII character, by compatibility decomposition without marks; forms of several characters (a circled ten) stay."""
    out = dict(FOLD_ODD)
    for code in FOLDED:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and chr(code) not in FOLD_LONG:
            out.setdefault(chr(code), base)
    return out


# --- columns ------------------------------------------------------------------------------------------------


def fold(c: Column) -> Column:
    table = fold_table()
    folded = F.translate(c, "".join(table), "".join(table.values()))
    folded = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), FOLD_LONG.items(), folded)
    return F.when(c.rlike(r"[^\x00-\x7f]"), folded).otherwise(c)


def trim(c: Column) -> Column:
    """Strips any white space at both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"^\p{javaWhitespace}+", ""), r"\p{javaWhitespace}+$", "")


def hyphenate(c: Column) -> Column:
    """A space and the white space after it become one hyphen."""
    return F.regexp_replace(c, r" \s*", "-")


def once(c: Column, of) -> Column:
    """What `of` makes of a value that is computed once, however often it stands there."""
    return F.transform(F.array(c), of)[0]


def positioned(words: Column) -> Column:
    return F.transform(words, lambda w, i: F.struct(w.alias("token"), i.cast("int").alias("pos")))


def parts(c: Column, more: str = "") -> Column:
    """Words between delimiters, cut also where letters meet digits."""
    if not more:
        return F.regexp_extract_all(c, F.lit(r"\p{L}+|\p{N}+"), F.lit(0))
    cut = F.regexp_replace(c, r"(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})", "-")
    return F.filter(F.split(cut, rf"[^\p{{L}}\p{{N}}{more}]+"), lambda w: w != "")


def catenated(words: Column) -> Column:
    """The words with positions, and all of them joined at the last one's position where there are several."""

    def made(w: Column) -> Column:
        joined = F.array(F.struct(F.array_join(w, "").alias("token"), (F.size(w) - 1).cast("int").alias("pos")))
        return F.concat(positioned(w), F.when(F.size(w) > 1, joined).otherwise(F.array().cast(TOKENS)))

    return once(words, made)


def words(c: Column) -> Column:
    """Runs of letters and digits, lower case (generic text)."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def initials(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.struct(F.substring(t["token"], 1, 1).alias("token"), t["pos"].alias("pos")))


def phonetic_code(word: Column) -> Column:
    """Refined phonetic code: first letter, then the digits of all letters with runs of one digit collapsed; a word without letters stays."""
    letters = F.upper(F.regexp_replace(word, "[^A-Za-z]", ""))
    digits = F.regexp_replace(F.translate(letters, LETTERS, PHONETIC), r"(.)\1+", "$1")
    return F.when(letters == "", word).otherwise(F.concat(F.substring(letters, 1, 1), digits))


def phonetic(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.struct(phonetic_code(t["token"]).alias("token"), t["pos"].alias("pos")))


def with_synonyms(tokens: Column, synonyms: dict[str, list[str]]) -> Column:
    """Each word that the dictionary lists becomes its alternatives, all at its position."""
    if not synonyms:
        return tokens
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k.lower()), F.array(*[F.lit(s.lower()) for s in v]))])
    return F.flatten(F.transform(tokens, lambda t: F.transform(F.coalesce(F.try_element_at(table, t["token"]), F.array(t["token"])), lambda s: F.struct(s.alias("token"), t["pos"].alias("pos")))))


def multi_valued(values: Column, analyse) -> Column:
    """Tokens of all values; a later value starts GAP past the end of the one before."""
    zero = F.struct(F.lit(0).alias("next"), F.array().cast(TOKENS).alias("out"))

    def step(acc: Column, value: Column) -> Column:
        found = analyse(value)
        moved = F.transform(found, lambda t: F.struct(t["token"].alias("token"), (t["pos"] + acc["next"]).alias("pos")))
        after = F.coalesce(F.array_max(F.transform(moved, lambda t: t["pos"])) + 1, acc["next"]) + GAP
        return F.struct(after.cast("int").alias("next"), F.concat(acc["out"], moved).alias("out"))

    return F.aggregate(F.coalesce(values, F.array().cast("array<string>")), zero, step, lambda a: a["out"])


def _full(tokens: Column) -> Column:
    return F.coalesce(tokens, F.array().cast(TOKENS))


def first_an(c: Column) -> Column:
    return _full(positioned(parts(trim(hyphenate(F.lower(c))))))


def first_syn(c: Column, synonyms: dict[str, list[str]]) -> Column:
    return with_synonyms(first_an(c), synonyms)


def first_initial(c: Column) -> Column:
    return initials(first_an(c))


def first_rs(c: Column) -> Column:
    return phonetic(first_an(fold(c)))


def last_an(c: Column) -> Column:
    return _full(catenated(parts(trim(hyphenate(F.lower(fold(c)))))))


def last_syn(c: Column, synonyms: dict[str, list[str]]) -> Column:
    return with_synonyms(last_an(c), synonyms)


def last_rs(c: Column) -> Column:
    return phonetic(last_an(c))


def name_string(c: Column) -> Column:
    return trim(F.lower(fold(c)))


def text_facet(c: Column) -> Column:
    return trim(F.lower(c))


def analysed(c: Column) -> Column:
    """Generic text: words by the standard rules."""
    return _full(standard_words(c))


def whitespace_words(c: Column) -> Column:
    return _full(positioned(F.filter(F.split(c, r"\p{javaWhitespace}+"), lambda w: w != "")))


# --- query strings ------------------------------------------------------------------------------------------


def fold_text(text: str) -> str:
    table = fold_table()
    return "".join(FOLD_LONG.get(c, table.get(c, c)) for c in text)


def _parts(text: str, more: str = "") -> list[str]:
    out, now, kind = [], "", ""
    for c in text:
        own = "d" if c.isnumeric() else "l" if c.isalpha() else "w" if c in more else ""
        if now and (not own or {own, kind} == {"d", "l"}):
            out.append(now)
            now = ""
        if own:
            now += c
        kind = own
    return out + [now] if now else out


def query_words(text: str, surname: bool) -> list[str]:
    """First names: words between white space. Surnames: folded, and cut at delimiters but for wildcards."""
    if not surname:
        return [w.strip().lower() for w in text.split()]
    return [p for w in text.split() for p in _parts(fold_text(w).lower().strip(), "*?")]


def code(word: str) -> str:
    letters = re.sub("[^A-Za-z]", "", word).upper()
    if not letters:
        return word
    digits = [PHONETIC[LETTERS.index(c)] for c in letters]
    return letters[0] + "".join(d for k, d in enumerate(digits) if k == 0 or d != digits[k - 1])


def query_code(word: str) -> str | None:
    """The code of a query word's first part, or none."""
    found = _parts(re.sub(r" \s*", "-", fold_text(word).lower()).strip())
    return code(found[0]) if found else None


def query_synonym_words(text: str) -> list[str]:
    """The query side of synonym fields: words by the standard rules."""
    return words_of(text)


def query_exact(text: str) -> str:
    return fold_text(text).lower().strip()
