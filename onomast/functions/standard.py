"""The standard tokenizer: words by the Unicode word-break rules, as one expression on a column and for query strings in Python.

Text is split at single characters and places, never matched by a loop, so that very long words cost no stack. A character parts words unless it is a
letter, digit, kana, ideograph or connector, or stands between two letters (`:` `.` apostrophes) or two digits (`.` `,` `;` apostrophes). Marks and format characters belong
to what stands before them. Between scripts words also end at places without a separator: every ideograph and every hiragana is a word, katakana
and letters part, and runs of scripts without spaces (Thai and others) are words.

Not covered: the quotation marks within Hebrew words; a separator after more than eight marks is taken to stand at a word's end.
"""

from __future__ import annotations

from functools import cache

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The classes of the word-break rules, as parts of character classes.
UNSPACED = r"\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTai_Le}\p{IsNew_Tai_Lue}\p{IsTai_Tham}\p{IsTai_Viet}"
IDEOGRAPH, HIRAGANA, KATAKANA = r"\p{IsIdeographic}", r"\p{IsHiragana}", r"\p{IsKatakana}\u30fc\uff70\u3031-\u3035\u309b\u309c\u30a0"
EXTEND = r"[\p{M}\p{Cf}&&[^\u200b]]"
LETTER = rf"[[\p{{IsAlphabetic}}\u05f3]&&[^\p{{M}}{IDEOGRAPH}{HIRAGANA}{KATAKANA}{UNSPACED}]]"
DIGIT, CONNECTOR = r"\p{Nd}\u066b", r"\p{Pc}"
BETWEEN_LETTERS = r":\u00b7\u0387\u05f4\u2027\ufe13\ufe55\uff1a"
BETWEEN_DIGITS = r",;\u037e\u0589\u060c\u060d\u066c\u07f8\u2044\ufe10\ufe14\ufe50\ufe54\uff0c\uff1b"
BETWEEN_EITHER = r".'\u2018\u2019\u2024\ufe52\uff07\uff0e"
#: Longer words are left out, but keep their place.
LONGEST = 255

_ANY = rf"{LETTER}{IDEOGRAPH}{HIRAGANA}{KATAKANA}{UNSPACED}{DIGIT}"
_MARKS = rf"{EXTEND}{{0,8}}"


def _kept(after: str, marks: str) -> str:
    """The mark stands between two characters of the class."""
    return rf"(?<=[{after}]{_MARKS}[{marks}])(?={EXTEND}{{0,8}}[{after}])"


#: Most characters are told by these alone: letters, digits and connectors that never part words, and ASCII that always does.
PLAIN_WORD = r"[A-Za-z0-9_\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"
PLAIN_SEPARATOR = r"[\x00-\x20!-&(-+\-/<-@\[-\^`{-\x7f]"
SEPARATOR = (
    rf"(?!{PLAIN_WORD})(?:{PLAIN_SEPARATOR}|[^{_ANY}{CONNECTOR}{EXTEND}{BETWEEN_LETTERS}{BETWEEN_DIGITS}{BETWEEN_EITHER}]"
    rf"|[{BETWEEN_LETTERS}](?!{_kept(LETTER, BETWEEN_LETTERS)})|[{BETWEEN_DIGITS}](?!{_kept(DIGIT, BETWEEN_DIGITS)})"
    rf"|[{BETWEEN_EITHER}](?!{_kept(LETTER, BETWEEN_EITHER)}|{_kept(DIGIT, BETWEEN_EITHER)}))"
)
#: Places where words end without a separator.
PLACE = (
    rf"(?<=[{IDEOGRAPH}{HIRAGANA}]{_MARKS})(?!{EXTEND})|(?=[{IDEOGRAPH}{HIRAGANA}])"
    rf"|(?<=[{UNSPACED}]{_MARKS})(?![{UNSPACED}]|{EXTEND})|(?<![{UNSPACED}]|{EXTEND})(?=[{UNSPACED}])"
    rf"|(?<=[{KATAKANA}]{_MARKS})(?=[{LETTER}{DIGIT}])|(?<=[{LETTER}{DIGIT}]{_MARKS})(?=[{KATAKANA}])"
)
SCRIPTS = rf"(?![\x00-\u02ff])[{IDEOGRAPH}{HIRAGANA}{KATAKANA}{UNSPACED}]"
WORD, LEADING = rf"[A-Za-z0-9]|[{_ANY}]", rf"^{EXTEND}+"
SOME_MARKS = rf"(?![\x00-\xac]){EXTEND}"
#: Stands where words part; a control character, which parts words itself.
CUT = "\x01"

#: Letters beside ASCII of texts that are split in one step: each is a letter to all rules, and its lower case is one of them.
PLAIN_LETTERS = r"\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
NOT_PLAIN = rf"(?![\x00-\x7f\u00c0-\u00d6])[^{PLAIN_LETTERS}]"


def _apart(marks: str, *classes: str) -> str:
    """One of the marks, unless it stands between two characters of a class."""
    return rf"[{marks}](?!{'|'.join(rf'(?<=[{c}].)[{c}]' for c in classes)})"


#: The separators of such a text once it is lower case; a run of characters that always part words is one.
PLAIN_SPLIT = "|".join((f"{PLAIN_SEPARATOR}++", _apart(",;", "0-9"), _apart(":", f"a-z{PLAIN_LETTERS}"), _apart(".'", f"a-z{PLAIN_LETTERS}", "0-9")))


def _plain_words(c: Column) -> Column:
    """The words of a text of plain characters, lower case. Connectors alone are no word."""
    words = F.array_remove(F.split(F.lower(c), PLAIN_SPLIT), "")
    return F.when(F.contains(c, F.lit("_")), F.filter(words, lambda w: w.rlike("[^_]"))).otherwise(words)


def standard_words(c: Column) -> Column:
    """The words of a text with their positions, lower case; null for null."""
    cut = F.when(c.rlike(SCRIPTS), F.regexp_replace(c, f"{SEPARATOR}|{PLACE}", CUT)).otherwise(F.regexp_replace(c, SEPARATOR, CUT))
    words = F.filter(F.split(cut, CUT), lambda w: w.rlike(WORD))
    bare = F.when(c.rlike(SOME_MARKS), F.transform(words, lambda w: F.regexp_replace(w, LEADING, ""))).otherwise(words)
    lower = F.when(~c.rlike(NOT_PLAIN), _plain_words(c)).otherwise(F.transform(bare, lambda w: F.lower(w)))
    placed = F.transform(lower, lambda w, i: F.struct(w.alias("token"), i.cast("int").alias("pos")))
    return F.filter(placed, lambda t: F.char_length(t["token"]) <= LONGEST)


@cache
def _compiled() -> tuple:
    own = lambda p: regex.compile(p.replace(r"\p{Is", r"\p{"), regex.V1)
    return own(f"{SEPARATOR}|{PLACE}"), own(WORD), own(LEADING)


def words_of(text: str) -> list[str]:
    """The same words of a query string."""
    split, word, leading = _compiled()
    return [w for w in (leading.sub("", p).lower() for p in split.split(text) if word.search(p)) if len(w) <= LONGEST]
