"""Edit distances of two columns of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def swapped(w: Column) -> Column:
    """What each exchange of two neighbours makes of a word."""
    at = F.sequence(F.lit(1), F.greatest(F.char_length(w) - 1, F.lit(1)))
    return F.transform(at, lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1, F.lit(1)), F.substr(w, i, F.lit(1)), F.substr(w, i + 2)))


def edits_between(a: Column, b: Column, most: Column) -> Column:
    """Edit distance with exchanged neighbours as one edit, null beyond `most` (1 or 2), of two columns.

    An exchange costs two plain edits, so pairs within twice the limit are looked at once more: all words that one exchange
    makes of the shorter word (letters may stand between the exchanged ones in the longer), and those that two make.
    """
    plain = F.levenshtein(a, b)

    less = F.char_length(a) < F.char_length(b)
    short, long = F.when(less, a).otherwise(b), F.when(less, b).otherwise(a)
    once = F.array_min(F.transform(swapped(short), lambda w: F.levenshtein(long, w))) + 1
    # two exchanges are two edits already, so only equal words count
    twice = F.when(F.exists(swapped(a), lambda w: F.exists(swapped(b), lambda v: v == w)), 2)
    least = F.when(plain <= 1, plain).when((plain <= 2 * most) & (most > 1), F.least(plain, once, twice)).when(plain <= 2 * most, F.least(plain, once)).otherwise(plain)
    return F.when(least <= most, least)
