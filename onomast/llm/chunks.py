"""Scores of the pieces between spaces, kept in one array so that whole batches are summed by numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from onomast.llm.common import LONGEST_PIECE


class ChunkTable:
    """Maps pieces of text to rows of an array, made once a distinct piece.

    Two generations bound the memory by bytes: a full young one becomes the old one, and pieces met again move
    back. `make` gives the rows of a list of new pieces. Pieces longer than LONGEST_PIECE are kept for their batch only.
    """

    def __init__(self, make: Callable[[list[str]], np.ndarray], limit: int = 12 << 20):
        self.make, self.limit, self.spent, self.used = make, limit, 0, 0
        self.index: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.rows = self.old_rows = None
        self.brief: list[str] = []

    def _trim(self) -> None:
        for c in self.brief:
            self.index.pop(c, None)
        self.brief.clear()
        if self.spent > self.limit:
            self.old, self.old_rows = self.index, self.rows[: self.used].copy()
            self.index, self.rows, self.spent, self.used = {}, None, 0, 0

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """The pieces' rows in self.rows, which may be another array afterwards."""
        self._trim()
        index = self.index
        new = set(chunks).difference(index)
        if new or self.rows is None:
            met = list(new.intersection(self.old))
            fresh = list(new.difference(met))
            made = self.make(fresh).astype(np.float32)
            if met:
                made = np.concatenate([made, self.old_rows[[self.old[c] for c in met]]])
            start, names = self.used, fresh + met
            if self.rows is None or start + len(names) > len(self.rows):
                grown = np.zeros((2 * (start + len(names)), made.shape[1]), np.float32)
                if start:
                    grown[:start] = self.rows[:start]
                self.rows = grown
            self.rows[start : start + len(names)] = made
            self.used += len(names)
            self.spent += len(names) * (130 + 8 * made.shape[1]) + sum([len(c) for c in names if len(c) <= LONGEST_PIECE])
            self.brief += [c for c in names if len(c) > LONGEST_PIECE]
            index.update(zip(names, range(start, self.used), strict=True))
        return np.array(list(map(index.__getitem__, chunks)), np.int64)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; runs may be empty."""
    out = np.zeros((len(counts), *values.shape[1:]), np.float64)
    full = np.flatnonzero(counts)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        out[full] = np.add.reduceat(values.astype(np.float64), starts, axis=0)
    return out
