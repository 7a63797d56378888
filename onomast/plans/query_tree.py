"""Combined queries: a tree of names, words, positions, payloads and values that must, should or must not match."""

from __future__ import annotations

import re
from dataclasses import dataclass

from onomast.plans.name_query import NameQuery


@dataclass(frozen=True)
class Name:
    """A name query on the fields of `base` (with mv: the multi-valued ones)."""

    query: NameQuery
    base: str
    mv: bool = False

    def __str__(self) -> str:
        return f"{self.base}{'_mv' if self.mv else ''}~({self.query.text})"


@dataclass(frozen=True)
class Words:
    """Any of the words in a token column; what each scores adds up."""

    column: str
    words: tuple[str, ...]

    def __str__(self) -> str:
        return f"{self.column}:({' '.join(self.words)})" if len(self.words) != 1 else f"{self.column}:{self.words[0]}"


@dataclass(frozen=True)
class Positioned:
    """Tokens near a target position (none: anywhere). kind: term, prefix, wildcard or fuzzy."""

    column: str
    term: str
    target: int | None = None
    kind: str = "term"

    def __str__(self) -> str:
        mark = {"prefix": "*", "fuzzy": "~"}.get(self.kind, "")
        return f"targetPosition({self.column}:{self.term}{mark}, {'any' if self.target is None else self.target})"


@dataclass(frozen=True)
class Payload:
    """The term's best payload near posn."""

    column: str
    term: str
    posn: int
    mult: float = 1.0

    def __str__(self) -> str:
        return f"payload({self.column}:{self.term}, {self.posn}, {self.mult:g})"


@dataclass(frozen=True)
class Value:
    """A plain column's value, or one of an array column's."""

    column: str
    value: str

    def __str__(self) -> str:
        return f"{self.column}={self.value}"


@dataclass(frozen=True)
class Everything:
    def __str__(self) -> str:
        return "*:*"


@dataclass(frozen=True)
class All:
    """All of `must`, none of `must_not`, and at least `at_least` of `should` (one, where nothing must match). What matches adds up, times boost."""

    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()
    at_least: int = 0
    boost: float = 1.0

    def __str__(self) -> str:
        parts = [f"+{_inner(n)}" for n in self.must] + [_inner(n) for n in self.should] + [f"-{_inner(n)}" for n in self.must_not]
        least = f"~{self.at_least}" if self.at_least else ""
        out = " ".join(parts)
        return f"({out}){least}^{self.boost:g}" if self.boost != 1 or least else out


Node = Name | Words | Positioned | Payload | Value | Everything | All


def _inner(node: Node) -> str:
    out = str(node)
    return f"({out})" if isinstance(node, All) and not out.startswith("(") else out


def terms(node: Node) -> list[tuple[str, str]]:
    """The (field or column, term) that a tree looks for, also those that must not match; patterns as they stand."""
    if isinstance(node, All):
        return [t for n in (*node.must, *node.should, *node.must_not) for t in terms(n)]
    if isinstance(node, Name):
        return [(f"{node.base}.{c.field}", c.term) for c in node.query.clauses()]
    if isinstance(node, Words):
        return [(node.column, w) for w in node.words]
    if isinstance(node, Value):
        return [(node.column, node.value)]
    return [] if isinstance(node, Everything) else [(node.column, node.term)]


LOCAL = re.compile(r"(?:_query_:)?(?P<quote>[\"']?)\{!\w+(?P<options>[^}]*)\}(?P<text>.*)(?P=quote)", re.S)
OPTION = re.compile(r"(\w+)=(?:'([^']*)'|\"([^\"]*)\"|(\S+))")


def of_request(text: str) -> Name:
    """The name query of a request like `{!nameQuery f=name__fname tie=0.1}red widget`, also quoted or behind `_query_:`."""
    found = LOCAL.fullmatch(text.strip())
    if not found:
        raise ValueError(f"no name query: {text!r}")
    options = {k: a or b or c for k, a, b, c in OPTION.findall(found["options"])}
    if "f" not in options:
        raise ValueError("f must name a field")
    query = NameQuery.of(options | {"v": found["text"]})
    return Name(query, options["f"].removesuffix("_mv"), options["f"].endswith("_mv"))
