"""A name query and the clauses it compiles to."""

from __future__ import annotations

from dataclasses import dataclass, field

from onomast.functions import analysis as an

FIELDS = ("an", "syn", "rs", "initial", "exact")


def flag(value) -> bool:
    """Only `true`, in any case, is true."""
    return value if isinstance(value, bool) else str(value).lower() == "true"


@dataclass(frozen=True)
class Clause:
    """kind: term, exact, half (a bare initial), wild or fuzzy. target None: any position. variant 1: the joined words."""

    variant: int
    n_tok: int
    tok: int
    kind: str
    field: str
    term: str
    target: int | None
    boost: float
    guard: bool
    #: A fuzzy word's terms with their weights, where a dictionary was asked.
    among: tuple[tuple[str, float], ...] | None = None


@dataclass(frozen=True)
class NameQuery:
    """Options of a name query. gender_value names a gender to exclude; compat keeps the bare initial wildcard unpositioned and unboosted."""

    text: str
    tie: float = 0.0
    exactboost: float = 1.01
    synboost: float = 0.8
    initialboost: float = 0.42
    phoneticboost: float = 0.75
    nullboost: float = 0.01
    fuzzyboost: float = 0.2
    wildboost: float = 0.1
    useexact: bool = False
    usefuzzy: bool = False
    usephonetic: bool = True
    usenull: bool = True
    useinitial: bool = True
    usesyn: bool = True
    is_surname: bool = True
    surname_field: bool | None = None  # which chain analyses the text; as is_surname unless said
    gender_value: str | None = None
    gender_field: str = "Gender__facet_text"
    field_name: str | None = None  # the field that requests name, `_mv` included
    compat: bool = True
    extra: dict = field(default_factory=dict, compare=False)

    @staticmethod
    def of(params: dict[str, str]) -> NameQuery:
        """From request parameters: v, f and the options as strings."""
        names = {"isSurname": "is_surname", "gendervalue": "gender_value", "genderfield": "gender_field"}
        made: dict = {"text": params["v"].strip(), "surname_field": "lname" in params.get("f", "lname"), "field_name": params.get("f")}
        for k, v in params.items():
            k = names.get(k, k)
            if k.startswith("use") or k == "is_surname":
                made[k] = flag(v)
            elif k.endswith("boost") or k == "tie":
                made[k] = float(v)
            elif k in ("gender_value", "gender_field"):
                made[k] = v
        return NameQuery(**made)

    def clauses(self) -> list[Clause]:
        by_surname = self.is_surname if self.surname_field is None else self.surname_field
        words = an.query_words(self.text, by_surname)
        any_place = self.is_surname and len(words) == 1
        out: list[Clause] = []
        for k, word in enumerate(words):
            out += self._alternatives(0, len(words), k, word, None if any_place else k, 1.0)
        if len(words) > 1 and self.is_surname:
            out += self._alternatives(1, 1, 0, "".join(words), None, float(len(words)))
        return out

    def _alternatives(self, variant: int, n: int, tok: int, word: str, target: int | None, factor: float) -> list[Clause]:
        def clause(kind: str, field_: str, term: str, boost: float, guard: bool, at: int | None = target) -> Clause:
            # a term at any position is never guarded
            return Clause(variant, n, tok, kind, field_, term, at, boost, guard and bool(self.gender_value) and (kind != "term" or at is not None))

        if "*" in word or "?" in word:
            if not self.is_surname and len(word) == 2 and word[0] not in "*?":
                if self.compat:
                    return [clause("half", "initial", word[0], 1.0, False, None)]
                return [clause("term", "initial", word[0], self.wildboost * factor, True)]
            return [clause("wild", "an", word, self.wildboost * factor, True, None)]
        out = [clause("term", "an", word, factor, False)]
        if self.useexact:
            out.append(clause("exact", "exact", an.query_exact(self.text), self.exactboost * factor, False, None))
        if self.usenull:
            out.append(clause("exact", "exact", "-", self.nullboost * factor, target is not None))
        if len(word) == 1:
            if self.useinitial:
                out.append(clause("term", "initial", word, self.initialboost * factor, True))
            return out
        if self.usesyn:
            out.append(clause("term", "syn", word, self.synboost * factor, False))
        if self.useinitial:
            out.append(clause("term", "an", word[0], self.initialboost * factor, True))
        if self.usephonetic and (code := an.query_code(word)):
            out.append(clause("term", "rs", code, self.phoneticboost * factor, True))
        if self.usefuzzy:
            out.append(clause("fuzzy", "an", word, self.fuzzyboost * factor, True, None))
        return out


def like(pattern: str) -> str:
    """A wildcard pattern as a LIKE pattern, escaped by a backslash."""
    return "".join({"*": "%", "?": "_", "%": "\\%", "_": "\\_", "\\": "\\\\"}.get(c, c) for c in pattern)


def most_edits(word: str) -> int:
    return 2 if len(word) > 8 else 1
