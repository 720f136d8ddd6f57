"""Calls to a model: what is asked, checked before anything runs."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from inquest.errors import CompileError, SimilarCallWarning

KINDS = ("if", "score", "classify", "extract", "map", "features")
#: Shares of rows that a test keeps when nothing is known, and weights of a call for ordering.
SELECTIVITY = 0.2
WEIGHTS = {"if": 1.0, "score": 1.0, "classify": 1.1, "map": 1.4, "extract": 1.6, "features": 1.0}
MAP_TOKENS, MOST_MAP_TOKENS = 256, 32768
_HOLE = re.compile(r"\{(\d+)\}")


@dataclass(frozen=True)
class Prompt:
    """A template whose {k} stand for documents."""

    template: str

    def check(self, values: int) -> Prompt:
        used = {int(k) for k in _HOLE.findall(self.template)}
        if missing := sorted(used - set(range(values))):
            raise CompileError(f"PROMPT uses {{{missing[0]}}} but has {values} value{'s' * (values != 1)}")
        if unused := sorted(set(range(values)) - used):
            raise CompileError(f"PROMPT never uses its value {{{unused[0]}}}")
        return self

    def pieces(self) -> list[str | int]:
        """Text and document numbers in turn."""
        return [int(p) if i % 2 else p for i, p in enumerate(_HOLE.split(self.template))]

    def question(self) -> str:
        """The template with its documents left out."""
        return " ".join(p for p in (str(x).strip() for x in self.pieces()[::2]) if p)


@dataclass(frozen=True)
class ModelCall:
    """One question about one or more documents; equal calls are one call."""

    kind: str
    question: str
    documents: int = 1
    labels: tuple[str, ...] = ()
    descriptions: tuple[str, ...] = ()
    fields: tuple[tuple[str, str], ...] = ()
    task: str = ""
    max_tokens: int = MAP_TOKENS
    pooling: str = "last"
    selectivity: float | None = None
    probabilities: bool = False
    anchor: str | None = None

    def identity(self) -> ModelCall:
        """Without what only steers the plan."""
        return replace(self, selectivity=None, anchor=None, probabilities=False)

    @property
    def keeps(self) -> float:
        return SELECTIVITY if self.selectivity is None else self.selectivity

    @property
    def cost(self) -> float:
        base = WEIGHTS[self.kind] * (1 + (self.kind == "map" and self.max_tokens > 64))
        return base * max(1, len(self.fields)) * self.documents

    def rank(self) -> float:
        """Order of tests on the same rows, least first: cost for each row that is spared."""
        return self.cost / max(1e-6, 1 - self.keeps)


def check_options(options: dict, allowed: Sequence[str]) -> dict:
    for name, value in options.items():
        if name not in allowed:
            raise CompileError(f"unknown option '{name}'; expected one of {', '.join(allowed)}")
        if name == "selectivity" and (isinstance(value, bool) or not isinstance(value, (int, float))):
            raise CompileError("selectivity must be a number")
        if name == "selectivity" and not 0 <= value <= 1:
            raise CompileError("selectivity must lie between 0 and 1")
        if name == "anchor" and not isinstance(value, str):
            raise CompileError("anchor must be the name of a table")
        if name == "probabilities" and not isinstance(value, bool):
            raise CompileError("probabilities must be true or false")
    return options


def check_labels(given: Iterable) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Labels and their descriptions from strings, {label, description} objects or pairs."""
    if isinstance(given, dict):
        given = given.get("categories", [])
    labels, described = [], []
    for item in given:
        if isinstance(item, str):
            labels.append(item)
        elif isinstance(item, dict):
            labels.append(item.get("label", ""))
            described.append(item.get("description") or "")
        else:
            labels.append(item[0])
            described.append(item[1] if len(item) > 1 else "")
    if len(labels) < 2:
        raise CompileError("AI.CLASSIFY needs at least two labels")
    if any(not isinstance(x, str) or not x.strip() for x in labels):
        raise CompileError("labels must be strings that aren't empty")
    if len({x.casefold() for x in labels}) < len(labels):
        raise CompileError("labels must differ by more than letter case")
    if described and (len(described) < len(labels) or not all(described)) and any(described):
        raise CompileError("either all labels have a description or none")
    if any(len(d.split()) > 25 for d in described):
        raise CompileError("a label's description has at most 25 words")
    return tuple(labels), tuple(described) if all(described) else ()


def check_fields(given: dict | Sequence[tuple[str, str]]) -> tuple[tuple[str, str], ...]:
    pairs = list(given.items()) if isinstance(given, dict) else list(given)
    if not pairs:
        raise CompileError("AI.EXTRACT needs at least one field")
    names = [n for n, _ in pairs]
    if twice := next((n for n in names if names.count(n) > 1), None):
        raise CompileError(f"field '{twice}' is written twice")
    if empty := next((n for n, q in pairs if not str(q).strip()), None):
        raise CompileError(f"the question of field '{empty}' is empty")
    return tuple((str(n), str(q)) for n, q in pairs)


def check_map(question: str, max_tokens: int) -> None:
    if not 1 <= max_tokens <= MOST_MAP_TOKENS:
        raise CompileError(f"max_tokens must lie between 1 and {MOST_MAP_TOKENS}")
    if _HOLE.search(question):
        raise CompileError("the instruction of AI.MAP has no {N}; give the document as its first argument")


def check_known_label(call: ModelCall, value: str) -> None:
    if value not in call.labels:
        raise CompileError(f"'{value}' is not a label; the labels are {', '.join(call.labels)}")


def _bare(text: str) -> str:
    return re.sub(r"[\W_]+", "", text.casefold())


def _edits(a: str, b: str, most: int) -> int:
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def check_similar(calls: Iterable[ModelCall]) -> None:
    """Refuse questions that differ in case, space or punctuation only; warn of a likely slip."""
    seen: list[ModelCall] = []
    for call in calls:
        for other in seen:
            if call.kind != other.kind or call.identity() == other.identity() or call.documents != other.documents:
                continue
            a, b = call.question, other.question
            if a == b:
                continue
            if _bare(a) == _bare(b):
                raise CompileError(f"two calls ask the same but for case, space or punctuation: '{a}' and '{b}'; write them alike")
            digits = re.findall(r"\d", a) == re.findall(r"\d", b)
            if digits and min(len(a), len(b)) >= 12 and _edits(a.casefold(), b.casefold(), 2) <= 2:
                warnings.warn(f"two calls ask nearly the same: '{a}' and '{b}'", SimilarCallWarning, stacklevel=3)
        seen.append(call)
