"""Models. An expression backend answers with Spark SQL expressions, which Catalyst compiles like any other;
an Arrow backend answers batches of documents in Python workers."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import types as T

from inquest.operators.calls import KINDS, ModelCall

FEATURE_TYPE = T.ArrayType(T.StructType([T.StructField("feature", T.IntegerType()), T.StructField("strength", T.FloatType())]))
NAMES = ("amber", "birch", "cedar", "dune", "ember")


def answer_type(call: ModelCall) -> T.DataType:
    if call.kind == "extract":
        return T.StructType([T.StructField(n, T.StringType()) for n, _ in call.fields])
    return {"if": T.BooleanType(), "score": T.DoubleType(), "classify": T.StringType(), "map": T.StringType(), "features": FEATURE_TYPE}[call.kind]


class ModelBackend(Protocol):
    """What a model must offer. ``expression`` may return None: then ``ask`` answers in batches."""

    name: str

    def supports(self, kind: str) -> bool: ...

    def expression(self, call: ModelCall, documents: Sequence[str]) -> str | None:
        """SQL for the answer, given the SQL of each document."""

    def ask(self, call: ModelCall, documents: Sequence[Sequence[str]]) -> list:
        """An answer for each tuple of documents, none of which is null."""


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def key_of(text: str) -> int:
    """A small number that depends on the question alone."""
    return sum(map(ord, text)) % 7


def words_weight(text: str) -> int:
    """ascii + length + ascii of the last character: what ExprBackend reads of a document."""
    return (ord(text[0]) + len(text) + ord(text[-1])) if text else 0


class ExprBackend:
    """A deterministic model that reads three numbers of a document. Every answer is a native expression."""

    name = "expression"

    def supports(self, kind: str) -> bool:
        return kind in KINDS

    def _weight(self, documents: Sequence[str]) -> str:
        return " + ".join(f"(ascii({d}) + length({d}) + ascii(right({d}, 1)))" for d in documents)

    def expression(self, call: ModelCall, documents: Sequence[str]) -> str:
        w, k = self._weight(documents), key_of(call.question)
        present = " AND ".join(f"({d}) IS NOT NULL" for d in documents)
        given = lambda x: f"(CASE WHEN {present} THEN {x} END)"
        if call.kind == "if":
            return given(f"({w} + {k}) % {3 if len(documents) > 1 else k + 2} = 0")
        if call.kind == "score":
            return given(f"(({w} + {k}) % 5) / 4.0D")
        if call.kind == "classify":
            labels = ", ".join(map(literal, call.labels))
            return given(f"element_at(array({labels}), cast(({w} + {k}) % {len(call.labels)} + 1 AS int))")
        if call.kind == "map":
            return given(f"element_at(array({', '.join(map(literal, NAMES))}), cast(({w} + {k}) % {len(NAMES)} + 1 AS int))")
        if call.kind == "features":
            made = ", ".join(f"named_struct('feature', cast(({w} * {m} + {k}) % 89 + {100 * i} AS int), 'strength', cast({3 - i} AS float))" for i, m in enumerate((1, 3, 7)))
            return given(f"array({made})")
        parts = ", ".join(f"{literal(n)}, {self.field(q, documents[0])}" for n, q in call.fields)
        return f"named_struct({parts})"

    def field(self, question: str, document: str) -> str:
        """The first, second or third word of the document; null if there is none."""
        return f"(CASE WHEN ({document}) IS NOT NULL THEN nullif(split_part(substring_index({document}, ' ', 3), ' ', cast(({self._weight([document])} + {key_of(question)}) % 3 + 1 AS int)), '') END)"

    def ask(self, call: ModelCall, documents: Sequence[Sequence[str]]) -> list:
        """The same in Python."""
        out = []
        for docs in documents:
            w, k = sum(map(words_weight, docs)), key_of(call.question)
            if call.kind == "if":
                out.append((w + k) % (3 if len(docs) > 1 else k + 2) == 0)
            elif call.kind == "score":
                out.append((w + k) % 5 / 4.0)
            elif call.kind == "classify":
                out.append(call.labels[(w + k) % len(call.labels)])
            elif call.kind == "map":
                out.append(NAMES[(w + k) % len(NAMES)])
            elif call.kind == "features":
                out.append([{"feature": (w * m + k) % 89 + 100 * i, "strength": float(3 - i)} for i, m in enumerate((1, 3, 7))])
            else:
                out.append({n: (docs[0].split(" ")[(w + key_of(q)) % 3 : (w + key_of(q)) % 3 + 1] or [""])[0] or None for n, q in call.fields})
        return out


class ArrowBackend:
    """A model behind a Python function: ``answer(call, documents) -> answers`` over batches.

    It runs in Python workers, so it and what it refers to must be picklable; a client for a remote model is
    opened inside the function. Texts that a model writes are brought to what was asked: labels are matched,
    extracted strings are found again in the document or dropped, mapped texts are trimmed.
    """

    def __init__(self, answer: Callable[[ModelCall, Sequence[Sequence[str]]], list], name: str = "arrow", kinds: Sequence[str] = KINDS, batch: int = 64) -> None:
        self.answer, self.name, self.kinds, self.batch = answer, name, tuple(kinds), batch

    def supports(self, kind: str) -> bool:
        return kind in self.kinds

    def expression(self, call: ModelCall, documents: Sequence[str]) -> None:
        return None

    def ask(self, call: ModelCall, documents: Sequence[Sequence[str]]) -> list:
        out: list = []
        for i in range(0, len(documents), self.batch):
            part = documents[i : i + self.batch]
            out += [tidy(call, a, d) for a, d in zip(self.answer(call, part), part, strict=True)]
        return out


def http_backend(url: str, name: str = "http", timeout: float = 60.0, **options) -> ArrowBackend:
    """A model behind an HTTP address that takes {call, documents} as JSON and returns {answers}.

    A document is a string, or {"base64": ...} where it is bytes, as images are.
    """

    def answer(call: ModelCall, documents: Sequence[Sequence[str]]) -> list:
        import base64
        import dataclasses
        import json
        import urllib.request

        plain = lambda x: {"base64": base64.b64encode(x).decode()} if isinstance(x, (bytes, bytearray)) else x
        body = json.dumps({"call": dataclasses.asdict(call), "documents": [list(map(plain, d)) for d in documents]}).encode()
        with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as reply:
            return json.load(reply)["answers"]

    return ArrowBackend(answer, name, **options)


def tidy(call: ModelCall, answer, documents: Sequence[str]):
    """What an answer of free form means."""
    if answer is None:
        return None
    if call.kind == "classify":
        return match_label(answer, call.labels)
    if call.kind == "map":
        return str(answer).strip()
    if call.kind == "extract":
        return {n: locate(documents[0], (answer or {}).get(n)) for n, _ in call.fields}
    if call.kind == "score":
        return min(1.0, max(0.0, float(answer)))
    return answer


def match_label(text: str, labels: Sequence[str]) -> str | None:
    """The label that a model's text begins with: the longest, then the first."""
    lines = [x for x in str(text).splitlines() if not x.strip().casefold().startswith("thought")]
    said = re.sub(r"^\s*answer:\s*", "", "\n".join(lines).strip(), flags=re.I).strip().casefold()
    found = [x for x in labels if said.startswith(x.casefold())]
    return max(found, key=lambda x: (len(x), -labels.index(x))) if found else None


def locate(document: str, answer: str | None) -> str | None:
    """The document's own text for an extracted string: the longest prefix in whole words that it holds."""
    span = locate_span(document, answer)
    return document[span[0] : span[1]] if span else None


def locate_span(document: str, answer: str | None) -> tuple[int, int] | None:
    words = (answer or "").split()
    whole = (answer or "").strip()
    if whole and (at := document.find(whole)) >= 0:
        return at, at + len(whole)
    for n in range(len(words), 0, -1):
        m = re.search(r"(?<!\w)" + r"\s+".join(map(re.escape, words[:n])) + r"(?!\w)", document, re.I)
        if m:
            return m.span()
    return None


def asking(backend: ModelBackend, call: ModelCall):
    """A pandas function over document columns; rows with a null document aren't asked."""

    def run(*documents):
        frame = pd.concat([d.rename(str(i)) for i, d in enumerate(documents)], axis=1)
        there = frame.notna().all(axis=1)
        kinds = frame[there].drop_duplicates()
        keys = list(kinds.itertuples(index=False, name=None))
        answers = dict(zip(keys, backend.ask(call, keys), strict=True)) if keys else {}
        rows = list(frame.itertuples(index=False, name=None))
        out = [answers[r] if ok else None for r, ok in zip(rows, there, strict=True)]
        if call.kind == "extract":
            names = [n for n, _ in call.fields]
            return pd.DataFrame({n: [None if a is None else a.get(n) for a in out] for n in names}, columns=names)
        return pd.Series(out, dtype=object)

    return run
