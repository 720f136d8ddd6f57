"""Counts over one whole text that the quality operators read."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inquest.llm.common import WHITE, WORD, ship, slices

SYMBOLS = "#*$%&|<>"
WINDOW = 8
_WORD = re.compile(WORD)
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_shouts", "n_marked", "n_plain", "n_headed")


def repeated_words(words: list[str]) -> int:
    """Words within windows of WINDOW words that occur twice or more.

    Windows get equal codes if and only if they are equal: pairs of words are numbered, then pairs of pairs,
    then pairs of those.
    """
    if len(words) < WINDOW + 1:
        return 0
    known: dict[str, int] = {}
    codes = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(known) == len(words):
        return 0
    for step in (1, 2, 4):
        pairs = codes[:-step] * (codes.max() + 1) + codes[step:]
        _, codes, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(counts) == len(codes):
            return 0
    twice = counts[codes] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:-WINDOW] += twice
    edge[WINDOW:] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def stats(text: str | None) -> tuple[int, ...]:
    """FIELDS of a text; a null text has no words and no lines.

    n_lines counts lines with a word, n_distinct different words, n_upper words in capitals, n_shouts words
    ending in !!, n_marked words ending in . ? or !, n_plain words ending in a letter, a digit or usual
    punctuation, n_headed words beginning with a letter or digit.
    """
    if not text:
        return (0,) * len(FIELDS)
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    symbols = sum(map(text.count, SYMBOLS))
    ends = [w[-1] for w in words]
    marked = ends.count(".") + ends.count("?") + ends.count("!")
    shouts = sum(w.endswith("!!") for w in words) if "!!" in text else 0
    plain = sum(map(str.isalnum, ends)) + sum(map(ends.count, ".,;:?!)\"'")) - shouts
    headed = sum(w[0].isalnum() for w in words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), len(set(words)), sum(map(str.isupper, words)), shouts, marked, plain, headed


def with_stats(docs: DataFrame, carried: list[str]) -> DataFrame:
    """The carried columns and FIELDS of each row."""
    ship(docs.sparkSession)
    given = docs.select("text", *(f"`{c}`" for c in carried))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = np.array([stats(t) for t in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(rows[:, k]) for k in range(len(FIELDS)))], [*batch.schema.names[1:], *FIELDS])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[1:]), *(f"{f} bigint" for f in FIELDS)])
    return given.mapInArrow(run, schema)
