"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are character 1-, 2- and 3-grams of the lower-cased text, hashed to ``2**BITS`` columns, with
1 + log(tf) times idf, scaled to length 1. Document frequencies are summed over every training document. The
model is fitted by follow-the-regularised-leader with elastic-net penalties (per-coordinate rates; the L1 part
leaves most weights exactly 0) on at most ``SAMPLE`` training documents, drawn by a hash of the row with as many from
each language as there are, up to an equal share, so that rare languages are learned. Only their features reach
the driver, at most ``2**BITS`` columns each however long the text. A temperature is then fitted on a tenth of that
sample which the fit did not see. Prediction reads whole texts.

Cases: a null text or one without a letter is ``und`` with score 0; documents without lang are predicted but
never learned from; with no training document at all every text is ``und``; with one language only, that
language is predicted; ties go to the first language in code-point order; repeated rows each get their result;
doc_id may have any type; a table without rows gives a table without rows; other columns are ignored whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquest.llm.common import fold_of, mix64, ship, slices

BITS = 15
#: Training documents that the fit reads at most.
SAMPLE = 8000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.01
_LETTER = regex.compile(r"\p{L}")
_SIZE = 1 << BITS


def ngrams(text: str) -> np.ndarray:
    """Hashed character 1- to 3-grams, in no order, of a whole text."""
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    if codes.max() < 1024:  # three letters of ten bits
        one = codes.astype(np.uint32)
        two, tri = one[:-1] << 10 | one[1:], one[:-2] << 20 | one[1:-1] << 10 | one[2:]
        return np.concatenate([_short(one), _short(two + np.uint32(0x40000000)), _short(tri + np.uint32(0x80000001))])
    one = codes.astype(np.uint64)
    two, tri = one[:-1] << np.uint64(21) | one[1:], one[:-2] << np.uint64(42) | one[1:-1] << np.uint64(21) | one[2:]
    wide = np.concatenate([one, two + np.uint64(1 << 43), tri])
    return (mix64(wide) >> np.uint64(64 - BITS)).astype(np.int64)


def _short(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x >> np.uint32(32 - BITS)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Columns and 1 + log(tf)."""
    counts = np.bincount(ngrams(text), minlength=_SIZE)
    at = np.flatnonzero(counts)
    return at, 1.0 + np.log(counts[at])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many documents have each column, and how many there are: at most 2**BITS numbers a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(_SIZE + 1, np.int64)
        for batch in slices(batches, "text"):
            for text in batch.column(0).to_pylist():
                if text:
                    df[np.bincount(ngrams(text), minlength=_SIZE).nonzero()[0]] += 1
                    df[_SIZE] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["at", "n"])

    out = np.zeros(_SIZE + 1, np.int64)
    for r in docs.select("text").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out[:_SIZE], int(out[_SIZE])


@dataclass
class Ftrl:
    """Multinomial logistic regression, follow-the-regularised-leader with elastic net."""

    classes: int

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros((_SIZE + 1, self.classes)), np.zeros((_SIZE + 1, self.classes))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.append(at, _SIZE), np.append(x, 1.0)  # the last column is the constant
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1.0
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of logits with the least log loss, by golden-section search over its logarithm."""

    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()

    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


@dataclass
class LanguageModel:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    heat: float

    def logits(self, text: str) -> np.ndarray:
        at, tf = features(text)
        x = tf * self.idf[at]
        return x @ self.weights[at] / max(float(np.sqrt(x @ x)), 1e-12) + self.weights[_SIZE]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0
        p = softmax(self.logits(text) / self.heat)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def quotas(counts: dict[str, int], sample: int) -> dict[str, float]:
    """The share of each language's documents to draw: all of the rare ones, an equal number of the others."""
    left, out = 0.9 * sample, {}
    for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        take = min(n, left / (len(counts) - k))
        out[lang] = take / n
        left -= take
    return out


@dataclass
class Drawn:
    """Features of a sample of rows that have a letter, in the order of their draw, one array for all."""

    langs: list[str]
    bounds: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    idf: np.ndarray

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns and TF-IDF of length 1."""
        at = self.columns[self.bounds[i] : self.bounds[i + 1]].astype(np.int64)
        x = self.values[self.bounds[i] : self.bounds[i + 1]].astype(float) * self.idf[at]
        return at, x / np.sqrt(x @ x)


def _draw(known: DataFrame, share: Column, sample: int, idf: np.ndarray) -> Drawn:
    drawn = known.where(F.shiftrightunsigned("draw", 11) < share * float(1 << 53))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [(d, lang, *features(t)) for d, lang, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if _LETTER.search(t)]
            arrays = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())]
            arrays += [pa.array([r[k].astype(t).tobytes() for r in rows], pa.binary()) for k, t in ((2, np.uint16), (3, np.float16))]
            yield pa.RecordBatch.from_arrays(arrays, ["draw", "lang", "at", "tf"])

    made = drawn.select("draw", "lang", "text").mapInArrow(run, "draw bigint, lang string, at binary, tf binary").orderBy("draw").limit(sample)
    table = made.toArrow().sort_by([("draw", "ascending"), ("lang", "ascending")])
    columns, values = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("at", np.uint16), ("tf", np.float16)))
    sizes = pc.binary_length(table["at"]).to_numpy() // 2
    return Drawn(table["lang"].to_pylist(), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), columns, values, idf)


def fit(docs: DataFrame, training: Column, sample: int = SAMPLE) -> LanguageModel:
    """Learn from text and lang of the rows where ``training`` holds and lang is not null."""
    ship(docs.sparkSession)
    known = docs.where(training & F.col("lang").isNotNull()).select("text", "lang", F.xxhash64("doc_id", "text").alias("draw"))
    df, total = document_frequencies(known)
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    known = known.where("text IS NOT NULL")
    # copies of a text differ in their ids, so a hash of both draws them apart; one row for each language
    share = quotas({r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}, sample)
    if not share:
        return LanguageModel([], idf, np.zeros((_SIZE + 1, 1)), 1.0)
    drawn = _draw(known, F.create_map(*(F.lit(x) for pair in share.items() for x in pair))[F.col("lang")], sample, idf)
    langs = sorted(set(drawn.langs))
    label = [langs.index(lang) for lang in drawn.langs]
    model = Ftrl(max(1, len(langs)))
    held = list(range(0, len(label), 10)) if len(label) >= 50 else []
    learned = [i for i in range(len(label)) if i % 10] if held else list(range(len(label)))
    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(learned)):
            model.learn(*drawn[learned[k]], label[learned[k]])
    weights = model.weights(slice(None))
    logits = np.array([x @ weights[at] + weights[_SIZE] for at, x in (drawn[i] for i in held)])
    heat = temperature(logits, np.array([label[i] for i in held])) if held and len(langs) > 1 else 1.0
    return LanguageModel(langs, idf, weights, heat)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score."""
    ship(docs.sparkSession)
    # the model has a fixed size: 2**BITS rows of one number for each language and two more
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = [sent.value.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def recognised(docs: DataFrame, model: LanguageModel, least: float) -> DataFrame:
    """The rows of docs whose language the model tells with a score of at least ``least``; one pass, no shuffle."""
    ship(docs.sparkSession)
    sent, place = docs.sparkSession.sparkContext.broadcast(model), [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, place):
            said = map(sent.value.predict, batch.column(place).to_pylist())
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in said], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out() -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.pmod(fold_of("doc_id"), F.lit(4)) == 2, F.lit(False))


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document."""
    model = fit(docs, ~held_out())
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
