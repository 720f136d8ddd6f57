"""Quality rules as weak supervision.

Each rule votes good, votes bad or abstains. Nobody says how far a rule is to be trusted:
expectation-maximisation estimates, from the votes of all documents, how often each rule votes so on good and
on bad documents, and how many documents are good. A document is kept if the posterior probability that it is
good reaches ``threshold``. There are at most 3**len(RULES) different patterns of votes, so the votes of any
number of documents are summed into a table of bounded size before the driver sees them.

Cases: null and empty texts have no words and are not kept (the base rule says so); repeated rows get equal
verdicts; with a table without rows the priors stand; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquest.llm.common import stored
from inquest.llm.textstats import with_stats

GOOD, BAD, NONE = 0, 1, 2


def _per_word(field: str) -> Column:
    return F.col(field) / F.greatest(F.col("n_words"), F.lit(1))


def _vote(bad: Column, good: Column | None = None) -> Column:
    return F.when(bad, BAD).otherwise(NONE) if good is None else F.when(bad, BAD).when(good, GOOD).otherwise(NONE)


def rules() -> dict[str, Column]:
    """Name -> vote. A rule votes good only where what it sees speaks for prose; else it abstains."""
    symbols, repeats, capitals, shouts = map(_per_word, ("n_symbols", "n_repeat_words", "n_upper", "n_shouts"))
    length, distinct, marked, plain, headed = map(_per_word, ("word_chars", "n_distinct", "n_marked", "n_plain", "n_headed"))
    copied = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    n = F.col("n_words")
    return {
        "symbols": _vote(symbols >= 0.15, symbols <= 0.03),
        "word_ends": _vote(plain <= 0.75, plain >= 0.95),
        "word_starts": _vote(headed <= 0.85, headed >= 0.97),
        "sentences": _vote((n >= 30) & ((marked < 0.004) | (marked > 0.6)), (n >= 30) & (marked >= 0.02) & (marked <= 0.4)),
        "capitals": _vote((n >= 20) & (capitals >= 0.5)),
        "shouts": _vote(shouts >= 0.1, shouts == 0),
        "word_length": _vote((length < 2) | (length > 14)),
        "copied_lines": _vote(copied >= 0.3),
        "repeats": _vote(repeats > 0.3, repeats <= 0.05),
        "distinct": _vote((n >= 50) & (distinct < 0.1)),
    }


@dataclass
class LabelModel:
    """good: share of good documents; votes[y, j, v]: how often rule j votes v on documents of class y."""

    good: float
    votes: np.ndarray

    @classmethod
    def fit(cls, patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, smooth: float = 1.0) -> LabelModel:
        """Expectation-maximisation over patterns (rows of votes) and how many documents have each.

        It starts from rules that are right four times in five, so "good" keeps its meaning.
        """
        n_rules = patterns.shape[1] if patterns.size else len(rules())
        start = np.array([[[0.72, 0.08, 0.2]], [[0.3, 0.5, 0.2]]])
        model = cls(0.8, np.repeat(start, n_rules, axis=1))
        prior = model.votes.copy() * smooth * 10
        for _ in range(rounds if len(counts) else 0):
            p = model.posterior(patterns)
            held = np.stack([p * counts, (1 - p) * counts])
            votes = prior + np.stack([np.stack([held @ (patterns == v) for v in range(3)], -1)])[0]
            good = (held[0].sum() + 8) / (counts.sum() + 10)
            fresh = cls(float(good), votes / votes.sum(-1, keepdims=True))
            done = np.abs(fresh.votes - model.votes).max() < 1e-9
            model = fresh
            if done:
                break
        return model

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        odds = self.log_odds()
        return 1 / (1 + np.exp(-(self.prior_odds() + sum(odds[j][patterns[:, j]] for j in range(patterns.shape[1])))))

    def prior_odds(self) -> float:
        return float(np.log(self.good / (1 - self.good)))

    def log_odds(self) -> np.ndarray:
        return np.log(self.votes[GOOD] / self.votes[BAD])


def judge(docs: DataFrame, threshold: float = 0.5, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carried, the counts, ``votes`` (list of GOOD, BAD or NONE), ``quality`` (posterior), base_failed, kept."""
    counted = stored(with_stats(docs, list(carried)).withColumn("votes", F.array(*(v.cast("tinyint") for v in rules().values()))), "votes")
    n = len(rules())
    code = sum((F.col("votes")[j].cast("int") * 3**j for j in range(n)), F.lit(0))
    table = counted.groupBy(code.alias("code")).count().collect()  # at most 3**n rows
    patterns = np.array([[r["code"] // 3**j % 3 for j in range(n)] for r in table]).reshape(-1, n)
    model = LabelModel.fit(patterns, np.array([r["count"] for r in table], float))
    odds = sum((F.element_at(F.array(*map(F.lit, map(float, w))), F.col("votes")[j] + 1) for j, w in enumerate(model.log_odds())), F.lit(model.prior_odds()))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = counted.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def verdicts(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
