"""Quality classifier with hierarchical empirical Bayes.

A document classifier (logistic regression over ten counts of the text, fitted on at most ``SAMPLE`` labelled
documents) gives each document a probability. The documents of a host, and of a path below it, are evidence
about each other: a host's share of good documents is a Beta posterior around the global share, a path's one
around its host's, and how strongly small groups shrink is estimated from the groups themselves by the method
of moments. A path's documents are no evidence for its own prior, and a document's none for its path, so a
host's share is that of its other paths and a path's that of its other documents; then

    logit(quality) = logit(document) + logit(path's share) - logit(global share).

Sums per host and path combine before the shuffle, so one host with a third of all documents is a few rows.

Cases: null hosts and null paths are groups of their own; null and empty texts have all counts 0; labels that
are null, or whose document is missing, are not learned from; a document with several labels is learned from
once for each; rows that repeat a doc_id are documents of their own, each with that id's labels; with labels of
one kind or none the classifier is the labels' share (0.5 without labels); texts are read whole however long; a
table without rows gives a table without rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquest.llm.common import stored
from inquest.llm.textstats import with_stats

#: Labelled documents that the fit reads at most.
SAMPLE = 20_000
_INPUTS = ("log_words", "word_length", "symbols", "copied_lines", "repeats", "distinct", "capitals", "shouts", "marked", "line_words")


def _inputs() -> dict[str, Column]:
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    values = (F.log1p("n_words"), F.col("word_chars") / n, F.least(F.col("n_symbols") / n, F.lit(2.0)), F.col("n_dup_lines") / lines, F.col("n_repeat_words") / n, F.col("n_distinct") / n, F.col("n_upper") / n, F.col("n_shouts") / n, F.col("n_marked") / n, F.log1p(F.col("n_words") / lines))
    return dict(zip(_INPUTS, values, strict=True))


def fit_classifier(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression, the last one the constant, by Newton's method; inputs as they are."""
    if not len(y) or len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 0.02), 0.98)
        return np.append(np.zeros(x.shape[1] if x.ndim == 2 else len(_INPUTS)), np.log(share / (1 - share)))
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    w, penalty = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    slope = w[:-1] / spread
    return np.append(slope, w[-1] - slope @ mean)


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, centre: Column, n: str = "n", good: str = "good") -> float:
    """Prior count by the method of moments: what groups vary beyond what their sizes explain."""
    expected = centre * (1 - centre)
    n_, rate = F.col(n), F.col(good) / F.col(n)
    rows = groups.where(n_ > 1)
    spread, within, e, k = rows.agg(F.avg((rate - centre) ** 2), F.avg(expected / n_), F.avg(expected), F.count("*")).first()
    if not k or not e:
        return 100.0
    between = max((spread or 0.0) - (within or 0.0), 1e-9)
    return float(min(max(e / between - 1, 2.0), 10_000.0))


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """doc_id, host, path, document (the classifier's), path_share, quality, kept.

    labels: doc_id, quality (0 or 1).
    """
    keyed = docs.select("doc_id", "text", host.alias("host"), path.alias("path"))
    counted = stored(with_stats(keyed, ["doc_id", "host", "path"]).select("doc_id", "host", "path", *(c.alias(n) for n, c in _inputs().items())), "site-counts")
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("label"))
    share = min(1.0, 0.9 * sample / max(1, known.count()))
    draw = F.xxhash64("doc_id")
    drawn = known.where(F.shiftrightunsigned(draw, 11) < int(share * (1 << 53)))
    # in the order of the draw, should ids repeat so often that the share is more than the sample
    rows = counted.join(drawn, "doc_id").select(draw.alias("draw"), "label", *_INPUTS).orderBy("draw", "label", *_INPUTS).limit(sample).toPandas()
    w = fit_classifier(rows[[*_INPUTS]].to_numpy(float), rows["label"].to_numpy(float))
    odds = sum((F.col(c) * float(w[k]) for k, c in enumerate(_INPUTS)), F.lit(float(w[-1])))
    judged = stored(counted.select("doc_id", "host", "path", (1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(30.0)), F.lit(-30.0))))).alias("document")), "site-documents")
    paths = stored(judged.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("document").alias("good")), "site-paths")
    total, good = paths.agg(F.sum("n"), F.sum("good")).first()
    centre = min(max((good or 0.0) / (total or 1), 1e-3), 1 - 1e-3)
    hosts = paths.groupBy(F.col("host").alias("host_")).agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    k_host = _strength(hosts, F.lit(centre), "host_n", "host_good")
    groups = paths.join(hosts, F.col("host").eqNullSafe(F.col("host_")))
    others = (k_host * F.lit(centre) + F.col("host_good") - F.col("good")) / (k_host + F.col("host_n") - F.col("n"))
    k_path = _strength(groups, others)
    groups = groups.select(F.col("host_"), F.col("path").alias("path_"), "n", "good", "host_n", "host_good")
    both = judged.join(groups, F.col("host").eqNullSafe(F.col("host_")) & F.col("path").eqNullSafe(F.col("path_")))
    # what a path holds is no evidence about its host's other paths, nor a document about its neighbours
    host_share = (k_host * centre + F.col("host_good") - F.col("good")) / (k_host + F.col("host_n") - F.col("n"))
    path_share = (k_path * host_share + F.col("good") - F.col("document")) / (k_path + F.col("n") - 1)
    out = both.withColumn("path_share", path_share).withColumn("quality", 1 / (1 + F.exp(-(_logit(F.col("document")) + _logit(F.col("path_share")) - _logit(F.lit(centre))))))
    return out.select("doc_id", "host", "path", "document", "path_share", "quality", (F.col("quality") >= threshold).alias("kept"))


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents: the source is the host, source and language the path."""
    return score(docs, labels, F.col("source"), F.col("lang")).select("doc_id", "document", "path_share", "quality", "kept")
