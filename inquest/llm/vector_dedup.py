"""Near-duplicate vectors with an inverted multi-index.

Vectors are scaled to length 1 and cut in halves; each half has a codebook of its own (k-means on at most
``SAMPLE`` vectors), and the product of the two codebooks is a grid of cells. Every vector lies in the cell of
its nearest codewords. A vector visits cells in the order of the multi-sequence traversal, least summed
distance first, and is compared with the vectors that lie there in double precision. How many cells are
visited is measured, not guessed: vectors are compared with all vectors by brute force, ``PROBES_TRIED`` at
first and then more, until ``LINKED`` of them have links, and the least power of two, ``FLOOR`` at least, that
finds ``recall`` of their links is taken. Where links are so rare that ``MOST_PROBES`` vectors show too few, each
vector of the sample gets a neighbour made at the least cosine that links, in a random direction, and the cells
are those that find ``recall`` of these. Where the vectors are few, the recall is missed, or the cells hold as many
vectors as there are, all vectors are compared with all.

Equal vectors collapse to one representative before the search and count with their number after it. Links are
counted inside blocks of at most ``BLOCK`` times ``BLOCK`` comparisons, never written as pairs: a block returns
counts and a spanning forest. A crowded cell becomes many blocks. A link that only one of its two vectors
finds counts for both.

Cases: vectors that are null, empty, zero or hold null or non-finite components have no links and are kept;
vectors are compared with those of the same dimension only; rows that repeat a vec_id are vectors of their
own; a row without vec_id has no links and a null component; vec_id may have any type that has an order; a table
without rows gives a table without rows; other columns, labels too, are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inquest.llm.common import dropped, forest, key_of, ship, stored
from inquest.llm.components import components

COSINE, RECALL = 0.9, 0.9999
SAMPLE = 20_000
PROBES_TRIED = 1024
#: Vectors with links that a measured recall rests on, at least; the fewest cells visited; the most probes in a round.
LINKED, FLOOR, ROUND = 300, 4, 8192
#: Vectors compared with all to see links, at most; beyond that neighbours are made.
MOST_PROBES = 16_384
BLOCK = 256
#: Vectors on a side of a block where all are compared with all.
EXACT_BLOCK = 4096
#: Vectors that a cell holds, about; the codebooks' largest size.
CELL, MOST_CODES = 16, 8192
_SPREAD = 17  # probe counts tried: 2**0 .. 2**(_SPREAD - 1)


def unit(values: list | None) -> bytes | None:
    """The vector over its length, as doubles; None where it can't have links."""
    if not values or any(v is None for v in values):
        return None
    v = np.array(values, np.float64)
    if not np.isfinite(v).all() or not v.any():
        return None
    v = v / np.abs(v).max()
    return (v / np.sqrt(v @ v)).tobytes()


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [unit(v) for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["vec_id", "unit"])


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    codes = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.concatenate([distances(part, codes).argmin(1) for part in np.array_split(x, 1 + len(x) * len(codes) // 4_000_000)])
        sums, n = np.zeros_like(codes), np.bincount(near, minlength=len(codes))
        np.add.at(sums, near, x)
        codes[n > 0] = sums[n > 0] / n[n > 0, None]
    return codes


def distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(1)


class MultiIndex:
    """Two codebooks and the traversal of their grid."""

    def __init__(self, sample: np.ndarray, n: int) -> None:
        self.half = sample.shape[1] // 2
        k = int(min(max(1, round((n / CELL) ** 0.5)), MOST_CODES, max(1, len(sample))))
        self.left = kmeans(sample[:, : self.half], k) if self.half else np.zeros((1, 0))
        self.right = kmeans(sample[:, self.half :], k)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, : self.half], self.left), distances(x[:, self.half :], self.right)

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return a.argmin(1) * len(self.right) + b.argmin(1)

    def visits(self, x: np.ndarray, cells: int) -> np.ndarray:
        """The first cells of the traversal for each vector: (vectors, at most ``cells``).

        The p-th nearest left codeword with the q-th nearest right one has p * q pairs at or before it, so only
        places with p * q <= cells can be among the first.
        """
        a, b = self.halves(x)
        p, q = (v.ravel() for v in np.mgrid[0 : min(cells, a.shape[1]), 0 : min(cells, b.shape[1])])
        near = (p + 1) * (q + 1) <= cells
        p, q = p[near], q[near]
        ia, ib = np.argsort(a, 1, kind="stable"), np.argsort(b, 1, kind="stable")
        total = np.take_along_axis(a, ia, 1)[:, p] + np.take_along_axis(b, ib, 1)[:, q]
        first = np.argsort(total, 1, kind="stable")[:, :cells]
        return np.take_along_axis(ia[:, p], first, 1) * len(self.right) + np.take_along_axis(ib[:, q], first, 1)

    def place(self, query: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """How many cells each query visits before the one given."""
        a, b = self.halves(query)
        own = a[np.arange(len(query)), cell // len(self.right)] + b[np.arange(len(query)), cell % len(self.right)]
        b = np.sort(b, 1)
        return np.array([sum(np.searchsorted(b[i], own[i] - a[i] - 1e-9, "left")) for i in range(len(query))], np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def made_neighbours(index: MultiIndex, x: np.ndarray, cosine: float, seed: int = 11) -> np.ndarray:
    """For each level of cells, how many of the vectors made at ``cosine`` from x find their origin only there."""
    side = np.random.default_rng(seed).standard_normal(x.shape)
    side -= (side * x).sum(1)[:, None] * x
    y = cosine * x + (1 - cosine * cosine) ** 0.5 * side / np.maximum(np.linalg.norm(side, axis=1), 1e-12)[:, None]
    counts = np.zeros(_SPREAD + 1, np.int64)
    for a, b in ((x[i : i + 512], y[i : i + 512]) for i in range(0, len(x), 512)):
        # a link is found from either side
        place = np.minimum(index.place(b, index.home(a)), index.place(a, index.home(b)))
        np.add.at(counts, np.minimum(np.ceil(np.log2(place + 1)).astype(int), _SPREAD), 1)
    return counts


def needed_visits(reps: DataFrame, index: MultiIndex, sample: np.ndarray, cosine: float, recall: float) -> int | None:
    """The least power of two of cells that finds ``recall`` of the links of some vectors, or of neighbours made
    from the sample; None if none does or the vectors are few."""
    dim = sample.shape[1]
    spark = reps.sparkSession
    n = reps.count()
    hashed = F.shiftrightunsigned(F.xxhash64("rep"), 11)
    counts, linked, done, probes = np.zeros(_SPREAD + 1, np.int64), 0, 0, PROBES_TRIED
    while linked < LINKED:
        if done + probes > MOST_PROBES:
            counts = made_neighbours(index, sample[:4096], cosine)
            break
        if 4 * (done + probes) > n:
            return None  # comparing all is hardly more work
        low, high = (int(x / n * (1 << 53)) for x in (done, done + probes))
        tried = reps.where((hashed >= low) & (hashed < high)).select("rep", "unit").toArrow()
        done, probes = done + probes, min(2 * probes, ROUND)
        if not tried.num_rows:
            continue
        sent = spark.sparkContext.broadcast((tried["rep"].to_numpy(), _matrix(tried["unit"].combine_chunks(), dim), index))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, queries, index = sent.value
            found = np.zeros((len(ids), _SPREAD + 1), np.int64)
            for whole in batches:
                for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                    own, x = batch.column(0).to_numpy(), _matrix(batch.column(1), dim)
                    q, at = np.nonzero((queries @ x.T >= cosine) & (ids[:, None] != own[None, :]))
                    home = index.home(x)
                    for part in np.array_split(np.arange(len(q)), 1 + len(q) // 4096):
                        place = index.place(queries[q[part]], home[at[part]])
                        np.add.at(found, (q[part], np.minimum(np.ceil(np.log2(place + 1)).astype(int), _SPREAD)), 1)
            q, k = np.nonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(k), pa.array(found[q, k])], ["q", "k", "n"])

        # the number of links by level beside the probes that have any, which are at most ROUND
        by = reps.select("rep", "unit").mapInArrow(run, "q bigint, k bigint, n bigint").groupBy("q", "k").agg(F.sum("n").alias("n")).toArrow()
        np.add.at(counts, by["k"].to_numpy(), by["n"].to_numpy())
        linked += len(np.unique(by["q"].to_numpy()))
        sent.unpersist()
    for k in range(_SPREAD):
        if counts[: k + 1].sum() >= recall * counts.sum():
            return max(FLOOR, 1 << k)
    return None


def _compare(dim: int, cosine: float):
    def run(table: pa.Table) -> pa.Table:
        role = table["role"].to_numpy()
        base, query = table.filter(pa.array(role == 0)), table.filter(pa.array(role == 1))
        out_a, out_b, kind = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int8)]
        if base.num_rows and query.num_rows:
            ids, others = base["rep"].to_numpy(), query["rep"].to_numpy()
            x, y = (_matrix(t["unit"].combine_chunks(), dim) for t in (base, query))
            # the cells that a base vector visits, to know whether it finds the query by itself
            sees = np.array(base["visits"].to_pylist(), np.int64)
            home = query["home"].to_numpy()
            for rows in np.array_split(np.arange(len(y)), 1 + len(y) // BLOCK):
                q, b = np.nonzero((y[rows] @ x.T >= cosine) & (others[rows][:, None] != ids[None, :]))
                q = rows[q]
                if not len(q):
                    continue
                lone = ~(sees[b] == home[q][:, None]).any(1)
                n_b, n_q = base["copies"].to_numpy()[b], query["copies"].to_numpy()[q]
                for at, size, mine in ((q, n_b, others), (b[lone], n_q[lone], ids)):
                    sums = np.bincount(at, size, len(mine)).astype(np.int64)
                    hit = np.flatnonzero(sums)
                    out_a.append(mine[hit])
                    out_b.append(sums[hit])
                    kind.append(np.zeros(len(hit), np.int8))
                names, local = np.unique(np.concatenate([others[q], ids[b]]), return_inverse=True)
                u, v = forest(local[: len(q)], local[len(q) :], len(names))
                out_a.append(names[u])
                out_b.append(names[v])
                kind.append(np.ones(len(u), np.int8))
        return pa.table({"kind": np.concatenate(kind), "a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return run


def search(reps: DataFrame, dim: int, cosine: float, recall: float) -> DataFrame:
    """reps: rep, copies, unit -> kind 0: rep a has b links found; kind 1: a and b are linked through."""
    spark = reps.sparkSession
    n = reps.count()
    share = min(1.0, 0.9 * SAMPLE / max(1, n))
    sample = reps.where(F.shiftrightunsigned(F.xxhash64(F.lit(3), "rep"), 11) < int(share * (1 << 53))).select("rep", "unit").limit(SAMPLE).toArrow().sort_by("rep")
    if not sample.num_rows:
        sample = reps.select("rep", "unit").orderBy("rep").limit(1).toArrow()
    vectors = _matrix(sample["unit"].combine_chunks(), dim)
    index = MultiIndex(vectors, n)
    cells = needed_visits(reps, index, vectors, cosine, recall)
    exact = cells is None or cells * CELL >= n
    most = EXACT_BLOCK if exact else BLOCK
    sent = spark.sparkContext.broadcast(index)  # two codebooks of at most MOST_CODES rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                x = _matrix(batch.column(2), dim)
                if exact:  # one cell, which all visit
                    home, visits = np.zeros(len(x), np.int64), np.zeros((len(x), 1), np.int64)
                else:
                    home, visits = sent.value.home(x), sent.value.visits(x, cells)
                    # its own cell comes first and counts as visited even if rounding disagrees
                    visits = np.where((visits == home[:, None]).any(1)[:, None], visits, np.c_[home, visits[:, :-1]])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(list(visits), pa.list_(pa.int64()))], ["rep", "copies", "unit", "home", "visits"])

    placed = stored(reps.select("rep", "copies", "unit").mapInArrow(run, "rep bigint, copies bigint, unit binary, home bigint, visits array<bigint>"), "placed")
    base = placed.select(F.lit(0).alias("role"), F.col("home").alias("cell"), "rep", "copies", "unit", "home", "visits")
    queries = placed.select(F.lit(1).alias("role"), F.explode("visits").alias("cell"), "rep", "copies", "unit", "home", F.lit(None).cast("array<bigint>").alias("visits"))
    counts = base.select("cell", F.lit(1).alias("nb"), F.lit(0).alias("nq")).unionByName(queries.select("cell", F.lit(0).alias("nb"), F.lit(1).alias("nq")))
    crowded = counts.groupBy("cell").agg(F.sum("nb").alias("nb"), F.sum("nq").alias("nq")).where(f"nb > {most} OR nq > {most}")
    crowded = stored(crowded.select("cell", F.ceil(F.col("nb") / most).alias("kb"), F.ceil(F.col("nq") / most).alias("kq")), "crowded")
    dealt = base.unionByName(queries).join(crowded, "cell", "left").withColumn("kb", F.greatest(F.coalesce("kb", F.lit(1)), F.lit(1))).withColumn("kq", F.greatest(F.coalesce("kq", F.lit(1)), F.lit(1)))
    own, many = F.xxhash64("rep"), lambda k: F.sequence(F.lit(0).cast("bigint"), F.col(k) - 1)
    dealt = dealt.withColumn("pieces", F.when(F.col("role") == 0, F.transform(many("kq"), lambda c: F.struct(F.pmod(own, F.col("kb")).alias("block"), c.alias("chunk")))).otherwise(F.transform(many("kb"), lambda b: F.struct(b.alias("block"), F.pmod(own, F.col("kq")).alias("chunk")))))
    dealt = dealt.select("role", "cell", F.explode("pieces").alias("piece"), "rep", "copies", "unit", "home", "visits").select("*", "piece.*").drop("piece")
    return dealt.groupBy("cell", "block", "chunk").applyInArrow(_compare(dim, cosine), "kind tinyint, a bigint, b bigint")


def link_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id -> vec_id, n_links, component_id, one row for each row of vectors."""
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)["vec_id"]
    ship(spark)
    units = stored(vectors.select("vec_id", "embedding").mapInArrow(_units, f"vec_id {kind}, unit binary").select("vec_id", "unit", *key_of("unit")), "units")
    valid = units.where("unit IS NOT NULL AND vec_id IS NOT NULL")
    copies = valid.groupBy("h1", "h2").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    # a number for each different vector, written so that it stays
    copies = stored(copies.withColumn("rep", F.monotonically_increasing_id()), "vector-copies")
    firsts = valid.join(copies, ["h1", "h2"]).where("vec_id = first_id").dropDuplicates(["rep"]).select("rep", "copies", "unit")
    firsts = stored(firsts, "vectors")
    found = None
    for row in firsts.select(F.length("unit").alias("bytes")).distinct().collect():  # the dimensions in use
        part = search(firsts.where(F.length("unit") == row["bytes"]), row["bytes"] // 8, cosine, recall)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = stored(found, "links")
    labels = components(found.where("kind = 1").select("a", "b"), "vector-groups")
    sums = found.where("kind = 0").groupBy(F.col("a").alias("of")).agg(F.sum("b").alias("n"))
    named = copies.join(sums, F.col("rep") == F.col("of"), "left").join(labels, F.col("rep") == F.col("node"), "left")
    named = stored(named.select("h1", "h2", "first_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "vector-classes")
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = stored(named.join(least, "component").drop("component", "first_id"), "vector-classes")
    dropped(spark, firsts, found, labels)
    out = units.join(named, (units["h1"] == named["h1"]) & (units["h2"] == named["h2"]) & units["unit"].isNotNull() & units["vec_id"].isNotNull(), "left")
    return out.select(units["vec_id"], F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", units["vec_id"]).alias("component_id"))


def membership(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    return link_vectors(vectors).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
