"""Near-duplicate documents by BagMinHash over weighted word shingles.

A document is the multiset of its shingles of ``WORDS`` words. Two documents are linked if the overlap of their
multisets, sum of minima over sum of maxima, is at least ``similarity``; a group is a connected component of
links, and its document of the smallest id stays.

Signatures come from hierarchical Poisson processes. The weight axis of a shingle is cut into the dyadic blocks
(0,1], (1,2], (2,4], (4,8], ...; each block has a Poisson process whose rate is its length, whose points fall on
a uniform register and a uniform place of the block. A document with weight w sees exactly the points placed at
w or below, so a register's least point is shared by two documents with a probability equal to their weighted
Jaccard similarity. Points come in rising order, so a shingle is left as soon as its next point lies above
every register: nearly all of them after one point.

Copies collapse first: one representative for each different text. Bands of registers make buckets. A bucket of
n documents never becomes n*n rows: each document is paired with the bucket's leader, the document with the
most company, and the pairs' whole multisets are compared. Buckets that then still hold several components are
finished exactly: their members outside the main component are compared with all others, in blocks of matrix
products that return connecting edges only. Every pair of a bucket is compared or already connected.

Cases: null and empty texts, and texts without a word, are groups of their own; a text of fewer than WORDS
words is one shingle, and a very long one is read whole; a row without doc_id is kept with a null group; rows that
repeat a doc_id are told apart by their texts, each in its text's group, so that no text is lost with another of
the same id; ties don't matter, as the smallest id stays; doc_id may have any type that has an order; a table
without rows gives a table without rows; other columns pass through ``deduplicated`` whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inquest.llm.common import WORD, WordHashes, dropped, forest, free_name, key_of, mix64, ship, slices, stored
from inquest.llm.components import components

WORDS, SIMILARITY = 5, 0.8
#: At similarity 0.8, 25 bands of 5 miss a pair with a chance of 5e-5.
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
_WORD = re.compile(WORD)
_GOLD, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """A hash for each run of WORDS words, repeats included; of all words if they are fewer."""
    found = _WORD.findall(text) if text else []
    if not found:
        return np.zeros(0, np.uint64)
    words = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    span = min(WORDS, len(words))
    n = len(words) - span + 1
    h = np.full(n, span, np.uint64)
    for k in range(span):
        h = mix64(h * _GOLD + words[k : k + n])
    return h


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """For each bag (different shingles, weights of at least 1) the least point in each register.

    A bag without shingles has infinite registers.
    """
    mins = np.full((len(bags), registers), np.inf)
    doc = np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags])
    if not len(doc):
        return mins
    shingle, weight = np.concatenate([h for h, _ in bags]), np.concatenate([w for _, w in bags]).astype(np.float64)
    parts, block = [], 0
    at = np.arange(len(doc))
    while len(at):  # a row for each block that begins below the weight
        low, length = (0.0, 1.0) if block == 0 else (2.0 ** (block - 1), 2.0 ** (block - 1))
        at = at[weight[at] > low]
        base = mix64(shingle[at] ^ mix64(np.full(1, block + 1, np.uint64) * _TURN))
        parts.append((doc[at], base, np.full(len(at), length), np.minimum((weight[at] - low) / length, 1.0)))
        block += 1
    doc, base, length, share = (np.concatenate(x) for x in zip(*parts, strict=True))
    flat, x, k = mins.reshape(-1), np.zeros(len(doc)), 0
    while len(doc):
        k += 1
        draw = mix64(base + np.uint64(k * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
        x = x - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / (registers * length)
        mark = mix64(draw ^ _TURN)
        register = ((mark >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        place = ((mark & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) / 2.0**32
        seen = place <= share
        np.minimum.at(flat, doc[seen] * registers + register[seen], x[seen])
        left = x < mins.max(1)[doc]
        doc, base, length, share, x = doc[left], base[left], length[left], share[left], x[left]
    return mins


def band_keys(mins: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    bits = mins.view(np.uint64).reshape(len(mins), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bits.shape[:2]).copy()
    for r in range(ROWS):
        h = mix64(h * _GOLD + bits[:, :, r])
    return h.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in slices(batches, "text"):
        bags = [np.unique(shingles(t, hashes), return_counts=True) for t in batch.column(3).to_pylist()]
        keys = band_keys(signatures(bags))
        empty = np.array([not len(h) for h, _ in bags])
        offsets = np.concatenate([[0], np.cumsum(np.where(empty, 0, BANDS))]).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[~empty].reshape(-1)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], bands], ["doc_id", "h1", "h2", "bands"])


def _bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in slices(batches, "text"):
        bags = [bag(shingles(t, hashes)).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.binary())], ["id", "bag"])


def bag(h: np.ndarray) -> np.ndarray:
    """A multiset as a sorted set: the second, third, ... copy of a shingle is an element of its own."""
    h = np.sort(h)
    first = np.searchsorted(h, h, "left")
    turn = (np.arange(len(h)) - first).astype(np.uint64)
    return np.sort(np.where(turn == 0, h, mix64(h + turn * _GOLD)))


def overlap(a: bytes, b: bytes) -> float:
    """Sum of minima over sum of maxima of two multisets, as bag() has them."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [overlap(x, y) >= similarity for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 16384) -> np.ndarray:
    """How many elements each left bag shares with each right one, by products of 0-1 matrices."""
    (l, i), (r, j) = ((np.concatenate(x) if x else np.zeros(0, np.uint64), np.repeat(np.arange(len(x)), [len(b) for b in x])) for x in (left, right))
    names = np.intersect1d(l, r)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(names):
        return out
    at_l, at_r = np.searchsorted(names, l), np.searchsorted(names, r)
    in_l, in_r = names[np.minimum(at_l, len(names) - 1)] == l, names[np.minimum(at_r, len(names) - 1)] == r
    for low in range(0, len(names), columns):
        a, b = (np.zeros((len(out) if side is i else out.shape[1], min(columns, len(names) - low)), np.float32) for side in (i, j))
        for m, row, at, ok in ((a, i, at_l, in_l), (b, j, at_r, in_r)):
            ok = ok & (at >= low) & (at < low + columns)
            m[row[ok], at[ok] - low] = 1
        out += a @ b.T
    return out


def _blocks(similarity: float):
    """Links between the strangers and the members of a block, as a few edges that connect the same."""

    def run(table: pa.Table) -> pa.Table:
        few, all_ = table.filter(pa.array(table["role"].to_numpy() == 0)), table.filter(pa.array(table["role"].to_numpy() == 1))
        x, y = few["id"].to_numpy(), all_["id"].to_numpy()
        bags_x, bags_y = ([np.frombuffer(b, np.uint64) for b in t["bag"].to_pylist()] for t in (few, all_))
        both = shared_counts(bags_x, bags_y)
        n_x, n_y = (np.array([len(b) for b in bags], np.float64) for bags in (bags_x, bags_y))
        # counts are whole numbers, and a quotient of doubles reaches the threshold only where the fraction does
        good = both / np.maximum(n_x[:, None] + n_y[None, :] - both, 1) >= similarity
        good &= few["c"].to_numpy()[:, None] != all_["c"].to_numpy()[None, :]
        u, v = np.nonzero(good)
        names, local = np.unique(np.concatenate([x[u], y[v]]), return_inverse=True)
        a, b = forest(local[: len(u)], local[len(u) :], len(names))
        return pa.table({"a": names[a], "b": names[b]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


class _Buckets:
    """Candidate search over the members of buckets, without all pairs of a bucket.

    texts: id, text of the members.
    """

    BLOCK = 128

    def __init__(self, texts: DataFrame, members: DataFrame, similarity: float) -> None:
        self.similarity, self.spark = similarity, members.sparkSession
        self.made: list[DataFrame] = []
        self.bags = self.stored(texts.mapInArrow(_bagged, "id bigint, bag binary"), "bags")
        self.members = members

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.made.append(stored(df, name))
        return self.made[-1]

    def leaders(self) -> DataFrame:
        """Each member with its bucket's leader: the one with the most company over all its buckets, which the
        original of many copies has, then the least id."""
        sizes = self.stored(self.members.groupBy("band", "key").agg(F.count("*").alias("n")), "sizes")
        company = self.members.join(sizes, ["band", "key"]).groupBy("id").agg(F.sum("n").alias("company"))
        ranked = self.members.join(self.stored(company, "company"), "id")
        lead = ranked.groupBy("band", "key").agg(F.max(F.struct("company", (-F.col("id")).alias("id"))).alias("m"))
        lead = self.stored(lead.select("band", "key", (-F.col("m.id")).alias("y")), "leaders")
        return self.members.join(lead, ["band", "key"]).select(F.col("id").alias("x"), "y")

    def compare(self, pairs: DataFrame) -> DataFrame:
        """The pairs (x, y) whose whole multisets overlap enough."""
        pairs = self.stored(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct(), "pairs")
        left, right = self.bags.select(F.col("id").alias("a"), F.col("bag").alias("bag_a")), self.bags.select(F.col("id").alias("b"), F.col("bag").alias("bag_b"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "bag_a", "bag_b")
        return self.stored(both.mapInArrow(_verified(self.similarity), "a bigint, b bigint"), "links")

    def run(self) -> DataFrame:
        """node, component of every text that has a link; what was written on the way is deleted."""
        labels = self.labels()
        dropped(self.spark, *self.made)
        return labels

    def labels(self) -> DataFrame:
        links = self.compare(self.leaders())
        labels = components(links, "groups")
        named = self.members.join(labels, F.col("id") == F.col("node"), "left").select("band", "key", "id", F.coalesce("component", "id").alias("c"))
        named = self.stored(named, "named")
        sizes = named.groupBy("band", "key", "c").agg(F.count("*").alias("n"))
        # the component with most members in a bucket, the least id among equals
        open_ = sizes.groupBy("band", "key").agg(F.max(F.struct("n", (-F.col("c")).alias("c"))).alias("m"), F.sum("n").alias("all"), F.count("*").alias("kinds")).where("kinds > 1")
        blocks = [F.ceil(x / self.BLOCK).cast("int").alias(n) for x, n in ((F.col("all") - F.col("m.n"), "kx"), (F.col("all"), "ky"))]
        open_ = self.stored(open_.select("band", "key", (-F.col("m.c")).alias("main"), *blocks), "open")
        if open_.isEmpty():
            return labels
        return components(links.unionByName(self._exhaust(named, open_)), "groups")

    def _exhaust(self, named: DataFrame, open_: DataFrame) -> DataFrame:
        """Compare members outside a bucket's main component with all of other components in it, by blocks."""
        rows = self.stored(named.join(open_, ["band", "key"]).select("band", "key", "id", "c", "main", "kx", "ky"), "open-rows")
        own, every = F.xxhash64("id"), lambda k: F.sequence(F.lit(0), F.col(k) - 1)
        few = rows.where("c <> main").select("band", "key", "id", "c", F.lit(0).alias("role"), F.pmod(own, "kx").cast("int").alias("bx"), F.explode(every("ky")).alias("by"))
        all_ = rows.select("band", "key", "id", "c", F.lit(1).alias("role"), F.explode(every("kx")).alias("bx"), F.pmod(own, "ky").cast("int").alias("by"))
        dealt = self.stored(few.unionByName(all_), "block-rows").join(self.bags, "id")
        return self.stored(dealt.groupBy("band", "key", "bx", "by").applyInArrow(_blocks(self.similarity), "a bigint, b bigint"), "links")


def _classes(docs: DataFrame, similarity: float) -> DataFrame:
    """doc_id, h1, h2, group_id of each row that has a doc_id; h1 and h2 stand for its text."""
    spark = docs.sparkSession
    ship(spark)
    known = docs.where("doc_id IS NOT NULL").select("doc_id", *key_of("text"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    signed = stored(known.mapInArrow(_signed, f"doc_id {kind}, h1 bigint, h2 bigint, bands array<bigint>"), "signatures")
    copies = signed.where(F.size("bands") > 0).groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"))
    # a number for each different text, written so that it stays
    copies = stored(copies.withColumn("id", F.monotonically_increasing_id()), "copies")
    first = signed.join(copies, ["h1", "h2"]).where("doc_id = first_doc").dropDuplicates(["id"])
    members = first.select("id", F.posexplode("bands").alias("band", "key")).select("band", "key", "id")
    shared = members.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key")
    members = stored(members.join(shared, ["band", "key"], "left_semi"), "members")
    ids = copies.join(members.select("id").distinct(), "id", "left_semi")
    texts = known.join(ids.withColumnRenamed("first_doc", "doc_id").hint("shuffle_hash"), ["doc_id", "h1", "h2"]).dropDuplicates(["id"]).select("id", "text")
    labels = _Buckets(texts, members, similarity).run()
    named = stored(copies.join(labels, F.col("id") == F.col("node"), "left").select("h1", "h2", "first_doc", F.coalesce("component", "id").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("first_doc").alias("group_id"))
    named = stored(named.join(least, "component").select("h1", "h2", "group_id"), "named")
    dropped(spark, members, labels)
    # texts without a word are in no bucket
    return signed.select("doc_id", "h1", "h2").join(named, ["h1", "h2"], "left").withColumn("group_id", F.coalesce("group_id", "doc_id"))


def groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id -> doc_id, group_id (the group's smallest doc_id), one row for each row of docs."""
    out = _classes(docs, similarity).select("doc_id", "group_id")
    return out.unionByName(docs.where("doc_id IS NULL").select("doc_id", F.col("doc_id").alias("group_id")))


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs whose document stays."""
    doc, one, two = free_name(docs, "__doc", "__h1", "__h2")
    goes = _classes(docs, similarity).where("doc_id <> group_id").select(F.col("doc_id").alias(doc), F.col("h1").alias(one), F.col("h2").alias(two))
    h1, h2 = key_of("text")
    # those that go are fewer than those that stay
    return docs.join(stored(goes.distinct(), "goes"), (F.col("doc_id") == F.col(doc)) & (h1 == F.col(one)) & (h2 == F.col(two)), "left_anti")


def membership(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("kept"))


def jaccard(a: str, b: str) -> float:
    """Overlap of two texts, by counting: what the operator is tested against."""
    def bag(t: str) -> Counter:
        w = _WORD.findall(t)
        return Counter(tuple(w[i : i + WORDS]) for i in range(max(1, len(w) - WORDS + 1))) if w else Counter()

    x, y = bag(a), bag(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))
