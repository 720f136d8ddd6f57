"""Line de-duplication with sharded cuckoo filters over exact reference counts.

A line that two documents or more hold stays in the document of the smallest id and leaves the others. State
is two tables. ``postings`` says exactly which document holds which line key, so reference counts follow from
it; ``filters`` has one cuckoo filter for each shard of the key space, holding the keys that two documents or
more hold. Cuckoo filters forget keys as well as they learn them, so documents can be inserted and deleted
again and the state is then what it was: nothing about the order of the edits remains.

A filter answers "surely in one document only" for nearly all lines without touching the exact table; what it
lets through is joined with the exact counts, so its false positives do no harm. Filters are broadcast while
their summed size is at most ``broadcast_bytes``; beyond that lines travel to the filter of their shard, which a
crowded shard has in several tasks. Both ways give equal results.

Cases: null and empty texts are one empty line; texts are read whole however long; keys shorter than
``min_chars`` code points never leave; a row without doc_id takes no part and keeps its lines; rows that repeat a
doc_id are one document, also where their texts differ: a line is dropped from all of them or from none; doc_id
may have any type that has an order; a table without rows gives a table without rows; other columns pass through
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquest.llm.common import WHITE, free_name, mix64, ship, stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys of the filters that one shard should hold at most, about.
SHARD_KEYS = 1_000_000
#: Lines that one task asks a filter about, about, where filters aren't broadcast.
TASK_LINES = 4_000_000
SLOTS, KICKS = 4, 500


class CuckooFilter:
    """16-bit fingerprints in buckets of four, each key in one of two buckets."""

    def __init__(self, buckets: np.ndarray) -> None:
        self.buckets = buckets  # (power of two, SLOTS) of uint16; 0 is free

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        n = 1 << max(1, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.85)))))
        return cls(np.zeros((n, SLOTS), np.uint16))

    @classmethod
    def holding(cls, h1: np.ndarray, h2: np.ndarray) -> CuckooFilter:
        """A filter with these distinct keys, twice as large if the first size doesn't do."""
        room = max(16, len(h1))
        while not (made := cls.sized(room)).insert(h1, h2):
            room *= 2
        return made

    @classmethod
    def parse(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.buckets) - 1)
        prints = (mix64(h2.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)
        prints[prints == 0] = 1
        first = mix64(h1.astype(np.uint64)) & mask
        return prints, first, first ^ (mix64(prints.astype(np.uint64)) & mask)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(h1, h2)
        return ((self.buckets[first] == prints[:, None]) | (self.buckets[second] == prints[:, None])).any(1)

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """False if the filter is too full; it is then to be built anew."""
        prints, first, second = self._places(h1, h2)
        left = np.arange(len(prints))
        for places in (first, second):  # all keys at once, as far as buckets have room
            order = left[np.argsort(places[left], kind="stable")]
            at = places[order]
            turn, free = np.arange(len(at)) - np.searchsorted(at, at, "left"), self.buckets[at] == 0
            fits = turn < free.sum(1)
            slots = np.argsort(~free[fits], 1, kind="stable")
            self.buckets[at[fits], slots[np.arange(len(slots)), turn[fits]]] = prints[order[fits]]
            left = order[~fits]
        rng, mask = np.random.default_rng(len(prints)), len(self.buckets) - 1
        for p, where in zip(prints[left].tolist(), second[left].tolist(), strict=True):
            for _ in range(KICKS):
                slot = int(rng.integers(SLOTS))
                p, self.buckets[where, slot] = int(self.buckets[where, slot]), p
                where ^= int(mix64(np.array([p], np.uint64))[0]) & mask
                free = np.flatnonzero(self.buckets[where] == 0)
                if len(free):
                    self.buckets[where, free[0]] = p
                    break
            else:
                return False
        return True

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Take out keys that were inserted before."""
        prints, first, second = self._places(h1, h2)
        for p, *places in zip(prints.tolist(), first.tolist(), second.tolist(), strict=True):
            for where in places:
                held = np.flatnonzero(self.buckets[where] == p)
                if len(held):
                    self.buckets[where, held[0]] = 0
                    break


def line_keys(text: Column, min_chars: int) -> Column:
    """For each line its key's two hashes, or null for a short key."""
    lines = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), "\n")
    keys = F.transform(lines, lambda x: F.btrim(x, F.lit(WHITE)))
    return F.transform(keys, lambda k: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2"))))


@dataclass
class LineIndex:
    """postings: h1, h2, doc_id; shared: h1, h2, first_doc, n_docs of keys in two documents or more;
    filters: shard, buckets."""

    postings: DataFrame
    shared: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = 10

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = 10, shards: int | None = None) -> LineIndex:
        return cls.of_postings(stored(postings_of(lines_of(docs, min_chars)).distinct(), "postings"), min_chars, shards)

    @classmethod
    def of_postings(cls, postings: DataFrame, min_chars: int = 10, shards: int | None = None) -> LineIndex:
        ship(postings.sparkSession)
        shared = stored(references(postings).where("n_docs > 1"), "shared-lines")
        if shards is None:
            shards = max(1, -(-shared.count() // SHARD_KEYS))
        filters = shared.select("h1", "h2", F.pmod("h1", F.lit(shards)).alias("shard")).repartitionById(shards, F.col("shard").cast("int"))
        return cls(postings, shared, stored(filters.mapInPandas(_build, "shard bigint, buckets binary"), "line-filters"), shards, min_chars)

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(postings_of(lines_of(docs, self.min_chars)).distinct().join(self.postings, ["h1", "h2", "doc_id"], "left_anti"), gone=False)

    def delete(self, docs: DataFrame) -> LineIndex:
        return self._changed(self.postings.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("h1", "h2", "doc_id"), gone=True)

    def _changed(self, delta: DataFrame, gone: bool) -> LineIndex:
        delta = stored(delta, "line-delta")
        after = stored(self.postings.join(delta, ["h1", "h2", "doc_id"], "left_anti") if gone else self.postings.unionByName(delta), "postings")
        touched = delta.groupBy("h1", "h2").agg(F.count("*").alias("change"))
        now = stored(references(after.join(touched, ["h1", "h2"], "left_semi")), "line-counts")
        shared = stored(self.shared.join(touched, ["h1", "h2"], "left_anti").unionByName(now.where("n_docs > 1")), "shared-lines")
        step = F.col("change") * (-1 if gone else 1)
        both = touched.join(now, ["h1", "h2"], "left").select("h1", "h2", F.coalesce("n_docs", F.lit(0)).alias("now"), step.alias("step"))
        crossed = both.where((F.col("now") > 1) != (F.col("now") - F.col("step") > 1))
        edits = crossed.select(F.pmod("h1", F.lit(self.shards)).alias("shard"), "h1", "h2", (F.col("now") > 1).alias("add"))
        # a shard's filter is rebuilt from the exact counts if it overflows, so overflow loses nothing
        filters = edits.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(_edit, "shard bigint, buckets binary")
        filters = stored(filters, "line-filters")
        full = filters.where("buckets IS NULL").select("shard")
        again = shared.withColumn("shard", F.pmod("h1", F.lit(self.shards))).join(full, "shard", "left_semi").select("h1", "h2", "shard")
        rebuilt = again.repartitionById(self.shards, F.col("shard").cast("int")).mapInPandas(_build, "shard bigint, buckets binary")
        return LineIndex(after, shared, stored(filters.where("buckets IS NOT NULL").unionByName(rebuilt), "line-filters"), self.shards, self.min_chars)


def lines_of(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, a hash of the text, and the keys of its lines, in order; kept in the shared folder."""
    return stored(docs.select("doc_id", F.xxhash64("text").alias("own"), line_keys(F.col("text"), min_chars).alias("keys")), "lines")


def postings_of(lines: DataFrame) -> DataFrame:
    """One row for each document and key."""
    held = F.array_distinct(F.filter("keys", lambda k: k.isNotNull()))
    return lines.where("doc_id IS NOT NULL").select("doc_id", F.explode(held).alias("k")).select("k.h1", "k.h2", "doc_id")


def references(postings: DataFrame) -> DataFrame:
    """Exact counts: h1, h2, first_doc, n_docs (1, or at least 2 for rows that repeat a doc_id aside).

    Built from minimum, maximum and count, which combine before the shuffle: a line of a third of all
    documents reaches its reducer as one row from each task.
    """
    counted = postings.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n"))
    return counted.select("h1", "h2", "first_doc", F.when(F.col("first_doc") == F.col("last_doc"), 1).otherwise(F.col("n")).alias("n_docs"))


def _build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = [p for p in parts if len(p)]
    if held:
        for shard, keys in pd.concat(held).groupby("shard"):
            made = CuckooFilter.holding(keys["h1"].to_numpy(), keys["h2"].to_numpy())
            yield pd.DataFrame({"shard": [shard], "buckets": [made.buckets.tobytes()]})


def _edit(key: tuple, edits: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    made = CuckooFilter.parse(filters["buckets"].iloc[0]) if len(filters) else CuckooFilter.sized(16)
    less, more = edits[~edits["add"].astype(bool)], edits[edits["add"].astype(bool)]
    made.delete(less["h1"].to_numpy(), less["h2"].to_numpy())
    whole = made.insert(more["h1"].to_numpy(), more["h2"].to_numpy())
    return pd.DataFrame({"shard": [key[0]], "buckets": [made.buckets.tobytes() if whole else None]})


def _suspects(lines: DataFrame, filters: DataFrame, shards: int, broadcast_bytes: int) -> DataFrame:
    """doc_id, own, pos, h1, h2 of the lines that may be in two documents."""
    each = lines.where("doc_id IS NOT NULL")
    total = filters.agg(F.sum(F.length("buckets"))).first()[0] or 0
    if total > broadcast_bytes:
        return _sent_to_filters(each, filters, shards)
    spark = lines.sparkSession
    sent = spark.sparkContext.broadcast({r["shard"]: bytes(r["buckets"]) for r in filters.collect()})  # at most broadcast_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {s: CuckooFilter.parse(raw) for s, raw in sent.value.items()}
        for batch in batches:
            keys = batch.column(2)
            flat, rows = keys.flatten(), pc.list_parent_indices(keys).to_numpy()
            starts = np.searchsorted(rows, rows, "left")
            h1, h2 = (pc.fill_null(pc.struct_field(flat, n), 0).to_numpy(zero_copy_only=False) for n in ("h1", "h2"))
            valid = flat.is_valid().to_numpy(zero_copy_only=False)
            maybe, at = np.zeros(len(h1), bool), np.mod(h1, shards)
            for s, f in held.items():
                mine = np.flatnonzero((at == s) & valid)
                maybe[mine] = f.contains(h1[mine], h2[mine])
            hit = np.flatnonzero(maybe)
            ids, own = (batch.column(k).take(pa.array(rows[hit])) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([ids, own, pa.array((hit - starts[hit]).astype(np.int32)), pa.array(h1[hit]), pa.array(h2[hit])], ["doc_id", "own", "pos", "h1", "h2"])

    kind = dict(lines.dtypes)["doc_id"]
    return each.select("doc_id", "own", "keys").mapInArrow(run, f"doc_id {kind}, own bigint, pos int, h1 bigint, h2 bigint")


def _sent_to_filters(each: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The same where filters stay in place: lines go to their shard's filter, of which each task has one at a time."""
    shard = F.pmod("h1", F.lit(shards))
    lines = each.select("doc_id", "own", F.posexplode("keys").alias("pos", "k")).where("k IS NOT NULL").select("doc_id", "own", "pos", "k.h1", "k.h2").withColumn("shard", shard)
    # one row for each shard; a line of a third of all documents crowds one, which then has many pieces
    pieces = lines.groupBy("shard").agg(F.ceil(F.count("*") / TASK_LINES).alias("pieces")).join(filters.select("shard"), "shard", "left_semi")
    pieces = stored(pieces, "pieces")
    asked = lines.join(pieces, "shard").withColumn("piece", F.pmod(F.xxhash64("doc_id", "pos"), "pieces")).drop("pieces")
    held = filters.join(pieces, "shard").select("shard", "buckets", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("piece"))
    both = asked.unionByName(held, allowMissingColumns=True).select("doc_id", "own", "pos", "h1", "h2", "shard", "piece", "buckets")
    n = max(int(each.sparkSession.conf.get("spark.sql.shuffle.partitions")), pieces.agg(F.sum("pieces")).first()[0] or 1)
    dealt = both.repartition(n, "shard", "piece").sortWithinPartitions("shard", "piece", F.col("buckets").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            raw, hits = batch.column(7), [np.zeros(0, np.int64)]
            h1, h2 = (pc.fill_null(batch.column(k), 0).to_numpy(zero_copy_only=False) for k in (3, 4))
            begins = np.flatnonzero(raw.is_valid().to_numpy(zero_copy_only=False))
            for a, b in zip([0, *begins], [*begins, batch.num_rows], strict=True):
                if raw[a].is_valid if a < b else False:
                    now, a = CuckooFilter.parse(raw[a].as_py()), a + 1
                if a < b:
                    hits.append(a + np.flatnonzero(now.contains(h1[a:b], h2[a:b])))
            yield batch.select([0, 1, 2, 3, 4]).take(pa.array(np.concatenate(hits)))

    kind = dict(each.dtypes)["doc_id"]
    return dealt.mapInArrow(run, f"doc_id {kind}, own bigint, pos int, h1 bigint, h2 bigint")


def dedup_lines(docs: DataFrame, min_chars: int = 10, broadcast_bytes: int = 64 << 20, index: LineIndex | None = None) -> DataFrame:
    """docs with ``text`` rewritten, ``n_lines`` before and ``n_dropped``.

    Lines are judged against ``index``, or against the documents themselves.
    """
    ship(docs.sparkSession)
    lines = lines_of(docs, min_chars)
    if index is None:
        index = LineIndex.of_postings(postings_of(lines), min_chars)
    shared = index.shared.select("h1", "h2", "first_doc")
    maybe = _suspects(lines, index.filters, index.shards, broadcast_bytes)
    # a hot line's rows are split by adaptive execution: this join has no order to keep
    leaving = maybe.join(shared, ["h1", "h2"]).where("doc_id > first_doc")
    by_doc, by_text, dropped, split, kept, n_lines, n_dropped = free_name(docs, "__doc", "__own", "__dropped", "__split", "__kept", "n_lines", "n_dropped")
    # rows of one doc_id and one text have their lines at the same places
    gone = leaving.groupBy(F.col("doc_id").alias(by_doc), F.col("own").alias(by_text)).agg(F.collect_set("pos").alias(dropped))
    whole = docs.join(gone.hint("shuffle_hash"), (docs["doc_id"] == gone[by_doc]) & (F.xxhash64(docs["text"]) == gone[by_text]), "left").withColumn(split, F.split(F.coalesce("text", F.lit("")), "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(dropped))
    rest = F.array_join(F.transform(stay, lambda i: F.get(F.col(split), i)), "\n")
    out = whole.withColumn(kept, F.when(F.col(dropped).isNull(), F.col("text")).otherwise(rest))
    return out.select(*(F.col(kept).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns), F.size(split).cast("bigint").alias(n_lines), F.coalesce(F.size(dropped), F.lit(0)).cast("bigint").alias(n_dropped))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each document."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), s AS (
  SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), j AS (
  SELECT k.*, s.first_doc IS NOT NULL AND k.doc_id <> s.first_doc AS gone FROM k LEFT JOIN s ON k.key = s.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
