"""Language-model scoring with a log-frequency Bloom filter.

The model is a word bigram model interpolated with a discounted unigram model. Counts of all training n-grams
live in Bloom filters: a count is quantised to a level (1, 2, 3, 4, 5, 6, 8, 10, ... about a quarter apart), and
the n-gram is inserted once for each level up to its own. A count is read by probing level 1, 2, ... until a
probe fails. Absence is never wrong, and an n-gram never counts as rarer than it is. As a filter holds every level
up to an n-gram's own, words, whose exact counts lie beside it, are probed from their own level on, and a task
remembers the levels of frequent bigrams that it has read: both give the levels that probing from 1 gives.

N-grams are counted in shards of the hash space: each task sums what it has seen and sends sorted blocks, so a
frequent word is a few numbers a task. A shard's filter and its exact word counts (for the base score) are
built where the shard lies. While all shards together have at most ``broadcast_bytes`` they are broadcast, and
workers map the broadcast's file, whose pages the workers of a host share. A corpus whose filters are larger
is not read once for each part of them: the different n-grams of each block of texts travel to the shards
instead, are probed there, and their levels travel back. Both ways are one pass with the same result.

A token's probability depends on three levels only (bigram, context, word). Their joint counts over all training
tokens are a small table, from which expectation-maximisation fits the interpolation weights, leaving each
token's own count out.

Cases: null and empty texts are one end token; a row without doc_id is learned from; repeated rows count each;
without training documents every token is unknown; a table without rows gives a table without rows; other
columns are ignored, whatever their names; doc_id may have any type. Texts are read whole: a very long one makes
a block of its own.
"""

from __future__ import annotations

import pickle
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquest.llm.common import dropped, fold_of, mix64, ship, slices, stored

HASHES, BITS = 5, 8
#: N-grams that a counting task holds before it sends them; bytes of text that a shard is made for; of a block.
HELD, SHARD_BYTES, BLOCK_BYTES = 1_000_000, 64 << 20, 2_500_000
#: Bytes of a word that are hashed eight at a time; the level from which a task remembers bigrams, and how many.
WORD_BYTES, FREQUENT, REMEMBERED = 64, 8, 1_000_000
_ONE, _GOLD = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)


def _levels() -> np.ndarray:
    """Least count of each level; level 0 is absence."""
    out, x = [0, 1], 1.0
    while out[-1] < 1 << 40:
        x *= 1.25
        if round(x) > out[-1]:
            out.append(round(x))
    return np.array(out, np.int64)


LEVELS = _levels()
#: What a level counts for: the geometric middle of its range.
VALUE = np.concatenate([[0.0], np.sqrt(LEVELS[1:-1].astype(float) * np.maximum(LEVELS[2:] - 1, LEVELS[1:-1])), [float(LEVELS[-1])]])
N_LEVELS = len(LEVELS)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts on end, with A-Z in lower case, and each text's number of words; only ASCII letters and
    ASCII white space matter."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    ends = np.cumsum(pc.list_value_length(split).fill_null(0).to_numpy(zero_copy_only=False))
    flat = split.flatten()
    full = pc.greater(pc.binary_length(flat), 0)  # white space at an end leaves an empty piece
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), np.diff(upto[ends], prepend=0)


_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def hashes_of(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words, whatever array they are in; those of long words are xxHash's."""
    if not len(words):
        return np.zeros(0, np.uint64)
    _, offsets, data = words.buffers()
    wide = pa.types.is_large_string(words.type)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    held = np.zeros(int(offsets[-1] - offsets[0]) + 8, np.uint8)
    held[:-8] = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    eight = np.ndarray(len(held) - 7, "<u8", held, strides=(1,))  # the eight bytes from each place on
    start, size = offsets[:-1] - offsets[0], np.diff(offsets)
    h, at = mix64(size.astype(np.uint64) * _GOLD), np.arange(len(words))
    for done in range(0, WORD_BYTES, 8):
        at = at[size[at] > done]
        h[at] = mix64(h[at] ^ (eight[start[at] + done] & _FIRST[np.minimum(size[at] - done, 8)]))
    for i in np.flatnonzero(size > WORD_BYTES):
        h[i] = xxhash.xxh3_64_intdigest(held[start[i] : start[i] + size[i]])
    return h


class _Hasher:
    """Even hashes for words and odd ones for bigrams; the end and the start are no words."""

    def __init__(self) -> None:
        self.end, self.start = hashes_of(pa.array([" end", " start"])) & ~_ONE

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token hashes and bigram hashes of all texts on end, and each text's number of tokens."""
        words, sizes = words_of(texts)
        sizes = sizes + 1
        ends = np.cumsum(sizes) - 1
        uni = np.empty(int(sizes.sum()), np.uint64)
        inner = np.ones(len(uni), bool)
        inner[ends] = False
        uni[inner] = hashes_of(words) & ~_ONE
        uni[ends] = self.end
        before = np.roll(uni, 1)
        before[ends - sizes + 1] = self.start
        return uni, mix64(before * _GOLD + uni) | _ONE, sizes


def _counting(shards: int):
    """Sorted blocks of (hash, count) for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _Hasher()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            h, n = summed(held)
            shard = (h >> np.uint64(33)) % np.uint64(shards)
            order = np.argsort(shard, kind="stable")
            h, n, at = h[order], n[order], np.searchsorted(shard[order], np.arange(shards + 1))
            used = np.flatnonzero(np.diff(at))
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([h[at[s] : at[s + 1]].tobytes() for s in used], pa.binary()), pa.array([n[at[s] : at[s + 1]].astype(np.uint32).tobytes() for s in used], pa.binary())], ["shard", "hashes", "counts"])

        for batch in slices(batches, "text"):
            uni, bi, sizes = hashed(batch.column(0))
            starts = np.full(len(sizes), hashed.start)  # the context of first words
            h, n = np.unique(np.concatenate([uni, bi, starts]), return_counts=True)
            held.append((h, n))
            size += len(h)
            if size > HELD:
                yield from sent()
                held, size = [], 0
        if held:
            yield from sent()

    return run


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
    return h[first], np.add.reduceat(n, first) if len(h) else n


def _packed(counts: np.ndarray) -> bytes:
    """Counts in four bytes each if they fit, else in eight."""
    return counts.astype(np.uint32 if counts.max(initial=0) < 1 << 32 else np.int64).tobytes()


class LogBloom:
    """Levels of hashes in one bit array."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    @classmethod
    def holding(cls, h: np.ndarray, level: np.ndarray, bits_each: int = BITS) -> LogBloom:
        size = max(64, int(level.sum()) * bits_each + 7 >> 3)
        made = cls(np.zeros(size, np.uint8))
        for j in range(1, int(level.max(initial=0)) + 1):
            h, level = h[level >= j], level[level >= j]
            a = cls._mixed(h, j)
            for k in range(HASHES):
                at = _place(a, k, made.bits.size * 8)
                np.bitwise_or.at(made.bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        return made

    @staticmethod
    def _mixed(h: np.ndarray, level: int | np.ndarray) -> np.ndarray:
        return mix64(h + np.asarray(level, np.uint64) * _GOLD)

    def levels(self, h: np.ndarray, least: np.ndarray | None = None) -> np.ndarray:
        """Probe level after level until one is missing, above those that the hashes have for certain."""
        out = np.zeros(len(h), np.uint8) if least is None else least
        return _levels(self.bits, h, out, np.arange(len(h)), None, self.bits.size * 8)


def _place(a: np.ndarray, k: int, size: int | np.ndarray) -> np.ndarray:
    """The k-th bit, of so many, of hashes that a level has mixed."""
    step = (a >> np.uint64(32)) | _ONE
    if isinstance(size, int) and size >= 1 << 32:  # 32 bits don't reach all places
        return (mix64(a + np.uint64(k) * step) % np.uint64(size)).astype(np.int64)
    return ((a + np.uint64(k) * step & np.uint64(0xFFFFFFFF)) * np.asarray(size, np.uint64) >> np.uint64(32)).astype(np.int64)


def _levels(bits: np.ndarray, h: np.ndarray, out: np.ndarray, at: np.ndarray, start: np.ndarray | None, size: int | np.ndarray) -> np.ndarray:
    """Raise the levels ``out`` of hashes, those at ``at``, until the next is missing; with ``start``, each in its
    filter of ``size`` bits from there."""
    at = at[out[at] < N_LEVELS - 1]
    while len(at):
        a = LogBloom._mixed(h[at], out[at] + np.uint8(1))
        for k in range(HASHES):  # the first bit that is missing decides
            p = _place(a, k, size if start is None else size[at])
            byte = p >> 3 if start is None else (p >> 3) + start[at]
            there = np.flatnonzero(bits[byte] >> (p & 7).astype(np.uint8) & 1)
            at, a = at[there], a[there]
        out[at] += 1
        at = at[out[at] < N_LEVELS - 1]
    return out


def _level_of(counts: np.ndarray) -> np.ndarray:
    return (np.searchsorted(LEVELS, counts, "right") - 1).astype(np.uint8)


class Remembered:
    """Levels that a task has read of frequent bigrams, which cost most probes: a bounded number."""

    def __init__(self) -> None:
        self.h, self.level = np.zeros(1, np.uint64), np.zeros(1, np.uint8)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Levels of hashes; 0 where they aren't known."""
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, self.level[at], np.uint8(0))

    def add(self, h: np.ndarray, level: np.ndarray, known: np.ndarray) -> None:
        """Add what a block has read, in order of its hashes; when full, keep this block's only."""
        often = (level >= FREQUENT) & (h & _ONE == 1)
        fresh = often & ~known
        if len(self.h) + int(fresh.sum()) > REMEMBERED:
            keep = np.flatnonzero(often)[:REMEMBERED]
            self.h, self.level = (h[keep], level[keep]) if len(keep) else (self.h[:1], self.level[:1])
            return
        both = np.concatenate([self.h, h[fresh]])
        order = np.argsort(both, kind="stable")
        self.h, self.level = both[order], np.concatenate([self.level, level[fresh]])[order]


def _building(bits_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = defaultdict(list)
        for batch in batches:
            for s, h, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts[s].append((np.frombuffer(h, np.uint64), np.frombuffer(n, np.uint32)))
        hashed = _Hasher()
        for s in sorted(parts):
            h, n = summed([(h, n.astype(np.int64)) for h, n in parts.pop(s)])
            level = _level_of(n)
            words = (h & _ONE == 0) & (h != hashed.start)
            one, two = int((n[words] == 1).sum()), int((n[words] == 2).sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([s]), pa.array([LogBloom.holding(h, level, bits_each).bits.tobytes()], pa.binary()), pa.array([h[words].tobytes()], pa.binary()), pa.array([_packed(n[words])], pa.binary())]
                + [pa.array([v]) for v in (int(n[words].sum()), int(words.sum()), one, two, float(VALUE[level[words]].sum()))],
                ["shard", "bits", "words", "counts", "total", "kinds", "once", "twice", "read"],
            )

    return run


@dataclass
class Corpus:
    """The written shards and their sums: all tokens, different tokens, those seen once and twice, and the
    tokens that the quantised counts add up to."""

    shards: DataFrame
    n_shards: int
    total: int
    kinds: int
    once: int
    twice: int
    read: float


def learn(docs: DataFrame, bits_each: int = BITS) -> Corpus:
    """Count the n-grams of all texts of docs."""
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    blocks = docs.select("text").mapInArrow(_counting(n), "shard bigint, hashes binary, counts binary").repartitionById(n, F.col("shard").cast("int"))
    made = stored(blocks.mapInArrow(_building(bits_each), "shard bigint, bits binary, words binary, counts binary, total bigint, kinds bigint, once bigint, twice bigint, read double"), "ngrams")
    sums = made.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "kinds", "once", "twice", "read"))).first()
    return Corpus(made, n, *sums)


class Shipped:
    """Filters and word counts of all shards in one broadcast. A worker maps the file that Spark has put the
    broadcast in, so the workers of a host share its pages; where there is no plain file (encryption) it reads
    the value."""

    MARK = uuid.UUID(int=0x8A5C_1D2E_7F40_4B6B_9E13_C2D1_55AA_0F37).bytes
    PARTS = ("bits", "words", "counts")

    def __init__(self, spark, rows: Iterator, n_shards: int) -> None:
        # what comes before the bytes in a pickle, so that numbers lie at multiples of eight in the file
        held = bytearray(self.MARK) + bytes(-pickle.dumps(bytearray(b"x" * (1 << 17)), pickle.HIGHEST_PROTOCOL).find(b"x" * 64) % 8)
        self.at = np.zeros((n_shards, len(self.PARTS), 2), np.int64)
        for r in rows:
            for k, part in enumerate(self.PARTS):
                self.at[r["shard"], k] = len(held), len(held) + len(r[part])
                held += r[part]
                held += bytes(-len(r[part]) % 8)
        self.size = len(held)
        self.sent = spark.sparkContext.broadcast(held)

    def open(self) -> np.ndarray:
        path = getattr(self.sent, "_path", None)
        if path and self.size > 1 << 16:
            with open(path, "rb") as f:
                start = f.read(1 << 12).find(self.MARK)
            if start >= 0:
                return np.memmap(path, np.uint8, "r", start, self.size)
        return np.frombuffer(self.sent.value, np.uint8)

    def looked_up(self, whole: np.ndarray, kinds: np.ndarray, remembered: Remembered) -> tuple[np.ndarray, np.ndarray]:
        """Levels of hashes, which are in order, and, for words, exact counts."""
        n_shards = len(self.at)
        order, bounds = _shard_of(kinds, n_shards)
        h, shard = kinds[order], np.repeat(np.arange(n_shards), np.diff(bounds))
        count, word = np.zeros(len(kinds), np.int64), np.flatnonzero(h & _ONE == 0)
        at = np.searchsorted(word, bounds)
        for s, (_, words, counts) in enumerate(self.at):
            mine = word[at[s] : at[s + 1]]
            if len(mine):
                count[mine] = _counted(whole[slice(*words)], whole[slice(*counts)], h[mine])
        start, stop = self.at[shard, 0].T
        level = remembered.levels(kinds)[order]
        known = level > 0
        level[word] = np.maximum(level[word], _level_of(count[word]))
        # one shard after another, so its filter stays near
        level = _levels(whole, h, level, np.flatnonzero((stop > start) & ~known), start, (stop - start).astype(np.uint64) * np.uint64(8))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        level, count = level[back], count[back]
        remembered.add(kinds, level, known[back])
        return level, count


def _shard_of(kinds: np.ndarray, n_shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes in order of their shards, and where each shard begins."""
    shard = ((kinds >> np.uint64(33)) % np.uint64(n_shards)).astype(np.uint16 if n_shards <= 1 << 16 else np.uint64)
    order = np.argsort(shard, kind="stable")  # by digits, for two bytes
    return order, np.searchsorted(shard[order], np.arange(n_shards + 1))


def _counted(words: np.ndarray, counts: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Exact counts of a shard's words."""
    words = words.view(np.uint64)
    if not len(words):
        return np.zeros(len(h), np.int64)
    counts = counts.view(np.uint32 if len(counts) < len(words) * 8 else np.int64)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return np.where(words[at] == h, counts[at].astype(np.int64), 0)


#: What scoring keeps of a document: its row, base score, known tokens, and its tokens' word and bigram levels.
_KEPT = ["row", "base", "known", "words", "bigrams"]


def _scored(rows: pa.Array, sizes: np.ndarray, u: np.ndarray, b: np.ndarray, level: np.ndarray, count: np.ndarray, floor: float) -> pa.RecordBatch:
    """_KEPT from a block's levels and counts; u and b say which of them each token has."""
    ends = np.cumsum(sizes)
    base, known = np.log10((count + 0.1) / floor)[u], (count > 0)[u]
    lu, lb = level[u], level[b]
    spans = list(zip(ends - sizes, ends, strict=True))
    arrays = [pa.array(np.add.reduceat(base, ends - sizes)), pa.array(np.add.reduceat(known.astype(np.int64), ends - sizes))]
    return pa.RecordBatch.from_arrays([rows, *arrays, *(pa.array([x[a:e].tobytes() for a, e in spans], pa.binary()) for x in (lu, lb))], _KEPT)


def _probing(shards: Shipped, floor: float):
    """_KEPT of each document, from shards that every worker holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, hashed, remembered = np.asarray(shards.open()), _Hasher(), Remembered()
        for batch in slices(batches, "text", BLOCK_BYTES):
            uni, bi, sizes = hashed(batch.column(1))
            kinds, back = np.unique(np.concatenate([uni, bi]), return_inverse=True)
            yield _scored(batch.column(0), sizes, back[: len(uni)], back[len(uni) :], *shards.looked_up(whole, kinds, remembered), floor)

    return run


def _routed(rows: DataFrame, corpus: Corpus, row_type: str, kind: str, floor: float) -> DataFrame:
    """_KEPT of each document, from shards that stay where they are: what each block asks of a shard, and the
    block's documents, are written once; requests meet their shard, answers their block."""
    n = corpus.n_shards

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _Hasher()
        for batch in slices(batches, "text", BLOCK_BYTES):
            uni, bi, sizes = hashed(batch.column(1))
            kinds, back = np.unique(np.concatenate([uni, bi]), return_inverse=True)
            order, bounds = _shard_of(kinds, n)
            used = np.flatnonzero(np.diff(bounds))
            name = uuid.uuid4().hex  # written before it is read, so it doesn't change
            kinds = kinds[order]
            texts = pickle.dumps((sizes, order.astype(np.int32), back.astype(np.int32), kinds & _ONE == 0))
            data = pa.array([texts, *(kinds[bounds[s] : bounds[s + 1]].tobytes() for s in used)], pa.binary())
            documents = pa.ListArray.from_arrays(pa.array([0] + [batch.num_rows] * (len(used) + 1), pa.int32()), batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(used) + 1)), pa.array([-1, *used.tolist()]), data, documents], ["block", "shard", "data", "rows"])

    blocks = stored(rows.mapInArrow(asked, f"block string, shard bigint, data binary, rows array<{row_type}>"), "blocks")
    none = F.lit(None).cast("binary")
    requests = blocks.where("shard >= 0").select("shard", "block", "data", none.alias("words"), none.alias("counts"))
    filters = corpus.shards.select("shard", F.lit(None).cast("string").alias("block"), F.col("bits").alias("data"), "words", "counts")
    # a shard's filter comes before what is asked of it
    met = requests.unionByName(filters).repartitionById(n, F.col("shard").cast("int")).sortWithinPartitions("shard", F.col("block").asc_nulls_first())

    def answering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = -1, None
        for batch in batches:
            out = []
            for s, block, data, words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(data, np.uint8)
                if block is None:
                    now, parts = s, (LogBloom(data), np.frombuffer(words, np.uint8), np.frombuffer(counts, np.uint8))
                    continue
                h = data.view(np.uint64)
                level, word = np.zeros(len(h), np.uint8), h & _ONE == 0
                count = np.zeros(int(word.sum()), np.int64)
                if s == now:
                    count = _counted(*parts[1:], h[word])
                    level[word] = _level_of(count)
                    level = parts[0].levels(h, level)
                out.append((block, s, level.tobytes(), count.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.binary()))], ["block", "shard", "data", "counts"])

    answers = met.mapInArrow(answering, "block string, shard bigint, data binary, counts binary")
    both = answers.withColumn("rows", F.lit(None).cast(blocks.schema["rows"].dataType)).unionByName(blocks.where("shard < 0").withColumn("counts", none))

    def gathered(table: pa.Table) -> pa.Table:
        """One block: its documents and an answer of each shard that it asked."""
        table = table.sort_by("shard")
        data = table["data"].to_pylist()
        sizes, order, back, word = pickle.loads(data[0])
        n_u = len(back) // 2
        level, count = np.empty(len(order), np.uint8), np.zeros(len(order), np.int64)
        level[order] = np.frombuffer(b"".join(data[1:]), np.uint8)
        count[order[word]] = np.frombuffer(b"".join(table["counts"].to_pylist()[1:]), np.int64)
        rows_ = table["rows"].combine_chunks().slice(0, 1).flatten()
        return pa.Table.from_batches([_scored(rows_, sizes, back[:n_u], back[n_u:], level, count, floor)])

    return both.groupBy("block").applyInArrow(gathered, kind)


def _codes(words: bytes, bigrams: bytes, start: int) -> np.ndarray:
    """(bigram, context, word) levels of each token as one number."""
    u, b = np.frombuffer(words, np.uint8).astype(np.int64), np.frombuffer(bigrams, np.uint8).astype(np.int64)
    context = np.concatenate([[start], u[:-1]])
    return (b * N_LEVELS + context) * N_LEVELS + u


class Interpolation:
    """The probability of a token from its code, with weights by the context's level."""

    GROUPS = np.array([1, 2, 3, 6, 9, 14, 20])

    def __init__(self, corpus: Corpus) -> None:
        d = corpus.once / max(1, corpus.once + 2 * corpus.twice)
        self.discount = min(max(d, 0.1), 0.9)
        self.kinds, self.read = corpus.kinds, corpus.read
        self.weights = np.zeros(len(self.GROUPS) + 1)

    def parts(self, codes: np.ndarray, out: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unigram and bigram probability and weight group; ``out``: how much to leave out of each count."""
        u, h, b = codes % N_LEVELS, codes // N_LEVELS % N_LEVELS, codes // N_LEVELS**2
        c, ch, cb = (np.maximum(VALUE[x] - out, 0.0) for x in (u, h, b))
        total = max(1.0, self.read)
        unseen = self.discount * self.kinds / total / (self.kinds + 1) if self.kinds else 1.0
        # the discounts of all different words are what unseen words share, as if there were as many
        uni = np.where(c > 0.0, np.maximum(c - self.discount, 0.0) / total, 0.0) + unseen * (c <= 0.0)
        bi = np.where(ch > 0.0, np.minimum(cb / np.maximum(ch, 1e-9), 1.0), 0.0)
        return np.maximum(uni, 1e-300), bi, np.where(ch > 0.0, np.searchsorted(self.GROUPS, h, "right"), 0)

    def fit(self, codes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> None:
        uni, bi, group = self.parts(codes, 1.0)
        w = np.full(len(self.GROUPS) + 1, 0.3)
        w[0] = 0.0
        n = np.bincount(group, counts, len(w))
        for _ in range(rounds):
            a = w[group] * bi
            w = np.where(n > 0, np.bincount(group, counts * a / (a + (1 - w[group]) * uni), len(w)) / np.maximum(n, 1), 0.0)
            w[0] = 0.0
        self.weights = np.clip(w, 0.0, 0.999)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        uni, bi, group = self.parts(codes)
        w = self.weights[group]
        return np.log10(w * bi + (1 - w) * uni)


def score(docs: DataFrame, training: Column, broadcast_bytes: int = 256 << 20, bits_each: int = BITS) -> DataFrame:
    """doc_id, training, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select("doc_id", "text", training.alias("training"))
    corpus = learn(rows.where("training"), bits_each)
    given = rows.select(F.struct("doc_id", "training").alias("row"), "text")
    row_type = f"struct<doc_id:{dict(rows.dtypes)['doc_id']},training:boolean>"
    kind = f"row {row_type}, base double, known bigint, words binary, bigrams binary"
    floor = corpus.total + 0.1 * (corpus.kinds + 1)
    start = _Hasher().start
    own = corpus.shards.where(F.col("shard") == int((start >> np.uint64(33)) % np.uint64(corpus.n_shards))).select("bits").collect()
    start_level = int(LogBloom(np.frombuffer(own[0]["bits"], np.uint8)).levels(np.array([start]))[0]) if own else 0
    if (corpus.shards.agg(F.sum(sum((F.length(c) for c in Shipped.PARTS), F.lit(0)))).first()[0] or 0) <= broadcast_bytes:
        shards = Shipped(spark, corpus.shards.toLocalIterator(), corpus.n_shards)  # at most broadcast_bytes
        table = stored(given.mapInArrow(_probing(shards, floor), kind), "levels")
        shards.sent.destroy()
    else:
        table = stored(_routed(given, corpus, row_type, kind, floor), "levels")
    dropped(spark, corpus.shards)
    code_space = N_LEVELS**3

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(code_space, np.int64)
        for batch in batches:
            for words, bigrams in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                np.add.at(n, _codes(words, bigrams, start_level), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["code", "n"])

    # at most code_space different codes, whatever the corpus
    codes = table.where("row.training").select("words", "bigrams").mapInArrow(tally, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    model = Interpolation(corpus)
    model.fit(codes["code"].to_numpy(np.int64), codes["n"].to_numpy(float))

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.log10(_codes(w, b, start_level)) for w, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], *batch.columns[3:], pa.array([len(x) for x in got], pa.int64()), pa.array([float(x.sum()) for x in got], pa.float64())], ["row", "base", "known", "n_tokens", "score"])

    out = table.select("row", "words", "bigrams", "base", "known").mapInArrow(final, kind.split(", words")[0] + ", n_tokens bigint, score double")
    return out.select("row.doc_id", "row.training", "n_tokens", F.col("known").alias("n_known"), F.lit(corpus.total).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held_out = F.coalesce(F.pmod(fold_of("doc_id"), F.lit(10)) == 0, F.lit(False))
    out = score(docs, ~held_out)
    return out.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
