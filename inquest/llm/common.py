"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word and line rules: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
#: A word, for Java's and Python's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"
REPO = str(Path(__file__).resolve().parents[2])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes that a batch on its way to Python holds at most: ten thousand very long texts fit in no worker.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package wherever the driver was started, and bound the bytes of
    their batches where the session doesn't.

    On a cluster the package is installed or sent with ``--py-files``.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    if REPO not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (REPO, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent a local folder is made and set as checkpoint folder, on one machine only.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="inquest-"))
        root = context._jsc.sc().getCheckpointDir().get()
    return f"{root.rstrip('/')}/inquest-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that :func:`stored` made, once nothing reads them any more."""
    for file in {f.rpartition("/")[0] for df in tables for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def key_of(*columns: Column | str, name: str = "h") -> list[Column]:
    """Two independent 64-bit hashes: equal inputs have equal keys, and unequal ones unequal keys
    but for a chance of 2**-128."""
    return [F.xxhash64(*columns).alias(f"{name}1"), F.xxhash64(F.lit(7), *columns).alias(f"{name}2")]


def fold_of(column: Column | str) -> Column:
    """crc32 of the id as text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary"))


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names that clash with no column of df, in any letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for w in wanted:
        while w.lower() in taken:
            w = "_" + w
        taken.add(w.lower())
        out.append(w)
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str | int, chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a text column holds about ``chars`` bytes in each piece.

    One text longer than that makes a piece of its own: texts are never cut.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes.astype(np.int64)) // chars)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser over unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links (a, b) over nodes 0..n-1 connect, fewer than n."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        fresh = label.copy()
        np.minimum.at(fresh, a, low)
        np.minimum.at(fresh, b, low)
        fresh = fresh[fresh]
        if (fresh == label).all():
            break
        label = fresh
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


class WordHashes(dict):
    """Stable 64-bit hash of each word; words met lately are remembered, two generations of a bounded number."""

    def __init__(self, bound: int = 200_000) -> None:
        super().__init__()
        self.bound, self.old = bound, {}

    def __missing__(self, word: str | bytes) -> int:
        h = self.old.get(word)
        if h is None:
            h = xxhash.xxh3_64_intdigest(word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass"))
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        self[word] = h
        return h
