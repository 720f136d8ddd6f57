"""Named tables: what can be registered, and what is refused."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from inquest.errors import CompileError, RefusalError
from inquest.sources.shared import workers_import


class Catalog:
    """Thin registry over temp views."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}
        self.ids: dict[str, str] = {}
        self.labels: dict[str, list] = {}

    def add(self, name: str, df: DataFrame, id_col: str = "") -> DataFrame:
        if "@" in name:
            raise CompileError(f"a table's name has no '@': '{name}'")
        if name.lower() in self.tables:
            raise CompileError(f"a table named '{name}' is registered already")
        if id_col and id_col not in df.columns:
            raise CompileError(f"id_col '{id_col}' is not a column of '{name}'; its columns are {', '.join(df.columns)}")
        df.createOrReplaceTempView(f"`{name}`" if not name.isidentifier() else name)
        self.tables[name.lower()], self.ids[name.lower()] = df, id_col
        return df

    def drop(self, name: str) -> bool:
        self.ids.pop(name.lower(), None)
        self.labels.pop(name.lower(), None)
        return self.tables.pop(name.lower(), None) is not None and self.spark.catalog.dropTempView(name)

    def close(self) -> None:
        for name in list(self.tables):
            self.drop(name)


def to_frame(spark: SparkSession, table: Any) -> DataFrame:
    """A DataFrame of whatever holds a table: Spark, Arrow, pandas, a DataSource, or an object that scans."""
    if isinstance(table, DataFrame):
        return table
    if isinstance(table, type) and issubclass(table, DataSource):
        spark.dataSource.register(table)
        return spark.read.format(table.name()).load()
    if isinstance(table, pads.FileSystemDataset) and table.format.default_extname in ("parquet",):
        return spark.read.parquet(*table.files)  # Spark reads the files itself, pruned and in parallel
    if isinstance(table, pads.FileSystemDataset):
        return read_fragments(spark, table)
    if isinstance(table, pads.Dataset):
        return spark.createDataFrame(table.to_table())
    if isinstance(table, pa.RecordBatchReader):
        return spark.createDataFrame(table.read_all())
    if isinstance(table, pa.RecordBatch):
        return spark.createDataFrame(pa.Table.from_batches([table]))
    if isinstance(table, pa.Table):
        return spark.createDataFrame(table)
    if hasattr(table, "__arrow_c_stream__"):
        return spark.createDataFrame(pa.RecordBatchReader.from_stream(table).read_all())
    if hasattr(table, "scan"):
        return spark.createDataFrame(pa.Table.from_batches(list(table.scan()), table.schema()))
    if hasattr(table, "columns") and hasattr(table, "iloc"):
        return spark.createDataFrame(table)
    if isinstance(table, dict):
        return spark.createDataFrame(pa.table(table))
    raise CompileError(f"cannot read a table from {type(table).__name__}")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(str(path))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(str(path))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(str(path), header=True, inferSchema=True)


def _opened(raw: bytes) -> pa.RecordBatchReader:
    if raw[:6] == b"ARROW1":
        file = pa.ipc.open_file(raw)
        return pa.RecordBatchReader.from_batches(file.schema, (file.get_batch(i) for i in range(file.num_record_batches)))
    return pa.ipc.open_stream(raw)


def read_ipc(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files or streams, a file or a folder of them; executors read them, and the driver one schema."""
    workers_import(spark)
    files = spark.read.format("binaryFile").load(str(path)).select("content")

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_opened(x).schema.serialize().to_pybytes() for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["schema"])

    first = files.limit(1).mapInArrow(head, "schema binary").first()
    if first is None:
        raise CompileError(f"there is no file at {path}")
    schema = from_arrow_schema(pa.ipc.read_schema(pa.py_buffer(bytes(first["schema"]))))
    return files.mapInArrow(_rows_as(lambda batch: (x for raw in batch.column(0).to_pylist() for x in _opened(raw)), to_arrow_schema(schema)), schema)


def _rows_as(parts: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                yield pa.RecordBatch.from_arrays([part.column(f.name).cast(f.type) for f in schema], schema=schema)

    return run


def read_fragments(spark: SparkSession, dataset: pads.FileSystemDataset) -> DataFrame:
    """A dataset of files in any format that Arrow reads; each file, or part that Arrow tells apart, is a task."""
    workers_import(spark)
    fragments, schema = list(dataset.get_fragments()), from_arrow_schema(dataset.schema)
    whole = dataset.schema
    numbers = spark.range(0, len(fragments), 1, max(1, len(fragments)))
    return numbers.mapInArrow(_rows_as(lambda batch: (x for i in batch.column(0).to_pylist() for x in fragments[i].to_batches(schema=whole)), to_arrow_schema(schema)), schema)


def read_hf(spark: SparkSession, dataset: str, split: str = "train", config: str | None = None, revision: str | None = None) -> DataFrame:
    """A dataset of the public hub, through Spark's Python data source if it is installed."""
    try:
        from pyspark_huggingface import HuggingFaceDatasets
    except ImportError:
        raise RefusalError([f"dataset '{dataset}' needs the pyspark_huggingface package and a network"], constraint="source") from None
    spark.dataSource.register(HuggingFaceDatasets)
    reader = spark.read.format("huggingface").option("split", split)
    reader = reader.option("config", config) if config else reader
    return (reader.option("revision", revision) if revision else reader).load(dataset)


def read_format(spark: SparkSession, kind: str, path: str | None = None, **options: str) -> DataFrame:
    """Any other format that Spark has a reader for (delta, iceberg, orc, text, ...)."""
    return spark.read.format(kind).options(**options).load(path)
