"""Sessions, queries and results."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inquest.errors import CompileError
from inquest.functions import documents as documents_
from inquest.operators.ask import AskLog, check_support
from inquest.operators.backends import ExprBackend, ModelBackend, answer_type, asking
from inquest.operators.calls import ModelCall
from inquest.plans.eager import Planner
from inquest.plans.registry import ExtensionRegistry
from inquest.plans.sqlfront import Front, Rewritten, tokenize
from inquest.plans.sqlfront import _split as split_arguments
from inquest.sources import catalog as sources
from inquest.sources.shared import kept, workers_import


def _from_path(read: Callable[[SparkSession, str], DataFrame]) -> Callable[..., DataFrame]:
    """A method that registers what ``read`` finds at a path."""

    def register(self: AiSession, name: str, path: str, id_col: str = "") -> DataFrame:
        return self.catalog.add(name, read(self.spark, path), id_col)

    return register


@dataclass(frozen=True)
class EngineConfig:
    """Which model answers and how it is asked: documents in a batch, tasks that ask, rules of the planner left out."""

    model: ModelBackend | str | None = None
    batch_rows: int = 1024
    parallelism: int | None = None
    without: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.batch_rows < 1 or self.parallelism is not None and self.parallelism < 1:
            raise CompileError("batch_rows and parallelism are at least 1")


class AiSession:
    """SQL with questions to a model, over an existing SparkSession."""

    def __init__(self, spark: SparkSession | None = None, model: ModelBackend | str | None = None, registry: ExtensionRegistry | None = None, without: Sequence[str] = (), config: EngineConfig | None = None) -> None:
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.registry = registry or ExtensionRegistry()
        self.config = config or EngineConfig()
        model, without = model if model is not None else self.config.model, without or self.config.without
        self.model = self.registry.model(model) if isinstance(model, str) else model or ExprBackend()
        self.catalog = sources.Catalog(self.spark)
        self.prepared: dict[str, tuple[str, str]] = {}
        self._asks: dict[ModelCall, str] = {}
        self.without = tuple(without)
        self.views: list[str] = []
        workers_import(self.spark)

    def __enter__(self) -> AiSession:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        self.catalog.close()
        while self.views:
            self.spark.catalog.dropTempView(self.views.pop())

    # ---- tables

    def register(self, name: str, table: Any, id_col: str = "") -> DataFrame:
        return self.catalog.add(name, sources.to_frame(self.spark, table), id_col)

    register_parquet = _from_path(sources.read_parquet)
    register_json = _from_path(sources.read_json)
    register_csv = _from_path(sources.read_csv)
    register_ipc = _from_path(sources.read_ipc)

    def register_hf(self, name: str, dataset: str, id_col: str = "", **options: Any) -> DataFrame:
        return self.catalog.add(name, sources.read_hf(self.spark, dataset, **options), id_col)

    def register_labels(self, name: str, labels: Sequence) -> None:
        """A set of labels that AI.CLASSIFY can name."""
        self.catalog.labels[name.lower()] = list(labels)

    # ---- queries

    def sql(self, text: str, *, dialect: str = "snowflake", order: str | None = None, nodes: Sequence[str] = ()) -> Query:
        """A query, bound at once: mistakes show here, before anything runs. ``nodes`` are registered steps that its
        rows go through at the end, one after another."""
        if order not in (None, "as_written", "by_cost"):
            raise CompileError(f"unknown order '{order}'; expected as_written or by_cost")
        return Query(self, text, dialect, order, tuple(map(self.registry.node, nodes)))

    def read_format(self, name: str, fmt: str, path: str | None = None, id_col: str = "", **options: Any) -> DataFrame:
        """Register a table of any Spark data source: delta, iceberg, orc, jdbc and so on."""
        return self.catalog.add(name, sources.read_format(self.spark, fmt, path, **options), id_col)

    def front(self, dialect: str) -> Front:
        return Front(self._answer, documents_.sql_call(self.spark), dialect, self.labels_of, self.columns_of)

    def labels_of(self, name: str) -> list | None:
        return self.catalog.labels.get(name.lower())

    def columns_of(self, name: str) -> list[str] | None:
        table = self.catalog.tables.get(name.lower())
        return None if table is None else table.columns

    def _answer(self, call: ModelCall, documents: list[str]) -> str:
        check_support(self.model, call)
        sql = self.model.expression(call, documents)
        if sql is not None:
            return sql
        if call.kind == "extract" and len(call.fields) > 1:
            # a question for each field: Catalyst drops those that nobody reads
            one = lambda n, q: ModelCall("extract", call.question, 1, fields=((n, q),))
            return "named_struct(" + ", ".join(f"'{n}', ({self._answer(one(n, q), documents)})['{n}']" for n, q in call.fields) + ")"
        key = call.identity()
        if key not in self._asks:
            name = f"__inquest_ask_{len(self._asks)}"
            self.spark.udf.register(name, F.pandas_udf(asking(self.model, key), answer_type(call), F.PandasUDFType.SCALAR))
            self._asks[key] = name
        return f"{self._asks[key]}({', '.join(documents)})"

    def estimate_calls(self, text: str, *, dialect: str = "snowflake") -> list[ModelCall]:
        """The different calls of a query, without running it."""
        return list(dict.fromkeys(c.identity() for c in self.front(dialect).rewrite(text).calls))


_CREATE = re.compile(r"\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?(TABLE|VIEW)\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w`\"]+)\s+AS\s+(.*)", re.I | re.S)
_DROP = re.compile(r"\s*DROP\s+(?:TABLE|VIEW)\s+(IF\s+EXISTS\s+)?([\w`\"]+)\s*;?\s*$", re.I)
_PREPARE = re.compile(r"\s*PREPARE\s+(\w+)(?:\s*\([^)]*\))?\s+AS\s+(.*)", re.I | re.S)
_EXECUTE = re.compile(r"\s*EXECUTE\s+(\w+)\s*(?:\((.*)\))?\s*;?\s*$", re.I | re.S)
_EXPLAIN = re.compile(r"\s*EXPLAIN\s+(ANALYZE\s+|VERBOSE\s+)*(.*)", re.I | re.S)
_SCHEMA = re.compile(r"'(?:[^'\\]|\\.|'')*'|\binformation_schema\s*\.\s*(tables|columns)\b", re.I)
_PLAIN = re.compile(r"\s*(SET|RESET|SHOW|DESCRIBE|DESC)\b", re.I)


def _with_schema(session: AiSession, text: str) -> str:
    """information_schema.tables and .columns are views of what is registered."""
    found = {k.lower() for k in _SCHEMA.findall(text) if k}
    tables = {name: df for name, df in session.catalog.tables.items() if not name.startswith("__information_")}
    for kind in found:
        if kind == "tables":
            rows, schema = [(n, "VIEW") for n in tables], "table_name string, table_type string"
        else:
            rows = [(n, f.name, k, f.dataType.simpleString(), "YES" if f.nullable else "NO") for n, df in tables.items() for k, f in enumerate(df.schema, 1)]
            schema = "table_name string, column_name string, ordinal_position int, data_type string, is_nullable string"
        session.spark.createDataFrame(rows, schema).createOrReplaceTempView(f"__information_{kind}")
        session.views.append(f"__information_{kind}")
    return _SCHEMA.sub(lambda m: f"__information_{m[1].lower()}" if m[1] else m[0], text)


def _filled_in(body: str, values: str, dialect: str) -> str:
    """A prepared statement with its $1, $2, ... replaced, except inside strings and quoted names."""
    tokens = tokenize(values, dialect)
    given = [" ".join(t.text for t in v) for v in split_arguments(tokens)] if tokens else []

    def value(m: re.Match) -> str:
        if m[1] is None:
            return m[0]
        if not 1 <= int(m[1]) <= len(given):
            raise CompileError(f"the statement reads ${m[1]} and was given {len(given)} value{'s' * (len(given) != 1)}")
        return f"({given[int(m[1]) - 1]})" if given[int(m[1]) - 1][:1] == "-" else given[int(m[1]) - 1]

    return re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`[^`]*`|--[^\n]*|\$(\d+)", value, body)


class Query:
    """A bound statement; nothing has run yet."""

    def __init__(self, session: AiSession, text: str, dialect: str, order: str | None = None, nodes: Sequence[Callable[[DataFrame], DataFrame]] = ()) -> None:
        self.session, self.text, self.dialect, self.order, self.nodes = session, _with_schema(session, text), dialect, order, nodes
        self.calls: list[ModelCall] = []
        self._act: Callable[[], DataFrame] | None = None
        self.spark_sql = ""
        self.asked: AskLog | None = None
        self._rows: DataFrame | None = None
        self._bind()

    def _bind(self) -> None:
        s, spark = self.session, self.session.spark
        empty = lambda: spark.createDataFrame([], "status string")
        if m := _CREATE.match(self.text):
            kind, name, body = m[1].upper(), m[2].strip('`"'), Query(s, m[3], self.dialect, self.order)
            self.calls = body.calls

            def create() -> DataFrame:
                df = body.dataframe()
                s.catalog.add(name, kept(df, name) if kind == "TABLE" else df)
                return empty()

            self._act = create
        elif m := _DROP.match(self.text):
            name = m[2].strip('`"')

            def drop() -> DataFrame:
                if not s.catalog.drop(name) and not m[1]:
                    raise CompileError(f"there is no table named '{name}'")
                return empty()

            self._act = drop
        elif m := _PREPARE.match(self.text):

            def prepare() -> DataFrame:
                s.prepared[m[1].lower()] = (m[2], self.dialect)
                return empty()

            self._act = prepare
        elif m := _EXECUTE.match(self.text):
            if m[1].lower() not in s.prepared:
                raise CompileError(f"nothing is prepared under the name '{m[1]}'")
            body, dialect = s.prepared[m[1].lower()]
            inner = Query(s, _filled_in(body, m[2] or "", dialect), dialect, self.order)
            self.calls, self._act = inner.calls, inner.dataframe
        elif m := _EXPLAIN.match(self.text):
            inner = Query(s, m[2], self.dialect, self.order)
            self.calls = inner.calls
            self._act = lambda: spark.createDataFrame([(inner.explain(analyze="ANALYZE" in (m[1] or "").upper()),)], "plan string")
        elif _PLAIN.match(self.text):
            self._act = lambda: spark.sql(self.text)
        else:
            done: Rewritten = s.front(self.dialect).rewrite(self.text)
            self.calls, self.spark_sql = done.calls, done.sql
            for rule in s.registry.rules:
                self.spark_sql = rule(self.spark_sql)
            outside = bool(self.calls) and s.model.expression(self.calls[0], ["NULL"] * self.calls[0].documents) is None
            if outside:  # the text is analysed with a model that Spark takes anywhere
                self.spark_sql = Front(ExprBackend().expression, documents_.sql_call(spark), self.dialect, s.labels_of, s.columns_of).rewrite(self.text).sql
            df = self._analysed()
            self._act = self._planned if outside else lambda: df

    def _planned(self) -> DataFrame:
        """The rows with a model that answers outside Spark; the questions are asked here, once a query."""
        if self._rows is None:
            # as written: tests run in the order of the text
            planner = Planner(self.session, self.dialect, (*self.session.without, *(["order"] if self.order == "as_written" else [])))
            self._rows = planner.run(self.text)
            self.asked = planner.log
        return self._rows

    def _analysed(self) -> DataFrame | None:
        try:
            return self.session.spark.sql(self.spark_sql)
        except (AnalysisException, ParseException) as e:
            raise CompileError(explain_error(e)) from e

    def dataframe(self) -> DataFrame:
        df = self._act()
        for node in self.nodes:
            df = node(df)
        return df

    def regions(self) -> list[dict]:
        """The parts that a model answers: each different call, and how often it was asked if it has run."""
        asked = self.asked.asked if self.asked else {}
        return [{"kind": c.kind, "question": c.question, "documents": c.documents, "executed": c in asked, "asked": asked.get(c)} for c in dict.fromkeys(c.identity() for c in self.calls)]

    def plan(self) -> str:
        """The optimised logical plan."""
        return self.dataframe()._jdf.queryExecution().optimizedPlan().toString()

    def explain(self, verbose: bool = False, analyze: bool = False) -> str:
        df = self.dataframe()
        lines = [f"asks AI.{c.kind.upper()} {c.question!r}" for c in dict.fromkeys(c.identity() for c in self.calls)]
        if analyze:
            began = time.time()
            n = df.count()
            lines.append(f"{n} rows in {time.time() - began:.3f} s")
        else:
            lines.append("not executed")
        q = df._jdf.queryExecution()
        return "\n".join(lines) + "\n" + (q.toString() if verbose else q.executedPlan().toString())

    def run(self) -> QueryResult:
        return QueryResult(self)

    def collect(self, limit: int | None = None) -> pa.Table:
        return self.run().collect(limit)

    def execute_stream(self, batch_rows: int = 65536, limit: int | None = None) -> pa.RecordBatchReader:
        return self.run().execute_stream(batch_rows, limit)


def _as_bytes(rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in given:
            for batch in (whole.slice(i, rows) for i in range(0, whole.num_rows, rows)):
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, batch.schema) as writer:
                    writer.write_batch(batch)
                yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["ipc"])

    return run


class QueryResult:
    """Rows, as a table or as a stream, and what running took."""

    def __init__(self, query: Query) -> None:
        self.query, self._df, self._began = query, query.dataframe(), time.time()
        self._seconds: float | None = None
        self._rows: int | None = None

    def _limited(self, limit: int | None) -> DataFrame:
        if limit is not None and limit < 0:
            raise CompileError("a limit is not negative")
        return self._df if limit is None else self._df.limit(limit)

    def collect(self, limit: int | None = None) -> pa.Table:
        began = time.time()
        out = self._limited(limit).toArrow()
        self._seconds, self._rows = time.time() - began, out.num_rows
        self.query.session.registry.report(self.report())
        return out

    def execute_stream(self, batch_rows: int = 65536, limit: int | None = None) -> pa.RecordBatchReader:
        """Record batches while the query runs, one partition after another, of at most ``batch_rows`` rows.

        Batches cross from the executors as Arrow's own bytes; no row becomes a Python object.
        """
        df = self._limited(limit)
        schema = df.limit(0).toArrow().schema
        workers_import(df.sparkSession)

        def batches() -> Iterator[pa.RecordBatch]:
            for row in df.mapInArrow(_as_bytes(batch_rows), "ipc binary").toLocalIterator(prefetchPartitions=False):
                for batch in pa.ipc.open_stream(bytes(row["ipc"])):
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema, strict=True)], schema=schema)

        return pa.RecordBatchReader.from_batches(schema, batches())

    def to_rows(self) -> list[dict]:
        return self.collect().to_pylist()

    def count(self) -> int:
        return self._df.count()

    __len__ = count

    def explain(self, **how: bool) -> str:
        return self.query.explain(**how)

    def report(self) -> dict:
        calls = list(dict.fromkeys(c.identity() for c in self.query.calls))
        return {"model": self.query.session.model.name, "calls": [{"kind": c.kind, "question": c.question} for c in calls], "rows": self._rows, "wall_seconds": self._seconds, "asked": self.query.asked.total if self.query.asked else None}


def explain_error(e: Exception) -> str:
    """Spark's message in the words of this front end."""
    text = str(e)
    kind = getattr(e, "getCondition", lambda: "")() or ""
    if "DATATYPE_MISMATCH.FILTER_NOT_BOOLEAN" in kind:
        got = re.search(r'of type "([^"]+)"', text)
        return f"a test is true or false, got {got[1] if got else 'another type'}"
    if "UNRESOLVED_ROUTINE" in kind:
        name = re.search(r"routine `?([\w`.]+)`?", text)
        return f"unknown function {name[1].replace('`', '') if name else ''}".strip()
    if "MISSING_AGGREGATION" in kind or "MISSING_GROUP_BY" in kind:
        return f"a column is neither grouped nor aggregated: {text.splitlines()[0]}"
    if "PYTHON_UDF_IN_ON_CLAUSE" in text:
        return "this model cannot be asked inside the ON of an outer, semi or anti join; use operators.ask.ai_join"
    return text.split("SQLSTATE")[0].strip()


def install(spark: SparkSession, model: ModelBackend | None = None) -> AiSession:
    """Use the AI functions in a session that exists."""
    return AiSession(spark, model)
