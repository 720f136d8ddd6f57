"""Asking a model about the rows of a DataFrame, each different document once.

With an expression backend an answer is a column that Catalyst compiles. With any other backend the different
documents that rows really need are asked, their answers are written to the shared folder (so that no retry,
lost executor or second reading asks again) and join the rows by the documents' hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inquest.errors import RefusalError
from inquest.operators.backends import ModelBackend, answer_type
from inquest.operators.calls import ModelCall
from inquest.sources.shared import kept, workers_import


@dataclass
class AskLog:
    """How questions are asked, and how many each call has asked.

    ``batch_rows``: documents in a batch; ``parallelism``: tasks that ask, as many as the documents come in if None;
    ``listeners`` are told of each call once its answers are written: the call, a DataFrame of the answers (h1, h2,
    answer) and their number.
    """

    asked: dict[ModelCall, int] = field(default_factory=dict)
    batch_rows: int = 1024
    parallelism: int | None = None
    listeners: list[Callable[[ModelCall, DataFrame, int], None]] = field(default_factory=list)

    def add(self, call: ModelCall, n: int) -> None:
        self.asked[call.identity()] = self.asked.get(call.identity(), 0) + n

    def heard(self, call: ModelCall, found: DataFrame) -> None:
        n = found.count()
        self.add(call, n)
        for listener in self.listeners:
            listener(call.identity(), found, n)

    @property
    def total(self) -> int:
        return sum(self.asked.values())


def _columns(documents: Sequence[Column | str]) -> list[Column]:
    return [F.col(d) if isinstance(d, str) else d for d in documents]


def check_support(backend: ModelBackend, call: ModelCall) -> None:
    if not backend.supports(call.kind):
        raise RefusalError([f"the model '{backend.name}' does not answer AI.{call.kind.upper()}"], constraint="model")


def _anchor(call: ModelCall) -> int | None:
    """Which document of a pair the questions about it should stand beside each other for."""
    return int(call.anchor) if call.anchor and call.anchor.isdigit() else None


def answers(docs: DataFrame, call: ModelCall, backend: ModelBackend, log: AskLog | None = None, beside: int | None = None) -> DataFrame:
    """h1, h2, d0.. -> h1, h2, answer, asked in Arrow batches and written once.

    With ``beside`` questions that share this document follow one another, for models that keep what they read.
    """
    workers_import(docs.sparkSession)
    kind, n = answer_type(call), call.documents
    batch_rows = log.batch_rows if log else AskLog.batch_rows
    if log and log.parallelism:
        docs = docs.repartition(log.parallelism)
    if beside is not None:
        docs = docs.sortWithinPartitions(F.xxhash64(docs.columns[2 + beside]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for whole in batches:
            for batch in (whole.slice(i, batch_rows) for i in range(0, whole.num_rows, batch_rows)):
                got = backend.ask(call, list(zip(*(batch.column(2 + i).to_pylist() for i in range(n)), strict=True)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, to_arrow_type(kind))], ["h1", "h2", "answer"])

    return kept(docs.mapInArrow(run, f"h1 bigint, h2 bigint, answer {kind.simpleString()}"), "answers")


def ask(df: DataFrame, call: ModelCall, documents: Sequence[Column | str], out: str, backend: ModelBackend, guard: Column | None = None, log: AskLog | None = None) -> DataFrame:
    """df with the answer column ``out``; null where a document is null or the guard isn't true."""
    check_support(backend, call)
    given = _columns(documents)
    names = [f"__doc{i}" for i in range(len(given))]
    sql = backend.expression(call, names)
    if sql is not None:
        made = F.expr(sql) if guard is None else F.when(guard, F.expr(sql))
        return df.withColumns(dict(zip(names, given, strict=True))).withColumn(out, made).drop(*names)
    wanted = F.lit(True) if guard is None else F.coalesce(guard, F.lit(False))
    for d in given:
        wanted = wanted & d.isNotNull()
    keys = {"__h1": F.when(wanted, F.xxhash64(*given)), "__h2": F.when(wanted, F.xxhash64(F.lit(7), *given))}
    keyed = df.withColumns(keys)
    docs = keyed.where("__h1 IS NOT NULL").select(F.col("__h1").alias("h1"), F.col("__h2").alias("h2"), *(d.alias(n) for d, n in zip(given, names, strict=True)))
    found = answers(docs.dropDuplicates(["h1", "h2"]), call, backend, log, beside=_anchor(call))
    if log is not None:
        log.heard(call, found)
    found = found.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), F.col("answer").alias(out))
    return keyed.join(found, ["__h1", "__h2"], "left").select(*(F.col(f"`{c}`") for c in df.columns if c != out), out)


def ai_filter(df: DataFrame, tests: Sequence[tuple[ModelCall, Sequence[Column | str]]], backend: ModelBackend, log: AskLog | None = None, by_cost: bool = True) -> DataFrame:
    """Rows for which all AI.IF tests are true, cheapest rows spared first."""
    for call, documents in sorted(tests, key=lambda t: t[0].rank()) if by_cost else tests:
        df = ask(df, call, documents, "__test", backend, log=log).where("__test").drop("__test")
    return df


def ai_any(df: DataFrame, plain: Column | None, tests: Sequence[tuple[ModelCall, Sequence[Column | str]]], backend: ModelBackend, log: AskLog | None = None) -> DataFrame:
    """Rows for which the plain test or one of the AI.IF tests is true: each is asked only where none was yet."""
    so_far = F.lit(False) if plain is None else F.coalesce(plain, F.lit(False))
    df = df.withColumn("__any", so_far)
    for call, documents in sorted(tests, key=lambda t: t[0].cost / max(1e-6, t[0].keeps)):
        df = ask(df, call, documents, "__test", backend, guard=~F.col("__any"), log=log)
        df = df.withColumn("__any", F.col("__any") | F.coalesce("__test", F.lit(False))).drop("__test")
    return df.where("__any").drop("__any")


def ai_join(left: DataFrame, right: DataFrame, call: ModelCall, left_doc: str, right_doc: str, backend: ModelBackend, on: Callable[[DataFrame, DataFrame], Column] | None = None, how: str = "inner", extra: Sequence[ModelCall] = (), log: AskLog | None = None) -> DataFrame:
    """Join two tables on a model's answer about pairs of documents.

    ``on(left, right)`` narrows the candidate pairs first; without it every pair is a candidate. ``how`` is inner,
    left, right, full, left_semi or left_anti. Unmatched rows come back by row identity, so copies keep their
    number. In left_anti a null document reads as the empty text. Columns must have different names.
    """
    if clash := set(left.columns) & set(right.columns):
        raise RefusalError([f"both tables have a column {sorted(clash)[0]}; rename one"], constraint="join")
    anti = how == "left_anti"
    row_l, row_r = "__row_l", "__row_r"
    # row numbers must not change between readings
    lhs = kept(left.withColumn(row_l, F.monotonically_increasing_id()), "left")
    rhs = kept(right.withColumn(row_r, F.monotonically_increasing_id()), "right")
    read = (lambda c: F.coalesce(F.col(c), F.lit(""))) if anti else F.col
    near = on(lhs, rhs) if on else F.lit(True)
    if backend.expression(call, ["__l", "__r"]) is not None:
        pairs = lhs.join(rhs, near).select(row_l, row_r, read(left_doc).alias("__l"), read(right_doc).alias("__r"))
        for each in sorted([call, *extra], key=ModelCall.rank):
            pairs = ask(pairs, each, ["__l", "__r"], "__match", backend, log=log).where("__match").drop("__match")
    else:
        # a candidate pair is two row numbers and the hashes of its texts; texts join the pairs that are asked
        named = lambda df, doc, s: df.withColumns({f"__{s}1": F.when(read(doc).isNotNull(), F.xxhash64(read(doc))), f"__{s}2": F.xxhash64(F.lit(7), read(doc))})
        keys = ["__l1", "__l2", "__r1", "__r2"]
        pairs = named(lhs, left_doc, "l").join(named(rhs, right_doc, "r"), near).select(row_l, row_r, *keys).where("__l1 IS NOT NULL AND __r1 IS NOT NULL")
        pairs = kept(pairs, "candidates")
        texts = lambda df, doc, s: named(df, doc, s).where(f"__{s}1 IS NOT NULL").select(f"__{s}1", f"__{s}2", read(doc).alias(f"__{s}")).dropDuplicates([f"__{s}1", f"__{s}2"])
        for each in sorted([call, *extra], key=ModelCall.rank):
            check_support(backend, each)
            kinds = pairs.select(*keys).distinct().join(texts(lhs, left_doc, "l"), keys[:2]).join(texts(rhs, right_doc, "r"), keys[2:])
            asked = answers(kinds.select(F.xxhash64(*keys).alias("h1"), F.xxhash64(F.lit(7), *keys).alias("h2"), "__l", "__r"), each, backend, log, beside=_anchor(each))
            if log is not None:
                log.heard(each, asked)
            good = asked.where("answer").select("h1", "h2")
            pairs = pairs.join(good, (F.xxhash64(*keys) == F.col("h1")) & (F.xxhash64(F.lit(7), *keys) == F.col("h2")), "left_semi")
    pairs = kept(pairs.select(row_l, row_r), "pairs")
    if how in ("left_semi", "left_anti"):
        return lhs.join(pairs, row_l, how).drop(row_l)
    both = pairs.join(lhs, row_l).join(rhs, row_r).select(*left.columns, *right.columns)
    if how in ("left", "full"):
        both = both.unionByName(lhs.join(pairs, row_l, "left_anti").drop(row_l), allowMissingColumns=True)
    if how in ("right", "full"):
        both = both.unionByName(rhs.join(pairs, row_r, "left_anti").drop(row_r), allowMissingColumns=True)
    return both.select(*left.columns, *right.columns)


def ai_fetch(df: DataFrame, call: ModelCall, documents: Sequence[Column | str], n: int, order: Sequence[Column], backend: ModelBackend, key: Sequence[str] = (), log: AskLog | None = None) -> DataFrame:
    """The first n rows (of each key) in ascending order that pass an AI.IF, asking batch after batch until they are found.

    The first batch has n rows of each key, or 2 n rows without keys, and each further one twice as many. A row is
    known by its number in a written table of order columns, keys and documents' hashes, whose places are counted in
    ranges: no task orders a whole key. Texts are read for the batch that is asked.
    """
    if n <= 0:
        return df.limit(0)
    given = _columns(documents)
    by, at = [f"__o{i}" for i in range(len(order))], "__row"
    # what is ordered carries no text; row numbers must not change between readings
    whole = df.withColumn(at, F.monotonically_increasing_id())
    whole = whole if _stays(df) else kept(whole, "rows")
    small = whole.select(at, *(F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(key)), *(c.alias(b) for c, b in zip(order, by, strict=True)))
    keys = [f"__k{i}" for i in range(len(key))]
    down = [F.col(b) for b in by] + [F.col(at)]
    if not key:
        return _first(whole, small.select(at, *by), call, given, n, down, backend, log)
    numbered = kept(_placed(small, keys, down).select(at, *keys, "__n"), "numbered")
    most = numbered.agg(F.max("__n")).first()[0] or 0
    found, done, size, full = None, 0, n, None
    while done < most:
        batch = numbered.where((F.col("__n") > done) & (F.col("__n") <= done + size))
        if full is not None:
            batch = kept(batch.join(full, [batch[k].eqNullSafe(full[k + "_"]) for k in keys], "left_anti"), "batch")
            if batch.isEmpty():  # a key's rows are numbered without gaps: none misses a row any more
                break
        rows = whole.join(batch.select(at, "__n"), at)
        passed = ask(rows, call, documents, "__test", backend, log=log).where("__test").select(at, "__n", *(F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(key)))
        passed = kept(passed, "passed")
        found = passed if found is None else found.unionByName(passed)
        full = found.groupBy(*keys).agg(F.count("*").alias("__c")).where(F.col("__c") >= n).select(*(F.col(k).alias(k + "_") for k in keys))
        done, size = done + size, size * 2
    if found is None:
        return df.limit(0)
    best = found.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy("__n"))).where(F.col("__k") <= n).select(at)
    return whole.join(kept(best, "fetched"), at, "left_semi").drop(at)


def _stays(df: DataFrame) -> bool:
    """Whether each reading of df has the same rows in the same partitions: no shuffle and nothing drawn."""
    plan = df._jdf.queryExecution()
    return "Exchange" not in plan.executedPlan().toString() and plan.optimizedPlan().deterministic()


def _placed(small: DataFrame, keys: Sequence[str], down: Sequence[Column]) -> DataFrame:
    """Number each key's rows in order, ``__n`` from 1: ranges over key and order, then what lies before a range."""
    ranged = kept(small.repartitionByRange(*(F.col(k) for k in keys), *down).withColumn("__part", F.spark_partition_id()), "ranges")
    own = F.row_number().over(Window.partitionBy("__part", *keys).orderBy(*down))
    # one row for each range and key in it
    sizes = ranged.groupBy("__part", *keys).agg(F.count("*").alias("__size"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(F.col("__part").alias("__p"), "__before", *(F.col(k).alias(k + "_") for k in keys))
    same = F.col("__part") == F.col("__p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(k + "_"))
    return ranged.withColumn("__own", own).join(before, same).withColumn("__n", F.col("__own") + F.col("__before"))


def _first(whole: DataFrame, small: DataFrame, call: ModelCall, given: Sequence[Column], n: int, down: Sequence[Column], backend: ModelBackend, log: AskLog | None) -> DataFrame:
    """The first n rows that pass, without numbering the others: each batch is the rows after the last one, taken by
    a top-k that keeps as many rows of a partition as are asked for."""
    at, found, size, last = "__row", None, 2 * n, None
    place = F.struct(*down)
    while True:
        rest = small if last is None else small.where(place > last)
        batch = kept(rest.orderBy(*down).limit(size).select(at, place.alias("__place")), "batch")
        passed = kept(ask(whole.join(batch, at), call, list(given), "__test", backend, log=log).where("__test").select(at, "__place"), "passed")
        found = passed if found is None else found.unionByName(passed)
        if found.count() >= n or batch.count() < size:
            best = kept(found.orderBy("__place").limit(n).select(at), "fetched")
            return whole.join(best, at, "left_semi").drop(at)
        top = batch.agg(F.max("__place")).first()[0]
        last = F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(top, batch.schema["__place"].dataType, strict=True)))
        size *= 2


def ai_take(df: DataFrame, call: ModelCall, documents: Sequence[Column | str], n: int, backend: ModelBackend, log: AskLog | None = None) -> DataFrame:
    """Any n rows that pass an AI.IF, as LIMIT without an order allows.

    Reads the beginnings of df's partitions, 2 n rows of each and then four times as many, and asks about them batch
    after batch; the rest of the table is neither read nor written unless it is needed. A table that comes out of a
    shuffle, whose partitions needn't be the same again, is written first.
    """
    if n <= 0:
        return df.limit(0)
    source = df if _stays(df) else kept(df, "rows")
    workers_import(df.sparkSession)
    low, size, found = 0, 2 * n, None
    schema = T.StructType([*df.schema.fields, T.StructField("__at", T.LongType()), T.StructField("__part", T.LongType())])
    while True:
        heads = kept(source.mapInArrow(_heads(low, low + size), schema), "heads")
        last, step = (-1, -1), 2 * n
        while True:
            after = (F.col("__at") > last[0]) | ((F.col("__at") == last[0]) & (F.col("__part") > last[1]))
            batch = kept(heads.where(after).orderBy("__at", "__part").limit(step), "batch")
            top = batch.agg(F.max(F.struct("__at", "__part"))).first()[0]
            if top is None:
                break
            passed = kept(ask(batch, call, documents, "__test", backend, log=log).where("__test").select(*(f"`{c}`" for c in df.columns)), "passed")
            found = passed if found is None else found.unionByName(passed)
            if found.count() >= n:
                return found.limit(n)
            last, step = tuple(top), step * 2
        if last == (-1, -1):  # no partition has more rows
            return df.limit(0) if found is None else found
        low, size = low + size, size * 4


def _heads(low: int, high: int):
    """Rows low to high of each partition, with their numbers; what comes after them isn't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            a, b = max(low - seen, 0), min(high - seen, batch.num_rows)
            if a < b:
                at = pa.array(range(seen + a, seen + b), pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, at, pa.array([part] * (b - a), pa.int64())], [*batch.schema.names, "__at", "__part"])
            seen += batch.num_rows
            if seen >= high:
                return

    return run
