"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations alone.

Every source gets a target number of words. Sources in code-point order, the null source last, take the given
weights in turn and share ``budget_share`` of all words; no target may exceed ``max_epochs`` times its source,
and what is above is shared among the rest by weight until none is above. A source takes complete epochs
first: each document floor(target / source size) times. The rest of the target is a weighted sample without
replacement: each document draws an exponential key, -ln(u) over its quality weight, and the documents of
least key are taken while their summed words fit.

The order within a source is never one task's sort. Keys fall into bins by their logarithm, so that keys of any
size are told apart; the words of each (source, bin) are summed before the shuffle, and prefix sums over a
source's 256 bins say which bins are in and which one holds the cut. That bin is divided in the same way, twice,
and only the documents of the last bin, at most 6 millionths of a source that has even weights, are sorted.

Cases: a null text has size 0, and texts are counted whole however long; documents of size 0 are taken 0 times; a
source of size 0 has target 0; ties of key go by doc_id; rows that repeat a doc_id, or have none, count as
documents of their own, and those without draw by their text; a null, NaN or non-positive quality weight counts
as the least weight, one above 1e12 as 1e12; doc_id may have any type that has an order; a table without rows gives
a table without rows; ``mixed`` passes other columns on whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inquest.llm.common import WORD, free_name, stored

WEIGHTS = (5.0, 2.0, 1.0)
LEAST_WEIGHT, MOST_WEIGHT = 0.01, 1e12
#: Bins of a level, and levels: the last bins hold a source's documents by 2**-24.
FAN, LEVELS = 256, 3


def quality_weight() -> Column:
    """Default weight of a document: near 1 for usual word lengths, less for very short or long words."""
    mean = F.length("text") / F.greatest(F.col("size"), F.lit(1))
    return F.greatest(F.lit(0.25), F.exp(-F.abs(mean - 6.0) / 4.0))


def uniform(seed: int) -> Column:
    """A number in (0, 1) from the document's id, or else its text, and the seed: the same in every run and engine."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary")), F.lit("null"))
    digest = F.md5(F.concat(own, F.lit(f":{seed}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _ranked(df: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """Number rows from 0 in order without one task holding them all: ranges, then offsets by range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range: as many as shuffle partitions
    offsets = dealt.groupBy("__range").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return dealt.join(offsets, "__range").withColumn(rank, within + F.col("__before")).drop("__range", "__before")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget_share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """source, source_size -> source, source_size, target.

    The driver sees sums only: each round shares the excess of the capped sources among the others.
    """
    turn = F.pmod("__rank", F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))
    ranked = stored(_ranked(sources, [F.col("source").asc_nulls_last()], "__rank").withColumn("__weight", weight), "sources")
    cap = F.col("source_size") * max_epochs
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget, level, capped = budget_share * total, None, -1
    while True:
        above = F.lit(False) if level is None else cap < F.col("__weight") * level
        n, full, free = ranked.agg(F.count_if(above), F.sum(F.when(above, cap).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("__weight")))).first()
        if n == capped or not free:
            break
        capped, level = n, (budget - full) / free
    share = cap if level is None or not free else F.least(cap.cast("double"), F.col("__weight") * F.lit(level))
    return ranked.select("source", "source_size", share.cast("double").alias("target"))


def _bin(key: Column) -> Column:
    """FAN**LEVELS bins of equal width over natural logarithms from -128 to 128."""
    most = FAN**LEVELS - 1
    return F.greatest(F.least(F.floor((F.log(key) + 128) * (most + 1) / 256), F.lit(most)), F.lit(0)).cast("bigint")


def _decided(docs: DataFrame, carried: list[str], weights: tuple[float, ...], budget_share: float, max_epochs: float, quality: Column | None, seed: int) -> DataFrame:
    """One row for each of docs: the carried columns, source, size, source_size, target and copies."""
    sized = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint"))
    given = F.nanvl(F.coalesce((quality_weight() if quality is None else quality).cast("double"), F.lit(0.0)), F.lit(0.0))
    key = -F.log(uniform(seed)) / F.greatest(F.least(given, F.lit(MOST_WEIGHT)), F.lit(LEAST_WEIGHT))
    # row tells rows apart that are equal otherwise; it is written, so it stays what it is
    drawn = stored(sized.select(*carried, "doc_id", "source", "size", key.alias("key"), _bin(key).alias("bin"), F.monotonically_increasing_id().alias("row")), "drawn")
    sizes = drawn.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, budget_share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = stored(plan.withColumnRenamed("source", "of").withColumn("cut", F.lit(0).cast("bigint")).withColumn("before", F.lit(0).cast("bigint")), "plan")
    upto = Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    for level in range(LEVELS):  # the bin that holds the cut, then the bin within it
        at, above = F.floor(F.col("bin") / FAN ** (LEVELS - 1 - level)), F.floor(F.col("bin") / FAN ** (LEVELS - level))
        near = drawn.join(plan.select("of", "cut"), drawn["source"].eqNullSafe(F.col("of")) & (above == F.col("cut")))
        words = near.groupBy("of", at.alias("at")).agg(F.sum("size").alias("words"))
        run = words.withColumn("upto", F.sum("words").over(upto)).withColumnRenamed("of", "of_")
        run = run.join(plan, F.col("of_").eqNullSafe(F.col("of"))).select("of", "at", (F.col("before") + F.col("upto") - F.col("words")).alias("start"), "words", "rest")
        cuts = run.where("start <= rest AND start + words > rest").groupBy(F.col("of").alias("of_")).agg(F.min("at").alias("cut_"), F.min_by("start", "at").alias("before_"))
        plan = plan.join(cuts, F.col("of").eqNullSafe(F.col("of_")), "left")
        # a source without words has no cut
        plan = stored(plan.select("of", "source_size", "target", "epochs", "rest", F.coalesce("cut_", F.lit(-1)).alias("cut"), F.coalesce("before_", F.lit(0)).alias("before")), "plan")
    all_ = drawn.join(plan, drawn["source"].eqNullSafe(plan["of"])).drop("of")
    running = F.sum("size").over(Window.partitionBy("source").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0))
    taken = (F.col("before") + running - F.col("size") / 2 <= F.col("rest")).cast("bigint")
    # few rows, which join the others without moving them
    at_cut = stored(all_.where("bin = cut").select(F.col("row").alias("row_"), taken.alias("more")), "at-cut")
    more = F.coalesce("more", (F.col("bin") < F.col("cut")).cast("bigint"))
    copies = F.when(F.col("size") > 0, F.col("epochs") + more).otherwise(0).cast("bigint")
    return all_.join(at_cut, F.col("row") == F.col("row_"), "left").select(*carried, "doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget_share: float = 1.5, max_epochs: float = 2.0, quality: Column | None = None, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (times taken) and taken (words taken).

    ``quality`` may read the columns of docs and ``size``.
    """
    return _decided(docs, [], weights, budget_share, max_epochs, quality, seed).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget_share: float = 1.5, max_epochs: float = 2.0, quality: Column | None = None, seed: int = 17) -> DataFrame:
    """The documents that the mix takes, each as often as it takes them, with docs' columns.

    The texts are written once, beside what each row has drawn, and not shuffled.
    """
    whole, = free_name(docs, "__whole")
    packed = docs.withColumn(whole, F.struct(*(F.col(f"`{c}`") for c in docs.columns)))
    taken = _decided(packed, [whole], weights, budget_share, max_epochs, quality, seed).where("copies > 0")
    return taken.select(whole, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(f"{whole}.*")


def shares(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, length(text) AS chars,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(text), 'null') || ':17'), 1, 12))::BIGINT + 0.5) / 281474976710656.0::DOUBLE AS u FROM documents
), k AS (
  SELECT *, -ln(u) / greatest(coalesce(greatest(0.25, exp(-abs(chars / greatest(size, 1)::DOUBLE - 6.0) / 4.0)), 0.0), 0.01) AS key FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM k GROUP BY source
), r AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
), v AS (SELECT min_by(level, cap / w) AS level FROM r WHERE level * w <= cap
), t AS (SELECT source, source_size, least(cap, w * v.level) AS target FROM r, v
), e AS (
  SELECT k.*, t.source_size, t.target, floor(t.target / greatest(t.source_size, 1))::BIGINT AS epochs,
         sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN size > 0 THEN size * (epochs + (upto - size / 2.0 <= target - epochs * source_size)::BIGINT) ELSE 0 END)::BIGINT AS taken FROM e
"""
