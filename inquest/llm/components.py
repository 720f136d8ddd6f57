"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inquest.llm.common import dropped, stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges: a, b (comparable ids) -> node, component: the smallest id reachable, for each id in an edge.

    Alternates large-star and small-star steps (each node links its greater, then its smaller neighbours to
    the least id it knows) until nothing changes: a number of rounds that grows with the logarithm of the
    graph. Each round is written to the shared folder, so its lineage is short and it survives lost executors.
    A hub's rows are split by adaptive execution; its least neighbour combines before the shuffle.
    """
    spark = edges.sparkSession
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, before = stored(links, name), None
    while True:
        # large star: every greater neighbour of u points at the least id near u
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = stored(large.distinct(), name)
        # small star: u and its smaller neighbours point at the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        small = stored(small.where("u <> v").distinct(), name)
        state = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(spark, links, large)
        links = small
        if state == before:
            break
        before = state
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
