"""Connected components by alternating large-star and small-star rounds, each a few joins on the node."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.frames import dropped, fresh_path, stored


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Every node's larger (or other) neighbours get the smallest node around it. Only minima meet, so a hot node adds no group."""
    if larger:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if larger:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a != b")


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour or none, and then no other: no round would change such edges."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0] == 0


def components(links: DataFrame, a: str, b: str, rounds: int = 60, folder: str | None = None) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of a link.

    Links go either way, may repeat and may join a node with itself; null ends are no links.
    Long chains take a number of rounds that grows with the logarithm of their length. The links
    and the last round stay stored, below folder if that is given: the result reads them.
    """
    spark = links.sparkSession
    folder = f"{folder}/components-{uuid.uuid4().hex}" if folder else fresh_path(spark, "components")
    pairs = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    pairs = stored(pairs.distinct(), "links", folder)
    alone = pairs.where("a = b").select(F.col("a").alias("node"))
    edges = pairs.where("a != b")
    for n in range(rounds):
        if _settled(edges):
            break
        edges = stored(_star(_star(edges, True), False).distinct(), "edges", f"{folder}/{n}")
        if n:
            dropped(spark, f"{folder}/{n - 1}")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = found.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
    found = found.unionByName(roots)
    return found.unionByName(alone.join(found, "node", "left_anti").withColumn("component", F.col("node")))
