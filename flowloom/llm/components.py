"""Connected components of a link table by repeated contraction, on Spark joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every node of ``links`` (a, b: 64-bit integers); loops and repeats do no harm.

    Each round every node moves to the first of itself and its neighbours in a hashed order, so a constant share
    of the nodes vanishes whatever the shape (a path does not take a round per node), and links are redrawn
    between the nodes that are left. Nothing but the number of remaining links reaches the driver. An empty
    link table gives an empty result.
    """
    links = stage(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while True:
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("x"))
        moves = stage(ends.groupBy("a").agg(F.min(order("b")).alias("to")).select(F.col("a").alias("from"), F.least("to", order("a"))["x"].alias("to")), "moves")
        if labels is None:
            labels = moves.select(F.col("from").alias("node"), F.col("to").alias("root"))
        else:
            labels = stage(labels.join(moves, F.col("root") == F.col("from"), "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        left = moves.select(F.col("from").alias("a"), F.col("to").alias("a2"))
        right = moves.select(F.col("from").alias("b"), F.col("to").alias("b2"))
        redrawn = links.join(left, "a").join(right, "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        links = stage(redrawn.distinct(), "links")
        if links.isEmpty():
            return labels
