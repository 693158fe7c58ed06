"""Connected components of a graph given as edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the edges (a, b), longs; root: the smallest node of its component.

    Each round joins every node's larger neighbours to its smallest neighbour, then its smaller ones, until
    nothing changes: a number of rounds that grows with the logarithm of a component's width. Edges live in
    written tables; nothing is collected. A hub's neighbours are never gathered: its smallest neighbour is an
    aggregate, and edges are handled one by one. Empty: no row.
    """
    now = common.written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components"
    )
    marks = None
    for _ in range(rounds):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A written table on both sides lets adaptive execution split a hub's rows, or broadcast what is small.
        spent = [now, common.written(both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w")), "components-low")]
        large = both.join(spent[1], "u").where("v > u").select(F.col("v").alias("u"), F.col("w").alias("v")).where("u <> v").distinct()
        held = common.written(large, "components-large")
        low = common.written(held.groupBy("u").agg(F.min("v").alias("w")), "components-low")
        spent += [held, low]
        small = held.join(low, "u").select("u", "v", "w")
        pairs = small.select(F.explode(F.array(F.struct("u", F.col("w").alias("v")), F.struct(F.col("v").alias("u"), F.col("w").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = common.written(pairs, "components-small")
        common.discard(*spent)
        was, marks = marks, tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if was == marks:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
