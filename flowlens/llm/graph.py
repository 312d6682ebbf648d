"""Connected components over an edge table, as DataFrame joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, rows: int | None = None, max_rounds: int = 60) -> DataFrame:
    """Distributed union-find: edges (a long, b long) -> (node, label), one label per component, for each node of an edge between two nodes.

    Each round every node takes the smallest name among itself and its neighbours under an order that a seeded
    bijection shuffles, then the edges are rewritten between the names taken and those inside one name vanish. An order
    serves two rounds: in the second, what is left of a star hangs on its smallest leaf, so that a star takes two rounds;
    a new order then shrinks long paths by a constant factor. The round maps are composed from the last one back.
    `rows`, where given, is the number of edges at most; small tables are then written in few files.
    An empty table gives an empty result; self-loops, repeated edges and null ends are ignored. The label is the name of some
    node of the component, not its smallest. Nothing is collected: only counts reach the driver.
    """
    maps = []
    current = scratch.keep(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), rows)
    for r in range(max_rounds):
        size = current.count()
        if not size:
            break
        salt = F.xxhash64(F.lit(r // 2))
        both = current.select(F.col("a").alias("node"), F.col("b").alias("other")).union(current.select(F.col("b"), F.col("a")))
        # x ^ salt is a bijection of longs, so the smallest can be turned back into the node it names
        taken = both.groupBy("node").agg(F.min(F.least(F.col("node").bitwiseXOR(salt), F.col("other").bitwiseXOR(salt))).bitwiseXOR(salt).alias("label"))
        taken = scratch.keep(taken, 2 * size)
        maps.append((taken, 2 * size))
        ends = current.join(taken.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(taken.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
        following = scratch.keep(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), size)
        scratch.drop(current)
        current = following
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not maps:
        return edges.sparkSession.createDataFrame([], "node long, label long")
    out = maps[-1][0]
    for earlier, rows in reversed(maps[:-1]):
        later = out.select(F.col("node").alias("label"), F.col("label").alias("final"))
        out = scratch.keep(earlier.join(later, "label", "left").select("node", F.coalesce("final", "label").alias("label")), rows)
    return out
