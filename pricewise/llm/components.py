"""Connected components of an edge table, by repeated hooking and contraction.

Each round every vertex hooks to its smallest neighbour (or itself), one pointer
jump shortens the chains, and the edges are rewritten between the new labels; a
component's labels at least halve each round. Rounds read stored tables, so both
sides of their joins are plain shuffles that adaptive execution can split when a
vertex holds most edges. Nothing but edge counts reaches the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every end of an edge ``(a, b)``: the label is the same
    within a component (it is one of its nodes). Loops, repeated edges and null
    ends are ignored; without edges the result is empty."""
    links = written(edges.filter("a != b").select("a", "b").distinct())
    maps = []
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = written(both.groupBy("a").agg(F.min("b").alias("_m"))
                      .select(F.col("a").alias("node"), F.least("a", "_m").alias("parent")))
        if hook.isEmpty():
            break
        up = hook.select(F.col("node").alias("parent"), F.col("parent").alias("_p"))
        jump = written(hook.join(up, "parent").select("node", F.col("_p").alias("parent")))
        maps.append(jump)
        to = lambda c: jump.select(F.col("node").alias(c), F.col("parent").alias(f"_{c}"))
        links = written(links.join(to("a"), "a").join(to("b"), "b").filter("_a != _b")
                       .select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0)

    def compose(below: DataFrame, above: DataFrame) -> DataFrame:
        nxt = above.select(F.col("node").alias("label"), F.col("parent").alias("_l"))
        return below.join(nxt, "label", "left").select("node", F.coalesce("_l", "label").alias("label"))
    first = maps[0].select("node", F.col("parent").alias("label"))
    return written(reduce(compose, maps[1:], first))
