"""Connected components of links between ids, by hooking and pointer jumping on DataFrames.

No component, adjacency list or link set is gathered in one task: every step is an aggregation by minimum or a join on
an id, ids with very many links (hubs) meet a broadcast of bounded size, and each round is written out, so that lineage
stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardinal.llm.staging import dropped, heavy_keys, join_split, staged


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for each id in links, staged; component is the smallest id reachable. Null ends are ignored."""
    one = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    both = staged(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    hubs = heavy_keys(both, ["v"])
    labels = staged(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")))
    while True:
        near = join_split(both, labels.select(F.col("u").alias("v"), "c"), ["v"], heavy=hubs).groupBy("u").agg(F.min("c").alias("m"))
        near = staged(labels.join(near, "u"))
        if near.where("m < c").isEmpty():
            dropped(both, near)
            return labels.select(F.col("u").alias("id"), F.col("c").alias("component"))
        # Each id learns its own neighbours' least label, and so does the label that it had (hooking).
        hooks = near.groupBy(F.col("c").alias("u")).agg(F.min("m").alias("k"))
        hooked = staged(near.join(hooks, "u", "left").select("u", F.least("c", "m", F.coalesce("k", "m")).alias("c")))
        dropped(labels, near)
        # Labels that got a smaller one themselves: all that carry them jump there.
        moves = hooked.where("c < u").select(F.col("u").alias("c"), F.col("c").alias("j"))
        moves = staged(moves.join(hooked.select("c").distinct(), "c", "left_semi"))
        if moves.isEmpty():
            labels = hooked
        else:
            labels = staged(join_split(hooked, moves, ["c"], "left").select("u", F.coalesce("j", "c").alias("c")))
            dropped(hooked)
        dropped(moves)
