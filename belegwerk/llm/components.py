"""Connected components of an edge table: every vertex gets its smallest reachable id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, label: str = "components", rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of longs, either direction, repeats allowed -> ``(id, component)``.

    Hook and shortcut: each round a vertex and its parent take the smallest grandparent seen
    over the vertex's edges, then paths halve. All steps are joins and minima that combine
    before the shuffle; each round is written to the shared folder. Nulls link nothing.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = written(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-edges")
    tree = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("up")), f"{label}-0")
    for i in range(1, rounds + 1):
        grand = tree.alias("t").join(tree.select(F.col("id").alias("up"), F.col("up").alias("top")), "up", "left").select(
            "id", "up", F.coalesce("top", "up").alias("top")
        )
        grand = written(grand, f"{label}-{i}g")
        seen = both.join(grand.select(F.col("id").alias("b"), "top"), "b").groupBy(F.col("a").alias("id")).agg(F.min("top").alias("low"))
        hooked = grand.join(seen, "id", "left").select("id", "up", "top", F.least("top", F.coalesce("low", "top")).alias("low"))
        moves = hooked.select("id", F.col("low").alias("up")).union(hooked.select(F.col("up").alias("id"), F.col("low").alias("up")))
        tree = written(moves.groupBy("id").agg(F.min("up").alias("up")), f"{label}-{i}")
        moved = tree.join(grand.select("id", F.col("up").alias("was"), "top"), "id").where("up <> was or up <> top").limit(1).count()
        if not moved:
            return tree.select("id", F.col("up").alias("component"))
    raise RuntimeError("components did not settle")
