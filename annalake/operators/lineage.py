"""Impact analysis over a table of (src, dst) edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalake.operators.matching import present_in
from annalake.session import shared_dir
from annalake.sources.sinks import write_once


# Frontiers kept apart before they are merged, which bounds the plan of a round.
MERGE_ROUNDS = 16


def direct_neighbours(edges: DataFrame, node: str, direction: str = "down") -> DataFrame:
    """One hop from a node: what depends on it (down) or what it depends on (up)."""
    near, far = _ends(direction)
    return edges.where(F.col(near) == node).select(F.col(far).alias("node")).distinct()


def _ends(direction: str) -> tuple[str, str]:
    if direction == "down":
        return "src", "dst"
    if direction == "up":
        return "dst", "src"
    raise ValueError("direction must be 'down' or 'up'")


def reachable(edges: DataFrame, seeds: DataFrame, direction: str = "down", max_rounds: int | None = None) -> DataFrame:
    """All further nodes reachable from the seeds as (node, distance); every node
    is visited once, so cycles end.

    Breadth first: each round joins the frontier with the edges, drops what was
    seen and writes the new frontier as a checkpoint, so the plan of a round
    stays short and survives lost executors. Only an emptiness test reaches the
    driver. Rounds equal the depth of the graph, unless ``max_rounds`` asks for
    fewer hops.
    """
    shared_dir(edges.sparkSession)
    near, far = _ends(direction)
    # Every round reads the edges.
    hops = write_once(edges.select(F.col(near).alias("_from"), F.col(far).alias("node")).where("node is not null"))
    frontier = seeds.select("node").distinct().withColumn("distance", F.lit(0)).checkpoint()
    visited = [frontier]
    distance = 0
    while max_rounds is None or distance < max_rounds:
        distance += 1
        step = present_in(hops, frontier.select(F.col("node").alias("_from")), ["_from"]).select("node").distinct()
        seen = reduce(DataFrame.union, [v.select("node") for v in visited])
        frontier = step.join(seen, "node", "left_anti").withColumn("distance", F.lit(distance)).checkpoint()
        if frontier.isEmpty():
            break
        visited.append(frontier)
        if len(visited) == MERGE_ROUNDS:
            visited = [reduce(DataFrame.union, visited).checkpoint()]
    return reduce(DataFrame.union, visited).where("distance > 0")
