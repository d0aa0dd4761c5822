"""Connected components of an edge table, without bringing any of it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from .runtime import join_counted, materialize, release

#: Edges a task works on, at least, while an edge table is small.
TASK_EDGES = 16_384


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b), longs; the component is its smallest node.

    Alternates large-star and small-star steps, each a pre-aggregated minimum and a join
    that keeps a star's many edges out of any one task, until all components are stars; every round is
    written to the shared folder. Null ends, loops and repeated edges are allowed and link nothing more. No edges, no rows.
    """
    stars = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    count = stars.count()
    small = count * 2 * 64 <= runtime.BROADCAST_BYTES  # there are at most two nodes an edge, and rounds add no edges
    # A small table's rounds take few tasks, however many partitions the session's shuffles have.
    tasks = max(8, count // TASK_EDGES) if small else None
    while not _all_stars(stars, tasks):
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large, least = _with_least(both, tasks)
        large = large.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = _in_tasks(large.distinct(), tasks)
        if not small:
            large = materialize(large, "large-stars")
        joined, low = _with_least(large, tasks)
        joined = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = joined.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        after = materialize(_in_tasks(after, tasks), "stars")
        release(stars, large, least, low)
        stars = after
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _in_tasks(df: DataFrame, tasks: int | None) -> DataFrame:
    return df.coalesce(tasks) if tasks else df


def _with_least(edges: DataFrame, tasks: int | None) -> tuple[DataFrame, DataFrame]:
    """The edges with m, the smallest b of their a; and that table (a, m, rows)."""
    least = _in_tasks(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("rows")), tasks)
    if tasks:
        return edges.join(F.broadcast(least.drop("rows")), "a"), least
    least = materialize(least, "least")
    return join_counted(edges, least, ["a"]), least


def _all_stars(edges: DataFrame, tasks: int | None) -> bool:
    """Whether each larger end has one edge only and is nobody's smaller end."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    odd = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1")
    return _in_tasks(odd, tasks).isEmpty()
