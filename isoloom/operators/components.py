"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.shared import discard, materialise

#: Up to so many edges the smallest neighbours are joined as they come; beyond, they are written first.
_FEW = 1 << 20

#: Edges that :func:`local_components` makes stars of at once.
_RUN = 1 << 17


def _large_star(edges: DataFrame, least_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = least_of(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, least_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = least_of(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _is_stars(edges: DataFrame) -> bool:
    """Whether every edge goes from a node with no other edge to a centre."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or (out = 1 and in = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` -> ``(node, component)``: the smallest node reachable, for every node of an edge.

    Both star steps keep the components and only re-hang edges on smaller nodes; the end is reached when all edges
    make stars, one per component. A round is two aggregations and two joins of the edge
    table, whatever the shape of the components. The edges are written before the first round. In graphs of more than a
    million edges the smallest neighbours are written before they are joined: both sides of the join are then plain shuffles, so
    that adaptive execution can split a hub's edges. Each round is written to the shared folder, and a lost
    executor repeats one round at most. Self loops give a node its own component; null ends are dropped.
    """
    written: list[DataFrame] = []
    edges = materialise(edges.select("u", "v").where("u is not null and v is not null"), "graph")
    few = edges.count() <= _FEW

    def least_of(df: DataFrame) -> DataFrame:
        if few:
            return df
        written.append(materialise(df, "least"))
        return written[-1]

    loops = edges.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    now = materialise(_small_star(edges.where("u <> v"), least_of).distinct(), "components")
    while not _is_stars(now):
        large = materialise(_large_star(now, least_of).distinct(), "components")
        after = materialise(_small_star(large, least_of).distinct(), "components")
        for old in (now, large, *written):
            discard(old)
        written.clear()
        now = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return stars.union(centres).union(loops).groupBy("node").agg(F.min("component").alias("component"))


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node to the smallest of its component; one to itself where it is alone."""
    names, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = code[: len(u)], code[len(u) :], np.arange(len(names))
    while ((x := root[a]) != (y := root[b])).any():
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
    far = (root != np.arange(len(names))) | (np.bincount(root, minlength=len(names))[root] == 1)
    return names[far], names[root[far]]


def _runs(batches):
    """Batches of edges (u, v) as stars, ``_RUN`` edges at a time."""
    held, n = [], 0

    def starred() -> pa.RecordBatch:
        u, v = (np.concatenate([x[c].to_numpy(zero_copy_only=False) for x in held]) for c in ("u", "v"))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _stars(u, v)], ["u", "v"])

    for x in batches:
        held.append(x)
        n += x.num_rows
        if n >= _RUN:
            yield starred()
            held, n = [], 0
    if n:
        yield starred()


def local_components(edges: DataFrame) -> DataFrame:
    """:func:`connected_components` of ``edges(u, v)`` of whole numbers, most of which join nodes of near numbers.

    Edges become stars a run at a time, where they are read and again where they are dealt by blocks of numbers. A node that has one star's
    centre as its only neighbour waits for that centre's component; only edges of other nodes, those in which runs meet, go through rounds.
    Edges between far numbers gain nothing and go through all rounds.
    """
    some = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u is not null and v is not null")
    dealt = some.mapInArrow(_runs, "u long, v long").withColumn("block", F.floor(F.col("u") / _RUN))
    dealt = dealt.repartition("block").sortWithinPartitions("block", "u").select("u", "v")
    stars = materialise(dealt.mapInArrow(_runs, "u long, v long"), "stars")
    none = F.lit(None).cast("long")
    ends = stars.select(F.col("u").alias("node"), F.when(F.col("u") != F.col("v"), F.col("v")).alias("to"), F.lit(False).alias("centre"))
    ends = ends.union(stars.where("u <> v").select("v", none, F.lit(True)).distinct())
    ends = ends.groupBy("node").agg(F.min("to").alias("lo"), F.max("to").alias("hi"), F.max("centre").alias("centre"))
    waits = F.col("lo").isNotNull() & (F.col("lo") == F.col("hi")) & ~F.col("centre")
    nodes = materialise(ends.select("node", F.when(waits, F.col("lo")).otherwise(F.col("node")).alias("key"), (F.col("lo").isNotNull() & ~waits).alias("meets")), "nodes")
    meets = nodes.where("meets").select(F.col("node").alias("u"))
    if meets.isEmpty():
        return nodes.select("node", F.col("key").alias("component"))
    core = connected_components(stars.join(meets, "u", "left_semi")).select(F.col("node").alias("key"), "component")
    return nodes.join(core, "key", "left").select("node", F.coalesce("component", "key").alias("component"))
