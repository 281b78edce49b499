"""Weighted path graphs, all clusters in one job.

``paths(cluster, read, support, pos, node)``: node ids increase strictly along each path.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from isoloom.operators.clusters import _ahead, ranked
from isoloom.operators.components import local_components
from isoloom.shared import discard
from isoloom.shared import spread as materialise

READ = ["cluster", "read"]


def steps(paths: DataFrame) -> DataFrame:
    """One row per step of a read: (cluster, read, support, u, v)."""
    return paths.withColumn("v", F.lead("node").over(W.partitionBy(*READ).orderBy("pos"))).where("v is not null").select("cluster", "read", "support", F.col("node").alias("u"), "v")


def edge_weights(paths: DataFrame) -> DataFrame:
    """(cluster, u, v, weight, n_reads): weight is the sum of the supports of the reads that take the step."""
    return steps(paths).groupBy("cluster", "u", "v").agg(F.sum("support").alias("weight"), F.count("*").alias("n_reads"))


def node_support(paths: DataFrame) -> DataFrame:
    return paths.groupBy("cluster", "node").agg(F.count("*").alias("n_reads"), F.sum("support").alias("support"))


def sources_sinks(edges: DataFrame) -> DataFrame:
    """(cluster, node, is_source, is_sink) of nodes that are one or both."""
    ends = edges.select("cluster", F.col("u").alias("node"), F.lit(1).alias("outs"), F.lit(0).alias("ins")).union(edges.select("cluster", F.col("v"), F.lit(0), F.lit(1)))
    each = ends.groupBy("cluster", "node").agg(F.sum("outs").alias("outs"), F.sum("ins").alias("ins"))
    return each.where("outs = 0 or ins = 0").select("cluster", "node", (F.col("ins") == 0).alias("is_source"), (F.col("outs") == 0).alias("is_sink"))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select("cluster", F.col("u").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("cluster", F.col("v"), F.lit(0), F.lit(1)))
    return ends.groupBy("cluster", "node").agg(F.sum("i").alias("indegree"), F.sum("o").alias("outdegree"))


def edge_log_likelihood(edges: DataFrame) -> DataFrame:
    """-ln of the share of an edge's weight among the edges out of its node."""
    return edges.withColumn("nll", F.lit(0.0) - F.log(F.col("weight") / F.sum("weight").over(W.partitionBy("cluster", "u"))))


def best_successor(edges: DataFrame) -> DataFrame:
    """(cluster, u, v, weight): the heaviest edge out of each node, the smallest node among equals."""
    top = edges.groupBy("cluster", "u").agg(F.min(F.struct((-F.col("weight")).alias("w"), "v")).alias("x"))
    return top.select("cluster", "u", "x.v", (-F.col("x.w")).alias("weight"))


def best_predecessor(edges: DataFrame) -> DataFrame:
    top = edges.groupBy("cluster", "v").agg(F.min(F.struct((-F.col("weight")).alias("w"), "u")).alias("x"))
    return top.select("cluster", "v", "x.u", (-F.col("x.w")).alias("weight"))


def _twice(jump: DataFrame) -> DataFrame:
    """A function (cluster, u, v) applied twice."""
    return materialise(jump.alias("a").join(jump.alias("b"), F.expr("a.cluster = b.cluster and a.v = b.u")).select("a.cluster", "a.u", "b.v"), "jump")


def reach(following: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(cluster, source, node, step): what each start reaches along a function (cluster, u, v), by doubling.

    Known prefixes of the walks double in each round, so the rounds are the logarithm of the longest walk, or of
    ``most`` steps. A round writes what it adds. No walk may run into a circle.
    """
    jump = materialise(following.select("cluster", "u", "v"), "jump")
    parts = [materialise(starts.select("cluster", F.col("node").alias("source"), "node", F.lit(0).cast("long").alias("step")), "reach")]
    length = 1
    while most is None or length <= most:
        known = reduce(DataFrame.union, parts)
        more = known.join(jump, (known.cluster == jump.cluster) & (known.node == jump.u)).select(known.cluster, "source", F.col("v").alias("node"), (F.col("step") + length).alias("step"))
        more = materialise(more if most is None else more.where(F.col("step") <= most), "reach")
        if more.isEmpty():
            break
        parts.append(more)
        jump, old, length = _twice(jump), jump, length * 2
        discard(old)
    return reduce(DataFrame.union, parts)


def owners(following: DataFrame, starts: DataFrame) -> DataFrame:
    """(cluster, node, owner): the smallest of ``starts(cluster, node)`` from which the function (cluster, u, v) leads to
    the node. One row per node and round, however many starts lead there."""
    jump = materialise(following.select("cluster", "u", "v"), "jump")
    now = materialise(starts.select("cluster", "node", F.col("node").alias("owner")), "owners")
    while not jump.isEmpty():
        pushed = now.join(jump, (now.cluster == jump.cluster) & (now.node == jump.u)).select(now.cluster, F.col("v").alias("node"), "owner")
        after = materialise(now.union(pushed).groupBy("cluster", "node").agg(F.min("owner").alias("owner")), "owners")
        twice = _twice(jump)
        discard(now)
        discard(jump)
        now, jump = after, twice
    return now


def _exits(lines: pa.Table) -> pa.Table:
    """(cluster, u, v): the first node outside of a block that each node asked for leads to, if any."""
    then = {u: v for u, v in zip(lines["node"].to_pylist(), lines["v"].to_pylist(), strict=True) if v is not None}
    inside, end = set(lines["node"].to_pylist()) | {v for v in then.values() if v // lines["width"][0].as_py() == lines["block"][0].as_py()}, {}
    asked = [u for u, v in zip(lines["node"].to_pylist(), lines["v"].to_pylist(), strict=True) if v is None]
    for u in asked:
        trail = []
        while u in then and u not in end:
            trail.append(u)
            u = then[u]
        end |= dict.fromkeys(trail, end.get(u, u))
    found = [(u, end[u]) for u in asked if end.get(u, u) not in inside]
    head = lines.select(["cluster"]).take(pa.array([0] * len(found), pa.int64()))
    return pa.table([head["cluster"], *(pa.array([x[k] for x in found], pa.int64()) for k in (0, 1))], names=["cluster", "u", "v"])


def _claims(lines: pa.Table) -> pa.Table:
    """(cluster, block, source, k, node): the nodes of a block by the smallest owner that leads to them, in the order in which it meets them."""
    node, v, owner = (lines[c].to_pylist() for c in ("node", "v", "owner"))
    then = {a: b for a, b in zip(node, v, strict=True) if b is not None}
    here, got, turn = set(node) | {b for b in then.values() if b // lines["width"][0].as_py() == lines["block"][0].as_py()}, {}, Counter()
    for o, a in sorted((o, a) for o, a in zip(owner, node, strict=True) if o is not None):
        while a in here and a not in got:
            got[a] = (o, turn[o])
            turn[o] += 1
            a = then.get(a)
    head = lines.select(["cluster", "block"]).take(pa.array([0] * len(got), pa.int64()))
    columns = [pa.array([x[k] for x in got.values()], pa.int64()) for k in (0, 1)]
    return pa.table([*head.columns, *columns, pa.array(got, pa.int64())], names=["cluster", "block", "source", "k", "node"])


def _owned(following: DataFrame, starts: DataFrame, block: int) -> DataFrame:
    """(cluster, source, step, node): what each start owns along a function (cluster, u, v), in walk order; see :func:`walks_from`.

    Nodes are cut into blocks of ``block`` numbers. Between blocks only the nodes count where walks come in: owners of these are
    told by :func:`owners`, in rounds that are the logarithm of the blocks, and the rest inside each block.
    """
    cluster, number = following.schema["cluster"], starts.schema["node"].dataType
    at = lambda c: F.floor(F.col(c) / block)
    none, width = F.lit(None).cast("long"), F.lit(block).cast("long").alias("width")
    lines = following.select("cluster", at("u").alias("block"), F.col("u").cast("long").alias("node"), F.col("v").cast("long").alias("v"), width)
    cross = materialise(following.where(at("u") != at("v")).select("cluster", at("u").alias("block"), "v"), "crossing")
    asked = starts.select("cluster", "node").union(cross.select("cluster", "v")).distinct()
    asked = lines.union(asked.select("cluster", at("node"), F.col("node").cast("long"), none, width))
    asked = asked.join(cross.select("cluster", "block").distinct(), ["cluster", "block"], "left_semi").select("cluster", "block", "node", "v", "width")
    hops = asked.groupBy("cluster", "block").applyInArrow(_exits, StructType([cluster]).add("u", "long").add("v", "long"))
    told = owners(hops, starts.select("cluster", F.col("node").cast("long").alias("node")))
    lines = lines.withColumn("owner", none).union(told.select("cluster", at("node"), "node", none, width, "owner"))
    claims = lines.groupBy("cluster", "block").applyInArrow(_claims, StructType([cluster]).add("block", "long").add("source", "long").add("k", "long").add("node", "long"))
    placed = _ahead(materialise(claims, "claims").select("cluster", "source", "k", "node", "block"), ["cluster", "source"], F.col("block"), {"n_before": F.count("*")})
    return placed.select("cluster", F.col("source").cast(number).alias("source"), (F.col("k") + F.col("n_before")).alias("step"), F.col("node").cast(number).alias("node"))


def walks_from(edges: DataFrame, starts: DataFrame, tail: int = 15, block: int = 1 << 12) -> DataFrame:
    """(cluster, source, step, node): heaviest walks along ``edges(cluster, u, v, weight)`` from ``starts(cluster, node)``, in ascending order.

    A walk that meets a node of an earlier one takes it and up to ``tail`` more, and ends. Successors
    are a function, so walks that meet stay together and the walk that owns a node is the smallest source that
    reaches it. A start on an earlier walk begins no walk. A walk is what its source owns, which no other
    walk has, and the steps beyond, which are pieces of the walks that it meets: rows grow with the nodes, not with sources times nodes.
    """
    starts = materialise(starts, "starts")
    following = materialise(best_successor(edges).select("cluster", "u", "v"), "following")
    owned = materialise(_owned(following, starts, block), "owned")
    last = owned.groupBy("cluster", "source").agg((F.max("step") + 1).alias("size"), F.max_by("node", "step").alias("u"))
    last = materialise(last, "last")
    joint = last.join(following, ["cluster", "u"]).select("cluster", "source", F.col("v").alias("node"))
    joint = joint.join(owned.select("cluster", "node", F.col("source").alias("to"), F.col("step").alias("first")), ["cluster", "node"])
    size = last.select("cluster", F.col("source").alias("to"), F.col("size").alias("of"))
    joint = materialise(joint.join(size, ["cluster", "to"]).select("cluster", "source", "to", "first", (F.col("of") - F.col("first")).alias("n")), "joints")
    # Pieces that a walk takes of others: from the place where it meets the next one, and so on from that one's end.
    now = joint.join(last.select("cluster", "source", "size"), ["cluster", "source"]).select("cluster", "source", "to", "first", "n", F.col("size").alias("step"), F.lit(tail + 1).cast("long").alias("left"))
    parts = []
    while parts == [] or not parts[-1].isEmpty():
        parts.append(materialise(now, "pieces"))
        on = joint.select("cluster", F.col("source").alias("to"), F.col("to").alias("next"), F.col("first").alias("begin"), F.col("n").alias("more"))
        now = parts[-1].where("left > n").join(on, ["cluster", "to"])
        now = now.select("cluster", "source", F.col("next").alias("to"), F.col("begin").alias("first"), F.col("more").alias("n"), (F.col("step") + F.col("n")).alias("step"), (F.col("left") - F.col("n")).alias("left"))
    each = reduce(DataFrame.union, parts).where("left > 0").select("cluster", "source", "to", "step", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.least("n", "left") - 1)).alias("k"))
    nodes = owned.select("cluster", F.col("source").alias("to"), F.col("step").alias("at"), "node")
    after = each.withColumn("at", F.col("first") + F.col("k")).join(nodes, ["cluster", "to", "at"]).select("cluster", "source", (F.col("step") + F.col("k")).alias("step"), "node")
    return owned.select("cluster", "source", "step", "node").union(after)


def greedy_walks(paths: DataFrame, tail: int = 15) -> DataFrame:
    """(cluster, source, step, node): :func:`walks_from` the distinct first nodes of the reads of ``paths``, along their edges."""
    starts = paths.groupBy(*READ).agg(F.min("node").alias("node")).select("cluster", "node").distinct()
    return walks_from(edge_weights(paths), starts, tail)


def align_paths(paths: DataFrame, walk: DataFrame) -> DataFrame:
    """Every read of ``paths`` merged with its cluster's ``walk(cluster, node)`` in node order: (cluster, read, node, op).

    op is M for nodes of both, I for the read's alone, D for the walk's alone. All walk nodes are listed for all reads, which is the
    result; what only needs their number takes ranks on the walk, see :func:`walk_ranks`.
    """
    wanted = paths.select(*READ).distinct().join(walk.select("cluster", "node").hint("merge"), "cluster")
    both = paths.select(*READ, "node", F.lit(1).alias("p"), F.lit(0).alias("w")).union(wanted.select(*READ, "node", F.lit(0), F.lit(1)))
    each = both.groupBy(*READ, "node").agg(F.max("p").alias("p"), F.max("w").alias("w"))
    return each.select(*READ, "node", F.when((F.col("p") == 1) & (F.col("w") == 1), "M").when(F.col("p") == 1, "I").otherwise("D").alias("op"))


def walk_ranks(walk: DataFrame, key: str = "cluster") -> DataFrame:
    """(cluster, node, rank): the nodes of each walk numbered along it. Two nodes with ranks p < q have q - p - 1 between them."""
    return walk.select(key, "node").distinct().withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("node")))


def correct_paths(paths: DataFrame, walk: DataFrame, psi: int = 35, correct_ends: bool = False, detect_ends: bool = True) -> tuple[DataFrame, DataFrame]:
    """(paths, flags): small differences of each read to the walk are taken back; flags(cluster, read, differs).

    Islands are the rows between matches. Inside: fewer than ``psi`` nodes of the read alone are dropped, more
    raise the flag and stay, and the walk's nodes are then ignored; otherwise fewer than ``psi`` of the
    walk's alone are added, more raise the flag. Before the first and after the last match the walk's nodes are
    ignored; with ``detect_ends`` or ``correct_ends`` a run of ``psi`` or more raises the flag, and only
    ``correct_ends`` drops a shorter one. Walk nodes between matches are counted by their ranks; only those that are added become rows.
    """
    w = W.partitionBy(*READ)
    ranks = materialise(walk_ranks(walk), "ranks")
    rows = paths.select(*READ, "support", "node").join(ranks, ["cluster", "node"], "left").withColumn("match", F.col("rank").isNotNull().cast("int"))
    ahead = F.last("rank", ignorenulls=True).over(w.orderBy(F.col("node").desc()).rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("next", F.when(F.col("match") == 1, ahead))
    rows = rows.withColumn("island", F.sum("match").over(w.orderBy("node").rowsBetween(W.unboundedPreceding, W.currentRow)))
    isle = W.partitionBy(*READ, "island")
    rows = rows.withColumn("ins", F.sum(1 - F.col("match")).over(isle)).withColumn("dels", F.max(F.col("next") - F.col("rank") - 1).over(isle))
    inner = F.col("dels").isNotNull()
    large_ins, large_del = F.col("ins") >= psi, (F.col("dels") >= psi) & (F.col("ins") < psi)
    rows = rows.withColumn("differs", F.when(inner, large_ins | large_del).otherwise(F.lit(detect_ends or correct_ends) & large_ins))
    rows = materialise(rows, "islands")
    flags = rows.groupBy(*READ).agg(F.bool_or("differs").alias("differs"))
    kept = rows.where((F.col("match") == 1) | large_ins | (~inner & F.lit(not correct_ends))).select(*READ, "support", "node")
    gaps = rows.where((F.col("match") == 1) & (F.col("dels") > 0) & (F.col("dels") < psi) & ~large_ins)
    gaps = gaps.select(*READ, "support", F.explode(F.sequence(F.col("rank") + 1, F.col("next") - 1)).alias("rank"))
    added = gaps.join(ranks, ["cluster", "rank"]).select(*READ, "support", "node")
    out = kept.union(added).withColumn("pos", F.row_number().over(w.orderBy("node")))
    return out.select("cluster", "read", "support", "pos", "node"), flags


def sum_support(groups: DataFrame, key: str = "cluster") -> DataFrame:
    """The support of each group: the sum over the reads that it accounts for."""
    return groups.groupBy(key).agg(F.sum("support").alias("support"))


def heaviest_path(paths: DataFrame) -> DataFrame:
    """(cluster, node): from the most supported node of each cluster along heaviest edges both ways."""
    edges = materialise(edge_weights(paths), "edges")
    top = node_support(paths).groupBy("cluster").agg(F.max(F.struct("support", (-F.col("node")).alias("node"))).alias("x")).select("cluster", (-F.col("x.node")).alias("node"))
    on = reach(best_successor(edges), top).select("cluster", "node")
    back = reach(best_predecessor(edges).select("cluster", F.col("v").alias("u"), F.col("u").alias("v")), top).select("cluster", "node")
    return on.union(back).distinct()


def compatible_reads(paths: DataFrame, walk: DataFrame, ends_delta: int = 35) -> DataFrame:
    """(cluster, read, support): reads that, but for ``ends_delta`` nodes at either end, equal the walk over their span.

    Reads of at most twice ``ends_delta`` nodes have nothing to compare and are compatible. A read equals the walk where all its nodes are on it
    and their ranks have no gap.
    """
    n = F.count("*").over(W.partitionBy(*READ))
    middle = (F.col("pos") > ends_delta) & (F.col("pos") <= F.col("n") - ends_delta)
    rows = paths.withColumn("n", n).join(walk_ranks(walk).hint("merge"), ["cluster", "node"], "left")
    told = rows.groupBy(*READ).agg(
        F.max("support").alias("support"), F.count_if(middle).alias("n_read"), F.count_if(middle & F.col("rank").isNotNull()).alias("n_both"),
        (F.max(F.when(middle, F.col("rank"))) - F.min(F.when(middle, F.col("rank"))) + 1).alias("n_walk"),
    )
    return told.where("n_read = 0 or (n_read = n_both and n_read = n_walk)").select(*READ, "support")


def path_sequence(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cluster, read, seq): the letters of ``nodes(cluster, node, nts)`` in path order."""
    letters = paths.join(nodes, ["cluster", "node"])
    return letters.groupBy(*READ).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "nts"))), lambda x: x["nts"]), "").alias("seq"))


def _chains(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cluster, source, node, step): every node with the head of its maximal run of nodes with one way on and one way in."""
    d = materialise(degrees(edges), "degrees")
    outs, ins = d.where("outdegree = 1").select("cluster", F.col("node").alias("u")), d.where("indegree = 1").select("cluster", F.col("node").alias("v"))
    link = materialise(edges.select("cluster", "u", "v").join(outs, ["cluster", "u"], "left_semi").join(ins, ["cluster", "v"], "left_semi"), "link")
    heads = nodes.select("cluster", "node").join(link.select("cluster", F.col("v").alias("node")), ["cluster", "node"], "left_anti")
    return reach(link, heads)


def _roots(single: DataFrame, most: int) -> DataFrame:
    """(cluster, node, to, far) of a function (cluster, node, to, far), followed until it ends, by doubling; ``far`` adds up."""
    now, known = materialise(single, "roots"), 1
    while True:
        on = now.select("cluster", F.col("node").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"))
        after = materialise(now.join(on, ["cluster", "to"], "left"), "roots")
        if after.where("next is not null").isEmpty():
            discard(after)
            return now
        if known > most:
            raise ValueError("the graph has a circle")
        discard(now)
        now = materialise(after.select("cluster", "node", F.coalesce("next", "to").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far")), "roots")
        discard(after)
        known *= 2


def _layered(lines: pa.Table) -> pa.Table:
    """(cluster, node, layer): the nodes of a block by the longest way from those that are known; null in a circle and behind one.

    Lines are edges (u, v, far) inside the block and, where u is null, layers that a node has at least.
    """
    layer, on, waits = {}, {}, Counter()
    for u, v, far in zip(*(lines[c].to_pylist() for c in ("u", "v", "far")), strict=True):
        if u is None:
            layer[v] = max(layer.get(v, 0), far)
        else:
            on.setdefault(u, []).append((v, far))
            waits[v] += 1
    nodes = list(dict.fromkeys([*layer, *on, *waits]))
    ready = [x for x in nodes if not waits[x]]
    while ready:
        u = ready.pop()
        for v, far in on.get(u, ()):
            layer[v] = max(layer.get(v, 0), layer.get(u, 0) + far)
            waits[v] -= 1
            if not waits[v]:
                ready.append(v)
    head = lines.select(["cluster"]).take(pa.array([0] * len(nodes), pa.int64()))
    told = pa.array([None if waits[x] else layer.get(x, 0) for x in nodes], pa.int64())
    return pa.table([*head.columns, pa.array(nodes, lines["v"].type), told], names=["cluster", "node", "layer"])


def topological_layers(edges: DataFrame, block: int = 1 << 11) -> DataFrame:
    """(cluster, node, layer): longest distance from a source.

    Nodes are cut into blocks of ``block`` numbers, and layers are told inside each block; a cluster of one block is done with this. In others
    what crosses blocks is told again until it doesn't change: rounds are the blocks on a way, not its nodes. To make these ways
    short, a node with one way in lies that far behind the node where it begins, so trees of such nodes are taken out first, by doubling, and the
    ways on from them go on from their roots. Of ways between the same two nodes the longest counts, which makes new nodes with one way in: runs,
    bubbles, and bubbles of bubbles vanish in a round each. A cluster is done with this when a third of its nodes or less would go. In
    the end all nodes taken out get their layers, last round first. A graph with a circle is an error.
    """
    at = lambda c: F.floor(F.col(c) / block)
    schema = StructType([edges.schema["cluster"]]).add("node", edges.schema["u"].dataType).add("layer", "long")

    def told(hops: DataFrame, known: DataFrame | None = None) -> DataFrame:
        lines = hops.where(at("u") == at("v")).select("cluster", at("u").alias("block"), "u", "v", "far")
        if known is not None:
            lines = lines.union(known.select("cluster", at("node"), F.lit(None).cast(schema["node"].dataType), "node", "layer"))
        return lines.groupBy("cluster", "block").applyInArrow(_layered, schema)

    def written(layers: DataFrame) -> DataFrame:
        layers = materialise(layers, "layers")
        if not layers.where("layer is null").isEmpty():
            raise ValueError("the graph has a circle")
        return layers

    hops = materialise(edges.select("cluster", "u", "v").distinct().withColumn("far", F.lit(1).cast("long")), "hops")
    wide = materialise(hops.where(at("u") != at("v")).select("cluster").distinct(), "wide")
    flat = lambda layers: layers.select("cluster", "node", F.col("layer").cast("int").alias("layer"))
    if wide.isEmpty():
        return flat(written(told(hops)))
    narrow = written(told(hops.join(wide, "cluster", "left_anti")))
    after = materialise(hops.join(wide, "cluster", "left_semi"), "hops")
    discard(hops)
    hops = after
    nodes = materialise(hops.select("cluster", F.col("u").alias("node")).union(hops.select("cluster", "v")).distinct(), "nodes")
    sizes = nodes.groupBy("cluster").agg(F.count("*").alias("size"))
    most, left, undo = nodes.count(), nodes, []
    while True:
        single = hops.groupBy("cluster", "v").agg(F.count("*").alias("n"), F.min("u").alias("to"), F.max("far").alias("far")).where("n = 1")
        single = materialise(single.select("cluster", F.col("v").alias("node"), "to", "far"), "single")
        share = single.groupBy("cluster").agg(F.count("*").alias("n")).join(left.groupBy("cluster").agg(F.count("*").alias("of")), "cluster").where("n * 3 > of")
        single = materialise(single.join(share.select("cluster"), "cluster", "left_semi"), "single")
        if not hops.where("u = v").isEmpty():
            raise ValueError("the graph has a circle")
        if single.isEmpty():
            break
        roots = _roots(single, most)
        undo.append(roots)
        of = roots.select("cluster", F.col("node").alias("u"), F.col("to").alias("root"), F.col("far").alias("more"))
        kept = hops.join(single.select("cluster", F.col("node").alias("v")), ["cluster", "v"], "left_anti").join(of, ["cluster", "u"], "left")
        moved = kept.select("cluster", F.coalesce("root", "u").alias("u"), "v", (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"))
        after = materialise(moved.groupBy("cluster", "u", "v").agg(F.max("far").alias("far")), "hops")
        left = materialise(left.join(single, ["cluster", "node"], "left_anti"), "left")
        discard(hops)
        hops = after
    cross = materialise(hops.where(at("u") != at("v")), "crossing")
    starts = left.withColumn("layer", F.lit(0).cast("long"))
    known, entries, total, rounds = starts, None, -1, 0
    while not cross.isEmpty():
        # Layers only grow, so their sum tells a fixed point; in a circle they outgrow the number of nodes.
        more = told(hops, known).where("layer is not null").withColumnRenamed("node", "u").join(cross, ["cluster", "u"])
        after = materialise(more.groupBy("cluster", F.col("v").alias("node")).agg(F.max(F.col("layer") + F.col("far")).alias("layer")), "layers")
        if entries is not None:
            discard(entries)
        entries, before, total, rounds = after, total, after.agg(F.sum("layer")).first()[0], rounds + 1
        known = starts.union(entries)
        if total == before:
            break
        if rounds & rounds - 1 == 0 and not entries.join(sizes, "cluster").where("layer >= size").isEmpty():
            raise ValueError("the graph has a circle")
    now = written(told(hops, known))
    for roots in reversed(undo):
        behind = roots.join(now.select("cluster", F.col("node").alias("to"), "layer"), ["cluster", "to"])
        now = materialise(now.union(behind.select("cluster", "node", (F.col("layer") + F.col("far")).alias("layer"))), "layers")
    return flat(narrow.union(now))


def compact_chains(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cluster, head, nts, n): maximal runs where out-degree and in-degree are 1, letters joined in order."""
    letters = _chains(edges, nodes).join(nodes, ["cluster", "node"]).groupBy("cluster", F.col("source").alias("head"))
    return letters.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "nts"))), lambda x: x["nts"]), "").alias("nts"), F.count("*").alias("n"))


def select_paths(paths: DataFrame, reads: DataFrame, keep: bool = True) -> DataFrame:
    """Only the listed reads, or all others, with the nodes that are left renumbered from 0 in each cluster."""
    some = paths.join(reads, READ, "left_semi" if keep else "left_anti")
    return some.join(_numbers(some), ["cluster", "node"]).select("cluster", "read", "support", "pos", F.col("new").alias("node"))


def _numbers(paths: DataFrame) -> DataFrame:
    """(cluster, node, new): the nodes of each cluster from 0 in order, over bins of node numbers."""
    left = paths.select("cluster", "node").distinct()
    return ranked(left, ["cluster"], ["node"], F.floor(F.col("node") / (1 << 14))).select("cluster", "node", (F.col("rank") - 1).alias("new"))


def select_links(paths: DataFrame, reads: DataFrame, keep_foreign: bool = False) -> DataFrame:
    """(cluster, u, v, weight, n_reads): the edges of :func:`select_paths`, in its numbers.

    With ``keep_foreign`` the edges between nodes that are left stay even where only reads that are gone take them.
    """
    some = paths.join(reads, READ, "left_semi")
    new, edges = _numbers(some), edge_weights(paths if keep_foreign else some)
    name = lambda c: new.select("cluster", F.col("node").alias(c), F.col("new").alias(f"new_{c}"))
    return edges.join(name("u"), ["cluster", "u"]).join(name("v"), ["cluster", "v"]).select("cluster", F.col("new_u").alias("u"), F.col("new_v").alias("v"), "weight", "n_reads")


def alignment_columns(rings: DataFrame) -> DataFrame:
    """``rings(a, b)`` pairs of aligned nodes -> (node, column_id): the smallest node of the ring."""
    return local_components(rings.select(F.col("a").alias("u"), F.col("b").alias("v"))).select("node", F.col("component").alias("column_id"))


def gapped_rows(paths: DataFrame, letter, columns: DataFrame) -> DataFrame:
    """(cluster, read, row): one letter per column of the cluster, ``-`` where the read has none.

    ``columns(cluster, node, column)`` gives each node its ring; a column is there if any node of it is, in order of
    ``column``. A read has one node of a ring at most. Columns are numbered once and gaps filled by their width, so rows are those of reads.
    """
    w = W.partitionBy("cluster")
    ranks = columns.select("cluster", "column").distinct().withColumn("rank", F.row_number().over(w.orderBy("column"))).withColumn("width", F.count("*").over(w))
    ranks = materialise(ranks, "columns")
    placed = columns.select("cluster", "node", "column").join(ranks.drop("width"), ["cluster", "column"]).select("cluster", "node", "rank")
    there = paths.select(*READ, "node", letter.alias("nts")).join(placed, ["cluster", "node"], "left")
    rows = there.groupBy(*READ).agg(F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "nts")))).alias("x"))
    rows = rows.join(ranks.select("cluster", "width").distinct(), "cluster")
    before = lambda i: F.coalesce(F.get("x", i - 1)["rank"], F.lit(0))
    parts = F.transform("x", lambda c, i: F.concat(F.repeat(F.lit("-"), c["rank"] - before(i) - 1), c["nts"]))
    last = F.coalesce(F.get("x", F.size("x") - 1)["rank"], F.lit(0))
    return rows.select(*READ, F.concat(F.array_join(parts, ""), F.repeat(F.lit("-"), (F.col("width") - last).cast("int"))).alias("row"))


def linear_graph(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of ``records(ref, seq)``: a node per base (ref, node, nts), and (ref, u, v, weight) of weight 1 between
    neighbours. The record's path is its nodes in order."""
    nodes = records.select("ref", F.posexplode(F.split("seq", "")).alias("node", "nts")).where("nts <> ''")
    n = F.length("seq")
    edges = records.where(n > 1).select("ref", F.explode(F.sequence(F.lit(0), n - 2)).alias("u")).select("ref", "u", (F.col("u") + 1).alias("v"), F.lit(1).cast("long").alias("weight"))
    return nodes, edges


def consensus_graph(paths: DataFrame, rings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the graph that the chosen paths induce, each of them counting once.

    edges(cluster, u, v, weight, n_reads, nll); nodes(cluster, node, new, indegree, outdegree, partner): ``new`` numbers them in
    order, partner is their ring partner of ``rings(cluster, node, partner)``, null where that isn't in the graph.
    """
    edges = edge_log_likelihood(edge_weights(paths.withColumn("support", F.lit(1))))
    nodes = _numbers(paths).join(degrees(edges), ["cluster", "node"], "left").select("cluster", "node", "new", F.coalesce("indegree", F.lit(0)).alias("indegree"), F.coalesce("outdegree", F.lit(0)).alias("outdegree"))
    if rings is None:
        return nodes.withColumn("partner", F.lit(None).cast("long")), edges
    left = rings.join(nodes.select("cluster", F.col("node").alias("partner")), ["cluster", "partner"], "left_semi").select("cluster", "node", "partner")
    return nodes.join(left, ["cluster", "node"], "left").select("cluster", "node", "new", "indegree", "outdegree", "partner"), edges
