"""Short-read pileups on backbones, polishing and the per-cluster fixed point.

``aln(rid, ref, start, cigar, seq)`` with =, X, I, D and S operations (0-based start). A read is one row until its bases are
needed: operations are placed, trimmed, dropped and named inside the row. CIGAR strings are parsed a batch at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from isoloom.functions import sequences as S
from isoloom.operators import decompose as D
from isoloom.operators import paths as P
from isoloom.operators.transcripts import latest_version
from isoloom.shared import discard
from isoloom.shared import spread as materialise

_ON_REF, _ON_READ = ("=", "X", "D"), ("=", "X", "I", "S")
READ = ["rid", "ref", "start"]


_LETTERS = np.isin(np.arange(256), list(b"MIDNSHP=X"))


def _placed(cigar: pa.Array, start: pa.Array) -> pa.ListArray:
    """The operations of a batch of CIGAR strings, parsed as one run of bytes; see :func:`aligned_ops`."""
    text = pc.fill_null(cigar, "").cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    row, digit = np.repeat(np.arange(len(text)), np.diff(offsets)), (data >= 48) & (data <= 57)
    end = np.flatnonzero(_LETTERS[data[1:]] & digit[:-1] & (row[1:] == row[:-1])) + 1
    n, live, k = np.zeros(len(end), np.int64), np.arange(len(end)), 1
    while len(live):  # the k-th digits before the letters
        n[live] += (data[end[live] - k].astype(np.int64) - 48) * 10 ** (k - 1)
        k += 1
        live = live[end[live] - k >= offsets[row[end[live]]]]
        live = live[digit[end[live] - k]]
    end, n = end[n > 0], n[n > 0]
    of, op = row[end], data[end]
    first = np.r_[0, np.cumsum(np.bincount(of, minlength=len(text)))]

    def places(kinds: tuple[str, ...]) -> np.ndarray:
        """By how much the operations before it in its row advance."""
        total = np.r_[0, np.cumsum(np.where(np.isin(op, [ord(x) for x in kinds]), n, 0))]
        return total[:-1] - total[first[of]]

    r = pa.array(places(_ON_REF) + pc.fill_null(start, 0).to_numpy(zero_copy_only=False)[of].astype(np.int64), mask=start.is_null().to_numpy(zero_copy_only=False)[of])
    letters = pa.StringArray.from_buffers(len(op), pa.py_buffer(np.arange(len(op) + 1, dtype=np.int32)), pa.py_buffer(op.tobytes()))
    i = pa.array(np.arange(len(op)) - first[of], pa.int32())
    values = pa.StructArray.from_arrays([i, letters, pa.array(n, pa.int32()), r, pa.array(places(_ON_READ))], ["i", "op", "n", "r", "q"])
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), values, mask=cigar.is_null())


def aligned_ops(aln: DataFrame) -> DataFrame:
    """(rid, ref, start, seq, ops): operations as structs (i, op, n, r, q), with the offsets on reference and read where
    they begin. M is no valid operation here."""
    reads = aln.select("rid", "ref", "start", "seq", "cigar")
    ops = "array<struct<i:int,op:string,n:int,r:bigint,q:bigint>>"

    def run(batches):
        for x in batches:
            yield pa.RecordBatch.from_arrays([*x.columns[:4], _placed(x["cigar"], x["start"])], ["rid", "ref", "start", "seq", "ops"])

    return reads.mapInArrow(run, StructType([*reads.schema.fields[:4], StructField("ops", DataType.fromDDL(ops))]))


def by_place(aln: DataFrame, block: int = 1 << 12) -> DataFrame:
    """``aln`` dealt by reference and block of ``block`` positions: reads of one place meet in a task, which counts their steps before these are
    shuffled. A read is one small row, its steps are many. Adaptive execution splits places with very many reads; what is counted is summed up after.
    """
    return aln.select("rid", "ref", "start", "cigar", "seq", F.floor(F.col("start") / block).alias("block")).hint("rebalance", "ref", "block").drop("block")


def trim_to_matches(reads: DataFrame) -> DataFrame:
    """Operations from the first to the last = of each read of :func:`aligned_ops`; reads without any have none left."""
    reads = S.once(reads, matches=F.transform(F.filter("ops", lambda o: o["op"] == "="), lambda o: o["i"]))
    reads = S.once(reads, lo=F.array_min("matches"), hi=F.array_max("matches"))
    kept = S.once(reads, kept=F.filter("ops", lambda o: (o["i"] >= F.col("lo")) & (o["i"] <= F.col("hi"))))
    return kept.select("rid", "ref", "start", "seq", F.col("kept").alias("ops"))


def _text(o: Column) -> Column:
    """The read's bases in an operation."""
    return F.substr(F.col("seq"), (o["q"] + 1).cast("int"), o["n"])


def drop_ambiguous(reads: DataFrame) -> DataFrame:
    """Without the reads that have N inside an I or X."""
    return reads.where(~F.coalesce(F.exists("ops", lambda o: o["op"].isin("I", "X") & F.contains(_text(o), F.lit("N"))), F.lit(False)))


def base_steps(reads: DataFrame) -> DataFrame:
    """One row per base step: (rid, ref, i, op, k, rpos, qpos, base).

    ``i`` numbers the operation, ``k`` the step within it; ``rpos`` is the reference offset (of the anchor before
    them for I and S), ``qpos`` the read offset; base is the read's, null for D.
    """
    each = reads.select("rid", "ref", "seq", F.explode("ops").alias("o")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("o.n") - 1)))
    on_ref, on_read = F.col("o.op").isin(*_ON_REF), F.col("o.op").isin(*_ON_READ)
    rpos = F.when(on_ref, F.col("o.r") + F.col("k")).otherwise(F.col("o.r") - 1)
    qpos = F.when(on_read, F.col("o.q") + F.col("k")).otherwise(F.col("o.q") - 1)
    return each.select("rid", "ref", F.col("o.i").alias("i"), F.col("o.op").alias("op"), "k", rpos.cast("long").alias("rpos"), qpos.cast("long").alias("qpos"), F.when(on_read, F.col("seq").substr((qpos + 1).cast("int"), F.lit(1))).alias("base"))


def steps_by_op(reads: DataFrame) -> DataFrame:
    """(rid, ref, op, n, first, last, bases): the steps of :func:`base_steps` of each read, by kind of operation: how many, the first and the
    last reference offset and the read's bases in order. One read is one row, so nothing is gathered."""
    each = reads.select("rid", "ref", "seq", "ops", F.explode(F.array_distinct("ops.op")).alias("op"))
    each = S.once(each, x=F.filter("ops", lambda o: o["op"] == F.col("op")))
    on_ref, on_read = F.col("op").isin(*_ON_REF), F.col("op").isin(*_ON_READ)
    at, last = F.get("x", F.lit(0)), F.element_at("x", -1)
    n = F.aggregate("x", F.lit(0).cast("long"), lambda n, o: n + o["n"])
    bases = F.when(on_read, F.array_join(F.transform("x", lambda o: _text(o)), "")).otherwise("")
    return each.select("rid", "ref", "op", n.alias("n"), F.when(on_ref, at["r"]).otherwise(at["r"] - 1).alias("first"), F.when(on_ref, last["r"] + last["n"] - 1).otherwise(last["r"] - 1).alias("last"), bases.alias("bases"))


def expand_cigar(aln: DataFrame) -> DataFrame:
    return base_steps(aligned_ops(aln))


def backbone_node(pos: Column) -> Column:
    return F.concat(F.lpad(pos.cast("string"), 10, "0"), F.lit("="))


def position(node: Column) -> Column:
    return F.substr(node, F.lit(1), F.lit(10)).cast("long")


def kind(node: Column) -> Column:
    """``=`` for backbone nodes, ``X`` and ``i`` for others."""
    return F.substr(node, F.lit(11), F.lit(1))


def alignment_nodes(reads: DataFrame) -> DataFrame:
    """(rid, ref, start, step, node): the names of the nodes that the reads of :func:`aligned_ops` pass, one row each; equal
    variants share a name.

    = is the backbone node ``pos=``, X an alternative ``posXbase``, I a node per inserted base
    ``positext:k`` with the anchor and the whole inserted text; D and S pass no node. Positions have ten digits, so
    names are in path order.
    """
    clipped = F.filter("ops", lambda o: o["op"] == "S").alias("clipped")
    each = reads.select(*READ, "seq", F.get("ops", F.lit(0))["q"].alias("q0"), clipped, F.explode("ops").alias("o")).where(F.col("o.op").isin("=", "X", "I"))
    behind = F.aggregate(F.filter("clipped", lambda c: c["i"] < F.col("o.i")), F.lit(0).cast("long"), lambda n, c: n + c["n"])
    each = each.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("o.n") - 1)))
    step = F.col("o.q") + F.col("k") + 1 - F.col("q0") - F.when(F.size("clipped") > 0, behind).otherwise(0)
    return each.select(*READ, step.cast("int").alias("step"), _nth(F.col("o"), F.col("k")).alias("node"))


def backbone_edges(backbone: DataFrame) -> DataFrame:
    """(ref, u, v) of the steps along each backbone, weight 1."""
    n = F.length("seq")
    return backbone.where(n > 1).select("ref", F.explode(F.sequence(F.lit(0), n - 2)).alias("k")).select("ref", backbone_node(F.col("k")).alias("u"), backbone_node(F.col("k") + 1).alias("v"), F.lit(1).cast("long").alias("weight"))


def pileup_edges(backbone: DataFrame, reads: DataFrame, short_weight: int = 10) -> DataFrame:
    """(ref, u, v, weight): each step of a short read of :func:`aligned_ops` adds ``short_weight`` to what long reads give.

    Steps along a backbone are counted where their number changes, and become rows once per place, not once per read.
    """
    steps = materialise(step_counts(reads), "steps")
    on = depth_spans(steps).select("ref", "depth", F.explode(F.sequence("pos", F.col("next") - 1)).alias("k"))
    on = on.select("ref", backbone_node(F.col("k")).alias("u"), backbone_node(F.col("k") + 1).alias("v"), (F.col("depth") * short_weight).alias("weight"))
    off = steps.where("v is not null").select("ref", "u", "v", (F.col("n") * short_weight).alias("weight"))
    return backbone_edges(backbone).union(on).union(off).groupBy("ref", "u", "v").agg(F.sum("weight").alias("weight"))


def alignments_by_target(reads: DataFrame, aln: DataFrame) -> DataFrame:
    """The alignments whose contig is the name of one of ``reads(read_id, ...)``, with what is known of that read."""
    return reads.join(aln, reads["read_id"] == aln["contig"])


def stringency_check(backbone: DataFrame, reads: DataFrame, tolerance: int = 100) -> DataFrame:
    """(ref, ok): every step into positions tolerance .. n - tolerance - 1 is taken by one of ``reads`` of :func:`aligned_ops`; shorter
    ones pass. Steps are counted as runs, not one by one."""
    spans = depth_spans(step_counts(reads)).join(backbone.select("ref", F.length("seq").alias("n")), "ref")
    least = max(tolerance, 1)
    inside = F.least(F.col("next"), F.col("n") - tolerance - 1) - F.greatest(F.col("pos") + 1, F.lit(least)) + 1
    hit = materialise(spans.groupBy("ref").agg(F.sum(F.greatest(inside, F.lit(0))).alias("hit")), "hits")
    return backbone.select("ref", "seq").join(hit, "ref", "left").select("ref", (F.coalesce("hit", F.lit(0)) >= F.coalesce(F.length("seq"), F.lit(0)) - tolerance - least).alias("ok"))


def branch_support(reads: DataFrame) -> DataFrame:
    """(ref, branch, n_reads): maximal stretches off the backbone with the nodes beside them, and their reads.

    ``reads`` as from :func:`aligned_ops`. branch is the node names joined by a blank; a jump over deleted nodes is a
    branch of its two ends. A match is its first and its last node with a cut between them, so that what stands between two cuts
    is a branch, or two neighbours on the backbone.
    """
    names = lambda o: F.array_join(F.transform(F.sequence(F.lit(0), o["n"] - 1), lambda k: _nth(o, k)), " ")
    cut = lambda o: F.concat(_first(o), F.lit("\n"), _nth(o, o["n"] - 1))
    passing = F.filter("ops", lambda o: o["op"].isin("=", "X", "I"))
    pieces = F.split(F.array_join(F.transform(passing, lambda o: F.when(o["op"] == "=", cut(o)).otherwise(names(o))), " "), "\n")
    one = lambda x: F.instr(x, " ") == 0
    last = lambda x: F.substring_index(x, " ", -1)
    beside = lambda x: F.rlike(x, F.lit("^[0-9]+= [0-9]+=$")) & (position(last(x)) == position(x) + 1)
    branch = F.explode(F.filter(pieces, lambda x: F.when(one(x), (x != "") & (kind(x) != "=")).otherwise(~beside(x))))
    return reads.select("ref", branch.alias("branch")).groupBy("ref", "branch").agg(F.count("*").alias("n_reads"))


def branch_edges(branches: DataFrame) -> DataFrame:
    """(ref, u, v, n_branches): how many distinct branches take each step."""
    return _edges_of(branches.select("ref", "branch").distinct())


def _edges_of(branches: DataFrame) -> DataFrame:
    """:func:`branch_edges` of branches that have one row each."""
    n = F.size("x")
    pairs = F.arrays_zip(F.slice("x", F.lit(1), n - 1).alias("u"), F.slice("x", F.lit(2), n - 1).alias("v"))
    steps = branches.select("ref", F.split("branch", " ").alias("x")).where(n > 1).select("ref", F.explode(pairs).alias("e"))
    return steps.groupBy("ref", "e.u", "e.v").agg(F.count("*").alias("n_branches"))


def branch_nodes(branches: DataFrame) -> DataFrame:
    """(ref, node, n_branches): how many distinct branches have the node between their ends."""
    x = F.split("branch", " ")
    inner = F.slice(x, F.lit(2), F.greatest(F.size(x) - 2, F.lit(0)))
    return branches.select("ref", "branch").distinct().select("ref", F.explode(inner).alias("node")).groupBy("ref", "node").agg(F.count("*").alias("n_branches"))


_BLOCK = 64


def _block(node: Column) -> Column:
    return F.coalesce(F.floor(F.substr(node, F.lit(1), F.lit(10)).try_cast("long") / _BLOCK), F.lit(-1))


def branch_fates(branches: DataFrame, walk: DataFrame, alive: DataFrame | None = None) -> DataFrame:
    """``branches(ref, branch, n_reads)`` of :func:`branch_support` with ``fate`` beside ``walk(ref, node)``.

    dead: an end is no node of ``alive(ref, node)`` any more; same: the walk takes the very same nodes from the first to
    the last; settled: both ends are on the walk, which goes another way between them; open: it runs off the walk.

    What is known of the nodes of a block of positions is one row, which a branch inside of the block meets once; only those of branches
    over several blocks are looked up one by one.
    """
    branches = branches if hasattr(branches, "isoloom_path") else materialise(branches, "branches")
    x, n = F.split("branch", " "), F.size("x")
    ends = branches.select("ref", "branch", "n_reads", F.substring_index("branch", " ", 1).alias("a"), F.substring_index("branch", " ", -1).alias("z"))
    ends = ends.withColumn("block", _block(F.col("a"))).withColumn("near", _block(F.col("z")) == F.col("block"))
    ranks = materialise(P.walk_ranks(walk, "ref"), "ranks")
    marks = ranks.select("ref", "node", "rank", F.lit(False).alias("alive"))
    if alive is not None:
        alive = materialise(alive.select("ref", "node").distinct(), "alive")
        marks = marks.union(alive.select("ref", "node", F.lit(None).cast("int"), F.lit(True)))
    marks = marks.groupBy("ref", "node").agg(F.max("rank").alias("rank"), F.max("alive").alias("alive")).groupBy("ref", _block(F.col("node")).alias("block"))
    marks = materialise(marks.agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct("rank", "alive")))).alias("marks")), "marks")

    near = ends.where("near").join(marks, ["ref", "block"], "left")
    known = lambda node: F.try_element_at("marks", node)
    near = S.once(near, x=x, at_a=known(F.col("a")), at_z=known(F.col("z")))
    inner = F.slice("x", F.lit(2), F.greatest(n - 2, F.lit(0)))
    whole = F.forall(inner, lambda node: known(node)["rank"].isNotNull())
    missing = ~F.coalesce(F.col("at_a.alive"), F.lit(False)) | ~F.coalesce(F.col("at_z.alive"), F.lit(False))
    near = near.select("ref", "branch", "n_reads", _fate(F.lit(False) if alive is None else missing, F.col("at_a.rank"), F.col("at_z.rank"), n, whole).alias("fate"))

    far, key = ends.where("not near").withColumn("x", x), ["ref", "branch"]
    on = far.select(*key, "a", "z", F.explode("x").alias("node")).join(ranks, ["ref", "node"]).groupBy(*key)
    of = lambda end: F.max(F.when(F.col("node") == F.col(end), F.col("rank"))).alias(f"rank_{end}")
    told, dead = far.join(on.agg(F.count("*").alias("n_on"), of("a"), of("z")), key, "left"), F.lit(False)
    if alive is not None:
        for end in ("a", "z"):
            told = told.join(alive.select("ref", F.col("node").alias(end), F.lit(True).alias(f"alive_{end}")), ["ref", end], "left")
            dead = dead | F.col(f"alive_{end}").isNull()
    told = told.select("ref", "branch", "n_reads", _fate(dead, F.col("rank_a"), F.col("rank_z"), n, F.col("n_on") == n).alias("fate"))
    return near.union(told)


def _fate(dead: Column, first: Column, last: Column, n: Column, whole: Column) -> Column:
    """See :func:`branch_fates`: ``first`` and ``last`` are the ranks of the ends of ``n`` nodes, ``whole`` whether all others have one too."""
    both = first.isNotNull() & last.isNotNull()
    return F.when(dead, "dead").when(both & (last - first + 1 == n) & whole, "same").when(both, "settled").otherwise("open")


def drop_branches(branches: DataFrame, walk: DataFrame, alive: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, support): the open branches, and (ref, u, v, n_branches) without the support of those that are dead or settled.

    A branch that the walk takes itself goes from the list but leaves its support.
    """
    told = branch_fates(branches, walk, alive)
    return told.where("fate = 'open'").drop("fate"), _edges_of(told.where("fate in ('open', 'same')"))


def _first(o: Column) -> Column:
    """Name of the first node of an operation =, X or I; see :func:`alignment_nodes`."""
    at = lambda pos: F.lpad(pos.cast("string"), 10, "0")
    added = F.concat(at(o["r"] - 1), F.lit("i"), _text(o), F.lit(":00000"))
    return F.when(o["op"] == "=", backbone_node(o["r"])).when(o["op"] == "X", F.concat(at(o["r"]), F.lit("X"), F.substr(F.col("seq"), (o["q"] + 1).cast("int"), F.lit(1)))).otherwise(added)


def _nth(o: Column, k: Column) -> Column:
    """Name of the k-th node of an operation, from 0: that of an operation which begins there."""
    later = F.struct(o["op"].alias("op"), (o["r"] + k).alias("r"), (o["q"] + k).alias("q"), F.lit(1).alias("n"))
    added = F.concat(F.lpad((o["r"] - 1).cast("string"), 10, "0"), F.lit("i"), _text(o), F.lit(":"), F.lpad(k.cast("string"), 5, "0"))
    return F.when(o["op"] == "I", added).otherwise(_first(later))


def _steps(ref: pa.Array, seq: pa.Array, ops: pa.ListArray) -> pa.RecordBatch:
    """The steps of a batch of reads, see :func:`read_turns`: (ref, a, x, b, y, along), nodes as their position and the rest of their name."""
    texts = ["" if t is None else t for t in seq.to_pylist()]
    size = np.array([len(t) for t in texts], np.int64)
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    flat, op = ops.flatten(), pc.index_in(ops.flatten().field("op"), pa.array(["=", "X", "I"]))
    passing = pc.and_(op.is_valid(), flat.field("r").is_valid()).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(ops)), pc.fill_null(pc.list_value_length(ops), 0).to_numpy(zero_copy_only=False))[passing]
    get = lambda c: pc.fill_null(c, 0).to_numpy(zero_copy_only=False)[passing].astype(np.int64)
    op, n, r, q = get(op), *(get(flat.field(c)) for c in ("n", "r", "q"))
    # Every node of an X or I: its place and the rest of its name, as a number in ``names``.
    names, number = ["="], {"=": 0}
    off = np.flatnonzero(op > 0)
    many = n[off]
    of, first = np.repeat(off, many), np.r_[0, np.cumsum(many)][:-1]
    k = np.arange(len(of)) - np.repeat(first, many)
    at, name = np.where(op[of] == 1, r[of] + k, r[of] - 1), np.zeros(len(of), np.int64)
    x = np.flatnonzero(op[of] == 1)
    inside = q[of[x]] + k[x] < size[row[of[x]]]
    letter = np.full(len(x), -1, np.int64)
    letter[inside] = letters[(np.r_[0, np.cumsum(size)][row[of[x]]] + q[of[x]] + k[x])[inside]]
    for c in np.unique(letter).tolist():
        names.append("X" if c < 0 else "X" + chr(c))
        name[x[letter == c]] = len(names) - 1
    added = []
    for i, m, lo in zip(row[off[op[off] == 2]].tolist(), n[off[op[off] == 2]].tolist(), q[off[op[off] == 2]].tolist(), strict=True):
        text = f"i{texts[i][lo : lo + m]}:"
        added += [number.setdefault(f"{text}{j:05d}"[: len(text) + 5], len(number)) for j in range(m)]
    name[op[of] == 2] = np.array(added, np.int64) + (len(names) - 1)
    names += list(number)[1:]
    # The first and the last node of each operation.
    a, x, b, y = r.copy(), np.zeros(len(r), np.int64), r + n - 1, np.zeros(len(r), np.int64)
    a[off], x[off], b[off], y[off] = at[first], name[first], at[first + many - 1], name[first + many - 1]
    j, run, on = np.flatnonzero(row[1:] == row[:-1]), np.flatnonzero((op == 0) & (n > 1)), np.flatnonzero(of[1:] == of[:-1])
    parts = [(row[j], b[j], y[j], a[j + 1], x[j + 1]), (row[run], a[run], x[run], b[run], y[run]), (row[of[on]], at[on], name[on], at[on + 1], name[on + 1])]
    row, a, x, b, y = (np.concatenate(c) for c in zip(*parts, strict=True))
    along = np.repeat([False, True, False], [len(j), len(run), len(on)])
    # The letters of a read without text are unknown, and so are its nodes off the backbone.
    told = np.flatnonzero((x + y == 0) | seq.is_valid().to_numpy(zero_copy_only=False)[row])
    rest = pa.array(names, pa.string())
    columns = [ref.take(pa.array(row[told])), pa.array(a[told]), rest.take(pa.array(x[told])), pa.array(b[told]), rest.take(pa.array(y[told])), pa.array(along[told])]
    return pa.RecordBatch.from_arrays(columns, ["ref", "a", "x", "b", "y", "along"])


def _ends(steps: pa.RecordBatch) -> pa.RecordBatch:
    """``steps`` of :func:`_steps` with how many reads take each, those along the backbone as where they begin (n 1) and end (n -1); these have no b and y."""
    plain = pc.and_(pc.and_(pc.equal(steps["x"], "="), pc.equal(steps["y"], "=")), pc.equal(steps["b"], pc.add(steps["a"], 1)))
    along = pc.or_(steps["along"], plain).to_numpy(zero_copy_only=False)
    on, off = np.flatnonzero(along), np.flatnonzero(~along)
    rows = pa.array(np.concatenate([off, on, on]))
    none = pa.array(np.arange(len(rows)) >= len(off))
    at = pa.array(np.concatenate([*(steps[c].to_numpy()[i] for c, i in (("a", off), ("a", on), ("b", on)))]))
    n = pa.array(np.repeat(np.array([1, 1, -1], np.int64), [len(off), len(on), len(on)]))
    b, y = (pc.if_else(none, pa.scalar(None, steps[c].type), steps[c].take(rows)) for c in ("b", "y"))
    return pa.RecordBatch.from_arrays([steps["ref"].take(rows), at, steps["x"].take(rows), b, y, n], ["ref", "at", "x", "b", "y", "n"])


def _summed(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """``batches`` with a column n and rows that are equal but for n summed up, about ``most`` rows held at a time."""

    def of(held: list[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(held)
        flat = table
        while any(pa.types.is_struct(f.type) for f in flat.schema):  # groups have no nested keys
            flat = flat.flatten()
        told = flat.group_by([c for c in flat.column_names if c != "n"], use_threads=False).aggregate([("n", "sum")]).combine_chunks()
        whole = lambda c: c.chunk(0) if c.num_chunks else pa.array([], c.type)

        def back(name: str, kind: pa.DataType) -> pa.Array:
            if pa.types.is_struct(kind):
                return pa.StructArray.from_arrays([back(f"{name}.{f.name}", f.type) for f in kind], fields=[*kind])
            return whole(told["n_sum" if name == "n" else name])

        return pa.Table.from_arrays([back(f.name, f.type) for f in table.schema], schema=table.schema)

    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= most:
            table = of(held)
            held, rows = table.to_batches(), table.num_rows
            if 2 * rows > most:  # hardly any are equal
                yield from held
                held, rows = [], 0
    if rows:
        yield from of(held).to_batches(1 << 16)


_HELD = 1 << 20


def _counts(reads: DataFrame, tell: Callable[[pa.RecordBatch], pa.RecordBatch], columns: str, held: int) -> DataFrame:
    """(ref, *columns, n): the steps of ``reads`` as ``tell`` makes them, with how many take them; summed in the tasks first."""
    passing = reads.select("ref", "seq", "ops")
    schema = StructType([passing.schema["ref"], *DataType.fromDDL(columns).fields]).add("n", "long")

    def run(batches):
        yield from _summed((tell(_steps(b["ref"], b["seq"], b["ops"])) for b in batches), held)

    return passing.mapInArrow(run, schema).groupBy(*schema.names[:-1]).agg(F.sum("n").alias("n"))


def _named(at: str, rest: str) -> Column:
    return F.concat(F.lpad(F.col(at).cast("string"), 10, "0"), F.col(rest))


def read_turns(reads: DataFrame, held: int = _HELD) -> DataFrame:
    """(ref, u, v, n, along): the steps of the reads of :func:`aligned_ops` with how many take them, those along the backbone as runs.

    Not ``along``: steps from one operation to the next and inside X and I. ``along``: all steps of one match from backbone node u
    on to v. A long match is one row, not one per base. Steps are told a batch of reads at a time and named after they are counted. Reads without a
    start take none.
    """
    one = lambda steps: steps.append_column("n", pa.array(np.ones(steps.num_rows, np.int64)))
    steps = _counts(reads, one, "a long, x string, b long, y string, along boolean", held)
    plain = (F.col("x") == "=") & (F.col("y") == "=") & (F.col("b") == F.col("a") + 1)
    return steps.select("ref", _named("a", "x").alias("u"), _named("b", "y").alias("v"), "n", (F.col("along") | plain).alias("along"))


def step_counts(reads: DataFrame, held: int = _HELD) -> DataFrame:
    """(ref, u, v, n): the steps of :func:`read_turns` off the backbone; with v null, by how many more reads take the step along the backbone
    from u on than the one before it. Rows are bounded by the places of the backbone and the variants there, where reads come by :func:`by_place`.
    ``held`` is how many rows a task sums up at a time, and changes no result.
    """
    steps = _counts(reads, _ends, "at long, x string, b long, y string", held).where("n <> 0")
    return steps.select("ref", _named("at", "x").alias("u"), _named("b", "y").alias("v"), "n")


def coverage(steps: DataFrame) -> DataFrame:
    """(ref, pos, depth): how many of ``steps`` of :func:`step_counts` go along the backbone from each place on where that changes, to the next."""
    order = W.partitionBy("ref").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return steps.where("v is null").select("ref", position(F.col("u")).alias("pos"), "n").select("ref", "pos", F.sum("n").over(order).alias("depth"))


def depth_spans(steps: DataFrame) -> DataFrame:
    """(ref, pos, next, depth): how many of ``steps`` of :func:`step_counts` take each step along a backbone, where any does."""
    return coverage(steps).withColumn("next", F.lead("pos").over(W.partitionBy("ref").orderBy("pos"))).where("depth > 0")


def _turns(reads: DataFrame, short_weight: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(off, depth, turns): the steps of short reads off the backbone (ref, u, v, n), how many take each step along it, and the
    steps (ref, u, v) of best successors that don't just go on along the backbone.

    Where no short read turns off at a backbone node, the walk follows the backbone, so only places where one does are looked at.
    """
    steps = materialise(step_counts(reads), "steps")
    off = steps.where("v is not null")
    depth = materialise(coverage(steps), "depth")
    asked = off.where(kind(F.col("u")) == "=").select("ref", position(F.col("u")).alias("pos")).distinct()
    near = W.partitionBy("ref").orderBy("pos", F.col("depth").asc_nulls_last())
    known = depth.union(asked.withColumn("depth", F.lit(None).cast("long"))).withColumn("here", F.coalesce(F.last("depth", ignorenulls=True).over(near), F.lit(0)))
    on = known.where("depth is null").select("ref", backbone_node(F.col("pos")).alias("u"), backbone_node(F.col("pos") + 1).alias("v"), (F.col("here") * short_weight + 1).alias("weight"))
    weights = off.select("ref", "u", "v", (F.col("n") * short_weight).alias("weight")).union(on)
    best = P.best_successor(weights.withColumnRenamed("ref", "cluster")).select(F.col("cluster").alias("ref"), "u", "v")
    return off, depth, materialise(best.where(~((kind(F.col("u")) == "=") & (F.col("v") == backbone_node(position(F.col("u")) + 1)))), "turns")


def _islands(backbone: DataFrame, turns: DataFrame) -> DataFrame:
    """(ref, b, q, text, names): where the greedy walk from the first base leaves the backbone after position b, and comes back at q,
    and the letters and nodes it takes between them."""
    u, v = F.col("u"), F.col("v")
    leaves = turns.where(kind(u) == "=").select("ref", position(u).alias("pos"), position(u).alias("leave"))
    lands = turns.where(kind(v) == "=").select("ref", position(v).alias("pos")).union(backbone.select("ref", F.lit(0).cast("long"))).distinct()
    # From each landing the walk follows the backbone to the nearest place where it leaves it.
    ahead = W.partitionBy("ref").orderBy(F.col("pos").desc(), F.col("leave").desc_nulls_last())
    every = leaves.union(lands.withColumn("leave", F.lit(None).cast("long"))).withColumn("next", F.last("leave", ignorenulls=True).over(ahead.rowsBetween(W.unboundedPreceding, W.currentRow)))
    runs = materialise(every.where("leave is null and next is not null").select("ref", "pos", "next"), "runs")
    via = turns.withColumn("pos", F.when(kind(v) == "=", position(v))).join(runs, ["ref", "pos"], "left")
    hops = via.select(F.col("ref").alias("cluster"), "u", F.when(kind(v) == "=", F.when(F.col("next").isNotNull(), backbone_node(F.col("next")))).otherwise(v).alias("v")).where("v is not null")
    starts = runs.where("pos = 0").select(F.col("ref").alias("cluster"), backbone_node(F.col("next")).alias("node"))
    walked = P.reach(hops, starts).select(F.col("cluster").alias("ref"), F.col("node").alias("u"), "step").join(turns, ["ref", "u"])
    order = W.partitionBy("ref").orderBy("step")
    walked = walked.withColumn("isle", F.sum(F.when(kind(u) == "=", 1).otherwise(0)).over(order))
    letter = F.when(kind(u) == "X", F.substr(u, F.lit(12), F.lit(1))).when(kind(u) == "i", F.substr(u, F.lit(12) + F.split_part(u, F.lit(":"), F.lit(2)).cast("int"), F.lit(1))).otherwise("")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", letter.alias("x")))), lambda x: x["x"]), "")
    names = F.transform(F.array_sort(F.collect_list(F.when(kind(u) != "=", F.struct("step", "u")))), lambda x: x["u"])
    per = walked.groupBy("ref", "isle").agg(F.min(F.when(kind(u) == "=", position(u))).alias("b"), F.max_by(position(v), "step").alias("q"), text.alias("text"), names.alias("names"))
    return per.select("ref", "b", "q", "text", "names")


def polish_linear(backbone: DataFrame, aln: DataFrame, short_weight: int = 10, psi: int = 35, tolerance: int = 100, stringent: bool = True) -> DataFrame:
    """(ref, seq, ok) of :func:`polish_with_islands`; with ``stringent`` only backbones that pass the check."""
    told, _ = polish_with_islands(backbone, aln, short_weight, psi, tolerance)
    return told.where("ok") if stringent else told


def polish_with_islands(backbone: DataFrame, aln: DataFrame, short_weight: int = 10, psi: int = 35, tolerance: int = 100) -> tuple[DataFrame, DataFrame]:
    """(told, islands): told(ref, seq, ok), every backbone corrected towards the greedy walk of its pileup; ``ok`` is the stringency check.

    Backbone and short reads make one graph, whose heaviest edges are walked from the first base. Where the walk leaves
    the backbone, fewer than ``psi`` skipped bases are taken out and fewer than ``psi`` bases of the walk are put in;
    larger differences stay as they are. The check asks that every step into positions tolerance .. n - tolerance - 1 of
    the result is taken by a short read. islands(ref, b, q, text, names, before) are the places that changed: bases between b and q gave way
    to text, made of the nodes ``names``, and ``before`` is by how much the places up to there have moved. All
    backbones are polished in one job, and rows are what short reads touch, not bases.
    """
    off, depth, turns = _turns(drop_ambiguous(trim_to_matches(aligned_ops(by_place(aln)))), short_weight)
    isles = _islands(backbone, turns).withColumn("gap", F.col("q") - F.col("b") - 1).where(F.col("gap") < psi)
    isles = isles.withColumn("left_out", F.length("text") >= psi).where("gap > 0 or not left_out")  # else nothing changes
    isles = isles.withColumn("names", F.when(F.length("text") < psi, F.col("names")).otherwise(F.array().cast("array<string>")))
    isles = isles.withColumn("text", F.when(F.length("text") < psi, F.col("text")).otherwise(""))
    order = W.partitionBy("ref").orderBy("b")
    before = F.coalesce(F.sum(F.length("text") - F.col("gap")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    isles = materialise(isles.withColumn("before", before), "isles")
    # The sequence: slices of the backbone and what stands between them.
    per = isles.groupBy("ref").agg(F.array_sort(F.collect_list(F.struct("b", "q", "text"))).alias("isles"))
    slice_ = lambda lo, hi: F.substr(F.col("seq"), (lo + 1).cast("int"), (hi - lo).cast("int"))
    at = lambda i: F.coalesce(F.get("isles", i)["q"], F.lit(0))
    pieces = F.transform("isles", lambda x, i: F.concat(slice_(at(i - 1), x["b"] + 1), x["text"]))
    last = slice_(at(F.size("isles") - 1), F.length("seq"))
    fixed = backbone.select("ref", "seq").join(per, "ref", "left").select("ref", F.when(F.col("isles").isNull(), F.col("seq")).otherwise(F.concat(F.array_join(pieces, ""), last)).alias("seq"))
    # The check: supported steps by their place in the result. Steps along the backbone have moved with the island before them;
    # pieces between places where depth changes or an island begins or ends are counted as one.
    marks = depth.select("ref", "pos", "depth", F.lit(None).cast("long").alias("moved"), F.lit(None).cast("boolean").alias("kept"))
    marks = marks.union(isles.select("ref", "b", F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(False)))
    marks = marks.union(isles.select("ref", "q", F.lit(None).cast("long"), F.col("before") + F.length("text") - F.col("gap"), F.lit(True)))
    near = W.partitionBy("ref").orderBy("pos", F.col("kept").desc_nulls_first())  # an island that begins where one ends comes after it
    last_of = lambda c, start: F.coalesce(F.last(c, ignorenulls=True).over(near), F.lit(start))
    pieces = marks.select("ref", "pos", F.lead("pos").over(near).alias("next"), last_of("depth", 0).alias("depth"), last_of("moved", 0).alias("moved"), last_of("kept", True).alias("kept"))
    pieces = pieces.where("kept and depth > 0 and next > pos")
    steps = pieces.select("ref", (F.col("pos") + 1 + F.col("moved")).alias("first"), (F.col("next") + F.col("moved")).alias("last"))
    into = F.col("b") + 1 + F.col("before")
    direct = off.select("ref", "u", "v", F.lit(True).alias("direct"))
    joint = isles.withColumn("u", backbone_node(F.col("b"))).withColumn("v", backbone_node(F.col("q"))).join(direct, ["ref", "u", "v"], "left").where(~F.col("left_out") | F.col("direct"))
    steps = steps.union(joint.select("ref", into, into + F.length("text")))
    ends = fixed.select("ref", F.length("seq").alias("n"))
    inside = F.greatest(F.lit(0), F.least("last", F.col("n") - tolerance - 1) - F.greatest("first", F.lit(tolerance)) + 1)
    hit = steps.join(ends, "ref").groupBy("ref").agg(F.sum(inside).alias("hit"))
    told = fixed.join(hit, "ref", "left").withColumn("ok", F.coalesce("hit", F.lit(0)) >= F.length("seq") - 2 * tolerance).drop("hit")
    return told, isles.select("ref", "b", "q", "text", "names", "before")


def _carried(ops: list[tuple[int, str]], start: int, text: str, backbone: str, isles: list, places: dict[str, int]) -> tuple[int, str, str] | None:
    """(start, cigar, seq) of a read on the polished backbone: nodes that it still has are matches, see :func:`carry`."""
    ends = [i["b"] for i in isles]
    letters: list[tuple[str, int]] = []  # each base of the read with its new place, or -1
    r, q = start, 0
    for n, op in ops:
        if op == "=":
            for k in range(n):
                i = bisect_left(ends, r + k) - 1  # the last island that begins before
                at = r + k if i < 0 else -1 if r + k < isles[i]["q"] else r + k + isles[i]["before"] + len(isles[i]["text"]) - (isles[i]["q"] - isles[i]["b"] - 1)
                letters.append((text[q + k], at))
        elif op == "X":
            letters += [(text[q + k], places.get(f"{r + k:010d}X{text[q + k]}", -1)) for k in range(n)]
        elif op == "I":
            letters += [(text[q + k], places.get(f"{r - 1:010d}i{text[q : q + n]}:{k:05d}", -1)) for k in range(n)]
        r, q = r + (n if op in _ON_REF else 0), q + (n if op in _ON_READ else 0)
    kept = [k for k, (_, at) in enumerate(letters) if at >= 0]
    if not kept:
        return None
    letters = letters[kept[0] : kept[-1] + 1]
    steps, now, open_ = [], letters[0][1], ""
    for c, at in letters:
        if at < 0:
            open_ += c
            continue
        both = min(len(open_), at - now)
        steps += ["=" if open_[k] == backbone[now + k] else "X" for k in range(both)]
        steps += ["I"] * (len(open_) - both) + ["D"] * (at - now - both) + ["="]
        now, open_ = at + 1, ""
    return letters[0][1], "".join(f"{len([*g])}{op}" for op, g in groupby(steps)), "".join(c for c, _ in letters)


def _carried_together(starts: pa.Array, cigars: pa.Array, texts: pa.Array, backbone: str, isles: list, places: dict[str, int]) -> tuple[pa.Array, ...] | None:
    """(row, start, cigar, seq) of the reads that :func:`_carried` keeps, told for all reads at once; None where it has to look at each of them."""
    letters, line = "".join(texts.to_pylist()), np.frombuffer(backbone.encode("utf-32-le"), np.uint32)
    if not letters.isascii() or not len(line):
        return None
    text = np.frombuffer(letters.encode(), np.uint8)
    begin = np.r_[0, np.cumsum(pc.binary_length(texts).to_numpy())].astype(np.int64)
    ops = _placed(cigars, starts)
    flat, row = ops.flatten(), np.repeat(np.arange(len(ops)), pc.list_value_length(ops).to_numpy())
    op, (n, r, q) = pc.index_in(flat.field("op"), pa.array(["=", "X", "I"])), (flat.field(c).to_numpy().astype(np.int64) for c in ("n", "r", "q"))
    passing = op.is_valid().to_numpy(zero_copy_only=False)
    op, row, n, r, q = pc.fill_null(op, 0).to_numpy()[passing], row[passing], n[passing], r[passing], q[passing]
    if (q + n > np.diff(begin)[row]).any():
        return None
    # Every base: its read, letter, and place on the polished backbone or -1.
    of = np.repeat(np.arange(len(op)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    letter, at, was = text[begin[row[of]] + q[of] + k], np.full(len(of), -1, np.int64), r[of] + k
    b, e, moved = np.array([[i["b"], i["q"], i["before"] + len(i["text"]) - (i["q"] - i["b"] - 1)] for i in isles], np.int64).reshape(-1, 3).T
    on = np.flatnonzero(op[of] == 0)
    i = np.searchsorted(b, was[on]) - 1  # the last island that begins before
    at[on] = np.where(i < 0, was[on], np.where(was[on] < e[i], -1, was[on] + moved[i])) if len(b) else was[on]
    others, added = {}, {}
    for name, place in places.items():
        if name[10] == "X":
            if len(name) == 12 and name[:10].isdigit():
                others[int(name[:10]) << 21 | ord(name[11])] = place
        else:
            node, nth = name.rsplit(":", 1)
            added.setdefault(node, {})[int(nth)] = place
    if others:
        keys = np.array(sorted(others), np.int64)
        x = np.flatnonzero(op[of] == 1)
        wanted = was[x] << 21 | letter[x]
        near = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        at[x] = np.where(keys[near] == wanted, np.array([others[y] for y in keys.tolist()], np.int64)[near], -1)
    if added:
        first = np.cumsum(n) - n
        for j in np.flatnonzero(op == 2).tolist():
            lo = int(begin[row[j]] + q[j])
            for nth, place in added.get(f"{r[j] - 1:010d}i{letters[lo : lo + n[j]]}", {}).items():
                if nth < n[j]:
                    at[first[j] + nth] = place
    # From the first to the last base with a place.
    kept, read = np.flatnonzero(at >= 0), row[of]
    if not len(kept):
        return tuple(pa.array([], t) for t in (pa.int64(), pa.int64(), pa.string(), pa.string()))
    new = np.r_[True, read[kept[1:]] != read[kept[:-1]]]
    heads, tails = kept[new], kept[np.r_[new[1:], True]]
    gap, skipped = np.where(new, 0, np.diff(kept, prepend=0) - 1), np.where(new, 0, np.diff(at[kept], prepend=0) - 1)
    if (skipped < 0).any():
        return None
    both = np.minimum(gap, skipped)
    code = np.full(len(at), ord("="), np.uint8)
    free = np.repeat(np.arange(len(kept)), gap)  # bases without a place, by the one with a place after them
    nth = np.arange(len(free)) - np.repeat(np.cumsum(gap) - gap, gap)
    base, against = kept[free] - gap[free] + nth, np.where(nth < both[free], at[kept[free]] - skipped[free] + nth, 0)
    code[base] = np.where(nth >= both[free], ord("I"), np.where(letter[base] == line[against], ord("="), ord("X")))
    inside = np.zeros(len(at) + 1, np.int64)
    inside[heads] += 1
    np.subtract.at(inside, tails + 1, 1)
    used = np.flatnonzero(np.cumsum(inside)[:-1])
    out = np.flatnonzero(skipped > both)
    before = np.searchsorted(used, kept[out])
    steps, of_read, size = np.insert(code[used], before, ord("D")), np.insert(read[used], before, read[kept[out]]), np.insert(np.ones(len(used), np.int64), before, (skipped - both)[out])
    turn = np.flatnonzero(np.r_[True, (steps[1:] != steps[:-1]) | (of_read[1:] != of_read[:-1])])
    kinds = pa.StringArray.from_buffers(len(turn), pa.py_buffer(np.arange(len(turn) + 1, dtype=np.int32)), pa.py_buffer(steps[turn].tobytes()))
    runs = pc.binary_join_element_wise(pa.array(np.add.reduceat(size, turn)).cast(pa.string()), kinds, "")
    rows = read[heads]
    bounds = lambda x: pa.array(np.r_[np.searchsorted(x, rows), len(x)].astype(np.int32))
    cigar = pc.binary_join(pa.ListArray.from_arrays(bounds(of_read[turn]), runs), "")
    seq = pa.StringArray.from_buffers(len(rows), bounds(read[used]).buffers()[1], pa.py_buffer(letter[used].tobytes()))
    return pa.array(rows), pa.array(at[heads]), cigar, seq


def carry(aln: DataFrame, told: DataFrame, islands: DataFrame, chunk: int = 2000) -> DataFrame:
    """``aln`` carried over from backbones to what :func:`polish_with_islands` made of them, without an aligner.

    A read's nodes that are in the polished backbone are matches at their new places: backbone bases that stayed, and the nodes of islands
    that the read took too. Between two matches its other bases stand against the bases skipped there, equal ones as matches, and what
    is left over is inserted or deleted. Bases before the first and after the last match are cut off, reads without any go. Reads that
    touch no island only move. A backbone's reads are dealt to chunks, each of which meets the islands of that backbone.
    """
    sizes = materialise(aln.groupBy("ref").agg(F.ceil(F.count("*") / chunk).alias("n_parts")), "counts")
    dealt = aln.select("rid", "ref", "start", "cigar", "seq").join(sizes, "ref").withColumn("part", F.pmod(F.xxhash64("rid", "start"), F.col("n_parts"))).drop("n_parts")
    per = islands.groupBy("ref").agg(F.array_sort(F.collect_list(F.struct("b", "q", "before", "text", "names"))).alias("isles"))
    new = told.select("ref", F.col("seq").alias("backbone")).join(per, "ref").join(sizes, "ref")
    new = new.select("ref", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1)).alias("part"), "backbone", "isles")
    schema = aln.select("rid", "ref", "start", "cigar", "seq").schema

    def run(reads: pa.Table, over: pa.Table) -> pa.Table:
        if not over.num_rows:  # nothing changed on this backbone
            return reads.select(["rid", "ref", "start", "cigar", "seq"])
        isles, backbone = over["isles"][0].as_py(), over["backbone"][0].as_py()
        places = {name: i["b"] + 1 + i["before"] + k for i in isles for k, name in enumerate(i["names"])}
        columns = [reads[c].combine_chunks() for c in ("start", "cigar", "seq")]
        if not any(c.null_count for c in columns) and (together := _carried_together(*columns, backbone, isles, places)) is not None:
            row, start, cigar, text = together
            ids = reads.select(["rid", "ref"]).take(row)
            return pa.table([*ids.columns, start.cast(reads.schema.field("start").type), cigar, text], names=["rid", "ref", "start", "cigar", "seq"])
        rows, out = [], []
        for k, (start, cigar, text) in enumerate(zip(reads["start"].to_pylist(), reads["cigar"].to_pylist(), reads["seq"].to_pylist(), strict=True)):
            ops = [(int(n), op) for n, op in re.findall("([0-9]+)([=XIDS])", cigar)]
            if (x := _carried(ops, start, text, backbone, isles, places)) is not None:
                rows.append(k)
                out.append(x)
        ids = reads.select(["rid", "ref"]).take(pa.array(rows, pa.int64()))
        start, cigar, text = zip(*out, strict=True) if out else ([], [], [])
        return pa.table([*ids.columns, pa.array(start, reads.schema.field("start").type), pa.array(cigar, pa.string()), pa.array(text, pa.string())], names=["rid", "ref", "start", "cigar", "seq"])

    return dealt.groupBy("ref", "part").cogroup(new.groupBy("ref", "part")).applyInArrow(run, schema)


def iterate_polish(backbone: DataFrame, aln: DataFrame, max_iterations: int = 5, short_weight: int = 10, psi: int = 35, tolerance: int = 100) -> DataFrame:
    """(ref, seq, ok, iteration): backbones polished until they don't change, at most ``max_iterations`` times.

    After each round the short reads of the backbones that go on are carried over to what these have become, see :func:`carry`. ``ok`` is the
    stringency check of the last version by the reads as they lie on it.
    """
    rounds: list[DataFrame] = []

    def step(now: DataFrame) -> DataFrame:
        reads = (rounds[-1].drop("iteration") if rounds else aln).join(now.select("ref"), "ref", "left_semi").select("rid", "ref", "start", "cigar", "seq")
        told, islands = polish_with_islands(now, reads, short_weight, psi, tolerance)
        told = materialise(told, "polished")
        rounds.append(materialise(carry(reads, told, islands).withColumn("iteration", F.lit(len(rounds) + 1)), "carried"))
        return told.select("ref", "seq")

    out = materialise(iterate_until_stable(backbone.select("ref", "seq"), step, "ref", max_iterations), "settled")
    last = latest_version(reduce(DataFrame.union, rounds), "ref", "iteration").drop("iteration")
    ok = stringency_check(out.select("ref", "seq"), drop_ambiguous(trim_to_matches(aligned_ops(by_place(last)))), tolerance)
    return out.join(ok, "ref").select("ref", "seq", "ok", "iteration")


def sum_edges(chunks: DataFrame) -> DataFrame:
    """Edges of chunk results (cluster, u, v, weight) with the sums of their weights."""
    return chunks.groupBy("cluster", "u", "v").agg(F.sum("weight").alias("weight"))


def iterate_until_stable(state: DataFrame, step: Callable[[DataFrame], DataFrame], key: str, max_iterations: int = 5) -> DataFrame:
    """Repeat ``step`` on clusters whose rows still change; a cluster that comes out as it went in is frozen.

    ``state`` and what ``step`` returns have the same columns; the result has ``iteration``, that in which the
    cluster was last changed or found stable. Rows of a cluster are compared by order-independent hash sums.
    """
    columns = state.columns
    mark = lambda df, n: df.groupBy(key).agg(F.count("*").alias(f"n_{n}"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias(f"h_{n}"))
    active, done, parts = materialise(state, "state"), 0, []
    for done in range(1, max_iterations + 1):
        after = materialise(step(active).select(columns), "state")
        same = mark(after, "a").join(mark(active, "b"), key).where("n_a = n_b and h_a = h_b").select(key)
        frozen = materialise(after.join(same, key, "left_semi").withColumn("iteration", F.lit(done)), "frozen")
        parts.append(frozen)
        discard(active)
        active = materialise(unconverged_only(after, frozen, key), "state")
        if active.isEmpty():
            break
    out = active.withColumn("iteration", F.lit(done))
    for p in parts:
        out = out.unionByName(p)
    return out


def unconverged_only(state: DataFrame, frozen: DataFrame, key: str = "cluster") -> DataFrame:
    """Rows of the clusters that aren't among ``frozen(key)``."""
    return state.join(frozen.select(key).distinct(), key, "left_anti")


def correct_until_stable(paths: DataFrame, max_iterations: int = 5, psi: int = 35) -> DataFrame:
    """Reads corrected towards the greedy walks of their cluster, one after another, until nothing changes."""
    return iterate_until_stable(paths, lambda now: D.correct_by_walks(now, P.greedy_walks(now), psi)[0], "cluster", max_iterations)
