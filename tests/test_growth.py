"""Steps that must not grow faster than their input: what goes through the driver, and what is done inside a row."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoloom.functions import sequences
from isoloom.operators import components, decompose, paths, pileup, transcripts
from isoloom.plans.queries import QUERIES
from isoloom.shared import spread
from tests.test_rules import frame, random_reads, walks_of


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_tables_are_not_broadcast(spark):
    a = spread(spark.range(10).withColumnRenamed("id", "a"), "a")
    assert "SortMergeJoin" in plan(a.join(spark.range(10).withColumnRenamed("id", "a"), "a"))
    rows = [(0, r, 1, k + 1, n) for r in range(3) for k, n in enumerate((1, 2, 4 + r))]
    reads = spark.createDataFrame(rows, "cluster long, read long, support int, pos int, node long")
    fixed, _ = paths.correct_paths(reads, paths.heaviest_path(reads), psi=3)
    assert "Broadcast" not in plan(fixed)
    walk = paths.heaviest_path(reads)
    for rows in (paths.align_paths(reads, walk), paths.compatible_reads(reads, walk, 0)):
        assert "SortMergeJoin" in plan(rows) and "Broadcast" not in plan(rows)


READS = [
    (1, 7, 0, "3=1X2=", "ACGTAC"), (2, 7, 0, "2S3=1X2=1S", "GGACGTACG"), (3, 7, 2, "2=3D2=", "ACGT"), (4, 7, 2, "2X1I2=2X", "ACGTACG"),
    (5, 7, 5, "1X", "A"), (6, 7, 5, "4=", "ACGT"), (7, 7, 5, "2=2=", "ACGT"), (8, 7, 1, "1=2D1=1I1=", "ACGT"), (9, 7, 1, "", ""),
]


def reads(spark):
    return pileup.aligned_ops(spark.createDataFrame(READS, "rid long, ref long, start int, cigar string, seq string"))


def test_branches_are_told_inside_the_row(spark):
    got = pileup.branch_support(reads(spark))
    assert "Window" not in plan(got)
    at = lambda p, x="=": f"{p:010d}{x}"
    want = {
        f"{at(2)} {at(3, 'XT')} {at(4)}": 2, f"{at(3)} {at(7)}": 1, f"{at(2, 'XA')} {at(3, 'XC')} {at(3, 'iG:00000')} {at(4)}": 1, f"{at(5)} {at(6, 'XC')} {at(7, 'XG')}": 1,
        at(5, "XA"): 1, f"{at(1)} {at(4)}": 1, f"{at(4)} {at(4, 'iG:00000')} {at(5)}": 1,
    }
    assert {r.branch: r.n_reads for r in got.collect()} == want
    walk = spark.createDataFrame([(7, at(k)) for k in range(9)], "ref long, node string")
    assert "Broadcast" not in plan(pileup.branch_fates(got, walk, walk))


def test_operations_of_odd_strings(spark):
    rng = random.Random(3)
    rows = [(k, 1, k, "".join(rng.choice(["3=", "12X", "0I", "1D", "5", "Z", "=", "10S", "007M", "é"]) for _ in range(rng.randrange(8))), "") for k in range(300)] + [(300, 1, 4, None, "")]
    got = {r.rid: r.ops for r in pileup.aligned_ops(spark.createDataFrame(rows, "rid long, ref long, start int, cigar string, seq string")).collect()}
    assert got.pop(300) is None
    for rid, _, start, cigar, _ in rows[:-1]:
        want, r, q = [], start, 0
        for n, op in re.findall("([0-9]+)([MIDNSHP=X])", cigar):
            if int(n):
                want.append((len(want), op, int(n), r, q))
                r, q = r + int(n) * (op in "=XD"), q + int(n) * (op in "=XIS")
        assert [tuple(x) for x in got[rid]] == want


def test_steps_are_counted_as_runs(spark):
    got = {(r.rid, r.op): tuple(r)[3:] for r in pileup.steps_by_op(reads(spark)).collect()}
    assert got[2, "S"] == (3, -1, 5, "GGG") and got[2, "="] == (5, 0, 5, "ACGAC") and got[3, "D"] == (3, 4, 6, "") and got[4, "I"] == (1, 3, 3, "G")
    steps = {(r.rid, r.step): r.node for r in pileup.alignment_nodes(reads(spark)).collect()}
    assert [steps[2, k] for k in range(1, 7)] == [steps[1, k] for k in range(1, 7)] and (2, 7) not in steps
    backbone = spark.createDataFrame([(7, "ACGTACGTA"), (8, "ACGT"), (9, "A")], "ref long, seq string")
    ok = lambda t: {r.ref: r.ok for r in pileup.stringency_check(backbone, reads(spark), t).collect()}
    assert ok(0) == {7: False, 8: False, 9: True} and ok(1) == {7: False, 8: False, 9: True} and ok(2) == {7: False, 8: True, 9: True}
    checked = pileup.stringency_check(backbone, reads(spark).where("rid in (1, 6, 8, 7)"), 0)
    assert not checked.where("ref = 7").first().ok


def test_chains_of_all_three_sets(spark):
    sf = "/root/testdata/sf0.001"
    kinds = {r[0] for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderstatus").distinct().collect()}
    assert {r.kind for r in QUERIES["intron_chains"](spark, sf).select("kind").distinct().collect()} == kinds == {"F", "O", "P"}
    assert QUERIES["novel_isoforms"](spark, sf).first().n_r2 > 0


def test_turns_are_told_a_batch_at_a_time(spark):
    rng, rows = random.Random(11), []
    for k in range(400):
        ops = "".join(f"{rng.choice([1, 2, 3, 12])}{rng.choice('==XIDS')}" for _ in range(rng.randrange(8)))
        rows.append((k, k % 3, rng.randrange(9), ops if k % 40 else None, "".join(rng.choice("ACGTé") for _ in range(rng.randrange(50))) if k % 30 else None))
    want = {}
    for _, ref, start, cigar, seq in rows:
        r, q, runs = start, 0, []  # runs: the node names of each operation, None where the letter is unknown
        for n, op in ((int(n), op) for n, op in re.findall("([0-9]+)([=XIDS])", cigar or "")):
            if op in "=X":
                runs.append((op, [f"{r + j:010d}=" if op == "=" else seq is not None and f"{r + j:010d}X{seq[q + j : q + j + 1]}" for j in range(n)]))
            elif op == "I":
                runs.append((op, [seq is not None and f"{f'{r - 1}'.rjust(10, '0')}i{seq[q : q + n]}:{j:05d}" for j in range(n)]))
            r, q = r + n * (op in "=XD"), q + n * (op in "=XIS")
        found = [(a[1][-1], b[1][0], False) for a, b in zip(runs, runs[1:])]
        for op, x in runs:
            found += [(x[0], x[-1], True)] * (len(x) > 1) if op == "=" else [(u, v, False) for u, v in zip(x, x[1:])]
        for u, v, along in found:
            if u and v:
                along = along or (u[10] == v[10] == "=" and int(v[:10]) == int(u[:10]) + 1)
                want[ref, u, v, along] = want.get((ref, u, v, along), 0) + 1
    aln = spark.createDataFrame(rows, "rid long, ref long, start int, cigar string, seq string")
    turns, got = pileup.read_turns(pileup.aligned_ops(aln)), {}
    for r in turns.collect():
        got[r.ref, r.u, r.v, r.along] = got.get((r.ref, r.u, r.v, r.along), 0) + r.n
    assert got == want
    assert len(re.findall(r"^.{0,20}MapInArrow", plan(turns), re.M)) == 2 and "Generate" not in plan(turns)  # counted by numbers, named after


def test_orfs_of_both_strands_are_told_a_batch_at_a_time(spark):
    rng = random.Random(7)
    texts = ["", "A", "AT", "ATG", "ATGTAA", "ATGATGTGA", "CATATGTAAATGTAG", "UUAUGCCUAAé", None, "ATGNTAA"]
    texts += ["".join(rng.choice("ATGGATAAéUacgR" if k % 3 == 0 else "ACGT") for _ in range(rng.randrange(300))) for k in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "read_id long, seq string")
    got = transcripts._oriented(df)
    assert "MapInArrow" in plan(got)
    once = sequences.once(got, f=sequences.longest_orf(F.translate("seq", "U", "T")), r=sequences.longest_orf(F.col("rev")))
    rows = once.select("read_id", "ahead", "back", "f.protein", F.col("r.protein").alias("other")).collect()
    assert {r.read_id for r in rows} == {k for k, t in enumerate(texts) if t is not None and "N" not in t.upper()}
    assert [(r.ahead, r.back) for r in rows] == [(r.protein, r.other) for r in rows]


def test_walks_go_by_blocks(spark):
    rows = random_reads(random.Random(8), 5, 9, 3)
    edges = paths.edge_weights(frame(spark, rows))
    starts = spark.createDataFrame(sorted({(c, min(x)) for (c, _), (_, x) in rows.items()}), "cluster int, node int")
    want = {(c, w[0]): w for c in range(5) for w in walks_of({r: x for (k, r), x in rows.items() if k == c}, 3)}
    for block in (3, 7, 1000):
        got = {}
        for x in paths.walks_from(edges, starts, 3, block).collect():
            got.setdefault((x.cluster, x.source), []).append((x.step, x.node))
        assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == want and all([s for s, _ in sorted(v)] == [*range(len(v))] for v in got.values())
    # Rounds are those of blocks, not of nodes.
    spark.sparkContext.setJobGroup("long walk", "")
    line = spark.createDataFrame([(0, k, k + 1, 1) for k in range(4000)], "cluster int, u long, v long, weight long")
    assert paths.walks_from(line, spark.createDataFrame([(0, 0), (0, 9)], "cluster int, node long")).count() == 4001
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("long walk")) < 60
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_single_ways_are_followed_at_once():
    long = [np.arange(k % 2, 400_000 + k) for k in range(4)]
    began = time.process_time()
    got = decompose.isoforms_of(long, np.array([1, 2, 3, 4]), 35)
    assert time.process_time() - began < 3
    assert [(p[0], len(p), s) for p, s in got] == [(0, 400_003, 10)]


def test_components_of_runs_are_stars(spark, monkeypatch):
    rng = random.Random(9)
    odd = [(5, 5), (6, None), (None, 7), (-3, 8), (8, -3), (8, 8)]
    strewn = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + odd
    near = [(k, k + rng.randrange(3)) for k in range(900) if k % 50] + odd
    for rows in (strewn, near, [(k + 1, k) for k in range(700)], odd[:1], []):
        edges = spark.createDataFrame(rows, "u long, v long").repartition(5)
        want = {r.node: r.component for r in components.connected_components(edges).collect()}
        assert {r.node: r.component for r in components.local_components(edges).collect()} == want
        assert components.local_components(edges).count() == len(want)
    # Components that lie together in the input are done where they are read.
    monkeypatch.setattr(components, "connected_components", None)
    line = spark.range(0, 50_000, 1, 2).selectExpr("id as u", "id - id % 100 as v")
    assert components.local_components(line).where("component <> node - node % 100").isEmpty()


def test_layers_go_by_blocks(spark, monkeypatch):
    written, real = [], paths.materialise
    monkeypatch.setattr(paths, "materialise", lambda df, name: written.append(name) or real(df, name))
    deep = [(c, k * 3 + i, k * 3 + 3 + j) for c in (0, 1) for k in range(300) for i in range(3) for j in range(3)]
    got = paths.topological_layers(spark.createDataFrame(deep, "cluster int, u int, v int"))
    assert got.dtypes == [("cluster", "int"), ("node", "int"), ("layer", "int")] and {(r.node // 3, r.layer) for r in got.collect()} == {(k, k) for k in range(301)}
    assert got.count() == 1806 and written.count("layers") == 1  # rounds are those of blocks, not of layers
    rng, edges = random.Random(4), deep
    for c in range(2, 6):  # numbers that don't ascend, dense and sparse, some in one block
        name = rng.sample(range(-40, 10 if c == 2 else 90), 50)
        edges = edges + [(c, name[i], name[j]) for i in range(50) for j in range(i + 1, 50) if rng.random() < (0.02, 0.1, 0.5)[c % 3]]
    want = {}
    for _ in range(301):
        for c, u, v in edges:
            want[c, v] = max(want.get((c, v), 0), want.setdefault((c, u), 0) + 1)
    written.clear()
    rows = paths.topological_layers(spark.createDataFrame(edges, "cluster int, u long, v long"), 64).collect()
    assert len(rows) == len(want) and {(r.cluster, r.node): r.layer for r in rows} == want and written.count("layers") < 70
    assert paths.topological_layers(spark.createDataFrame([], "cluster int, u long, v long")).isEmpty()
    for circle in ([(1, 2), (2, 3), (3, 2)], [(1, 20), (2, 20), (20, 31), (20, 32), (31, 2), (32, 2), (1, 2)]):
        with pytest.raises(ValueError, match="circle"):
            paths.topological_layers(spark.createDataFrame([(0, *e) for e in circle], "cluster int, u long, v long"), 10)


def test_steps_of_one_place_are_counted_before_they_are_shuffled(spark):
    import pyarrow as pa

    rows = pa.table({"ref": pa.array([{"cluster": k % 3, "read": None if k % 2 else 0} for k in range(6000)]), "x": pa.array([None if k % 5 else "=" for k in range(6000)]), "n": pa.array([1] * 6000)})
    few = pa.Table.from_batches([*pileup._summed(rows.to_batches(100), 250)])
    assert few.num_rows < 1000 and few.schema == rows.schema  # 12 different ones
    sums = {}
    for r in few.to_pylist():
        sums[str(r["ref"]), r["x"]] = sums.get((str(r["ref"]), r["x"]), 0) + r["n"]
    assert len(sums) == 12 and sum(sums.values()) == 6000
    aln = spark.createDataFrame([(k, k % 2, k % 7, "3=1X2I4=2D3=", "ACGTTTACGTACG") for k in range(500)], "rid long, ref long, start int, cigar string, seq string")
    dealt = pileup.by_place(aln)
    assert "rebalance" in plan(dealt).lower() and dealt.columns == aln.columns
    told = [sorted(map(tuple, pileup.step_counts(pileup.aligned_ops(x), held).collect()), key=str) for x, held in ((aln, 1), (dealt, 50), (dealt, 1 << 20))]
    assert told[0] == told[1] == told[2] and sum(r[3] for r in told[0] if r[2] is None) == 0
    backbone = spark.createDataFrame([(0, "ACGTACGTAC" * 3), (1, "ACGTACGTAC" * 3)], "ref long, seq string")
    weights = {(r.ref, r.u, r.v): r.weight for r in pileup.pileup_edges(backbone, pileup.aligned_ops(dealt), 1).collect()}
    turns = {}
    for r in pileup.read_turns(pileup.aligned_ops(aln)).collect():
        for k in range(int(r.u[:10]), int(r.v[:10])) if r.along else [None]:
            step = (r.ref, r.u, r.v) if k is None else (r.ref, f"{k:010d}=", f"{k + 1:010d}=")
            turns[step] = turns.get(step, 0) + r.n
    assert weights == {x: turns.get(x, 0) + (x[1][10] == x[2][10] == "=" and int(x[2][:10]) == int(x[1][:10]) + 1) for x in weights} and turns.keys() <= weights.keys()


def test_fates_are_told_from_blocks(spark):
    rng, at = random.Random(5), lambda k, x="=": f"{k:010d}{x}"
    nodes = {ref: [at(k, x) for k in range(300) for x in ("=", "XC", "iGT:00000", "iGT:00001") if x == "=" or rng.random() < 0.4] for ref in (1, 2)}
    walk = [(ref, x) for ref in nodes for x in nodes[ref] if rng.random() < 0.8]
    alive = [(ref, x) for ref in nodes for x in nodes[ref] if rng.random() < 0.9]
    on, rows = {ref: [x for r, x in walk if r == ref] for ref in nodes}, {}
    for k in range(600):
        ref, taken = 1 + k % 2, rng.choice((on, nodes))
        lo = rng.randrange(len(taken[ref]) - 90)
        some = taken[ref][lo : lo + rng.choice((1, 2, 3, 4, 90))]
        rows[ref, " ".join(rng.choice((some, [*some[:1], *some[-1:]])) if len(some) > 1 else some)] = k
    want = []
    for (ref, branch), k in rows.items():
        x = branch.split(" ")
        both = x[0] in on[ref] and x[-1] in on[ref]
        fate = "same" if both and [y for y in on[ref] if x[0] <= y <= x[-1]] == x else "settled" if both else "open"
        want.append((ref, branch, k, fate, "dead" if not {(ref, x[0]), (ref, x[-1])} <= {*alive} else fate))
    frame_ = lambda x: spark.createDataFrame(x, "ref long, node string")
    branches = spark.createDataFrame([(*b, k) for b, k in rows.items()], "ref long, branch string, n_reads long")
    for column, a in ((3, None), (4, frame_(alive))):
        told = pileup.branch_fates(branches, frame_(walk), a)
        assert sorted(map(tuple, told.collect())) == sorted((*x[:3], x[column]) for x in want)
    assert {x[4] for x in want} == {"dead", "same", "settled", "open"} and any(x[3] == "same" and x[1].count(" ") > 80 for x in want)
    kept, support = pileup.drop_branches(branches, frame_(walk), frame_(alive))
    assert kept.count() == sum(x[4] == "open" for x in want)
    edges = {}
    for ref, branch, _, _, fate in want:
        for u, v in zip(branch.split(" "), branch.split(" ")[1:]) if fate in ("open", "same") else ():
            edges[ref, u, v] = edges.get((ref, u, v), 0) + 1
    assert {tuple(r)[:3]: r.n_branches for r in support.collect()} == edges


def test_branches_are_read_once(spark):
    text = plan(QUERIES["branch_fates"](spark, "/root/testdata/sf0.001"))
    assert "lineitem" not in text and "MapInArrow" not in text  # all from written branches and what is known of nodes


def test_reads_are_carried_together():
    import pyarrow as pa

    rng, dropped, kinds = random.Random(9), 0, set()
    for k in range(60):
        line = "".join(rng.choice("ACGT") for _ in range(120))
        isles, before, b = [], 0, rng.randrange(12)
        while b < 100:
            q = b + 1 + rng.randrange(4)
            names = [f"{b + 1:010d}X{rng.choice('ACGT')}"][: rng.randrange(2)] + [f"{b + 1:010d}iGA:{j:05d}" for j in range(rng.choice((0, 1, 2)))]
            isles.append({"b": b, "q": q, "before": before, "text": "T" * len(names), "names": names})
            before += len(names) - (q - b - 1)
            b = q + rng.randrange(9)
        places = {name: i["b"] + 1 + i["before"] + j for i in isles for j, name in enumerate(i["names"])}
        polished, rows = "".join(rng.choice("ACGT") for _ in range(130 + before)), []
        for _ in range(80):
            ops = [(rng.choice((1, 1, 2, 5)), rng.choice("==XIDS")) for _ in range(rng.randrange(7))]
            text = "".join("GA" if (n, op) == (2, "I") and rng.random() < 0.7 else "".join(rng.choice("ACGT") for _ in range(n)) for n, op in ops if op != "D")
            rows.append((ops, rng.randrange(80), text))
        if not k:
            isles, places = [], {}
        each = [(i, *x) for i, (ops, start, text) in enumerate(rows) if (x := pileup._carried(ops, start, text, polished, isles, places)) is not None]
        columns = pa.array([s for _, s, _ in rows], pa.int32()), pa.array(["".join(f"{n}{op}" for n, op in ops) for ops, *_ in rows]), pa.array([t for *_, t in rows])
        got = pileup._carried_together(*columns, polished, isles, places)
        if got is None:
            kinds.add("each")
            continue
        assert [*zip(*(c.to_pylist() for c in got), strict=True)] == each
        dropped += len(rows) - len(each)
        kinds |= {c for _, _, cigar, _ in each for c in cigar if not c.isdigit()}
    assert dropped and {"=", "X", "I", "D"} <= kinds
    assert pileup._carried_together(pa.array([0]), pa.array(["1="]), pa.array(["é"]), "A", [], {}) is None
    assert pileup._carried_together(pa.array([0]), pa.array(["3="]), pa.array(["A"]), "ACG", [], {}) is None
