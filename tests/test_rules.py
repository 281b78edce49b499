"""Rules that SQL doesn't state well, against row-by-row restatements on random cases."""

import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoloom.functions import sequences as S
from isoloom.operators import clusters, components, decompose, paths, pileup, transcripts
from isoloom.operators import structure as I


def scan(read, walk, psi, correct_ends, detect_ends):
    """One pass over the merged nodes, with the run lengths since the last match."""
    merged = [(n, "M" if n in read and n in walk else "I" if n in read else "D") for n in sorted(read | walk)]
    out, differs, started, ins, dels = set(read), False, False, [], []
    for n, op in merged:
        if op == "I":
            ins.append(n)
        elif op == "D":
            dels.append(n)
        else:
            if started:
                if len(ins) >= psi:
                    differs = True
                else:
                    out -= set(ins)
                    if len(dels) >= psi:
                        differs = True
                    else:
                        out |= set(dels)
            elif correct_ends or detect_ends:
                if len(ins) >= psi:
                    differs = True
                elif correct_ends:
                    out -= set(ins)
            started, ins, dels = True, [], []
    if (correct_ends or detect_ends) and ins:
        if len(ins) >= psi:
            differs = True
        elif correct_ends:
            out -= set(ins)
    return sorted(out), differs


@pytest.mark.parametrize("ends", [(False, True), (True, True), (False, False)])
def test_correct_paths(spark, ends):
    rnd = random.Random(2)
    reads, walks = {}, {}
    for c in range(12):
        walks[c] = {n for n in range(60) if rnd.random() < 0.6}
        for r in range(8):
            reads[c, r] = {n for n in range(60) if (n in walks[c]) == (rnd.random() < 0.85)} or {1}
    rows = [(c, r, 1, i + 1, n) for (c, r), ns in reads.items() for i, n in enumerate(sorted(ns))]
    p = spark.createDataFrame(rows, "cluster int, read int, support long, pos int, node int")
    w = spark.createDataFrame([(c, n) for c, ns in walks.items() for n in ns], "cluster int, node int")
    fixed, flags = paths.correct_paths(p, w, psi=3, correct_ends=ends[0], detect_ends=ends[1])
    got = {(r.cluster, r.read): r.x for r in fixed.groupBy("cluster", "read").agg(F.array_sort(F.collect_list("node")).alias("x")).collect()}
    told = {(r.cluster, r.read): r.differs for r in flags.collect()}
    for key, ns in reads.items():
        want, differs = scan(ns, walks[key[0]], 3, *ends)
        assert (got.get(key, []), told[key]) == (want, differs)


def conditioned(reads, delta):
    """Isoforms of one chunk by sets: reads is a list of (support, nodes)."""
    rest, out = dict(enumerate(reads)), []
    while rest:
        nodes, edges = {}, {}
        for s, ns in rest.values():
            for n in ns:
                nodes[n] = nodes.get(n, 0) + s
            for e in zip(ns, ns[1:]):
                edges.setdefault(e, s)
        seed = min(nodes, key=lambda n: (-nodes[n], n))
        readers = {r for r, (_, ns) in rest.items() if seed in ns}
        walk = [seed]
        # Readers open at an end of the walk: the high end is True, the low end False.
        room = lambda r, n, high: len(rest[r][1]) - rest[r][1].index(n) if high else rest[r][1].index(n)
        open_ = {h: {r for r in readers if room(r, seed, h) >= delta} for h in (True, False)}
        beside = lambda r, n, high: dict(zip(rest[r][1], rest[r][1][1:]) if high else zip(rest[r][1][1:], rest[r][1])).get(n)
        while True:
            best = {}
            for high in (False, True):
                at = walk[-1] if high else walk[0]
                ways = {v for u, v in edges if u == at} if high else {u for u, v in edges if v == at}
                if len(ways) == 1:
                    best[high] = (float("inf"), *ways)
                for who in (open_[high] & readers, readers):
                    votes = {}
                    for r in who:
                        if (n := beside(r, at, high) if at in rest[r][1] else None) is not None:
                            votes[n] = votes.get(n, 0) + rest[r][0]
                    if votes and high not in best:
                        n = min(votes, key=lambda n: (-votes[n], n))
                        best[high] = (votes[n], n)
            if not best:
                break
            high = max(best, key=lambda h: (best[h][0], not h))
            at, to = walk[-1] if high else walk[0], best[high][1]
            for r in [*open_[high] & readers]:
                n = beside(r, at, high)
                if n is None:
                    open_[high].discard(r)
                elif n != to:
                    readers.discard(r)
                elif room(r, to, high) < delta:
                    open_[high].discard(r)
            walk = [*walk, to] if high else [to, *walk]
        out.append((walk, sum(rest.pop(r)[0] for r in sorted(readers))))
    return out


def distinct(reads):
    out = {}
    for s, ns in reads:
        out[tuple(ns)] = out.get(tuple(ns), 0) + s
    return [(s, list(ns)) for ns, s in sorted(out.items())]


def listed(forms):
    return sorted(forms, key=lambda x: (-x[1], x[0]))


def isoforms(df):
    got = {}
    for x in df.collect():
        got.setdefault(x.cluster, {}).setdefault(x.isoform, []).append((x.pos, x.node, x.support))
    return {c: [([n for _, n, _ in sorted(m)], m[0][2]) for _, m in sorted(forms.items())] for c, forms in got.items()}


def random_reads(rnd, clusters, reads, isoforms):
    rows = {}
    for c in range(clusters):
        forms = [sorted(rnd.sample(range(60), 40)) for _ in range(isoforms)]
        for r in range(reads):
            own = [n for n in rnd.choice(forms) if rnd.random() < (1 if r % 2 else 0.97)]
            rows[c, r] = 1 + rnd.randrange(3), own
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(c, r, s, i + 1, n) for (c, r), (s, ns) in rows.items() for i, n in enumerate(ns)], "cluster int, read int, support long, pos int, node int")


@pytest.mark.parametrize("delta", [0, 3, 6])
def test_decomposition(spark, delta):
    rows = random_reads(random.Random(4), 5, 20, 4)
    got = isoforms(decompose.decompose_paths(frame(spark, rows), ends_delta=delta))
    want = {c: listed(conditioned(distinct([x for (k, _), x in rows.items() if k == c]), delta)) for c in range(5)}
    assert got == want and max(map(len, want.values())) > 3
    assert any(s > 3 for forms in want.values() for _, s in forms)


def test_walks_depend_on_the_readers_they_have():
    # Most paths through 5 come from 0, but those that go on to 8 come from 1: no walk joins 0 and 8.
    reads = [(1, [0, 5, 6, 9])] * 3 + [(1, [1, 5, 6, 8])] * 2 + [(1, [6, 8])] * 3
    assert conditioned(distinct(reads), 0) == [([1, 5, 6, 8], 5), ([0, 5, 6, 9], 3)]
    for k in range(200):
        rnd = random.Random(k)
        reads = distinct([(rnd.randint(1, 3), sorted(rnd.sample(range(9), rnd.randint(1, 6)))) for _ in range(rnd.randint(1, 12))])
        delta = rnd.randint(0, 4)
        got = [(p.tolist(), s) for p, s in decompose.isoforms_of([np.array(n) for _, n in reads], np.array([s for s, _ in reads]), delta)]
        assert got == conditioned(reads, delta), (k, reads, delta)


def test_many_isoforms_in_one_cluster(spark):
    # 500 isoforms: one chunk, then chunks that are merged level by level.
    alone = {(0, r): (1 + r % 3, [r * 10 + k for k in range(6)]) for r in range(500)}
    began = time.time()
    for chunk in (1000, 40):
        got = isoforms(decompose.decompose_paths(frame(spark, alone), ends_delta=2, chunk=chunk))
        assert got == {0: listed([(ns, s) for s, ns in alone.values()])}
    assert time.time() - began < 60


def test_merging_keeps_supports_and_reunites_equal_isoforms(spark):
    rnd = random.Random(5)
    rows = random_reads(rnd, 3, 60, 3)
    for chunk in (7, 200):
        got = isoforms(decompose.decompose_paths(frame(spark, rows), ends_delta=6, chunk=chunk))
        for c in range(3):
            assert sum(s for _, s in got[c]) == sum(s for (k, _), (s, _) in rows.items() if k == c)
            assert len({tuple(p) for p, _ in got[c]}) == len(got[c])
    parts = [(c, k, i, j + 1, n, s) for c in range(3) for k in range(2) for i, (ns, s) in enumerate(listed(conditioned(distinct([x for (q, r), x in rows.items() if q == c and r % 2 == k]), 6))) for j, n in enumerate(ns)]
    out = isoforms(decompose.merge_isoforms(spark.createDataFrame(parts, "cluster int, chunk int, isoform int, pos int, node int, support long"), ends_delta=6))
    for c in range(3):
        both = {}
        for x in parts:
            if x[0] == c:
                both.setdefault((x[1], x[2]), (x[5], []))[1].append(x[4])
        assert out[c] == listed(conditioned(distinct(both.values()), 6))


def test_merging_takes_the_smallest_two_first(spark):
    # Chunks of 1, 1 and 3 paths: the two small ones meet first.
    paths_of = {0: [[1, 2]], 1: [[1, 2]], 2: [[5, 6], [7, 8], [1, 2, 3]]}
    rows = [(0, k, i, j + 1, n, 1) for k, ps in paths_of.items() for i, ns in enumerate(ps) for j, n in enumerate(ns)]
    for turn in ({0: 0, 1: 1, 2: 2}, {0: 2, 1: 0, 2: 1}):
        df = spark.createDataFrame([(c, turn[k], i, j, n, s) for c, k, i, j, n, s in rows], "cluster int, chunk int, isoform int, pos int, node int, support long")
        assert isoforms(decompose.merge_isoforms(df, ends_delta=0)) == {0: [([1, 2, 3], 3), ([5, 6], 1), ([7, 8], 1)]}


def walks_of(reads, tail):
    edge = {}
    for s, ns in reads.values():
        for e in zip(ns, ns[1:]):
            edge[e] = edge.get(e, 0) + s
    seen, out = set(), []
    for first in sorted({ns[0] for _, ns in reads.values()}):
        if first in seen:
            continue
        walk, left, at = [first], None, first
        while (left is None or left < tail) and (ways := [e for e in edge if e[0] == at]):
            at = min(ways, key=lambda e: (-edge[e], e[1]))[1]
            left = (0 if at in seen else None) if left is None else left + 1
            walk.append(at)
        seen |= set(walk)
        out.append(walk)
    return out


def test_walks_and_correction_by_all_of_them(spark):
    rows = random_reads(random.Random(6), 4, 8, 3)
    df = frame(spark, rows)
    walks = paths.greedy_walks(df, tail=3)
    got = {}
    for x in walks.collect():
        got.setdefault((x.cluster, x.source), []).append((x.step, x.node))
    want = {(c, w[0]): w for c in range(4) for w in walks_of({r: x for (k, r), x in rows.items() if k == c}, 3)}
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == want and len(want) > 5
    fixed, flags = decompose.correct_by_walks(df, walks, psi=4, chunk=3)
    mine = {(r.cluster, r.read): r.x for r in fixed.groupBy("cluster", "read").agg(F.array_sort(F.collect_list("node")).alias("x")).collect()}
    told = {(r.cluster, r.read): r.differs for r in flags.collect()}
    for (c, r), (_, ns) in rows.items():
        now, differs = set(ns), True
        for source in sorted(s for k, s in want if k == c):
            out, d = scan(now, set(want[c, source]), 4, False, True)
            now, differs = set(out), differs and d
        assert (mine[c, r], told[c, r]) == (sorted(now), differs)
    assert len(set(told.values())) == 2


def test_layers_of_long_paths_and_circles(spark):
    edges = [(0, k, k + 1) for k in range(3000)] + [(0, 10, 2000), (0, 5, 5000), (0, 5000, 2999), (1, 1, 2)]
    got = {(r.cluster, r.node): r.layer for r in paths.topological_layers(spark.createDataFrame(edges, "cluster int, u long, v long")).collect()}
    assert all(got[0, k] == k for k in range(3001)) and got[0, 5000] == 6 and got[1, 2] == 1
    for circle in ([(0, 1, 2), (0, 2, 3), (0, 3, 1)], [(0, 0, 1), (0, 1, 2), (0, 2, 1), (0, 2, 3)]):
        with pytest.raises(ValueError):
            paths.topological_layers(spark.createDataFrame(circle, "cluster int, u long, v long"))


def test_layers_of_many_bubbles(spark):
    # 10,000 bubbles in a row, ways of one and of two nodes; bubbles inside bubbles; a grid, which has no node with one way in inside.
    row = [(0, *e) for k in range(10_000) for e in ((k * 4, k * 4 + 1), (k * 4, k * 4 + 2), (k * 4 + 2, k * 4 + 3), (k * 4 + 1, k * 4 + 4), (k * 4 + 3, k * 4 + 4))]
    grid = [(1, *e) for i in range(7) for j in range(7) for e in ((i * 8 + j, i * 8 + j + 1), (i * 8 + j, i * 8 + j + 8))]
    rounds = []
    real = paths.materialise
    try:
        paths.materialise = lambda df, name: rounds.append(name) or real(df, name)
        got = {(r.cluster, r.node): r.layer for r in paths.topological_layers(spark.createDataFrame(row + grid, "cluster int, u long, v long")).collect()}
    finally:
        paths.materialise = real
    assert all(got[0, k * 4] == k * 3 and got[0, k * 4 + 1] == k * 3 + 1 and got[0, k * 4 + 3] == k * 3 + 2 for k in range(10_000)) and got[0, 40_000] == 30_000
    assert all(got[1, i * 8 + j] == i + j for i in range(7) for j in range(7))
    assert rounds.count("single") < 32 and rounds.count("roots") < 90 and rounds.count("layers") < 20


def test_maxima_across_bins(spark):
    rnd = random.Random(10)
    # One group over several bins of 16,384 positions, with a peak on either side of an edge.
    at = sorted({16383, 16384, 32768, *(p for p in range(15_000, 34_000, 9) if rnd.random() < 0.9)})
    sites = {p: rnd.randint(1, 5) for p in at} | {16383: 60, 16384: 61, 32768: 90}
    got = sorted(r.pos for r in clusters.kde_maxima(spark.createDataFrame([("c", p, n) for p, n in sites.items()], "contig string, pos long, weight int"), gap=40).collect())
    density = {}
    for p, n in sites.items():
        for c in range(max(at[0], p - 30), min(at[-1], p + 30) + 1):
            density[c] = density.get(c, 0) + n * math.exp(-((p - c) ** 2) / 200)
    density = {c: round(d, 9) for c, d in density.items()}
    assert got == [c for c, d in sorted(density.items()) if d > density.get(c - 1, 0) and d > density.get(c + 1, 0)]


def test_chunks_of_a_hot_cluster(spark):
    rows = [(0, f"r{k:05d}") for k in range(5000)] + [(c, f"r{k}") for c in (1, 2) for k in range(c)]
    df = spark.createDataFrame(rows, "cluster int, read_id string").repartition(7)
    number = {(c, r): k for c in range(3) for k, r in enumerate(sorted(r for x, r in rows if x == c))}
    assert {(r.cluster, r.read_id): r.chunk for r in transcripts.chunk_blocks(df, "cluster", "read_id", 300).collect()} == {x: k // 300 for x, k in number.items()}
    chunks = {0: 17, 1: 1, 2: 1}
    assert {(r.cluster, r.read_id): r.chunk for r in transcripts.chunk_strided(df, "cluster", "read_id", 300).collect()} == {x: k % chunks[x[0]] for x, k in number.items()}


def trimmed(ops, text):
    """Operations from the first to the last match, with the read's bases between them; where they begin on the backbone."""
    same = [k for k, (_, op) in enumerate(ops) if op == "="]
    if not same:
        return 0, [], ""
    width = lambda part, kinds: sum(n for n, op in part if op in kinds)
    lo, hi = same[0], same[-1] + 1
    return width(ops[:lo], "=XD"), ops[lo:hi], text[width(ops[:lo], "=XIS") : width(ops[:hi], "=XIS")]


def nodes_of(start, ops, text):
    """The nodes of a read, = (p, 0, ""), X (p, 1, c), I (p, 2, (text, k)), with its letters."""
    r, q, nodes = start, 0, []
    for n, op in ops:
        piece = text[q : q + n] if op != "D" else ""
        nodes += [((r + k, 0, ""), piece[k]) for k in range(n)] if op == "=" else [((r + k, 1, piece[k]), piece[k]) for k in range(n)] if op == "X" else [((r - 1, 2, (piece, k)), piece[k]) for k in range(n)] if op == "I" else []
        r, q = r + (n if op in "=XD" else 0), q + (n if op in "=XIS" else 0)
    return nodes


def polished_nodes(seq, reads, weight, psi):
    """Node by node: the graph as a table, the walk, the merge. (nodes, steps of short reads)."""
    edge, short = {}, set()
    name = lambda p: (p, 0, "")
    for p in range(len(seq) - 1):
        edge[name(p), name(p + 1)] = 1
    for start, ops, text in reads:
        ahead, ops, text = trimmed(ops, text)
        nodes = nodes_of(start + ahead, ops, text)
        if any(c == "N" and n[1] for n, c in nodes):
            continue
        nodes = [n for n, _ in nodes]
        for e in zip(nodes, nodes[1:]):
            edge[e] = edge.get(e, 0) + weight
            short.add(e)
    order = lambda n: (n[0], n[1], str(n[2]) if n[1] < 2 else n[2][0] + ":" + f"{n[2][1]:05d}")
    walk = [name(0)]
    out = {}
    for (u, v), w in edge.items():
        out.setdefault(u, []).append((-w, order(v), v))
    while walk[-1] in out:
        walk.append(min(out[walk[-1]])[2])
    rank = {n: k for k, n in enumerate(sorted({*walk, *map(name, range(len(seq)))}, key=order))}
    kept, _ = scan({rank[name(p)] for p in range(len(seq))}, {rank[n] for n in walk}, psi, False, True)
    return [n for n in sorted(rank, key=rank.get) if rank[n] in set(kept)], short


def polished(seq, reads, weight, psi, tolerance):
    nodes, short = polished_nodes(seq, reads, weight, psi)
    letters = "".join(seq[n[0]] if n[1] == 0 else n[2] if n[1] == 1 else n[2][0][n[2][1]] for n in nodes)
    ok = all((nodes[k - 1], nodes[k]) in short for k in range(max(tolerance, 1), len(nodes) - tolerance))
    return letters, ok


def settled(seq, reads, weight, psi, tolerance, rounds):
    """(sequence, check, round): polish, lay the reads on the new backbone by the nodes they share with it, again."""
    for k in range(1, rounds + 1):
        nodes, _ = polished_nodes(seq, reads, weight, psi)
        new, _ = polished(seq, reads, weight, psi, tolerance)
        place, moved = {n: p for p, n in enumerate(nodes)}, []
        if new != seq:
            for start, ops, text in reads:
                row = [(c, place.get(n)) for n, c in nodes_of(start, ops, text)]
                while row and row[0][1] is None:
                    row.pop(0)
                while row and row[-1][1] is None:
                    row.pop()
                steps, now, other = "", row[0][1] if row else 0, []
                for c, at in row:
                    if at is None:
                        other.append(c)
                        continue
                    for p in range(now, at):
                        steps += ("=" if other[0] == new[p] else "X") if other else "D"
                        other = other[1:]
                    steps += "I" * len(other) + "="
                    now, other = at + 1, []
                if row:
                    # Of one gap, insertions come before deletions are known; both never happen together.
                    moved.append((row[0][1], [(len(x.group()), x.group()[0]) for x in re.finditer(r"=+|X+|I+|D+", steps)], "".join(c for c, _ in row)))
            reads = moved
        seq, same = new, new == seq
        if same:
            break
    steps = set()
    for start, ops, text in reads:
        ahead, ops, text = trimmed(ops, text)
        row = nodes_of(start + ahead, ops, text)
        if not any(c == "N" and n[1] for n, c in row):
            steps |= set(zip([n for n, _ in row], [n for n, _ in row][1:]))
    ok = all(((p - 1, 0, ""), (p, 0, "")) in steps for p in range(max(tolerance, 1), len(seq) - tolerance))
    return seq, ok, k


def polish_case():
    rnd = random.Random(7)
    backbones, reads, rid = [], [], 0
    for ref in range(12):
        seq = "".join(rnd.choices("ACGT", k=rnd.choice([1, 30, 90, 160])))
        backbones.append((ref, seq))
        variants = {}  # the same way off at the same place, for some reads
        for _ in range(60 if len(seq) > 30 else 0):
            at, start, ops, text = 0, rnd.randrange(len(seq) - 20), [], ""
            at = start
            for _ in range(rnd.randint(1, 3)):
                n = 8 - at % 8
                if at + n + 14 >= len(seq):
                    break
                ops.append((n, "="))
                text += seq[at : at + n]
                at += n
                kind = variants.setdefault(at, rnd.choice(["X", "I", "D", "XI", "DI", "", ""]))
                for op in kind:
                    m = 1 + at % 3 if op != "I" else 1 + at % 6
                    ops.append((m, op))
                    if op == "X":
                        text += "".join("CGTA"["ACGT".index(c)] for c in seq[at : at + m])
                    if op == "I":
                        text += ("GATTACA" * 2)[at % 5 : at % 5 + m]
                    at += m if op != "I" else 0
            n = rnd.randint(1, len(seq) - at) if len(seq) - at < 12 else rnd.randint(1, 12)
            ops.append((n, "="))
            text += seq[at : at + n]
            if rnd.random() < 0.3:  # clipped and ragged ends
                lead = rnd.choice([[(2, "S")], [(1, "S"), (2, "I")], [(1, "X")] if start else [], [(1, "D"), (1, "X")] if start > 1 else []])
                tail = rnd.choice([[(1, "I"), (2, "S")], [(2, "S")], [(1, "D")], []])
                width = lambda part, kinds: sum(n for n, op in part if op in kinds)
                start -= width(lead, "XD")
                text = "N" * width(lead, "SXI") + text + "N" * width(tail, "SI")
                ops = [*lead, *ops, *tail]
            reads.append((rid := rid + 1, ref, start, ops, text))
        if len(seq) > 30:  # no match at all
            reads.append((rid := rid + 1, ref, 3, [(4, "X"), (1, "I")], "ACGTA"))
    return backbones, reads


def polish_frames(spark, backbones, reads):
    aln = spark.createDataFrame([(i, ref, start, "".join(f"{n}{op}" for n, op in ops), text) for i, ref, start, ops, text in reads], "rid long, ref int, start int, cigar string, seq string")
    return spark.createDataFrame(backbones, "ref int, seq string"), aln


def test_polish(spark):
    backbones, reads = polish_case()
    back, aln = polish_frames(spark, backbones, reads)
    changed = checked = 0
    for weight, psi, tolerance in ((10, 35, 10), (1, 4, 20)):
        got = {r.ref: (r.seq, r.ok) for r in pileup.polish_linear(back, aln, weight, psi, tolerance, stringent=False).collect()}
        for ref, seq in backbones:
            want = polished(seq, [(s, o, t) for _, x, s, o, t in reads if x == ref], weight, psi, tolerance)
            assert got[ref] == want, (ref, psi)
            changed += want[0] != seq
            checked += not want[1]
    assert changed > 8 and checked > 0
    assert {r.ref for r in pileup.polish_linear(back, aln, tolerance=10).collect()} == {ref for ref, (_, ok) in ((r, polished(s, [(b, o, t) for _, x, b, o, t in reads if x == r], 10, 35, 10)) for r, s in backbones) if ok}


def test_polishing_until_nothing_changes(spark):
    backbones, reads = polish_case()
    back, aln = polish_frames(spark, backbones, reads)
    for weight, psi, tolerance, rounds in ((10, 35, 10, 6), (1, 4, 20, 2)):
        got = {r.ref: (r.seq, r.ok, r.iteration) for r in pileup.iterate_polish(back, aln, rounds, weight, psi, tolerance).collect()}
        want = {ref: settled(seq, [(s, o, t) for _, x, s, o, t in reads if x == ref], weight, psi, tolerance, rounds) for ref, seq in backbones}
        assert got == want
    assert max(k for _, _, k in want.values()) == 2


def test_insertions_of_all_reads_are_taken_up(spark):
    seq = "ACGTTGCAACGTGGCA" * 2
    aln = spark.createDataFrame([(k, 0, 4, "6=2I6=", seq[4:10] + "TT" + seq[10:16]) for k in range(20)] + [(99, 0, 4, "6=2I6=", seq[4:10] + "NN" + seq[10:16])], "rid long, ref int, start int, cigar string, seq string")
    got = pileup.polish_linear(spark.createDataFrame([(0, seq)], "ref int, seq string"), aln, stringent=False).first()
    assert got.seq == seq[:10] + "TT" + seq[10:]


def test_islands_over_many_bins(spark):
    rnd = random.Random(8)
    rows = sorted({(rnd.randrange(400_000), rnd.choice([3, 50, 90_000])) for _ in range(900)})
    ivs = [("c", "+", s, s + n) for s, n in rows]
    got = {(r.start, r.end): r.island for r in clusters.overlap_clusters(spark.createDataFrame(ivs, "contig string, strand string, start long, end long")).collect()}
    island, reach = 0, -1
    for _, _, s, e in sorted(ivs):
        island, reach = island + (s > reach), max(reach, e)
        assert got[s, e] == island
    sites = sorted({rnd.randrange(300_000) for _ in range(4000)})
    got = {r.pos: r.grp for r in clusters.group_sites(spark.createDataFrame([("c", p, 1) for p in sites], "contig string, pos long, weight int"), gap=60).collect()}
    group = 0
    for a, b in zip([sites[0], *sites], sites):
        group += b - a > 60
        assert got[b] == group
    ranks = clusters.sort_unspliced(spark.createDataFrame(ivs, "contig string, strand string, start long, end long")).collect()
    assert {(r.start, r.end): r.rank for r in ranks} == {x[2:]: k + 1 for k, x in enumerate(sorted(ivs))}


def test_iteration_freezes_settled_clusters(spark):
    state = spark.createDataFrame([("a", 3), ("b", 1), ("c", 9)], "k string, n int")
    out = pileup.iterate_until_stable(state, lambda d: d.select("k", F.greatest(F.lit(0), F.col("n") - 1).alias("n")), "k", max_iterations=5)
    assert sorted(tuple(r) for r in out.collect()) == [("a", 0, 4), ("b", 0, 2), ("c", 4, 5)]


def test_components(spark):
    rnd = random.Random(9)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1200)] + [(2000, k) for k in range(2001, 2300)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    got = components.connected_components(spark.createDataFrame([*edges, (None, 1)], "u long, v long"))
    assert {r.node: r.component for r in got.collect()} == {x: find(x) for x in parent}


def test_sequences(spark):
    df = spark.createDataFrame([("AAAA", "CCATGAAATGA"), ("ATGATG", "ATGTTTTAA"), ("", "ATGCCC")], "a string, b string")
    got = S.once(df.withColumn("x", S.find_all(F.col("a"), "AA")), o=S.longest_orf(F.col("b"))).select("x", "o", S.find_all(F.lit("a.b.."), ".").alias("dots"), S.rev_comp(F.lit("ACGU")).alias("r"), S.wrap_sequence(F.lit("abcdef"), 3).alias("w")).collect()
    assert [r.x for r in got] == [[0, 1, 2], [], []] and {r.r for r in got} == {"ACGT"} and {r.w for r in got} == {"abc\ndef"}
    assert [tuple(r.o) for r in got] == [("MK", 2), ("MF", 0), ("", -1)] and got[0].dots == [1, 3, 4]
    rnd = random.Random(3)
    values = [[rnd.randrange(9) for _ in range(n)] for n in (0, 1, 63, 64, 65, 1000)]
    sums = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v array<int>").select("k", S.sums_before(F.col("v")).alias("s")).collect()
    assert {r.k: r.s for r in sums} == {k: [sum(v[:i]) for i in range(len(v))] for k, v in enumerate(values)}


def test_repeated_attributes(spark):
    rows = spark.createDataFrame([('gene_id "a"; tag "basic"; tag "CCDS"; note "x y";',), ("",), (None,), ("flag; k \"v\"",)], "t string")
    got = [r.x for r in rows.select(S.parse_attributes(F.col("t")).alias("x")).collect()]
    assert got == [{"gene_id": "a", "tag": "CCDS", "note": "x"}, {}, None, {"flag": "", "k": "v"}]


def test_rejected_introns(spark):
    exons = spark.createDataFrame([(1, "a", "+", 1, 0, 5), (1, "b", "+", 2, 9, 12), (1, "b", "+", 3, 20, 22)], "tx int, chr string, strand string, n int, s int, e int")
    good, bad = I.exons_to_introns(exons)
    assert [tuple(r) for r in good.collect()] == [(1, "b", "+", 12, 20)] and [tuple(r) for r in bad.collect()] == [(1, "b", "a")]
