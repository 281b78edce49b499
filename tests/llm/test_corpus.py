"""Substring dedup, mixing, quality and the pipeline against plain restatements."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from isoloom.llm import mixing, quality, queries, secrets, simhash, substrings

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---- substrings


def cut(rows, window):
    starts = {}
    for i, t in rows:
        if i is not None:
            w = words(t)
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                starts[key] = min(i, starts.get(key, i))
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - window + 1):
            if i is not None and starts[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [6, 50])
def test_substrings(spark, window):
    rnd = random.Random(window)
    vocabulary = ["é", "la", "x1", "Y", "zz,", "it", " q"]
    passages = [" ".join(rnd.choices(vocabulary, k=rnd.randint(window - 1, 3 * window))) for _ in range(6)]
    texts = [None, "", " \t", "one", passages[0], passages[0] + " ", "con " * (4 * window), "con " * (6 * window)]
    for _ in range(60):
        parts = [rnd.choice(passages) if rnd.random() < 0.5 else " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 2 * window))) for _ in range(rnd.randint(1, 6))]
        texts.append("\n".join(parts))
    texts += texts[8:20]
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts)] + [(None, texts[10]), (8 * 7 % 101, texts[8]), (9 * 7 % 101, passages[1])]
    docs = spark.createDataFrame([(*r, "c", "k") for r in rows], "doc_id long, text string, copy string, sha string")
    got = sorted(map(tuple, substrings.dedup(docs, window, seed_words=min(16, window - 2)).collect()), key=str)
    assert got == cut(rows, window)


def test_substrings_empty(spark):
    assert substrings.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- mixing


def level(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = dict(zip(order, [weights[k % 3] for k in range(len(order))], strict=True))
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join("w" * rnd.randint(0, 400)), rnd.choice(["b", "b", "b", "a", "é", "z", None, "c", "tiny"])) for i in range(400)]
    rows += [(900, None, "b"), (901, "", "none"), (902, "x " * 20_000, "a"), (902, "x " * 20_000, "a"), (None, "y y y", "z")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = level(dict(sizes))
    runs = [sorted(map(tuple, mixing.mix(d, block=64, group_words=9000).collect()), key=str) for d in (docs, docs.repartition(5))]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    taken, source = Counter(), {i: s for i, _, s in rows}
    for i, size, source_size, target, took in runs[0]:
        assert source_size == sizes[source[i]] and abs(target - want[source[i]]) < 1e-6 * max(1, target)
        assert 0 <= took <= 2 * size
        taken[source[i]] += took
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1


def test_permutations_are_permutations():
    for n in (1, 2, 3, 64, 65, 1000):
        j = np.arange(n, dtype=np.uint64)
        out = mixing.permuted(j, np.full(n, n, np.uint64), np.full(n, 12345, np.uint64))
        assert sorted(out.tolist()) == list(range(n))


def test_slots_meet_targets_and_shards_share_them(spark):
    kind = "source string, source_size long, target double"
    goals = spark.createDataFrame([("a", 100_000, 150_000.0), ("b", 30_000, 60_000.0), (None, 5, 7.5), ("e", 0, 0.0), ("c", 7000, 13_990.0)], kind)
    sizes = spark.createDataFrame([(i, s, n, i) for s, parts in (("a", [100] * 1000), ("b", [30_000]), (None, [5]), ("e", [0]), ("c", [7] * 1000)) for i, n in enumerate(parts)], "doc_id long, source string, size long, text_key long")
    blocks, plan = mixing.block_index(sizes, goals, block=64, group_words=3000)
    index = {((None if r.absent else r.name), r["index"]): r.n for r in blocks.collect()}
    for source, size in (("a", 100_000), ("b", 30_000), (None, 5), ("c", 7000)):
        own = [index[source, k] for k in range(sum(x == source for x, _ in index))]  # numbered without gaps, whole ones first
        assert sum(own) == size and own == [n for n in own if n == 64] + [n for n in own if n < 64]
    got = [(None if r.absent else r.name, r["pass"], r["index"], r.n_words, r.shard, r.pos) for r in mixing.slots(blocks, plan, block=64, shard_slots=100).collect()]
    per = Counter()
    for r in got:
        per[r[0]] += r[3]
    assert per == {"a": 150_000, "b": 60_000, None: 8, "c": 13_990}
    shards = Counter(r[4] for r in got)
    assert len(shards) > 20 and max(shards.values()) < 180
    assert {s: sorted(r[5] for r in got if r[4] == s) for s in shards} == {s: list(range(n)) for s, n in shards.items()}
    assert max(Counter(r[:3] for r in got).values()) == 1
    cut = Counter(r[0] for r in got if r[3] < index[r[0], r[2]])
    assert max(cut.values()) == 1  # only the last slot of a source is cut


def test_mix_is_written_as_shards(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(i, " \n".join(f"w{i}.{k}" for k in range(rnd.randint(0, 150))), rnd.choice(["a", "a", "b", None])) for i in range(120)] + [(500, "é z", "b")] * 2 + [(None, "q q q", "a")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, group int, size int")
    source, texts = {w: s for _, t, s in rows for w in words(t)}, {i: words(t) for i, t, _ in rows}
    for group_words, path in ((1 << 20, str(tmp_path / "one")), (1500, str(tmp_path / "several"))):
        got = mixing.mix(docs, block=32, path=path, group_words=group_words).collect()
        seen, blocks = Counter(), {}
        mixed = mixing.read_words(spark.read.parquet(path)).collect()
        for r in mixed:
            ws = r.words.split(" ")
            assert len(ws) == r.n_words == sum(x.n for x in r.spans) <= 32 and all(source[w] == r.source for w in ws)
            for x in r.spans:  # the span's words stand in its document in that order
                part, own = ws[x["first"] : x["first"] + x.n], texts[x.doc_id]
                assert any(own[k : k + x.n] == part for k in range(len(own)))
            seen.update(ws)
            blocks[r.source, r.block] = max(blocks.get((r.source, r.block), []), ws, key=len)
        lines = {s: Counter(w for _, t, x in rows if x == s for w in words(t)) for s in ("a", "b", None)}
        for s, line in lines.items():  # a source's blocks together are all its words, if they are all read
            whole = Counter(w for (x, _), k in blocks.items() if x == s for w in k)
            assert whole <= line and (sum(whole.values()) < sum(line.values()) or whole == line)
        assert sorted(r.pos for r in mixed if r.shard == 0) == list(range(sum(r.shard == 0 for r in mixed)))
        taken = Counter()
        for r in got:
            taken[r.doc_id] += r.taken
        for i, t, _ in rows:
            assert taken[i] == sum(seen[w] for w in set(words(t)))
        assert len(got) == len(rows) and all(r.taken <= 2 * r.size for r in got)


def test_mixing_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


# ---- quality


def test_quality_on_held_out_rows(spark):
    got = queries.op3_quality(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in got) / len(got)
    good = [r for r in got if r.quality == 1]
    assert len(got) > 500 and right > 0.98 and sum(r.predicted for r in good) / len(good) > 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 4), (None, "a b", 5), (3, "x " * 50_000, 6), (3, "x " * 50_000, 6)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score(docs, quality.train(docs, none)).collect()
    assert len(got) == 5 and all(r.score == 0.5 and r.predicted == 0 for r in got)
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (3, None), (None, 1), (2, 7)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {(r.doc_id, r.score) for r in quality.score(docs, model).collect() if r.doc_id in (1, 2)}
    assert {s for _, s in got} == {model.prior}
    assert quality.score(docs.limit(0), model).count() == 0


def test_scores_are_votes_of_the_nearest():
    rng = np.random.default_rng(0)
    x = np.abs(rng.normal(size=(60, quality.TERMS))).astype(np.float32)
    labels = rng.integers(0, 2, 60).astype(float)
    m = quality.fit(x, labels, latent=8, neighbours=5)
    y = m.latent(x[:10])
    for k, s in enumerate(m.scores(x[:10])):
        cosine = m.vectors @ y[k]
        near = np.argsort(-cosine, kind="stable")[:5]
        w = np.maximum(cosine[near], 1e-6).astype(float) ** 8
        assert abs(s - (w * labels[near]).sum() / w.sum()) < 1e-6


def plain_terms(text):
    """Terms gram by gram, with the fixed numbers of bytes and classes."""
    data, odd, mask = (text or "").encode(), 0x9E3779B97F4A7C15, (1 << 64) - 1
    out = []
    for values, n, size in ((quality._CLASS, 4, 1024), (quality._BYTE, 3, 512)):
        own, counts = [int(values[b]) for b in data], [0.0] * size
        for i in range(len(own) - n + 1):
            h = 0
            for v in own[i : i + n]:
                h = (h * odd + v) & mask
            counts[(h * odd & mask) >> 40 & size - 1] += 1
        out.append([math.sqrt(c) for c in counts])
    ws, repeats = data.split(), [0.0] * 16
    if len(ws) > 1:
        repeats[min(7, int(sum(x == y for x, y in zip(ws, ws[1:])) / (len(ws) - 1) * 16))] = 1.0
        repeats[8 + min(7, int(math.log1p(len(set(ws))) / math.log1p(len(ws)) * 8))] = 1.0
    norm = lambda g: math.sqrt(sum(x * x for x in g)) or 1.0
    return [x / norm(g) for g in (*out, repeats) for x in g]


def plain_scores(docs, labels):
    """Scores of documents {id: text} by their nearest labelled neighbours, all in doubles and one by one."""
    learnt = sorted(i for i in labels if i in docs and zlib.crc32(str(i).encode()) % 4 != 2)
    x = np.array([plain_terms(docs[i]) for i in learnt])
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1
    _, _, vt = np.linalg.svd(x * idf, full_matrices=False)
    project = vt[:32].T
    unit = lambda y: y / max(math.sqrt((y * y).sum()), 1e-12)
    known = [(unit((row * idf) @ project), labels[i]) for row, i in zip(x, learnt, strict=True)]
    out = {}
    for i, t in docs.items():
        mine = unit((np.array(plain_terms(t)) * idf) @ project)
        near = sorted(((float(mine @ v), q) for v, q in known), reverse=True)[:15]
        out[i] = sum(max(c, 1e-6) ** 8 * q for c, q in near) / sum(max(c, 1e-6) ** 8 for c, _ in near) if t else sum(q for _, q in known) / len(known)
    return out


def test_quality_against_plain_neighbours(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r.doc_id: r.score for r in queries.op3_quality(spark, SF).collect()}
    want = plain_scores(docs, labels)
    off = [i for i in want if abs(got[i] - want[i]) > 2e-3]
    assert set(got) == set(want) and len(off) <= len(want) // 50  # neighbours as near as one another may differ


# ---- pipeline


def plain_fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(items, linked):
    parent = {i: i for i in items}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in items:
        for b in items:
            if a < b and linked(items[a], items[b]):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {i: find(i) for i in items}


def shingle_set(text):
    ws = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    texts, stages = {i: r.text for i, r in rows.items()}, dict(corpus_pipeline.STAGES)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = stages["quality"](spark, docs, SF)
    scores, kept = plain_scores(texts, labels), {r.doc_id for r in good.collect()}
    wrong = kept ^ {i for i, s in scores.items() if s >= 0.7}
    assert good.columns == columns and all(abs(scores[i] - 0.7) < 0.1 for i in wrong) and len(wrong) < 3 and 50 < len(kept) < len(rows)
    one = stages["near duplicates"](spark, good, SF)
    parts = groups({i: plain_fingerprint(texts[i]) for i in kept}, lambda a, b: (a ^ b).bit_count() <= 4)
    assert one.columns == columns and {r.doc_id for r in one.collect()} == set(parts.values()) and len(set(parts.values())) < len(kept)
    kept = set(parts.values())
    clean = stages["benchmark"](spark, one, SF)
    items = [s for s in (shingle_set(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()) if s]
    left = {i for i in kept if not any(len(q & (own := shingle_set(texts[i]))) >= 0.8 * len(q) - 1e-9 for q in items)}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == left and len(left) < len(kept)
    safe = stages["secrets"](spark, clean, SF)
    got = {r.doc_id: r for r in safe.collect()}
    assert safe.columns == columns and set(got) == left
    base = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}|AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}""", re.A)
    for i, r in got.items():
        assert not base.search(r.text) and r.n_chars == len(r.text) and (r.text == texts[i] or base.search(texts[i]) or secrets.Scanner().spans(texts[i]))
    last = sorted(map(tuple, stages["mixing"](spark, safe, SF).collect()))
    sizes = Counter()
    for r in got.values():
        sizes[r.source] += len(words(r.text))
    goals = level(dict(sizes))
    taken = Counter()
    for i, size, source_size, target, took in last:
        assert (size, source_size) == (len(words(got[i].text)), sizes[got[i].source]) and abs(target - goals[got[i].source]) < 1e-6 * target + 1e-6 and took <= 2 * size
        taken[got[i].source] += took
    assert {r[0] for r in last} == left and all(abs(taken[s] - goals[s]) <= 1 for s in sizes)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == last


def test_pipeline_on_odd_tables(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long, score string, copies int"
    rows = [(1, None, None, None, None, "x", 1), (None, "a b c d e f", "en", "s", 11, None, 2), (None, "a b c d e f", "en", "s", 11, None, 2), (2, "", "en", "s", 0, "", 3), (3, "long " * 30_000, "en", None, 150_000, "", 4), (3, "long " * 30_000, "en", None, 150_000, "", 4)]
    empty = {"labels": "doc_id long, quality int", "benchmark": "item_id long, text string"}
    for name, some in (("odd", rows), ("none", [])):
        sf = f"{tmp_path}/{name}"
        spark.createDataFrame(some, kind).write.parquet(f"{sf}/documents.parquet")
        for t, k in empty.items():
            spark.createDataFrame([], k).write.parquet(f"{sf}/{t}.parquet")
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        assert corpus_pipeline.run(spark, sf).count() == 0  # without labels nothing is known to be good
        for stage, f in corpus_pipeline.STAGES[1:4]:
            out = f(spark, docs, sf)
            assert out.columns == docs.columns
            # Null and empty texts share a fingerprint, and so do the texts of one repeated word with theirs; the smallest doc_id of each stays.
            want = [1, 3, None] if stage == "near duplicates" else [x[0] for x in some]
            assert sorted((r.doc_id for r in out.collect()), key=str) == sorted(want if some else [], key=str), stage
        assert dict(corpus_pipeline.STAGES)["benchmark"](spark, docs, sf).count() == len(some) == dict(corpus_pipeline.STAGES)["secrets"](spark, docs, sf).count()
        mixed = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, sf)
        assert mixed.columns == ["doc_id", "size", "source_size", "target", "taken"] and mixed.count() == len(some)


def test_keep_one_with_repeats_and_missing_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "x"), (1, "a b c d e", "x"), (2, "a b c d e", "y"), (None, "a b c d e", "z"), (None, "only here q r s", "z"), (7, None, None)], "doc_id long, text string, component_id string")
    got = sorted((tuple(r) for r in simhash.keep_one(docs).collect()), key=str)
    assert got == sorted([(1, "a b c d e", "x"), (None, "only here q r s", "z"), (7, None, None)], key=str)
    assert simhash.keep_one(docs.limit(0)).count() == 0


# ---- paths of the De Bruijn graph


def unitigs(edges):
    """Maximal nonbranching paths of distinct edges (u, v, name), circles cut anywhere, walked edge by edge."""
    out, into = {}, {}
    for e in edges:
        out.setdefault(e[0], []).append(e)
        into.setdefault(e[1], []).append(e)
    through = lambda n: len(out.get(n, [])) == 1 == len(into.get(n, []))
    paths, used = [], set()
    for e in [e for e in edges if not through(e[0])] + list(edges):
        if e in used:
            continue
        path = [e]
        used.add(e)
        while through(path[-1][1]) and (f := out[path[-1][1]][0]) not in used:
            used.add(f)
            path.append(f)
        paths.append(path)
    return paths


def test_paths_are_maximal_and_unbranched(spark):
    rnd = random.Random(12)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(5, 60))) for _ in range(30)]
    texts += ["".join(t[k:] for t, k in zip(rnd.choices(texts, k=3), rnd.choices(range(20), k=3), strict=True)) for _ in range(60)]
    texts += ["abcde" * 9, "cdeab" * 7, "z" * 12, "y" * 9 + "z" * 12]
    first = {}
    for d, t in enumerate(texts):
        for k in range(len(t) - 3):
            first.setdefault(t[k : k + 4], (d, k))
    number = {n: k for k, n in enumerate(sorted({x for w in first for x in (w[:3], w[1:])}))}
    rows = [(number[w[:3]], number[w[1:]], hash(w) % 1000, d, k) for w, (d, k) in first.items()]
    name = {(u, v, x): (u, v, x) for u, v, x, _, _ in rows}
    assert len(name) == len(rows)
    got = {}
    for r in substrings.compact(spark.createDataFrame(rows, "u long, v long, x int, source long, source_at long")).collect():
        got.setdefault(r.path, []).append((r.step, (r.u, r.v, r.x)))
    assert sum(map(len, got.values())) == len(rows)
    for p in got.values():
        assert sorted(s for s, _ in p) == list(range(len(p)))
    mine = {tuple(e for _, e in sorted(p)) for p in got.values()}
    want = unitigs(sorted(name))
    circles = {e for p in want if p[0][0] == p[-1][1] for e in p}
    assert {p for p in mine if not set(p) & circles} == {tuple(p) for p in want if not set(p) & circles}
    for p in mine:  # also circles are walked in order, along nodes passed through
        assert all(a[1] == b[0] for a, b in zip(p, p[1:], strict=False))
    assert len(mine) < len(rows) / 2 and any(len(p) > 10 for p in mine) and circles
