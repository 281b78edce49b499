"""Fingerprints against a bit-by-bit count, links and components against all pairs."""

import random
import re

import xxhash
from pyspark.sql import functions as F

from isoloom.llm import simhash


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hs) * 2 > len(hs))


def components(ids_prints, bits):
    parent = {i: i for i, _ in ids_prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(ids_prints):
        for b, y in ids_prints[:k]:
            if (x ^ y).bit_count() <= bits:
                a_, b_ = sorted((find(a), find(b)))
                parent[b_] = a_
    return {i: find(i) for i in parent}


def test_fingerprints_and_components(spark):
    rnd = random.Random(5)
    vocabulary = [f"Wört{i}" for i in range(60)] + ["A", "b", "c"]
    texts = [None, "", " \n", "one", "One TWO", "a b c d"] + [" ".join(rnd.choices(vocabulary, k=rnd.randint(1, 80))) for _ in range(60)]
    texts += [t + " x" for t in texts[6:40]] + texts[6:12] + [" ".join(rnd.choices(vocabulary, k=40_000))]
    rows = [(i * 3 + 1, t, "extra") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    want = {i: slow_fingerprint(t) for i, t, _ in rows}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == want
    assert {i: r.component_id for i, r in got.items()} == components(sorted(want.items()), 4)


def test_links_of_dense_groups_over_many_blocks(spark):
    rnd = random.Random(7)
    base = [rnd.getrandbits(64) for _ in range(30)]
    prints = {b for b in base}
    for b in base[:4]:
        x = b
        for _ in range(120):  # chains and clouds
            x ^= 1 << rnd.randrange(64)
            prints |= {x, b ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64))}
    rows = sorted(enumerate(sorted(prints)))
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in rows]
    frame = spark.createDataFrame(signed, "rep long, fp long")
    for block in (16, 1024):
        found = simhash.connected_components(simhash.links(frame, block=block))
        got = {i: i for i, _ in rows} | {r.node: r.component for r in found.collect()}
        assert got == components(rows, 4)


def test_empty_repeated_and_missing_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (4, "z")], "doc_id long, text string")
    got = sorted(simhash.near_duplicates(docs).select(F.coalesce("doc_id", F.lit(-1)), "component_id").collect())
    assert [tuple(r) for r in got] == [(-1, 1), (1, 1), (1, 1), (4, 4)]
