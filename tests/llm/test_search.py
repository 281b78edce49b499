"""Ranked search against plain scores, the graph of shared term sets against the items."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from isoloom.llm import queries, search

SF = "/root/testdata/sf0.001"


def terms(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain(docs, items, best=10):
    said = [(i, terms(t)) for i, t, *_ in docs]
    n_docs, all_terms = sum(bool(w) for _, w in said), sum(len(w) for _, w in said)
    df = Counter(t for _, w in said for t in set(w))
    out = []
    for item in {i for i, *_ in items}:
        asked = Counter(x for i, t, *_ in items if i == item for x in terms(t))
        ranked = []
        for i, w in said:
            tf, score = Counter(w), 0
            m = 25 + (75 * len(w) * n_docs) // all_terms if all_terms else 0
            for t, q in asked.items():
                if tf[t]:
                    score += q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                ranked.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(ranked)[:best])]
    return sorted(out, key=str)


def odd_tables():
    rnd = random.Random(12)
    vocabulary = [f"wörd{i}" for i in range(40)] + ["The", "OF", "İd", "naïve", "x9"]
    text = lambda most: rnd.choice([" ", ", ", "\n", "\x00"]).join(rnd.choices(vocabulary, k=rnd.randint(1, most)))
    docs = [(rnd.randint(0, 250), text(60), "n") for _ in range(300)] + [(None, "the of the", ""), (None, None, ""), (5, "", ""), (6, " \t-", ""), (7, "the " * 50_000, "")]
    docs += [(8, "one copy of it", "")] * 30
    items = [(i, text(25), "n") for i in range(30)] + [(3, "the of", ""), (None, "copy copy copy of", ""), (40, None, ""), (41, "!?", ""), (42, "nowhere", ""), (43, "copy of", ""), (43, "copy of", "")]
    return docs, items


def test_against_plain_scores_in_one_and_in_many_blocks(spark):
    docs, items = odd_tables()
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    q = spark.createDataFrame(items, "item_id long, text string, rank string")
    for per_block in (4096, 8):
        assert sorted(map(tuple, search.search(d, q, per_block=per_block).collect()), key=str) == plain(docs, items)


def test_items_are_the_sums_of_their_nodes(spark):
    _, items = odd_tables()
    rows = spark.createDataFrame([(i or 99, t) for i, t, _ in items], "item long, text string").where("text is not null")
    said = search.item_terms(rows)
    graph = search.plan(said)
    holds = [Counter({graph.terms[t].decode(): step for t, step in parts}) for parts in graph.atoms]
    for left, right in graph.nodes:
        holds.append(holds[left] + holds[right])
    want = {}
    for r in said.collect():
        want.setdefault(r.item, Counter())[r.term] = r.n
    assert {i: holds[k] for i, k in graph.roots} == want
    # Sharing: fewer sums than without, and no node is made twice.
    assert len(set(graph.nodes)) == len(graph.nodes)
    assert len(graph.nodes) < sum(len(c) - 1 for c in want.values())


def test_accumulators_are_computed_once_per_block():
    graph = search.Plan([b"a", b"b"], [[(0, 1)], [(1, 2)]], [(0, 1)], [(0, 2), (1, 0)])
    acc = search.accumulate(graph, np.array([0, 2]), np.array([0, 1]), np.array([5, 7]), 3)
    assert [x.tolist() for x in acc] == [[5, 0, 0], [0, 0, 14], [5, 0, 14]]


def test_empty_tables(spark):
    docs, items = odd_tables()
    d, q = spark.createDataFrame(docs, "doc_id long, text string, c string"), spark.createDataFrame(items, "item_id long, text string, c string")
    assert search.search(d.limit(0), q).count() == 0 and search.search(d, q.limit(0)).count() == 0


def test_query_against_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.op12_search(spark, SF)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL['op12_search']}) q").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
