"""Collocations against plain counts, automata against the sorted phrases they are made from."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from isoloom.llm import collocations as C
from isoloom.llm import queries

SF = "/root/testdata/sf0.001"


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def plain(rows, least, best=2000, longest=5):
    f, n, out = {}, Counter(), []
    for text, lang, *_ in rows:
        count = f.setdefault(lang or ("und" if lang is None else lang), Counter())
        for w in pieces(text):
            n[lang if lang is not None else "und"] += len(w)
            for m in range(1, longest + 1):
                count.update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    for lang, count in f.items():
        ranked = []
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        inside = {q: max(a for p, a in candidates.items() if any(p[i : i + len(q)] == q for i in range(len(p) - len(q) + 1)) and len(p) > len(q)) for q in candidates for _ in [0] if any(len(p) > len(q) and any(p[i : i + len(q)] == q for i in range(len(p) - len(q) + 1)) for p in candidates)}
        for p, a in candidates.items():
            if inside.get(p, 0) * 100 >= 100 * a:
                continue
            score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), a, count[p[:k]], count[p[k:]], score))
        out += [(lang, i + 1, x[2].decode(), *x[3:6], n[lang], x[6]) for i, x in enumerate(sorted(ranked)[:best])]
    return sorted(out)


def odd_rows():
    rnd = random.Random(13)
    vocabulary = ["The", "of", "é", "日本", "x-1", "a", "Ab", " ", "z'", "qu"]
    text = lambda: "".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", "; "]) for _ in range(rnd.randint(0, 120)))
    rows = [(text(), rnd.choice(["en", "en", "fr", None, "und", ""]), "e") for _ in range(150)]
    rows += [(None, "en", ""), ("", None, ""), (" \t.,", "fr", ""), ("a a a a a a a", "de", ""), ("long tail " * 20_000, "de", ""), ("w" * 100_000 + " w", "de", "")]
    return rows + [("one common line of it all here", "en", "")] * 300


@pytest.mark.parametrize("size", [300, 1 << 20])
def test_against_plain_counts(spark, size):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "text string, lang string, phrase string").repartition(5)
    for least, best in ((6, 2000), (20, 7)):
        assert sorted(map(tuple, C.collocations(docs, least=least, best=best, size=size).collect())) == plain(rows, least, best)


def test_automaton_of_sorted_paths():
    rnd = random.Random(1)
    paths = np.array([[rnd.randint(1, 3), rnd.randint(1, 3), *((rnd.randint(1, 3), rnd.randint(0, 1)) if rnd.random() < 0.7 else (0, 0))] for _ in range(500)])
    full, counts = C.distinct(paths)
    assert Counter(map(tuple, paths.tolist())) == dict(zip(map(tuple, full.tolist()), counts.tolist(), strict=True)) and full.tolist() == sorted(full.tolist())
    vocabulary = pa.array(["a", "b", "cc"])
    for width in (1, 3):
        batch = C.pieces("en", vocabulary, full, counts, 1, width, pa.array(["b"]))
        rows = batch.to_pylist()
        assert {r["letter"] for r in rows if r["prefix"] == "b"} == {97, 98, 99} and {r["letter"] for r in rows if r["prefix"] != "b"} == {-1}
        assert {r["prefix"] for r in rows} == {"a", "b", "cc"[:width]}
        assert all(r["words"].split()[0].startswith(r["prefix"]) and r["depth"][0] == 1 for r in rows)
        want = Counter(tuple(p[:d]) for p in paths.tolist() for d in range(2, 5) if p[d - 1])
        back, _, below, weight = C.unfold(batch, 1, 4)
        names = [tuple(back[c - 1].as_py() for c in p if c) for p in below.tolist()]
        assert dict(zip(names, weight.tolist(), strict=True)) == {tuple(vocabulary[c - 1].as_py() for c in p): n for p, n in want.items()}
        assert len(names) == len(want)  # one state for each phrase


def test_union_sums_weights_whatever_the_batches(spark):
    vocabulary = pa.array(["a", "b", "cc", "d"])
    rnd = random.Random(2)
    parts = [C.pieces("en", vocabulary, *C.distinct(np.array([[rnd.randint(1, 4), rnd.randint(1, 4)] for _ in range(50)])), 1, 3, pa.array(["a"])) for _ in range(9)]
    rows = sorted((r for p in parts for r in p.to_pylist()), key=lambda r: (r["lang"], r["prefix"], r["letter"]))
    want = Counter()


    def said(r):
        way = []
        for w, d, n in zip(r["words"].split(), r["depth"], np.frombuffer(r["weight"], "<i8").tolist(), strict=True):
            way[d - 1 :] = [w]
            if d > 1:
                yield tuple(way), n

    for r in rows:
        for p, n in said(r):
            want[p] += n
    for size in (1, 2, 7, 1000):
        batches = [pa.RecordBatch.from_pylist(rows[i : i + size], schema=parts[0].schema) for i in range(0, len(rows), size)]
        out = [r for b in C._united(1, 5, 30)(iter(batches)) for r in b.to_pylist()]
        assert {p: n for r in out for p, n in said(r)} == {k: n for k, n in want.items() if n >= 30}
        assert len({(r["prefix"], r["letter"]) for r in out}) == len(out)


def test_union_holds_different_states_only(monkeypatch):
    vocabulary = pa.array(["a", *(f"w{k:03d}" for k in range(300))])
    paths = np.array([[1, k, 2, 2, 2] for k in range(2, 302)])
    part = C.pieces("en", vocabulary, paths, np.ones(300, np.int64), 2, 3, pa.array(["a"]))
    unfolded = []
    whole = C.unfold
    monkeypatch.setattr(C, "unfold", lambda batch, *x: unfolded.append(batch.num_rows) or whole(batch, *x))
    out = [r for b in C._united(2, 5, 100, most=5000)(iter([part] * 100)) for r in b.to_pylist()]
    assert len(out) == 1 and max(unfolded) < 20 and sum(np.frombuffer(out[0]["weight"], "<i8")) == 3 * 300 * 100
    assert not [*C._united(2, 5, 101, most=5000)(iter([part] * 100))]  # what is rare goes at the end only


def test_narrower_ranges_change_no_result(spark, monkeypatch):
    assert [C.range_width(n) for n in (0, 1 << 28, 1 << 29, 1 << 31)] == [3, 3, 4, 5] and C.range_letters(1 << 30) == 2
    assert C.first_bytes(pa.array(["a", "bc", "é", "日本"]), 2).tolist() == [0, 0x6100, 0x6263, 0xC3A9, 0xE697]
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "text string, lang string, phrase string").repartition(5)
    monkeypatch.setattr(C, "range_letters", lambda n: 2)
    monkeypatch.setattr(C, "range_width", lambda n: 5)
    assert sorted(map(tuple, C.collocations(docs, least=6, size=300).collect())) == plain(rows, 6)


def test_hashes_and_bitmaps(spark):
    rows = spark.createDataFrame([("en", "é"), ("", "a"), ("de", "longer words")], "lang string, word string").withColumn("h", F.xxhash64("lang", "word"))
    for r in rows.collect():
        h = int(C._hashes(r.lang, pa.array([r.word]))[1])
        assert h == r.h % (1 << 64) == xxhash.xxh64_intdigest(r.word, xxhash.xxh64_intdigest(r.lang, 42))
    many = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bitmap = C.bitmap_of(many)
    hs = np.array([r.h for r in many.collect()], np.int64).view(np.uint64)
    assert C._is_set(bitmap, hs).all() and np.bitwise_count(bitmap).sum() == len(np.unique(hs & np.uint64((1 << 27) - 1)))


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert C.collocations(spark.createDataFrame([(None, None), (".", "en")], "text string, lang string")).count() == 0


def test_query_against_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.op13_collocations(spark, SF)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL['op13_collocations']}) q").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
