"""Shards against a plain restatement of the draws, moves, slots and files."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from isoloom.llm import queries, sharding

SF = "/root/testdata/sf0.001"


def plain_shard(key, shards):
    best = None
    for s, w in shards.items():
        x = int(hashlib.md5(f"{'n' if key is None else f'k{key}'}:{s}".encode()).hexdigest()[:13], 16)
        best = max(filter(None, [best, (w / -math.log((x + 0.5) / (1 << 52)), -s)]))
    return -best[1]


def odd_rows():
    rnd = random.Random(3)
    rows = [(i * 7, f"text {i % 11} é" * rnd.randint(0, 4), "x") for i in range(400)]
    rows += [(None, None, None), (None, "a", "y"), (7, None, "x"), (7, "", "x"), (14, "z" * 300_000, "x")]
    return rows + [(21, "copy", "x")] * 500 + [(None, None, None)] * 3


def test_every_row_has_its_shard_and_slots_have_no_gaps(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    for part_rows in (16, 4096):
        out = sharding.digests(docs, part_rows=part_rows).collect()
        want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), plain_shard(i, sharding.SHARDS), plain_shard(i, {s: 1 for s in range(17)})) for i, t, _ in rows)
        assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in out) == want
        assert {r.law for r in out} == {"key"} and all(r.grown_shard in (r.shard, 16) for r in out)
        per = {}
        for r in out:
            per.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(x) == list(range(len(x))) for x in per.values())
        of = sorted((r.shard, r.slot, r.doc_id or -1, r.size) for r in out)
        before = of if part_rows == 16 else before
        assert of == before  # the size of parts changes no slot


def test_weights_and_moves(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"))
    four = {0: 1.0, 1: 2.0, 5: 1.0, 9: 4.0}
    n = {r.shard: r["count"] for r in sharding.assign(docs, four).groupBy("shard").count().collect()}
    assert all(abs(n[s] - 20_000 * w / 8) < 400 for s, w in four.items())
    moved = [r for r in sharding.moves(docs, four, {**four, 7: 2.0}).collect() if r.from_shard != r.to_shard]
    assert {r.to_shard for r in moved} == {7} and abs(sum(r.n_rows for r in moved) - 4_000) < 400
    gone = [r for r in sharding.moves(docs, four, {s: w for s, w in four.items() if s != 1}).collect() if r.from_shard != r.to_shard]
    assert {r.from_shard for r in gone} == {1} and sum(r.n_rows for r in gone) == n[1]
    heavier = [r for r in sharding.moves(docs, four, {**four, 5: 3.0}).collect() if r.from_shard != r.to_shard]
    assert {r.to_shard for r in heavier} == {5}
    with pytest.raises(ValueError):
        sharding.assign(docs, {})
    with pytest.raises(ValueError):
        sharding.assign(docs, {0: 0.0})


def test_placed_rows_keep_their_columns_and_are_written_in_order(spark, tmp_path):
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string, shard string").withColumnRenamed("shard", "note").withColumn("slot", F.lit("mine"))
    placed = sharding.place(docs, {0: 1.0, 1: 1.0, 2: 1.0}, part_rows=32)
    assert Counter((r.doc_id, r.text, r.note) for r in placed.collect()) == Counter(odd_rows())
    sharding.write(placed, str(tmp_path / "out"), file_rows=100)
    back = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "text", "shard", "slot", F.input_file_name().alias("file")).collect()
    assert len(back) == len(odd_rows()) and all(r.shard == plain_shard(r.doc_id, {0: 1, 1: 1, 2: 1}) for r in back)
    files = {}
    for r in back:
        files.setdefault(r.file, []).append(r.slot)
    assert len(files) >= 9 and all(len(s) <= 100 and s == sorted(s) for s in files.values())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.digests(docs).count() == 0 and sharding.place(docs).count() == 0 and sharding.moves(docs, {0: 1.0}, {1: 1.0}).count() == 0


def test_query_against_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.op11_sharding(spark, SF)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL['op11_sharding']}) q").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
