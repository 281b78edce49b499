"""Mixing sources to target weights: fixed-length blocks, drawn slots, permuted indexes, a join by index.

The documents of a source are dealt by hash to groups, and the words of a group, documents in order of id, are
packed into blocks of BLOCK words; the last block of a group is shorter. A small source is one group, one that has more
than a GROUPS-th of all words is several. The whole blocks of a source are indexed group after group from 0, its short
blocks follow. A source whose target is t words gets slots for t words: whole passes over its blocks and a rest. How
many slots of a source an output shard gets is a multinomial draw (given the source's total, so that totals meet their
targets). Slot j of a pass reads block P(j), P a keyed pseudorandom permutation of the whole blocks' indexes
computed for each j alone (a Feistel network with cycle walking); short blocks come last, and only the last slot of a
source is cut.

Texts move twice. Slots are joined to the index of blocks, which holds no words, and sent to the groups of their
blocks along with the documents; a group is packed in one pass and gives each block to the slots that read it. The filled
slots are then written as shards in slot order. What is taken of a document is the sum of its spans there. Words travel and are
kept as zstandard-compressed text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isoloom.shared import materialise, new_path

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK = 4096
SHARD_SLOTS = 2048
SEED = 20240229
GROUPS = 4096
GROUP_WORDS = 1 << 20  # no source of fewer words is split
_FILE_SLOTS = 256  # slots of a shard in one file
_LEVEL = 6
_WORD = r"[^\x20\x09-\x0D]+"
_SOURCE = ["name", "absent"]


def document_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, text_key): size is the number of words, 0 for null texts."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(_WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) with one row per source.

    Sources by code point, null last, take ``weights`` in turn. A target is min(most * size, w * level) at
    the one level where targets sum to ``share`` of all words; resharing the excess by weight until none
    is above its bound ends there. The level follows from running sums over sources in the order in which
    they reach their bound, on a table with one row per source.
    """
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("w", w).withColumn("bound", F.col("source_size") * most)
    every, before = W.partitionBy(), W.orderBy(F.col("bound") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(every) * share
    level = (total - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # level: if all sources from this one on were below their bound; the first for which that holds sets it.
    per = per.withColumn("level", level).withColumn("free", F.col("level") * F.col("w") <= F.col("bound"))
    per = per.withColumn("level", F.min(F.when(F.col("free"), F.struct((F.col("bound") / F.col("w")).alias("at"), "source", "level"))).over(every)["level"])
    return per.select("source", "source_size", F.least("bound", F.coalesce(F.col("level") * F.col("w"), F.col("bound"))).alias("target"))


def permuted(j: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """P(j) for a permutation P of 0..n-1 named by ``key``; all arrays uint64, j < n."""
    half = np.ones_like(n)
    while (small := (np.uint64(1) << (2 * half)) < n).any():
        half[small] += np.uint64(1)
    mask = (np.uint64(1) << half) - np.uint64(1)

    def network(x: np.ndarray, at: slice | np.ndarray) -> np.ndarray:
        left, right = x >> half[at], x & mask[at]
        for r in range(rounds):
            z = right + key[at] + np.uint64(r * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & mask[at])
        return (left << half[at]) | right

    with np.errstate(over="ignore"):
        out = network(j, slice(None))
        while (out >= n).any():  # outside the range: walk on along the cycle
            over = np.flatnonzero(out >= n)
            out[over] = network(out[over], over)
    return out


def _named(df: DataFrame) -> DataFrame:
    """``source`` as two columns without nulls, so that equal keys meet in a plain join."""
    return df.withColumn("name", F.coalesce("source", F.lit(""))).withColumn("absent", F.col("source").isNull()).drop("source")


def deal(rows: DataFrame, goals: DataFrame, groups: int = GROUPS, group_words: int = GROUP_WORDS) -> DataFrame:
    """``rows(doc_id, text_key, name, absent, ...)`` with ``group``, the group of its source to which a document is dealt.

    Only sources of more than a ``groups``-th of all words are split, so fewer than ``groups`` of them are broadcast.
    """
    total = goals.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    each = max(group_words, -(-total // groups))
    split = _named(goals.where(F.col("source_size") > each)).select(*_SOURCE, F.ceil(F.col("source_size") / each).cast("int").alias("groups"))
    n = F.coalesce("groups", F.lit(1))
    return rows.join(F.broadcast(split), _SOURCE, "left").withColumn("group", F.pmod(F.xxhash64("doc_id", "text_key"), n).cast("int")).drop("groups")


def block_index(sizes: DataFrame, goals: DataFrame, block: int = BLOCK, group_words: int = GROUP_WORDS) -> tuple[DataFrame, DataFrame]:
    """(blocks, plan). blocks(name, absent, index, group, k, n, before): every block of every source, k-th of its
    group, n words long; ``before`` is what a pass has read before a short block, null for whole ones. plan(name, absent,
    size, goal, whole, full, short, rest): whole blocks, short ones, and the slots of the pass that is not whole.
    """
    per = deal(_named(sizes.where("size > 0")), goals, group_words=group_words).groupBy(*_SOURCE, "group").agg(F.sum("size").alias("words"))
    ahead = W.partitionBy(*_SOURCE).orderBy("group").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("full", F.floor(F.col("words") / block)).withColumn("left", F.col("words") % block).withColumn("some", (F.col("left") > 0).cast("long"))
    for name, what in (("base", "full"), ("nth", "some"), ("words_before", "left")):
        per = per.withColumn(name, F.coalesce(F.sum(what).over(ahead), F.lit(0)))
    per = materialise(per, "groups")
    plan = _named(goals.where("source_size > 0")).select(*_SOURCE, F.col("source_size").alias("size"), F.round("target").cast("long").alias("goal"))
    plan = plan.withColumn("whole", F.floor(F.col("goal") / F.col("size")))
    plan = plan.join(per.groupBy(*_SOURCE).agg(F.sum("full").alias("full"), F.sum("some").alias("short")), _SOURCE)
    over = plan.select(*_SOURCE, (F.col("goal") - F.col("whole") * F.col("size") - F.col("full") * block).alias("over"))
    late = per.where("some = 1").join(over, _SOURCE).groupBy(*_SOURCE).agg(F.count_if(F.col("words_before") < F.col("over")).alias("late"))
    rest = F.least(F.ceil((F.col("goal") - F.col("whole") * F.col("size")) / block), F.col("full")) + F.coalesce("late", F.lit(0))
    plan = plan.join(late, _SOURCE, "left").withColumn("rest", rest.cast("long")).drop("late")
    all_full = plan.select(*_SOURCE, F.col("full").alias("all_full"))
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1 + F.col("some")))
    rows = per.where("words > 0").join(all_full, _SOURCE).select("*", k.alias("k"))
    whole = F.col("k") < F.col("full")
    blocks = rows.select(
        *_SOURCE, F.when(whole, F.col("base") + F.col("k")).otherwise(F.col("all_full") + F.col("nth")).alias("index"), "group", "k",
        F.when(whole, F.lit(block).cast("long")).otherwise(F.col("left")).alias("n"), F.when(~whole, F.col("all_full") * block + F.col("words_before")).alias("before"),
    )
    return blocks, plan


def slots(blocks: DataFrame, plan: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(name, absent, group, k, index, pass, shard, pos, n_words): what every output shard reads, one row per slot.

    ``pos`` is the slot's place in its shard, from 0; sources are shuffled among each other.
    ``blocks`` and ``plan`` as from :func:`block_index`. The same input gives the same slots in every run.
    """
    per_pass = F.col("full") + F.col("short")
    drawing = plan.select(*_SOURCE, "size", "goal", "full", per_pass.alias("per_pass"), (F.col("whole") * per_pass + F.col("rest")).alias("n"), F.xxhash64(F.when(~F.col("absent"), F.col("name")), F.lit(seed)).alias("key")).where("n > 0")
    drawing = drawing.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.sum("n").over(W.partitionBy()) / shard_slots)).cast("int"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                step = 1 << 16
                rng, left, at = np.random.default_rng(r.key & (1 << 64) - 1), r.n, 0
                for first in range(0, r.shards, step):  # a multinomial draw by parts: the part's total, then its shards
                    k = min(step, r.shards - first)
                    part = left if first + k == r.shards else rng.binomial(left, k / (r.shards - first))
                    counts = rng.multinomial(part, np.full(k, 1 / k))
                    starts = at + np.r_[0, np.cumsum(counts)[:-1]]
                    left, at = left - part, at + part
                    yield pd.DataFrame({"name": r.name, "absent": r.absent, "size": r.size, "goal": r.goal, "full": r.full, "per_pass": r.per_pass, "key": r.key, "shard": first + np.arange(k), "first": starts, "count": counts})

    kind = "name string, absent boolean, size long, goal long, full long, per_pass long, key long, shard int, first long, count long"
    drawn = drawing.mapInPandas(draw, kind).where("count > 0")
    each = drawn.repartition(*_SOURCE, "shard").withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)))
    each = each.withColumn("pass", F.floor(F.col("slot") / F.col("per_pass"))).withColumn("j", F.col("slot") % F.col("per_pass"))

    @F.pandas_udf("long")
    def place(j: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(permuted(*(x.to_numpy().astype(np.uint64) for x in (j, n, key))).astype(np.int64))

    full = F.col("full")
    index = F.when(F.col("j") < full, place(F.least("j", F.greatest(full - 1, F.lit(0))), F.greatest(full, F.lit(1)), F.xxhash64("key", "pass"))).otherwise(F.col("j"))
    pos = F.row_number().over(W.partitionBy("shard").orderBy(F.xxhash64("key", "slot"), *_SOURCE, "slot")) - 1
    asked = each.select(*_SOURCE, index.alias("index"), "pass", "shard", pos.alias("pos"), "j", (F.col("goal") - F.col("pass") * F.col("size")).alias("left"))
    # Slots are made from a small table, so their number can't be estimated beforehand: never broadcast them.
    met = asked.hint("merge").join(blocks, [*_SOURCE, "index"])
    n = F.least("n", F.col("left") - F.coalesce("before", F.col("j") * block))
    return met.select(*_SOURCE, "group", "k", "index", "pass", "shard", "pos", n.alias("n_words"))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of few rows: their texts are held as Python objects only so many at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as their words joined by one space, compressed; rows without a word are left out."""
    pack, find = zstandard.ZstdCompressor(level=_LEVEL).compress, re.compile(_WORD).findall
    for b in _slices(batches):
        joined = (" ".join(find(t.as_py() or "")) for t in b.column("text"))
        packed = pa.array([pack(t.encode("utf-8", "replace")) if t else None for t in joined], pa.binary())
        b = b.set_column(b.schema.get_field_index("text"), "text", packed)
        yield b.filter(packed.is_valid())


_SPAN = pa.struct([("first", pa.int32()), ("n", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64())])
_FILLED = pa.schema([("name", pa.string()), ("absent", pa.bool_()), ("shard", pa.int32()), ("pos", pa.int32()), ("pass", pa.int64()), ("block", pa.int64()), ("n_words", pa.int64()), ("words", pa.binary()), ("spans", pa.list_(_SPAN))])


class _Group:
    """The blocks of one group, filled word by word, and the slots that read them."""

    def __init__(self, name: str, absent: bool, block: int):
        self.name, self.absent, self.block, self.asked = name, absent, block, {}
        self.k, self.words, self.spans = 0, [], []

    def add(self, doc_id: int | None, text_key: int, words: list[str]) -> Iterator[tuple]:
        at = 0
        while at < len(words):
            n = min(self.block - len(self.words), len(words) - at)
            self.spans.append((len(self.words), n, doc_id, text_key))
            self.words += words[at : at + n]
            at += n
            if len(self.words) == self.block:
                yield from self.give()

    def give(self) -> Iterator[tuple]:
        packed = {}
        for shard, pos, nth, index, n in self.asked.pop(self.k, ()):
            if n not in packed:
                cut = [{"first": f, "n": min(m, n - f), "doc_id": d, "text_key": t} for f, m, d, t in self.spans if f < n]
                packed[n] = zstandard.compress(" ".join(self.words[:n]).encode("utf-8", "replace"), _LEVEL), cut
            yield self.name, self.absent, shard, pos, nth, index, n, *packed[n]
        self.k, self.words, self.spans = self.k + 1, [], []


def _fill(block: int, held: int = 8 << 20):
    """Sorted rows of slots and documents, group by group, slots first -> filled slots."""

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        unpack, now, group = zstandard.ZstdDecompressor(), None, None
        for b in _slices(batches):
            for name, absent, of, k, doc_id, text_key, text, slot in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (name, absent, of) != now:
                    if group and group.words:
                        yield from group.give()
                    now, group = (name, absent, of), _Group(name, absent, block)
                if slot is not None:
                    group.asked.setdefault(k, []).append((slot["shard"], slot["pos"], slot["pass"], slot["index"], slot["n_words"]))
                else:
                    yield from group.add(doc_id, text_key, unpack.decompress(text).decode().split(" "))
        if group and group.words:
            yield from group.give()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_FILLED)], schema=_FILLED)
        for r in filled(batches):
            rows.append(r)
            size += len(r[7]) + 64 * len(r[8])
            if size > held:
                yield batch()
                rows, size = [], 0
        yield batch()

    return run


def write_shards(docs: DataFrame, goals: DataFrame, sizes: DataFrame, path: str, block: int = BLOCK, seed: int = SEED, group_words: int = GROUP_WORDS) -> DataFrame:
    """The mix, written to ``path`` with a folder per shard: (shard, pos, source, pass, block, n_words, words, spans).

    A shard's rows are its slots; files hold runs of them in order of ``pos``. ``words`` is compressed, see
    :func:`read_words`. ``spans`` has (first, n, doc_id, text_key) in order: n words from word ``first`` are of that document.
    """
    asked = slots(*block_index(sizes, goals, block, group_words), block, seed=seed)
    slot = F.struct("shard", "pos", "pass", "index", "n_words")
    none = lambda kind: F.lit(None).cast(kind)
    reads = asked.select(*_SOURCE, "group", "k", none("long").alias("doc_id"), none("long").alias("text_key"), none("binary").alias("text"), slot.alias("slot"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = deal(_named(rows.withColumn("text_key", F.xxhash64("text"))), goals, group_words=group_words).select(*_SOURCE, "group", none("long").alias("k"), "doc_id", "text_key", "text")
    rows = rows.mapInArrow(_squeeze, "name string, absent boolean, group int, k long, doc_id long, text_key long, text binary")
    both = reads.union(rows.withColumn("slot", none("struct<shard:int,pos:int,pass:bigint,index:bigint,n_words:bigint>")))
    # The sort puts a group's slots (k is not null) before its documents, and these in order.
    dealt = both.repartition(*_SOURCE, "group").sortWithinPartitions(*_SOURCE, "group", F.col("k").asc_nulls_last(), "doc_id", "text_key")
    filled = dealt.mapInArrow(_fill(block), "name string, absent boolean, shard int, pos int, pass long, block long, n_words long, words binary, spans array<struct<first:int,n:int,doc_id:bigint,text_key:bigint>>")
    out = filled.select("shard", "pos", F.when(~F.col("absent"), F.col("name")).alias("source"), "pass", "block", "n_words", "words", "spans")
    out = out.repartition("shard", F.floor(F.col("pos") / _FILE_SLOTS)).sortWithinPartitions("shard", "pos")
    out.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return out.sparkSession.read.schema(out.schema).parquet(path)


def read_words(mixed: DataFrame) -> DataFrame:
    """The shards of :func:`write_shards` with ``words`` as text, separated by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            k = b.schema.get_field_index("words")
            yield b.set_column(k, "words", pa.array([unpack.decompress(w.as_py()).decode() for w in b.column(k)], pa.string()))

    kinds = ", ".join(f"{f.name} {'string' if f.name == 'words' else f.dataType.simpleString()}" for f in mixed.schema)
    return mixed.mapInArrow(run, kinds)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, seed: int = SEED, path: str | None = None, group_words: int = GROUP_WORDS) -> DataFrame:
    """Every row of ``docs`` as (doc_id, size, source_size, target, taken); the mix itself is written to ``path``.

    ``path`` is a new path in the shared folder if not given, see :func:`write_shards`. ``taken`` counts the words of
    the document in all shards, repeats included. Null and empty texts have size 0 and are never taken; a long text fills many
    blocks; a null source is a source of its own, the last; rows without a doc_id and repeated rows are documents
    of their own, and rows that nothing tells apart share what is taken of them evenly. No document is taken more than
    ``most`` times its size. Without any word nothing is written but empty shards. Other columns aren't read.
    """
    sizes = materialise(document_sizes(docs), "sizes")
    goals = materialise(targets(sizes, weights, share, most), "targets")
    mixed = write_shards(docs, goals, sizes, path or new_path(docs.sparkSession, "shards"), block, seed, group_words)
    spans = _named(mixed.select("source", F.explode("spans").alias("x")))
    taken = spans.select(*_SOURCE, "x.doc_id", "x.text_key", F.col("x.n").cast("long").alias("taken"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("copies"))
    own = _named(sizes).select(*_SOURCE, "doc_id", "text_key", F.lit(0).cast("long").alias("taken"), "size", F.lit(1).alias("copies"))
    per = own.union(taken).groupBy(*_SOURCE, "doc_id", "text_key").agg(F.sum("taken").alias("taken"), F.max("size").alias("size"), F.sum("copies").alias("copies"))
    goals = _named(goals).hint("merge")
    met = per.join(goals, _SOURCE).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    each = F.floor(F.col("taken") / F.col("copies")) + (F.col("copy") <= F.col("taken") % F.col("copies")).cast("long")
    return met.select("doc_id", "size", "source_size", "target", each.cast("long").alias("taken"))
