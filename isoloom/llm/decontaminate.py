"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Containment of a benchmark item Q in a document D is |Q & D| / |Q| over distinct shingles of five words.
A short item in a long document has almost no Jaccard similarity to it, so the search is partitioned by
size: items fall into classes of at most u shingles, u growing by the square root of two, and for each class
the document is cut into blocks of u/2 shingles and windows of three adjacent blocks. A passage of the item's
length lies whole in some window of its class, whatever the document's length, and has a Jaccard similarity of at
least 0.44 to it (0.34 if a fifth of the item is missing). Window signatures are minima over block minima, and
any equal minimum makes a candidate (bands of one row): with 32 permutations a passage is missed
with probability 0.56**32 < 1e-8 (0.66**32 < 2e-6). Items of one shingle are looked up as they are, which misses
none. Candidates are verified against all shingles of the whole document.

The benchmark is read in blocks of about ITEMS_PER_BLOCK items and BYTES_PER_BLOCK bytes of text; the minima of one block
are broadcast and searched in all documents, then those of the next, so what is broadcast has a bound
however large the benchmark is. Documents carry a row number from block to block: rows that share a doc_id, or
have none, are never taken for one another.

An item whose shingles are all in a document, but strewn over more than one and a half times its own length, may have no
window of its class that is like it; the exact test is made for candidates only, so such items can be missed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.shared import materialise

SHINGLE = 5
THRESHOLD = 0.8
PERMUTATIONS = 32
ITEMS_PER_BLOCK = 20_000
BYTES_PER_BLOCK = 64 << 20
_WORDS = re.compile(r"[^\W_]+")  # runs of letters and digits
_SEED = 11
_TOGETHER = 1 << 17
_NONE = np.uint64(2**64 - 1)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the word shingles in order; fewer words than ``size`` but some: the whole sequence."""
    words = _WORDS.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(size, len(h))):  # a hash of the word hashes in order
            out = (out ^ (h[k : k + n] + np.uint64(k + 1))) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def _permutations(n: int) -> np.ndarray:
    return np.random.default_rng(_SEED).integers(0, 1 << 64, n, np.uint64) | np.uint64(1)


def _class(n: int) -> int:
    """The least size of the classes that holds ``n`` shingles."""
    size = 1
    while size < n:
        size = math.ceil(size * math.sqrt(2))
    return size


class Index:
    """Minima of the items of one block, by size class and permutation, and their distinct shingles.

    An item is an (id, text) pair: an id with several texts is found by any of them.
    """

    def __init__(self, items: list[tuple[int, str | None]], threshold: float, permutations: int = PERMUTATIONS):
        self.threshold, self.a = threshold, _permutations(permutations)
        found = [(i, s) for i, text in items if len(s := np.unique(shingles(text)))]
        self.ids, self.items = [i for i, _ in found], [s for _, s in found]
        self.classes: dict[int, list[tuple[np.ndarray, list[list[int]]]]] = {}
        by_class: dict[int, list[int]] = {}
        for k, s in enumerate(self.items):
            by_class.setdefault(_class(len(s)), []).append(k)
        for c, members in by_class.items():
            whole = np.concatenate([self.items[k] for k in members])
            begin = np.cumsum([0, *(len(self.items[k]) for k in members)])[:-1]
            tables = []
            for k in range(permutations):
                at: dict[int, list[int]] = {}
                for least, i in zip(np.minimum.reduceat(self._hash(whole, k), begin).tolist(), members, strict=True):
                    at.setdefault(least, []).append(i)
                keys = np.array(sorted(at), np.uint64)
                tables.append((keys, [at[int(x)] for x in keys]))
            self.classes[c] = tables

    def _hash(self, s: np.ndarray, k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return s * self.a[k]  # an odd factor permutes the 64-bit values; shingles are mixed already

    def candidates(self, parts: list[np.ndarray]) -> list[set[int]]:
        """For each document, given by its shingles in order, the places of items that share a minimum with a window of it."""
        found: list[set[int]] = [set() for _ in parts]
        sizes = np.array([len(p) for p in parts])
        if not sizes.sum():
            return found
        s, begin = np.concatenate(parts), np.r_[0, np.cumsum(sizes)[:-1]]
        cuts = {}
        for c in self.classes:  # blocks begin anew in each document; a window is a block and the two after it there
            step = -(-c // 2)
            n = -(-sizes // step)
            doc = np.repeat(np.arange(len(parts)), n)
            nth = np.arange(len(doc)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
            cuts[c] = begin[doc] + nth * step, doc, np.flatnonzero(doc[1:] != doc[:-1])
        for k in range(len(self.a)):
            h = self._hash(s, k)
            for c, tables in self.classes.items():
                if c == 1 and k:  # found by the first permutation already
                    continue
                at, doc, last = cuts[c]
                block = np.minimum.reduceat(h, at)
                after = np.r_[block[1:], _NONE]
                after[last] = _NONE
                two = np.minimum(block, after)
                after = np.r_[two[1:], _NONE]
                after[last] = _NONE
                window = np.minimum(two, after) if c > 1 else block
                keys, ids = tables[k]
                place = np.searchsorted(keys, window)
                place[place == len(keys)] = 0
                for w in np.flatnonzero(keys[place] == window):
                    found[doc[w]].update(ids[place[w]])
        return found

    def search(self, texts: list[str | None]) -> list[list[tuple[int, float]]]:
        """For each text (item id, containment) of the items that it contains, by id; of an id's texts the best contained."""
        out: list[list[tuple[int, float]]] = []
        at = 0
        while at < len(texts):  # as many texts at a time as make up enough shingles for whole-array work
            parts, total = [], 0
            while at + len(parts) < len(texts) and total < _TOGETHER:
                parts.append(shingles(texts[at + len(parts)]))
                total += len(parts[-1])
            for s, places in zip(parts, self.candidates(parts) if self.items else [set()] * len(parts), strict=True):
                there, best = np.unique(s) if places else s, {}
                for k in places:
                    share = float(np.isin(self.items[k], there).mean())
                    if share >= self.threshold - 1e-12:
                        best[self.ids[k]] = max(share, best.get(self.ids[k], 0.0))
                out.append(sorted(best.items()))
            at += len(parts)
        return out


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, text) once each; repeated rows, and those without an id or a text, say nothing."""
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()


def _blocks(items: DataFrame, threshold: float, items_per_block: int) -> Iterator[Broadcast]:
    """The broadcast indexes of the blocks, one after another.

    Different rows fall into blocks by hash, with a quarter of their room to spare: a block of n expected rows is over its bound
    with probability exp(-n / 40), and the number of blocks follows the bytes of text too.
    """
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(1.25 * n / items_per_block), math.ceil(1.25 * size / BYTES_PER_BLOCK)) if n > items_per_block or size > BYTES_PER_BLOCK else 1
    for k in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        index = Index(sorted(map(tuple, some.collect())), threshold)
        yield items.sparkSession.sparkContext.broadcast(index)


def _search(rows: DataFrame, sent: Broadcast) -> DataFrame:
    """``rows(key, text)`` -> (key, item_ids, containment)."""
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = sent.value.search(b.column(1).to_pylist())
            ids, most = pa.array([[i for i, _ in f] for f in found], kind), pa.array([max((x for _, x in f), default=0.0) for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), ids, most], names=["key", "item_ids", "containment"])

    return rows.mapInArrow(run, "key long, item_ids array<long>, containment double")


def contained(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """Every row of ``docs`` as (doc_id, n_items, item_ids, containment, contaminated).

    ``item_ids`` are the benchmark items of which the whole text contains at least ``threshold`` of the
    distinct shingles, comma-joined in order; ``containment`` is the largest share among those, 0 if there are none.
    Items and texts without a word contain nothing; null texts count as empty; items without item_id are left out,
    repeated rows of ``benchmark`` count once, and an item_id with several texts is contained if one of them is. An empty
    benchmark is in no document. Rows of ``docs`` that repeat a doc_id or have none are judged and returned one by one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts: list[DataFrame] = []
    for k, sent in enumerate(_blocks(_items(benchmark), threshold, items_per_block)):
        if k == 1:  # more than one block: number the rows, and write what each block finds
            rows = materialise(rows.withColumn("key", F.monotonically_increasing_id()), "rows")
            parts = [materialise(_search(rows.select("key", "text"), first).where("size(item_ids) > 0"), "found")]
        if k == 0:
            first = sent
        else:
            parts.append(materialise(_search(rows.select("key", "text"), sent).where("size(item_ids) > 0"), "found"))
            sent.unpersist()
    if parts:
        every = parts[0]
        for p in parts[1:]:
            every = every.union(p)
        found = every.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.max("containment").alias("containment"))
        found = rows.select("key", "doc_id").join(found, "key", "left").select("doc_id", F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("containment", F.lit(0.0)).alias("containment"))
    else:
        found = _search(rows.select(F.col("doc_id").alias("key"), "text"), first).withColumnRenamed("key", "doc_id")
    return found.select(
        "doc_id", F.size("item_ids").cast("long").alias("n_items"), F.array_join(F.transform("item_ids", lambda i: i.cast("string")), ",").alias("item_ids"), "containment", (F.size("item_ids") > 0).alias("contaminated")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """``docs`` without the rows whose whole text contains a benchmark item (see :func:`contained`), all columns.

    Null and empty texts stay, whatever the benchmark; rows that repeat a doc_id or have none are judged one by
    one; an empty benchmark takes nothing out. With several blocks what is left is written after each of them.
    """
    names, kept = docs.columns, docs.withColumn("text", F.col("text").cast("string"))
    for k, sent in enumerate(_blocks(_items(benchmark), threshold, items_per_block)):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not f for f in sent.value.search(b.column(names.index("text")).to_pylist())], pa.bool_()))

        kept = (materialise(kept, "kept") if k else kept).mapInArrow(run, kept.schema)
    return kept
