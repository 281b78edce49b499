"""Ranked search of many items at once, what items share being computed once.

1. Mining. The terms of all items are grouped by the set of items that have them: such a closed term set is an atom, and every item is a union of
   atoms. A term said more often by some items counts as one term for each further step of its count. Atoms are ordered by
   how many items share them and halved again and again; what an item has of each part is a node, and items that have the same of it
   share the node. A node is the union of what it has of the two halves of its part, so nodes make a graph whose roots are the items.
2. Postings. One pass over the documents keeps, per document, its length and the counts of terms that items use. Document frequencies come
   from there.
3. Accumulators. A document's score is a sum over terms, so a node's partial scores are the sums of those of its two parts. For a
   block of documents every node is computed once, from atoms on up, and used by all nodes and items above it.
4. Each task keeps the best documents per item; the best of those are the result.

Scores are 64-bit integers throughout, so that sums don't depend on their order. Neither postings nor accumulators are shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isoloom.shared import discard, materialise

BEST = 10
#: Items are searched in blocks of about so many items and bytes of text; the plan of a block goes to all tasks.
ITEMS_PER_BLOCK, BYTES_PER_BLOCK = 4096, 8 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same on bytes: separators become blanks, A-Z lower case, bytes of other characters stay.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_CELLS = 1 << 22  # accumulators of a block of documents


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def item_terms(items: DataFrame) -> DataFrame:
    """(item, term, n) of ``items(item, text)``: how often each item says each of its terms."""
    every = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(TERM), F.lit(0))
    return items.select("item", F.explode(every).alias("term")).groupBy("item", "term").agg(F.count("*").alias("n"))


def closed_sets(said: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(atoms, members) of ``said(item, term, n)``.

    atoms(atom, parts): the term sets that the same items have, as structs (term, step): ``step`` is how much of the term's count
    is meant. members(item, atom): an item is the disjoint union of its atoms. Atoms are numbered from 0, most shared first.
    """
    counts = said.select("term", "n").distinct()
    steps = counts.withColumn("step", F.col("n") - F.coalesce(F.lag("n").over(W.partitionBy("term").orderBy("n")), F.lit(0)))
    having = said.withColumnRenamed("n", "has").join(steps, "term").where("has >= n")
    sets = having.groupBy("term", "n", "step").agg(F.array_sort(F.collect_list("item")).alias("items"))
    same = sets.groupBy("items").agg(F.array_sort(F.collect_list(F.struct("term", "step"))).alias("parts"))
    atoms = same.withColumn("atom", F.row_number().over(W.orderBy(F.size("items").desc(), "items")) - 1)
    return atoms.select("atom", "parts"), atoms.select(F.explode("items").alias("item"), "atom")


def shared_nodes(members: DataFrame, n_atoms: int) -> DataFrame:
    """(atoms, items, roots): the distinct sets that items have of each half, quarter and so on of the atoms, how many items have
    each, and the items of which it is all."""
    levels = max(0, n_atoms - 1).bit_length()
    each = members.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    sets = each.groupBy("item", "level", F.expr("shiftright(atom, level)")).agg(F.array_sort(F.collect_list("atom")).alias("atoms"))
    whole = F.array_sort(F.collect_list(F.when(F.col("level") == levels, F.col("item"))))
    return sets.groupBy("atoms").agg(F.count_distinct("item").alias("items"), whole.alias("roots"))


@dataclass
class Plan:
    """Atoms as (term, step) lists, nodes in order of computation as (left, right), and the node of every item."""

    terms: list[bytes]
    atoms: list[list[tuple[int, int]]]
    nodes: list[tuple[int, int]] = field(default_factory=list)  # numbers below len(atoms) are atoms
    roots: list[tuple[int, int]] = field(default_factory=list)  # (item, node)


def plan(said: DataFrame) -> Plan:
    """The graph of one block of items; its size is bounded by that of the block."""
    atoms, members = (materialise(x, "atoms") for x in closed_sets(said))
    parts = [r.parts for r in atoms.orderBy("atom").collect()]
    vocabulary = sorted({p.term.encode() for x in parts for p in x})
    number = {t: k for k, t in enumerate(vocabulary)}
    out = Plan(vocabulary, [[(number[p.term.encode()], p.step) for p in x] for x in parts])
    of = {(a,): a for a in range(len(parts))}
    for r in sorted(shared_nodes(members, len(parts)).collect(), key=lambda r: (len(r.atoms), r.atoms)):
        key = tuple(r.atoms)
        if len(key) > 1:
            bit = (key[0] ^ key[-1]).bit_length() - 1  # the first halving that parts them
            left = next(k for k, a in enumerate(key) if a >> bit & 1)
            of[key] = len(parts) + len(out.nodes)
            out.nodes.append((of[key[:left]], of[key[left:]]))
        out.roots += [(i, of[key]) for i in r.roots]
    discard(atoms)
    discard(members)
    return out


def postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, term, tf) per row of ``docs``: n terms in all, and counts of those in ``vocabulary``, by their numbers there."""
    number = {t: k for k, t in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                ns, found, counts = [], [], []
                for t in part.column(1):
                    said = terms(t.as_py())
                    hits = Counter(filter(number.__contains__, said))
                    ns.append(len(said))
                    found.append([number[x] for x in hits])
                    counts.append(list(hits.values()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ns, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "n", "term", "tf"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, term array<int>, tf array<long>")


def accumulate(graph: Plan, doc: np.ndarray, term: np.ndarray, gain: np.ndarray, n_docs: int) -> list[np.ndarray | None]:
    """Partial scores of ``n_docs`` documents for every atom and node, each computed once; None where all are zero.

    ``gain`` is what the term ``term`` adds to the score of document ``doc`` each time an item says it.
    """
    order = np.argsort(term, kind="stable")
    doc, gain = doc[order], gain[order]
    ends = np.searchsorted(term[order], np.arange(len(graph.terms) + 1)).tolist()
    out: list[np.ndarray | None] = []
    for parts in graph.atoms:
        acc = None
        for t, step in parts:
            lo, hi = ends[t], ends[t + 1]
            if lo < hi:
                acc = np.zeros(n_docs, np.int64) if acc is None else acc
                acc[doc[lo:hi]] += gain[lo:hi] * step
        out.append(acc)
    for left, right in graph.nodes:
        a, b = out[left], out[right]
        out.append(a if b is None else b if a is None else a + b)
    return out


def _ranked(graph: Plan, weight: np.ndarray, n_docs: int, all_terms: int, best: int):
    """Per task the ``best`` documents of every item: (item, doc_id, score)."""
    block = max(16, _CELLS // max(1, len(graph.atoms) + len(graph.nodes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, list] = {i: [] for i, _ in graph.roots}
        least = np.ones(len(graph.roots), np.int64)  # a score below can't be among the best
        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                ids, n = part.column(0).to_pylist(), part.column(1).to_numpy()
                m = 25 + 75 * n * n_docs // all_terms
                sizes = pa.compute.list_value_length(part.column(2)).to_numpy()
                doc = np.repeat(np.arange(len(ids)), sizes)
                term, tf = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
                acc = accumulate(graph, doc, term, weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc])), len(ids))
                for k, (item, node) in enumerate(graph.roots):
                    if acc[node] is None:
                        continue
                    held = top[item] + [(-s, ids[d] is None, ids[d] or 0) for d in (acc[node] >= least[k]).nonzero()[0].tolist() for s in [int(acc[node][d])]]
                    if len(held) > len(top[item]):
                        top[item] = sorted(held)[:best]
                        least[k] = -top[item][-1][0] if len(top[item]) == best else 1
        rows = [(i, None if none else d, -s) for i, x in top.items() for s, none, d in x]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "score"])

    return run


def _blocks(items: DataFrame, per_block: int) -> int:
    n, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    return max(1, math.ceil(n / per_block), math.ceil((size or 0) / BYTES_PER_BLOCK))


def search(docs: DataFrame, items: DataFrame, best: int = BEST, per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents of ``docs(doc_id, text)`` with a score above 0 for every row id of
    ``items(item_id, text)``, the smaller doc_id first among equal scores (a null one last).

    A document's score for an item is the sum, over the item's terms with repeats, of w * (10^9 tf div (1000 tf + 8 m)), where
    w = floor(1000 ln((2 N + 2) / (2 df + 1))) and m = 25 + (75 n N) div L; see the module's head for the method. The texts of rows that
    share an item_id are one item, null being an id like others. Every row of ``docs`` is a document of its own, so a repeated row
    is ranked as often as it is there. Null and empty texts have no terms; items without terms, or whose terms no document has, have no
    rows; empty tables give none. Other columns aren't read. Any number of items: each block of them is one search of all documents.
    """
    named = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    merged = named.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("text"))
    merged = materialise(merged, "items")
    n_blocks, out = _blocks(merged, per_block), []
    for k in range(n_blocks):
        some = merged.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k)
        ids = [r[0] for r in some.select("item_id").orderBy("item_id").collect()]
        number = docs.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], "item long, item_id long")
        said = item_terms(some.join(number, some.item_id.eqNullSafe(number.item_id)).select("item", "text"))
        graph = plan(materialise(said, "said"))
        index = materialise(postings(docs, graph.terms), "postings")
        n_docs, all_terms = index.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        df = dict(index.select(F.explode("term").alias("t")).groupBy("t").agg(F.count("*")).collect())
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(graph.terms))], np.int64)
        found = index.where("size(term) > 0").mapInArrow(_ranked(graph, weight, n_docs, all_terms or 1, best), "item long, doc_id long, score long")
        rank = F.row_number().over(W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
        top = found.withColumn("rank", rank).where(F.col("rank") <= best).join(number, "item")
        out.append(materialise(top.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "found"))
        discard(index)
    discard(merged)
    return reduce(DataFrame.union, out)
