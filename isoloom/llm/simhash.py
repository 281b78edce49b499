"""SimHash near-duplicates: fingerprints, a byte-position index with count filtering, components.

Two fingerprints that differ in at most 4 of 64 bits share at least 4 of their 8 bytes. A posting list
per (position, byte) would hold 1/256 of all fingerprints, so postings are compound: three positions
and their bytes, 2**24 values each. The 20 triples below are chosen so that every 4 of the 8 positions
contain one of them; hence any two fingerprints with 4 shared bytes meet in some list. Within a list
the shared positional bytes of a pair are tallied, pairs with fewer than 4 are dropped, and the
rest are verified by counting differing bits.

Long lists (groups of near copies) are cut into blocks, every pair of blocks is one tile, and a tile
returns the spanning stars of its components rather than its pairs: no link between different
fingerprints is lost for the components, and none is multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.operators.components import connected_components
from isoloom.shared import materialise

SHINGLE = 4
MAX_BITS = 4
BLOCK = 1024
#: Positions in three parts; triples inside a part, or two of a part and one of the next.
_PARTS = ((0, 1, 2), (3, 4, 5), (6, 7))
TRIPLES = [
    *(t for p in _PARTS for t in combinations(p, 3)),
    *((*two, one) for k, p in enumerate(_PARTS) for two in combinations(p, 2) for one in _PARTS[(k + 1) % 3]),
]


def fingerprint(text: str | None, shingle: int = SHINGLE, rows: int = 1 << 15) -> int:
    """64-bit SimHash, signed: bit set where over half the shingle hashes have it. No words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, rows):
        h = np.array([digest(b" ".join(words[i : i + shingle]), 42) for i in range(at, min(n, at + rows))], "<u8")
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp) per row of ``docs``; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fps], names=["doc_id", "text_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def _stars(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Indices (centre, member) of spanning stars of the link graph of ``fps``."""
    m, need = len(fps), 8 - max_bits
    linked = np.zeros((m, m), bool)
    for at in range(0, m, 256):
        x = fps[at : at + 256, None] ^ fps[None, :]
        shared = (x.view(np.uint8).reshape(len(x), m, 8) == 0).sum(axis=2, dtype=np.uint8)  # tally
        i, j = np.nonzero(shared >= need)
        ok = np.bitwise_count(x[i, j]) <= max_bits
        linked[at + i[ok], j[ok]] = True
    out, open_ = [], np.ones(m, bool)
    for centre in range(m):
        if not open_[centre]:
            continue
        open_[centre], todo = False, [centre]
        while todo:
            new = np.flatnonzero(linked[todo.pop()] & open_)
            open_[new] = False
            out += [(centre, int(k)) for k in new]
            todo += new.tolist()
    return out


def _link_tiles(max_bits: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def of(key: np.ndarray, rep: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        two = starts[sizes == 2]
        x = fp[two] ^ fp[two + 1]
        shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        two = two[(shared >= 8 - max_bits) & (np.bitwise_count(x) <= max_bits)]
        us, vs = [rep[two]], [rep[two + 1]]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            if star := _stars(fp[s : s + n], max_bits):
                c, k = np.array(star).T
                us.append(rep[s + c])
                vs.append(rep[s + k])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            tile = b.column(0).to_numpy(zero_copy_only=False)
            cols = [tile, b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            last = int(np.flatnonzero(cols[0] == cols[0][-1])[0])  # the last tile may go on in the next batch
            if last:
                yield of(*(c[:last] for c in cols))
            held = [c[last:] for c in cols]
        if held is not None and len(held[0]):
            yield of(*held)

    return run


def links(prints: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(u, v) edges that connect exactly what links of at most ``max_bits`` differing bits connect.

    ``prints(rep, fp)`` holds each fingerprint once. ``max_bits`` is at most 4, which the triples rely on.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("the index guarantees pairs of at most 4 differing bits")
    byte = [F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]
    keys = [F.lit(k << 24) + byte[a] * 65536 + byte[b] * 256 + byte[c] for k, (a, b, c) in enumerate(TRIPLES)]
    index = prints.select("rep", "fp", F.explode(F.array(*keys)).alias("key"))
    shared = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    index = index.join(shared, "key").withColumn("nb", F.ceil(F.col("n") / block).cast("int"))
    part = F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: j != F.col("part"))
    tiles = (
        index.withColumn("part", part)
        .withColumn("other", F.explode(F.when(F.col("nb") == 1, F.array(F.lit(0))).otherwise(others)))
        .select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("tile"), "rep", "fp")
    )
    # Two tiles under one 64-bit name would only add verified comparisons, never a wrong link.
    return tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(_link_tiles(max_bits), "u long, v long").distinct()


def _grouped(docs: DataFrame, max_bits: int, shingle: int) -> DataFrame:
    """(doc_id, text_key, fp, component_id) per row of ``docs``."""
    prints = materialise(fingerprints(docs, shingle), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    parts = connected_components(links(nodes.where("rep is not null"), max_bits))
    named = nodes.join(parts, nodes.rep == parts.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """Every row of ``docs`` as (doc_id, fingerprint, component_id).

    Only ``doc_id`` and ``text`` are read. Null or blank texts have fingerprint zero and link like any
    other. Equal texts share a fingerprint and so a component, without pairs among them. Repeated rows
    give repeated rows; rows without a doc_id are returned with the component of their fingerprint.
    Texts of any length are read whole; an empty table gives no rows. A bit set in exactly half the shingles is 0.
    """
    return _grouped(docs, max_bits, shingle).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` for each component of near duplicates, that with the smallest doc_id.

    A row without a doc_id stays only if its whole component has none. All columns are returned, whatever their names. Of rows that share
    the smallest doc_id one stays, any of them if they are equal, else that of the smallest text hash. An empty table stays empty.
    """
    rows = _grouped(docs, max_bits, shingle)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    alone = F.when(F.col("component_id").isNull(), F.col("fp"))
    kept = rows.groupBy("component_id", alone.alias("alone")).agg(first.alias("first")).select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_key").alias("kept_key"))
    keyed = docs.withColumn("kept_id_", F.col("doc_id").cast("long")).withColumn("kept_key_", F.xxhash64("text"))
    on = keyed.kept_id_.eqNullSafe(kept.kept_id) & (keyed.kept_key_ == kept.kept_key)
    return keyed.join(kept, on, "left_semi").dropDuplicates(["kept_id_", "kept_key_"]).drop("kept_id_", "kept_key_")
