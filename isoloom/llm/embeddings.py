"""Embedding near-duplicates: int8 tile products with error bounds, full precision where they can't decide.

Components are first divided by a power of two near the largest, which is exact, so that no square over- or
underflows. A vector u of length one is rounded to q / s with integers q of at most 127 and s = 127 / max|u|;
e = |u - q/s| is its own rounding error. For two vectors
    |u.w - (q_u/s_u).(q_w/s_w)| <= e_u + (1 + e_u) * e_w
since |w| = 1 and |q_u/s_u| <= 1 + e_u. Pairs whose integer product is further than that bound from the
threshold are settled, either way. The integer products run as float32 matrix products, which are exact while every
partial sum stays below 2**24 (checked by dimension).

Rows of one label are cut into blocks and every pair of blocks is a tile, so that no label, however
large, is one task. A tile gets int8 rows, scales and errors only; it returns a link count per vector, the spanning stars of
its components, and the vectors that have pairs it can't settle. Those alone are sent to the tile again, in doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.operators.components import connected_components
from isoloom.shared import materialise

THRESHOLD = 0.93
BLOCK = 2048
_EXACT = 2**24 // 127**2
_SLACK = 1e-9  # more than the double arithmetic of either side can be off
_COUNT, _EDGE, _UNSETTLED = 0, 1, 2
_TILE = ["label", "dim", "i", "j"]


def halved(x: np.ndarray) -> np.ndarray:
    """Rows of doubles, each times the power of two that brings its largest component to between 0.5 and 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows -> (int8 rows, scales, rounding errors with room for the double arithmetic itself)."""
    scale = 127.0 / np.abs(unit).max(axis=1)
    q = np.rint(unit * scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - q / scale[:, None]) ** 2).sum(axis=1)) + 1e-12
    return q, scale, error


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., dim, embedding) with (q, scale, error) added; all embeddings are usable."""
    for b in batches:
        dims = b.column("dim").to_numpy()
        q, scale, error = np.empty(len(b), object), np.empty(len(b)), np.empty(len(b))
        flat = b.column("embedding")
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            x = halved(np.array(flat.take(pa.array(at)).to_pylist(), np.float64))
            own, scale[at], error[at] = quantise(x / np.sqrt((x * x).sum(axis=1))[:, None])
            q[at] = [r.tobytes() for r in own]
        columns = [pa.array(list(q), pa.binary()), pa.array(scale), pa.array(error)]
        yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, "q", "scale", "error"])


def settle(left: tuple, right: tuple, threshold: float, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(linked, unsettled), boolean matrices of quantised rows (q, scales, errors) of two blocks."""
    (qa, sa, ea), (qb, sb, eb) = left, right
    linked, unsettled = (np.zeros((len(qa), len(qb)), bool) for _ in range(2))
    kind = np.float32 if qa.shape[1] <= _EXACT else np.float64
    columns = qb.T.astype(kind)
    for at in range(0, len(qa), step):
        to = at + step
        product = (qa[at:to].astype(kind) @ columns) / (sa[at:to, None] * sb[None, :])
        bound = _SLACK + ea[at:to, None] + (1 + ea[at:to, None]) * eb[None, :]
        linked[at:to] = product >= threshold + bound
        unsettled[at:to] = (product >= threshold - bound) & ~linked[at:to]
    return linked, unsettled


def exact_links(rows: np.ndarray, columns: np.ndarray, unsettled: np.ndarray, threshold: float) -> np.ndarray:
    """``unsettled`` without the pairs whose cosine in doubles doesn't reach ``threshold``."""
    rows, columns = halved(rows), halved(columns)
    norms = [np.sqrt((x * x).sum(axis=1)) for x in (rows, columns)]
    out = np.zeros_like(unsettled)
    i, j = np.nonzero(unsettled)
    for k in range(0, len(i), 1 << 16):
        a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        out[a, b] = (rows[a] * columns[b]).sum(axis=1) / (norms[0][a] * norms[1][b]) >= threshold
    return out


def _stars(linked: np.ndarray) -> list[tuple[int, int]]:
    """Spanning stars (centre, member) of a symmetric link matrix."""
    out, open_ = [], linked.any(axis=1)
    for centre in np.flatnonzero(open_):
        if not open_[centre]:
            continue
        open_[centre], todo = False, [centre]
        while todo:
            new = np.flatnonzero(linked[todo.pop()] & open_)
            open_[new] = False
            out += [(centre, k) for k in new]
            todo += new.tolist()
    return out


def _tile(threshold: float, exact: bool):
    """One (label, dimension, block, block) -> rows (kind, u, v): link counts of vectors, edges, and, of the first pass, vectors
    with unsettled pairs and their block. The second pass, with doubles, settles these."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = pdf["i"].iloc[0], pdf["j"].iloc[0]
        sides = [pdf[pdf["part"] == part].sort_values("vec_id") for part in dict.fromkeys((first, second))]
        rows = [(np.frombuffer(b"".join(x["q"]), np.int8).reshape(len(x), -1), x["scale"].to_numpy(), x["error"].to_numpy()) for x in sides]
        if min(map(len, sides)) == 0:
            return pd.DataFrame(columns=["kind", "u", "v", *_TILE])
        linked, unsettled = settle(rows[0], rows[-1], threshold)
        if exact:
            doubles = [np.array(x["embedding"].tolist(), np.float64) for x in sides]
            linked = exact_links(doubles[0], doubles[-1], unsettled, threshold)
        ids = np.concatenate([x["vec_id"].to_numpy() for x in sides])
        if first == second:
            for m in (linked, unsettled):
                np.fill_diagonal(m, False)
                m |= m.T
            counts, open_, parts = linked.sum(axis=1), unsettled.any(axis=1), np.full(len(ids), first)
            graph = linked
        else:
            n = len(sides[0])
            counts = np.r_[linked.sum(axis=1), linked.sum(axis=0)]
            open_, parts = np.r_[unsettled.any(axis=1), unsettled.any(axis=0)], np.r_[np.full(n, first), np.full(len(ids) - n, second)]
            graph = np.zeros((len(ids), len(ids)), bool) if linked.any() else np.zeros((0, 0), bool)
            if len(graph):
                graph[:n, n:] = linked
                graph |= graph.T
        star = np.array(_stars(graph) or np.zeros((0, 2), int), int)
        some, late = np.flatnonzero(counts), np.flatnonzero(open_) if not exact else np.zeros(0, int)
        return pd.DataFrame({
            "kind": np.repeat(np.array([_COUNT, _EDGE, _UNSETTLED], np.int32), [len(some), len(star), len(late)]),
            "u": np.r_[ids[some], ids[star[:, 0]], ids[late]].astype("int64"),
            "v": np.r_[counts[some], ids[star[:, 1]], parts[late]].astype("int64"),
        }).assign(label=pdf["label"].iloc[0], dim=pdf["dim"].iloc[0], i=first, j=second)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Every row of ``vectors(vec_id, embedding, label)`` as (vec_id, n_links, component_id, kept).

    Vectors link when labels are equal and not null and their cosine in doubles is at least ``threshold``.
    Null, empty and zero vectors, and those with null or non-finite components, link with nothing, nor do
    vectors of different length; vectors of any length are compared whole, and finite components of any size. Rows that repeat
    a vec_id count as one vector (the smallest by label and components) and each get its result. A row without
    vec_id has no links and is kept. An empty table gives no rows; other columns, whatever their names, aren't read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label"))
    bad = F.lit(float("inf"))
    usable = (
        (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < bad))
        & F.exists("embedding", lambda x: x != 0)
    )
    one = rows.where("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("x"))
    good = one.select("vec_id", "x.*").where(F.col("label").isNotNull() & F.coalesce(usable, F.lit(False))).withColumn("dim", F.size("embedding"))
    plain = F.col("label").cast("string")  # labels of any type travel as text
    good = good.select("vec_id", plain.alias("label"), "dim", "embedding").mapInArrow(_quantised, "vec_id long, label string, dim int, embedding array<double>, q binary, scale double, error double")
    good = materialise(good, "vectors")
    # Written first, so that adaptive execution can split the rows of a label that very many have.
    sizes = materialise(good.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("nb")), "labels")
    cut = good.select("vec_id", "label", "dim", "q", "scale", "error").join(sizes, ["label", "dim"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("nb")).cast("int"))
    tiles = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(*_TILE[:2], F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "vec_id", "q", "scale", "error")
    kind = "kind int, u long, v long, label string, dim int, i int, j int"
    settled = materialise(tiles.groupBy(_TILE).applyInPandas(_tile(threshold, False), kind), "vector-links")
    again = settled.where(F.col("kind") == _UNSETTLED).select(*_TILE, F.col("v").cast("int").alias("part"), F.col("u").alias("vec_id"))
    doubles = good.select("vec_id", "q", "scale", "error", "embedding")
    exact = materialise(again.join(doubles, "vec_id").groupBy(_TILE).applyInPandas(_tile(threshold, True), kind), "vector-links")
    found = settled.union(exact)
    counts = found.where(F.col("kind") == _COUNT).groupBy(F.col("u").alias("vec_id")).agg(F.sum("v").alias("n_links"))
    parts = connected_components(found.where(F.col("kind") == _EDGE).select("u", "v")).withColumnRenamed("node", "vec_id").withColumnRenamed("component", "component_id")
    component = F.coalesce("component_id", "vec_id")
    return (
        rows.select("vec_id").join(counts, "vec_id", "left").join(parts, "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
    )
