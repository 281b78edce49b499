"""Sharding by weighted rendezvous hashing, built-in functions only.

Every record draws one number per shard from a digest of its key and the shard's id; the shard whose number, stretched by its
weight, is largest takes it. A shard's numbers don't depend on which others there are, so a shard that is added takes
records only into itself, one that is taken away gives up only its own, and a changed weight moves records only from or to that shard.

Slots number the records of a shard without gaps. A shard is no unit of work: records are ordered by bits of another digest,
these bits cut every shard to parts of a few thousand rows, and a part's first slot is the sum of the parts before it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isoloom.functions.sequences import once
from isoloom.shared import materialise

SHARDS = {s: 1.0 for s in range(16)}
#: Rows of a part, about; slots don't depend on it.
PART_ROWS = 4096


def _digits(text: Column) -> Column:
    """52 bits of a digest as a long."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def _key(key: Column) -> Column:
    """A null key is a key of its own."""
    return F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("n"))


def draws(key: Column, shards: Mapping[int, float]) -> Column:
    """What a record draws for each shard, in the order of ``shards``: structs (score, id), greater is better, the smaller id
    among equals (``id`` is negated for that)."""
    if not shards or min(shards.values()) <= 0:
        raise ValueError("there must be shards, and weights above 0")
    every = F.array(*(F.struct(F.lit(int(s)).alias("id"), F.lit(float(w)).alias("w")) for s, w in shards.items()))
    u = lambda s: (_digits(F.concat(_key(key), F.lit(":"), s["id"].cast("string"))) + 0.5) / float(1 << 52)
    return F.transform(every, lambda s: F.struct((s["w"] / -F.ln(u(s))).alias("score"), (-s["id"]).alias("id")))


def assign(docs: DataFrame, shards: Mapping[int, float] = SHARDS, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """``docs`` with the int column ``name``: the shard (id -> weight) of each row by its ``key``.

    Only the key decides: repeated rows and rows of equal keys share a shard, rows without a key share one. A column ``name`` that
    is there already is replaced. No row moves; an empty table stays empty, texts aren't read.
    """
    return docs.withColumn(name, (-F.array_max(draws(F.col(key), shards))["id"]).cast("int"))


def moves(docs: DataFrame, before: Mapping[int, float], after: Mapping[int, float], key: str = "doc_id") -> DataFrame:
    """(from_shard, to_shard, n_rows): what changing the shards from ``before`` to ``after`` would move; rows that stay are there with
    equal shards. Shards may differ in number and weight. An empty table has no rows."""
    both = assign(assign(docs.select(key), before, key, "from_shard"), after, key, "to_shard")
    return both.groupBy("from_shard", "to_shard").agg(F.count("*").alias("n_rows"))


def number(rows: DataFrame, order: Column, part_rows: int = PART_ROWS) -> DataFrame:
    """``rows`` with the long column ``slot``, from 0 without gaps in each ``shard``, by ``order``, a long of 52 evenly spread bits, and
    then by all columns.

    Rows that are equal in all columns are one row with a count until the end: a group of copies, however large, is numbered as one and
    dealt out in runs. All columns must be of types that can be ordered. Slots don't depend on partitions or ``part_rows``.
    """
    columns = [c for c in rows.columns if c != "slot"]
    same = materialise(rows.select(*columns, order.alias("_o")).groupBy(*columns, "_o").agg(F.count("*").alias("_n")), "sharded")
    n = same.agg(F.sum("_n")).first()[0] or 0
    bits = max(0, (n // part_rows).bit_length() - 1)
    same = same.withColumn("_part", F.shiftright("_o", 52 - bits))
    part = W.partitionBy("shard", "_part")
    parts = same.groupBy("shard", "_part").agg(F.sum("_n").alias("_size"))
    parts = parts.select("shard", "_part", (F.sum("_size").over(W.partitionBy("shard").orderBy("_part")) - F.col("_size")).alias("_base"))
    until = F.sum("_n").over(part.orderBy("_o", *columns).rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = same.withColumn("_until", until).join(parts, ["shard", "_part"]).withColumn("_first", F.col("_base") + F.col("_until") - F.col("_n"))
    last = lambda step: F.least(F.col("_first") + step - 1, F.col("_end"))
    placed = placed.withColumn("_end", F.col("_first") + F.col("_n") - 1)
    few = placed.where(F.col("_n") <= part_rows).select(*columns, F.explode(F.sequence("_first", "_end")).alias("slot"))
    runs = placed.where(F.col("_n") > part_rows).select(*columns, "_end", F.explode(F.sequence("_first", "_end", F.lit(part_rows).cast("long"))).alias("_first"))
    many = runs.repartition("shard", "_first").select(*columns, F.explode(F.sequence(F.col("_first"), last(part_rows))).alias("slot"))
    return few.union(many)


def place(docs: DataFrame, shards: Mapping[int, float] = SHARDS, key: str = "doc_id", part_rows: int = PART_ROWS) -> DataFrame:
    """All columns of ``docs`` with ``shard`` and ``slot``; columns of these names are replaced. See :func:`assign` and :func:`number`.

    Null keys and texts, repeated rows and very long texts are rows like others; an empty table stays empty.
    """
    rows = assign(docs.drop("shard", "slot"), shards, key)
    return number(rows, _digits(F.concat(_key(F.col(key)), F.lit("/"), F.xxhash64(*docs.drop("shard", "slot").columns).cast("string"))), part_rows)


def write(placed: DataFrame, path: str, file_rows: int = 1 << 16) -> None:
    """Write what :func:`place` returns as Parquet in folders ``shard=N``, each file at most ``file_rows`` rows in order of their slots."""
    cut = F.floor(F.col("slot") / file_rows)
    out = placed.repartition("shard", cut).sortWithinPartitions("shard", "slot")
    out.write.option("maxRecordsPerFile", file_rows).partitionBy("shard").parquet(path)


def digests(docs: DataFrame, shards: Mapping[int, float] = SHARDS, part_rows: int = PART_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row by ``doc_id``.

    size is the UTF-8 bytes of the text plus 1; a null text has no bytes and the checksum 0. grown_shard is the shard if there were one
    more, with the mean weight and the next id. Other columns aren't read. Repeated rows give rows of the same shard with slots of their own.
    """
    more = {**shards, max(shards) + 1: sum(shards.values()) / len(shards)}
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = once(rows, d=draws(F.col("doc_id"), more))
    shard = lambda drawn: (-F.array_max(drawn)["id"]).cast("int")
    rows = rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), shard(F.slice("d", 1, len(shards))).alias("shard"), shard(F.col("d")).alias("grown_shard"))
    order = _digits(F.concat(_key(F.col("doc_id")), F.lit("/"), F.col("text_crc32").cast("string")))
    return number(rows, order, part_rows)
