"""Written stores of genomes and alignments that are read in part: by contig and region.

A store is a Parquet table in folders of contig groups, sorted by contig and place inside each file, so that a read of some
contigs opens only their folders and a region only the row groups that hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoloom.operators.structure import genome_chunks

GROUPS, CHUNK, BIN = 64, 1 << 16, 1 << 14


def _group(contig: Column, groups: int) -> Column:
    return F.pmod(F.xxhash64(contig), F.lit(groups)).cast("int")


def _write(rows: DataFrame, path: str, place: str) -> None:
    rows.repartitionByRange("group", "contig", place).sortWithinPartitions("group", "contig", place).write.option("parquet.block.size", 8 << 20).partitionBy("group").parquet(path)


def write_genome(genome: DataFrame, path: str, chunk: int = CHUNK, groups: int = GROUPS) -> None:
    """Cut ``genome(contig, seq)`` once and store it as (group, contig, chunk, piece), ``chunk`` bases a piece."""
    _write(genome_chunks(genome, chunk).withColumn("group", _group(F.col("contig"), groups)), path, "chunk")


def read_genome(spark: SparkSession, path: str, contigs: list[str] | None = None, groups: int = GROUPS) -> DataFrame:
    """(contig, chunk, piece) of a stored genome, of the listed contigs only: a few names, as a user gives them."""
    rows = spark.read.schema("contig string, chunk int, piece string, group int").parquet(path)
    if contigs is None:
        return rows.drop("group")
    some = spark.range(1).select(F.explode(F.lit(contigs)).alias("contig")).select(_group(F.col("contig"), groups)).distinct()
    return rows.where(F.col("group").isin(*(g for (g,) in some.collect())) & F.col("contig").isin(*contigs)).drop("group")


def write_alignments(aln: DataFrame, path: str, groups: int = GROUPS) -> None:
    """Store ``aln(rid, contig, start, cigar, ...)`` with ``end`` and the bins of start and end, sorted by contig and start."""
    width = F.aggregate(F.regexp_extract_all("cigar", F.lit("([0-9]+)[MDNX=]"), F.lit(1)), F.lit(0).cast("long"), lambda n, x: n + x.cast("long"))
    rows = aln.withColumn("start", F.col("start").cast("long")).withColumn("end", F.col("start") + width)
    _write(rows.withColumn("group", _group(F.col("contig"), groups)), path, "start")


def read_alignments(spark: SparkSession, path: str, regions: list[tuple[str, int, int]] | None = None, groups: int = GROUPS) -> DataFrame:
    """The stored alignments that overlap one of ``regions(contig, lo, hi)``, half open; all without regions.

    Folders are pruned by contig; row groups by contig, start and end, whose smallest and largest values Parquet keeps.
    """
    rows = spark.read.parquet(path)
    if regions is None:
        return rows.drop("group")
    contigs = sorted({c for c, _, _ in regions})
    some = spark.range(1).select(F.explode(F.lit(contigs)).alias("contig")).select(_group(F.col("contig"), groups)).distinct()
    hit = F.lit(False)
    for c, lo, hi in regions:
        hit = hit | ((F.col("contig") == c) & (F.col("start") < hi) & (F.col("end") > lo))
    return rows.where(F.col("group").isin(*(g for (g,) in some.collect())) & hit).drop("group")
