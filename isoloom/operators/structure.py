"""Exons, introns, chains and alignment summaries.

Blocks are (s, e), 0-based and half open; an intron is [end of one exon, start of the next).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isoloom.functions import sequences as S


def blocks_to_exons(bed: DataFrame) -> DataFrame:
    """BED12 rows (chr, start, name, strand, block_sizes, block_starts) -> one row per exon in GTF coordinates."""
    block = F.posexplode(F.arrays_zip("block_starts", "block_sizes")).alias("i", "b")
    start = F.col("start") + F.col("b.block_starts")
    return bed.select("*", block).select("chr", "name", "strand", "i", F.size("block_sizes").alias("n"), (start + 1).alias("exon_start"), (start + F.col("b.block_sizes")).alias("exon_end"))


def bed12_to_gtf(bed: DataFrame, stranded: bool = False) -> DataFrame:
    """(name, feature, chr, start, end, strand, exon_number): a transcript row and its exon rows.

    Exons count from the 5' end on the minus strand if ``stranded``; otherwise the strand is written as a dot.
    """
    strand = F.col("strand") if stranded else F.lit(".")
    number = F.when(F.lit(stranded) & (F.col("strand") == "-"), F.col("n") - F.col("i")).otherwise(F.col("i") + 1)
    exons = blocks_to_exons(bed).select("name", F.lit("exon").alias("feature"), "chr", F.col("exon_start").alias("start"), F.col("exon_end").alias("end"), strand.alias("strand"), number.cast("int").alias("exon_number"))
    whole = bed.select("name", F.lit("transcript").alias("feature"), "chr", (F.col("start") + 1).alias("start"), F.col("end"), strand.alias("strand"), F.lit(None).cast("int").alias("exon_number"))
    return whole.unionByName(exons)


def extract_introns(bed: DataFrame) -> DataFrame:
    """Introns between consecutive blocks of BED12 rows, from the row alone."""
    n = F.size("block_sizes")
    gap = lambda i: F.struct((F.col("start") + F.get("block_starts", i - 1) + F.get("block_sizes", i - 1)).alias("s"), (F.col("start") + F.get("block_starts", i)).alias("e"))
    introns = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), gap))
    return bed.select("chr", "name", "strand", F.explode(introns).alias("x")).select("chr", "name", "strand", "x.s", "x.e")


def exons_to_introns(exons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``exons(tx, chr, strand, n, s, e)`` in file order -> (introns, rejects): exons on another chromosome
    than the one before them in their transcript are rejected."""
    w = W.partitionBy("tx").orderBy("n")
    pairs = exons.withColumn("prev_chr", F.lag("chr").over(w)).withColumn("prev_e", F.lag("e").over(w)).where("prev_chr is not null")
    good = pairs.where("chr = prev_chr").select("tx", "chr", "strand", F.col("prev_e").alias("s"), F.col("s").alias("e"))
    return good, pairs.where("chr <> prev_chr").select("tx", "chr", "prev_chr")


def transcript_chains(exons: DataFrame, start: str = "s", end: str = "e", keep: tuple[str, ...] = ()) -> DataFrame:
    """(tx, chr, strand, chain): the ordered introns of each transcript; one exon has an empty chain."""
    parts = F.array_sort(F.collect_list(F.struct("n", F.col(start).alias("s"), F.col(end).alias("e"))))
    rows = exons.groupBy("tx", *keep).agg(F.min("chr").alias("chr"), F.min("strand").alias("strand"), parts.alias("p"))
    chain = F.transform(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda x, i: F.struct(F.get("p", i)["e"].alias("s"), x["s"].alias("e")))
    return rows.select("tx", *keep, "chr", "strand", chain.alias("chain"))


def intron_chains(exons: DataFrame, start: str = "s", end: str = "e", keep: tuple[str, ...] = ()) -> DataFrame:
    """The set of (chr, strand, chain)."""
    return transcript_chains(exons, start, end, keep).select(*keep, "chr", "strand", "chain").distinct()


def alignment_blocks(aln: DataFrame) -> DataFrame:
    """One row per CIGAR operation that advances on the reference, in order: (rid, contig, i, op, s, e)."""
    ops = aln.select("rid", "contig", "start", "strand", F.posexplode(S.cigar_ops(F.col("cigar"))).alias("i", "o"))
    moved = F.when(F.col("o.op").isin("M", "D", "=", "X", "N"), F.col("o.n")).otherwise(0)
    w = W.partitionBy("rid").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    return ops.withColumn("moved", moved).withColumn("e", F.col("start") + F.sum("moved").over(w)).select("rid", "contig", "strand", "i", F.col("o.op").alias("op"), (F.col("e") - F.col("moved")).alias("s"), "e").where("e > s")


def alignment_summary(aln: DataFrame, stranded: bool = True) -> DataFrame:
    """(rid, contig, strand, start, end, introns) of ``aln(rid, contig, start, cigar, flag)``.

    M, D, = and X advance on the reference, N is an intron and advances. The walk is a fold over the
    operations of a row, so no row moves. Unstranded reads and those with flag 16 are on the minus strand.
    """
    begin = F.struct(F.col("start").cast("long").alias("at"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("introns"))

    def step(acc, o):
        to = acc["at"] + F.when(o["op"].isin("M", "D", "=", "X", "N"), o["n"]).otherwise(0)
        intron = F.array(F.struct(acc["at"].alias("s"), to.alias("e")))
        return F.struct(to.alias("at"), F.when(o["op"] == "N", F.concat(acc["introns"], intron)).otherwise(acc["introns"]).alias("introns"))

    walked = S.once(aln, x=F.aggregate(S.cigar_ops(F.col("cigar")), begin, step))
    strand = F.when(F.lit(not stranded) | (F.col("flag").bitwiseAND(F.lit(16)) != 0), "-").otherwise("+")
    return walked.select("rid", "contig", strand.alias("strand"), F.col("start").cast("long").alias("start"), F.col("x.at").alias("end"), F.col("x.introns").alias("introns"))


def genome_chunks(genome: DataFrame, width: int = 1 << 16) -> DataFrame:
    """``genome(contig, seq)`` -> (contig, chunk, piece): long contigs become many rows."""
    pieces = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    return genome.select("contig", F.posexplode(pieces).alias("chunk", "piece"))


def genome_corrected(aln: DataFrame, genome: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(rid, seq): genome sequence over the exon segments of each read, reverse-complemented on the minus strand."""
    return corrected_from(aln, genome_chunks(genome, width), width)


def corrected_from(aln: DataFrame, chunks: DataFrame, width: int) -> DataFrame:
    """:func:`genome_corrected` with a genome that is cut already: ``chunks(contig, chunk, piece)`` of ``width`` bases."""
    found = alignment_summary(aln)
    edges = F.concat(F.array("start"), F.flatten(F.transform("introns", lambda x: F.array(x["s"], x["e"]))), F.array("end"))
    segments = S.once(found, p=edges).select("rid", "contig", "strand", "p").select("rid", "contig", "strand", F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("p") / 2).cast("int") - 1), lambda k: F.struct(F.get("p", (k * 2).cast("int")).alias("s"), F.get("p", (k * 2 + 1).cast("int")).alias("e")))).alias("i", "x"))
    parts = segments.where("x.e > x.s").select("rid", "contig", "strand", "i", F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.explode(F.sequence(F.floor(F.col("x.s") / width), F.floor((F.col("x.e") - 1) / width))).alias("chunk"))
    joined = parts.join(chunks, ["contig", "chunk"])
    lo, hi = F.greatest("s", F.col("chunk") * width) - F.col("chunk") * width, F.least("e", (F.col("chunk") + 1) * width) - F.col("chunk") * width
    text = joined.select("rid", "strand", "i", "chunk", F.col("piece").substr((lo + 1).cast("int"), (hi - lo).cast("int")).alias("t"))
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "chunk", "t"))), lambda x: x["t"]), "")
    return text.groupBy("rid", "strand").agg(seq.alias("seq")).select("rid", F.when(F.col("strand") == "-", S.rev_comp(F.col("seq"))).otherwise(F.upper("seq")).alias("seq"))
