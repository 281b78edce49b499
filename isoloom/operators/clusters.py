"""Collapsing aligned reads and clustering them by shared splice sites or by overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isoloom.operators.components import connected_components
from isoloom.shared import materialise


def primary_alignments(aln: DataFrame) -> DataFrame:
    """Without secondary, supplementary and unmapped records."""
    return aln.where(F.col("flag").bitwiseAND(F.lit(0x904)) == 0)


def _collapsed(rows: DataFrame, key: list[str], names: bool) -> DataFrame:
    more = [F.array_sort(F.collect_list("read_id")).alias("reads")] if names else []
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min("read_id").alias("first_read"), *more)


def collapse_by_chain(reads: DataFrame, names: bool = False) -> DataFrame:
    """Spliced reads (read_id, contig, strand, introns) by exact introns: (contig, strand, introns, n, first_read).

    With ``names`` also the list of their reads, which is one row however many they are; operators that need the
    reads of a chain join them by its introns instead.
    """
    return _collapsed(reads.where(F.size("introns") > 0), ["contig", "strand", "introns"], names)


def collapse_unspliced(reads: DataFrame, names: bool = False) -> DataFrame:
    """Reads without introns by exact interval."""
    return _collapsed(reads.where(F.size("introns") == 0), ["contig", "strand", "start", "end"], names)


def junction_weights(chains: DataFrame) -> DataFrame:
    """(contig, kind, pos, weight): reads per donor and acceptor position."""
    site = F.explode(F.flatten(F.transform("introns", lambda x: F.array(F.struct(F.lit("donor").alias("kind"), x["s"].alias("pos")), F.struct(F.lit("acceptor").alias("kind"), x["e"].alias("pos"))))))
    return chains.select("contig", "n", site.alias("x")).groupBy("contig", "x.kind", "x.pos").agg(F.sum("n").alias("weight"))


def cluster_sizes(assignment: DataFrame) -> DataFrame:
    return assignment.groupBy("cluster").agg(F.count("*").alias("n"))


def site_graph(chains: DataFrame) -> DataFrame:
    """(contig, strand, introns, site): chains and their splice sites; donors and acceptors share one space."""
    return chains.select("contig", "strand", "introns", F.explode(F.array_distinct(F.flatten(F.transform("introns", lambda x: F.array(x["s"], x["e"]))))).alias("site"))


def splice_clusters(chains: DataFrame) -> DataFrame:
    """(contig, strand, introns, component): chains that share sites, directly or through others.

    A chain is tied to the smallest site it has, and a site is a 64-bit name of (contig, strand, position), so the
    edges are site to site and long chain keys stay out of the rounds. component is the smallest name.
    """
    named = chains.withColumn("sites", F.array_sort(F.array_distinct(F.flatten(F.transform("introns", lambda x: F.array(x["s"], x["e"]))))))
    name = lambda p: F.xxhash64("contig", "strand", p)
    named = named.withColumn("first", name(F.get("sites", F.lit(0))))
    edges = named.select(F.col("first").alias("u"), F.explode("sites").alias("p"), "contig", "strand").select("u", name(F.col("p")).alias("v")).distinct()
    parts = connected_components(edges)
    return named.join(parts, named["first"] == parts.node).select("contig", "strand", "introns", "component")


def _ahead(rows: DataFrame, key: list[str], bin_: Column, carry: dict[str, Column]) -> DataFrame:
    """``rows`` with ``bin`` and, for each name of ``carry``, that aggregate of a bin carried over all bins before it.

    ``bin_`` must not decrease along the order that matters. Names that begin with n are summed, others are maxima. Windows
    run over rows of one bin, and over bins, never over all rows of a key.
    """
    binned = rows.withColumn("bin", bin_)
    per = binned.groupBy(*key, "bin").agg(*(c.alias(n) for n, c in carry.items()))
    before = W.partitionBy(*key).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    per = per.select(*key, "bin", *((F.coalesce(F.sum(n).over(before), F.lit(0)) if n.startswith("n") else F.max(n).over(before)).alias(n) for n in carry))
    return binned.join(materialise(per, "bins"), [*key, "bin"])


def ranked(rows: DataFrame, key: list[str], order: list[str], bin_: Column) -> DataFrame:
    """``rows`` with ``rank`` from 1 within ``key``, by ``order``; ``bin_`` must not decrease along it."""
    w = W.partitionBy(*key, "bin").orderBy(*order)
    return _ahead(rows, key, bin_, {"n_ahead": F.count("*")}).withColumn("rank", F.row_number().over(w) + F.col("n_ahead")).drop("bin", "n_ahead")


_WIDTH = 1 << 14  # positions in a bin


def assign_reads(reads: DataFrame, clusters: DataFrame) -> DataFrame:
    """(contig, read_id, cluster): clusters numbered by (contig, strand, smallest chain), from 0 within each contig.

    Numbers go on from one strand to the other. They are ranks among a contig's clusters, never among reads. ``clusters`` has
    a row per chain and is written, so that adaptive execution can split the reads of a hot chain.
    """
    key = ["contig", "strand", "introns"]
    clusters = materialise(clusters.select(*key, "component"), "clusters")
    least = clusters.groupBy("contig", "strand", "component").agg(F.min("introns").alias("least"))
    # Strands in order: - comes after + in no bin, so the strand leads the bin.
    place = F.when(F.col("strand") == "+", 0).when(F.col("strand") == "-", 1).otherwise(2) * F.lit(1 << 40) + F.floor(F.get("least", F.lit(0))["s"] / _WIDTH)
    numbers = ranked(least, ["contig"], ["strand", "least"], place).select("contig", "strand", "component", (F.col("rank") - 1).alias("cluster"))
    with_number = materialise(clusters.join(numbers, ["contig", "strand", "component"]).select(*key, "cluster"), "numbers")
    return reads.where(F.size("introns") > 0).join(with_number, key).select("contig", "read_id", "cluster")


def sort_chains(chains: DataFrame) -> DataFrame:
    """Rank of each chain in its contig and strand: by intron pairs, a prefix first."""
    return ranked(chains, ["contig", "strand"], ["introns"], F.floor(F.get("introns", F.lit(0))["s"] / _WIDTH))


def sort_unspliced(reads: DataFrame) -> DataFrame:
    """Rank of each unspliced read or interval in its contig and strand: by start, then end."""
    return ranked(reads, ["contig", "strand"], ["start", "end"], F.floor(F.col("start") / _WIDTH))


def overlap_clusters(reads: DataFrame) -> DataFrame:
    """(contig, strand, start, end, island): merged closed intervals of unspliced reads, numbered from 1.

    The furthest end before each bin of starts is carried over the bins, as is then the number of islands.
    """
    key = ["contig", "strand"]
    w = W.partitionBy(*key, "bin").orderBy("start", "end")
    at = F.floor(F.col("start") / _WIDTH)
    rows = _ahead(reads, key, at, {"furthest": F.max("end")})
    ahead = F.greatest(F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)), F.col("furthest"))
    rows = materialise(rows.withColumn("opens", F.when(ahead.isNull() | (F.col("start") > ahead), 1).otherwise(0)).drop("furthest", "bin"), "opens")
    rows = _ahead(rows, key, at, {"n_islands": F.sum("opens")})
    return rows.withColumn("island", F.sum("opens").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col("n_islands")).drop("opens", "bin", "n_islands")


def group_sites(sites: DataFrame, gap: int = 15) -> DataFrame:
    """``sites(contig, pos, weight)`` with the number of the group: a step beyond ``gap`` begins a new one."""
    w = W.partitionBy("contig", "bin").orderBy("pos")
    at = F.floor(F.col("pos") / _WIDTH)
    rows = _ahead(sites, ["contig"], at, {"last": F.max("pos")})
    before = F.coalesce(F.lag("pos").over(w), F.col("last"))
    rows = materialise(rows.withColumn("opens", F.when(F.col("pos") - before > gap, 1).otherwise(0)).drop("last", "bin"), "opens")
    rows = _ahead(rows, ["contig"], at, {"n_groups": F.sum("opens")})
    return rows.withColumn("grp", F.sum("opens").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col("n_groups")).drop("opens", "bin", "n_groups")


def kde_maxima(sites: DataFrame, gap: int = 15, window: int = 30, stddev: float = 10.0) -> DataFrame:
    """(contig, grp, pos): strict local maxima of the summed Gaussian density within each group of sites.

    Density is defined on the cells from the first to the last position of the group and 0 outside. Cells are compared with the two beside
    them inside bins, whose first and last cells are also in the bins next to them, so that a long group is many tasks.
    """
    grouped = materialise(group_sites(sites, gap), "groups")
    ends = grouped.groupBy("contig", "grp").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    spread = grouped.join(ends, ["contig", "grp"])
    cells = spread.withColumn("cell", F.explode(F.sequence(F.greatest("lo", F.col("pos") - window), F.least("hi", F.col("pos") + window))))
    x = (F.col("pos") - F.col("cell")).cast("double")
    density = cells.groupBy("contig", "grp", "cell").agg(F.round(F.sum(F.col("weight") * F.exp(-(x * x) / (2 * stddev * stddev))), 9).alias("d"))
    # Each cell with its bin, and with the bins of the cells beside it where these are others.
    bins = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor((F.col("cell") + k) / _WIDTH)))
    rows = density.withColumn("bin", F.explode(bins))
    o = W.partitionBy("contig", "grp", "bin").orderBy("cell")
    beside = lambda f, k: F.when(f("cell").over(o) == F.col("cell") + k, f("d").over(o)).otherwise(0.0)
    rows = rows.withColumn("before", beside(F.lag, -1)).withColumn("after", beside(F.lead, 1)).where(F.col("bin") == F.floor(F.col("cell") / _WIDTH))
    return rows.where("d > before and d > after").select("contig", "grp", F.col("cell").alias("pos"))
