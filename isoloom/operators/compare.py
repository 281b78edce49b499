"""Joins, set comparisons and search-hit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isoloom.shared import materialise

INTRON = ["chr", "s", "e"]


def novel_introns(query: DataFrame, reference: DataFrame, min_support: int = 5) -> DataFrame:
    """Supported query introns that are no reference intron; the strand doesn't count, duplicates stay."""
    return query.where(F.col("support") >= min_support).join(reference.select(INTRON), INTRON, "left_anti")


def novel_introns_counts(query: DataFrame, reference: DataFrame, min_support: int = 5) -> DataFrame:
    """One row: (total, novel) supported introns, in one pass over the query."""
    known = reference.select(INTRON).distinct().withColumn("known", F.lit(True))
    return query.where(F.col("support") >= min_support).join(known, INTRON, "left").agg(F.count("*").alias("total"), F.count_if(F.col("known").isNull()).alias("novel"))


def shared_introns(query: DataFrame, reference: DataFrame) -> DataFrame:
    return query.join(reference.select(INTRON), INTRON, "left_semi")


def shared_introns_counts(query: DataFrame, reference: DataFrame) -> DataFrame:
    known = reference.select(INTRON).distinct().withColumn("known", F.lit(True))
    return query.join(known, INTRON, "left").agg(F.count_if("known").alias("overlap"), F.count_if(F.col("known").isNull()).alias("non_overlap"))


def assign_by_chain(chains: DataFrame, reference: DataFrame) -> DataFrame:
    """(tx, ref): the smallest reference id with the same chromosome and introns, else a dot; strands don't count."""
    ids = reference.where(F.size("chain") > 0).groupBy("chr", "chain").agg(F.min("tx").cast("string").alias("ref"))
    return chains.where(F.size("chain") > 0).join(ids, ["chr", "chain"], "left").select("tx", F.coalesce("ref", F.lit(".")).alias("ref"))


def assign_by_overlap(query: DataFrame, genes: DataFrame, width: int = 1 << 10) -> DataFrame:
    """(qid, gene): the first gene by (start, end, id) on the chromosome that overlaps, closed ends; else a dot.

    A gene is listed under each bin of ``width`` it touches, a query joins the bins it touches, and the range
    test decides: an equi-join whatever the intervals. The smallest match is taken by aggregation, so
    meeting in several bins doesn't matter. Of the genes of a bin that begin before it only the first of each end that no
    earlier one reaches can be a first match there, so long genes that lie over one another aren't all listed.
    """
    bins = lambda: F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))
    right = genes.select(F.col("chr"), F.col("gid"), F.col("s").alias("gs"), F.col("e").alias("ge"), F.explode(bins()).alias("bin"))
    # A gene is of use in a bin if it reaches further than all that come before it in order.
    earlier = W.partitionBy("chr", "bin").orderBy("gs", "ge", "gid").rowsBetween(W.unboundedPreceding, -1)
    right = materialise(right.withColumn("reached", F.max("ge").over(earlier)).where("reached is null or ge > reached").drop("reached"), "genes")
    left = query.select("qid", "chr", "s", "e", F.explode(bins()).alias("bin"))
    met = left.join(right, ["chr", "bin"]).where("s <= ge and e >= gs")
    first = met.groupBy("qid").agg(F.min(F.struct("gs", "ge", "gid")).alias("g")).select("qid", F.col("g.gid").cast("string").alias("gene"))
    return query.select("qid").join(first, "qid", "left").select("qid", F.coalesce("gene", F.lit(".")).alias("gene"))


def novel_loci(records: DataFrame, tracking: DataFrame, codes: tuple[str, ...] = ("u", "p", "y", "i", "x", "s")) -> DataFrame:
    """Records whose id has a novel class code; ``tracking(read_id, code)``."""
    return records.join(tracking.where(F.col("code").isin(*codes)).select("read_id"), "read_id", "left_semi")


def reads_to_clusters(reads: DataFrame, assignment: DataFrame) -> DataFrame:
    return reads.join(assignment, "read_id")


def compare_sets(reference: DataFrame, query: DataFrame) -> DataFrame:
    """(tp, fp, fn, precision, recall) of the distinct values of the one column of each side.

    Both sides meet in one aggregation by value; nothing is joined.
    """
    both = reference.toDF("x").select("x", F.lit(1).alias("r"), F.lit(0).alias("q")).union(query.toDF("x").select("x", F.lit(0), F.lit(1)))
    each = both.where("x is not null").groupBy("x").agg(F.max("r").alias("r"), F.max("q").alias("q"))
    counts = each.agg(*(F.count_if((F.col("r") == r) & (F.col("q") == q)).alias(n) for n, r, q in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0))))
    return counts.select("tp", "fp", "fn", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"))


def best_hit(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query, subject, evalue): the first listed match of every query and its first stretch, ``----`` without one."""
    first = hits.groupBy("query").agg(F.min(F.struct("match_rank", "hsp_rank", "subject", "evalue")).alias("h"))
    return queries.join(first, "query", "left").select("query", F.coalesce(F.col("h.subject").cast("string"), F.lit("----")).alias("subject"), F.col("h.evalue").alias("evalue"))


def compare_hits(reference: DataFrame, queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(tp_queries, fp, tp_refs, fn, precision, recall): queries with and without a match, reference ids that are and
    are not the first match of a query."""
    top = best_hit(queries, hits)
    q = top.agg(F.count_if(F.col("subject") != "----").alias("tp_queries"), F.count_if(F.col("subject") == "----").alias("fp"))
    found = top.where("subject <> '----'").select("subject").distinct().withColumn("hit", F.lit(True))
    r = reference.select(F.col("subject").cast("string").alias("subject")).distinct().join(found, "subject", "left").agg(F.count_if("hit").alias("tp_refs"), F.count_if(F.col("hit").isNull()).alias("fn"))
    both = q.withColumn("k", F.lit(1)).join(r.withColumn("k", F.lit(1)), "k")
    return both.select("tp_queries", "fp", "tp_refs", "fn", F.try_divide("tp_queries", F.col("tp_queries") + F.col("fp")).alias("precision"), F.try_divide("tp_refs", F.col("tp_refs") + F.col("fn")).alias("recall"))


def hit_percentages(hits: DataFrame) -> DataFrame:
    """``hits`` with the percentages of identities, positives and gaps: 100 * numerator / denominator."""
    return hits.withColumns({f"{n}_pct": F.try_divide(F.col(f"{n}_num") * 100.0, F.col(f"{n}_den")) for n in ("id", "pos", "gap")})


def as_metrics(row: DataFrame) -> DataFrame:
    """A row of figures as rows (metric, value)."""
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns))).alias("x")).select("x.*")


def membership(chains: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Per (chr, strand, chain): in which sets it is, one boolean per name of ``kinds``."""
    return chains.groupBy("chr", "strand", "chain").agg(*(F.bool_or(F.col("kind") == v).alias(n) for n, v in kinds.items()))


def novel_isoforms(member: DataFrame) -> DataFrame:
    """Seven counts over membership(q, r1, r2)."""
    q, r1, r2 = F.col("q"), F.col("r1"), F.col("r2")
    return member.agg(
        F.count_if(q).alias("n_q"), F.count_if(r1).alias("n_r1"), F.count_if(r2).alias("n_r2"), F.count_if(q & ~r1).alias("q_r1"), F.count_if(q & ~r2).alias("q_r2"), F.count_if(r1 & ~r2).alias("r1_r2"), F.count_if(q & ~r1 & ~r2).alias("q_r1_r2")
    )


def union_clusters(first: DataFrame, *others: DataFrame) -> DataFrame:
    for o in others:
        first = first.unionByName(o)
    return first
