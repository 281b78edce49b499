"""Readers and writers on small hand-made files."""

import random
import re

from pyspark.sql import functions as F

from isoloom.operators import structure as I
from isoloom.operators import transcripts as T
from isoloom.sources import files as IO
from isoloom.sources import store


def put(tmp_path, name, text):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    return str(p)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_fasta(spark, tmp_path):
    path = put(tmp_path, "c1.x.fa", ">a one\nACG\nTTU\n\n>b\nGG\n")
    got = IO.read_fasta(spark, path)
    assert rows(got, "read_id", "sequence") == [("a one", "ACGTTU"), ("b", "GG")]
    assert [r.read_id for r in got.orderBy("ord").collect()] == ["a one", "b"]
    assert rows(IO.read_cluster_dir(spark, str(tmp_path)), "cluster", "read_id") == [("c1", "a one"), ("c1", "b")]
    assert rows(IO.read_genome(spark, path), "contig", "seq") == [("a", "ACGTTU"), ("b", "GG")]
    IO.write_fasta(got, str(tmp_path / "out"), width=4)
    assert rows(IO.read_fasta(spark, str(tmp_path / "out")), "read_id", "sequence") == [("a one", "ACGTTU"), ("b", "GG")]
    assert rows(IO.fasta_text(got, 3), "value") == [(">a one\nACG\nTTU",), (">b\nGG",)]
    IO.write_by(got.withColumn("bin", F.lit("1-1")), "bin", str(tmp_path / "by"))
    assert {r.bin for r in spark.read.text(str(tmp_path / "by")).collect()} == {"1-1"}


def test_fastq(spark, tmp_path):
    path = put(tmp_path, "r.fq", "@a\nACU\n+\n@!!\n@b\nGG\n+b\n!!\n@a\nT\n+\n@\n")
    got = IO.read_fastq(spark, path)
    assert rows(got, "ord", "read_id", "sequence", "qualities") == [(0, "a", "ACT", "@!!"), (1, "b", "GG", "!!"), (2, "a", "T", "@")]
    assert rows(T.dedupe_first(IO.fastq_to_fasta(got).drop("file"), "read_id", "ord"), "read_id", "sequence") == [("a", "ACT"), ("b", "GG")]
    IO.write_fastq(got.coalesce(1), str(tmp_path / "out"))
    assert rows(IO.read_fastq(spark, str(tmp_path / "out")), "read_id", "qualities") == [("a", "@"), ("a", "@!!"), ("b", "!!")]


def test_intervals(spark, tmp_path):
    bed = IO.read_bed12(spark, put(tmp_path, "x.bed", "chr1\t10\t60\tt1\t0\t+\t0\t0\t0\t3\t5,5,10,\t0,20,40,\nchr1\t5\t9\tt2\t0\t-\t0\t0\t0\t1\t4\t0\n"))
    assert rows(bed, "name", "block_sizes", "block_starts") == [("t1", [5, 5, 10], [0, 20, 40]), ("t2", [4], [0])]
    gtf = '# c\nchr1\ts\tgene\t1\t9\t.\t+\t.\tgene_id "g";\nchr1\ts\texon\t1\t9\t.\t+\t.\tgene_id "g"; transcript_id "t a";\nchr1\ts\texon\t3\t4\t.\t-\t.\tgene_id "g"\n'
    exons, rejects = IO.read_gtf(spark, put(tmp_path, "x.gtf", gtf))
    assert rows(exons, "transcript_id", "start", "end") == [("t", 0, 9)] and rows(rejects, "start") == [(2,)]
    names = IO.read_intron_names(spark, put(tmp_path, "n.txt", "a_b_7::chr2:5-9(-)\n"))
    assert rows(names, "name", "support", "chr", "start", "end", "strand") == [("a_b_7", 7, "chr2", 5, 9, "-")]
    tracking = IO.read_tracking(spark, put(tmp_path, "t.txt", "# x\nA\tB\tC\tu\tq1:tx1|g|0\nA\tB\tC\t=\t-\n"))
    assert rows(tracking, "code", "read_id") == [("u", "tx1")]


def test_alignments(spark, tmp_path):
    sam = "@HD\tx\nr1\t0\tc\t11\t60\t5=\t*\t0\t0\tACGTA\tIIIII\nr2\t256\tc\t1\t0\t1M\t*\t0\t0\tA\tI\nr3\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\n"
    assert rows(IO.read_alignments(spark, put(tmp_path, "a.sam", sam)), "rid", "start", "cigar") == [("r1", 10, "5=")]


def test_report(spark, tmp_path):
    text = (
        "BLASTP 2\n\nQuery= q1 first\n\nLength=50\n\n***** No hits found *****\n\nQuery= q2\nLength=40\n\n> s1 protein\nlong name\nLength=80\n\n Score = 90.1 bits (222),  Expect = 2e-20, Method: x\n"
        " Identities = 30/40 (75%), Positives = 35/40 (88%), Gaps = 2/40 (5%)\n\nQuery  1   MKV-L  4\n           MKV L\nSbjct  3   MKVAL  7\n\n Score = 12 bits (9),  Expect = 0.5, Method: x\n"
        " Identities = 3/4 (75%), Positives = 3/4 (75%), Gaps = 0/4 (0%)\n\nQuery  9   MM  10\n           MM\nSbjct  9   MM  10\n\n"
    )
    got = IO.read_blastp_report(spark, put(tmp_path, "r.txt", text))
    assert [tuple(r) for r in got.orderBy("query", "match_rank", "hsp_rank").select("query", "query_length", "subject", "subject_length", "hsp_rank", "score", "evalue", "id_num", "id_den", "id_pct", "gap_num", "query_seq", "subject_seq").collect()] == [
        ("q1 first", 50, *[None] * 11),
        ("q2", 40, "s1 protein long name", 80, 0, 90.1, 2e-20, 30, 40, 75.0, 2, "MKV-L", "MKVAL"), ("q2", 40, "s1 protein long name", 80, 1, 12.0, 0.5, 3, 4, 75.0, 0, "MM", "MM"),
    ]


def test_graph_text(spark, tmp_path):
    text = "VERSION=LPO.1\nNAME=x\nTITLE=x\nLENGTH=4\nSOURCECOUNT=2\nSOURCENAME=r0\nSOURCEINFO=3 0 1 0 x\nSOURCENAME=r1\nSOURCEINFO=3 0 1 0 y\nA:S0S1\nC:L0S0A2\nG:L0S1A1\nT:L1L2S0S1\n"
    g = IO.read_graph_text(spark, put(tmp_path, "g.po", text))
    assert rows(g["nodes"], "node", "nts") == [(0, "A"), (1, "C"), (2, "G"), (3, "T")]
    assert rows(g["edges"], "u", "v") == [(0, 1), (0, 2), (1, 3), (2, 3)]
    assert rows(g["paths"], "name", "node") == [("r0", 0), ("r0", 1), ("r0", 3), ("r1", 0), ("r1", 2), ("r1", 3)]
    assert rows(g["rings"], "a", "b") == [(1, 2), (2, 1)]


def test_cluster_folder_of_both_kinds(spark, tmp_path):
    put(tmp_path, "c1.fa", ">a one\nAC\nGT\n>b\nTT\n")
    put(tmp_path, "c2.fq", "@x\nAUG\n+\n>>>\n@y\nGG\n+\n@!\n")
    put(tmp_path, "c3.fastq", "@z\nC\n+\n!\n")
    got = IO.read_cluster_dir(spark, str(tmp_path))
    assert rows(got, "cluster", "read_id", "sequence") == [("c1", "a one", "ACGT"), ("c1", "b", "TT"), ("c2", "x", "ATG"), ("c2", "y", "GG"), ("c3", "z", "C")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_genome_is_read_in_part(spark, tmp_path):
    genome = spark.createDataFrame([(f"c{k}", "ACGTTGCA" * (k + 1)) for k in range(20)], "contig string, seq string")
    path = str(tmp_path / "genome")
    store.write_genome(genome, path, chunk=10, groups=8)
    every = store.read_genome(spark, path, groups=8)
    assert {(r.contig, r.chunk): r.piece for r in every.collect()} == {(f"c{k}", i): ("ACGTTGCA" * (k + 1))[i * 10 : i * 10 + 10] for k in range(20) for i in range(-(-8 * (k + 1) // 10))}
    some = store.read_genome(spark, path, ["c3", "c17"], groups=8)
    assert {r.contig for r in some.collect()} == {"c3", "c17"}
    assert re.search(r"PartitionFilters: \[[^\]]*group", plan_of(some)) and "PushedFilters: [In(contig" in plan_of(some)
    aln = spark.createDataFrame([(1, "c3", 4, "5M6N7M", 0), (2, "c17", 100, "9M", 16)], "rid long, contig string, start int, cigar string, flag int")
    assert rows(I.corrected_from(aln, every, 10), "rid", "seq") == rows(I.genome_corrected(aln, genome), "rid", "seq")


def test_stored_alignments_are_read_by_region(spark, tmp_path):
    rnd = random.Random(4)
    given = [(k, f"c{rnd.randrange(6)}", rnd.randrange(5000), f"{rnd.randint(1, 90)}M{rnd.randint(1, 400)}N{rnd.randint(1, 9)}=2I3S", "x") for k in range(400)]
    aln = spark.createDataFrame(given, "rid long, contig string, start int, cigar string, note string")
    path = str(tmp_path / "aln")
    store.write_alignments(aln, path, groups=4)
    assert store.read_alignments(spark, path, groups=4).count() == 400
    regions = [("c1", 100, 900), ("c4", 4000, 4001)]
    end = lambda start, cigar: start + sum(int(n) for n, op in re.findall(r"([0-9]+)([A-Z=])", cigar) if op in "MN=")
    want = sorted(k for k, c, s, g, _ in given if any(c == x and s < hi and end(s, g) > lo for x, lo, hi in regions))
    some = store.read_alignments(spark, path, regions, groups=4)
    assert sorted(r.rid for r in some.collect()) == want and want
    assert re.search(r"PartitionFilters: \[[^\]]*group", plan_of(some))
