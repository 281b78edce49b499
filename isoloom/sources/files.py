"""Readers and writers of sequence, interval, alignment, report and graph text files.

Readers return one row per record with the file and its place, so that order can be asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isoloom.functions import sequences as S

_FILE = "_metadata.file_path"


def _records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Text cut at ``sep``: (file, ord, value), ord grows in file order."""
    return spark.read.option("lineSep", sep).text(path).select(F.col(_FILE).alias("file"), F.monotonically_increasing_id().alias("ord"), "value")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, read_id, sequence): the id is the whole header; lines are joined, blank ones skipped."""
    rows = _records(spark, path, "\n>").withColumn("value", F.regexp_replace("value", "^>", "")).where(F.trim("value") != "")
    head = F.rtrim(F.split_part("value", F.lit("\n"), F.lit(1)), F.lit("\r"))
    body = F.when(F.instr("value", "\n") > 0, F.substring_index("value", "\n", -1)).otherwise("")
    body = F.regexp_replace(F.expr("substr(value, instr(value, '\n') + 1)"), r"\s", "")
    return rows.select("file", "ord", head.alias("read_id"), F.when(F.instr("value", "\n") > 0, body).otherwise("").alias("sequence"))


_FASTQ_FILES = "*.{fq,fastq}"


def read_fastq(spark: SparkSession, path: str, only: str = "*") -> DataFrame:
    """(file, ord, read_id, sequence, qualities): strict records of four lines, U read as T. ``only`` is a pattern of file names.

    Quality lines may begin with @, so records are counted by lines. A block of a file is read in order by one
    task, so a line's number is its place in the block plus the lines of the blocks before it: no sort, no single task.
    """
    lines = spark.read.option("pathGlobFilter", only).text(path).select(F.col(_FILE).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    ahead = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    placed = lines.join(blocks, ["file", "block"]).withColumn("at", F.col("ahead") + F.col("id") - F.col("first"))
    pick = lambda k: F.max(F.when(F.col("at") % 4 == k, F.col("value")))
    rows = placed.groupBy("file", F.floor(F.col("at") / 4).alias("ord")).agg(pick(0).alias("h"), pick(1).alias("s"), pick(3).alias("qualities"))
    return rows.where(F.col("h").startswith("@")).select("file", "ord", F.expr("substr(h, 2)").alias("read_id"), S.u_to_t(F.col("s")).alias("sequence"), "qualities")


def fastq_to_fasta(reads: DataFrame) -> DataFrame:
    return reads.drop("qualities")


def read_bed12(spark: SparkSession, path: str) -> DataFrame:
    """(chr, start, end, name, strand, block_sizes, block_starts); trailing commas are accepted."""
    names = "chr string, start long, end long, name string, score string, strand string, thick_start string, thick_end string, rgb string, block_count int, sizes string, starts string"
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("long"))
    return spark.read.schema(names).option("sep", "\t").csv(path).select("chr", "start", "end", "name", "strand", numbers("sizes").alias("block_sizes"), numbers("starts").alias("block_starts"))


def read_gtf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(exons, rejects): exon lines with 0-based starts and attributes; those without transcript_id are rejects."""
    names = "chr string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string"
    rows = spark.read.schema(names).option("sep", "\t").option("comment", "#").option("quote", "").csv(path).where("feature = 'exon'")
    rows = rows.withColumn("ord", F.monotonically_increasing_id()).withColumn("start", F.col("start") - 1).withColumn("attributes", S.parse_attributes(F.col("attributes")))
    tx = F.col("attributes")["transcript_id"]
    return rows.where(tx.isNotNull()).withColumn("transcript_id", tx), rows.where(tx.isNull())


def read_intron_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("value <> ''").select(S.parse_intron_name(F.ltrim(F.col("value"), F.lit(">"))).alias("x")).select("x.*")


def read_tracking(spark: SparkSession, path: str, sample: int = 1) -> DataFrame:
    """(code, read_id) of the sample's column; rows where it is absent are left out."""
    rows = spark.read.text(path).where("value <> '' and value not like '#%'").select(F.split("value", "\t").alias("f"))
    column = F.get("f", F.lit(3 + sample))
    return rows.where(column.isNotNull() & (column != "-")).select(F.get("f", F.lit(3)).alias("code"), S.tracking_txid(column).alias("read_id"))


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """(rid, flag, contig, start 0-based, cigar, seq, qual) of SAM text, primary and mapped."""
    rows = spark.read.text(path).where("value <> '' and value not like '@%'").select(F.split("value", "\t").alias("f"))
    get = lambda k: F.get("f", F.lit(k))
    aln = rows.select(get(0).alias("rid"), get(1).cast("int").alias("flag"), get(2).alias("contig"), (get(3).cast("long") - 1).alias("start"), get(5).alias("cigar"), get(9).alias("seq"), get(10).alias("qual"))
    return aln.where(F.col("flag").bitwiseAND(F.lit(0x904)) == 0)


def _folder(name: str) -> Column:
    """The value of the folder ``name=value`` that a file is in; empty if it is in none."""
    return F.url_decode(F.regexp_extract("file", f"/{name}=([^/]+)/[^/]*$", 1))


def read_cluster_dir(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, read_id, sequence, cluster) of every file of a folder, FASTQ records of ``.fq`` and ``.fastq`` files and FASTA records
    of others; cluster is that of its folder ``cluster=``, as :func:`write_by` makes them, or else the file's name up to its first dot."""
    own = F.regexp_extract("file", r"([^/.]+)[^/]*$", 1)
    columns = ["file", "ord", "read_id", "sequence"]
    fasta = read_fasta(spark, path).where(~F.col("file").rlike(r"\.(fq|fastq)$")).select(columns)
    reads = fasta.union(read_fastq(spark, path, _FASTQ_FILES).select(columns))
    return reads.withColumn("cluster", F.when(_folder("cluster") != "", _folder("cluster")).otherwise(own))


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    return read_fasta(spark, path).select(F.split_part("read_id", F.lit(" "), F.lit(1)).alias("contig"), F.upper("sequence").alias("seq"))


def read_blastp_report(spark: SparkSession, path: str) -> DataFrame:
    """(query, query_length, match_rank, subject, subject_length, hsp_rank, score, evalue, identities ...): a row per
    HSP; queries without hits have one row with nulls. Percentages are 100 * numerator / denominator."""
    blocks = _records(spark, path, "Query= ").where(F.col("value").contains("Length="))
    query = F.trim(F.regexp_replace(F.regexp_extract("value", r"(?s)^(.*?)\s*Length=", 1), r"\s+", " "))
    rows = blocks.select("file", "ord", query.alias("query"), F.regexp_extract("value", r"Length=([0-9]+)", 1).cast("long").alias("query_length"), F.split("value", r"\n>\s*").alias("m"))
    matches = rows.select("file", "ord", "query", "query_length", F.posexplode_outer(F.slice("m", 2, F.greatest(F.size("m") - 1, F.lit(0)))).alias("match_rank", "t"))
    subject = F.trim(F.regexp_replace(F.regexp_extract("t", r"(?s)^(.*?)\s*Length=", 1), r"\s+", " "))
    hsps = matches.withColumn("subject", subject).withColumn("subject_length", F.regexp_extract("t", r"Length=([0-9]+)", 1).try_cast("long")).withColumn("h", F.split("t", r"\s Score =|\n Score ="))
    hsps = hsps.select("file", "ord", "query", "query_length", "match_rank", "subject", "subject_length", F.posexplode_outer(F.slice("h", 2, F.greatest(F.size("h") - 1, F.lit(0)))).alias("hsp_rank", "x"))
    number = lambda pattern, kind: F.regexp_extract("x", pattern, 1).try_cast(kind)
    shares = []
    for n, name in (("Identities", "id"), ("Positives", "pos"), ("Gaps", "gap")):
        a, b = number(rf"{n} = ([0-9]+)/", "long"), number(rf"{n} = [0-9]+/([0-9]+)", "long")
        shares += [a.alias(f"{name}_num"), b.alias(f"{name}_den"), F.try_divide(a * 100.0, b).alias(f"{name}_pct")]
    lines = lambda who: F.array_join(F.regexp_extract_all("x", F.lit(rf"{who}\s+[0-9]+\s+(\S+)"), F.lit(1)), "")
    return hsps.select("file", "ord", "query", "query_length", "match_rank", "subject", "subject_length", "hsp_rank", number(r"^\s*([0-9.]+) bits", "double").alias("score"), number(r"Expect = ([0-9.e+-]+)", "double").alias("evalue"), *shares, lines("Query").alias("query_seq"), lines("Sbjct").alias("subject_seq"))


def _numbered(lines: DataFrame) -> DataFrame:
    """``lines(file, block, id, ...)`` with ``n``, their number in the file, from 0. A block is numbered by itself, and
    begins after those before it."""
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("rows"))
    ahead = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("ahead"))
    inside = F.row_number().over(W.partitionBy("file", "block").orderBy("id")) - 1
    return lines.withColumn("inside", inside).join(blocks, ["file", "block"]).withColumn("n", F.col("ahead") + F.col("inside")).drop("ahead", "inside", "block", "id")


def read_graph_text(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``nodes(file, graph, node, nts)``, ``edges(file, graph, u, v)``, ``paths(file, graph, read, name, node)`` and
    ``rings(file, graph, a, b)`` of graph text.

    ``graph`` is that of the file's folder ``graph=``, as :func:`write_graph_text` makes them, or else its NAME line. Nodes and
    sources are numbered by their lines; a file may be many blocks.
    """
    lines = spark.read.text(path).select(F.col(_FILE).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.rtrim("value", F.lit("\r")).alias("t"))
    node_line = r"^([^:\s=]+):((?:[LSA][0-9]+)*)$"
    own = lines.where(F.col("t").startswith("NAME=")).groupBy("file").agg(F.min(F.expr("substr(t, 6)")).alias("own"))
    graph = F.when(_folder("graph") != "", _folder("graph")).otherwise(F.col("own"))
    named = lambda df: df.join(own, "file", "left").withColumn("graph", graph).drop("own")
    nodes = _numbered(lines.where(F.col("t").rlike(node_line)))
    nodes = named(nodes.select("file", F.col("n").alias("node"), F.regexp_extract("t", node_line, 1).alias("nts"), F.regexp_extract("t", node_line, 2).alias("x")))
    numbers = lambda letter: F.explode(F.transform(F.regexp_extract_all("x", F.lit(letter + "([0-9]+)"), F.lit(1)), lambda n: n.cast("long")))
    names = _numbered(lines.where(F.col("t").startswith("SOURCENAME="))).select("file", F.col("n").alias("read"), F.expr("substr(t, 12)").alias("name"))
    return {
        "nodes": nodes.select("file", "graph", "node", "nts"),
        "edges": nodes.select("file", "graph", numbers("L").alias("u"), F.col("node").alias("v")),
        "paths": nodes.select("file", "graph", numbers("S").alias("read"), "node").join(names, ["file", "read"], "left").select("file", "graph", "read", "name", "node"),
        "rings": nodes.select("file", "graph", F.col("node").alias("a"), numbers("A").alias("b")),
    }


def fasta_text(df: DataFrame, width: int = 75) -> DataFrame:
    seq = S.wrap_sequence(F.col("sequence"), width) if width else F.col("sequence")
    return df.select(F.concat(F.lit(">"), "read_id", F.lit("\n"), seq).alias("value"))


def write_fasta(df: DataFrame, path: str, width: int = 75) -> None:
    """Wrapped records; ``width`` 0 leaves the sequence on one line."""
    fasta_text(df, width).write.text(path)


def write_fastq(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\n", F.concat(F.lit("@"), "read_id"), "sequence", F.lit("+"), "qualities").alias("value")).write.text(path)


def gtf_text(rows: DataFrame) -> DataFrame:
    """Rows of ``bed12_to_gtf`` as GTF lines."""
    attributes = F.concat(F.lit('gene_id "'), "name", F.lit('"; transcript_id "'), "name", F.lit('";'), F.coalesce(F.concat(F.lit(' exon_number "'), F.col("exon_number").cast("string"), F.lit('";')), F.lit("")))
    return rows.select(F.concat_ws("\t", "chr", F.lit("BLANK"), "feature", F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.lit("."), attributes).alias("value"))


def write_gtf(rows: DataFrame, path: str) -> None:
    gtf_text(rows).write.text(path)


def write_bed(introns: DataFrame, path: str) -> None:
    introns.select("chr", "s", "e", "name", F.lit(".").alias("score"), "strand").write.option("sep", "\t").csv(path)


def write_novel_bed(introns: DataFrame, path: str) -> None:
    """The four columns of a list of novel introns: chromosome, start, end and a fixed name."""
    introns.select("chr", "s", "e", F.lit("query_intron").alias("name")).write.option("sep", "\t").csv(path)


def write_tsv(df: DataFrame, path: str, missing: str = ".") -> None:
    df.select([F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) for c in df.columns]).write.option("sep", "\t").csv(path)


def write_by(df: DataFrame, column: str, path: str) -> None:
    """One folder per value of ``column``, FASTA text inside; a large value is several files, not one task."""
    text = df.select(column, F.concat(F.lit(">"), "read_id", F.lit("\n"), "sequence").alias("value"))
    text.repartition(column, F.pmod(F.xxhash64("value"), F.lit(8))).write.partitionBy(column).text(path)


def graph_node_lines(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(cluster, node, line): ``nts:L..S..`` with predecessors and member reads in order."""
    joined = lambda df, key, letter, name: df.groupBy("cluster", key).agg(F.array_join(F.transform(F.array_sort(F.collect_set(name)), lambda x: F.concat(F.lit(letter), x.cast("string"))), "").alias(letter))
    before = joined(edges.select("cluster", F.col("v").alias("node"), "u"), "node", "L", "u")
    members = joined(paths, "node", "S", "read")
    every = nodes.join(before, ["cluster", "node"], "left").join(members, ["cluster", "node"], "left")
    return every.select("cluster", "node", F.concat("nts", F.lit(":"), F.coalesce("L", F.lit("")), F.coalesce("S", F.lit(""))).alias("line"))


def write_graph_text(nodes: DataFrame, paths: DataFrame, path: str) -> None:
    """A graph per cluster of ``nodes(cluster, node, nts)`` and ``paths(cluster, read, pos, node)``, in folders ``graph=``.

    Nodes and reads are numbered from 0 in their order; a graph is one file: a header, two lines for each
    read, and a line for each node with its predecessors and reads.
    """
    by_cluster = W.partitionBy("cluster")
    number = nodes.select("cluster", "node", (F.row_number().over(by_cluster.orderBy("node")) - 1).cast("long").alias("new"))
    lengths = paths.groupBy("cluster", "read").agg(F.count("*").alias("n"))
    reads = lengths.withColumn("i", F.row_number().over(by_cluster.orderBy("read")) - 1)
    steps = paths.join(number, ["cluster", "node"]).join(reads.select("cluster", "read", "i"), ["cluster", "read"])
    before = F.lag("new").over(W.partitionBy("cluster", "read").orderBy("pos"))
    edges = steps.withColumn("u", before).where("u is not null").select("cluster", "u", F.col("new").alias("v")).distinct()
    lines = graph_node_lines(nodes.join(number, ["cluster", "node"]).select("cluster", F.col("new").alias("node"), "nts"), edges, steps.select("cluster", F.col("new").alias("node"), F.col("i").alias("read")))
    sizes = nodes.groupBy("cluster").agg(F.count("*").alias("length")).join(lengths.groupBy("cluster").agg(F.count("*").alias("sources")), "cluster", "left")
    head = F.array(F.lit("VERSION=LPO.0.1"), F.concat(F.lit("NAME="), "cluster"), F.lit("TITLE=untitled"), F.concat(F.lit("LENGTH="), "length"), F.concat(F.lit("SOURCECOUNT="), F.coalesce("sources", F.lit(0))))
    source = F.array(F.concat(F.lit("SOURCENAME="), "read"), F.concat(F.lit("SOURCEINFO="), "n", F.lit(" 0 1 -1 untitled")))
    rows = sizes.select("cluster", F.lit(0).alias("part"), F.lit(0).cast("long").alias("k"), F.posexplode(head).alias("j", "value"))
    rows = rows.union(reads.select("cluster", F.lit(1), F.col("i").cast("long"), F.posexplode(source))).union(lines.select("cluster", F.lit(2), F.col("node"), F.lit(0), "line"))
    # The writer sorts by folder, and the sort below keeps a graph's lines in order within it.
    ordered = rows.withColumnRenamed("cluster", "graph").repartition("graph").sortWithinPartitions("graph", "part", "k", "j")
    ordered.select("graph", "value").write.partitionBy("graph").text(path)
