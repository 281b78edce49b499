"""Views that give the given tables the shapes of reads, transcripts, paths and alignments.

One text serves both engines; ``{G}`` is the flag that makes a replacement global where that isn't the default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    # transcript = order, exon = line item, ascending and apart; set = whether the order is finished
    "v_exon": """
        SELECT tx, chr, strand, kind, n, s, s + q AS e, cs, cs + 1 + q % 2 AS ce FROM (
          SELECT l_orderkey AS tx, 'chr' || (l_orderkey % 5) AS chr, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'O' END AS kind,
                 CAST(l_quantity AS INT) AS q, n, n * 1000 + l_partkey % 10 AS s, n * 1000 + l_partkey % 2 AS cs
          FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) x
          JOIN orders ON l_orderkey = o_orderkey) y""",
    "v_intron": """
        SELECT tx, chr, strand, kind, s, e, 1 + tx % 12 AS support FROM (
          SELECT tx, chr, strand, kind, lag(e) OVER (PARTITION BY tx ORDER BY n) AS s, s AS e FROM v_exon) x WHERE s IS NOT NULL""",
    "v_seq": """
        SELECT doc_id AS read_id, lang AS cluster,
               translate(regexp_replace(lower(text), '[^a-z]', ''{G}), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq
        FROM documents""",
    "v_name": "SELECT 'cluster_' || (doc_id % 20) || '_' || doc_id || '_' || (n_chars % 700) AS read_id FROM documents",
    "v_query_iv": """
        SELECT l_orderkey * 100 + l_linenumber AS qid, l_suppkey % 5 AS chr, l_partkey * 10 AS s, l_partkey * 10 + CAST(l_quantity AS INT) AS e,
               l_partkey, l_suppkey FROM lineitem""",
    "v_gene": "SELECT p_partkey AS gid, p_partkey % 5 AS chr, p_partkey * 10 AS s, p_partkey * 10 + p_size AS e FROM part",
    "v_hit": """
        SELECT l_orderkey AS query, l_partkey AS subject, l_discount AS evalue, CAST(l_quantity AS INT) AS id_num, 50 AS id_den, least(50, CAST(l_quantity AS INT) + 5) AS pos_num, 50 AS pos_den, l_linenumber AS gap_num, 50 AS gap_den,
               dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS match_rank, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey, l_quantity, l_discount) AS hsp_rank FROM lineitem""",
    # read = user, node = place of the event in the user's order and its kind; events at one place are aligned
    "v_path": """
        SELECT user_id - user_id % 6 AS cluster, user_id AS read, 1 + user_id % 3 AS support, k AS pos, (k - 1) * 5 + CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 0 END AS node
        FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) a""",
    "v_site": """
        SELECT pos, count(*) AS weight FROM (
          SELECT (extract(day FROM ts) - 1) * 1440 + extract(hour FROM ts) * 60 + CAST(floor(extract(minute FROM ts)) AS INT) AS pos FROM events) x GROUP BY pos""",
    # backbone = turn of a conversation
    "v_backbone": """
        SELECT conv_id * 100 + turn AS ref, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', ''{G}), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq
        FROM conversations""",
    # short reads cut from the backbones: matches, wrong bases, inserted ones, matches, skipped ones, matches
    "v_aln": """
        SELECT rid, ref, start, a || '=' || b || 'X' || c || 'I' || '4=' || d || 'D' || (28 - a - b - c) || '=' AS cigar,
               substr(seq, start + 1, a) || translate(substr(seq, start + a + 1, b), 'ACGT', 'CGTA') || substr(ins, 1, c) || substr(seq, start + a + b + 1, 4) || substr(seq, start + a + b + d + 5, 28 - a - b - c) AS seq
        FROM (SELECT rid, ref, seq, CAST(p * 16 % (length(seq) - 40) AS INT) AS start, CAST(5 + p % 5 AS INT) AS a, CAST(1 + p % 2 AS INT) AS b, CAST(1 + ln % 3 AS INT) AS c, CAST(1 + p % 3 AS INT) AS d,
                     CASE WHEN q % 11 = 0 THEN 'TNA' ELSE 'TCA' END AS ins
              FROM (SELECT l_orderkey * 10000000000 + l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS rid, l_orderkey % (SELECT count(DISTINCT conv_id) FROM conversations) AS k, l_partkey AS p, l_linenumber AS ln, CAST(min(l_quantity) AS INT) AS q
                    FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber) x
              JOIN (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id) t ON k = conv_id
              JOIN v_backbone ON ref = conv_id * 100 + p % turns WHERE length(seq) > 60) y""",
    # reads with clipped and ragged ends, and some without any match
    "v_clip": """
        SELECT rid, ref, CAST(start - CASE WHEN rid % 6 IN (1, 5) AND start >= 2 THEN 2 ELSE 0 END AS INT) AS start,
               CASE rid % 6 WHEN 0 THEN '3S' || cigar || '2S' WHEN 1 THEN CASE WHEN start >= 2 THEN '2X' || cigar ELSE cigar END WHEN 2 THEN cigar || '2I1S'
                            WHEN 3 THEN '1I' || cigar || '1D2X' WHEN 4 THEN replace(cigar, '=', 'X') ELSE CASE WHEN start >= 2 THEN '1S1I1X1D' || cigar || '1D' ELSE cigar END END AS cigar,
               CASE rid % 6 WHEN 0 THEN 'GGG' || seq || 'TT' WHEN 1 THEN CASE WHEN start >= 2 THEN 'NN' || seq ELSE seq END WHEN 2 THEN seq || 'GNC'
                            WHEN 3 THEN 'N' || seq || 'NN' WHEN 4 THEN seq ELSE CASE WHEN start >= 2 THEN 'ANA' || seq ELSE seq END END AS seq
        FROM v_aln""",
    # a cluster is a conversation, its nodes are the texts of turns; isoform 0 has all turns, isoform 1 the even ones
    "v_turn": """
        SELECT cluster, node, nts, CAST(coalesce(sum(length(nts)) OVER (PARTITION BY cluster ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first
        FROM (SELECT CAST(floor(ref / 100) AS BIGINT) AS cluster, ref % 100 AS node, seq AS nts FROM v_backbone) x""",
    "v_isoform": """
        SELECT cluster, read, support, row_number() OVER (PARTITION BY cluster, read ORDER BY node) AS pos, node,
               CAST(coalesce(sum(length(nts)) OVER (PARTITION BY cluster, read ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
        FROM (SELECT cluster, 0 AS read, 2 + cluster % 3 AS support, node, nts FROM v_turn UNION ALL SELECT cluster, 1, 1, node, nts FROM v_turn WHERE node % 2 = 0) x""",
    "v_iso_aln": """
        SELECT a.rid, i.cluster, i.read, CAST(i.before + a.start AS INT) AS start, a.cigar, a.seq, i.node
        FROM v_aln a JOIN v_isoform i ON i.cluster * 100 + i.node = a.ref AND i.read = CASE WHEN a.ref % 2 = 0 THEN a.rid % 2 ELSE 0 END""",
    "v_spliced": """
        SELECT tx AS read_id, tx % 500 AS contig, strand, n, s, e FROM (
          SELECT tx, strand, n, lag(e) OVER (PARTITION BY tx ORDER BY n) AS s, s AS e FROM v_exon) x WHERE s IS NOT NULL""",
    "v_dup": "SELECT user_id AS key, event_id AS ord, event_type AS val FROM events",
}
# transcripts of all three sets: the status of the order
VIEWS["v_status"] = VIEWS["v_exon"].replace("CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'O' END AS kind", "o_orderstatus AS kind")
NEEDS = {"v_intron": ["v_exon"], "v_spliced": ["v_exon"], "v_aln": ["v_backbone"], "v_clip": ["v_aln"], "v_turn": ["v_backbone"], "v_isoform": ["v_turn"], "v_iso_aln": ["v_aln", "v_isoform"]}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        out += [x for x in [*_closure(NEEDS.get(n, [])), n] if x not in out]
    return out


def duck(names: str, body: str, recursive: bool = False, more: str = "") -> str:
    """SQL of the other engine: the views as common table expressions, then ``body``."""
    ctes = [f"{n} AS ({VIEWS[n].replace('{G}', ', ' + chr(39) + 'g' + chr(39))})" for n in _closure(names.split())]
    return f"WITH {'RECURSIVE ' * recursive}{', '.join([*ctes, *([more] if more else [])])} {body}"


class Fixtures:
    """The tables and views of one folder as DataFrames: ``Fixtures(spark, sf_dir).v_exon``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        text = VIEWS[name].replace("{G}", "")
        sources = {n: getattr(self, n) for n in [*TABLES, *VIEWS] if n != name and f" {n}" in text.replace("\n", " ")}
        for n, df in sources.items():  # {n} is filled in by the SQL call itself, no session-wide view is made
            text = text.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
        return self.spark.sql(text, **sources)
