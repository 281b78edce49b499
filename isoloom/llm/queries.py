"""Registered queries of the operators in this subpackage, one per operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from isoloom.llm import collocations, decontaminate, embeddings, licenses, mixing, quality, search, secrets, sharding, simhash, substrings, tokens, warc
from isoloom.shared import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_pages(_table(spark, sf_dir, "pages"), path)
    return warc.read_pages(spark, path)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(_table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(_table(spark, sf_dir, "documents")))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("places")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digests(_table(spark, sf_dir, "documents"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_decontaminate, op3_quality, op4_mixing, op5_substrings, op6_secrets, op7_licenses, op8_simhash, op9_tokens, op10_embeddings, op11_sharding, op12_search, op13_collocations)}

SQL: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
        f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex),
        g AS (SELECT DISTINCT hex, unnest(range(8)) AS k FROM p),
        c AS (SELECT hex, k, CAST('0x' || substr(hex, CAST(k * 5 + 1 AS INT), 5) AS BIGINT) AS v FROM g),
        b AS (SELECT hex, string_agg(
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v >> 15) & 31) + 1 AS INT), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v >> 10) & 31) + 1 AS INT), 1)
             || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v >> 5) & 31) + 1 AS INT), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v & 31) + 1 AS INT), 1), '' ORDER BY k) AS payload_digest
              FROM c GROUP BY hex)
        SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM p JOIN f USING (hex) JOIN b USING (hex)""",
    "op2_decontaminate": r"""
        WITH w AS (
          SELECT 'd' AS side, doc_id AS id, '' AS one, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents
          UNION ALL SELECT DISTINCT 'q', item_id, md5(text), regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
        n AS (SELECT side, id, one, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0),
        s AS (SELECT DISTINCT side, id, one, array_to_string(ws[i : i + 4], ' ') AS s FROM n),
        q AS (SELECT id, one, count(*) AS n FROM s WHERE side = 'q' GROUP BY id, one),
        hit AS (SELECT d.id AS doc_id, b.id AS item_id, b.one, count(*) AS k FROM s d JOIN s b ON d.s = b.s AND d.side = 'd' AND b.side = 'q' GROUP BY 1, 2, 3),
        ok AS (SELECT doc_id, item_id, max(CAST(k AS DOUBLE) / n) AS x FROM hit JOIN q ON q.id = item_id AND q.one = hit.one WHERE k >= 0.8 * n - 1e-9 GROUP BY doc_id, item_id),
        per AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids, max(x) AS containment FROM ok GROUP BY doc_id)
        SELECT doc_id, coalesce(n_items, 0) AS n_items, coalesce(item_ids, '') AS item_ids, coalesce(containment, 0.0) AS containment, n_items IS NOT NULL AS contaminated
        FROM documents LEFT JOIN per USING (doc_id)""",
    "op5_substrings": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        n AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
        s AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS s FROM n),
        f AS (SELECT s, min(doc_id) AS first FROM s GROUP BY s),
        hit AS (SELECT doc_id, unnest(range(i, i + 50)) AS k FROM s JOIN f USING (s) WHERE first < doc_id),
        gone AS (SELECT doc_id, list(DISTINCT k) AS ks FROM hit GROUP BY doc_id),
        word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS k FROM w),
        gone_words AS (SELECT DISTINCT doc_id, k FROM hit),
        kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.k) AS t FROM word LEFT JOIN gone_words g ON g.doc_id = word.doc_id AND g.k = word.k WHERE g.k IS NULL GROUP BY word.doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept ON kept.doc_id = w.doc_id""",
    "op10_embeddings": """
        WITH RECURSIVE v AS (
          SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        link AS (
          SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
        reach AS (
          SELECT DISTINCT vec_id AS u, vec_id AS v FROM v
          UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u),
        comp AS (SELECT u AS vec_id, min(v) AS component_id FROM reach GROUP BY u),
        n AS (SELECT u AS vec_id, count(*) AS n_links FROM link GROUP BY u)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM v LEFT JOIN n USING (vec_id) LEFT JOIN comp USING (vec_id)""",
    "op11_sharding": """
        WITH RECURSIVE step AS (
          SELECT CAST(b AS BIGINT) AS b, CAST(b AS BIGINT) AS c, 0 AS k FROM range(256) t(b)
          UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
        crc AS (SELECT list(c ORDER BY b) AS t FROM step WHERE k = 8),
        hex AS (SELECT list('' || substr('0123456789ABCDEF', CAST(b // 16 + 1 AS INT), 1) || substr('0123456789ABCDEF', CAST(b % 16 + 1 AS INT), 1) ORDER BY b) AS h FROM range(256) x(b)),
        two AS (SELECT map(h, range(256)) AS of FROM hex),
        d AS (
          SELECT row_number() OVER () AS r, doc_id, coalesce('k' || doc_id, 'n') AS key, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
                 xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST(of[x] AS BIGINT)),
                     lambda c, x: xor(t[CAST((xor(c, x) & 255) + 1 AS INT)], c >> 8), 4294967295)) AS text_crc32
          FROM documents, crc, two),
        u AS (SELECT r, s, -1.0 / ln((CAST('0x' || substr(md5(key || ':' || s), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) AS score FROM d, range(17) x(s)),
        best AS (SELECT r, CAST(arg_max(s, score) FILTER (s < 16) AS INT) AS shard, CAST(arg_max(s, score) AS INT) AS grown_shard FROM u GROUP BY r),
        o AS (SELECT *, CAST('0x' || substr(md5(key || '/' || text_crc32), 1, 13) AS BIGINT) AS o FROM d JOIN best USING (r))
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY o, doc_id, size, text_crc32) - 1 AS BIGINT) AS slot, grown_shard
        FROM o""",
    "op12_search": r"""
        WITH t AS (
          SELECT 'd' AS side, row_number() OVER () AS r, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
          UNION ALL SELECT 'q', 0, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') FROM benchmark),
        c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS l FROM t WHERE side = 'd' AND len(ws) > 0),
        tf AS (SELECT side, r, id, term, count(*) AS tf FROM (SELECT side, r, id, unnest(ws) AS term FROM t) x GROUP BY side, r, id, term),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c WHERE side = 'd' GROUP BY term, n_docs),
        m AS (SELECT r, 25 + (75 * CAST(len(ws) AS BIGINT) * n_docs) // l AS m FROM t, c WHERE side = 'd'),
        s AS (SELECT q.id AS item_id, d.r, d.id AS doc_id, CAST(sum(q.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 8 * m))) AS BIGINT) AS score
              FROM tf q JOIN tf d ON q.term = d.term AND q.side = 'q' AND d.side = 'd' JOIN w ON w.term = d.term JOIN m ON m.r = d.r GROUP BY q.id, d.r, d.id),
        k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT * FROM k WHERE rank <= 10""",
    "op13_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
        g AS (SELECT lang, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, range(1, 6) x(m) WHERE len(ws) >= m) y),
        f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY lang, m, phrase HAVING count(*) >= 100),
        t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
        c AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS ws, a, unnest(range(1, m)) AS k FROM f WHERE m > 1),
        s AS (SELECT c.lang, c.m, c.phrase, c.a, k, l.a AS l, r.a AS r, n, CAST((CAST(1000 AS HUGEINT) * c.a * n) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
              FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1 : k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[k + 1 : c.m], ' ') JOIN t ON t.lang = c.lang),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        i AS (SELECT lang, array_to_string(ws[p : p + z - 1], ' ') AS phrase, a FROM (
                SELECT lang, ws, m, a, z, unnest(range(1, m - z + 2)) AS p FROM (SELECT DISTINCT lang, ws, m, a, unnest(range(2, m)) AS z FROM c WHERE m > 2) x) y),
        o AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY lang, phrase),
        k AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE longer IS NULL OR longer < a)
        SELECT lang, rank, phrase, a, l, r, n, score FROM k WHERE rank <= 2000""",
}
