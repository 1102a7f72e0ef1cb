"""Driver queries of this folder: one ``opN_<name>`` for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, ngram_join, packing, prefix_trie, quality, secret_scan, sentencepiece_codec, sharding, suffix_dedup, token_counts, topk, vector_dedup, whitening


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.join(_read(spark, sf, "documents"), words=4, num=85, den=100)


def op2_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard(_read(spark, sf, "documents"), n_shards=16)


def op3_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_read(spark, sf, "documents"), limit=2048)


def op4_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "embeddings")
    return topk.exact_topk(rows, rows.where(F.col("vec_id") % 100 == 0), k=10, scale=1024)


def op10_vector_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return vector_dedup.near_vectors(_read(spark, sf, "embeddings"), threshold=0.98)


def op6_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.dedup(_read(spark, sf, "documents"), length=100)


def op5_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(_read(spark, sf, "documents"))


def op7_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classify(_read(spark, sf, "documents"), _read(spark, sf, "labels"))


def op8_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.dedup(_read(spark, sf, "documents"), run=3)


def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf, "documents"), limit=2048)


def op11_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.scan(_read(spark, sf, "documents"))


def op12_conversation_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.prefix_trie(_read(spark, sf, "conversations"), heads="crc32(cast(conv as string)) % 4", base="conv - conv % 20")


def op13_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf, "embeddings"), components=8, scale=1024)


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_ngram_jaccard_join, op2_sharding, op3_packing, op4_exact_topk, op5_sentencepiece,
        op6_suffix_dedup, op7_quality_classifier, op8_line_dedup, op9_token_counts, op10_vector_dedup,
        op11_secret_scan, op12_conversation_trie, op13_embedding_whitening)}


#: The exact top 10 by a plain scan of the quantised vectors.
OP4_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""

#: Runs of three lines that start earlier lose their lines.
OP8_SQL = """
WITH split AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), line AS (
  SELECT doc_id, i, ls[i] AS l, trim(ls[i], ' ' || chr(9) || chr(13)) AS t
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM split)
), full_line AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM line WHERE t <> ''
), run AS (
  SELECT doc_id, p, t, lead(t, 1) OVER w AS t1, lead(t, 2) OVER w AS t2
  FROM full_line WINDOW w AS (PARTITION BY doc_id ORDER BY p)
), later AS (
  SELECT doc_id, p FROM (
    SELECT doc_id, p, row_number() OVER (PARTITION BY t, t1, t2 ORDER BY doc_id, p) AS r FROM run WHERE t2 IS NOT NULL)
  WHERE r > 1
), gone AS (
  SELECT DISTINCT f.doc_id, f.i
  FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS p FROM later) g JOIN full_line f USING (doc_id, p)
), kept AS (
  SELECT doc_id, string_agg(l, chr(10) ORDER BY i) AS kept
  FROM line WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = line.doc_id AND gone.i = line.i) GROUP BY doc_id
), lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT s.doc_id, CASE WHEN s.text IS NULL THEN NULL ELSE coalesce(k.kept, '') END AS text,
       CAST(coalesce(len(s.ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(x.n, 0) AS BIGINT) AS n_removed
FROM split s LEFT JOIN kept k USING (doc_id) LEFT JOIN lost x USING (doc_id)
"""

#: Prefixes as lists of turns; the checksum bit by bit; each node's sums from all nodes that it is a prefix of.
OP12_SQL = """
WITH own AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, md5(concat(strlen(coalesce(role, '')), ':', role, text))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), head AS (
  SELECT *, list_reduce(
    list_concat([4294967295::UBIGINT], flatten([list_concat([ascii(x)::UBIGINT], [999::UBIGINT FOR i IN range(8)]) FOR x IN string_split(c::VARCHAR, '')])),
    lambda a, b: CASE WHEN b < 999 THEN xor(a, b) ELSE xor(a >> 1, 3988292384::UBIGINT * (a & 1::UBIGINT)) END) AS crc
  FROM own
), conv AS (
  SELECT a.c, list_concat(coalesce(b.turns, [])[1:CAST(xor(a.crc, 4294967295::UBIGINT) % 4 AS INT)], a.turns[CAST(xor(a.crc, 4294967295::UBIGINT) % 4 AS INT) + 1:]) AS turns
  FROM head a LEFT JOIN own b ON b.c = a.c - a.c % 20
), prefix AS (
  SELECT c, d, turns[1:d] AS p, len(turns) = d AS ends FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM conv)
), node AS (
  SELECT p, d, min(c) AS c, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS digest,
         CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].t, '[^\\x20\\x09-\\x0D]+')) END AS words
  FROM prefix GROUP BY p, d
), child AS (
  SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2
), full_node AS (
  SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (p, d)
), below AS (
  SELECT p[1:k] AS p, k AS d, sum((n_children = 0)::INT) AS n_leaves, sum((n - 1) * words) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM full_node) GROUP BY 1, 2
)
SELECT x.c AS conv_id, x.d AS depth, up.c AS parent_conv_id, x.n AS n_convs, CAST(x.n_children AS BIGINT) AS n_children,
       CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, x.digest AS ends_sha256
FROM full_node x JOIN below b USING (p, d) LEFT JOIN node up ON up.d = x.d - 1 AND up.p = x.p[1:x.d - 1]
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; the others are held against brute force in the tests."""
    return {"op4_exact_topk": OP4_SQL, "op8_line_dedup": OP8_SQL, "op12_conversation_trie": OP12_SQL}
