"""Driver queries over the supplied tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths as P
from .functions import text as T
from .functions import vectors as V
from .functions import web as W
from .operators import changes, readq, retrieve, store, validate
from .plans import graph, ranks
from .streaming import folds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(c, digits: int = 6):
    return F.round(c, digits)


PATH = "concat(source, '/', lang, '/', doc_id, '.md')"
TERMS = """flatten([CASE WHEN strlen(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN [lower(w), left(lower(w), length(lower(w)) - 1)] ELSE [lower(w)] END
  FOR w IN [lower(x) FOR x IN regexp_split_to_array(
    regexp_replace(regexp_replace({0}, '([\\p{{Ll}}\\p{{Nd}}])(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g'), '[^\\p{{L}}\\p{{Nd}}]+') IF x <> '']])"""
DOCS = f"docs AS (SELECT doc_id, text, {PATH} AS path FROM documents)"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", "text", "lang", "source", F.expr(PATH).alias("path"))


HYBRID = [("q1", "released under the license src3", 0), ("q2", "password en src11 thing", 7)]
_ASKED = " UNION ALL ".join(f"SELECT '{i}' AS query_id, '{q}' AS query, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {v}) AS qv" for i, q, v in HYBRID)


@query(f"""WITH {DOCS}, asked AS ({_ASKED}), pool AS (
  SELECT d.doc_id, d.path, CAST(e.embedding AS DOUBLE[]) AS v, {TERMS.format('d.text')} AS terms, {TERMS.format('d.path')} AS pt,
         len(string_split(regexp_replace(d.text, chr(10) || '$', ''), chr(10))) AS span
  FROM docs d JOIN embeddings e ON e.vec_id = d.doc_id
), cand AS (
  SELECT query_id, doc_id, path, span, len(terms) AS n, terms, pt, list_distinct({TERMS.format('query')}) AS qt,
         list_dot_product(v, qv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv))) AS cosine
  FROM pool, asked
), per AS (
  SELECT query_id, doc_id, n, t, len([x FOR x IN terms IF x = t]) AS tf FROM (SELECT query_id, doc_id, n, terms, unnest(qt) AS t FROM cand)
), df AS (SELECT query_id, t, sum(CAST(tf > 0 AS BIGINT)) AS df FROM per GROUP BY ALL),
tot AS (SELECT query_id, count(*) AS c, avg(n) AS a FROM cand GROUP BY ALL), bm AS (
  SELECT query_id, doc_id, sum(CASE WHEN tf > 0 THEN ln(1 + (c - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / a)) ELSE 0 END) AS s
  FROM per JOIN df USING (query_id, t) JOIN tot USING (query_id) GROUP BY ALL
), sc AS (
  SELECT query_id, doc_id, path, span, cosine, greatest(1e-9, least(1, greatest(0, (cosine + 1) / 2))) AS vs, s / (s + 1) AS ts,
         len([x FOR x IN qt IF list_contains(pt, x)]) / CAST(len(qt) AS DOUBLE) AS ps
  FROM cand JOIN bm USING (query_id, doc_id)
), rk AS (SELECT *, vs + (1 - vs) * least(1, 0.45 * ts + 0.3 * ps) AS rank FROM sc)
SELECT query_id, CAST(place AS INTEGER) AS place, doc_id, path, round(cosine, 6) AS cosine, round(ts, 6) AS text_score, round(ps, 6) AS path_score, round(rank, 6) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, span, path) AS place FROM rk) WHERE place <= 20""")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid retrieval of two queries over whole documents: C01, D15, I01, I40-I44, F01."""
    docs = _docs(spark, sf)
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "path", F.lit(1).alias("start_line"), F.size(T.body_lines(F.col("text"))).alias("end_line"), F.lit(None).cast("string").alias("symbol"), "text")
    vectors = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    wanted = {r["chunk_id"]: list(r["vector"]) for r in vectors.where(F.col("chunk_id").isin([v for *_, v in HYBRID])).collect()}
    got = retrieve.search(chunks, vectors, [(i, q, wanted[v]) for i, q, v in HYBRID], limit=20)
    return got.select("query_id", "place", F.col("chunk_id").alias("doc_id"), "path", _r("cosine").alias("cosine"), _r("text_score").alias("text_score"), _r("path_score").alias("path_score"), _r("rank").alias("rank"))


@query(f"SELECT doc_id, len(t) AS n_terms, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {TERMS.format('text')} AS t FROM documents)")
def search_terms(spark, sf):
    """Tokenizer with case borders and singulars: I01, G11."""
    return _t(spark, sf, "documents").select("doc_id", F.size(T.terms(F.col("text"))).cast("long").alias("n_terms"), F.size(T.distinct_terms(F.col("text"))).cast("long").alias("n_distinct"))


@query(f"""SELECT doc_id, t AS term, count(*) AS n FROM (SELECT doc_id, unnest({TERMS.format('text')}) AS t FROM documents)
  WHERE t IN ('the', 'that', 'und', 'los') GROUP BY ALL""")
def term_counts(spark, sf):
    """Counts of the terms of a query set: I02."""
    return _t(spark, sf, "documents").select("doc_id", F.explode(T.terms(F.col("text"))).alias("term")).where(F.col("term").isin("the", "that", "und", "los")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query("""SELECT a.vec_id, round(list_dot_product(a.v, q.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(q.v, q.v))), 6) AS cosine
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) a, (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 3) q""")
def cosine_to_row(spark, sf):
    """Cosine of every vector to one: I40."""
    e = _t(spark, sf, "embeddings")
    q = e.where("vec_id = 3").first()["embedding"]
    return e.select("vec_id", _r(V.cosine(F.col("embedding"), F.array(*map(F.lit, q)).cast("array<float>"))).alias("cosine"))


@query("""SELECT vec_id AS ord, 'similar' AS mode FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) a,
  (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 42) b
  WHERE list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) >= 0.9 ORDER BY vec_id LIMIT 1""")
def similar_query_replay(spark, sf):
    """The first history entry that is similar enough: C19."""
    e = _t(spark, sf, "embeddings")
    q = e.where("vec_id = 42").first()["embedding"]
    history = e.select(F.col("vec_id").alias("ord"), F.concat(F.lit("n"), "vec_id").alias("normalized"), F.col("embedding").alias("query_embedding"))
    return retrieve.similar_query(history, list(q), "no such query")


def _windows(size: int, step: int) -> str:
    return f"""WITH l AS (SELECT doc_id, string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), chr(10) || '$', ''), chr(10)) AS ls FROM documents),
  s AS (SELECT doc_id, ls, unnest(range(1, CAST(greatest(len(ls) - {size - step}, 1) AS BIGINT) + 1, {step})) AS st FROM l)
  SELECT doc_id, CAST(st AS INTEGER) AS start_line, CAST(least(st + {size - 1}, len(ls)) AS INTEGER) AS end_line,
         CAST(strlen(array_to_string(ls[st:st + {size - 1}], chr(10))) AS INTEGER) AS bytes FROM s"""


def _chunks(spark, sf, size, step):
    return retrieve.line_chunks(_t(spark, sf, "documents"), size, step).select("doc_id", "start_line", "end_line", F.octet_length("body").alias("bytes"))


@query(_windows(80, 60))
def line_windows(spark, sf):
    """Overlapping windows of 80 lines: E01, I07."""
    return _chunks(spark, sf, 80, 60)


@query(_windows(8, 6))
def small_line_windows(spark, sf):
    """The same with windows of 8 lines: E01."""
    return _chunks(spark, sf, 8, 6)


@query("SELECT doc_id, printf('c%06d', CAST(row_number() OVER (ORDER BY source, doc_id) AS BIGINT)) AS chunk_id FROM documents")
def chunk_numbers(spark, sf):
    """Chunk ids in order: E06."""
    return retrieve.numbered(_t(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "chunk_id")


@query("""SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS q,
  CASE WHEN length(text) <= 31970 THEN 'implementation entrypoint for ' || text ELSE left(text, 32000) END AS framed FROM documents""")
def query_texts(spark, sf):
    """Whole texts as normalised and framed queries: I03-I05."""
    return _t(spark, sf, "documents").select("doc_id", T.normalized_query(F.col("text")).alias("q"), T.framed_query(F.col("text")).alias("framed"))


@query("""SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND text NOT LIKE '%' || chr(10) THEN 1 ELSE 0 END AS INTEGER) AS n_lines,
  CAST(strlen(text) AS INTEGER) AS n_bytes FROM documents""")
def line_and_byte_counts(spark, sf):
    """Lines and bytes of texts: D29."""
    return _t(spark, sf, "documents").select("doc_id", T.line_count(F.col("text")).alias("n_lines"), F.octet_length("text").alias("n_bytes"))


@query("""SELECT doc_id, array_to_string(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))[2:4], chr(10)) AS body FROM documents""")
def line_ranges(spark, sf):
    """Lines 2 to 4 of each text: I34, L03."""
    return _t(spark, sf, "documents").select("doc_id", T.line_range(F.col("text"), F.lit(2), F.lit(4)).alias("body"))


KINDS = "concat(source, CASE lang WHEN 'en' THEN '/' || doc_id || '_test.go' WHEN 'de' THEN '/tests/' || doc_id || '.yaml' WHEN 'fr' THEN '/a/' || doc_id || '.py' ELSE '/LATEST' || doc_id END)"


@query(f"""SELECT doc_id, {KINDS} AS path, source || CASE lang WHEN 'de' THEN '/tests' WHEN 'fr' THEN '/a' ELSE '' END AS dir, CASE lang WHEN 'en' THEN '.go' WHEN 'de' THEN '.yaml' WHEN 'fr' THEN '.py' ELSE '<none>' END AS extension,
  CASE lang WHEN 'en' THEN 'go' WHEN 'de' THEN 'yaml' ELSE '' END AS language, coalesce(lang IN ('en', 'fr'), false) AS code, coalesce(lang IN ('en', 'de'), false) AS test FROM documents""")
def path_parts(spark, sf):
    """Directory, extension, language and predicates of paths: I30, I31, B05, B06."""
    p = F.col("path")
    return _t(spark, sf, "documents").select("doc_id", F.expr(KINDS).alias("path")).select("doc_id", "path", P.directory(p).alias("dir"), P.extension(p).alias("extension"), P.language(p).alias("language"), P.is_code(p).alias("code"), P.is_test(p).alias("test"))


@query("""SELECT page_id, u AS url, lower(regexp_extract(u, '^[a-zA-Z]+://(?:[^@/?#]*@)?([^/:?#]*)', 1)) AS host
  FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://)[^@/]*@', '\\1') AS u FROM pages)""")
def sanitized_urls(spark, sf):
    """Addresses without user, query and fragment, and hosts: I67."""
    u = W.sanitized(F.col("url"))
    return _t(spark, sf, "pages").select("page_id", u.alias("url"), F.lower(F.regexp_extract(u, W.URL, 2)).alias("host"))


@query("""SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://(?:[^@/?#]*@)?([^/:?#]*)', 1)) || '/' ||
  regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '^/+|/+$', '', 'g'), '\\.git$', '') AS identity FROM pages""")
def url_identities(spark, sf):
    """One text for all forms of an address: I68."""
    return _t(spark, sf, "pages").select("page_id", W.identity(F.col("url")).alias("identity"))


@query()
def page_main_text(spark, sf):
    """Visible text of pages without scripts and styles: I70."""
    return _t(spark, sf, "pages").select("page_id", W.main_text(F.col("html"), "").alias("text"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def json_pointer(spark, sf):
    """A JSON pointer as exact text: I60, L07."""
    return _t(spark, sf, "events").select("event_id", readq.pointer(F.col("props"), "/k").alias("k"))


@query("""SELECT event_id, unnest(['/a', '/b', '/it''s', '/n', '/x~1y']) AS pointer, unnest(['object', 'array', 'string', 'null', 'number']) AS kind FROM events""")
def json_kinds(spark, sf):
    """Members of JSON objects with their kinds: H09."""
    e = _t(spark, sf, "events")
    members = F.format_string('{"n":null,"a":%s,"b":[%d],"it\'s":"%s","x/y":%d}', F.col("props"), F.col("event_id"), F.col("event_type"), F.col("user_id"))
    return readq.json_members(e.select("event_id", members.alias("j")), "event_id", "j")


@query(f"""WITH {DOCS}, l AS (SELECT path, string_split_regex(text, '\\r?\\n') AS ls FROM docs WHERE strlen(text) <= 2097152),
  x AS (SELECT path, unnest(range(1, len(ls) + 1)) AS i, ls FROM l)
  SELECT path, CAST(i AS INTEGER) AS line, left(ls[i], 1000) AS match FROM x WHERE regexp_matches(ls[i], '[Ll]icense|password=[0-9a-f]+')""")
def grep_lines(spark, sf):
    """All lines that match a pattern: L05."""
    return readq.grep(_docs(spark, sf), "[Ll]icense|password=[0-9a-f]+", most=None)


@query(f"""WITH {DOCS}, f AS (SELECT path, 'file' AS kind FROM docs UNION SELECT source, 'directory' FROM documents UNION SELECT source || '/' || lang, 'directory' FROM documents)
  SELECT path, kind FROM f WHERE regexp_matches(path, '^src1[^/]*$') OR regexp_matches(path, '^([^/]*/)*[^/]*7\\.md$') AND regexp_matches(regexp_extract(path, '[^/]*$'), '^src1[^/]*$')""")
def find_paths(spark, sf):
    """Files and directories by glob: L06, B15."""
    return readq.find(_docs(spark, sf), "src1*", most=None)


@query(f"""WITH {DOCS} SELECT path FROM docs WHERE path = 'src1' OR starts_with(path, 'src1/') ORDER BY path LIMIT 201""")
def list_files(spark, sf):
    """Paths below a prefix with a probe for truncation: L02, A10."""
    return readq.listed(_docs(spark, sf), "src1")


@query(f"""WITH {DOCS} SELECT path, (SELECT count(*) FROM docs) AS total, (SELECT count(*) FROM docs) > 90 AS has_more, CAST(90 AS BIGINT) AS next_offset FROM docs ORDER BY path LIMIT 50 OFFSET 40""")
def page_of_paths(spark, sf):
    """A page of an inventory with its total: F08, L08."""
    return readq.page(_docs(spark, sf).select("path"), ["path"], 40, 50)


@query("""SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id)""")
def reuse_join(spark, sf):
    """Chunks with the last vector of their hash: C02."""
    chunks = _t(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("embedding_input_hash"))
    pool = _t(spark, sf, "labels").select(F.col("doc_id").alias("embedding_input_hash"), F.col("quality").alias("vector"), F.lit(1).alias("ord"))
    return store.reuse(chunks, pool).select("doc_id", F.col("vector").alias("quality"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_chunks(spark, sf):
    """Chunks without a vector: C03, C04."""
    return store.missing(_t(spark, sf, "documents").select("doc_id"), _t(spark, sf, "labels"), "doc_id")


@query("""SELECT k, v FROM (SELECT o_custkey AS k, o_orderkey AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderkey) AS r FROM orders) WHERE r = 1""")
def precedence_union(spark, sf):
    """Base rows beat incoming ones, the first incoming the later ones: G01."""
    o = _t(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.col("o_orderkey").alias("ord"), "o_orderstatus")
    base, incoming = o.where("o_orderstatus = 'F'").drop("o_orderstatus"), o.where("o_orderstatus <> 'F' or o_orderstatus is null").drop("o_orderstatus")
    return store.precedence(base, incoming, "k").select("k", "v")


@query("SELECT o_custkey AS k FROM orders GROUP BY 1 HAVING min(o_orderstatus) <> max(o_orderstatus)")
def union_conflicts(spark, sf):
    """Keys whose payloads differ: G02."""
    return store.conflicts(_t(spark, sf, "orders").withColumnRenamed("o_custkey", "k"), "k", "o_orderstatus")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def dead_rows(spark, sf):
    """Catalog rows that no live index names: D22, D24."""
    return store.garbage(_t(spark, sf, "documents").select("doc_id", "n_chars"), _t(spark, sf, "labels").where("quality = 1"), "doc_id")


@query("SELECT vec_id, CAST(floor((row_number() OVER (ORDER BY vec_id) - 1) / 64) AS BIGINT) AS pack, CAST((row_number() OVER (ORDER BY vec_id) - 1) % 64 AS BIGINT) AS slot FROM embeddings")
def pack_numbers(spark, sf):
    """Packs and slots in key order: E04."""
    return store.packs(_t(spark, sf, "embeddings").select("vec_id"), 64, "vec_id", size=64 * 64 * 4).select("vec_id", F.col("pack").cast("long").alias("pack"), F.col("slot").cast("long").alias("slot"))


@query("SELECT vec_id, CAST(coalesce(sum(4 * len(embedding)) OVER (ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM embeddings")
def running_offsets(spark, sf):
    """Exclusive byte offsets in key order: E05."""
    e = _t(spark, sf, "embeddings").select("vec_id", F.size("embedding").alias("dims"))
    return store.byte_offsets(e, "dims", "vec_id").select("vec_id", "offset")


@query("""SELECT c_custkey AS path, CASE WHEN o.n IS NULL THEN '' ELSE 'M' END AS status, coalesce(o.n, 0) AS adds FROM customer
  LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def change_inventory(spark, sf):
    """Paths with status and counts, with defaults: C10-C12."""
    n = _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("path")).agg(F.count("*").alias("adds"))
    paths = _t(spark, sf, "customer").select(F.col("c_custkey").alias("path"))
    got = changes.inventory(paths, n.select("path", F.lit("M").alias("status")), n.select("path", "adds", F.lit(0).alias("deletes"), F.lit(False).alias("is_binary")))
    return got.select("path", "status", "adds")


@query("""WITH a AS (SELECT l_partkey AS k, count(*) AS v FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey AS k, count(*) AS v FROM lineitem GROUP BY 1)
  SELECT coalesce(a.k, b.k) AS k, a.v AS old, b.v AS new, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'deleted' ELSE 'modified' END AS status
  FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v""")
def full_outer_delta(spark, sf):
    """Keys whose values differ between two sides: C13-C15."""
    side = lambda c: _t(spark, sf, "lineitem").groupBy(F.col(c).alias("k")).agg(F.count("*").alias("v"))
    return changes.delta(side("l_partkey"), side("l_suppkey"), "k", "v").select("k", "old", "new", "status")


FACTS = """facts AS (SELECT l_returnflag || '/' || l_linestatus || '/' || l_suppkey || CASE WHEN l_linenumber = 1 THEN '.go' ELSE '.md' END AS path,
  CAST(sum(l_quantity) AS BIGINT) AS adds, count(*) AS deletes, l_linenumber = 1 AS generated, CASE WHEN l_linestatus = 'O' THEN 'A' ELSE 'M' END AS status
  FROM lineitem GROUP BY ALL)"""


def _facts(spark, sf):
    li = _t(spark, sf, "lineitem")
    return li.groupBy(
        F.expr("concat(l_returnflag, '/', l_linestatus, '/', l_suppkey, case when l_linenumber = 1 then '.go' else '.md' end)").alias("path"),
        (F.col("l_linenumber") == 1).alias("generated"), F.expr("case when l_linestatus = 'O' then 'A' else 'M' end").alias("status"),
    ).agg(F.sum("l_quantity").cast("long").alias("adds"), F.count("*").alias("deletes")).withColumn("rule", F.lit(""))


@query(f"""WITH {FACTS}, d AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, count(*) AS c FROM facts GROUP BY 1)
  SELECT count(*) AS files, CAST(sum(adds) AS BIGINT) AS adds, CAST(sum(deletes) AS BIGINT) AS deletes, CAST(sum(CAST(generated AS INT)) AS BIGINT) AS generated_files, (SELECT dir FROM d ORDER BY c DESC, dir LIMIT 1) AS dominant_scope FROM facts""")
def change_overview(spark, sf):
    """Sums of a change set and its dominant directory: D01, D04."""
    return changes.overview(_facts(spark, sf))


@query(f"""WITH {FACTS}, g AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '(\\.[^.]*)$', 1) AS extension FROM facts),
  o AS (SELECT *, row_number() OVER (PARTITION BY status, generated, dir, extension ORDER BY path) AS k, count(*) OVER (PARTITION BY status, generated, dir, extension) AS n,
    row_number() OVER (PARTITION BY status, generated, dir, extension ORDER BY adds + deletes DESC, path) AS c FROM g)
  SELECT status, generated, dir, extension, count(*) AS files, CAST(sum(adds) AS BIGINT) AS adds, CAST(sum(deletes) AS BIGINT) AS deletes, dir || '/*' || extension AS match,
    min(CASE WHEN c = 1 THEN path END) AS most_changed, min(CASE WHEN k = 1 THEN path END) AS first_sample, min(CASE WHEN k = CASE WHEN n <= 3 THEN 1 ELSE n // 2 + 1 END THEN path END) AS middle_sample,
    (SELECT count(*) FROM facts) > 20 AND count(*) <= 1 AS outlier FROM o GROUP BY ALL""")
def change_groups(spark, sf):
    """Groups of a change set with samples and outliers: D02, D03, D05."""
    got = changes.groups(_facts(spark, sf))
    middle = F.when(F.col("files") <= 3, F.element_at("samples", 1)).otherwise(F.get("samples", F.lit(1)))
    # the middle sample is the first one again where it is also the most changed one and the group is small
    return got.select("status", "generated", "dir", "extension", "files", "adds", "deletes", "match", "most_changed", F.element_at("samples", 1).alias("first_sample"), middle.alias("middle_sample"), "outlier")


@query(f"""WITH {FACTS} SELECT status, path, place FROM (SELECT status, path, CAST(row_number() OVER (PARTITION BY status ORDER BY adds + deletes DESC, path) AS INTEGER) AS place FROM facts) WHERE place <= 3""")
def top_churn(spark, sf):
    """The most changed paths of each status: F04."""
    return changes.top_churn(_facts(spark, sf), ["status"]).select("status", "path", "place")


CLASSED = """files AS (SELECT p_brand AS sha, 'x' || p_partkey || CASE p_size % 7 WHEN 0 THEN '_test.go' WHEN 1 THEN '.md' WHEN 2 THEN '.gen.ts' WHEN 3 THEN '/go.mod' WHEN 4 THEN '/Makefile' ELSE '.go' END AS path,
  p_size AS additions, 1 AS deletions, p_size % 11 = 0 AS submodule, p_size % 7 = 0 AS test, p_size % 7 = 1 AS docs, p_size % 7 = 2 AS generated, p_size % 7 = 3 AS dependency, p_size % 7 = 4 AS build FROM part)"""


def _files(spark, sf):
    part = _t(spark, sf, "part").withColumn("m", F.col("p_size") % 7)
    end = F.when(F.col("m") == 0, "_test.go").when(F.col("m") == 1, ".md").when(F.col("m") == 2, ".gen.ts").when(F.col("m") == 3, "/go.mod").when(F.col("m") == 4, "/Makefile").otherwise(".go")
    out = part.select(F.col("p_brand").alias("sha"), F.concat(F.lit("x"), "p_partkey", end).alias("path"), F.col("p_size").cast("long").alias("additions"), F.lit(1).cast("long").alias("deletions"), (F.col("p_size") % 11 == 0).alias("submodule"))
    return out.withColumns(P.release_classes(F.col("path")))


@query(f"""WITH {CLASSED} SELECT sha, count(*) AS files, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions,
  CAST(sum(CAST(submodule AS INT)) AS BIGINT) AS submodule_files, CAST(sum(CAST(NOT submodule AND build AS INT)) AS BIGINT) AS build_files, CAST(sum(CAST(NOT submodule AND test AS INT)) AS BIGINT) AS test_files,
  CAST(sum(CAST(NOT submodule AND docs AS INT)) AS BIGINT) AS docs_files, CAST(sum(CAST(NOT submodule AND generated AS INT)) AS BIGINT) AS generated_files, CAST(sum(CAST(NOT submodule AND dependency AS INT)) AS BIGINT) AS dependency_files FROM files GROUP BY 1""")
def classified_diffstat(spark, sf):
    """Files by their first class: B19, D08, D09."""
    return changes.classified_diffstat(_files(spark, sf), "sha")


@query(f"""WITH {CLASSED} SELECT sha, bool_and(generated) AS generated_only, bool_and(test) AS tests_only, bool_and(dependency) AS dependency_only, bool_and(submodule) AS submodule_only, bool_and(build) AS build_only,
  false AS internal_only, bool_or(docs) AS docs_changed, false AS cli_changed, false AS api_changed, false AS config_schema_changed, bool_or(NOT (test OR docs OR generated OR dependency OR submodule OR build)) AS runtime_changed FROM files GROUP BY 1""")
def operator_signals(spark, sf):
    """Whether all or any files of a change are of a class: D10."""
    return changes.operator_signals(_files(spark, sf), "sha")


BUDGET = f"""WITH {FACTS}, m AS (SELECT status, CAST(sum(adds + deletes) AS BIGINT) AS total, CAST(sum(CASE WHEN generated THEN adds + deletes ELSE 0 END) AS BIGINT) AS made, count(*) AS n,
    CAST(sum(CAST(generated AS INT)) AS BIGINT) AS gen, count(DISTINCT split_part(path, '/', 1)) AS scopes FROM facts GROUP BY 1),
  e AS (SELECT status, CAST(total - made + ceil(made * 0.15) AS BIGINT) AS effective_lines, CAST(n - gen + ceil(gen / 4) AS BIGINT) AS effective_files, scopes FROM m),
  w AS (SELECT *, CAST(2 * ceil(sqrt(effective_lines / 50)) + ceil(sqrt(effective_files)) + ceil(log2(1 + greatest(scopes - 1, 0))) AS BIGINT) AS work_units FROM e)"""


@query(f"{BUDGET} SELECT * FROM w")
def budget_metrics(spark, sf):
    """Effective lines, files and work units: D13, I45."""
    return changes.budget_metrics(_facts(spark, sf).withColumn("is_binary", F.lit(False)), "status")


@query(f"""{BUDGET}, l AS (SELECT *, CAST(least(greatest(6 + ceil(0.5 * work_units * 1.05), 8), 60) AS BIGINT) AS lo, CAST(6 + ceil(work_units * 1.15) + 3 AS BIGINT) AS hi FROM w),
  u AS (SELECT *, least(greatest(hi, lo), 60) AS up FROM l)
  SELECT status, lo AS lower_steps, up AS upper_steps, CAST(ceil((lo + up) / 2) AS BIGINT) AS balanced_steps, CAST(least(greatest(6, ceil(4 * ceil((lo + up) / 2) / 5)), 48) AS BIGINT) AS balanced_tools FROM u""")
def budget_plans(spark, sf):
    """Steps and tool calls of a plan: D14."""
    m = changes.budget_metrics(_facts(spark, sf).withColumn("is_binary", F.lit(False)), "status")
    return changes.budget_plan(m, "review", 0.8).select("status", "lower_steps", "upper_steps", "balanced_steps", "balanced_tools")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def counts_by_kind(spark, sf):
    """Rows by kind: D16, D19."""
    return changes.counts_by(_t(spark, sf, "events"), F.col("event_type"), "event_type")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM (SELECT event_type FROM events UNION ALL SELECT event_type FROM events WHERE value > 10) GROUP BY 1")
def merged_counts(spark, sf):
    """Counts of two tables added: D20."""
    e = _t(spark, sf, "events")
    return changes.merged_counts(*(changes.counts_by(x, F.col("event_type"), "event_type") for x in (e, e.where("value > 10"))), key="event_type")


@query("""WITH g AS (SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 36000000000 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT user_id, ts, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g)
  SELECT user_id, session, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM s GROUP BY ALL""")
def gap_sessions(spark, sf):
    """Sessions by gaps of ten hours: J04."""
    got = folds.gap_sessions(_t(spark, sf, "events"), "user_id", "ts", 36_000)
    micros = lambda c: (F.unix_micros(F.col(c).cast("timestamp"))).alias(f"{c}_us")
    return got.select("user_id", "session", micros("first"), micros("last"), "n")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_rows(spark, sf):
    """The last row of each key: E07, J09."""
    return folds.latest(_t(spark, sf, "events"), "user_id", "event_id", "event_id", "event_type")


@query("""WITH f AS (SELECT *, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM conversations),
  c AS (SELECT conv_id, v, max(CASE WHEN role IS DISTINCT FROM v THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS c FROM f)
  SELECT conv_id, count(*) AS run, min(v) AS value FROM c WHERE c = 0 GROUP BY 1""")
def leading_runs(spark, sf):
    """The run of equal values that a group begins with: E12."""
    return folds.leading_run(_t(spark, sf, "conversations"), "conv_id", "turn", "role")


@query("SELECT conv_id AS id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY 1")
def ordered_concat(spark, sf):
    """Deltas in order: E13, J07."""
    c = _t(spark, sf, "conversations").select(F.col("conv_id").alias("id"), F.lit(0).alias("part"), F.col("turn").alias("seq"), F.col("text").alias("delta"), F.lit(False).alias("done"))
    return folds.concatenated(c)


@query("""SELECT conv_id, CAST(count(*) AS BIGINT) AS input_tokens, CAST(sum(length(text)) AS BIGINT) AS total_tokens, CAST(greatest(0, count(*) - sum(turn)) AS BIGINT) AS uncached_input_tokens FROM conversations GROUP BY 1""")
def usage_sums(spark, sf):
    """Token counters added: D18, D37, B38."""
    c = _t(spark, sf, "conversations").select("conv_id", F.lit(1).cast("long").alias("input_tokens"), F.col("turn").alias("cached_input_tokens"), F.lit(0).cast("long").alias("cache_write_input_tokens"), F.lit(0).cast("long").alias("output_tokens"), F.lit(0).cast("long").alias("reasoning_tokens"), F.char_length("text").cast("long").alias("total_tokens"))
    return folds.usage(c, "conv_id").select("conv_id", "input_tokens", "total_tokens", "uncached_input_tokens")


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS n, CASE WHEN c_custkey % 3 = 0 THEN c_custkey // 3 END AS p FROM customer WHERE c_custkey > 1 UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey // 2 END FROM customer WHERE c_custkey > 1),
  r AS (SELECT CAST(864 AS BIGINT) AS node UNION SELECT p FROM r JOIN e ON n = node WHERE p IS NOT NULL), b AS (SELECT CAST(72 AS BIGINT) AS node UNION SELECT p FROM b JOIN e ON n = node WHERE p IS NOT NULL)
  SELECT node FROM r WHERE node NOT IN (SELECT node FROM b)""")
def commit_range(spark, sf):
    """What a release reaches and its base doesn't: H01, H02, G07, A25."""
    c = _t(spark, sf, "customer").where("c_custkey > 1").select("c_custkey")
    edges = c.selectExpr("c_custkey as sha", "case when c_custkey % 3 = 0 then c_custkey div 3 end as parent").unionByName(c.selectExpr("c_custkey as sha", "case when c_custkey % 2 = 0 then c_custkey div 2 end as parent"))
    one = lambda n: spark.range(1).select(F.lit(n).cast("long").alias("node"))
    return graph.commit_range(edges, one(72), one(864)).select("node")


@query("""WITH RECURSIVE d AS (SELECT conv_id, turn, CAST(0 AS INTEGER) AS depth FROM conversations WHERE turn = (SELECT min(turn) FROM conversations)
  UNION ALL SELECT c.conv_id, c.turn, CASE WHEN d.depth >= 3 THEN 0 ELSE d.depth + 1 END FROM d JOIN conversations c ON c.conv_id = d.conv_id AND c.turn = d.turn + 1)
  SELECT conv_id * 1000 + turn AS id, depth FROM d""")
def lineage_depths(spark, sf):
    """Follow-up depths: H07."""
    c = _t(spark, sf, "conversations")
    low = c.agg(F.min("turn")).first()[0]
    rows = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") > low, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent_id"))
    return graph.depths(rows)


@query(f"""WITH {DOCS} SELECT path, CASE WHEN source IN ('src1', 'src2') AND lang = 'en' THEN source || '/en' ELSE source END AS root FROM docs JOIN documents USING (doc_id) WHERE source IN ('src1', 'src2', 'src3')""")
def nearest_roots(spark, sf):
    """Each path's deepest root: C20, C21, C23."""
    docs = _docs(spark, sf)
    roots = docs.where("source in ('src1', 'src2', 'src3')").select(F.col("source").alias("root")).unionByName(docs.where("source in ('src1', 'src2') and lang = 'en'").select(F.concat("source", F.lit("/en")).alias("root")))
    return graph.nearest_ancestor(docs, roots)


@query(r"""WITH m AS (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations),
  c AS (SELECT conv_id, turn, unnest([CASE WHEN t = '' THEN 'empty message' END, CASE WHEN contains(t, '```') THEN 'code fence' END,
    CASE WHEN contains(lower(t), 'here is') OR contains(lower(t), 'commit message:') OR contains(lower(t), 'explanation:') OR contains(lower(t), 'i would') THEN 'commentary' END,
    CASE WHEN len([l FOR l IN string_split(t, chr(10))[2:] IF strlen(l) > 90]) > 0 THEN 'body line over 90 bytes' END]) AS error FROM m)
  SELECT conv_id, turn, error FROM c WHERE error IS NOT NULL""")
def message_errors(spark, sf):
    """Errors of messages, a row each: V01."""
    c = _t(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.explode(validate.commit_message(F.col("text"))).alias("error"))


@query("""WITH f AS (SELECT o_custkey AS report, o_orderkey AS ord, CASE split_part(o_orderpriority, '-', 1) WHEN '1' THEN 4 WHEN '2' THEN 3 WHEN '3' THEN 2 ELSE 1 END AS r FROM orders)
  SELECT report, CASE WHEN max(r) >= 3 THEN 'FIX' WHEN max(r) IS NOT NULL THEN 'COMMENT' ELSE 'APPROVE' END AS recommendation, count(*) AS findings FROM f GROUP BY 1""")
def recommendations(spark, sf):
    """What reports recommend by their worst finding: D21."""
    return validate.recommendation(_findings(spark, sf))


def _findings(spark, sf):
    first = F.substring_index("o_orderpriority", "-", 1)
    severity = F.when(first == "1", "CRITICAL").when(first == "2", "HIGH").when(first == "3", "MEDIUM").otherwise("LOW")
    return _t(spark, sf, "orders").select(F.col("o_custkey").alias("report"), F.col("o_orderkey").alias("ord"), severity.alias("severity"), F.lit("style").alias("aspect"), F.lit("t").alias("title"), F.lit(2).alias("line_start"), F.lit(1).alias("line_end"))


@query("""WITH f AS (SELECT o_custkey AS report, o_orderkey AS ord, CASE split_part(o_orderpriority, '-', 1) WHEN '1' THEN 4 WHEN '2' THEN 3 WHEN '3' THEN 2 ELSE 1 END AS r FROM orders),
  e AS (SELECT report, ord, unnest([CASE WHEN lag(r) OVER (PARTITION BY report ORDER BY ord) < r THEN 'severity rises' END, CASE WHEN r > 1 THEN 'style must be low' END, 'bad line range']) AS error FROM f)
  SELECT report, ord, error FROM e WHERE error IS NOT NULL""")
def finding_errors(spark, sf):
    """Errors of findings, a row each: V02, E09."""
    return validate.findings(_findings(spark, sf)).select("report", "ord", F.explode("errors").alias("error"))


@query("SELECT doc_id, sha256(text) AS input_hash, sha256(sha256(text) || chr(0) || 'm' || chr(0) || '64') AS vector_key FROM documents")
def content_identities(spark, sf):
    """Input hashes and vector keys: I47, I48."""
    h = V.input_hash(F.col("text"))
    return _t(spark, sf, "documents").select("doc_id", h.alias("input_hash"), V.vector_key(h, F.lit("m"), F.lit(64)).alias("vector_key"))


@query("SELECT p_partkey, CAST(regexp_extract(v, '^v?(\\d+)', 1) AS INTEGER) AS major, printf('v%d.%d.0', p_size // 10, p_size % 10 + 1) AS next FROM (SELECT p_partkey, p_size, printf('v%d.%d.%d', p_size // 10, p_size % 10, 3) AS v FROM part)")
def version_bumps(spark, sf):
    """Parsed and next versions: I71, I72."""
    part = _t(spark, sf, "part").withColumn("v", F.expr("concat('v', p_size div 10, '.', p_size % 10, '.3')"))
    return part.select("p_partkey", W.version(F.col("v"))["major"].alias("major"), W.bumped(F.col("v"), "minor").alias("next"))


@query()
def greedy_batches(spark, sf):
    """Batches by count and bytes: E03."""
    docs = _t(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return ranks.greedy_batches(docs, "source", "doc_id", "n_chars", 32, 60_000)


@query()
def change_fingerprint(spark, sf):
    """A hash of rows in any order: D32, D33."""
    return changes.fingerprint(_t(spark, sf, "orders"), "o_orderkey", "o_orderstatus", "o_custkey")


_TREE = "sha1(unhex(hex(encode('tree ' || CAST(len(string_agg(e, '')) // 2 AS VARCHAR))) || '00' || string_agg(e, '' ORDER BY k)))"


@query(f"""WITH {DOCS}, f AS (SELECT source, lang, doc_id || '.md' AS name, sha1(encode('blob ' || strlen(text)) || '\\x00'::BLOB || encode(text)) AS blob FROM documents),
  low AS (SELECT source, lang, {_TREE} AS hash FROM (SELECT source, lang, name AS k, hex(encode('100644 ' || name)) || '00' || blob AS e FROM f) GROUP BY source, lang),
  mid AS (SELECT source, {_TREE} AS hash FROM (SELECT source, lang || '/' AS k, hex(encode('40000 ' || lang)) || '00' || hash AS e FROM low) GROUP BY source),
  top AS (SELECT {_TREE} AS hash FROM (SELECT source || '/' AS k, hex(encode('40000 ' || source)) || '00' || hash AS e FROM mid))
  SELECT source || '/' || lang AS dir, hash FROM low UNION ALL SELECT source, hash FROM mid UNION ALL SELECT '.', hash FROM top""")
def merkle_tree(spark, sf):
    """Directory ids from files, as git gives them: H06."""
    text = F.encode("text", "UTF-8")
    blob = F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length("text").cast("string")), "UTF-8"), F.unhex(F.lit("00")), text))
    return graph.merkle(_docs(spark, sf).select("path", blob.alias("blob")))


@query()
def markdown_headings(spark, sf):
    """Headings outside fences: I73, L04."""
    return readq.markdown_outline(_docs(spark, sf))


from . import record_queries, view_queries  # noqa: E402, F401 -- they register their own queries
