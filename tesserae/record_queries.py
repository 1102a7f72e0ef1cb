"""Driver queries over records: merges that keep rows, orders, filters and short forms, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import vectors as V
from .operators import changes, history, messages, reports, retrieve, store, validate, views
from .queries import PATH, _t, query


@query("""SELECT doc_id, 'new' AS origin, length(text) AS size FROM documents WHERE lang = 'en' AND text IS NOT NULL
  UNION ALL SELECT doc_id, 'old', n_chars FROM documents WHERE lang <> 'en' AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en' AND text IS NOT NULL)""")
def preserved_rows(spark, sf):
    """Rows of a scope that was read again, and old rows outside of it: C06, C07, C08."""
    d = _t(spark, sf, "documents")
    records = d.where("lang = 'en' and text is not null").select("doc_id", F.lit("new").alias("origin"), F.char_length("text").cast("bigint").alias("size"), "lang")
    old = d.select("doc_id", F.lit("old").alias("origin"), F.col("n_chars").alias("size"), "lang")
    return store.preserved(records, old, "doc_id", F.col("lang") != "en").select("doc_id", "origin", "size")


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A')
  (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL (SELECT k FROM b EXCEPT SELECT k FROM a)""")
def scope_changes(spark, sf):
    """Keys that one of two states of a scope lacks: C09."""
    side = lambda f: _t(spark, sf, "lineitem").where(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("k"))
    return store.rows_changed(side("R"), side("A"), "k")


@query("""WITH r AS (SELECT o_orderkey AS k, o_custkey AS place, 'remote' AS origin FROM orders WHERE o_orderstatus = 'F'),
  l AS (SELECT o_orderkey + 1 AS k, o_custkey AS place, 'local' AS origin FROM orders WHERE o_orderpriority LIKE '1%')
  SELECT * FROM r UNION ALL SELECT * FROM l WHERE k NOT IN (SELECT k FROM r) AND place NOT IN (SELECT place FROM r)""")
def imported_rows(spark, sf):
    """Remote rows, and local ones whose key and place the remote lacks: G03."""
    o = _t(spark, sf, "orders")
    remote = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("place"), F.lit("remote").alias("origin"))
    local = o.where("o_orderpriority like '1%'").select((F.col("o_orderkey") + 1).alias("k"), F.col("o_custkey").alias("place"), F.lit("local").alias("origin"))
    return store.imported(local, remote, "k", "place")


@query("""SELECT DISTINCT 'p' || l_suppkey AS path, l_linenumber AS line, CAST(l_quantity AS INTEGER) AS "column", l_returnflag AS code, l_linestatus AS message FROM lineitem
  ORDER BY path, line, "column", code, message LIMIT 100""")
def first_diagnostics(spark, sf):
    """Distinct diagnostics, the first hundred in order: D38, F06."""
    l = _t(spark, sf, "lineitem")  # noqa: E741
    rows = l.select(F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("path"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("int").alias("column"), F.col("l_returnflag").alias("code"), F.col("l_linestatus").alias("message"))
    return changes.unique_diagnostics(rows, 100)


@query("SELECT event_id FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE value <= b")
def order_breaks(spark, sf):
    """Rows that aren't above the one before them: E10."""
    return validate.strictly_ascending(_t(spark, sf, "events"), "value", "user_id", "event_id").select("event_id")


@query("""SELECT DISTINCT path FROM (SELECT p_brand AS path FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT s_name FROM supplier) WHERE path IS NOT NULL AND path <> '' ORDER BY path""")
def path_union(spark, sf):
    """Old and new paths and those of submodules: G09."""
    part = _t(spark, sf, "part").select(F.col("p_brand").alias("path"), F.col("p_type").alias("old_path"))
    return history.changed_paths(part, _t(spark, sf, "supplier").select(F.col("s_name").alias("path")))


@query("SELECT event_id, CAST((strlen(props) + 3) // 4 AS BIGINT) AS tokens FROM events")
def token_estimates(spark, sf):
    """A quarter of the bytes: I46."""
    return _t(spark, sf, "events").select("event_id", V.token_estimate(F.col("props")).cast("bigint").alias("tokens"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN false ELSE o_orderstatus = 'O' AND o_orderpriority LIKE '%HIGH%' AND o_custkey % 3 = 0 END AS replays FROM orders""")
def filter_matches(spark, sf):
    """Whether a query that was stored with filters can be replayed: B16."""
    stored = F.when(F.col("o_orderstatus") != "P", F.struct((F.col("o_orderstatus") == "O").alias("code"), F.col("o_orderpriority").like("%HIGH%").alias("no_tests"),
                                                             F.when(F.col("o_custkey") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("scope")))
    rows = _t(spark, sf, "orders").select("o_orderkey", stored.alias("filters"))
    return rows.select("o_orderkey", retrieve.same_filters(True, True, ["a", "b"]).alias("replays"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 2 = 0 THEN 'f' || l_orderkey || '.go' ELSE 'f' || l_orderkey || '.md' END AS path, CASE WHEN l_returnflag = 'R' THEN 's' END AS symbol FROM lineitem),
  n AS (SELECT *, bool_or(symbol IS NOT NULL) OVER (PARTITION BY path) AS named FROM r)
  SELECT l_orderkey, l_linenumber, path, symbol FROM n WHERE NOT (symbol IS NULL AND named AND path LIKE '%.go')""")
def brief_results(spark, sf):
    """Hits without a symbol go where their source file has one with: B32."""
    l = _t(spark, sf, "lineitem")  # noqa: E741
    path = F.concat(F.lit("f"), F.col("l_orderkey").cast("string"), F.when(F.col("l_orderkey") % 2 == 0, ".go").otherwise(".md"))
    return retrieve.brief(l.select("l_orderkey", "l_linenumber", path.alias("path"), F.when(F.col("l_returnflag") == "R", "s").alias("symbol")))


@query("SELECT l_orderkey, l_linenumber, printf('%.2f %s %s', l_discount, 'o' || l_orderkey || ':' || l_linenumber, l_returnflag) AS line FROM lineitem")
def brief_lines(spark, sf):
    """Score, location and summary on a line: A49."""
    place = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string"))
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", messages.brief_line(F.col("l_discount"), place, F.col("l_returnflag")).alias("line"))


@query("""SELECT event_id, '/k' AS pointer, 'number' AS value_kind, CAST(strlen(props ->> '$.k') AS BIGINT) AS value_bytes, CAST(1 AS BIGINT) AS value_lines,
  CASE WHEN strlen(props ->> '$.k') <= 1 THEN props ->> '$.k' END AS value, strlen(props ->> '$.k') > 1 AS truncated FROM events""")
def pointed_json(spark, sf):
    """A pointer's value with its kind and size, cut beyond a limit: I61."""
    rows = _t(spark, sf, "events").select(F.col("event_id").cast("string").alias("path"), F.col("props").alias("text"))
    out = reports.pointed(rows, "/k", most_bytes=1)
    return out.select(F.col("path").cast("bigint").alias("event_id"), "pointer", "value_kind", "value_bytes", "value_lines", "value", "truncated")


@query(f"""WITH s AS (SELECT source, list({PATH} ORDER BY {PATH}) AS p FROM documents GROUP BY source) SELECT source, array_to_string(p[1:128], ' ') AS shown, len(p) > 128 AS more FROM s""")
def prompt_lists(spark, sf):
    """The first entries of each list, and whether there are more: F13."""
    lists = _t(spark, sf, "documents").groupBy("source").agg(F.sort_array(F.collect_list(F.expr(PATH))).alias("p"))
    entries = views.bounded_entries(F.col("p"))
    return lists.select("source", F.array_join(entries["entries"], " ").alias("shown"), entries["truncated"].alias("more"))


@query("""WITH RECURSIVE r AS (SELECT doc_id, source, n_chars AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
  b AS (SELECT doc_id, source, k, CAST(1 AS BIGINT) AS n, size AS total, CAST(0 AS BIGINT) AS batch FROM r WHERE k = 1 UNION ALL
    SELECT r.doc_id, r.source, r.k, CASE WHEN full_ THEN 1 ELSE n + 1 END, CASE WHEN full_ THEN size ELSE total + size END, CASE WHEN full_ THEN batch + 1 ELSE batch END
    FROM (SELECT b.n, b.total, b.batch, b.source AS s, b.k AS at FROM b) x JOIN r ON r.source = x.s AND r.k = x.at + 1, LATERAL (SELECT x.n = 32 OR x.total + r.size > 60000 AS full_))
  SELECT doc_id, batch FROM b""")
def source_batches(spark, sf):
    """Batches by count and bytes: E03."""
    from .plans import ranks

    return ranks.greedy_batches(_t(spark, sf, "documents").select("doc_id", "source", "n_chars"), "source", "doc_id", "n_chars", 32, 60_000).select("doc_id", "batch")
