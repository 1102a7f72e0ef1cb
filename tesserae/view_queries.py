"""More driver queries: trees and views, chunks, packs, inventories, reports; each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .functions import web as W
from .operators import changes, inventory, packs, reports, retrieve, views
from .plans.graph import written
from .queries import DOCS, FACTS, PATH, _docs, _facts, _t, query
from .sources import git

# The old tree holds all documents; in the new one each path of a source has the text of the next document,
# so the last one's path goes, equal texts move, and benchmark items come in.
TREES = f"""d AS (SELECT doc_id, source, {PATH} AS path, sha256(text) AS blob FROM documents),
  old AS (SELECT path, blob FROM d), new AS (SELECT path, nxt AS blob FROM (SELECT path, lead(blob) OVER (PARTITION BY source ORDER BY doc_id) AS nxt FROM d) WHERE nxt IS NOT NULL
    UNION ALL SELECT 'bench/' || item_id || '.txt', sha256(text) FROM benchmark),
  diff AS (SELECT coalesce(old.path, new.path) AS path, old.blob AS old_blob, new.blob AS new_blob,
    CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM old FULL JOIN new ON old.path = new.path WHERE old.blob IS DISTINCT FROM new.blob)"""


def _trees(spark, sf) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    path = F.concat_ws("", "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))  # SQL's concat leaves nulls out, and its order has them last
    d = _t(spark, sf, "documents").select("doc_id", "source", path.alias("path"), F.sha2("text", 256).alias("blob"))
    nxt = d.select("path", F.lead("blob").over(Window.partitionBy("source").orderBy(F.asc_nulls_last("doc_id"))).alias("blob")).where("blob is not null")
    items = _t(spark, sf, "benchmark").select(F.concat(F.lit("bench/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("path"), F.sha2("text", 256).alias("blob"))
    moded = lambda x: x.select("path", "blob", F.lit("100644").alias("mode"))
    return moded(d), moded(nxt.unionByName(items))


@query(f"WITH {TREES} SELECT path, status, old_blob, new_blob FROM diff")
def tree_diff(spark, sf):
    """Changed paths of two trees: C14, M15."""
    return views.tree_diff(*_trees(spark, sf), renames=False).select("path", "status", "old_blob", "new_blob")


@query(f"""WITH {TREES}, gone AS (SELECT path, old_blob AS b, row_number() OVER (PARTITION BY old_blob ORDER BY path) AS k FROM diff WHERE status = 'deleted'),
  come AS (SELECT path, new_blob AS b, row_number() OVER (PARTITION BY new_blob ORDER BY path) AS k FROM diff WHERE status = 'added'),
  moved AS (SELECT come.path AS path, gone.path AS old_path FROM come JOIN gone USING (b, k))
  SELECT path, old_path, 'renamed' AS status FROM moved UNION ALL
  SELECT path, NULL, status FROM diff WHERE path NOT IN (SELECT path FROM moved) AND path NOT IN (SELECT old_path FROM moved)""")
def tree_renames(spark, sf):
    """The same with exact renames: C14, M15."""
    return views.tree_diff(*_trees(spark, sf)).select("path", "old_path", "status")


@query(f"WITH {TREES} SELECT path, CASE status WHEN 'added' THEN 'A' WHEN 'deleted' THEN 'D' ELSE 'M' END AS status FROM diff")
def tree_status(spark, sf):
    """A, D and M of each path, renames as two: C16, M01."""
    old, new = _trees(spark, sf)
    blobs = spark.createDataFrame([], "blob string, size bigint, data binary")
    return views.View.of("staged", {"head": old, "index": new}, blobs).status()


@query(f"WITH {TREES} SELECT path, status, old_blob, new_blob FROM diff")
def pruned_tree_diff(spark, sf):
    """The same as tree_diff from directories, following only those that differ: C14."""
    from .plans import graph

    trees = _trees(spark, sf)
    key = lambda c: F.coalesce(F.sha1(c), F.lit("0" * 40))  # noqa: E731  # a null text has a place in the tree, too
    sides = [graph.tree_objects(d.withColumn("blob", key("blob"))) for d in trees]
    roots = [next((r.tree for r in s.where("dir = '.'").select("tree").take(1)), None) for s in sides]
    entries = written(sides[0].unionByName(sides[1]).select("tree", "name", "mode", "child").distinct())
    found = views.pruned_diff(entries, *roots, renames=False).select("path", "status", F.col("old_blob").alias("old_key"), F.col("new_blob").alias("new_key"))
    for d, s in zip(trees, ("old", "new"), strict=True):
        names = written(d.select("path", F.col("blob").alias(f"{s}_blob")))
        found = found.join(names.withColumn(f"{s}_key", key(f"{s}_blob")), ["path", f"{s}_key"], "left")
    return found.where("not (old_blob <=> new_blob)").select("path", "status", "old_blob", "new_blob")


_SHARES = r"""side AS (SELECT 'a' || doc_id AS b, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS x FROM documents WHERE text IS NOT NULL UNION ALL
    SELECT 'b' || doc_id, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') || chr(10) || 'edited' FROM documents WHERE text IS NOT NULL),
  blk AS (SELECT b, strlen(x) AS size, k, sum(strlen(k)) AS bytes FROM (SELECT b, x, unnest(regexp_extract_all(x, '[^\n]{0,63}\n|[^\n]{1,64}')) AS k FROM side) GROUP BY ALL)
  SELECT a.b AS "from", c.b AS "to", CAST(sum(least(a.bytes, c.bytes)) AS BIGINT) AS shared, CAST(greatest(a.size, c.size) AS BIGINT) AS size
  FROM blk a JOIN blk c USING (k) WHERE a.b LIKE 'a%' AND c.b LIKE 'b%' GROUP BY a.b, c.b, greatest(a.size, c.size) HAVING sum(least(a.bytes, c.bytes)) * 99 >= greatest(a.size, c.size) * 59"""


@query(f"WITH {_SHARES}")
def similar_contents(spark, sf):
    """Contents that an edit, or another document, shares enough with to be a rename: C14."""
    from .operators import renames

    d = _t(spark, sf, "documents").where("text is not null").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "?").alias("x"))
    side = lambda n, c: d.select(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias("blob"), F.encode(c, "UTF-8").alias("data"))
    return renames.similar(side("a", F.col("x")), side("b", F.concat("x", F.lit("\nedited")))).select("from", "to", "shared", F.col("size").cast("bigint").alias("size"))


# Each text gets one more line, so the counts are known: a text without a final line end changes its last line too.
@query(f"""WITH {DOCS}, t AS (SELECT path, min(text) AS text FROM docs GROUP BY path)
  SELECT path, CAST(CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN 1 ELSE 2 END AS BIGINT) AS adds, CAST(CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN 0 ELSE 1 END AS BIGINT) AS deletes FROM t WHERE instr(text, chr(0)) = 0""")
def diff_stats(spark, sf):
    """Added and deleted lines by unified diffs of whole texts: M13, M16, L09, L10."""
    view = _appended(spark, sf)
    return view.stats().where("not is_binary").select("path", "adds", "deletes")


def _appended(spark, sf) -> views.View:
    docs = _docs(spark, sf).where("text is not null").groupBy("path").agg(F.min("text").alias("text"))
    more = F.concat("text", F.when((F.col("text") == "") | F.col("text").endswith("\n"), "").otherwise("\n"), F.lit("one more line\n"))
    side = lambda c: docs.select("path", F.lit("100644").alias("mode"), F.sha2(c, 256).alias("blob"), F.encode(c, "UTF-8").alias("data"))
    old, new = side(F.col("text")), side(more)
    blobs = old.unionByName(new).select("blob", F.octet_length("data").alias("size"), "data").dropDuplicates(["blob"])
    return views.View(old.drop("data"), new.drop("data"), blobs)


@query(f"WITH {DOCS} SELECT source || '/' || lang || '/' || doc_id || '.md' AS path, '100644' AS mode, sha256(text) AS blob FROM documents")
def flat_tree(spark, sf):
    """A tree of nested directories flattened from its entries: A03, A06."""
    d = _t(spark, sf, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("blob"))
    entry = lambda tree, name, mode, child: d.select(tree.alias("tree"), name.alias("name"), F.lit(mode).alias("mode"), child.alias("child")).distinct()
    top, sub = F.concat(F.lit("t:"), "source"), F.concat(F.lit("t:"), "source", F.lit("/"), "lang")
    entries = (
        entry(F.lit("root"), F.col("source"), git.DIRECTORY, top).unionByName(entry(top, F.col("lang"), git.DIRECTORY, sub))
        .unionByName(entry(sub, F.concat(F.col("doc_id").cast("string"), F.lit(".md")), "100644", F.col("blob"))))
    return git.flattened(entries, spark.createDataFrame([("root",)], "root string")).select("path", "mode", "blob")


@query(f"WITH {FACTS} SELECT count(*) AS paths, CAST(sum(adds) AS BIGINT) AS adds, CAST(sum(deletes) AS BIGINT) AS deletes, (SELECT array_to_string(list(path ORDER BY path)[1:5], ',') FROM facts) AS sample_paths FROM facts")
def file_set_summary(spark, sf):
    """Number, sums and first paths of a change: D28."""
    return views.file_set_summary(_facts(spark, sf)).withColumn("sample_paths", F.array_join("sample_paths", ","))


@query(f"WITH {FACTS} SELECT path, CAST(sum(adds + deletes) AS BIGINT) AS churn FROM facts GROUP BY path ORDER BY churn DESC, path LIMIT 5")
def focus_paths(spark, sf):
    """The most changed paths that a diff doesn't mention: F12."""
    sums = _facts(spark, sf).groupBy("path").agg(F.sum("adds").alias("adds"), F.sum("deletes").alias("deletes"))
    return views.focus_paths(sums, "diff --git a/none b/none")


@query("""SELECT doc_id, lang = 'en' AS generated, CASE WHEN lang = 'en' THEN 'go-generated-comment' ELSE '' END AS rule FROM documents WHERE text IS NOT NULL""")
def generated_marks(spark, sf):
    """Facts with the mark of generated code before or after the first line of code: B20, M25."""
    mark = "// Code generated by a tool. DO NOT EDIT.\n"
    head = F.when(F.col("lang") == "en", F.concat(F.lit("/* a\nblock */\n\n" + mark), F.col("text"))).otherwise(F.concat(F.lit("package x\n" + mark), F.col("text")))
    rows = _t(spark, sf, "documents").where("text is not null").select(F.concat(F.col("doc_id").cast("string"), F.lit(".go")).alias("path"), "doc_id", F.lit("").alias("status"), head.alias("header"))
    return views.normalised_facts(rows).select("doc_id", "generated", "rule")


# The text is a raw string, in which nothing is a declaration and no bracket counts.
@query("""WITH t AS (SELECT doc_id, string_split('package p' || chr(10) || chr(10) || 'func F' || doc_id || '() {' || chr(10) || '_ = `' || replace(replace(text, chr(13) || chr(10), chr(10)), '`', '') || '`' || chr(10) || '}', chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
  w AS (SELECT doc_id, len(ls) AS n, unnest(range(3, CAST(greatest(len(ls) - 20, 3) AS BIGINT) + 1, 60)) AS st FROM t)
  SELECT doc_id, CAST(st AS INTEGER) AS start_line, CAST(least(st + 79, n) AS INTEGER) AS end_line, 'function' AS symbol_type, 'F' || doc_id AS symbol FROM w
  UNION ALL SELECT doc_id, 1, 2, NULL, NULL FROM t""")
def symbol_windows(spark, sf):
    """Windows over declarations and over what they leave: E02, M27."""
    code = F.concat(F.lit("package p\n\nfunc F"), F.col("doc_id").cast("string"), F.lit("() {\n_ = `"), F.replace("text", F.lit("`"), F.lit("")), F.lit("`\n}\n"))
    docs = _t(spark, sf, "documents").where("text is not null").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".go")).alias("path"), code.alias("text"))
    return retrieve.chunks(docs).select("doc_id", "start_line", "end_line", "symbol_type", "symbol")


@query("""WITH l AS (SELECT doc_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), chr(10) || '$', ''), chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
  u AS (SELECT doc_id, i, trim(regexp_replace(l, '\\s+', ' ', 'g')) <> '' AS full_, CASE WHEN i < 2 THEN 0 ELSE 1 END AS part FROM l WHERE i NOT IN (2, 3))
  SELECT doc_id, CAST(min(CASE WHEN full_ THEN i END) AS INTEGER) AS start_line, CAST(max(i) AS INTEGER) AS end_line FROM u GROUP BY doc_id, part HAVING bool_or(full_)""")
def uncovered_lines(spark, sf):
    """Runs of lines that spans leave uncovered: E02."""
    docs = _t(spark, sf, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), "doc_id", "text")
    covered = docs.select("path", F.lit(2).alias("start"), F.lit(3).alias("end"))
    return retrieve.gaps(docs, covered).select(F.col("path").cast("bigint").alias("doc_id"), F.col("start").alias("start_line"), F.col("end").alias("end_line"))


@query(f"""WITH {DOCS}, i AS (SELECT doc_id, left('path: ' || path || chr(10) || 'language: markdown' || chr(10) || chr(10) ||
    array_to_string([left(l, 4000) FOR l IN string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), chr(10) || '$', ''), chr(10))], chr(10)), 32000) AS t FROM docs WHERE text IS NOT NULL)
  SELECT doc_id, sha256(t) AS hash, CAST(strlen(t) AS BIGINT) AS bytes FROM i""")
def embedding_inputs(spark, sf):
    """Hash and size of what a provider gets for whole texts: I06, I47, M28."""
    rows = _docs(spark, sf).where("text is not null").select("doc_id", "path", F.lit(None).cast("string").alias("symbol_type"), F.lit(None).cast("string").alias("symbol"), F.col("text").alias("body"))
    return reports.input_chunks(rows).select("doc_id", F.col("embedding_input_hash").alias("hash"), F.col("embedding_input_bytes").alias("bytes"))


def _vectors(spark, sf) -> DataFrame:
    data = W.float_bytes(F.col("embedding"))
    rows = _t(spark, sf, "embeddings").where("embedding is not null").select("vec_id", "label", F.unhex(F.sha2(F.col("vec_id").cast("string"), 256)).alias("embedding_key"), data.alias("data"))
    return rows.withColumn("vector_digest", F.unhex(F.sha2("data", 256)))


@query("""SELECT key, CAST((row_number() OVER (ORDER BY key) - 1) % 100 AS INTEGER) AS slot, 64 AS dimensions FROM (SELECT DISTINCT sha256(CAST(vec_id AS VARCHAR)) AS key FROM embeddings WHERE embedding IS NOT NULL)""")
def pack_entries(spark, sf):
    """Vectors packed by key, encoded, decoded and validated: A19, A20, A44, E04, F10."""
    rows = _vectors(spark, sf).select("embedding_key", "vector_digest", "data")
    made = packs.packed(rows, 64, b"\0" * 32, size=100 * 4 * 64)
    return packs.entries(made).select(F.lower(F.hex("embedding_key")).alias("key"), "slot", "dimensions")


@query("""WITH c AS (SELECT DISTINCT sha256(CAST(vec_id AS VARCHAR)) AS vector_key, vec_id FROM embeddings), live AS (SELECT vector_key FROM c JOIN (SELECT DISTINCT doc_id FROM documents) ON doc_id = vec_id)
  SELECT vector_key, CAST((row_number() OVER (ORDER BY vector_key) - 1) * 256 AS BIGINT) AS "offset" FROM live""")
def compacted_store(spark, sf):
    """A store without what no index names, with new offsets: M39, C27, D22, E05."""
    catalog, live = _store(spark, sf)
    return packs.compacted(catalog, catalog.select("vector_key"), live)[0].select("vector_key", "offset")


@query("""WITH c AS (SELECT DISTINCT vec_id FROM embeddings), l AS (SELECT vec_id FROM c JOIN (SELECT DISTINCT doc_id FROM documents) ON doc_id = vec_id)
  SELECT (SELECT count(*) FROM c) AS before, (SELECT count(*) FROM l) AS after, CAST(((SELECT count(*) FROM c) - (SELECT count(*) FROM l)) * 256 AS BIGINT) AS bytes_removed, (SELECT count(*) FROM c) = (SELECT count(*) FROM l) AS already_compact""")
def clean_up_summary(spark, sf):
    """What a clean-up removes: D23, M39."""
    catalog, live = _store(spark, sf)
    return packs.compacted(catalog, catalog.select("vector_key"), live)[2]


def _store(spark, sf) -> tuple[DataFrame, DataFrame]:
    catalog = _t(spark, sf, "embeddings").select(F.sha2(F.col("vec_id").cast("string"), 256).alias("vector_key"), F.lit(64).alias("dimensions"), F.col("vec_id").alias("checksum")).distinct().withColumn("offset", F.lit(0).cast("long"))
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("checksum")).distinct()
    return catalog, catalog.join(docs, "checksum", "left_semi").select("vector_key", "dimensions", "checksum")


@query("""WITH l AS (SELECT source AS origin, lang AS revision, doc_id AS chunk_id, sha256(text) AS d FROM documents), r AS (SELECT source, lang, doc_id, sha256(text) FROM documents UNION ALL SELECT 'bench', 'x', item_id, sha256(text) FROM benchmark)
  SELECT DISTINCT origin, revision, chunk_id, d AS vector_digest FROM (SELECT * FROM l UNION ALL SELECT * FROM r)""")
def reconciled_snapshots(spark, sf):
    """Snapshots of two sides as one: G04, G05, G13."""
    row = lambda d, o, r, i: d.select(o.alias("origin"), r.alias("revision"), i.alias("chunk_id"), F.sha2("text", 256).alias("vector_digest"), F.lit("p").alias("pack"))
    docs = row(_t(spark, sf, "documents"), F.col("source"), F.col("lang"), F.col("doc_id"))
    bench = row(_t(spark, sf, "benchmark"), F.lit("bench"), F.lit("x"), F.col("item_id"))
    return packs.reconciled(docs, docs.unionByName(bench)).drop("pack")


@query("""SELECT sha256(text) AS embedding_input_hash, printf('i%09d', CAST(min(doc_id) AS BIGINT)) AS first_index FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def reused_across_indexes(spark, sf):
    """Inputs that an index takes over from others, one vector of each: C05."""
    rows = _t(spark, sf, "documents").where("text is not null").select(
        F.format_string("i%09d", F.col("doc_id")).alias("index"), F.sha2("text", 256).alias("embedding_input_hash"), F.lit("m").alias("embedding_model"), F.lit(1).alias("dimensions"), F.array(F.col("doc_id").cast("double")).alias("vector"))
    got = packs.exact_reuse(rows, rows, "m", 1, "target")
    return got.select("embedding_input_hash", F.format_string("i%09d", F.element_at("vector", 1).cast("long")).alias("first_index"))


@query("""SELECT 'whole' AS part, count(DISTINCT sha256(text)) FILTER (WHERE lang = 'en' AND doc_id % 5 <> 0) AS kept, bool_and(lang = 'en' AND doc_id % 5 <> 0) AS every FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'fitting', count(DISTINCT sha256(text)), true FROM documents WHERE text IS NOT NULL AND lang = 'en' AND doc_id % 5 <> 0""")
def compatible_subset(spark, sf):
    """Distinct records of a model and dimension among others, and whether all are: G06, B12."""
    model, dims = F.when(F.col("lang") == "en", "m").otherwise("n"), F.when(F.col("doc_id") % 5 == 0, 2).otherwise(1)
    rows = _t(spark, sf, "documents").where("text is not null").select("lang", "doc_id", F.sha2("text", 256).alias("embedding_input_hash"), model.alias("embedding_model"), dims.alias("dimensions"), F.array(F.lit(1.0)).alias("vector"))
    out = None
    for part, own in (("whole", rows), ("fitting", rows.where("lang = 'en' and doc_id % 5 <> 0"))):
        kept, every = packs.compatible_rows(own, "m", 1, "embedding_input_hash")
        row = kept.agg(F.count("*").alias("kept")).select(F.lit(part).alias("part"), "kept", F.lit(every).alias("every"))
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT DISTINCT coalesce(lang, '') || ':' || coalesce(source, '') AS key FROM documents")
def record_keys(spark, sf):
    """Distinct record keys in byte order: F09, G14."""
    return packs.key_set(_t(spark, sf, "documents"), "lang", "source")


@query("""SELECT doc_id, sha256(source) AS o, source || '|' || lang AS state FROM documents WHERE source <> 'src2' OR lang <> 'en'""")
def snapshot_metadata(spark, sf):
    """Snapshots that aren't the target's: M30, M45."""
    rows = _t(spark, sf, "documents").select("doc_id", F.lit(2).alias("version"), F.col("source").alias("origin"), F.col("lang").alias("revision"))
    bad = packs.metadata_errors(rows, {"origin": "src2", "revision": "en"}).where(F.size("errors") > 0)
    path = packs.sync_path(F.col("origin"), F.col("revision"), F.lit("m"), F.lit(1))
    return bad.select("doc_id", F.split(path, "/")[1].alias("o"), F.concat_ws("|", "origin", "revision").alias("state"))


@query("""SELECT 'extra/' || doc_id AS path FROM documents UNION ALL SELECT 'indexes/' || sha256(source) || '/' || left(sha256(text), 16) || '.json' FROM documents WHERE text IS NOT NULL""")
def tree_errors(spark, sf):
    """Paths that a sync tree doesn't allow among those that it does: V11."""
    d = _t(spark, sf, "documents").where("text is not null")
    sha, text = F.sha2("source", 256), F.sha2("text", 256)
    path = F.explode(F.array(
        F.concat_ws("/", F.lit("indexes"), sha, F.substring(text, 1, 40), F.concat(text, F.lit(".json"))), F.concat_ws("/", F.lit("packs"), sha, F.concat(text, F.lit(".pack"))),
        F.concat(F.lit("extra/"), F.col("doc_id").cast("string")), F.concat_ws("/", F.lit("indexes"), sha, F.concat(F.substring(text, 1, 16), F.lit(".json")))))
    return packs.tree_errors(d.select(path.alias("path"), F.lit("file").alias("kind")), 2).select("path")


@query(f"WITH {DOCS}, e AS (SELECT regexp_replace(path, '/[0-9]+[.]md$', '') AS dir, path FROM docs) SELECT dir, count(DISTINCT path) AS files, count(*) AS chunks, split_part(dir, '/', 3) AS filters FROM (SELECT 'revs/' || replace(dir, '/', '/scope-') AS dir, path FROM e) GROUP BY dir")
def index_inventory(spark, sf):
    """Indexes with their files, chunks and filters: A29, B36, D17."""
    e = _docs(spark, sf).select(F.concat(F.lit("revs/"), "source", F.lit("/scope-"), "lang").alias("dir"), "path")
    manifests = e.select("dir").distinct().withColumns({"mode": F.lit("revision"), "resolved_rev": F.lit("r")})
    return inventory.indexes(manifests, e).select("dir", "files", "chunks", F.array_join("filters", ",").alias("filters"))


@query("SELECT DISTINCT source || '/a/' || lang || '_x.go' AS path FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def indexed_files(spark, sf):
    """Distinct paths of an index without tests: A31, B05, D17."""
    d = _t(spark, sf, "documents")
    both = d.select(F.concat("source", F.lit("/a/"), "lang", F.lit("_x.go")).alias("path")).unionByName(d.select(F.concat("source", F.lit("/tests/"), "lang", F.lit(".go")).alias("path"))).unionByName(d.select(F.concat("source", F.lit("/a/"), "lang", F.lit("_test.go")).alias("path")))
    return inventory.indexed_files(both, no_tests=True)


@query("SELECT source, count(DISTINCT lang) AS n_paths, string_agg(DISTINCT lang, ',' ORDER BY lang) AS paths FROM documents GROUP BY source")
def path_lists(spark, sf):
    """Distinct paths of each group, counted and sorted: D17, F14."""
    got = inventory.path_list(_t(spark, sf, "documents").select("source", F.col("lang").alias("path")), "source")
    return got.withColumn("paths", F.array_join("paths", ","))


@query("""SELECT user_id, count(*) FILTER (WHERE ts > m - INTERVAL 30 SECONDS) AS live FROM events, (SELECT max(ts) AS m FROM events) GROUP BY user_id""")
def live_intents(spark, sf):
    """Fresh heartbeats of each user at the last one's time: B25, D34."""
    e = _t(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("heartbeat_at"))
    now = e.agg(F.max("heartbeat_at")).first()[0]
    return inventory.live_intents(e, F.lit(now), "user_id")


@query("""SELECT user_id AS batch FROM events, (SELECT max(ts) AS m FROM events) GROUP BY user_id HAVING bool_and(event_type IN ('view', 'click') OR ts <= m - INTERVAL 30 SECONDS)""")
def finished_batches(spark, sf):
    """Batches whose items are consumed or whose owners are stale: J05."""
    e = _t(spark, sf, "events").select(F.col("user_id").alias("batch"), F.col("event_type").isin("view", "click").alias("consumed"), F.col("ts").cast("timestamp").alias("heartbeat_at"))
    return inventory.finished_batches(e, F.lit(e.agg(F.max("heartbeat_at")).first()[0]))


@query("""SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq, event_type AS kind, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS "at" FROM events""")
def event_sequences(spark, sf):
    """Events with a gapless number and their time in UTC: I75, J06."""
    e = _t(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("ord"), F.col("event_type").alias("kind"), F.col("props").alias("value"))
    return inventory.event_stream(e, "user_id").select("user_id", "seq", "kind", "at")


@query("""SELECT user_id AS task, arg_min(event_type, ROW(ts, event_id)) AS kind FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id""")
def terminal_events(spark, sf):
    """The one terminal event of each task: A54."""
    e = _t(spark, sf, "events").where("event_type in ('purchase', 'error')").select(F.col("user_id").alias("task"), F.col("event_type").alias("kind"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    tasks = e.select("task").distinct().withColumn("terminal", F.lit(None).cast(f"struct<kind:string,at:{dict(e.dtypes)['at']}>"))
    return inventory.terminal(tasks, e).select("task", F.col("terminal.kind").alias("kind"))


@query("SELECT user_id, CAST(epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS BIGINT) AS elapsed FROM events GROUP BY user_id")
def elapsed_times(spark, sf):
    """Milliseconds between the first and the last event: I75."""
    e = _t(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return e.select("user_id", inventory.elapsed_ms(F.col("a"), F.col("b")).alias("elapsed"))


@query("""SELECT event_id, CAST(strlen(props) AS BIGINT) AS bytes, sha256(props) AS sha256 FROM events""")
def payload_identities(spark, sf):
    """Size and hash of payloads: M38."""
    p = reports.payload_identity(F.col("props"))
    return _t(spark, sf, "events").select("event_id", p.alias("p")).select("event_id", "p.bytes", "p.sha256")


@query("""SELECT event_id, '{"a":{"b":' || replace(props, ' ', '') || '},"c":"x"}' AS expanded FROM events""")
def expanded_json(spark, sf):
    """Strings within JSON expanded at any depth: I64."""
    inner = F.to_json(F.struct(F.col("props").alias("b")))
    return _t(spark, sf, "events").select("event_id", reports.expanded_json(F.to_json(F.struct(inner.alias("a"), F.lit("x").alias("c")))).alias("expanded"))


@query("""SELECT event_id, strftime(ts, '%H:%M:%S.%g') || ' ' || event_type || ' k=' || json_extract_string(props, '$.k') AS line FROM events""")
def console_lines(spark, sf):
    """Events as lines of key=value: M50."""
    return _t(spark, sf, "events").select("event_id", reports.console_line(F.col("ts"), F.col("event_type"), F.col("props")).alias("line"))


@query(f"""WITH {DOCS}, f AS (SELECT 'AGENTS.md' AS path UNION SELECT DISTINCT source || '/AGENTS.md' FROM documents UNION SELECT DISTINCT source || '/' || lang || '/AGENTS.override.md' FROM documents) SELECT path FROM f WHERE path IS NOT NULL""")
def guidance_files(spark, sf):
    """Guidance of all paths, the first file of a directory once each: C22."""
    docs = _docs(spark, sf)
    files = lambda *c: docs.select(F.concat_ws("/", *c).alias("path"), F.lit("x").alias("text")).distinct()
    every = files(F.lit("AGENTS.md")).unionByName(files("source", F.lit("AGENTS.md"))).unionByName(files("source", "lang", F.lit("AGENTS.override.md"))).unionByName(files("source", "lang", F.lit("AGENTS.md"))).unionByName(files("source", F.lit("CLAUDE.md")))
    return reports.guidance(docs.select(F.col("doc_id").alias("ord"), "path"), every).select("path")


@query("SELECT DISTINCT source AS root, './' || lang AS package FROM documents")
def affected_packages(spark, sf):
    """Module and package of changed source files: D30, M54."""
    docs = _t(spark, sf, "documents")
    changed = docs.select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".go"))).alias("path"))
    roots = reports.module_roots(changed.unionByName(docs.select(F.concat_ws("/", "source", F.lit("go.mod")).alias("path")).distinct()))
    return reports.affected_packages(changed, roots)


@query(r"""WITH s AS (SELECT conv_id, turn, string_split(text, chr(10))[1] AS s FROM conversations)
  SELECT conv_id, turn, instr(s, ':') > 0 AND regexp_matches(trim(split_part(s, ':', 1)), '^[a-z]+(\([^)]+\))?!?$') AS conventional,
    NOT (instr(s, ':') > 0 AND regexp_matches(trim(split_part(s, ':', 1)), '^[a-z]+(\([^)]+\))?!?$')) AND regexp_matches(s, '^[A-Z]') AS title, regexp_matches(lower(s), '^chore[(:]') AS chore FROM s""")
def summary_styles(spark, sf):
    """Styles of first lines: B23, B24, D36."""
    s = F.substring_index("text", "\n", 1)
    return _t(spark, sf, "conversations").select("conv_id", "turn", T.is_conventional(s).alias("conventional"), T.is_title_case(s).alias("title"), T.is_chore(s).alias("chore"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 1 OR doc_id % 5 = 2 THEN NULL WHEN doc_id % 5 = 3 THEN lang || '/' || doc_id || '.md' ELSE source || '/' || lang || '/' || doc_id || '.md' END AS clean,
  CASE WHEN doc_id % 5 = 0 THEN '.' ELSE lang END AS tool FROM documents""")
def clean_paths(spark, sf):
    """Paths cleaned, absolute ones and those that leave the root as null: B29, B30."""
    d, kind = F.concat(F.col("doc_id").cast("string"), F.lit(".md")), F.col("doc_id") % 5
    path = (
        F.when(kind == 0, F.concat(F.lit("./"), "source", F.lit("//"), "lang", F.lit("/x/../"), d)).when(kind == 1, F.concat("source", F.lit("/../../"), "lang", F.lit("/"), d)).when(kind == 2, F.concat(F.lit("/"), "source", F.lit("/"), d))
        .when(kind == 3, F.concat("source", F.lit("/../"), "lang", F.lit("/./"), d)).otherwise(F.concat("source", F.lit("\\"), "lang", F.lit("\\"), d)))
    return _t(spark, sf, "documents").select("doc_id", reports.clean_path(path).alias("clean"), reports.tool_path(F.when(kind == 0, " ").otherwise(F.col("lang"))).alias("tool"))


@query("""SELECT p_partkey, 'p/' || p_partkey || '.go' AS path, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS message, CASE WHEN p_size < 10 THEN 'line must be positive' ELSE '' END AS errors FROM part""")
def diagnostics(spark, sf):
    """Diagnostics with clean paths and lines: M33, M53."""
    p = F.col("p_partkey").cast("string")
    rows = _t(spark, sf, "part").select("p_partkey", F.concat(F.lit("./p//"), p, F.lit(".go")).alias("path"), (F.col("p_size") - 9).alias("line"), F.lit(0).alias("column"), F.lit("").alias("code"), F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("\n\t"))).alias("message"))
    return reports.normalised_diagnostics(rows).select("p_partkey", "path", "message", F.array_join("errors", ",").alias("errors"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'findings result requires diagnostics or an omitted count' WHEN 'O' THEN '' ELSE 'skipped result requires only a normalised reason' END AS errors FROM orders""")
def check_results(spark, sf):
    """Errors of check results: V08."""
    status = F.when(F.col("o_orderstatus") == "F", "findings").when(F.col("o_orderstatus") == "O", "pass").otherwise("skipped")
    none = F.array().cast("array<struct<path:string,line:int,column:int,code:string,message:string>>")
    r = F.struct(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("name"), status.alias("status"), none.alias("diagnostics"), F.lit(0).alias("omitted"), F.lit("").alias("reason"), F.lit("").alias("error"))
    return _t(spark, sf, "orders").select("o_orderkey", F.array_join(reports.check_result_errors(r), ",").alias("errors"))


CALLS = """c AS (SELECT conv_id AS thread, turn AS ord, CASE role WHEN 'assistant' THEN 'function_call_output' ELSE 'function_call' END AS type, CASE role WHEN 'assistant' THEN turn - 1 ELSE turn END AS call FROM conversations)"""


def _calls(spark, sf) -> DataFrame:
    answer = F.col("role") == "assistant"
    return _t(spark, sf, "conversations").select(
        F.col("conv_id").alias("thread"), F.col("turn").alias("ord"), F.when(answer, "function_call_output").otherwise("function_call").alias("type"),
        F.when(answer, F.col("turn") - 1).otherwise(F.col("turn")).cast("string").alias("call_id"), F.lit("f").alias("name"), F.col("text").alias("content"))


@query(f"""WITH {CALLS} SELECT thread, type, CAST(call AS VARCHAR) AS call_id FROM c UNION ALL
  SELECT thread, 'function_call_output', CAST(call AS VARCHAR) FROM c WHERE type = 'function_call' AND NOT EXISTS (SELECT 1 FROM c x WHERE x.thread = c.thread AND x.call = c.call AND x.type <> c.type)""")
def completed_calls(spark, sf):
    """Conversations with an output for each call: M36, C28."""
    return reports.completed_calls(_calls(spark, sf)).select("thread", "type", "call_id")


@query("""SELECT conv_id AS thread, turn AS ord, 'output without a call' AS error FROM conversations WHERE role = 'assistant'""")
def call_errors(spark, sf):
    """Outputs without a call before them: M36, V13."""
    late = F.when(F.col("type") == "function_call_output", F.concat("call_id", F.lit("x"))).otherwise(F.col("call_id"))
    return reports.call_errors(_calls(spark, sf).withColumn("call_id", late)).where("error = 'output without a call'")


@query("""SELECT r_regionkey AS id, '### Improvements' || chr(10) || chr(10) || string_agg('- **' || n_name || '**: adds ' || n_name || ' (#' || n_nationkey || ')' || chr(10) || '  - key ' || n_nationkey, chr(10) ORDER BY n_nationkey)
  || chr(10) || chr(10) || '### Full Changelog' || chr(10) || chr(10) || '- abcdef0 ' || min(r_name) AS markdown FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey""")
def release_markdown(spark, sf):
    """Release documents as Markdown: A56, M24."""
    n, r = _t(spark, sf, "nation"), _t(spark, sf, "region")
    key, ref = F.col("n_nationkey").cast("string"), "struct<type:string,value:string,url:string>"
    bullet = F.struct(F.col("n_name").alias("label"), F.concat(F.lit("adds "), "n_name").alias("summary"), F.array(F.struct(F.lit("pr").alias("type"), key.alias("value"), F.lit(None).cast("string").alias("url"))).alias("refs"),
                      F.array(F.struct(F.concat(F.lit("key "), key).alias("summary"), F.array().cast(f"array<{ref}>").alias("refs"))).alias("children"))
    docs = n.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", bullet.alias("b")))), lambda x: x["b"]).alias("bullets")).join(r, "r_regionkey")
    document = F.struct(F.array(F.struct(F.lit("Improvements").alias("heading"), F.col("bullets"))).alias("sections"))
    log = F.array(F.struct(F.lit("abcdef0123").alias("sha"), F.col("r_name").alias("summary"), F.lit("").alias("url")))
    none = F.array().cast("array<struct<heading:string,entries:array<struct<sha:string,summary:string,url:string>>>>")
    return docs.select(F.col("r_regionkey").alias("id"), reports.release_markdown(document, log, none).alias("markdown"))


@query("""SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'bullet has no refs' WHEN n_regionkey = 1 THEN 'invalid commit ref' WHEN n_regionkey = 2 THEN 'forbidden section heading' ELSE '' END AS errors FROM nation""")
def document_errors(spark, sf):
    """Errors of release documents: V05, V07."""
    k = F.col("n_regionkey")
    one = F.array(F.struct(F.lit("commit").alias("type"), F.when(k == 1, "xyz").otherwise("abcdef0").alias("value"), F.lit(None).cast("string").alias("url")))
    refs = F.when(k == 0, F.slice(one, 1, 0)).otherwise(one)
    bullet = F.struct(F.lit("").alias("label"), F.concat(F.lit("adds "), "n_name").alias("summary"), refs.alias("refs"), F.lit(None).cast(f"array<struct<summary:string,refs:{reports.REFS}>>").alias("children"))
    document = F.struct(F.array(F.struct(F.when(k == 2, "Other").otherwise("Security").alias("heading"), F.array(bullet).alias("bullets"))).alias("sections"))
    return _t(spark, sf, "nation").select("n_nationkey", F.array_join(reports.document_errors(document), ",").alias("errors"))


@query("""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://(?:[^@/?#]*@)?([^/:?#]*)', 1)) || '/' ||
  regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '^/+|/+$', '', 'g'), '\\.git$', '') AS identity FROM pages)
  SELECT page_id, sha256(identity) AS project, 'B/search/fs/' || left(sha256('r' || page_id), 16) AS dir FROM u""")
def project_ids(spark, sf):
    """Projects by their origin's identity, and folders of indexes: I52, I54, M52."""
    root = F.concat(F.lit("r"), F.col("page_id").cast("string"))
    where = inventory.index_dir("B", F.lit("filesystem"), root, F.lit(""), F.array(F.lit("a")))
    return _t(spark, sf, "pages").select("page_id", inventory.project_id(root, F.col("url")).alias("project"), where.alias("dir"))


@query("SELECT url AS remote, url || ' rev=' || left(sha256(html), 12) || chr(10) || '  d' || page_id || chr(10) AS text FROM pages")
def remote_listing(spark, sf):
    """Cached remotes by address as text: A30, A51."""
    rows = _t(spark, sf, "pages").select(F.col("url").alias("remote"), F.sha2("html", 256).alias("last_resolved_rev"), F.lit(None).cast("timestamp").alias("last_fetched_at"), F.concat(F.lit("d"), F.col("page_id").cast("string")).alias("dir"))
    return inventory.remote_lines(inventory.remotes(rows))


@query("SELECT count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS indexes, CAST(coalesce(sum(c_nationkey) FILTER (WHERE c_mktsegment = 'BUILDING'), 0) AS BIGINT) AS records, count(*) FILTER (WHERE c_mktsegment <> 'BUILDING') AS skipped FROM customer")
def sync_summary(spark, sf):
    """What was synchronised and what was left out: A32, D35."""
    m = _t(spark, sf, "customer").select(F.when(F.col("c_mktsegment") == "BUILDING", "revision").otherwise("filesystem").alias("mode"), F.lit("o").alias("origin_identity"), F.lit("r").alias("resolved_rev"), F.col("c_nationkey").alias("records"))
    return packs.sync_summary(inventory.sync_targets(m).withColumn("synced", ~F.col("skipped")))


@query("""WITH l AS (SELECT c_custkey, printf('catalog-%020d.json', c_custkey) AS name FROM customer) SELECT name, c_custkey >= (SELECT max(c_custkey) - 1 FROM l) AS kept FROM l""")
def catalog_generations(spark, sf):
    """Catalog files of the newest generations, among files of other names: M39, M46."""
    names = _t(spark, sf, "customer").select(packs.catalog_name(F.col("c_custkey")).alias("name"))
    return packs.newest(names.unionByName(_t(spark, sf, "supplier").select(F.col("s_name").alias("name")))).select("name", "kept")


@query("""WITH r AS (SELECT source AS path, min(sha256(text)) AS old, max(sha256(text)) AS new FROM documents GROUP BY source) SELECT path, old, new, 'modified' AS status FROM r WHERE old <> new""")
def gitlink_range(spark, sf):
    """Submodules whose commit differs between two revisions: C13, M19."""
    d = _t(spark, sf, "documents").groupBy(F.col("source").alias("path")).agg(F.min(F.sha2("text", 256)).alias("a"), F.max(F.sha2("text", 256)).alias("b"))
    side = lambda c: d.select("path", F.col(c).alias("sha"))
    return views.gitlink_range(side("a"), side("b"))


@query("""WITH RECURSIVE up AS (SELECT n_nationkey AS n, n_nationkey AS node, 0 AS distance FROM nation UNION ALL SELECT n, node - 1, distance + 1 FROM up WHERE node > 0),
  old AS (SELECT n_nationkey AS n, n_nationkey // 2 AS o FROM nation)
  SELECT 'p' || up.n AS path, CAST(node AS VARCHAR) AS sha, 'nation ' || node AS summary, CAST(distance AS INTEGER) AS distance FROM up JOIN old USING (n) WHERE node > o""")
def submodule_history(spark, sf):
    """Commits between the two ends of moved submodules: H03, M13."""
    n = _t(spark, sf, "nation")
    key = lambda c: c.cast("string")
    k = F.col("n_nationkey")
    edges = n.select(key(k).alias("sha"), F.when(k > 0, key(k - 1)).alias("parent"))
    moves = n.select(F.concat(F.lit("p"), key(k)).alias("path"), key(F.floor(k / 2)).alias("old"), key(k).alias("new"))
    return views.submodule_history(moves, n.select(key(k).alias("sha"), F.concat(F.lit("nation "), key(k)).alias("message")), written(edges))


@query("SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND text NOT LIKE '%' || chr(10) THEN 1 ELSE 0 END AS INTEGER) >= 5 AS fifth, text = '' OR strlen(text) <= 80 AS whole FROM documents WHERE text IS NOT NULL")
def line_coverage(spark, sf):
    """Whether texts have a fifth line, and fit a match: E15, I13."""
    d = _t(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", T.has_line(F.col("text"), F.lit(5)).alias("fifth"), (T.clipped_match(F.col("text"), 80) == F.col("text")).alias("whole"))


@query(f"WITH {FACTS} SELECT count(*) AS files, CAST(sum(CAST(generated AS INT)) AS BIGINT) AS generated_files, count(*) > 100 AND sum(CAST(generated AS INT)) * 100 >= count(*) * 80 AS heavy FROM facts")
def generated_heavy(spark, sf):
    """Whether a change is large and mostly generated: B22, M26."""
    over = changes.overview(_facts(spark, sf)).select("files", "generated_files")
    return over.withColumn("heavy", F.lit(not views.generated_heavy(over).isEmpty()))


@query("SELECT doc_id, CASE WHEN source = 'src1' THEN 'kept' ELSE 'new' END AS side FROM documents")
def migrated_rows(spark, sf):
    """A legacy store's rows moved into the identity's own, whose rows win: G12, G01."""
    d = _t(spark, sf, "documents")
    own = d.where("source = 'src1'").select("doc_id", F.lit("kept").alias("side"), F.lit(0).alias("ord"))
    return packs.migrated(d.select("doc_id", F.lit("new").alias("side"), F.lit(0).alias("ord")), own, "doc_id").select("doc_id", "side")


@query("SELECT DISTINCT lang AS diff_ref FROM documents UNION SELECT DISTINCT source FROM documents")
def artifact_refs(spark, sf):
    """Distinct references of facts: D06."""
    return views.artifacts(_t(spark, sf, "documents").select(F.col("lang").alias("diff_ref"), F.col("source").alias("content_ref"))).withColumnRenamed("ref", "diff_ref")


@query("""WITH k AS (SELECT DISTINCT source, lang FROM documents) SELECT source || '/' || lang AS path, source AS owner FROM k""")
def component_files(spark, sf):
    """Files of nested components under their prefixes: A11, B18, H05, M08."""
    d = _t(spark, sf, "documents").select("source", "lang").distinct()
    parts = views.components(d.select(F.lit("").alias("repo"), F.col("source").alias("path"), F.col("source").alias("child")).distinct())
    return views.component_files(d.select(F.col("source").alias("repo"), F.col("lang").alias("path")), parts).withColumnRenamed("repo", "owner")


@query("SELECT 'c' || c_custkey AS dir, floor(c_acctbal) >= 5000 AS built FROM customer WHERE floor(c_acctbal) >= 0")
def confirmations(spark, sf):
    """Indexes confirmed since a query began, and whether they were built later: B26, J11."""
    at = F.timestamp_seconds(F.floor("c_acctbal"))
    c = _t(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("dir"), at.alias("confirmed_at"))
    earlier = c.withColumn("confirmed_at", F.col("confirmed_at") - F.expr("interval 1 hour"))  # the last one counts
    return inventory.confirmed(c.unionByName(earlier), F.timestamp_seconds(F.lit(0))).select("dir", inventory.built_since(F.col("confirmed_at"), F.timestamp_seconds(F.lit(5000))).alias("built"))


@query("SELECT p_partkey, CASE WHEN p_size < 20 THEN 'reuse' ELSE 'nothing' END AS aspect, CASE WHEN p_size < 20 THEN '' ELSE 'aspect is invalid' END AS errors FROM part")
def simplify_errors(spark, sf):
    """Errors of simplification reports: V03."""
    aspect = F.when(F.col("p_size") < 20, "reuse").otherwise("nothing")
    e = F.array(F.struct(F.lit("t").alias("title"), F.col("p_type").alias("path"), F.lit(1).alias("line_start"), F.col("p_size").alias("line_end")))
    o = F.array(F.struct(aspect.alias("aspect"), F.col("p_name").alias("title"), F.col("p_name").alias("body"), F.col("p_name").alias("proposed_change"), e.alias("evidences")))
    return _t(spark, sf, "part").select("p_partkey", aspect.alias("aspect"), F.array_join(reports.simplify_errors(F.col("p_brand"), o), ",").alias("errors"))


@query("""WITH m AS (SELECT conv_id, turn, string_split(trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10))[1] AS s FROM conversations) SELECT conv_id, turn, trim(s) AS subject FROM m""")
def shaped_subjects(spark, sf):
    """Subjects of shaped messages: I24."""
    c = _t(spark, sf, "conversations")
    alone = F.concat(F.substring_index(T.stripped(F.col("text")), "\n", 1), F.lit("\n\nBody"))
    return c.select("conv_id", "turn", F.split_part(reports.shaped(alone), F.lit("\n"), F.lit(1)).alias("subject"))


@query("""WITH s AS (SELECT DISTINCT source, source LIKE '%1%' AS same, source LIKE '%5' AS edited FROM documents)
  SELECT source AS path, CASE WHEN same AND NOT edited THEN '0' ELSE '1' END AS old, CASE WHEN same AND NOT edited THEN '9' WHEN same THEN '1' ELSE '2' END AS new, CASE WHEN same AND NOT edited THEN NULL ELSE edited END AS dirty FROM s""")
def dirty_gitlinks(spark, sf):
    """Submodules whose checkout moved or has changes of its own; the others as they were recorded: C24, M10."""
    s = _t(spark, sf, "documents").select(F.col("source").alias("path")).distinct()
    kind = "array<struct<path:string,code:string,hash:string>>"
    edited = F.when(F.col("path").like("%5"), F.array(F.struct(F.lit("f").alias("path"), F.lit("M").alias("code"), F.col("path").alias("hash")))).otherwise(F.array().cast(kind))
    checkouts = s.withColumns({"sha": F.when(F.col("path").like("%1%"), "1").otherwise("2"), "entries": edited})
    found = views.dirty_gitlinks(s.withColumn("sha", F.lit("1")), checkouts)
    return views.with_dirty(s.withColumns({"old": F.lit("0"), "new": F.lit("9")}), found.drop("state")).select("path", "old", "new", "dirty")


@query("SELECT source AS path, max(doc_id) AS base, max(doc_id) AS head FROM documents GROUP BY source")
def initialised_submodules(spark, sf):
    """Registered, checked out submodules that stay inside: M11."""
    s = _t(spark, sf, "documents").groupBy(F.col("source").alias("path")).agg(F.max("doc_id").alias("sha"))
    registered = s.select("path", F.lit("u").alias("url")).unionByName(s.select(F.concat(F.lit("../"), "path").alias("path"), F.lit("u").alias("url")))
    return views.initialised_submodules(s, registered, s.unionByName(s.select(F.concat(F.lit("../"), "path").alias("path"), "sha"))).drop("url")


@query("SELECT count(*) AS indexes, 0 AS packs, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL")
def tree_statistics(spark, sf):
    """Indexes, packs and bytes of a tree: D25."""
    f = _t(spark, sf, "documents").where("text is not null").select(F.concat(F.lit("indexes/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("path"), F.octet_length("text").cast("long").alias("size"))
    return packs.tree_statistics(f)


@query("SELECT DISTINCT sha256(text) AS chunk_id FROM documents WHERE text IS NOT NULL")
def exported_snapshot(spark, sf):
    """A snapshot merged strictly with the remote one: A45, G02."""
    d = _t(spark, sf, "documents").where("text is not null").select(F.sha2("text", 256).alias("chunk_id"), F.octet_length("text").alias("vector"))
    return packs.exported(d, d.distinct())[0].select("chunk_id")

