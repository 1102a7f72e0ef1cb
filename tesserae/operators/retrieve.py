"""Hybrid retrieval: cosine, BM25 and field matches over chunks, for many queries at once."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import golang as G
from ..functions import paths as P
from ..functions import text as T
from ..functions import vectors as V
from ..plans.graph import written
from ..plans.ranks import running


def line_chunks(docs: DataFrame, size: int = 80, step: int = 60) -> DataFrame:
    """Overlapping line windows of ``text`` with their lines: start_line, end_line, body."""
    lined = docs.withColumn("_lines", T.body_lines(F.col("text")))
    last = F.greatest(F.size("_lines") - (size - step), F.lit(1))
    out = lined.withColumn("start_line", F.explode(F.sequence(F.lit(1), last, F.lit(step))))
    out = out.withColumn("end_line", F.least(F.col("start_line") + size - 1, F.size("_lines")))
    return out.withColumn("body", F.array_join(F.slice("_lines", F.col("start_line"), F.lit(size)), "\n")).drop("_lines")


#: Lines that open a declaration at the margin: (kind, pattern with the name).
DECLARATIONS = (
    ("method", r"^func\s*\([^)]*\)\s*([A-Za-z_]\w*)"), ("function", r"^func\s+([A-Za-z_]\w*)"), ("type", r"^type\s+([A-Za-z_]\w*)"),
    ("const", r"^const\s+([A-Za-z_]\w*)"), ("var", r"^var\s+([A-Za-z_]\w*)"),
    ("function", r"^(?:async\s+)?def\s+([A-Za-z_]\w*)"), ("type", r"^class\s+([A-Za-z_]\w*)"))
#: Lines that open a group of declarations, whose names stand one level in.
GROUPS = (("type", r"^type\s*\($"), ("const", r"^const\s*\($"), ("var", r"^var\s*\($"))


def go_declarations(docs: DataFrame, key: str = "path") -> DataFrame:
    """Declarations of Go sources by their first and last lines (E02): key, start, end, symbol_type, symbol. A group is one with all its names.

    Strings, comments and brackets are told apart (see ``functions.golang``). A source in which something stays open has none.
    """
    text = F.array_join(T.body_lines(F.col("text")), "\n")
    s = docs.select(key, F.explode(G.statements(text, whole=True)).alias("s")).select(key, "s.*").withColumn("word", G.keyword(F.col("head")))
    names = F.array_join(F.transform(G.spec_names(F.col("head"), F.col("names")), lambda x: x["name"]), ", ")
    kind = F.when(F.col("word") != "func", F.col("word")).when(G.receiver(F.col("head")) != "", "method").otherwise("function")
    return s.where("word <> ''").select(key, "start", "end", kind.alias("symbol_type"), F.when(F.col("word") == "func", G.function_name(F.col("head"))).otherwise(names).alias("symbol"))


def declarations(docs: DataFrame, key: str = "path") -> DataFrame:
    """Declarations at the margin by their first and last lines, for languages other than Go: key, start, end, symbol_type, symbol.

    A declaration opens at the margin and ends before the next line at the margin that opens something or
    holds no closing bracket; a group in parentheses is one declaration with all its names. Lines are recognised, not parsed.
    """
    lines = docs.select(key, F.posexplode(T.body_lines(F.col("text"))).alias("at", "l")).withColumn("at", F.col("at") + 1)
    kind = name = F.lit(None).cast("string")
    for k, p in reversed(DECLARATIONS):
        kind, name = F.when(F.col("l").rlike(p), k).otherwise(kind), F.when(F.col("l").rlike(p), F.regexp_extract("l", p, 1)).otherwise(name)
    group = F.lit(None).cast("string")
    for k, p in GROUPS:
        group = F.when(F.trim("l").rlike(p), k).otherwise(group)
    margin = F.col("l").rlike(r"^\S") & ~F.col("l").rlike(r"^[)}\]]")
    marked = lines.withColumns({"kind": F.coalesce(kind, group), "name": name, "grouped": group.isNotNull(), "margin": margin})
    # a run goes from one line at the margin to the next; of a run that opens a declaration the last line that isn't blank is its end
    run = F.sum(F.col("margin").cast("int")).over(Window.partitionBy(key).orderBy("at"))
    inner = F.regexp_extract("l", r"^(?:\t| {2,4})([A-Za-z_]\w*)", 1)
    out = marked.withColumn("run", run).withColumn("inner", F.when(inner != "", inner)).groupBy(key, "run").agg(
        F.min("at").alias("start"), F.max(F.when(F.trim("l") != "", F.col("at"))).alias("end"), F.max("kind").alias("symbol_type"), F.max("name").alias("name"),
        F.bool_or("grouped").alias("grouped"), F.array_sort(F.collect_list(F.when(F.col("inner").isNotNull(), F.struct("at", "inner")))).alias("names"))
    symbol = F.when(F.col("grouped"), F.array_join(F.transform("names", lambda n: n["inner"]), ", ")).otherwise(F.col("name"))
    return out.where("symbol_type is not null and run > 0").select(key, "start", "end", "symbol_type", symbol.alias("symbol"))


def gaps(docs: DataFrame, covered: DataFrame, key: str = "path") -> DataFrame:
    """Runs of lines that nothing covers, from a line that isn't blank to the next covered one (E02): key, start, end.

    Gaps and islands over borders only: the covered spans of a key are few, its lines need not be expanded twice.
    """
    lined = docs.select(key, T.body_lines(F.col("text")).alias("_lines"))
    edge = Window.partitionBy(key).orderBy("start")
    spans = covered.select(key, "start", "end").withColumn("reach", F.max("end").over(edge.rowsBetween(Window.unboundedPreceding, 0)))
    after = spans.select(key, (F.col("reach") + 1).alias("start"), (F.coalesce(F.lead("start").over(edge), F.lit(1 << 30)) - 1).alias("end"))
    first = spans.groupBy(key).agg(F.lit(1).alias("start"), (F.min("start") - 1).alias("end"))
    none = docs.select(key).join(covered.select(key).distinct(), key, "left_anti").select(key, F.lit(1).alias("start"), F.lit(1 << 30).alias("end"))
    holes = after.unionByName(first).unionByName(none).join(lined, key).withColumn("end", F.least("end", F.size("_lines"))).where("start <= end")
    blank = F.transform(F.slice("_lines", F.col("start"), F.greatest(F.col("end") - F.col("start") + 1, F.lit(0))), lambda l: F.trim(F.regexp_replace(l, r"\s+", " ")) == "")
    shift = F.array_position(blank, False).cast("int")
    return holes.withColumn("shift", shift).where("shift > 0").select(key, (F.col("start") + F.col("shift") - 1).alias("start"), "end")


def symbol_chunks(docs: DataFrame, size: int = 80, step: int = 60, key: str = "path") -> DataFrame:
    """Windows over declarations, then over what they leave uncovered, by start (E02): all columns, start_line, end_line, symbol_type, symbol, body.

    A file whose heading says that it isn't to be edited has one chunk without a body.
    """
    plain = docs.where(~F.coalesce(T.has_do_not_edit(F.col("text")), F.lit(False)))
    go = F.lower("path").endswith(".go")
    found = written(go_declarations(plain.where(go), key).unionByName(declarations(plain.where(~go), key)))
    rest = gaps(plain, found, key).withColumns({"symbol_type": F.lit(None).cast("string"), "symbol": F.lit(None).cast("string")})
    spans = found.unionByName(rest)
    last = F.greatest(F.col("end") - (size - step), F.col("start"))
    out = plain.join(spans, key).withColumn("start_line", F.explode(F.sequence("start", last, F.lit(step))))
    out = out.withColumn("end_line", F.least(F.col("start_line") + size - 1, F.col("end")))
    body = F.array_join(F.slice(T.body_lines(F.col("text")), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    out = out.withColumn("body", body).drop("start", "end")
    sealed = docs.join(plain.select(key), key, "left_anti").withColumns({"symbol_type": F.lit(None).cast("string"), "symbol": F.lit(None).cast("string"), "start_line": F.lit(1), "end_line": F.lit(1), "body": F.lit("")})
    return out.select(*docs.columns, "start_line", "end_line", "symbol_type", "symbol", "body").unionByName(sealed.select(*docs.columns, "start_line", "end_line", "symbol_type", "symbol", "body"))


def chunks(docs: DataFrame, size: int = 80, step: int = 60) -> DataFrame:
    """Chunks of files by their kind (M27): by symbols where there are declarations, else line windows. ``docs``: path, text."""
    code = P.language(F.col("path")).isin("go", "python") | F.col("path").rlike(r"\.(go|py)$")
    by_symbol = symbol_chunks(docs.where(code), size, step)
    lines = line_chunks(docs.where(~code), size, step).withColumns({"symbol_type": F.lit(None).cast("string"), "symbol": F.lit(None).cast("string")})
    return by_symbol.unionByName(lines.select(*by_symbol.columns))


def on_disk(rows: DataFrame) -> DataFrame:
    """Chunk bodies kept on executors' disks until they are released (A58); a lost one is computed again."""
    return rows.persist(StorageLevel.DISK_ONLY)


def numbered(chunks: DataFrame, *order: str) -> DataFrame:
    """Chunk ids c000001, ... in order."""
    return running(chunks, list(order)).withColumn("chunk_id", F.format_string("c%06d", F.col("n") + 1)).drop("n")


def search(chunks: DataFrame, vectors: DataFrame, queries: list[tuple[str, str, list[float]]], min_score: float = 0.0, limit: int = 20, skip=None) -> DataFrame:
    """The best chunks of each query: query_id, place, path, lines and seven scores.

    ``chunks``: chunk_id, path, start_line, end_line, symbol (text or null), text.
    ``vectors``: chunk_id, vector. Chunks without a vector, and those that ``skip`` selects,
    are no candidates; BM25 counts candidates only. The threshold holds for the hybrid rank.
    """
    if not queries:
        raise ValueError("give at least one query")
    pool = chunks if skip is None else chunks.where(~skip)
    pool = pool.join(vectors.where(F.size("vector") > 0), "chunk_id").select(
        "chunk_id", "path", "start_line", "end_line", "vector", T.terms(F.col("text")).alias("terms"),
        T.terms(F.col("path")).alias("path_terms"), T.terms(F.coalesce("symbol", F.lit(""))).alias("symbol_terms"))
    asked = F.explode(F.array(*(F.struct(F.lit(i).alias("id"), F.lit(q).alias("text"), F.array(*map(F.lit, map(float, v))).alias("vector")) for i, q, v in queries)))
    found = pool.select("*", asked.alias("q")).select("*", F.col("q.id").alias("query_id"), T.distinct_terms(F.col("q.text")).alias("query_terms"))
    found = found.withColumns({
        "cosine": V.cosine(F.col("q.vector"), F.col("vector")), "length": F.size("terms"),
        "tf": F.transform("query_terms", lambda t: F.size(F.filter("terms", lambda x: x == t)))}).drop("terms", "vector", "q")
    found = written(found)  # texts are read and cut into terms once; what is kept of them is small
    counted = found.select("query_id", F.posexplode("tf").alias("pos", "n")).groupBy("query_id", "pos").agg(F.sum((F.col("n") > 0).cast("long")).alias("df"))
    dfs = counted.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "df"))), lambda x: x["df"]).alias("df"))
    totals = found.groupBy("query_id").agg(F.count("*").alias("n"), F.avg("length").alias("average"))
    stats = totals.join(dfs, "query_id", "left").withColumn("average", F.when(F.col("average") == 0, 1.0).otherwise(F.col("average")))
    scored = found.join(stats, "query_id")
    parts = F.zip_with("tf", "df", lambda t, d: V.bm25_term(t, d, F.col("n"), F.col("length"), F.col("average")))
    text_score = F.when(F.size("query_terms") == 0, 0.0).otherwise(V.saturated(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)))
    scored = scored.withColumns({
        "vector_score": V.relatedness(F.col("cosine")), "text_score": text_score,
        "path_score": V.field_match(F.col("query_terms"), F.col("path_terms")), "symbol_score": V.field_match(F.col("query_terms"), F.col("symbol_terms"))})
    scored = scored.withColumn("lexical_score", V.lexical(F.col("text_score"), F.col("path_score"), F.col("symbol_score")))
    scored = scored.withColumn("rank", V.hybrid(F.col("vector_score"), F.col("lexical_score"))).where(F.col("rank") >= min_score)
    order = Window.partitionBy("query_id").orderBy(F.desc("rank"), F.col("end_line") - F.col("start_line"), "path", "start_line", "chunk_id")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select(
        "query_id", "place", "chunk_id", "path", "start_line", "end_line", "cosine", "vector_score", "text_score", "path_score", "symbol_score", "lexical_score", "rank")


def similar_query(history: DataFrame, vector: list[float], normalized: str, threshold: float = 0.90) -> DataFrame:
    """What of a history to replay: an exact hit anywhere, else the first similar entry (C19): ord, mode."""
    score = V.cosine(F.array(*map(F.lit, map(float, vector))), F.col("query_embedding"))
    hits = history.select("ord", F.when(F.col("normalized") == normalized, 0).when(score >= threshold, 1).alias("kind")).where("kind is not null")
    return hits.orderBy("kind", "ord").limit(1).select("ord", F.when(F.col("kind") == 0, "hit").otherwise("similar").alias("mode"))


def same_filters(code: bool, no_tests: bool, scope: list[str]):
    """Whether stored filters are the asked ones; stored nulls match any without code."""
    stored = F.col("filters")
    same = (stored["code"] == code) & (stored["no_tests"] == no_tests) & (F.array_join(stored["scope"], "\0") == "\0".join(scope))
    return F.when(stored.isNull(), F.lit(not code)).otherwise(same)


def brief(results: DataFrame) -> DataFrame:
    """Package hits without a symbol go where their file has a symbol hit."""
    named = F.max(F.col("symbol").isNotNull()).over(Window.partitionBy("path"))
    return results.withColumn("_named", named).where(~(F.col("symbol").isNull() & F.col("_named") & F.col("path").endswith(".go"))).drop("_named")
