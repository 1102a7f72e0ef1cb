"""Global orders and deep histories at sizes where a wrong plan shows."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tesserae.operators import packs, retrieve, store
from tesserae.plans import graph, ranks

ROWS = 600_000


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Rows in eight files, of which a third have one key."""
    path = str(tmp_path_factory.mktemp("ranks") / "rows")
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.xxhash64("id"))
    spark.range(ROWS).select(key.alias("k"), "id", (F.col("id") % 5 + 1).alias("dims"), F.sha2(F.col("id").cast("string"), 256).alias("pad")).repartition(8).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(params=["true", "false"])
def adaptive(spark, request):
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", request.param)
    yield request.param
    spark.conf.set("spark.sql.adaptive.enabled", was)


def test_ranks_are_gapless(spark, table, adaptive, tmp_path):
    store.ranked(table, "k").write.parquet(str(tmp_path / "r"))
    got = spark.read.parquet(str(tmp_path / "r"))
    facts = got.agg(F.count("*"), F.countDistinct("n"), F.min("n"), F.max("n"), F.countDistinct("id")).first()
    assert tuple(facts) == (ROWS, ROWS, 0, ROWS - 1, ROWS)
    order = got.select("n", "k").where("n % 1000 < 2").orderBy("n").collect()
    assert all(a.k <= b.k for a, b in zip(order, order[1:], strict=False))
    ids = retrieve.numbered(table.select("id", "k"), "k", "id")
    assert ids.agg(F.countDistinct("chunk_id"), F.max("chunk_id")).first()[:] == (ROWS, "c600000")


def test_offsets_of_all_rows(spark, table, adaptive, tmp_path):
    store.byte_offsets(table, "dims", "id").write.parquet(str(tmp_path / "o"))
    got = spark.read.parquet(str(tmp_path / "o"))
    assert got.count() == ROWS
    # of five rows one has each size, so a row's place tells its offset
    want = F.expr("(id div 5) * 60 + 4 * (id % 5) * (id % 5 + 1) div 2")
    assert got.where(F.col("offset") != want).count() == 0
    packed = store.packs(table.select("id", "k"), 64, "id", size=64 * 4 * 1000)
    assert packed.where("pack * 1000 + slot <> id").count() == 0 and packed.count() == ROWS


def test_packed_and_compacted(spark):
    """Every vector of a large store is in a pack, and offsets after clean-up follow each other."""
    n = 60_000
    data = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    v = spark.range(n).select(F.unhex(F.sha2(F.concat(F.lit("k"), F.col("id")), 256)).alias("embedding_key"), F.unhex(F.sha2(data, 256)).alias("vector_digest"), data.alias("data")).repartition(6)
    made = packs.packed(v, 8, b"m" * 32, size=64 << 10)
    back = packs.entries(made)
    assert back.count() == n and back.select("embedding_key").distinct().count() == n


def plain_batches(rows, most, most_bytes):
    out, n, total, batch = {}, 0, 0, 0
    for i, s in rows:
        if n and (n == most or total + s > most_bytes):
            n, total, batch = 0, 0, batch + 1
        n, total = n + 1, total + s
        out[i] = batch
    return out


def test_greedy_batches_of_one_group(spark):
    """One group with all but a few rows, over many tasks, as in a loop."""
    sizes = spark.range(ROWS).select(F.lit("all").alias("g"), F.col("id").alias("i"), F.when(F.xxhash64("id") % 7 == 0, 1200).otherwise(F.pmod(F.xxhash64("id"), F.lit(400))).alias("s"))
    few = spark.createDataFrame([(None, -1, 5), ("z", 1, 2_000), ("z", 2, 10), ("z", 3, 2_995)], "g string, i bigint, s bigint")
    got = ranks.greedy_batches(sizes.unionByName(few).repartition(7), "g", "i", "s", 32, 3_000).toPandas()
    one = got[got["g"] == "all"].sort_values("i")
    assert len(one) == ROWS and dict(zip(one["i"], one["batch"], strict=True)) == plain_batches(list(zip(one["i"].tolist(), one["s"].tolist(), strict=True)), 32, 3_000)
    rest = {(g if isinstance(g, str) else None, i): b for g, i, b in zip(got["g"], got["i"], got["batch"], strict=True) if g != "all"}
    assert rest == {(None, -1): 0, ("z", 1): 0, ("z", 2): 0, ("z", 3): 1}
    assert ranks.greedy_batches(few.limit(0), "g", "i", "s").count() == 0


@pytest.mark.parametrize(("most", "most_bytes"), [(3, 1 << 40), (1 << 20, 50)])
def test_greedy_batches_by_one_limit(spark, most, most_bytes):
    r = random.Random(5)
    rows = [(i, r.choice([0, 1, 3, 50, 60])) for i in range(300)]
    df = spark.createDataFrame(rows, "i bigint, s bigint").withColumn("g", F.lit(1)).repartition(3)
    assert {x.i: x.batch for x in ranks.greedy_batches(df, "g", "i", "s", most, most_bytes).collect()} == plain_batches(rows, most, most_bytes)


def history(n, every, length, seed=0):
    """A main line of n commits; every so often a branch of some commits is merged, some from far back."""
    r, edges, made = random.Random(seed), [], n
    for i in range(1, n):
        edges.append((i, i - 1, 0))
        if i % every == 0:
            base, last = max(0, i - r.choice([2, 5, 30, 200])), None
            for _ in range(r.randint(1, length)):
                edges.append((made, base if last is None else last, 0))
                last, made = made, made + 1
            edges.append((i, last, 1))
    return edges


def search(edges, starts):
    up, seen, todo = defaultdict(list), set(), list(starts)
    for c, p, _ in edges:
        up[c].append(p)
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += up[x]
    return seen


def test_deep_history(spark):
    """200,000 commits with merges in under 30 rounds, as a plain search has them."""
    edges = history(150_000, 9, 5)
    df = spark.createDataFrame(edges, "sha bigint, parent bigint, ordinal int").repartition(4)
    chains = graph.Chains(df, ordinal="ordinal")
    one = lambda n: spark.createDataFrame([(n,)], "node bigint")
    assert chains.nodes.count() > 190_000
    fence = chains.reached(one(20_000))
    found = chains.above(chains.reached(one(149_990), fence), fence)
    assert {r.node for r in found.collect()} == search(edges, [149_990]) - search(edges, [20_000])
    assert chains.rounds < 30


@pytest.mark.parametrize("seed", range(2))
def test_any_graph(spark, seed):
    """Random graphs with several parents, roots and unconnected nodes, against a plain search."""
    r = random.Random(seed)
    n = 60
    edges = [(c, p, k) for c in range(n) for k, p in enumerate(sorted(r.sample(range(c), min(c, r.choice([0, 1, 1, 2, 3])))))]
    df = spark.createDataFrame([*edges, (5, 5, 0), (0, None, 0)], "sha bigint, parent bigint, o int")
    node = lambda *x: spark.createDataFrame([(i,) for i in x], "node bigint")
    a, b = r.sample(range(n), 2), r.sample(range(n), 1)
    assert {x.node for x in graph.ancestors(df, node(*a, 999)).collect()} == search(edges, a) | {999}
    assert {x.node for x in graph.commit_range(df, node(*b), node(*a)).collect()} == search(edges, a) - search(edges, b)
    ends = [("p", b[0], a[0]), ("q", a[0], a[1]), ("r", None, b[0]), ("s", 999, 998)]
    got = {tuple(x) for x in graph.commit_ranges(df, spark.createDataFrame(ends, "path string, old bigint, new bigint"), "path").collect()}
    assert got == {(g, x) for g, old, new in ends for x in search(edges, [new]) - search(edges, [old] if old is not None else [])}


def test_depths_and_cycles(spark):
    rows = [(i, i - 1 if i else None) for i in range(3_000)] + [(10_000, 9_999), (20_000, 0)]
    got = {r.id: r.depth for r in graph.depths(spark.createDataFrame(rows, "id bigint, parent_id bigint")).collect()}
    assert got == {**{i: i % 4 for i in range(3_000)}, 20_000: 1}
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "sha bigint, parent bigint")
    with pytest.raises(ValueError, match="cycle"):
        graph.ancestors(loop, spark.createDataFrame([(1,)], "node bigint"))


def walked(edges, start, outside=frozenset()):
    """Pre-order by a plain stack."""
    up, out, seen, todo = defaultdict(list), [], set(), [start]
    for c, p, o in sorted(edges, key=lambda e: e[2]):
        up[c].append(p)
    while todo:
        x = todo.pop()
        if x not in seen and x not in outside:
            seen.add(x)
            out.append(x)
            todo += reversed(up[x])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_preorder(spark, seed):
    """The walk on chains against a plain stack: merges, a base, a filter, limits."""
    r = random.Random(seed)
    edges = history(50, 4, 4, seed) if seed else [(c, p, k) for c in range(1, 30) for k, p in enumerate(r.sample(range(c), min(c, r.choice([1, 1, 2, 3]))))]
    top = 49 if seed else 29
    df = spark.createDataFrame(edges, "sha bigint, parent bigint, ordinal int")
    chains = graph.Chains(df, ordinal="ordinal")
    node = lambda *x: spark.createDataFrame([(i,) for i in x], "node bigint")
    every = chains.nodes.select("node")
    assert chains.preorder(node(top), every, 1000) == walked(edges, top)
    assert chains.preorder(node(top), every, 7) == walked(edges, top)[:7]
    fence = chains.reached(node(top // 2))
    want = walked(edges, top, search(edges, [top // 2]))
    assert chains.preorder(node(top), every, 1000, fence) == want
    some = {x for x in want if x % 3 == 0}
    assert chains.preorder(node(top), node(*some), 4, fence) == [x for x in want if x in some][:4]
    assert chains.preorder(node(12345), node(12345), 4) == [12345] and chains.preorder(node(12345), node(1), 4) == []
