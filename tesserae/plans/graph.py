"""Reachability, ranges and lineage over edge tables, by doubling and by chains."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """Written to the folder that driver and executors share, which cuts lineage."""
    spark = df.sparkSession
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = root or f"file://{tempfile.gettempdir()}/tesserae"
    path = f"{root.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hops(pointers: DataFrame) -> Iterator[tuple[DataFrame, DataFrame, DataFrame]]:
    """Pointers (node, p) of a forest, each round four times as far: rounds grow with the logarithm of the longest chain.

    A round gives (node, p, p2 or null), (node, p3) and the next pointers (node, p), all written. Where a pointer ends,
    the node goes, so that no null is ever joined. A cycle is an error.
    """
    nodes, reach = pointers.count(), 1
    steps = pointers
    while not steps.isEmpty():
        if reach > 4 * nodes:
            raise ValueError("the pointers have a cycle")
        two = written(steps.join(steps.select(F.col("node").alias("p"), F.col("p").alias("p2")), "p", "left").select("node", "p", "p2"))
        far = two.select(F.col("node").alias("p2"), F.col("p").alias("p3"), F.col("p2").alias("p4"))
        four = written(two.where("p2 is not null").join(far, "p2").select("node", "p3", "p4"))
        steps = four.where("p4 is not null").select("node", F.col("p4").alias("p"))
        yield two, four.select("node", "p3"), steps
        reach *= 4


class Chains:
    """A graph of commits as chains, for searches whose rounds don't grow with its depth.

    Each node goes on towards its first parent. Of a node's children, the one with the deepest descendant continues
    its chain, so that a chain is named by that descendant (``chain``), and a node by its distance from it (``pos``). Whoever
    reaches a place of a chain reaches all that is above it; a search therefore only keeps the lowest place by chain.
    ``nodes``: node, chain, pos; ``links``: chain, pos, o, to, at (all edges but those along a chain; o is 0 for first parents).
    """

    def __init__(self, edges: DataFrame, child: str = "sha", parent: str = "parent", ordinal: str | None = None) -> None:
        named = edges.select(F.col(child).alias("node"), F.col(parent).alias("up"), (F.col(ordinal) if ordinal else F.lit(0)).alias("o")).where("node is not null")
        pairs = written(named.where("up is not null and up <> node").groupBy("node", "up").agg(F.min("o").alias("o")))
        first = written(pairs.groupBy("node").agg(F.min(F.struct("o", "up"))["up"].alias("p")))
        every = named.select("node").unionByName(pairs.select(F.col("up").alias("node"))).distinct()
        best = written(every.select("node", F.lit(0).cast("bigint").alias("d"), F.col("node").alias("leaf")))
        step = self.rounds = 0
        for two, three, _ in hops(first):
            step, self.rounds = 4**self.rounds, self.rounds + 1
            reached = two.select("node", F.explode(F.filter(F.array(F.struct(F.col("p").alias("to"), F.lit(step).alias("far")), F.struct(F.col("p2").alias("to"), F.lit(2 * step).alias("far"))), lambda x: x["to"].isNotNull())).alias("x"))
            reached = reached.select("node", "x.to", "x.far").unionByName(three.select("node", F.col("p3").alias("to"), F.lit(3 * step).alias("far")))
            gained = reached.join(best, "node").groupBy(F.col("to").alias("node")).agg(F.max(F.struct((F.col("d") + F.col("far")).alias("d"), "leaf")).alias("more"))
            deepest = F.greatest(F.struct("d", "leaf"), F.coalesce("more", F.struct("d", "leaf")))
            best = written(best.join(gained, "node", "left").select("node", deepest.alias("m")).select("node", F.col("m.d").alias("d"), F.col("m.leaf").alias("leaf")))
        self.nodes = best.select("node", F.col("leaf").alias("chain"), F.col("d").alias("pos"))
        below = pairs.join(first, "node").join(self.nodes, "node").select("up", "chain", "pos", F.when(F.col("up") == F.col("p"), 0).otherwise(F.col("o") + 1).alias("o"))
        above = self.nodes.select(F.col("node").alias("up"), F.col("chain").alias("to"), F.col("pos").alias("at"))
        self.links = written(below.join(above, "up").where("chain <> to or o > 0").select("chain", "pos", "o", "to", "at"))

    def reached(self, starts: DataFrame, outside: DataFrame | None = None, *group: str) -> DataFrame:
        """The lowest place of each chain that the starts (node, group columns) reach: group columns, chain, low.

        ``outside``, such a table, ends the search where it has been. Each link is followed once, when a search
        comes below it; rounds are as many as chains lie behind each other.
        """
        keys = [*group, "chain"]
        fence = outside.select(*keys, F.col("low").alias("_fence")) if outside is not None else None
        inside = lambda d: d if fence is None else d.join(fence, keys, "left").where("_fence is null or low < _fence").drop("_fence")
        begun = starts.join(self.nodes, "node").groupBy(*keys).agg(F.min("pos").alias("low"))
        known = written(inside(begun))
        news = known.withColumn("was", F.lit(None).cast("bigint"))
        while not news.isEmpty():
            self.rounds += 1
            found = self.links.join(news, "chain").where("pos >= low and (was is null or pos < was)")
            found = inside(found.groupBy(*group, F.col("to").alias("chain")).agg(F.min("at").alias("low")))
            better = found.join(known.withColumnRenamed("low", "was"), keys, "left").where("was is null or low < was")
            news = written(better.select(*keys, "low", "was"))
            known = written(known.unionByName(news.select(*keys, "low")).groupBy(*keys).agg(F.min("low").alias("low")))
        return known

    def preorder(self, start: DataFrame, included: DataFrame, most: int, fence: DataFrame | None = None) -> list:
        """The first ``most`` nodes of ``included`` (node) in pre-order from a start: parents in order, nodes once, none of ``fence``.

        A walk goes along first parents until it comes to a chain's place that it has seen (all above that has been seen, too), and
        from its deepest node back to the others' further parents. The driver holds stretches of chains; it asks for the place and
        the end of a stretch, for what is included of a walk, and for the merges of a walk, a page at a time. A history whose
        first parents hold enough nodes takes one walk.
        """
        row = start.join(self.nodes, "node", "left").first()
        if row is None:
            return []
        if row.chain is None:  # without an edge
            return [r.node for r in included.join(start, "node", "left_semi").take(most)]
        seen: dict = {}
        out: list = []

        def stretches(chain, pos: int) -> list[tuple]:
            found = []
            while True:
                end = self.nodes.where(F.col("chain") == F.lit(chain)).agg(F.max("pos").alias("top"))
                limit = fence.where(F.col("chain") == F.lit(chain)).select("low") if fence is not None else None
                facts = end.join(limit, how="left").first() if limit is not None else end.first()
                stop = min(x for x in (facts.top + 1, seen.get(chain), facts.low if limit is not None else None) if x is not None)
                if pos < stop:
                    found.append((len(found), chain, pos, stop))
                    seen[chain] = pos
                link = self.links.where((F.col("chain") == F.lit(chain)) & (F.col("pos") == facts.top) & (F.col("o") == 0)).first() if pos < stop == facts.top + 1 else None
                if link is None:
                    return found
                chain, pos = link.to, link.at

        todo = [(row.chain, row.pos)]
        while todo and len(out) < most:
            if callable(todo[-1]):
                page = todo[-1]()
                if page:
                    todo += reversed(page)
                else:
                    todo.pop()
                continue
            walk = stretches(*todo.pop())
            if not walk:
                continue
            kind = self.nodes.schema["chain"].dataType.simpleString()
            path = self.nodes.sparkSession.createDataFrame(walk, f"turn int, chain {kind}, first bigint, stop bigint")
            on = lambda d, path=path: d.join(F.broadcast(path), "chain").where("pos >= first and pos < stop")
            hits = on(self.nodes).join(included.select("node").distinct(), "node", "left_semi").orderBy("turn", "pos").select("node")
            out += [r.node for r in hits.take(most - len(out))]
            todo.append(_pages(on(self.links.where("o > 0")).orderBy(F.desc("turn"), F.desc("pos"), "o"), most))
        return out

    def above(self, reached: DataFrame, outside: DataFrame | None = None, *group: str) -> DataFrame:
        """The nodes at or above the lowest places, and below those of ``outside``: group columns, node."""
        found = self.nodes.join(reached, "chain").where("pos >= low")
        if outside is not None:
            found = found.join(outside.select(*group, "chain", F.col("low").alias("_fence")), [*group, "chain"], "left").where("_fence is null or pos < _fence")
        return found.select(*group, "node")


def _pages(links: DataFrame, size: int):
    """A function that gives the next places (to, at) of ordered links, and an empty list in the end."""
    at = 0

    def page() -> list[tuple]:
        nonlocal at
        rows = links.select("to", "at").offset(at).limit(size).collect()
        at += len(rows)
        return [(r.to, r.at) for r in rows]

    return page


def ancestors(edges: DataFrame, starts: DataFrame, child: str = "sha", parent: str = "parent") -> DataFrame:
    """Nodes reachable from ``starts`` (``node``), themselves included, in rounds that grow with the logarithm of the depth."""
    chains = Chains(edges, child, parent)
    lone = starts.select("node").distinct().join(chains.nodes, "node", "left_anti")  # a start without an edge
    return chains.above(chains.reached(starts)).unionByName(lone)


def commit_range(edges: DataFrame, base: DataFrame, release: DataFrame, child: str = "sha", parent: str = "parent") -> DataFrame:
    """Nodes reachable from the release but not from the base (G07, H02). Where the base has been, the search ends."""
    chains = Chains(edges, child, parent)
    fence = chains.reached(base)
    lone = release.select("node").distinct().join(chains.nodes, "node", "left_anti").join(base, "node", "left_anti")
    return chains.above(chains.reached(release, fence), fence).unionByName(lone)


def commit_ranges(edges: DataFrame, ends: DataFrame, group: str, child: str = "sha", parent: str = "parent") -> DataFrame:
    """The same for many pairs of ends (group, old, new) at once: (group, node)."""
    chains = Chains(edges, child, parent)
    side = lambda c: ends.select(group, F.col(c).alias("node")).where("node is not null")
    fence = chains.reached(side("old"), None, group)
    lone = side("new").join(chains.nodes, "node", "left_anti").join(side("old"), [group, "node"], "left_anti").distinct()
    return chains.above(chains.reached(side("new"), fence, group), fence, group).unionByName(lone)


def reachable(edges: DataFrame, starts: DataFrame, child: str = "sha", parent: str = "parent", most: int | None = None) -> DataFrame:
    """Nodes reachable from ``starts`` (``node``), themselves included, with their least distance.

    A frontier at a time: rounds are as many as the longest least path, or ``most``. Use it for what is near;
    ``ancestors`` gives the set at any depth.
    """
    known = frontier = written(starts.select(F.col("node"), F.lit(0).alias("distance")).dropDuplicates(["node"]))
    steps = edges.where(F.col(parent).isNotNull()).select(F.col(child).alias("node"), F.col(parent).alias("next"))
    turn = 0
    while not frontier.isEmpty() and turn != most:
        turn += 1
        found = steps.join(frontier.select("node"), "node").select(F.col("next").alias("node")).distinct().join(known, "node", "left_anti")
        frontier = written(found.select("node", F.lit(turn).alias("distance")))
        known = known.unionByName(frontier)
        if turn % 16 == 0:
            known = written(known)
    return known


def nearest_within(edges: DataFrame, starts: DataFrame, inside: DataFrame, group: str, enough: int, child: str = "sha", parent: str = "parent") -> DataFrame:
    """For each group the nodes of ``inside`` (group, node) by distance from its starts, level by level until it has ``enough``: group, node, distance.

    A level adds a node at least, so there are at most ``enough`` rounds.
    """
    keys = [group, "node"]
    known = frontier = written(starts.select(*keys).distinct().join(inside, keys, "left_semi").withColumn("distance", F.lit(0)))
    steps = edges.where(F.col(parent).isNotNull()).select(F.col(child).alias("node"), F.col(parent).alias("next"))
    turn = 0
    while not frontier.isEmpty():
        turn += 1
        short = known.groupBy(group).count().where(F.col("count") < enough).select(group)
        found = steps.join(frontier.join(short, group, "left_semi").select(*keys), "node").select(group, F.col("next").alias("node")).distinct()
        frontier = written(found.join(inside, keys, "left_semi").join(known, keys, "left_anti").withColumn("distance", F.lit(turn)))
        known = known.unionByName(frontier)
        if turn % 16 == 0:
            known = written(known)
    return known


def depths(rows: DataFrame, most: int = 3, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """Follow-up depth: a parent's plus 1, 0 again beyond ``most`` (H07). What doesn't go back to a row without a parent has none.

    The distance to the root by doubling, as the depth is its remainder.
    """
    known = written(rows.select(F.col(key).alias("node"), F.col(parent).alias("p")).dropDuplicates(["node"]))
    far = known.where("p is null").select(F.col("node").alias("id"), F.lit(0).cast("bigint").alias("far"))
    step = 1
    for two, three, _ in hops(written(known.where("p is not null"))):
        # a root is met by each node once, at the step that leads to it
        ends = two.select("node", F.explode(F.array(F.struct(F.col("p").alias("to"), F.lit(1).alias("k")), F.struct(F.col("p2").alias("to"), F.lit(2).alias("k")))).alias("x")).select("node", "x.to", "x.k")
        ends = ends.unionByName(three.select("node", F.col("p3").alias("to"), F.lit(3).alias("k"))).where("to is not null")
        near = far.select(F.col("id").alias("to"), F.col("far").alias("more")).where(F.col("more") < step)
        far = written(far.unionByName(ends.join(near, "to").select(F.col("node").alias("id"), (F.col("k") * step + F.col("more")).alias("far"))))
        step *= 4
    return far.select("id", (F.col("far") % (most + 1)).cast("int").alias("depth"))


def nearest_ancestor(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Each path's deepest directory among ``roots`` (``root``), by equal ancestors rather than prefixes."""
    from ..functions.paths import ancestors

    up = paths.select("path", F.explode(ancestors(F.col("path"))).alias("root"))
    return up.join(roots.select("root").distinct(), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))


def _tree_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ids of directories whose entries come in order: dir, hash. Only the state of one hash is held."""
    at, state = None, None
    for b in batches:
        done = []
        for folder, size, name, mode, child in zip(b["dir"].tolist(), b["size"].tolist(), b["name"].tolist(), b["mode"].tolist(), b["child"].tolist(), strict=True):
            if folder != at:
                if at is not None:
                    done.append((at, state.hexdigest()))
                at, state = folder, hashlib.sha1(b"tree %d\0" % size, usedforsecurity=False)
            state.update(mode.encode() + b" " + name.encode() + b"\0" + bytes.fromhex(child.zfill(40)))
        yield pd.DataFrame(done, columns=["dir", "hash"])
    if at is not None:
        yield pd.DataFrame([(at, state.hexdigest())], columns=["dir", "hash"])


def tree_objects(files: DataFrame) -> DataFrame:
    """Entries of the directories over files (path, blob, mode), with the directories' own ids as git gives them (H06): dir, tree, name, mode, child.

    Level by level from the deepest; the root is ".". Entries are in order of their names, a directory's as if it ended
    in a slash, and go through a hash as a stream, so that a directory may hold any part of the files.
    """
    from ..functions.paths import directory

    level = files.select("path", F.col("blob").alias("child"), "mode")
    deepest = level.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 0
    out = None
    for depth in range(deepest, 0, -1):
        here = level.where(F.size(F.split("path", "/")) == depth).select(directory(F.col("path")).alias("dir"), F.substring_index("path", "/", -1).alias("name"), "mode", "child")
        key = F.when(F.col("mode") == "40000", F.concat("name", F.lit("/"))).otherwise(F.col("name"))
        # the window is what keeps a directory in one task: a repartition() beside a join by the same column is dropped, and the join's sides may then be read in pieces
        size = F.sum(F.octet_length("mode") + F.octet_length("name") + 22).over(Window.partitionBy("dir"))
        sorted_ = here.select("dir", size.alias("size"), "name", "mode", "child").sortWithinPartitions("dir", key)
        ids = written(sorted_.mapInPandas(_tree_ids, "dir string, hash string"))
        made = written(here.join(ids, "dir").select("dir", F.col("hash").alias("tree"), "name", "mode", "child"))
        out = made if out is None else out.unionByName(made)
        level = level.unionByName(ids.where("dir <> '.'").select(F.col("dir").alias("path"), F.col("hash").alias("child"), F.lit("40000").alias("mode")))
    return out if out is not None else files.select(*(F.lit("").alias(c) for c in ("dir", "tree", "name", "mode", "child"))).limit(0)


def merkle(files: DataFrame) -> DataFrame:
    """Ids of the directories over files (path, blob, perhaps mode), as git gives them (H06): dir, hash."""
    moded = files if "mode" in files.columns else files.withColumn("mode", F.lit("100644"))
    return tree_objects(moded).select("dir", F.col("tree").alias("hash")).distinct()
