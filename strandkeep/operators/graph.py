"""Ancestry over a table of parent edges: closure, ancestor test, merge base.

A commit's first parent, and its first parent, and so on lead to the commit that began its line: every commit stands in a tree, at
a height, which pointer doubling finds in rounds that grow with the logarithm of the height. Heights are cut into
blocks of BLOCK, blocks into blocks of blocks. What a block does to whoever enters it, the distances from its entries to what
lies beyond it, is worked out once, all blocks at a time; the next level sees the entries alone, with these
distances for edges. So a history of N commits takes some log N rounds however often it merges, and a search goes down again
from the coarsest blocks to the commits it is asked about. Any way of cutting gives the same distances.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandkeep.stash import stash

#: Heights in a block, blocks in the next larger one and so on.
BLOCK = 512
#: Searches that one task makes in a block; more are dealt to several tasks, each with the block's edges.
SEARCHES = 20_000
#: Nodes of a history for each group of blocks that a task works on at a time.
GROUP = 20_000


def heights(edges: DataFrame) -> DataFrame:
    """node, tree (the commit that its first parents lead to), height (how many they are) of all nodes of edges (child, parent, and ordinal if there are several)."""
    first = F.min_by("parent", F.struct("ordinal", "parent")) if "ordinal" in edges.columns else F.min("parent")
    up = edges.groupBy("child").agg(first.alias("to"))
    nodes = edges.select(F.col("child").alias("node")).unionByName(edges.select(F.col("parent").alias("node"))).distinct()
    rows = nodes.join(up, F.col("node") == F.col("child"), "left").select("node", F.coalesce("to", "node").alias("to"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("far"), F.col("to").isNull().alias("last"))
    rows = stash(rows)
    while not (open_ := rows.where("NOT last")).isEmpty():
        ahead = rows.select(F.col("node").alias("to"), F.col("to").alias("then"), F.col("far").alias("more"), F.col("last").alias("ends"))
        moved = open_.join(ahead, "to").select("node", F.col("then").alias("to"), (F.col("far") + F.col("more")).alias("far"), F.col("ends").alias("last"))
        moved = moved.join(ahead, "to").select("node", F.col("then").alias("to"), (F.col("far") + F.col("more")).alias("far"), F.col("ends").alias("last"))
        rows = stash(rows.where("last").unionByName(moved))
    return rows.select("node", F.col("to").alias("tree"), F.col("far").alias("height"))


def _searched(edges: DataFrame, sources: DataFrame, inside: bool, groups: int) -> DataFrame:
    """root, node, far: the least distances from sources (g, root, node, far) over the edges (g, a, b, w, own) of their block g; inside, to the nodes of the block, else to those that edges lead to out of it.

    Sources of one root in a block are searched from together. Blocks are dealt to groups, as most are small; no edge that is followed leaves a block. A block with more than SEARCHES
    sources is searched in several tasks.
    """
    kind = sources.schema["node"].dataType
    lots = sources.groupBy("g").agg(F.ceil(F.count("*") / SEARCHES).cast("int").alias("lots"))
    group = F.pmod(F.xxhash64("g"), F.lit(groups)).alias("k")
    mine = sources.join(lots, "g").select(group, F.pmod(F.xxhash64("root"), F.col("lots")).cast("int").alias("lot"), "root", F.lit(None).cast(kind).alias("a"), F.col("node").alias("b"), F.col("far").alias("w"), F.lit(True).alias("own"))
    theirs = edges.join(lots, "g").select(group, F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.lit(None).cast(kind).alias("root"), "a", "b", "w", "own")

    def search(table: pa.Table) -> pa.Table:
        ahead: dict = {}
        begin: dict = {}
        for root, a, b, w, own in zip(*(table[c].to_pylist() for c in ("root", "a", "b", "w", "own"))):
            if root is None:
                ahead.setdefault(a, []).append((b, w, own))
            else:
                begin.setdefault(root, []).append((w, b))
        roots, nodes, fars = [], [], []
        for root, found in begin.items():
            best: dict = {}
            heap = [(w, k, b) for k, (w, b) in enumerate(sorted(found, key=lambda x: x[0]))]
            n, out = len(heap), {}
            done = set()
            while heap:
                far, _, node = heapq.heappop(heap)
                if node in done:
                    continue
                done.add(node)
                if inside:
                    out[node] = far
                for b, w, own in ahead.get(node, ()):
                    if not own:
                        if not inside and out.get(b, far + w + 1) > far + w:
                            out[b] = far + w
                    elif b not in done and best.get(b, far + w + 1) > far + w:
                        best[b] = far + w
                        n += 1
                        heapq.heappush(heap, (far + w, n, b))
            roots += [root] * len(out)
            nodes += out.keys()
            fars += out.values()
        return pa.table([pa.array(roots, table["root"].type), pa.array(nodes, table["b"].type), pa.array(fars, pa.int64())], names=["root", "node", "far"])

    schema = StructType([sources.schema["root"], sources.schema["node"]]).add("far", "long")
    return mine.unionByName(theirs).groupBy("k", "lot").applyInArrow(search, schema)


def _least(rows: DataFrame) -> DataFrame:
    return rows.groupBy("root", "node").agg(F.min("far").alias("far"))


class Levels:
    """A history cut into blocks, level by level, for searches from given roots."""

    def __init__(self, edges: DataFrame, roots: DataFrame):
        places = heights(edges)
        alone = roots.select("node").distinct().join(places, "node", "left_anti").select("node", F.col("node").alias("tree"), F.lit(0).cast("long").alias("height"))
        self.places = stash(places.unionByName(alone))
        top, size = self.places.agg(F.coalesce(F.max("height"), F.lit(0)), F.count("*")).first()
        self.groups = max(size // GROUP, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        self.roots, self.edges, flat = roots, [], edges.select(F.col("child").alias("a"), F.col("parent").alias("b"), F.lit(1).cast("long").alias("w")).distinct()
        self.top, width = 0, 1
        while True:
            self.top, width = self.top + 1, width * BLOCK
            grouped = stash(self._cut(flat, self.top))
            self.edges.append(grouped)
            entries = grouped.where("NOT own").select(F.col("b").alias("node")).unionByName(roots.select("node")).distinct()
            sources = self.placed(entries, self.top).select("g", F.col("node").alias("root"), "node", F.lit(0).cast("long").alias("far"))
            flat = stash(_least(_searched(grouped, sources, False, self.groups)).select(F.col("root").alias("a"), F.col("node").alias("b"), F.col("far").alias("w")))
            if width > top:
                break
        self.flat = flat

    def block(self, level: int):
        return F.struct("tree", F.floor(F.col("height") / BLOCK**level).cast("long").alias("n")).alias("g")

    def placed(self, rows: DataFrame, level: int) -> DataFrame:
        """rows (node and others) with g, the block of a level that the node is in."""
        return rows.join(self.places.select("node", self.block(level)), "node")

    def _cut(self, flat: DataFrame, level: int) -> DataFrame:
        ends = self.places.select(F.col("node").alias("b"), self.block(level).alias("h"))
        return self.placed(flat.withColumnRenamed("a", "node"), level).join(ends, "b").select("g", F.col("node").alias("a"), "b", "w", (F.col("g") == F.col("h")).alias("own"))

    def entered(self, wanted: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
        """root, node, far: the nodes at the finest level that searches from the roots reach, in blocks that wanted leaves.

        Trees are gone through first: a round for each that lies behind another. wanted(rows, level) sees root, node, far and g of the entries of
        a level's blocks and keeps those of blocks to look into.
        """
        found = front = stash(self.roots.select("root", "node", F.lit(0).cast("long").alias("far")))
        while not front.isEmpty():
            step = front.join(self.flat, F.col("node") == F.col("a")).select("root", F.col("b").alias("node"), (F.col("far") + F.col("w")).alias("far"))
            step = _least(step)
            known = found.select(F.col("root").alias("r"), F.col("node").alias("n"), F.col("far").alias("f"))
            front = stash(step.join(known, (F.col("root") == F.col("r")) & (F.col("node") == F.col("n")) & (F.col("f") <= F.col("far")), "left_anti"))
            found = found.unionByName(front)
        found = _least(found)
        for level in range(self.top, 0, -1):
            sources = wanted(self.placed(found, level), level)
            found = stash(_least(_searched(self.edges[level - 1], sources.select("g", "root", "node", "far"), True, self.groups)))
        return found


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """root, node, depth: all nodes that the seeds (root, node) reach, the seeds at depth 0, each at its least depth.

    edges: child, parent (and ordinal). A parent that is no child itself ends its path; a seed without edges reaches itself.
    """
    return Levels(edges, seeds.select("root", "node").distinct()).entered(lambda rows, level: rows).withColumnRenamed("far", "depth")


def is_ancestor(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (ancestor, descendant) with is_ancestor; a node is its own ancestor. Only the blocks that the ancestor is in are looked into."""
    heads = pairs.select(F.col("descendant").alias("root"), F.col("descendant").alias("node")).distinct()
    levels = Levels(edges, heads)
    asked = pairs.select(F.col("descendant").alias("root"), F.col("ancestor").alias("node")).distinct()

    def wanted(rows: DataFrame, level: int) -> DataFrame:
        return rows.join(levels.placed(asked, level).select("root", "g").distinct(), ["root", "g"], "left_semi")

    hits = asked.join(levels.entered(wanted), ["root", "node"], "left_semi").select(F.col("root").alias("descendant"), F.col("node").alias("ancestor"), F.lit(True).alias("hit"))
    same = pairs.where("ancestor = descendant").select("descendant", "ancestor", F.lit(True).alias("hit"))
    return pairs.join(hits.unionByName(same).distinct(), ["ancestor", "descendant"], "left").withColumn("is_ancestor", F.coalesce("hit", F.lit(False))).drop("hit")


def merge_bases(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (ours, theirs) with base: the first ancestor of theirs, breadth first, that is ours' ancestor too; null if none.

    At each level the nearest entry that both reach bounds how far the base can be; blocks that theirs enters only beyond it, and those
    that one of the two never enters, are not looked into. Only pairs with several
    bases of one depth are walked generation by generation, for the order of the parents (ordinal) to decide.
    """
    asked = stash(pairs.select("ours", "theirs").distinct())
    heads = asked.select(F.col("ours").alias("root")).unionByName(asked.select(F.col("theirs").alias("root"))).distinct()
    levels = Levels(edges, heads.withColumn("node", F.col("root")))

    def met(rows: DataFrame, on: list[str]) -> DataFrame:
        up = asked.join(rows.withColumnRenamed("root", "theirs"), "theirs")
        return up.join(rows.select(F.col("root").alias("ours"), *on).distinct(), ["ours", *on])

    def wanted(rows: DataFrame, level: int) -> DataFrame:
        rows = stash(rows)
        bound = met(rows, ["node"]).groupBy("ours", "theirs").agg(F.min("far").alias("most"))
        blocks = met(rows, ["g"]).join(bound, ["ours", "theirs"], "left").where("most IS NULL OR far <= most").select("ours", "theirs", "g").distinct()
        keep = blocks.select(F.col("ours").alias("root"), "g").unionByName(blocks.select(F.col("theirs").alias("root"), "g")).distinct()
        return rows.join(keep, ["root", "g"], "left_semi")

    meet = stash(met(levels.entered(wanted), ["node"]).select("ours", "theirs", "node", F.col("far").alias("depth")))
    least = meet.groupBy("ours", "theirs").agg(F.min("depth").alias("depth"))
    meet = meet.join(least, ["ours", "theirs", "depth"])
    first = stash(meet.groupBy("ours", "theirs").agg(F.min("node").alias("base"), F.count("*").alias("n"), F.max("depth").alias("depth")))
    tied = first.where("n > 1").select("ours", "theirs", "depth")
    if not tied.isEmpty():
        order = ranks(edges, tied.groupBy(F.col("theirs").alias("root")).agg(F.max("depth").alias("depth")))
        chosen = meet.join(order.withColumnRenamed("root", "theirs"), ["theirs", "node", "depth"]).groupBy("ours", "theirs").agg(F.min_by("node", "rank").alias("chosen"))
        first = first.join(chosen, ["ours", "theirs"], "left").withColumn("base", F.coalesce("chosen", "base"))
    return pairs.join(first.select("ours", "theirs", "base"), ["ours", "theirs"], "left")


def ranks(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """root, node, depth, rank: the place of a node among those of its generation, as a queue would hold them, for roots (root, depth) down to that depth."""
    front = stash(roots.select("root", F.col("root").alias("node"), F.lit(0).cast("long").alias("depth"), F.lit(1).alias("rank"), F.col("depth").alias("most")))
    out, seen, depth = front, front.select("root", "node"), 0
    while not front.isEmpty():
        depth += 1
        step = front.where(F.col("most") >= depth).withColumnRenamed("node", "child").join(edges, "child")
        step = step.groupBy("root", F.col("parent").alias("node"), "most").agg(F.min(F.struct("rank", "ordinal")).alias("by")).join(seen, ["root", "node"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("root").orderBy("by", "node"))
        front = stash(step.select("root", "node", F.lit(depth).cast("long").alias("depth"), rank.alias("rank"), "most"))
        out, seen = out.unionByName(front), seen.unionByName(front.select("root", "node"))
        if depth % 16 == 0:
            out, seen = stash(out), stash(seen)
    return out.drop("most")
