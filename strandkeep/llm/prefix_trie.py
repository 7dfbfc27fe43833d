"""The prefix trie of conversations.

A node stands for the first turns that some conversations share. Each partition walks its conversations and
emits a trie of its own as a table: nodes, keyed by a hash chained over the turns, with their members counted,
and the lists of those that end there. Tables are mergeable: the nodes of some partitions are merged, then those of all.

Every node belongs to its smallest member, and those of one member stand one below the other: a path. A path
hangs from a node of a smaller member's path, so the trie is a tree of paths, and it is rolled up bottom-up:
path by path in rounds, then from the end of each path to its top. There are as many rounds as paths hang from
each other, whatever the paths' lengths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandkeep.llm import common

ROOT = bytes(32)
#: Nodes and ends that a task holds before it emits what it has.
HELD = 100_000
#: Conversations that end at one node lie in pieces of ids that agree but for so many low bits.
LOW_BITS = 12
#: Groups of partitions whose tables are merged first.
LOTS = 64
_PARTIAL = "lot int, node binary, parent binary, depth long, words long, n_convs long, conv_id long, piece long, ends array<long>"


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 1), key (a hash of role and text), words of all turns with a conv_id, null turns first, equal ones by role and text."""
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("at"), key.alias("key"), common.n_words("text").alias("words"))


def rebuilt(turns: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """conv_id, part, at, key, words: of ordered turns those of every conversation with the first h taken from its group's first; a row of part -1 opens each.

    h is the CRC32 of the id in decimal modulo heads. A group's first conversation may be missing or shorter, and an own one too.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    turns = common.stash(turns)
    convs = turns.where("at = 1").select("conv_id", h.alias("h"))
    head = turns.where(F.col("at") < heads).withColumnRenamed("conv_id", "head")
    lent = convs.withColumn("head", F.col("conv_id") - F.col("conv_id") % group).join(head, "head").where("at <= h")
    nothing = [F.lit(0).cast("long").alias("at"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("words")]
    opened = convs.select("conv_id", F.lit(-1).alias("part"), *nothing)
    rows = opened.unionByName(lent.select("conv_id", F.lit(0).alias("part"), "at", "key", "words"))
    return rows.unionByName(turns.where(F.col("at") > h).select("conv_id", F.lit(1).alias("part"), "at", "key", "words"))


def partial_tries(steps: DataFrame) -> DataFrame:
    """The tries of the partitions over steps (conv_id, part, at, key, words) as one table: rows of nodes, and rows of ends with their ids.

    A task holds HELD nodes and ends at most; what it has then becomes a table of its own.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, nodes, ends, held = TaskContext.get().partitionId() % LOTS, {}, {}, 0
        conv, node, depth = None, ROOT, 0

        def table() -> pa.RecordBatch:
            rows = [(lot, k, *v, None, None) for k, v in nodes.items()] + [(lot, k, None, None, None, None, None, piece, ids) for (k, piece), ids in ends.items()]
            kinds = [pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 5, pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _PARTIAL.split(", ")])

        def ended() -> None:
            ends.setdefault((node, conv >> LOW_BITS), []).append(conv)

        for batch in batches:
            for c, part, key, words in zip(*(batch[x].to_pylist() for x in ("conv_id", "part", "key", "words"))):
                if part < 0:
                    if conv is not None:
                        ended()
                    conv, node, parent, depth = c, ROOT, None, 0
                else:
                    parent, node, depth = node, hashlib.sha256(node + key).digest(), depth + 1
                here = nodes.get(node)
                if here is None:
                    nodes[node] = [parent, depth, words, 1, conv]
                else:
                    here[3] += 1
                    here[4] = min(here[4], conv)
                held += part < 0
                if len(nodes) + held > HELD:
                    yield table()
                    nodes, ends, held = {}, {}, 0
        if conv is not None:
            ended()
        if nodes or ends:
            yield table()

    rows = steps.repartition("conv_id").sortWithinPartitions("conv_id", "part", "at")
    return common.stash(rows.mapInArrow(common.lean(walk), _PARTIAL))


def merged(nodes: DataFrame, *keys: str) -> DataFrame:
    """Tables of nodes merged by keys: members are added up, the smallest stays."""
    same = [F.first(c).alias(c) for c in ("parent", "depth", "words")]
    return nodes.groupBy(*keys).agg(*same, F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))


def ends_of(partial: DataFrame) -> DataFrame:
    """node, sha256 of the ids of the conversations that end there, ascending: lists are merged piece by piece, and pieces hashed in order."""
    pieces = partial.where("ends IS NOT NULL").groupBy("node", "piece").agg(F.array_sort(F.flatten(F.collect_list("ends"))).alias("ends"))
    return common.sha256_in_order(pieces.withColumn("text", F.array_join(F.col("ends").cast("array<string>"), ",")), ["node"], ["piece"], "text", ",")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """Merged nodes (node, parent, depth, words, n_convs, conv_id) with parent_conv_id, n_children, n_leaves, saved_tokens."""
    owner = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("up"))
    own = (F.col("n_convs") - 1) * F.col("words")
    paths = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("depth").alias("last"), F.min_by("parent", "depth").alias("parent"), F.sum(own).alias("saved"))
    paths = common.stash(paths.join(owner, "parent", "left").select("conv_id", "up", (F.col("top") - 1).alias("at"), "last", "saved"))
    hung = paths.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(F.count("*").alias("hung"))
    leafless = hung.select("conv_id", F.col("depth").alias("last"), F.lit(0).alias("leaves"))
    paths = paths.join(leafless, ["conv_id", "last"], "left").select("conv_id", "up", "at", "saved", F.coalesce("leaves", F.lit(1)).cast("long").alias("leaves"))
    paths = common.stash(paths)
    levels = [common.stash(paths.where("up IS NULL"))]
    while not levels[-1].isEmpty():
        above = levels[-1].select(F.col("conv_id").alias("up"))
        levels.append(common.stash(paths.join(above, "up").select(paths.columns)))
    totals = total = levels.pop()
    for level in reversed(levels):
        below = total.groupBy(F.col("up").alias("conv_id")).agg(F.sum("saved").alias("more"), F.sum("leaves").alias("ends"))
        total = level.join(below, "conv_id", "left").select("conv_id", "up", "at", (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("ends", F.lit(0))).alias("leaves"))
        total = common.stash(total)
        totals = totals.unionByName(total)
    hanging = totals.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(F.count("*").alias("hung"), F.sum("saved").alias("more"), F.sum("leaves").alias("ends"))
    up = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    here = nodes.join(hanging, ["conv_id", "depth"], "left").withColumn("last", F.row_number().over(up) == 1)
    zero = F.lit(0)
    children = F.coalesce("hung", zero) + F.when(F.col("last"), 0).otherwise(1)
    below = up.rowsBetween(Window.unboundedPreceding, 0)
    here = here.withColumns({"n_children": children.cast("long"), "first_depth": F.min("depth").over(Window.partitionBy("conv_id"))})
    here = here.withColumns({
        "n_leaves": F.sum(F.coalesce("ends", zero) + F.when(F.col("n_children") == 0, 1).otherwise(0)).over(below),
        "saved_tokens": F.sum(F.coalesce("more", zero) + own).over(below),
    })
    tops = paths.select("conv_id", "up")
    here = here.join(tops, "conv_id").withColumn("parent_conv_id", F.when(F.col("depth") == F.col("first_depth"), F.col("up")).otherwise(F.col("conv_id")))
    return here.drop("hung", "more", "ends", "last", "first_depth", "up")


def trie(steps: DataFrame) -> DataFrame:
    """The trie of conversations given as steps: conv_id (its smallest member), depth, parent_conv_id, words, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    A conversation is walked turn by turn in one task, some 60 bytes a turn; no group of conversations meets in one. Without conversations there is
    no node, not even the root.
    """
    partial = partial_tries(steps)
    nodes = merged(merged(partial.where("ends IS NULL"), "node", "lot"), "node")
    out = rolled_up(common.stash(nodes)).join(ends_of(partial), "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "words", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations.

    Null roles and texts are empty; turns that are null come first, equal ones stand in the order of role and text, repeated rows
    count as turns. Rows without a conv_id belong to no conversation. Other columns are left out.
    """
    return trie(rebuilt(ordered(common.table(spark, sf_dir, "conversations")))).drop("words")


QUERIES = {"op13_prefix_trie": op13_prefix_trie}

#: The CRC32 register of a value in decimal, before its last exclusive or.
CRC_SQL = """list_reduce(list_transform(range(len(CAST({x} AS VARCHAR))), lambda i: ord(substr(CAST({x} AS VARCHAR), CAST(i + 1 AS BIGINT), 1))::BIGINT),
        lambda c, b: list_reduce(range(8), lambda d, k: xor(d >> 1, 3988292384 * (d & 1)), xor(c, b)), 4294967295::BIGINT)"""

ORACLES = {
    "op13_prefix_trie": f"""WITH RECURSIVE t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
            FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, xor({CRC_SQL.format(x="conv_id")}, 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
        s AS (SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND pos <= h UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos > h),
        r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, role, text FROM s),
        p AS (SELECT conv_id, CAST(0 AS BIGINT) AS depth, sha256('') AS node, CAST(NULL AS VARCHAR) AS parent, CAST(0 AS BIGINT) AS words FROM c
            UNION ALL SELECT p.conv_id, r.depth, sha256(p.node || strlen(r.role) || ':' || r.role || r.text), p.node, len(regexp_extract_all(r.text, '[^\\x20\\x09-\\x0D]+')) FROM p JOIN r ON r.conv_id = p.conv_id AND r.depth = p.depth + 1),
        n AS (SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs FROM p GROUP BY node),
        k AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
        under AS (SELECT DISTINCT a.node AS top, b.node FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
        sums AS (SELECT top, count(*) FILTER (k.n_children IS NULL) AS n_leaves, CAST(sum((n.n_convs - 1) * n.words) AS BIGINT) AS saved_tokens FROM under JOIN n USING (node) LEFT JOIN k USING (node) GROUP BY top),
        last AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
        e AS (SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM p JOIN last USING (conv_id, depth) GROUP BY node)
        SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
        FROM n LEFT JOIN n u ON u.node = n.parent LEFT JOIN k ON k.node = n.node JOIN sums ON sums.top = n.node LEFT JOIN e ON e.node = n.node""",
}
