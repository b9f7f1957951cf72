"""Merkle manifests of a table: a digest a row, a tree a group, one tree over the groups, and a proof for every row.

Levels are built bottom up: rows get indices by row_number (within ranges of the order, plus the rows of earlier
ranges, so that no task numbers a whole group), indices are divided by the fanout, the sorted children of each run
are hashed into their parent, until one node a group is left. Those subroots go through the same levels once more.
Then joins lead from the root down, level by level: each appends the siblings of a node to the path of its parent.
A level holds an eighth of the rows of the one below, and only leaves carry row data.

Cases: a null field is hashed as "-", so null and empty differ; a null group is a group, the first one; rows without
an order key come first; ties are ordered by digest, so equal rows have equal digests, in any order, and each has a
proof of its own place; a group of one row is its own subroot; an empty table gives an empty result; columns that are
not asked for do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import written

FANOUT = 8
NO_GROUP, GROUP_MARK = "", "="
PATH_TYPE = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """How a value is hashed: "-" for null, else its length in UTF-8 bytes, ":" and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest_of(*values: Column) -> Column:
    """Hex SHA-256 of values, so written that different rows never read alike."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def group_key(value: Column) -> Column:
    """A key that is never null and sorts as the group does, null first."""
    return F.when(value.isNull(), F.lit(NO_GROUP)).otherwise(F.concat(F.lit(GROUP_MARK), value.cast("string")))


def indexed(rows: DataFrame, order: Sequence[str], tag: str) -> DataFrame:
    """rows(key, ...) with idx, their place among the rows of a key (from 0), and n, the number of these.

    Rows are dealt by ranges of (key, order), numbered within key and range, and moved on by the counts of the earlier ranges;
    a last sort key deals equal rows too."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("key"), *[F.col(c).asc_nulls_first() for c in order]]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys, F.col("_tie"))
    ranged = written(dealt.withColumn("part", F.spark_partition_id()).drop("_tie"), tag)  # one sampling of ranges for all readers
    by_key = Window.partitionBy("key")
    counts = ranged.groupBy("key", "part").agg(F.count(F.lit(1)).alias("here"))  # a row a range and key at most
    earlier = F.sum("here").over(by_key.orderBy("part")) - F.col("here")
    counts = counts.select("key", "part", earlier.alias("earlier"), F.sum("here").over(by_key).alias("n"))
    place = F.row_number().over(Window.partitionBy("key", "part").orderBy(*keys[1:]))
    return ranged.join(counts, ["key", "part"]).withColumn("idx", place - 1 + F.col("earlier")).drop("part", "earlier")


@dataclass
class Tree:
    """Runs of siblings by level (key, run, n, children, digest of the run's parent) and one root a key with its height."""

    runs: list[DataFrame]
    roots: DataFrame
    fanout: int


def grown(nodes: DataFrame, fanout: int, tag: str) -> Tree:
    """The trees over nodes(key, idx, n, node struct with a digest). A lone node is its own root, of height 0."""
    runs, roots, height = [], [], 0
    while True:
        grouped = nodes.groupBy("key", F.floor(F.col("idx") / fanout).cast("long").alias("run"), "n").agg(
            F.sort_array(F.collect_list(F.struct("idx", "node"))).alias("children")
        )
        joined = F.array_join(F.transform("children", lambda c: c["node"]["digest"]), "")
        lone = F.lit(height == 0) & (F.col("n") == 1)
        level = grouped.withColumn("digest", F.when(lone, F.col("children")[0]["node"]["digest"]).otherwise(F.sha2(joined, 256)))
        level = written(level, f"{tag}-level-{height}")
        runs.append(level)
        roots.append(level.filter(F.col("n") <= fanout).select("key", "digest", F.when(F.col("n") == 1, 0).otherwise(height + 1).alias("height")))
        if height == 0:
            most = level.agg(F.max("n")).first()[0] or 0
        if most <= fanout:
            break
        most = -(-most // fanout)
        nodes = level.filter(F.col("n") > fanout).select(
            "key", F.col("run").alias("idx"), F.ceil(F.col("n") / fanout).cast("long").alias("n"), F.struct("digest").alias("node")
        )
        height += 1
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return Tree(runs, written(found, f"{tag}-roots"), fanout)


def descended(tree: Tree, tops: DataFrame, carried: Sequence[str]) -> DataFrame:
    """(key, node, path, *carried) of every leaf. tops: (key, path, *carried) of the roots; a path holds what stands left and
    right of a node among its siblings, from its own level upward."""
    tops = tops.join(tree.roots.select("key", "height"), "key").withColumn("run", F.lit(0).cast("long"))
    above = None
    for level in range(len(tree.runs) - 1, -1, -1):
        ends = tops.filter((F.col("height") == level + 1) | (F.lit(level == 0) & (F.col("height") == 0))).drop("height")
        parents = ends if above is None else above.unionByName(ends)
        runs = tree.runs[level].select("key", "run", "n", "children")
        opened = runs.join(parents, ["key", "run"]).select("key", "n", "path", *carried, "children", F.posexplode("children").alias("at", "child"))
        texts = lambda a, n: F.array_join(F.transform(F.slice("children", a, n), lambda c: c["node"]["digest"]), "")
        sides = F.struct(texts(F.lit(1), F.col("at")).alias("left"), texts(F.col("at") + 2, F.lit(tree.fanout)).alias("right"))
        path = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.array(sides), F.col("path"))) if level == 0 else F.concat(F.array(sides), F.col("path"))
        below = opened.select("key", F.col("child.idx").alias("run"), F.col("child.node").alias("node"), path.alias("path"), *carried)
        above = below.drop("node")
    return below.drop("run")


def manifest(rows: DataFrame, group: str, order: Sequence[str], digest: str = "digest", fanout: int = FANOUT) -> DataFrame:
    """rows with subroot, root and path (columns of these names are replaced).

    rows has a column of hex digests; `order` sorts within the group, ties by digest. `path` lists the digests of siblings left
    and right of the row's node, level by level up to the root."""
    names = [c for c in rows.columns if c not in ("subroot", "root", "path")]
    node = F.struct(F.col(digest).alias("digest"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    at = [f"_order{i}" for i in range(len(order))]
    leaves = rows.select(group_key(F.col(group)).alias("key"), *[F.col(c).alias(a) for c, a in zip(order, at, strict=True)], F.col(digest).alias("_digest"), node.alias("node"))
    leaves = written(leaves, "merkle-leaves")  # texts are hashed once, not again for the sample of ranges
    tree = grown(indexed(leaves, [*at, "_digest"], "merkle-ranges").select("key", "idx", "n", "node"), fanout, "merkle")
    groups = tree.roots.select(F.lit(NO_GROUP).alias("key"), F.col("key").alias("_group"), F.struct("digest", F.col("key").alias("group")).alias("node"))
    top = grown(indexed(groups, ["_group"], "merkle-groups").select("key", "idx", "n", "node"), fanout, "merkle-top")
    start = top.roots.select("key", F.col("digest").alias("root"), F.array().cast(PATH_TYPE).alias("path"))
    subroots = descended(top, start, ["root"]).select(F.col("node.group").alias("key"), F.col("node.digest").alias("subroot"), "root", "path")
    found = descended(tree, subroots, ["subroot", "root"])
    return found.select(*[F.col(f"node.row.`{c}`").alias(c) for c in names], "subroot", "root", "path")


def proof_text(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(digest: Column, path: Column) -> Column:
    """The root that follows from a row's digest and its path."""
    return F.aggregate(path, digest, lambda below, s: F.sha2(F.concat(s["left"], below, s["right"]), 256))
