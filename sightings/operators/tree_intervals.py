"""Trees numbered in pre-order, so that "below any of these nodes" is a range on one whole number.

A node has ``first``, its place in pre-order, and ``last``, the largest place below it.  Rows that carry their node's
``first`` are filtered by ranges of a plain column, which reach the scan; with rows sorted by it, row groups are skipped.

Numbering is three joins and sorts for any tree: paths from the root by doubling, the order of all paths by ranges of
them, and the number of nodes below by counting path members.  No task holds the tree, a level of it or one
parent's children.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightings.session import staged

# Levels of a tree at most; what lies deeper, or in a circle, has no path and is reported.
MAX_DEPTH = 512
# Ranges of a filter that are written as comparisons; more of them become a join.
RANGES = 1000


def paths(nodes: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(nodeid, path) with the ids from the root to the node, for rows (nodeid, parentid) of a forest.

    A node whose parent isn't there is a root.  Every round follows twice as many levels.
    """
    known = nodes.select(F.col("nodeid").alias("top")).distinct()
    linked = nodes.select("nodeid", F.col("parentid").alias("top")).distinct().join(known.withColumn("there", F.lit(True)), "top", "left")
    state = linked.select("nodeid", F.when(F.col("there"), F.col("top")).alias("top"), F.array("nodeid").alias("path"))
    state, reach = staged(state, "paths"), 1
    while reach < max_depth and not state.where("top is not null").isEmpty():
        above = state.select(F.col("nodeid").alias("at"), F.col("top").alias("next"), F.col("path").alias("before"))
        open_rows = state.where("top is not null").join(above, F.col("top") == F.col("at"))
        grown = open_rows.select("nodeid", F.col("next").alias("top"), F.concat("before", "path").alias("path"))
        state = staged(state.where("top is null").unionByName(grown), "paths")
        reach *= 2
    lost = state.where("top is not null").limit(1).collect()
    if lost:
        raise ValueError(f"node {lost[0].nodeid!r} stands in a circle or below {max_depth} levels")
    return state.select("nodeid", "path")


def places(rows: DataFrame, order: str, name: str = "first") -> DataFrame:
    """Rows with their place in the order of a column, from 1, by a sort over ranges of it; written once."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, order).sortWithinPartitions(order)
    marked = staged(ranged.withColumn("_number", F.monotonically_increasing_id()), "ranges")  # partition and place in it
    part, inside = F.shiftright("_number", 33), F.col("_number").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(marked.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row a partition
    before, starts = 1, []
    for number, n in sizes:
        starts.append((number, before))
        before += n
    start = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part bigint, _start bigint"))
    return marked.join(start, part == F.col("_part")).withColumn(name, F.col("_start") + inside).drop("_number", "_part", "_start")


def numbered_tree(nodes: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(nodeid, parentid, depth, first, last) of rows (nodeid, parentid); children stand in the order of their ids."""
    found = places(paths(nodes, max_depth), "path")
    below = found.select(F.explode("path").alias("nodeid")).groupBy("nodeid").agg(F.count("*").alias("size"))
    parent = F.when(F.size("path") > 1, F.element_at("path", -2))
    own = found.select("nodeid", parent.alias("parentid"), F.size("path").alias("depth"), "first")
    return own.join(below, "nodeid").select("nodeid", "parentid", "depth", "first", (F.col("first") + F.col("size") - 1).alias("last"))


def merged(ranges: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, without overlaps and gaps of nothing."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(out[-1][1], last)
        else:
            out.append((first, last))
    return out


def in_ranges(column: Column, ranges: Sequence[tuple[int, int]]) -> Column:
    """Plain comparisons that reach the scan; false for no range."""
    return reduce(or_, [column.between(first, last) for first, last in merged(ranges)], F.lit(False)) if ranges else F.lit(False)


def below(df: DataFrame, column: str, tree: DataFrame, wanted: Column) -> DataFrame:
    """Rows of df whose node, named by its ``first`` in a column, is or lies below a node of the tree that is wanted."""
    chosen = tree.where(wanted).select("first", "last")
    ranges = [(r.first_, r.last_) for r in chosen.toDF("first_", "last_").limit(RANGES + 1).collect()]
    if len(ranges) <= RANGES:
        return df.where(in_ranges(F.col(column), ranges))
    # too many for comparisons: the places below them are the keys of a semi join
    keys = chosen.select(F.explode(F.sequence("first", "last")).alias("_place")).distinct()
    return df.join(keys, F.col(column) == F.col("_place"), "left_semi")


def counts_above(df: DataFrame, column: str, tree: DataFrame, wanted: Column) -> DataFrame:
    """(nodeid, count): rows of df at or below each wanted node.

    Rows are counted by node first; a count then goes to the node's ancestors, of which there are as many as levels.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_at")).agg(F.count("*").alias("_n"))
    up = paths(tree.select("nodeid", "parentid")).join(tree.select("nodeid", "first"), "nodeid")
    each = counted.join(up, F.col("_at") == F.col("first")).select(F.explode("path").alias("nodeid"), "_n")
    summed = each.groupBy("nodeid").agg(F.sum("_n").alias("count"))
    return summed.join(tree.where(wanted).select("nodeid"), "nodeid", "left_semi")


def move_subtree(tree: DataFrame, node: str, parent: str) -> tuple[DataFrame, Callable[[Column], Column]]:
    """The tree with a node and all below it as the last child of another parent, and how to renumber places.

    Only places between the old and the new position change, by adding a constant: a table that carries them is
    rewritten in that range alone.
    """
    found = {r.nodeid: r for r in tree.where(F.col("nodeid").isin(node, parent)).collect()}
    if node not in found or parent not in found:
        raise ValueError("both nodes must be in the tree")
    a, b, end = found[node].first, found[node].last, found[parent].last
    if a <= found[parent].first <= b:
        raise ValueError("a subtree can't move below itself")
    size = b - a + 1
    low, high = (b + 1, end) if end >= b else (end + 1, a - 1)  # places that make room
    room, shift = (-size, end - b) if end >= b else (size, end + 1 - a)

    def renumber(place: Column) -> Column:
        return F.when(place.between(a, b), place + shift).when(place.between(low, high), place + room).otherwise(place)

    old_above = (F.col("first") < a) & (F.col("last") >= b)
    new_above = (F.col("first") <= found[parent].first) & (F.col("last") >= end)
    grown = F.when(new_above & ~old_above, F.lit(size)).when(old_above & ~new_above, F.lit(-size)).otherwise(F.lit(0))
    inside = F.col("first").between(a, b)
    first = renumber(F.col("first"))
    return tree.select(
        "nodeid",
        F.when(F.col("nodeid") == node, F.lit(parent)).otherwise(F.col("parentid")).alias("parentid"),
        F.when(inside, F.col("depth") + found[parent].depth + 1 - found[node].depth).otherwise(F.col("depth")).alias("depth"),
        first.alias("first"),
        (first + (F.col("last") - F.col("first")) + grown).alias("last"),
    ), renumber
