"""Parent-child links to full hierarchies (p5).

Method: nested sets. Subtree sizes are computed upward, sibling preorder ranges are allocated
by prefix sums downward, and everything else is read off the ranges: a node's depth is the number
of ranges around its position and its root the last root that begins at or before it, both by
prefix sums over the positions; ancestors and descendants by a join of ranges and positions.
Nodes the upward pass never finishes are on a cycle or below one.

Both passes double their reach in each round (a node's pointer jumps to its pointer's
pointer), so a tree of depth D takes about log2(D) rounds, and only nodes that are not yet
finished take part in a round. Rounds are written to the shared folder. Pointers at a hot node are
cut into parts (:func:`quillspark.shared.spread_join`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.shared import Scratch, heavy_list, salt_of, salts_for, spread_join
from quillspark.tables import current_pages, page_key, read


@dataclass
class Hierarchy:
    """``nodes``: ``id, parent, root, depth, pre, size[, path]``; a cyclic node has root '', depth -1 and null pre and size.

    The descendants of a node are those with ``pre`` in ``(pre, pre + size)``; ``pre`` is unique over the whole forest.
    """

    nodes: DataFrame

    def descendants(self, of: DataFrame, bits: int = 6) -> DataFrame:
        """Pairs ``ancestor, id`` for the ids in ``of`` (column ``id``), by range.

        Each range is cut into aligned blocks of ``2**bits`` positions and joined on the block, so
        the work follows the output. Ids without node give nothing.
        """
        return _pairs(self.nodes.filter("depth >= 0"), of, bits).select("ancestor", "id")


def _pairs(tree: DataFrame, of: DataFrame | None, bits: int) -> DataFrame:
    """``ancestor, a_pre, id`` of the nodes ``id, pre, size`` in ``tree``."""
    wanted = tree if of is None else of.select("id").distinct().join(tree, "id")
    ranges = wanted.filter("size > 1").select(F.col("id").alias("ancestor"), F.col("pre").alias("a_pre"), (F.col("pre") + F.col("size")).alias("a_end"))
    blocks = ranges.withColumn(
        "block", F.explode(F.sequence(F.shiftright(F.col("a_pre") + 1, bits), F.shiftright(F.col("a_end") - 1, bits)))
    )
    points = tree.select("id", "pre", F.shiftright("pre", bits).alias("block"))
    return points.join(blocks, "block").filter("pre > a_pre AND pre < a_end").select("ancestor", "a_pre", "id")


def _sizes_upward(scratch: Scratch, links: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(``n, gain``: descendants of each node; ``n``: nodes on or below a cycle; what was written) of ``links`` (``n, up``, both set).

    In round k a node's pointer is its 2^k-th ancestor and its size counts the descendants nearer
    than 2^k; it adds its size to the pointer's. A node whose pointer has none is finished. If a
    round finishes no node, no tree node is left, as depths have no gaps: the rest is cyclic.
    """
    active, left = scratch.put_counted(links.withColumn("size", F.lit(1).cast("long")))
    gains, used = [], [active]
    while left:
        gain = active.groupBy(F.col("up").alias("n")).agg(F.sum("size").alias("gain"))
        gains.append(gain)
        jump = active.select(F.col("n").alias("up"), F.col("up").alias("j_up"))
        nxt, still = scratch.put_counted(
            spread_join(active, jump, "up", heavy_list(active, "up", left))
            .join(gain, "n", "left")
            .select("n", F.col("j_up").alias("up"), (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size"))
        )
        active, before, left = nxt, left, still
        used.append(active)
        if left == before:
            break
    total = active.select("n", F.lit(0).cast("long").alias("gain"))
    for g in gains:
        total = total.unionByName(g)
    return total.groupBy("n").agg(F.sum("gain").alias("gain")), active.select("n"), used


def _sums_downward(scratch: Scratch, start: DataFrame, value: str, keep: list[str]) -> DataFrame:
    """``start`` (``n, up, value``; a forest) with ``value`` summed along the path from the root; ``keep`` is passed on."""
    state, left = scratch.put_counted(start)
    done, active = [state.filter("up IS NULL")], state.filter("up IS NOT NULL")
    left = active.count()  # of a written column of longs
    while left:
        known = active.select("n", "up", value)
        for part in done:
            known = known.unionByName(part.select("n", "up", value))
        above = known.select(F.col("n").alias("up"), F.col("up").alias("t_up"), F.col(value).alias("t_value"))
        moved = scratch.put(
            spread_join(active, above, "up", heavy_list(active, "up", left)).select(
                "n", F.col("t_up").alias("up"), (F.col(value) + F.col("t_value")).alias(value), *keep
            )
        )
        done.append(moved.filter("up IS NULL"))
        active = moved.filter("up IS NOT NULL")
        left = active.count()
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("up")


def _depths_and_roots(placed: DataFrame, total: int, pieces: int) -> DataFrame:
    """``n, pre, size, depth, root`` of ``n, pre, size, root_id`` (``root_id`` set at the roots) by prefix sums over positions.

    At position p, p + 1 ranges have begun, so the depth is p minus the ranges that have ended. The positions
    0 .. ``total`` - 1 are cut into ``pieces`` equal blocks; what comes before a block is one row per block.
    """
    block = max(-(-total // pieces), 1)
    begin = placed.select(F.col("pre").alias("at"), F.lit(1).alias("begins"), "n", "size", "root_id")
    end = placed.select((F.col("pre") + F.col("size")).alias("at"), F.lit(0).alias("begins"), F.lit(None).cast("long").alias("n"), "size", F.lit(None).cast("string").alias("root_id"))
    events = begin.unionByName(end.filter(F.col("at") < total)).withColumn("block", F.floor(F.col("at") / block))
    sums = events.groupBy("block").agg(
        F.count_if(F.col("begins") == 0).alias("ends"), F.max(F.when(F.col("root_id").isNotNull(), F.struct("at", "root_id"))).alias("last")
    )
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # at most ``pieces`` rows
    carried = sums.select("block", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("ended"), F.max("last").over(before)["root_id"].alias("root_before"))
    within = Window.partitionBy("block").orderBy("at", "begins").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = events.select(
        "*", F.sum(1 - F.col("begins")).over(within).alias("here"), F.last("root_id", ignorenulls=True).over(within).alias("root_here")
    )
    return inside.filter("begins = 1").join(F.broadcast(carried), "block").select(
        "n", F.col("at").alias("pre"), "size", (F.col("at") - F.col("ended") - F.col("here")).cast("int").alias("depth"),
        F.coalesce("root_here", "root_before").alias("root"),
    )


def build(links: DataFrame, node: str = "id", parent: str = "parent", with_path: bool = False, salts: int | None = None) -> Hierarchy:
    """Hierarchy of ``links`` (one row per node with its parent's id).

    A null or empty parent, or one that is no node, makes a root. Null and empty node ids are
    left out; of repeated nodes the one with the greatest parent counts; other columns are
    ignored. Siblings are ordered by (hash salt, number), so a parent of a third of all nodes
    spreads over ``salts`` tasks. ``with_path`` adds the ids from the root to the node, found by range.
    """
    spark = links.sparkSession
    scratch = Scratch(spark)
    pieces = salts or salts_for(spark)
    nodes, count = scratch.put_counted(
        links.filter(F.coalesce(F.col(node), F.lit("")) != "")
        .groupBy(F.col(node).alias("id"))
        .agg(F.max(parent).alias("parent"))
        .withColumn("n", F.monotonically_increasing_id())
    )
    keys = nodes.select(F.col("id").alias("parent"), F.col("n").alias("up"))
    named = nodes.filter("parent <> ''")
    linked = scratch.put(
        spread_join(named, keys, "parent", heavy_list(named, "parent", count), "left").select("id", "n", "up").unionByName(
            nodes.filter("coalesce(parent, '') = ''").select("id", "n", F.lit(None).cast("long").alias("up"))
        )
    )

    # upward; a node that neither gains nor is cyclic has no child
    gains, cyclic, used = _sizes_upward(scratch, linked.filter("up IS NOT NULL"))
    tree, total = scratch.put_counted(
        linked.join(cyclic, "n", "left_anti")
        .join(gains, "n", "left")
        .select("n", F.col("up").alias("parent_n"), (F.coalesce("gain", F.lit(0)) + 1).alias("size"), F.when(F.col("up").isNull(), F.col("id")).alias("root_id"))
    )

    scratch.drop(linked, *used)

    # downward: offset among the siblings by exact prefix sums, in (parent, salt) blocks;
    # the roots are the children of one imaginary node
    salted = tree.withColumn("salt", salt_of("n", salts=pieces)).withColumn("p", F.coalesce("parent_n", F.lit(-1)))
    totals = salted.groupBy("p", "salt").agg(F.sum("size").alias("s"))
    before = Window.partitionBy("p").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("p", "salt", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("off"))
    within = Window.partitionBy("p", "salt").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    start = (
        salted.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(offsets, ["p", "salt"])
        .select("n", F.col("parent_n").alias("up"), "size", "root_id", (F.col("own") + F.col("off") + F.when(F.col("parent_n").isNull(), 0).otherwise(1)).alias("pre"))
    )
    placed = _sums_downward(scratch, start, "pre", ["size", "root_id"])
    ranged = _depths_and_roots(placed, total, pieces)
    joined = nodes.join(ranged, "n", "left").select(
        "id", "parent", F.coalesce("root", F.lit("")).alias("root"), F.coalesce("depth", F.lit(-1)).alias("depth"), "pre", "size"
    )
    if with_path:
        joined = scratch.put(joined)
        above = _pairs(joined.filter("depth >= 0"), None, 6).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("a_pre", "ancestor"))).alias("above"))
        path = F.concat(F.coalesce(F.transform("above", lambda x: x["ancestor"]), F.array().cast("array<string>")), F.array("id"))
        joined = joined.join(above, "id", "left").withColumn("path", F.when(F.col("depth") >= 0, path)).drop("above")
    return Hierarchy(joined)


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, parent`` of the current pages; parents of another kind than a page count as none."""
    kind = F.lower(F.trim(F.coalesce("parent_type", F.lit(""))))
    cur = current_pages(
        read(spark, sf_dir, "pages"), {"parent": F.when(kind.isin("", "page_id"), page_key("parent_id")).otherwise("")}
    )
    return cur.select(F.col("page_id").alias("id"), "parent")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = build(page_links(spark, sf_dir)).nodes
    return nodes.select(F.col("id").alias("page_id"), F.col("root").alias("root_id"), "depth")


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path from the root and number of descendants of every page that reaches a root."""
    nodes = build(page_links(spark, sf_dir), with_path=True).nodes.filter("depth >= 0")
    return nodes.select(F.col("id").alias("page_id"), F.array_join("path", "/").alias("path"), (F.col("size") - 1).alias("n_descendants"))


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All (ancestor, descendant) pairs of the page trees, inner pages as ancestors too."""
    tree = build(page_links(spark, sf_dir)).nodes.filter("depth >= 0")
    return _pairs(Scratch(spark).put(tree), None, 6).select(F.col("ancestor").alias("ancestor_id"), F.col("id").alias("page_id"))
