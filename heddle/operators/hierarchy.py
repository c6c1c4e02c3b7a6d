"""Parent-child links to full hierarchies.

Level-wise frontier joins walk down from the roots and extend path and depth by one
level a round.  Rows that no root reaches hang below a cycle; only on this residue
cycles are labelled, by doubling pointers and carrying the smallest id passed.

Defined cases: a null, empty or unknown parent means "none" (the node is a root); rows
with a null id are left out; repeated rows of one node count once, and where copies
name different parents the smallest known one holds (nulls last); an empty table gives
empty results; further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from heddle.operators import rounds
from heddle.session import keep



def parent_links(nodes: DataFrame, id_col: str = "node_id", parent_col: str = "parent_node_id") -> DataFrame:
    """(id, parent) with one row per id; parents that name no existing id become null."""
    raw = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent")).where("id is not null")
    one = raw.groupBy("id").agg(F.min("parent").alias("parent"))
    known = one.select(F.col("id").alias("known"))
    return one.join(known, one.parent == known.known, "left").select("id", F.col("known").alias("parent"))


@dataclass
class Levels:
    """levels: (id, depth, root, path) of every reached node; rest: (id, parent) of the others."""

    levels: DataFrame
    rest: DataFrame


def walk_levels(links: DataFrame, with_path: bool = True) -> Levels:
    """Walk from the roots downwards, one join a level.

    links: (id, parent).  Each level joins the last frontier with the links on the
    parent; an id has one parent, so no row is met twice and the walk ends by itself.
    After the first levels the links not yet reached are written anew, so that the later
    rounds, whose frontiers are small, no longer scan the whole table.
    """
    links = keep(links, "links")
    start = links.where("parent is null").select(
        "id", F.lit(0).alias("depth"), F.col("id").alias("root"), *([F.array("id").alias("path")] if with_path else [])
    )
    start, hanging = keep(start, "roots"), links.where("parent is not null")

    def step_over(rest: DataFrame):
        def step(last: DataFrame) -> DataFrame:
            up = last.select(F.col("id").alias("above"), F.col("depth").alias("above_depth"), *(c for c in last.columns if c not in ("id", "depth")))
            return rest.join(up, rest.parent == F.col("above")).select(
                "id", (F.col("above_depth") + 1).cast("int").alias("depth"), "root", *([F.concat("path", F.array("id")).alias("path")] if with_path else [])
            )

        return step

    def cut(done: list[DataFrame]):
        reached = rounds.union(done).select(F.col("id").alias("seen"))
        return step_over(keep(hanging.join(reached, F.col("id") == F.col("seen"), "left_anti"), "rest"))

    levels = rounds.union([start, *rounds.walk(start, step_over(hanging), "frontier", after_single=cut)])
    reached = levels.select(F.col("id").alias("seen"))
    return Levels(levels, hanging.join(reached, F.col("id") == F.col("seen"), "left_anti"))


def cycle_members(rest: DataFrame) -> DataFrame:
    """(node_id, cycle_head) of the rows of ``rest`` that lie on a cycle themselves.

    rest: (id, parent), each parent again an id of it.  Per round the pointer of a row
    doubles its reach, the smallest id on the way is kept, and rows that no pointer meets
    are dropped.  The image of the pointers shrinks to the nodes on cycles; it has been reached when its size and the minima on
    it no longer change, which takes about log2 of the longest path or cycle rounds.
    """
    spark = rest.sparkSession
    jump = keep(rest.select("id", F.col("parent").alias("ahead"), F.least("id", "parent").alias("low")), "jump")
    if jump.isEmpty():
        return spark.createDataFrame([], "node_id string, cycle_head string")
    before = None
    while True:
        image = jump.select(F.col("ahead").alias("id")).distinct()
        on = jump.join(image, "id", "left_semi")
        now = on.agg(F.count("*"), F.sum(F.xxhash64("id", "low").cast("decimal(38,0)"))).first()
        if before is not None and tuple(now) == tuple(before):
            return on.select(F.col("id").alias("node_id"), F.col("low").alias("cycle_head"))
        before = now
        # only the image matters from here on: what hangs below the cycles falls away in halves
        far = on.select(F.col("id").alias("mid"), F.col("ahead").alias("far"), F.col("low").alias("far_low"))
        jump = keep(
            on.join(far, F.col("ahead") == F.col("mid")).select("id", F.col("far").alias("ahead"), F.least("low", "far_low").alias("low")),
            "jump",
        )


def hierarchy(nodes: DataFrame, id_col: str = "node_id", parent_col: str = "parent_node_id") -> DataFrame:
    """One row per node: node_id, parent_node_id, root_id, depth, path array, on_cycle, cycle_head.

    Nodes that no root reaches have null root, depth and path; those on a cycle carry
    its smallest id as ``cycle_head``, those below one have on_cycle = false.
    """
    links = parent_links(nodes, id_col, parent_col)
    walked = walk_levels(links)
    rest = keep(walked.rest, "unreached")
    heads = cycle_members(rest).withColumnRenamed("node_id", "id")
    unreached = rest.join(heads, "id", "left").select(
        F.col("id").alias("node_id"),
        F.col("parent").alias("parent_node_id"),
        F.lit(None).cast("string").alias("root_id"),
        F.lit(None).cast("int").alias("depth"),
        F.lit(None).cast("array<string>").alias("path"),
        F.col("cycle_head").isNotNull().alias("on_cycle"),
        "cycle_head",
    )
    reached = walked.levels.select(
        F.col("id").alias("node_id"),
        F.when(F.col("depth") > 0, F.expr("path[depth - 1]")).alias("parent_node_id"),
        F.col("root").alias("root_id"),
        "depth",
        "path",
        F.lit(False).alias("on_cycle"),
        F.lit(None).cast("string").alias("cycle_head"),
    )
    return reached.unionByName(unreached)


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor_id, node_id, distance) of every reached node and each node above it.

    tree: the result of :func:`hierarchy`.  The pairs come from the paths without a
    join; their number is the sum of the depths, so hot roots need no special care.
    """
    return tree.where("depth > 0").select(
        F.posexplode(F.expr("slice(path, 1, depth)")).alias("at", "ancestor_id"), "node_id", "depth"
    ).select("ancestor_id", "node_id", (F.col("depth") - F.col("at")).alias("distance"))


def find_cycles(nodes: DataFrame, id_col: str = "node_id", parent_col: str = "parent_node_id") -> DataFrame:
    """(node_id, cycle_head) of each node on a cycle; the walk from the roots leaves the residue."""
    walked = walk_levels(parent_links(nodes, id_col, parent_col), with_path=False)
    return cycle_members(walked.rest)
