"""Nodes and edges: upserts, lookups, neighbours, degrees, ancestors.

A graph is a nodes DataFrame (at least node_id, node_seq) and an edges DataFrame (src,
dst, edge_type, edge_seq); a null edge_type is containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from heddle.session import keep


def versions(nodes: DataFrame) -> DataFrame:
    """(node_id, first_seq, last_seq): narrow, so texts and vectors are not shuffled for it."""
    return nodes.where("node_id is not null").groupBy("node_id").agg(F.min("node_seq").alias("first_seq"), F.max("node_seq").alias("last_seq"))


def upsert_nodes(nodes: DataFrame) -> DataFrame:
    """One row per node id: content of its last row, position of its first (column first_seq)."""
    v = versions(nodes).withColumnRenamed("node_id", "vid")
    return nodes.join(v, (nodes.node_id == v.vid) & (nodes.node_seq == v.last_seq)).drop("vid", "last_seq")


def current_only(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (with node_id, node_seq) of the last version of their node; adds first_seq."""
    v = versions(nodes).withColumnRenamed("node_id", "vid")
    return rows.join(v, (rows.node_id == v.vid) & (rows.node_seq == v.last_seq)).drop("vid", "last_seq")


def upsert_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends known, one per (src, dst): position of the first, type of the last that has one."""
    ids = nodes.select("node_id").where("node_id is not null").distinct()
    e = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return e.groupBy("src", "dst").agg(F.min("edge_seq").alias("edge_seq"), F.max_by("edge_type", F.when(F.col("edge_type").isNotNull(), F.col("edge_seq"))).alias("edge_type"))


def edges_of(edges: DataFrame, node_id: str, direction: str = "both", edge_type: str | None = None) -> DataFrame:
    """(direction, other, edge_type, edge_seq): outgoing first, then incoming."""
    e = edges if edge_type is None else edges.where(F.col("edge_type") == edge_type)
    out = e.where(F.col("src") == node_id).select(F.lit("outgoing").alias("direction"), F.col("dst").alias("other"), "edge_type", "edge_seq")
    inc = e.where(F.col("dst") == node_id).select(F.lit("incoming").alias("direction"), F.col("src").alias("other"), "edge_type", "edge_seq")
    return {"outgoing": out, "incoming": inc, "both": out.unionByName(inc)}[direction]


def children(edges: DataFrame, containment_only: bool = False) -> DataFrame:
    """(node_id, child_id, position) with position running from 1 in edge order."""
    e = edges.where("edge_type is null") if containment_only else edges
    w = Window.partitionBy("src").orderBy("edge_seq")
    return e.select(F.col("src").alias("node_id"), F.col("dst").alias("child_id"), F.row_number().over(w).alias("position"))


def parents(edges: DataFrame) -> DataFrame:
    """(node_id, parent_id): the first containment edge into each node."""
    return edges.where("edge_type is null").groupBy(F.col("dst").alias("node_id")).agg(F.min_by("src", "edge_seq").alias("parent_id"))


def ancestors(start: DataFrame, up: DataFrame) -> DataFrame:
    """(node_id, ancestor_id, depth) of the start ids along ``up`` (node_id, parent_id; one parent a node).

    Jumps of 1, 2, 4 ... levels are joined to what is known, so a chain of any length takes as
    many rounds as its length has binary digits; the first DOUBLINGS of them are one plan.  A
    chain that closes on itself ends before it repeats an id.
    """
    jump = up.where("parent_id is not null").select(F.col("node_id").alias("at"), F.col("parent_id").alias("to"))
    known = start.select("node_id").where("node_id is not null").distinct().select("node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).alias("depth"))
    reach = 1
    while True:
        further = known.join(jump, F.col("ancestor_id") == F.col("at")).select("node_id", F.col("to").alias("ancestor_id"), (F.col("depth") + reach).cast("int").alias("depth"))
        known = known.unionByName(further)
        reach *= 2
        if reach >= 1 << DOUBLINGS:
            # on a closed chain an ancestor is met again: its first distance stays
            known = keep(known.groupBy("node_id", "ancestor_id").agg(F.min("depth").alias("depth")), "ancestors")
            if known.where(F.col("depth") >= reach // 2).isEmpty():
                return known.where("depth > 0")
            jump = keep(_twice(jump), "jumps")
        else:
            jump = _twice(jump)


#: Rounds of jumps that make up the first job of ancestors: chains below 2^DOUBLINGS levels need no more.
DOUBLINGS = 3


def _twice(jump: DataFrame) -> DataFrame:
    further = jump.select(F.col("at").alias("to"), F.col("to").alias("beyond"))
    return jump.join(further, "to").select("at", F.col("beyond").alias("to"))


def node(nodes: DataFrame, node_id: str) -> DataFrame:
    """The last version of one node, or no row; the filter reaches the scan."""
    hit = nodes.where(F.col("node_id") == node_id)
    return hit.orderBy(F.col("node_seq").desc()).limit(1)


def degrees(edges: DataFrame) -> DataFrame:
    """(node_id, in_degree, out_degree) over reference edges only, in one aggregation."""
    ref = edges.where("edge_type = 'references'")
    ends = ref.select(F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.node_id").agg(F.sum("e.i").cast("long").alias("in_degree"), F.sum("e.o").cast("long").alias("out_degree"))


def relationships(edges: DataFrame) -> DataFrame:
    """(node_id, referenced_by, references): ids in edge order."""
    ref = edges.where("edge_type = 'references'")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("edge_seq", c))), lambda x: x[c])
    by = ref.groupBy(F.col("dst").alias("node_id")).agg(ordered("src").alias("referenced_by"))
    to = ref.groupBy(F.col("src").alias("node_id")).agg(ordered("dst").alias("references"))
    return by.join(to, "node_id", "full")


def node_size(degree: Column, category: Column) -> Column:
    """Display size by category and degree, rounded to two digits."""
    size = lambda lo, hi, a, b: F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.lit(float(a)) + F.log2(degree + F.lit(1.0)) * F.lit(float(b))))
    return F.round(F.when(category == "file", size(6, 40, 6, 5)).when(category.isin("callable", "type"), size(3, 25, 3, 4)).otherwise(size(2, 12, 2, 2)), 2)


def first_edges(edges: DataFrame, order: str = "edge_seq") -> DataFrame:
    """First edge of each (src, dst)."""
    w = Window.partitionBy("src", "dst").orderBy(order)
    return edges.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def storage_stage(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, rejected): nodes upserted; containment from parent_node_id; reference edges
    kept if both ends exist and the pair is no containment pair; rejected names the reason."""
    n = upsert_nodes(nodes)
    ids = n.select("node_id")
    contain = n.where("parent_node_id is not null").select(F.col("parent_node_id").alias("src"), F.col("node_id").alias("dst"), F.col("first_seq").alias("edge_seq"))
    known = contain.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").withColumn("edge_type", F.lit(None).cast("string"))
    orphan = contain.join(ids.withColumnRenamed("node_id", "src"), "src", "left_anti").select("src", "dst", F.lit("missing parent").alias("reason"))
    ref = first_edges(edges.where("edge_type = 'references'"))
    both = ref.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    kept = both.join(known.select("src", "dst"), ["src", "dst"], "left_anti")
    return n, known.select("src", "dst", "edge_type", "edge_seq").unionByName(kept.select("src", "dst", "edge_type", "edge_seq")), orphan
