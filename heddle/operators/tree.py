"""Containment trees: pattern filter, roots, expansion, folders, text rendering.

Trees come out as flat rows (root_id, path of ids, depth, ...), ordered by ``sort_path``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from heddle.functions import scalars as S
from heddle.operators import graph, rounds
from heddle.session import keep


def input_mode(pattern: str) -> str:
    """A colon names a node, a slash a folder, anything else is a pattern."""
    return "node_id" if ":" in pattern else "folder" if "/" in pattern else "pattern"


def filter_nodes(nodes: DataFrame, pattern: str) -> DataFrame:
    """Nodes a pattern means: ``.`` all; exact id, path prefix, or exact, then glob, then substring."""
    if pattern == ".":
        return nodes
    mode = input_mode(pattern)
    if mode == "node_id":
        return nodes.where(F.col("node_id") == pattern)
    if mode == "folder":
        return nodes.where(S.file_path(F.col("node_id")).startswith(pattern if pattern.endswith("/") else pattern + "/"))
    exact = nodes.where(F.col("node_id") == pattern)
    if not exact.isEmpty():
        return exact
    if set("*?[]") & set(pattern):
        return nodes.where(F.col("node_id").rlike(f"^{S.glob_to_regex('*' + pattern + '*')}$"))
    return nodes.where(F.col("node_id").contains(pattern))


def root_bucket(matched: DataFrame, nodes: DataFrame) -> DataFrame:
    """Matched ids without a matched ancestor along parent_node_id.

    Ids on a cycle of matched nodes have such ancestors and drop out with what hangs below.
    """
    ids = matched.select("node_id").distinct()
    up = nodes.where("parent_node_id is not null").groupBy("node_id").agg(F.min("parent_node_id").alias("parent_id"))
    chains = graph.ancestors(ids, up)
    under = chains.join(ids.withColumnRenamed("node_id", "ancestor_id"), "ancestor_id", "left_semi").select("node_id").distinct()
    return ids.join(under, "node_id", "left_anti")


def expand(roots: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int = 0) -> DataFrame:
    """(root_id, node_id, depth, path, sort_path, hidden_children): the containment tree below each root.

    max_depth 1 shows roots only, 0 everything; children are ordered by start line, then
    by edge; at the limit hidden_children counts what is not shown.
    """
    n = nodes.groupBy("node_id").agg(F.max_by("start_line", "node_seq").alias("start_line"))
    links = edges.where("edge_type is null").join(n.withColumnRenamed("node_id", "dst"), "dst").select(F.col("src").alias("up"), F.col("dst").alias("child"), "start_line", "edge_seq")
    links = keep(links.groupBy("up", "child").agg(F.min("start_line").alias("start_line"), F.min("edge_seq").alias("edge_seq")), "links")
    sort_key = F.struct(F.col("start_line").alias("line"), F.col("edge_seq").alias("seq"))
    level = keep(roots.select(F.col("node_id").alias("root_id"), "node_id", F.lit(0).alias("depth"), F.array("node_id").alias("path"), F.array().cast("array<struct<line:int,seq:bigint>>").alias("sort_path")), "tree")

    def step(last: DataFrame) -> DataFrame:
        nxt = last.join(links, F.col("node_id") == F.col("up")).where(~F.array_contains("path", F.col("child")))
        return nxt.select("root_id", F.col("child").alias("node_id"), (F.col("depth") + 1).cast("int").alias("depth"), F.array_append("path", F.col("child")).alias("path"), F.array_append("sort_path", sort_key).alias("sort_path"))

    below = rounds.walk(level, step, "tree", most=max_depth - 1 if max_depth else None) if max_depth != 1 else []
    out = rounds.union([level, *below])
    counts = links.groupBy(F.col("up").alias("cid")).agg(F.count("*").alias("n"))
    hidden = F.when(F.lit(max_depth > 0) & (F.col("depth") + 1 >= max_depth), F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return out.join(counts, out.node_id == counts.cid, "left").select("root_id", "node_id", "depth", "path", "sort_path", hidden.alias("hidden_children"))


def node_count(tree: DataFrame) -> DataFrame:
    """One row: the nodes shown in a tree, and those that its depth limit hides."""
    return tree.agg(F.count("*").alias("n_nodes"), F.coalesce(F.sum("hidden_children"), F.lit(0)).cast("long").alias("n_hidden"))


def project(tree: DataFrame, nodes: DataFrame, edges: DataFrame, detail: str = "min") -> DataFrame:
    """Rows of a tree with six columns of their node (``min``); ``max`` adds signature, summary and the
    number of references into it, null where there is none."""
    cols = ["name", "category", "start_line", "end_line"] + (["signature", "smart_content"] if detail == "max" else [])
    n = nodes.groupBy("node_id").agg(F.max_by(F.struct(*cols), "node_seq").alias("n"))
    rows = tree.join(n, "node_id").select("root_id", "node_id", "depth", "sort_path", *(F.col(f"n.{c}").alias(c) for c in cols), F.when(F.col("hidden_children") > 0, F.col("hidden_children")).alias("hidden_children_count"))
    if detail != "max":
        return rows
    refs = edges.where("edge_type = 'references'").groupBy(F.col("dst").alias("ref")).agg(F.count("*").alias("ref_count"))
    blank = lambda c: F.when(F.length(c) > 0, F.col(c))
    return rows.join(refs, rows.node_id == refs.ref, "left").drop("ref").withColumn("signature", blank("signature")).withColumn("smart_content", blank("smart_content"))


def render(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """(root_id, sort_path, line): box-drawn lines; a row knows whether it is the last child by looking ahead."""
    n = nodes.groupBy("node_id").agg(F.max_by(F.struct("start_line", "end_line"), "node_seq").alias("at"))
    up = F.when(F.size("path") > 1, F.slice("path", 1, F.size("path") - 1)).otherwise(F.array().cast("array<string>"))
    w = Window.partitionBy("root_id", up).orderBy("sort_path")
    rows = tree.join(n, "node_id").withColumn("last", F.lead("node_id").over(w).isNull())
    mark = F.when(F.col("depth") == 0, "").otherwise(F.concat(F.repeat(F.lit("    "), F.col("depth") - 1), F.when(F.col("last"), "└── ").otherwise("├── ")))
    extra = F.when(F.col("hidden_children") > 0, F.concat(F.lit(" ("), F.col("hidden_children").cast("string"), F.lit(" children)"))).otherwise("")
    return rows.select("root_id", "sort_path", F.concat(mark, "node_id", F.lit(" ["), F.col("at.start_line").cast("string"), F.lit("-"), F.col("at.end_line").cast("string"), F.lit("]"), extra).alias("line"))


def folders(nodes: DataFrame) -> DataFrame:
    """(folder, depth, n_direct, n_folders, n_total): every folder above the nodes' paths.

    n_direct counts the nodes of files right in it, n_folders its subfolders, n_total all
    nodes below; subfolders themselves are not items.
    """
    path = S.file_path(F.col("node_id"))
    n = nodes.select("node_id").distinct().select(F.split(path, "/").alias("parts")).where("size(parts) > 1")
    chain = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda k: F.concat(F.array_join(F.slice("parts", 1, k), "/"), F.lit("/")))
    per_leaf = n.groupBy("parts").agg(F.count("*").alias("n"))
    by_dir = per_leaf.select(F.slice("parts", 1, F.size("parts") - 1).alias("dir"), "n", "parts").groupBy("dir").agg(F.sum("n").alias("n"))
    up = by_dir.select(F.posexplode(F.transform(F.sequence(F.lit(1), F.size("dir")), lambda k: F.concat(F.array_join(F.slice("dir", 1, k), "/"), F.lit("/")))).alias("k", "folder"), "dir", "n")
    agg = up.groupBy("folder").agg((F.min("k") + 1).cast("int").alias("depth"), F.sum("n").alias("n_below"), F.sum(F.when(F.col("k") + 1 == F.size("dir"), F.col("n")).otherwise(0)).alias("n_direct"))
    sub = agg.where("depth > 1").select(F.concat(F.array_join(F.slice(F.split("folder", "/"), 1, F.col("depth") - 1), "/"), F.lit("/")).alias("up")).groupBy("up").agg(F.count("*").alias("n_folders"))
    return agg.join(sub, agg.folder == sub.up, "left").select("folder", "depth", F.col("n_direct").cast("long").alias("n_direct"), F.coalesce("n_folders", F.lit(0)).cast("long").alias("n_folders"), F.col("n_below").cast("long").alias("n_total"))


def folder_view(nodes: DataFrame, max_depth: int) -> DataFrame:
    """(folder, depth, hidden_children) of the folders shown at a depth limit."""
    f = folders(nodes).where(F.col("depth") <= max_depth)
    hidden = F.when(F.col("depth") >= max_depth, F.col("n_total")).when(F.col("depth") + 1 >= max_depth, F.col("n_total") - F.col("n_direct") - F.col("n_folders")).otherwise(F.lit(0)).cast("long")
    return f.select("folder", "depth", hidden.alias("hidden_children"))
