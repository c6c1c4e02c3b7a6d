"""The codebase report: filters, clustering of callables, sizes, depth, metadata, serialisation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from heddle.functions import scalars as S
from heddle.operators import graph as g, hierarchy as h
from heddle.session import keep, only_row

#: Deepest level that is told apart; deeper chains and cycles count one more.
DEEPEST = 20


def filter_report(nodes: DataFrame, edges: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes whose whole id matches an include glob and no exclude glob; edges between them."""
    n = nodes
    if include:
        n = n.where(S._any([F.col("node_id").rlike(f"^{S.glob_to_regex(p)}$") for p in include]))
    if exclude:
        n = n.where(~S._any([F.col("node_id").rlike(f"^{S.glob_to_regex(p)}$") for p in exclude]))
    ids = n.select("node_id").distinct()
    e = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return n, e


def node_depth(nodes: DataFrame) -> DataFrame:
    """(node_id, depth): length of the parent chain; a parent that is no node adds one; cycles and
    chains beyond DEEPEST count DEEPEST + 1."""
    tree = h.hierarchy(nodes)
    up = nodes.groupBy(F.col("node_id").alias("rid")).agg(F.min("parent_node_id").alias("p"))
    j = tree.join(up, F.coalesce("root_id", "node_id") == up.rid, "left")
    raw = F.col("depth") + F.when(F.col("p").isNotNull(), 1).otherwise(0)
    return j.select("node_id", F.least(F.lit(DEEPEST + 1), F.coalesce(raw, F.lit(DEEPEST + 1))).cast("int").alias("depth"))


def node_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, in_degree, out_degree, size, is_entry_point); a file adds the degrees of its direct children."""
    deg = g.degrees(edges)
    n = nodes.select("node_id", "category", "parent_node_id")
    d = n.join(deg, "node_id", "left").fillna(0, ["in_degree", "out_degree"])
    d = keep(d, "degrees")
    below = d.where("in_degree + out_degree > 0 and parent_node_id is not null").groupBy(F.col("parent_node_id").alias("pid")).agg(F.sum(F.col("in_degree") + F.col("out_degree")).alias("below"))
    j = d.join(below, d.node_id == below.pid, "left")
    total = F.col("in_degree") + F.col("out_degree") + F.when(F.col("category") == "file", F.coalesce("below", F.lit(0))).otherwise(0)
    entry = (F.col("in_degree") == 0) & (F.col("out_degree") > 0) & (F.col("category") == "callable")
    return j.select("node_id", "in_degree", "out_degree", g.node_size(total, F.col("category")).alias("size"), entry.alias("is_entry_point"))


def fold_table(sizes: np.ndarray, most: int) -> np.ndarray:
    """State after these groups for every state 0..most before: a group is kept whole while it
    fits, else it becomes one row. States beyond ``most`` grow by one a group."""
    s = np.arange(most + 1, dtype="int64")
    for c in sizes:
        s = np.where(s + c <= most, s + c, s + 1)
    return s


def cluster_callables(nodes: DataFrame, edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, mapping): if there are more than ``most`` nodes, callables are taken parent by
    parent in id order; a group stays while the whole fits, else it becomes one summary row.

    The fold over the groups is sequential, but a run of groups acts on the count as a
    function of bounded size; the functions of range partitions are composed on the
    driver, so no task sees all groups.
    """
    n = nodes.select("node_id", "category", "parent_node_id", "start_line", "end_line", "file_path")
    if n.count() <= most:
        return n.withColumn("n_clustered", F.lit(1).cast("long")), edges, n.select("node_id", F.col("node_id").alias("shown_id")).limit(0)
    is_call = F.coalesce((F.col("category") == "callable") & (F.length("parent_node_id") > 0), F.lit(False))
    kept = n.where(~is_call)
    groups = n.where(is_call).groupBy(F.col("parent_node_id").alias("parent")).agg(F.count("*").alias("c"), F.min(F.coalesce("start_line", F.lit(0))).alias("start_line"), F.max(F.coalesce("end_line", F.lit(0))).alias("end_line"), F.min("file_path").alias("file_path"))
    parts = keep(groups.repartitionByRange("parent").sortWithinPartitions("parent").withColumn("pid", F.spark_partition_id()), "groups")

    def table(part: pd.DataFrame) -> pd.DataFrame:
        p = part.sort_values("parent")
        return pd.DataFrame({"pid": [p["pid"].iat[0]], "first": [p["parent"].iat[0]], "n": [len(p)], "after": [fold_table(p["c"].to_numpy(), most)]})

    tables = parts.groupBy("pid").applyInPandas(table, "pid int, first string, n long, after array<long>").toPandas().sort_values("first")
    state, entry = kept.count(), {}
    for r in tables.itertuples(index=False):
        entry[int(r.pid)] = state
        state = int(r.after[state]) if state <= most else state + int(r.n)

    def decide(part: pd.DataFrame) -> pd.DataFrame:
        p = part.sort_values("parent")
        s, flags = entry[int(p["pid"].iat[0])], []
        for c in p["c"]:
            fits = s + c <= most
            flags.append(not fits)
            s += c if fits else 1
        return p[["parent", "c", "start_line", "end_line", "file_path"]].assign(clustered=flags)

    chosen = keep(parts.groupBy("pid").applyInPandas(decide, "parent string, c long, start_line int, end_line int, file_path string, clustered boolean"), "chosen")
    gone = chosen.where("clustered").withColumn("shown_id", F.concat(F.lit("callable:"), F.coalesce("file_path", F.lit("")), F.lit(":_cluster_"), F.col("c").cast("string")))
    mapping = n.where(is_call).join(gone.select("parent", "shown_id"), F.col("parent_node_id") == F.col("parent")).select("node_id", "shown_id")
    single = n.where(is_call).join(chosen.where("not clustered").select("parent"), F.col("parent_node_id") == F.col("parent"), "left_semi")
    summary = gone.select(F.col("shown_id").alias("node_id"), F.lit("callable").alias("category"), F.col("parent").alias("parent_node_id"), "start_line", "end_line", "file_path", F.col("c").alias("n_clustered"))
    shown = kept.unionByName(single).withColumn("n_clustered", F.lit(1).cast("long")).unionByName(summary)
    ids = shown.select("node_id").distinct()
    m = mapping
    e = edges.join(m.select(F.col("node_id").alias("src"), F.col("shown_id").alias("s2")), "src", "left").join(m.select(F.col("node_id").alias("dst"), F.col("shown_id").alias("d2")), "dst", "left")
    e = e.select(F.coalesce("s2", "src").alias("src"), F.coalesce("d2", "dst").alias("dst"), "edge_type", "edge_seq")
    e = e.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return shown, g.first_edges(e), mapping


def serialise_edges(edges: DataFrame) -> DataFrame:
    """(id, source, target, color, hidden): references amber and visible, containment dark and hidden.

    The running number counts edges in order; it is taken in two steps over ranges of edge_seq.
    """
    from pyspark.sql import Window

    e = edges.withColumn("block", F.floor(F.col("edge_seq") / 100_000))
    n = e.groupBy("block").agg(F.count("*").alias("n"))
    off = n.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    idx = F.col("off") + F.row_number().over(Window.partitionBy("block").orderBy("edge_seq", "src", "dst")) - 1
    ref = F.coalesce(F.col("edge_type") == "references", F.lit(False))
    return e.join(off, "block").select(F.concat(F.lit("e-"), idx.cast("string")).alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"), F.when(ref, "#f59e0b").otherwise("#334155").alias("color"), (~ref).alias("hidden"))


def report_metadata(nodes: DataFrame, edges: DataFrame, project: str = "project", clustered: bool = False) -> DataFrame:
    """One row: project, node and edge counts by kind, categories as text, whether callables were clustered."""
    c = nodes.groupBy("category").agg(F.count("*").alias("n"))
    cats = c.agg(F.sum("n").alias("node_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category", "n"))), lambda x: F.concat(x["category"], F.lit("="), x["n"].cast("string"))), ",").alias("categories"))
    e = only_row(edges.agg(F.count("*").alias("edges"), F.count_if(F.col("edge_type") == "references").alias("references")))
    return cats.select(F.lit(project).alias("project"), "node_count", F.lit(e["edges"]).cast("long").alias("edge_count"), F.lit(e["references"]).cast("long").alias("reference_count"), "categories", F.lit(clustered).alias("clustered"))


_PAGE = """<script>
const c=document.getElementById('c'),g=c.getContext('2d'),at=new Map(nodes.map(n=>[n.node_id,n]));
let k=1,dx=0,dy=0;const X=n=>(n.x+dx)*k,Y=n=>(n.y+dy)*k;
function draw(){c.width=innerWidth;c.height=innerHeight;g.lineWidth=.5;
for(const e of edges){const a=at.get(e.source),b=at.get(e.target);if(!a||!b||e.hidden)continue;g.strokeStyle=e.color;g.beginPath();g.moveTo(X(a),Y(a));g.lineTo(X(b),Y(b));g.stroke()}
for(const n of nodes){g.fillStyle='#60a5fa';g.beginPath();g.arc(X(n),Y(n),Math.max(1,n.size*k/4),0,7);g.fill()}}
onwheel=e=>{k*=e.deltaY<0?1.1:.9;draw()};onmousemove=e=>{if(e.buttons){dx+=e.movementX/k;dy+=e.movementY/k;draw()}};onresize=draw;draw();
</script>"""


def write_html(nodes: DataFrame, edges: DataFrame, meta: DataFrame, path: str) -> int:
    """Write a self-contained page that draws the graph; gives the number of nodes.

    nodes: (node_id, x, y, size, ...); edges as of serialise_edges. Every row is written, as it
    comes from the partitions; bring large graphs under a limit with cluster_callables.
    """
    import html
    import json

    head = meta.first().asDict()
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"<!doctype html><meta charset=utf-8><title>{html.escape(str(head.get('project', '')))}</title><canvas id=c></canvas><script>const meta=")
        f.write(json.dumps(head, ensure_ascii=False, default=str).replace("</", "<\\/"))
        for name, df in (("nodes", nodes), ("edges", edges)):
            f.write(f";\nconst {name}=[")
            for k, row in enumerate(df.select(F.to_json(F.struct(*df.columns)).alias("r")).toLocalIterator()):
                f.write(("," if k else "") + row["r"].replace("</", "<\\/"))
                n += name == "nodes"
            f.write("]")
        f.write(";</script>" + _PAGE + "\n")
    return n


def report_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, name, category, file_path, start_line, end_line, signature, smart_content, x, y, size, depth,
    is_entry_point): what a page shows of each node, no text or vectors of it."""
    from heddle.operators import layout

    shown = nodes.select("node_id", "name", "category", "file_path", "start_line", "end_line", "signature", "smart_content")
    at = layout.treemap(nodes)
    metrics = node_metrics(nodes, edges).select("node_id", "is_entry_point")
    return shown.join(at, "node_id").join(metrics, "node_id").join(node_depth(nodes), "node_id")
