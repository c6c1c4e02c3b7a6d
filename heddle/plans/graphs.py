"""Queries over nodes and edges: lookups, trees, degrees, folders, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from heddle.operators import graph as g, tree as t
from heddle.plans.search import CUR
from heddle.session import keep, table

NARROW = ["node_id", "node_seq", "category", "name", "start_line", "end_line", "parent_node_id", "file_path", "language", "ts_kind"]


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_nodes", *NARROW)


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return g.upsert_edges(table(spark, d, "edges"), table(spark, d, "code_nodes", "node_id"))


def upserted_nodes(spark: SparkSession, d: str) -> DataFrame:
    return g.upsert_nodes(_nodes(spark, d)).select("node_id", "node_seq", "first_seq", "category", "start_line", "end_line")


def upserted_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


def node_children(spark: SparkSession, d: str) -> DataFrame:
    return g.children(_edges(spark, d))


def containment_children(spark: SparkSession, d: str) -> DataFrame:
    return g.children(_edges(spark, d), containment_only=True)


def node_parents(spark: SparkSession, d: str) -> DataFrame:
    return g.parents(_edges(spark, d))


def edges_of_node(spark: SparkSession, d: str) -> DataFrame:
    """Both directions of the node with the most reference edges."""
    e = keep(_edges(spark, d), "edges")
    top = g.degrees(e).orderBy((F.col("in_degree") + F.col("out_degree")).desc(), "node_id").first()
    return g.edges_of(e, top["node_id"]) if top else g.edges_of(e, "")


def ancestor_closure(spark: SparkSession, d: str) -> DataFrame:
    e = keep(_edges(spark, d), "edges")
    return g.ancestors(e.select(F.col("dst").alias("node_id")).distinct(), g.parents(e))


def root_bucket(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    return t.root_bucket(t.filter_nodes(n, "Store"), n)


def tree_of_folder(spark: SparkSession, d: str) -> DataFrame:
    """Trees of the matched roots of one repository, to the third level."""
    n = _nodes(spark, d)
    roots = keep(t.root_bucket(t.filter_nodes(n, "lanternfs/"), n), "roots")
    return t.expand(roots, n, _edges(spark, d), 3).select("root_id", "node_id", "depth", F.array_join("path", " > ").alias("path"), "hidden_children")


def tree_full(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    roots = keep(t.root_bucket(t.filter_nodes(n, "*.py"), n), "roots")
    return t.expand(roots, n, _edges(spark, d)).select("root_id", "node_id", "depth", F.array_join("path", " > ").alias("path"), "hidden_children")


def tree_max(spark: SparkSession, d: str) -> DataFrame:
    """Rows of tree_of_folder with signature, summary and references."""
    n = table(spark, d, "code_nodes", *NARROW, "signature", "smart_content")
    roots = keep(t.root_bucket(t.filter_nodes(n, "lanternfs/"), n), "roots")
    e = keep(_edges(spark, d), "edges")
    return t.project(t.expand(roots, n, e, 3), n, e, "max").drop("sort_path")


def tree_size(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the full tree below all Python files."""
    n = _nodes(spark, d)
    return t.node_count(t.expand(keep(t.root_bucket(t.filter_nodes(n, "*.py"), n), "roots"), n, _edges(spark, d)))


def node_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The node of the smallest id by its id, and one that does not exist."""
    n = _nodes(spark, d)
    least = n.agg(F.min("node_id")).first()[0]
    return g.node(n, least or "").unionByName(g.node(n, "callable:none")).select("node_id", "node_seq", "category", "start_line")


def tree_lines(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    roots = keep(t.root_bucket(t.filter_nodes(n, "lanternfs/"), n), "roots")
    return t.render(t.expand(roots, n, _edges(spark, d), 3), n).select("root_id", "line")


def folder_counts(spark: SparkSession, d: str) -> DataFrame:
    return t.folders(_nodes(spark, d))


def folder_view(spark: SparkSession, d: str) -> DataFrame:
    return t.folder_view(_nodes(spark, d), 2)


def degrees(spark: SparkSession, d: str) -> DataFrame:
    return g.degrees(_edges(spark, d))


def relationship_lists(spark: SparkSession, d: str) -> DataFrame:
    r = g.relationships(_edges(spark, d))
    return r.select("node_id", F.coalesce(F.array_join("referenced_by", "|"), F.lit("")).alias("referenced_by"), F.coalesce(F.array_join("references", "|"), F.lit("")).alias("references"))


def stored_edges(spark: SparkSession, d: str) -> DataFrame:
    """What the storage stage keeps."""
    return g.storage_stage(_nodes(spark, d), table(spark, d, "edges"))[1].select("src", "dst", "edge_type")


def missing_parents(spark: SparkSession, d: str) -> DataFrame:
    return g.storage_stage(_nodes(spark, d), table(spark, d, "edges"))[2]


def graph_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Counts by language, kind, both, and category."""
    n = g.upsert_nodes(_nodes(spark, d))
    return n.groupingSets([["language"], ["ts_kind"], ["language", "ts_kind"], ["category"], []], "language", "ts_kind", "category").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (upserted_nodes, upserted_edges, node_children, containment_children, node_parents, edges_of_node, ancestor_closure, root_bucket, tree_of_folder, tree_full, tree_max, tree_size, node_lookup, tree_lines, folder_counts, folder_view, degrees, relationship_lists, stored_edges, missing_parents, graph_statistics)}

E_ = f"""{CUR}, e as (select src, dst, min(edge_seq) as edge_seq, arg_max(edge_type, edge_seq) filter (where edge_type is not null) as edge_type
from edges where src in (select node_id from v) and dst in (select node_id from v) group by 1, 2)"""
_PAR = "par as (select dst as node_id, arg_min(src, edge_seq) as parent_id from e where edge_type is null group by 1)"
_PATH = "split_part(node_id, ':', 2)"


def _bucket(where: str) -> str:
    return f"""ups as (select node_id, min(parent_node_id) as up from code_nodes where parent_node_id is not null group by 1),
m as (select distinct node_id from code_nodes where {where}),
climb as (select m.node_id, u.up as anc, [m.node_id, u.up] as seen from m join ups u using (node_id) where u.up <> m.node_id
  union all select c.node_id, u.up, list_append(c.seen, u.up) from climb c join ups u on u.node_id = c.anc where not list_contains(c.seen, u.up)),
roots as (select node_id from m where node_id not in (select node_id from climb where anc in (select node_id from m)))"""


def _tree(limit: int) -> str:
    return f"""kids as (select src, dst, min(edge_seq) as seq from e where edge_type is null group by 1, 2),
tree as (select node_id as root_id, node_id, 0 as depth, [node_id] as path from roots
  union all select t.root_id, k.dst, t.depth + 1, list_append(t.path, k.dst) from tree t join kids k on k.src = t.node_id where not list_contains(t.path, k.dst) and ({limit} = 0 or t.depth + 1 < {limit})),
shown as (select t.*, case when {limit} > 0 and depth + 1 >= {limit} then (select count(*) from kids k where k.src = t.node_id) else 0 end::bigint as hidden_children from tree t)"""


_FOLDERS = f"""n as (select distinct node_id, string_split({_PATH}, '/') as parts from code_nodes),
up as (select unnest(range(1, len(parts))) as k, parts from n where len(parts) > 1),
a as (select array_to_string(parts[1:k], '/') || '/' as folder, k::int as depth, count(*) as n_below, count(*) filter (where k = len(parts) - 1) as n_direct from up group by 1, 2),
f as (select a.folder, a.depth, a.n_direct, (select count(*) from a b where starts_with(b.folder, a.folder) and b.depth = a.depth + 1) as n_folders,
  a.n_below as n_total from a)"""

ORACLE = {
    "upserted_nodes": f"with {CUR} select node_id, node_seq, first_seq, category, start_line, end_line from cur",
    "upserted_edges": f"with {E_} select src, dst, edge_seq, edge_type from e",
    "node_children": f"with {E_} select src as node_id, dst as child_id, row_number() over (partition by src order by edge_seq)::int as position from e",
    "containment_children": f"with {E_} select src as node_id, dst as child_id, row_number() over (partition by src order by edge_seq)::int as position from e where edge_type is null",
    "node_parents": f"with {E_}, {_PAR} select * from par",
    "edges_of_node": f"""with {E_}, ends as (select src as id from e where edge_type = 'references' union all select dst from e where edge_type = 'references'),
top as (select id from ends group by 1 order by count(*) desc, id limit 1)
select 'outgoing' as direction, dst as other, edge_type, edge_seq from e where src = (select id from top) union all select 'incoming', src, edge_type, edge_seq from e where dst = (select id from top)""",
    "ancestor_closure": f"""with recursive {E_}, {_PAR},
walk as (select p.node_id, p.parent_id as anc, 1 as depth, [p.node_id, p.parent_id] as seen from (select distinct dst from e) s join par p on p.node_id = s.dst where p.parent_id <> p.node_id
  union all select w.node_id, p.parent_id, w.depth + 1, list_append(w.seen, p.parent_id) from walk w join par p on p.node_id = w.anc where not list_contains(w.seen, p.parent_id))
select node_id, anc as ancestor_id, depth from walk""",
    "root_bucket": f"with recursive {_bucket("contains(node_id, 'Store')")} select node_id from roots",
    "tree_of_folder": f"with recursive {E_}, {_bucket(f"starts_with({_PATH}, 'lanternfs/')")}, {_tree(3)} select root_id, node_id, depth, array_to_string(path, ' > ') as path, hidden_children from shown",
    "tree_full": f"with recursive {E_}, {_bucket("regexp_matches(node_id, '^.*.*\\.py.*$')")}, {_tree(0)} select root_id, node_id, depth, array_to_string(path, ' > ') as path, hidden_children from shown",
    "tree_max": f"""with recursive {E_}, {_bucket(f"starts_with({_PATH}, 'lanternfs/')")}, {_tree(3)}, rf as (select dst, count(*) as ref_count from e where edge_type = 'references' group by 1)
select root_id, s.node_id, depth, c.name, c.category, c.start_line, c.end_line, nullif(c.signature, '') as signature, nullif(c.smart_content, '') as smart_content, nullif(hidden_children, 0) as hidden_children_count, ref_count
from shown s join cur c using (node_id) left join rf on rf.dst = s.node_id""",
    "tree_lines": f"""with recursive {E_}, {_bucket(f"starts_with({_PATH}, 'lanternfs/')")}, {_tree(3)},
x as (select s.*, c.start_line, c.end_line, row_number() over (partition by s.root_id, s.path[1:len(s.path) - 1] order by c.start_line desc, k.seq desc) = 1 as last
  from shown s join cur c using (node_id) left join kids k on k.src = s.path[len(s.path) - 1] and k.dst = s.node_id)
select root_id, case when depth = 0 then '' else repeat('    ', depth - 1) || case when last then '└── ' else '├── ' end end || node_id || ' [' || start_line || '-' || end_line || ']' || case when hidden_children > 0 then ' (' || hidden_children || ' children)' else '' end as line from x""",
    "tree_size": f"with recursive {E_}, {_bucket("regexp_matches(node_id, '^.*.*\\.py.*$')")}, {_tree(0)} select count(*) as n_nodes, coalesce(sum(hidden_children), 0)::bigint as n_hidden from shown",
    "node_lookup": f"with {CUR} select node_id, node_seq, category, start_line from cur where node_id in ((select min(node_id) from code_nodes), 'callable:none')",
    "folder_counts": f"with {_FOLDERS} select * from f",
    "folder_view": f"with {_FOLDERS} select folder, depth, case when depth >= 2 then n_total when depth + 1 >= 2 then n_total - n_direct - n_folders else 0 end::bigint as hidden_children from f where depth <= 2",
    "degrees": f"""with {E_}, x as (select src as node_id, 0 as i, 1 as o from e where edge_type = 'references' union all select dst, 1, 0 from e where edge_type = 'references')
select node_id, sum(i)::bigint as in_degree, sum(o)::bigint as out_degree from x group by 1""",
    "relationship_lists": f"""with {E_}, b as (select dst as id, string_agg(src, '|' order by edge_seq) as r from e where edge_type = 'references' group by 1), t as (select src as id, string_agg(dst, '|' order by edge_seq) as r from e where edge_type = 'references' group by 1)
select coalesce(b.id, t.id) as node_id, coalesce(b.r, '') as referenced_by, coalesce(t.r, '') as "references" from b full join t on b.id = t.id""",
    "stored_edges": f"""with {CUR}, c as (select parent_node_id as src, node_id as dst from cur where parent_node_id in (select node_id from v)),
r as (select distinct src, dst from edges where edge_type = 'references' and src in (select node_id from v) and dst in (select node_id from v))
select src, dst, null::varchar as edge_type from c union all select r.src, r.dst, 'references' from r where not exists (select 1 from c where c.src = r.src and c.dst = r.dst)""",
    "missing_parents": f"with {CUR} select parent_node_id as src, node_id as dst, 'missing parent' as reason from cur where parent_node_id is not null and parent_node_id not in (select node_id from v)",
    "graph_statistics": f"with {CUR} select language, ts_kind, category, count(*) as n from cur group by grouping sets ((language), (ts_kind), (language, ts_kind), (category), ())",
}
