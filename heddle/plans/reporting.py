"""Queries of report, layout and enrichment, with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from heddle.functions import scalars as S
from heddle.operators import enrich, graph as g, layout, report as r, tree
from heddle.plans.graphs import E_
from heddle.plans.maintain import EMBEDDED
from heddle.plans.search import CUR
from heddle.session import keep, table

MOST = 1200


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return g.upsert_nodes(table(spark, d, "code_nodes"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return g.upsert_edges(table(spark, d, "edges"), table(spark, d, "code_nodes", "node_id"))


def report_filter(spark: SparkSession, d: str) -> DataFrame:
    n, e = r.filter_report(_nodes(spark, d), _edges(spark, d), include=["*.py*"], exclude=["*vendor*"])
    return e.select("src", "dst", "edge_type")


def node_depths(spark: SparkSession, d: str) -> DataFrame:
    return r.node_depth(_nodes(spark, d).select("node_id", "parent_node_id"))


def node_metrics(spark: SparkSession, d: str) -> DataFrame:
    return r.node_metrics(_nodes(spark, d), _edges(spark, d))


def clustered_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    return r.cluster_callables(n, _edges(spark, d), MOST)[0].select("node_id", "parent_node_id", "start_line", "end_line", "n_clustered")


def clustered_edges(spark: SparkSession, d: str) -> DataFrame:
    return r.cluster_callables(_nodes(spark, d), _edges(spark, d), MOST)[1].select("src", "dst", "edge_type")


def serialised_edges(spark: SparkSession, d: str) -> DataFrame:
    return r.serialise_edges(_edges(spark, d))


def report_metadata(spark: SparkSession, d: str) -> DataFrame:
    return r.report_metadata(_nodes(spark, d), _edges(spark, d))


def layout_points(spark: SparkSession, d: str) -> DataFrame:
    """Points and clusters of nodes with vectors, the others beside their parents."""
    n = _nodes(spark, d)
    p = keep(layout.project(n), "points")
    return layout.clusters(p).select("node_id", "x", "y", "cluster").unionByName(layout.place_rest(n, p).withColumn("cluster", F.lit(0)))


def cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    """Centre, size and label of each cluster."""
    n = _nodes(spark, d)
    c = keep(layout.clusters(layout.project(n)), "clusters")
    words = layout.tokens(n.select("node_id", "name")).join(c.select("node_id", "cluster"), "node_id").select("cluster", "token")
    return layout.centroids(c).join(layout.cluster_labels(words), "cluster", "left")


def cluster_hulls(spark: SparkSession, d: str) -> DataFrame:
    return layout.hulls(layout.clusters(layout.project(_nodes(spark, d))))


def language_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels with the languages as clusters."""
    n = _nodes(spark, d).select("node_id", "name", "language")
    return layout.cluster_labels(layout.tokens(n).join(n.select("node_id", F.col("language").alias("cluster")), "node_id").select("cluster", "token"))


def treemap(spark: SparkSession, d: str) -> DataFrame:
    """Position and size of every node."""
    return layout.treemap(_nodes(spark, d).select("node_id", "file_path", "start_line", "end_line"))


def treemap_folders(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles of all folders, at every depth."""
    t = layout.rectangles(_nodes(spark, d).select("node_id", "file_path")).where("not local")
    return t.select("folder", "depth", *(F.round(c, 3).alias(c) for c in ("x", "y", "w", "h")))


def term_points(spark: SparkSession, d: str) -> DataFrame:
    """Points by terms, as for a graph without vectors."""
    n = _nodes(spark, d).select("node_id", "name", "signature", "content").withColumn("embedding", F.lit(None).cast("array<array<double>>"))
    return layout.points(n)


def report_page_nodes(spark: SparkSession, d: str) -> DataFrame:
    """What the page shows of each node."""
    return r.report_nodes(_nodes(spark, d), _edges(spark, d)).select("node_id", "category", "depth", "is_entry_point", "size")


def prompt_templates(spark: SparkSession, d: str) -> DataFrame:
    return enrich.templates(table(spark, d, "code_nodes", "node_id", "category").distinct())


def summarised(spark: SparkSession, d: str) -> DataFrame:
    """Result of the summary stage for every node, by a deterministic stand-in for the model."""
    return enrich.summarise(_nodes(spark, d)).select("node_id", "smart_content", "status")


def embedded(spark: SparkSession, d: str) -> DataFrame:
    e = enrich.embed(_nodes(spark, d))
    return e.select("node_id", F.coalesce(F.size("embedding"), F.lit(0)).alias("n_raw"), F.coalesce(F.size("smart_content_embedding"), F.lit(0)).alias("n_smart"), "embedding_hash", "n_failed")


def docs_by_tag(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "docs_registry")
    return docs.where((F.col("category") == "how-to") & F.arrays_overlap("tags", F.array(F.lit("scope"), F.lit("router"), F.lit("queue")))).select("id", "title", "path")


QUERIES = {f.__name__: f for f in (report_filter, node_depths, node_metrics, clustered_nodes, clustered_edges, serialised_edges, report_metadata, layout_points, cluster_summary, cluster_hulls, language_labels, treemap, treemap_folders, term_points, report_page_nodes, prompt_templates, summarised, embedded, docs_by_tag)}

_SIZE = """round(case when category = 'file' then greatest(6, least(40, 6 + log2(total + 1) * 5)) when category in ('callable', 'type') then greatest(3, least(25, 3 + log2(total + 1) * 4)) else greatest(2, least(12, 2 + log2(total + 1) * 2)) end, 2)"""
_CLUSTER = f"""k as (select node_id, category, parent_node_id, start_line, end_line, file_path, category = 'callable' and length(parent_node_id) > 0 as is_call from cur),
grp as (select parent_node_id as parent, count(*) as c, min(coalesce(start_line, 0)) as a, max(coalesce(end_line, 0)) as b, min(file_path) as fp, row_number() over (order by parent_node_id) as i from k where is_call group by 1),
fold as (select 0::bigint as i, (select count(*) from k where not coalesce(is_call, false)) as s, false as clustered
  union all select g.i, case when f.s + g.c <= {MOST} then f.s + g.c else f.s + 1 end, f.s + g.c > {MOST} from fold f join grp g on g.i = f.i + 1),
gone as (select g.*, 'callable:' || coalesce(fp, '') || ':_cluster_' || c as sid from grp g join fold f using (i) where f.clustered and (select count(*) from k) > {MOST}),
shown as (select node_id, parent_node_id, start_line, end_line, 1::bigint as n_clustered from k where not (coalesce(is_call, false) and parent_node_id in (select parent from gone))
  union all select sid, parent, a, b, c from gone),
m as (select k.node_id, gone.sid from k join gone on k.is_call and gone.parent = k.parent_node_id)"""

_RECTANGLES = f"""{CUR},
f as (select node_id, coalesce(file_path, '') as file, string_split(coalesce(file_path, ''), '/') as p, start_line, end_line from cur),
own as (select p[1:greatest(len(p) - 1, 0)] as dir, count(*) as n from f group by 1),
raw as (select array_to_string(dir, '/') as up, null::varchar as folder, len(dir) as depth, n as weight from own
  union all select array_to_string(dir[1:k - 1], '/'), array_to_string(dir[1:k], '/'), k - 1, sum(n) from (select dir, n, unnest(range(1, len(dir) + 1)) as k from own where len(dir) > 0) group by 1, 2, 3),
items as (select *, folder is null as local, coalesce(sum(weight) over (w rows between unbounded preceding and 1 preceding), 0) as before, row_number() over w - 1 as pos, sum(weight) over (partition by up) as total, count(*) over (partition by up) as n
  from raw window w as (partition by up order by folder is null desc, folder)),
rect as (select null::varchar as up, '' as folder, -1::bigint as depth, false as local, 0.0::double as x, 0.0::double as y, 1000.0::double as w, 1000.0::double as h
  union all
  select up, folder, depth, local,
    px + pw * 0.03 + case when wide then o else 0.0 end, py + ph * 0.03 + case when wide then 0.0 else o end,
    case when wide then l else pw - pw * 0.03 * 2 end, case when wide then ph - ph * 0.03 * 2 else l end
  from (select *, room * before / total + gap * pos as o, room * weight / total as l
    from (select *, case when r0 > 0 then r0 else side end as room, case when r0 > 0 then pad else 0.0 end as gap
      from (select *, side - pad * (n - 1) as r0 from (
        select i.*, r.x as px, r.y as py, r.w as pw, r.h as ph, r.w >= r.h as wide, case when r.w >= r.h then r.w else r.h end as side, case when r.w >= r.h then r.w * 0.03 else r.h * 0.03 end as pad
        from rect r join items i on i.up = r.folder where not r.local))))
  where l > 0 and case when wide then ph - ph * 0.03 * 2 else pw - pw * 0.03 * 2 end > 0)"""
_LINE_SIZE = "round(case when start_line is null or end_line is null then 4 else greatest(4, least(14, 3 + 1.5 * log2(greatest(1, end_line - start_line + 1) + 1))) end, 2)"

_WORDS_OF = "list_filter(string_split_regex(lower(regexp_replace({x}, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[ _]'), lambda w: w <> '')"
_STOP = ", ".join(f"'{w}'" for w in layout.STOP_WORDS)

ORACLE = {
    "language_labels": f"""with {CUR}, p as (select node_id, language, coalesce(name, '') as name, string_split(split_part(node_id, ':', 2), '/') as parts from cur),
t as (select language as cluster, unnest({_WORDS_OF.format(x="name")} || {_WORDS_OF.format(x="regexp_replace(regexp_replace(parts[-1], '[.][^.]*$', ''), '^test_', '')")} || {_WORDS_OF.format(x="coalesce(parts[-2], '')")}) as token from p),
w as (select * from t where length(token) >= 3 and token not in ({_STOP})),
tf as (select cluster, token, count(*) as tf from w group by 1, 2), n as (select count(distinct cluster) as n from w), df as (select token, count(*) as df from tf group by 1),
s as (select cluster, token, tf * (ln((1 + n) / (1 + df)) + 1) as score from tf join df using (token), n where df <= greatest(1.0, n * 0.8)),
r as (select *, row_number() over (partition by cluster order by score desc, token) as r from s where score > 0)
select cluster, string_agg(token, ' · ' order by r) as label from r where r <= 4 group by 1""",
    "treemap_folders": f"with recursive {_RECTANGLES} select folder, depth::int as depth, round(x, 3) as x, round(y, 3) as y, round(w, 3) as w, round(h, 3) as h from rect where not local and depth >= 0",
    "treemap": f"""with recursive {_RECTANGLES},
n as (select node_id, array_to_string(p[1:greatest(len(p) - 1, 0)], '/') as dir, start_line, end_line, row_number() over (partition by array_to_string(p[1:greatest(len(p) - 1, 0)], '/') order by file, coalesce(start_line, 0), node_id) - 1 as i, count(*) over (partition by array_to_string(p[1:greatest(len(p) - 1, 0)], '/')) as n from f),
a as (select n.*, x, y, w, h, greatest(1, floor(w / 18.0)) as fw, greatest(1, floor(h / 18.0)) as fh, greatest(1, least(ceil(sqrt(n)), greatest(1, floor(w / 18.0)))) as c0 from n join rect on rect.local and rect.up = n.dir),
b as (select *, greatest(1, least(ceil(n / c0), fh)) as r0 from a),
c as (select *, case when c0 * r0 < n and c0 < fw then c0 + 1 else c0 end as cols, case when c0 * r0 < n and c0 < fw then ceil(n / (c0 + 1)) else r0 end as rws from b),
e as (select *, greatest(0, i - cols * rws + 1) as over_ from c)
select node_id, round(x + (case when over_ > 0 then cols - 1 else i % cols end + 0.5) * w / cols + over_ * 2, 2) as x, round(y + (case when over_ > 0 then rws - 1 else floor(i / cols) end + 0.5) * h / rws + over_ * 2, 2) as y, {_LINE_SIZE} as size from e""",
    "report_filter": f"with {E_}, n as (select node_id from v where regexp_matches(node_id, '^.*\\.py.*$') and not regexp_matches(node_id, '^.*vendor.*$')) select src, dst, edge_type from e where src in (select node_id from n) and dst in (select node_id from n)",
    "node_depths": f"""with recursive {CUR}, climb as (select node_id, parent_node_id as up, 0 as depth from cur
  union all select c.node_id, n.parent_node_id, c.depth + 1 from climb c left join cur n on n.node_id = c.up where c.up is not null and c.depth <= 20)
select node_id, max(depth)::int as depth from climb group by 1""",
    "node_metrics": f"""with {E_}, deg as (select id, sum(i) as i, sum(o) as o from (select src as id, 0 as i, 1 as o from e where edge_type = 'references' union all select dst, 1, 0 from e where edge_type = 'references') group by 1),
n as (select node_id, category, parent_node_id, coalesce(i, 0) as i, coalesce(o, 0) as o from cur left join deg on id = node_id),
t as (select n.*, i + o + case when category = 'file' then coalesce((select sum(c.i + c.o) from n c where c.parent_node_id = n.node_id), 0) else 0 end as total from n)
select node_id, i::bigint as in_degree, o::bigint as out_degree, {_SIZE} as size, i = 0 and o > 0 and category = 'callable' as is_entry_point from t""",
    "clustered_nodes": f"with recursive {CUR}, {_CLUSTER} select * from shown",
    "clustered_edges": f"""with recursive {E_}, {_CLUSTER}, x as (select coalesce(a.sid, e.src) as src, coalesce(b.sid, e.dst) as dst, edge_type, edge_seq from e left join m a on a.node_id = e.src left join m b on b.node_id = e.dst)
select src, dst, nullif(arg_min(coalesce(edge_type, ''), edge_seq), '') as edge_type from x where src in (select node_id from shown) and dst in (select node_id from shown) group by 1, 2""",
    "serialised_edges": f"with {E_} select 'e-' || (row_number() over (order by edge_seq, src, dst) - 1) as id, src as source, dst as target, case when edge_type = 'references' then '#f59e0b' else '#334155' end as color, coalesce(edge_type, '') <> 'references' as hidden from e",
    "report_metadata": f"""with {E_}, c as (select category, count(*) as n from cur group by 1)
select 'project' as project, (select sum(n) from c)::bigint as node_count, (select count(*) from e) as edge_count, (select count(*) from e where edge_type = 'references') as reference_count, (select string_agg(category || '=' || n, ',' order by category) from c) as categories, false as clustered""",
    "prompt_templates": "select distinct node_id, case when category in ('file', 'type', 'callable', 'section', 'block') then category else 'base' end as template, case when category in ('file', 'type') then 200 when category in ('callable', 'section', 'block') then 150 else 100 end as max_tokens from code_nodes",
    "docs_by_tag": "select id, title, path from docs_registry where category = 'how-to' and list_has_any(tags, ['scope', 'router', 'queue'])",
}

ORACLE["report_page_nodes"] = f"""select c.node_id, c.category, d.depth, m.is_entry_point, c.size from (with {CUR} select node_id, category, {_LINE_SIZE} as size from cur) c
join ({ORACLE["node_depths"]}) d on d.node_id = c.node_id join ({ORACLE["node_metrics"]}) m on m.node_id = c.node_id"""
ORACLE["summarised"] = f"""with {CUR}, n as (select node_id, category, name, content, smart_content, coalesce(smart_content_hash = content_hash and smart_content is not null, false) as fresh,
  length(regexp_replace(coalesce(content, ''), '^\\s+|\\s+$', '', 'g')) < 50 as trivial, length(content) // 4 as tokens from cur),
q as (select *, case when tokens > 4000 then substring(content, 1, floor(length(content) * 4000 / tokens * 0.9)::bigint) || chr(10) || chr(10) || '[TRUNCATED]' else content end as prompt from n)
select node_id, case when fresh then smart_content when trivial then '[Empty content - no summary generated for ' || category || ' ' || chr(39) || coalesce(name, 'None') || chr(39) || ']' else array_to_string(list_filter(string_split_regex(prompt, '\\s+'), lambda w: w <> '')[1:12], ' ') end as smart_content,
  case when fresh then 'skipped' when trivial then 'placeholder' else 'enriched' end as status from q"""
ORACLE["embedded"] = EMBEDDED
