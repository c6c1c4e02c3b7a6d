"""Queries of incremental maintenance, references and chunking, with their SQL.

The prior state is the same tables with every seventh content altered and every eleventh
node missing, as a rescan would find them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from heddle.operators import chunking as c, graph as g, incremental as inc, refs
from heddle.plans.search import CUR
from heddle.session import table


def _current(spark: SparkSession, d: str) -> DataFrame:
    return g.upsert_nodes(table(spark, d, "code_nodes"))


def _prior(nodes: DataFrame) -> DataFrame:
    p = nodes.where("node_seq % 11 <> 0")
    return p.withColumn("content_hash", F.when(F.col("node_seq") % 7 == 0, F.sha2(F.concat("content", F.lit("!")), 256)).otherwise(F.col("content_hash")))


def changed_files(spark: SparkSession, d: str) -> DataFrame:
    n = _current(spark, d)
    return inc.changed_files(n, _prior(n))


def nodes_to_rescan(spark: SparkSession, d: str) -> DataFrame:
    n = _current(spark, d)
    return inc.nodes_of_changed(n, inc.changed_files(n, _prior(n))).select("node_id")


def embedding_freshness(spark: SparkSession, d: str) -> DataFrame:
    return _current(spark, d).select("node_id", inc.embedding_is_fresh().alias("fresh"), inc.summary_is_fresh().alias("summary_fresh"), inc.self_documenting().alias("self_documenting"))


def carried_summaries(spark: SparkSession, d: str) -> DataFrame:
    n = _current(spark, d)
    fresh = n.withColumn("smart_content", F.lit(None).cast("string")).withColumn("smart_content_hash", F.lit(None).cast("string")).withColumn("embedding", F.lit(None).cast("array<array<double>>")).withColumn("smart_content_embedding", F.lit(None).cast("array<array<double>>"))
    out = inc.carry_summaries(fresh, _prior(n))
    return out.select("node_id", "carried", "smart_content", F.coalesce(F.size("embedding"), F.lit(-1)).alias("n_vectors"))


def carried_embeddings(spark: SparkSession, d: str) -> DataFrame:
    n = _current(spark, d)
    out = inc.carry_embeddings(n.withColumn("embedding", F.lit(None).cast("array<array<double>>")), _prior(n))
    return out.select("node_id", "carried", F.coalesce(F.size("embedding"), F.lit(-1)).alias("n_vectors"))


def overlaid(spark: SparkSession, d: str) -> DataFrame:
    n = _current(spark, d)
    results = n.where("node_seq % 5 = 0").select("node_id", F.concat(F.lit("summary of "), "node_id").alias("smart_content"))
    return inc.overlay(n.select("node_id", "smart_content"), results, ["smart_content"])


def fixture_lookup(spark: SparkSession, d: str) -> DataFrame:
    i = inc.fixture_index(table(spark, d, "code_nodes", "content", "embedding", "smart_content", "node_seq"))
    return i.select("content_hash", "smart_content", F.coalesce(F.size("embedding"), F.lit(0)).alias("n_vectors"))


def reference_pairs(spark: SparkSession, d: str) -> DataFrame:
    return refs.raw_edges(table(spark, d, "occurrences"))


def reference_edges(spark: SparkSession, d: str) -> DataFrame:
    return refs.map_to_nodes(refs.raw_edges(table(spark, d, "occurrences")), table(spark, d, "code_nodes", "node_id"))


def reused_edges(spark: SparkSession, d: str) -> DataFrame:
    n = _current(spark, d)
    return refs.reuse_prior(table(spark, d, "edges"), inc.changed_files(n, _prior(n)), n).select("src", "dst").distinct()


def cross_file_edges(spark: SparkSession, d: str) -> DataFrame:
    n = _current(spark, d)
    return refs.cross_file(table(spark, d, "occurrences"), n, table(spark, d, "edges"), inc.changed_files(n, _prior(n)))


def first_edges(spark: SparkSession, d: str) -> DataFrame:
    return g.first_edges(table(spark, d, "edges").where("src is not null and dst is not null"))


def symbol_names(spark: SparkSession, d: str) -> DataFrame:
    from heddle.functions.scalars import symbol_descriptor

    s = table(spark, d, "occurrences", "symbol").distinct().where("symbol is not null")
    x = symbol_descriptor(F.col("symbol"))
    return s.select("symbol", x.alias("descriptor"))


def char_chunks(spark: SparkSession, d: str) -> DataFrame:
    return c.by_chars(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", 200, 50)


def token_chunks(spark: SparkSession, d: str) -> DataFrame:
    """All nodes' contents by tokens."""
    return c.by_tokens(_current(spark, d), 200, 20)


def chunk_batches(spark: SparkSession, d: str) -> DataFrame:
    """Number of chunks per batch size."""
    items = table(spark, d, "chunk_items", "node_id", "chunk_index", "is_smart_content").distinct()
    b = c.batches(items, ["node_id", "is_smart_content", "chunk_index"], 16)
    return b.groupBy("batch").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("n_batches"))


def reassembled(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.concat(F.lit("n"), F.floor(F.col("vec_id") / 5).cast("string")).alias("node_id"), (F.col("vec_id") % 5).cast("int").alias("chunk_index"), (F.col("vec_id") % 5 == 4).alias("is_smart_content"), F.col("embedding").alias("vector"))
    r = c.reassemble(v)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    in_order = F.aggregate(F.transform("embedding", lambda v, i: (i + 1) * total(v)), F.lit(0.0), lambda s, x: s + x)
    smart = F.aggregate(F.transform("smart_content_embedding", total), F.lit(0.0), lambda s, x: s + x)
    return r.select("node_id", F.size("embedding").alias("n_raw"), F.size("smart_content_embedding").alias("n_smart"), F.round(in_order, 4).alias("raw_in_order"), F.round(smart, 4).alias("smart_total"))


def mean_vectors(spark: SparkSession, d: str) -> DataFrame:
    m = c.mean_vector(_current(spark, d).select("node_id", "embedding"))
    return m.select("node_id", F.round(F.col("mean")[0], 6).alias("first"), F.round(F.col("mean")[63], 6).alias("last"))


QUERIES = {f.__name__: f for f in (changed_files, nodes_to_rescan, embedding_freshness, carried_summaries, carried_embeddings, overlaid, fixture_lookup, reference_pairs, reference_edges, reused_edges, cross_file_edges, first_edges, symbol_names, char_chunks, token_chunks, chunk_batches, reassembled, mean_vectors)}

_P = f"""{CUR}, prior as (select * replace (case when node_seq % 7 = 0 then sha256(content || '!') else content_hash end as content_hash) from cur where node_seq % 11 <> 0),
changed as (select distinct c.file_path from cur c left join prior p on p.node_id = c.node_id where c.category = 'file' and (p.content_hash is null or p.content_hash <> c.content_hash))"""
_RAW = """o as (select * from occurrences where symbol <> '' and not starts_with(symbol, 'local ')),
d as (select symbol, arg_max(doc_path, occ_id) as def_file from o where symbol_roles & 1 = 1 group by 1),
raw as (select distinct o.doc_path as ref_file, d.def_file, symbol from o join d using (symbol) where o.symbol_roles & 1 = 0 and o.doc_path <> d.def_file)"""
_MAP = """parts as (select *, string_split(regexp_extract(symbol, '`([^`/]+)`(?:\\(\\))?\\.?$', 1), '.') as p from raw),
cand as (select ref_file, def_file, symbol, side, unnest([1, 2, 3, 4, 5, 6, 7]) as k, unnest(['callable:' || f || ':' || array_to_string(p, '.'), 'class:' || f || ':' || array_to_string(p, '.'), 'type:' || f || ':' || array_to_string(p, '.'),
  case when len(p) > 1 then 'callable:' || f || ':' || array_to_string(p[2:], '.') end, case when len(p) > 1 then 'class:' || f || ':' || array_to_string(p[2:], '.') end, case when len(p) > 1 then 'type:' || f || ':' || array_to_string(p[2:], '.') end, 'file:' || f]) as id
  from (select *, 'src' as side, ref_file as f from parts union all select *, 'dst', def_file from parts)),
hit as (select ref_file, def_file, symbol, side, arg_min(id, k) as node from cand where id in (select node_id from code_nodes) group by all),
mapped as (select distinct a.node as src, b.node as dst from hit a join hit b using (ref_file, def_file, symbol) where a.side = 'src' and b.side = 'dst' and a.node <> b.node)"""
_REUSED = f"""reused as (select distinct src, dst from edges where edge_type = 'references' and src in (select node_id from cur) and dst in (select node_id from cur)
and split_part(src, ':', 2) not in (select file_path from changed) and split_part(dst, ':', 2) not in (select file_path from changed))"""
_HAS = lambda c: f"coalesce(len({c}) > 0, false)"

def _chunks(most: int, overlap: int) -> str:
    """chunks (node_id, chunk_index, text, start_line, end_line) of t (node_id, content, base, ls)."""
    return f"""l as (select node_id, unnest(range(1, len(ls) + 1)) as i, unnest(ls) as line from t where length(content) // 4 > {most}),
p as (select node_id, i, line, (length(line) + 1) // 4 as n, sum((length(line) + 1) // 4) over w as tn, sum(length(line) + 1) over w as tc from l window w as (partition by node_id order by i)),
pl as (select node_id, list(tn::bigint order by i) as tn, list(tc::bigint order by i) as tc, count(*) as m from p group by 1),
st as (select node_id, 0::bigint as i, 1::bigint as held, 0::bigint as used, null::bigint as a, null::bigint as b from pl
  union all
  select node_id, i, case when n > {most} then i + 1 when full_ then again else held end, case when n > {most} then 0 when full_ then n + case when again < i then (tc[i - 1] - coalesce(tc[again - 1], 0)) // 4 else 0 end else used + n end,
    case when (n > {most} or full_) and held < i then held end, case when (n > {most} or full_) and held < i then i - 1 end
  from (select s.node_id, p.i, p.n, s.held, s.used, s.used + p.n > {most} as full_, pl.tn, pl.tc, list_filter(range(s.held, p.i + 1), lambda k: coalesce(pl.tn[p.i - 1], 0) - coalesce(pl.tn[k - 1], 0) <= {overlap})[1] as again
    from st s join p on p.node_id = s.node_id and p.i = s.i + 1 join pl on pl.node_id = s.node_id)),
w as (select node_id, i, line, greatest(100, floor({most}.0 * length(line) / greatest(length(line) // 4, 1) * 0.9)::bigint) as width from p where n > {most}),
c as (select node_id, i, 0 as kind, 0::bigint as k, a, b, null::varchar as piece from st where a is not null
  union all select node_id, i, 1, unnest(range(0, length(line), width)), i, i, null from w
  union all select st.node_id, st.i + 1, 2, 0, st.held, st.i, null from st join pl on pl.node_id = st.node_id and pl.m = st.i where st.held <= st.i),
x as (select c.node_id, c.i, c.kind, c.k, c.a, c.b, case when c.kind = 1 then substring(w.line, c.k + 1, w.width) else regexp_replace(array_to_string(t.ls[c.a:c.b], chr(10)), '\\n+$', '') end as text, t.base
  from c join t on t.node_id = c.node_id left join w on w.node_id = c.node_id and w.i = c.i and c.kind = 1),
chunks as (select node_id, (row_number() over (partition by node_id order by i, kind, k) - 1)::int as chunk_index, text, (base + a)::int as start_line, (base + b)::int as end_line from x
union all select node_id, 0, content, (base + 1)::int, (base + len(ls))::int from t where length(content) // 4 <= {most})"""


ORACLE = {
    "token_chunks": f"with recursive {CUR}, t as (select node_id, content, coalesce(start_line, 1) - 1 as base, string_split(content, chr(10)) as ls from cur where regexp_matches(content, '\\S')), {_chunks(200, 20)} select * from chunks",
    "changed_files": f"with {_P} select * from changed",
    "nodes_to_rescan": f"with {_P} select node_id from cur where file_path in (select file_path from changed)",
    "embedding_freshness": f"""with {CUR}, x as (select *, case when length(leading_context) > 0 then sha256(leading_context || chr(10) || content) else content_hash end as expected from cur)
select node_id, (length(regexp_replace(coalesce(content, ''), '^\\s+|\\s+$', '', 'g')) = 0 or {_HAS('embedding')}) and coalesce(embedding_hash = expected, false)
  and (coalesce(starts_with(smart_content, '[Empty content'), false) or smart_content is null or {_HAS('smart_content_embedding')}) as fresh,
coalesce(smart_content_hash = content_hash and smart_content is not null, false) as summary_fresh, content_type = 'content' and category = 'section' and language in ('markdown', 'rst') as self_documenting from x""",
    "carried_summaries": f"""with {_P}, j as (select c.node_id, p.smart_content, p.embedding, coalesce(p.content_hash = c.content_hash, false) as same, {_HAS('p.embedding')} or {_HAS('p.smart_content_embedding')} as vec from cur c left join prior p using (node_id))
select node_id, case when same and smart_content is not null then 'summary' when same and vec then 'vectors' else 'nothing' end as carried, case when same then smart_content end as smart_content,
coalesce(case when same and (smart_content is not null or vec) then len(embedding) end, -1)::int as n_vectors from j""",
    "carried_embeddings": f"""with {_P}, j as (select c.node_id, p.embedding, coalesce(p.embedding_hash = case when length(c.leading_context) > 0 then sha256(c.leading_context || chr(10) || c.content) else c.content_hash end, false)
and ({_HAS('p.embedding')} or {_HAS('p.smart_content_embedding')}) as ok from cur c left join prior p using (node_id))
select node_id, ok as carried, coalesce(case when ok then len(embedding) end, -1)::int as n_vectors from j""",
    "overlaid": f"with {CUR} select node_id, case when node_seq % 5 = 0 then 'summary of ' || node_id else smart_content end as smart_content from cur",
    "fixture_lookup": "select sha256(content) as content_hash, arg_max(smart_content, node_seq) filter (where smart_content is not null) as smart_content, coalesce(len(arg_max(embedding, node_seq) filter (where len(embedding) > 0)), 0)::int as n_vectors from code_nodes group by 1",
    "reference_pairs": f"with {_RAW} select * from raw",
    "reference_edges": f"with {_RAW}, {_MAP} select * from mapped",
    "reused_edges": f"with {_P}, {_REUSED} select * from reused",
    "cross_file_edges": f"with {_P}, {_RAW}, {_MAP}, {_REUSED} select src, dst, 'reused' as origin from reused union all select src, dst, 'fresh' from mapped m where not exists (select 1 from reused r where r.src = m.src and r.dst = m.dst)",
    "first_edges": "select edge_seq, src, dst, edge_type from edges where src is not null and dst is not null qualify row_number() over (partition by src, dst order by edge_seq) = 1",
    "symbol_names": "select distinct symbol, case when not starts_with(symbol, 'local ') and len(string_split(symbol, ' ')) >= 5 then array_to_string(string_split(symbol, ' ')[5:], ' ') end as descriptor from occurrences where symbol is not null",
    "char_chunks": """with s as (select doc_id, text, unnest(case when length(text) <= 200 then [0] else range(0, length(text), 150) end) as a from documents where length(text) > 0),
p as (select doc_id, (a // 150)::int as chunk_index, substr(text, a::int + 1, 200) as piece, left(text, a::int) as before from s)
select doc_id, chunk_index, piece as text, (1 + length(before) - length(replace(before, chr(10), '')))::int as start_line,
(1 + length(before) - length(replace(before, chr(10), '')) + length(piece) - length(replace(piece, chr(10), '')))::int as end_line from p""",
    "chunk_batches": """with n as (select count(*) as n from (select distinct node_id, chunk_index, is_smart_content from chunk_items))
select * from (select 16::bigint as n, n // 16 as n_batches from n union all select n % 16, 1 from n) where n > 0 and n_batches > 0""",
    "reassembled": """with v as (select 'n' || (vec_id // 5) as node_id, vec_id % 5 as i, embedding from embeddings)
select node_id, (count(*) filter (where i < 4))::int as n_raw, (nullif(count(*) filter (where i = 4), 0))::int as n_smart, round(sum((i + 1) * list_sum(embedding::double[])) filter (where i < 4), 4) as raw_in_order, round(sum(list_sum(embedding::double[])) filter (where i = 4), 4) as smart_total from v group by 1""",
    "mean_vectors": f"""with {CUR}, c as (select node_id, unnest(embedding) as vec, len(embedding[1]) as n from cur where len(embedding) > 0)
select node_id, round(avg(vec[1]), 6) as first, round(avg(vec[64]), 6) as last from c where len(vec) = n group by 1""",
}
#: For the query of the embedding stage.
EMBEDDED = f"""with recursive {CUR}, exp as (select *, case when length(leading_context) > 0 then sha256(leading_context || chr(10) || content) else content_hash end as expected from cur),
todo as (select * from exp where not ((length(regexp_replace(coalesce(content, ''), '^\\s+|\\s+$', '', 'g')) = 0 or {_HAS('embedding')}) and coalesce(embedding_hash = expected, false)
  and (coalesce(starts_with(smart_content, '[Empty content'), false) or smart_content is null or {_HAS('smart_content_embedding')}))),
y as (select node_id, case when length(leading_context) > 0 then leading_context || chr(10) || content else content end as content, coalesce(start_line, 1) - 1 as base from todo),
t as (select *, string_split(content, chr(10)) as ls from y where regexp_matches(content, '\\S')), {_chunks(4000, 50)},
r as (select node_id, count(*) as n from chunks group by 1),
m as (select node_id, 1 as n from todo where length(smart_content) > 0 and not coalesce(starts_with(smart_content, '[Empty content'), false))
select node_id, coalesce(r.n, 0)::int as n_raw, coalesce(m.n, 0)::int as n_smart, expected as embedding_hash, 0::bigint as n_failed from todo left join r using (node_id) left join m using (node_id) where r.n > 0 or m.n > 0"""
