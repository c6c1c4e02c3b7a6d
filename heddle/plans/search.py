"""Queries of search, scalars, filters and aggregates over hits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from heddle.functions import scalars as S
from heddle.operators import graph, search as op
from heddle.session import only_row, table

NODES = ["node_id", "node_seq", "start_line", "end_line", "content", "smart_content", "leading_context", "embedding", "smart_content_embedding", "embedding_chunk_offsets"]


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_nodes")


def edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edges")


TEXT = op.QuerySpec("queue", "text", limit=50, offset=10, include=(r"\.py",), exclude=("vendor/", "third_party/"))
REGEX = op.QuerySpec(r"def (merge|split)_\w+", "regex", limit=10_000_000)
TEXT_ALL = op.QuerySpec("registry", "text", limit=10_000_000)


def search_text(spark: SparkSession, d: str) -> DataFrame:
    """Page of a text search: filters, parent penalty, rank order."""
    return op.page_of(nodes(spark, d), edges(spark, d), TEXT, "text").select("node_id", F.round("score", 6).alias("score"), "match_field", "snippet", "match_start_line", "match_end_line")


def search_text_all(spark: SparkSession, d: str) -> DataFrame:
    """Every hit of a text search with its penalised score."""
    hits = op.hits_of(nodes(spark, d), edges(spark, d), TEXT_ALL, "text")
    return hits.select("node_id", F.round("score", 6).alias("score"), "match_field", "first_seq")


def search_regex_all(spark: SparkSession, d: str) -> DataFrame:
    hits = op.hits_of(nodes(spark, d), edges(spark, d), REGEX, "regex")
    return hits.select("node_id", F.round("score", 6).alias("score"), "match_field", "match_start_line", "match_end_line", "snippet")


def _query_vector(text: str = "where the queue is merged", dim: int = 64) -> list[float]:
    import hashlib

    digest = hashlib.sha256(text.encode()).digest()
    return [(digest[i % 32] ^ (i & 255)) / 127.5 - 1 for i in range(dim)]


def search_semantic(spark: SparkSession, d: str) -> DataFrame:
    spec = op.QuerySpec("where the queue is merged", "semantic", limit=10_000_000, min_similarity=0.05)
    hits = op.hits_of(nodes(spark, d), edges(spark, d), spec, "semantic", _query_vector(), penalty=0.0)
    return hits.select("node_id", F.round("score", 6).alias("score"), "match_field", "chunk_index")


def search_envelope(spark: SparkSession, d: str) -> DataFrame:
    hits = op.hits_of(nodes(spark, d), edges(spark, d), TEXT, "text", penalty=0.0)
    e = op.envelope(hits, op.page(hits, TEXT), TEXT)
    return e.select("total", "showing", "offset", "limit", F.array_join(F.transform(F.array_sort(F.map_entries("folders")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias("folders"))


def search_max(spark: SparkSession, d: str) -> DataFrame:
    """The page of search_text with all thirteen columns."""
    return op.project_hits(op.page_of(nodes(spark, d), edges(spark, d), TEXT, "text"), nodes(spark, d), "max").select("node_id", F.round("score", 6).alias("score"), "smart_content", "content", F.size("matched_lines").alias("n_lines"), "chunk_index")


SLOW = op.QuerySpec(r"def (?:[a-z]+_)+queue\b", "regex", limit=10_000_000)


def search_regex_timed(spark: SparkSession, d: str) -> DataFrame:
    """A pattern whose repetition is nested, so that every search has a time limit."""
    hits = op.hits_of(nodes(spark, d), edges(spark, d), SLOW, "regex", penalty=0.0)
    return hits.select("node_id", F.round("score", 6).alias("score"), "match_field", "first_seq")


def tool_envelope(spark: SparkSession, d: str) -> DataFrame:
    hits = op.hits_of(nodes(spark, d), edges(spark, d), TEXT, "text", penalty=0.0)
    e = op.tool_envelope(hits, op.page(hits, TEXT), TEXT)
    return e.select("total", "showing", "filtered", F.array_join("include", "|").alias("include"), F.array_join("exclude", "|").alias("exclude"))


def folder_distribution(spark: SparkSession, d: str) -> DataFrame:
    return op.folder_distribution(table(spark, d, "code_nodes", "node_id").distinct())


def folder_drill(spark: SparkSession, d: str) -> DataFrame:
    """One repository: its first folder holds everything, so it is split."""
    return op.folder_distribution(table(spark, d, "code_nodes", "node_id").where("split_part(node_id, ':', 2) like 'lanternfs/%'").distinct())


def vector_coverage(spark: SparkSession, d: str) -> DataFrame:
    return op.coverage(nodes(spark, d))


def glob_filters(spark: SparkSession, d: str) -> DataFrame:
    """Distinct ids that each of several user filters keeps."""
    ids = table(spark, d, "code_nodes", "node_id").distinct()
    checks = [F.count_if(F.col("node_id").rlike(S.normalize_filter(p))).alias(name) for name, p in (("py", "*.py"), ("ext_rs", ".rs"), ("callables", "callable:*"), ("index", "inde?.ts"), ("regex", "(queue|stage)"))]
    return ids.agg(*checks)


def node_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Scalar functions over every distinct node."""
    n = table(spark, d, "code_nodes", "node_id", "ts_kind", "name", "category", "start_line", "end_line", "content", "content_hash").distinct()
    p = S.file_path(F.col("node_id"))
    return n.select(
        "node_id", p.alias("path"), S.extension(p).alias("ext"), S.classify(F.col("ts_kind")).alias("class"), S.is_minified(p).alias("minified"), S.folder(p).alias("folder"),
        F.round(S.line_size(F.col("start_line"), F.col("end_line")), 6).alias("size"), S.token_estimate(F.col("content")).alias("tokens"), (S.content_hash(F.col("content")) != F.col("content_hash")).alias("stale_hash"),
        F.array_join(S.name_words(F.coalesce("name", F.lit(""))), " ").alias("words"), S.is_trivial(F.col("content")).alias("trivial"),
    )


def languages(spark: SparkSession, d: str) -> DataFrame:
    """Files per detected language, and how many agree with the recorded one."""
    f = table(spark, d, "code_nodes", "file_path", "language", "category").where("category = 'file'").distinct()
    g = f.withColumn("detected", S.detect_language(F.col("file_path")))
    return g.groupBy(F.coalesce("detected", F.lit("(none)")).alias("detected")).agg(F.count("*").alias("n"), F.count_if(F.col("detected") == F.col("language")).alias("n_same"))


def skip_summary(spark: SparkSession, d: str) -> DataFrame:
    """Files per extension that no language is known for or that are minified."""
    f = table(spark, d, "code_nodes", "file_path").distinct()
    skip = f.where(S.detect_language(F.col("file_path")).isNull() | S.is_minified(F.col("file_path")))
    ext = S.extension(F.col("file_path"))
    return skip.groupBy(F.when(ext == "", "(no extension)").otherwise(ext).alias("ext")).agg(F.count("*").alias("n"))


def extension_summary(spark: SparkSession, d: str) -> DataFrame:
    p = S.file_path(F.col("node_id"))
    ext = S.extension(p)
    n = table(spark, d, "code_nodes", "node_id").distinct()
    return n.groupBy(F.when(ext == "", "(no ext)").otherwise(ext).alias("ext")).agg(F.count("*").alias("n_nodes"), F.countDistinct(p).alias("n_files"))


def top_extensions(spark: SparkSession, d: str) -> DataFrame:
    """The five most frequent extensions and how many others there are."""
    s = extension_summary(spark, d)
    top = s.orderBy(F.col("n_nodes").desc(), "ext").limit(5)
    more = s.agg(F.greatest(F.lit(0), F.count("*") - 5).alias("n_nodes")).select(F.lit("(more)").alias("ext"), F.col("n_nodes").cast("long"))
    return top.select("ext", "n_nodes").unionByName(more)


def hash_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """First and last number and the sum of the deterministic vector of every text."""
    docs = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    v = docs.select("doc_id", S.hash_embedding(F.col("text"), 48).alias("v"))
    return v.select("doc_id", F.round(F.col("v")[0], 9).alias("first"), F.round(F.col("v")[47], 9).alias("last"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def cosine_to_first(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each vector to vector 0, clamped at 0."""
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    q = only_row(e.where("vec_id = 0"))["embedding"]
    return e.select("vec_id", F.round(S.cosine(F.col("embedding"), F.lit([float(x) for x in q])), 6).alias("score"))


def node_projection(spark: SparkSession, d: str) -> DataFrame:
    """Display fields of every node's last version, with its references, vectors left out."""
    n = graph.upsert_nodes(table(spark, d, "code_nodes", "node_id", "node_seq", "name", "category", "start_line", "end_line", "signature", "language"))
    rel = graph.relationships(graph.upsert_edges(edges(spark, d), nodes(spark, d)))
    r = rel.withColumnRenamed("node_id", "rid")
    return n.join(r, n.node_id == r.rid, "left").select(
        "node_id", "name", "category", "start_line", "end_line", "signature", "language",
        F.coalesce(F.array_join("referenced_by", "|"), F.lit("")).alias("referenced_by"), F.coalesce(F.array_join("references", "|"), F.lit("")).alias("references"),
    )


QUERIES = {f.__name__: f for f in (search_text, search_text_all, search_regex_all, search_semantic, search_envelope, search_max, search_regex_timed, tool_envelope, folder_distribution, folder_drill, vector_coverage, glob_filters, node_scalars, languages, skip_summary, extension_summary, top_extensions, hash_embeddings, cosine_to_first, node_projection)}

CUR = """v as (select node_id, min(node_seq) as first_seq, max(node_seq) as last_seq from code_nodes where node_id is not null group by 1),
cur as (select n.*, v.first_seq from code_nodes n join v on n.node_id = v.node_id and n.node_seq = v.last_seq)"""


def _matched(pattern: str) -> str:
    return f"""matched as (
  select node_id, first_seq, start_line, end_line, content, smart_content, leading_context,
    case when regexp_matches(node_id, '{pattern}') then 'node_id'
         when leading_context <> '' and regexp_matches(leading_context, '{pattern}') then 'leading_context'
         when content <> '' and regexp_matches(content, '{pattern}') then 'content'
         when smart_content <> '' and regexp_matches(smart_content, '{pattern}') then 'smart_content' end as match_field,
    case when regexp_matches(node_id, '{pattern}') then case when regexp_extract(node_id, '{pattern}') = node_id then 1.0::double else 0.8::double end
         when leading_context <> '' and regexp_matches(leading_context, '{pattern}') then 0.6::double else 0.5::double end as raw
  from cur)"""


PENALTY = """
par as (select dst as id, arg_min(src, edge_seq) as up from edges where edge_type is null group by 1),
walk as (
  select h.node_id, p.up as anc, 1 as depth, [h.node_id, p.up] as seen from hits h join par p on p.id = h.node_id where p.up <> h.node_id
  union all
  select w.node_id, p.up, w.depth + 1, list_append(w.seen, p.up) from walk w join par p on p.id = w.anc where not list_contains(w.seen, p.up)),
deep as (select anc, max(depth) as deep from walk where anc in (select node_id from hits) group by 1),
ranked as (select h.*, case when d.deep is not null and h.raw < 1 then greatest(0, least(1, h.raw * pow(0.75, d.deep))) else h.raw end as score
  from hits h left join deep d on d.anc = h.node_id)"""

_EXT = r"lower(regexp_extract({p}, '[^/](\.[^./]*[^./])$', 1))"
_PATH = "split_part(node_id, ':', 2)"
_FOLDERS = """p as (select {path} as path from ids),
f as (select case when contains(path, '/') then split_part(path, '/', 1) || '/' else '(root)' end as f1,
  case when contains(path, '/') then split_part(path, '/', 1) || '/' || split_part(path, '/', 2) || '/' else path || '/' end as f2 from p),
big as (select f1 from f group by 1 having count(*) / (select count(*) from f) >= 0.9),
folders as (select case when f1 in (select f1 from big) then f2 else f1 end as folder, count(*) as n from f group by 1)"""
_FOLDERS = _FOLDERS.replace("{path}", _PATH)
_CLASS = """case when ts_kind in ('module','program','source_file','document','compilation_unit','translation_unit','config_file','stream') then 'file'
  when suffix(ts_kind, '_instruction') or ts_kind = 'block' or suffix(ts_kind, '_block') then 'block'
  when regexp_matches(ts_kind, 'function|method|lambda|procedure') then 'callable'
  when regexp_matches(ts_kind, 'class|struct|interface|enum|type_alias|trait|impl') then 'type'
  when contains(ts_kind, 'heading') then 'section' when suffix(ts_kind, '_statement') then 'statement' when suffix(ts_kind, '_expression') then 'expression'
  when regexp_matches(ts_kind, '(_definition|_declaration|_item|_specifier)$') then 'definition' else 'other' end"""
# Fixed values, written out once more so that the comparison does not rest on the table of the engine.
_LANG = """case
    when name in ('Dockerfile') then 'dockerfile'
    when name in ('Makefile') then 'make'
    when name in ('CMakeLists.txt') then 'cmake'
    when name in ('Jenkinsfile') then 'groovy'
    when name in ('Vagrantfile', 'Gemfile', 'Rakefile') then 'ruby'
    when name in ('.gitignore') then 'gitignore'
    when name in ('.gitattributes') then 'gitattributes'
    when name in ('BUILD', 'BUILD.bazel', 'WORKSPACE') then 'starlark'
    when name in ('meson.build', 'meson_options.txt') then 'meson'
    when starts_with(name, 'Dockerfile') then 'dockerfile'
    when ext in ('.py', '.pyi', '.pyw') then 'python'
    when ext in ('.js', '.mjs', '.cjs', '.jsx') then 'javascript'
    when ext in ('.ts') then 'typescript'
    when ext in ('.tsx') then 'tsx'
    when ext in ('.html', '.htm') then 'html'
    when ext in ('.css') then 'css'
    when ext in ('.scss') then 'scss'
    when ext in ('.json') then 'json'
    when ext in ('.yaml', '.yml') then 'yaml'
    when ext in ('.toml') then 'toml'
    when ext in ('.xml') then 'xml'
    when ext in ('.md', '.markdown') then 'markdown'
    when ext in ('.rst') then 'rst'
    when ext in ('.txt', '.csv', '.tsv', '.example') then 'plaintext'
    when ext in ('.tf', '.tfvars') then 'hcl'
    when ext in ('.c') then 'c'
    when ext in ('.h', '.hpp', '.cpp', '.cc', '.cxx', '.hh', '.hxx') then 'cpp'
    when ext in ('.rs') then 'rust'
    when ext in ('.go') then 'go'
    when ext in ('.cs') then 'csharp'
    when ext in ('.java') then 'java'
    when ext in ('.kt', '.kts') then 'kotlin'
    when ext in ('.scala') then 'scala'
    when ext in ('.swift') then 'swift'
    when ext in ('.dart') then 'dart'
    when ext in ('.gd') then 'gdscript'
    when ext in ('.cu', '.cuh') then 'cuda'
    when ext in ('.sh', '.bash', '.zsh') then 'bash'
    when ext in ('.fish') then 'fish'
    when ext in ('.ps1') then 'powershell'
    when ext in ('.rb') then 'ruby'
    when ext in ('.lua') then 'lua'
    when ext in ('.pl') then 'perl'
    when ext in ('.php') then 'php'
    when ext in ('.ini') then 'ini'
    when ext in ('.sql') then 'sql'
    when ext in ('.graphql', '.gql') then 'graphql'
    when ext in ('.make') then 'make'
    when ext in ('.cmake') then 'cmake'
    when ext in ('.ex', '.exs') then 'elixir'
    when ext in ('.erl') then 'erlang'
    when ext in ('.hs') then 'haskell'
    when ext in ('.ml') then 'ocaml'
    when ext in ('.mli') then 'ocaml_interface'
    when ext in ('.fs') then 'fsharp'
    when ext in ('.fsi') then 'fsharp_signature'
    when ext in ('.clj') then 'clojure'
    when ext in ('.scm') then 'scheme'
    when ext in ('.rkt') then 'racket'
    when ext in ('.nim') then 'nim'
    when ext in ('.zig') then 'zig'
    when ext in ('.v') then 'v'
    when ext in ('.d') then 'd'
    when ext in ('.r') then 'r'
    when ext in ('.jl') then 'julia'
    when ext in ('.vue') then 'vue'
    when ext in ('.svelte') then 'svelte'
    when ext in ('.astro') then 'astro'
    when ext in ('.heex') then 'heex'
    when ext in ('.twig') then 'twig'
    when ext in ('.glsl', '.vert', '.frag', '.geom', '.comp') then 'glsl'
    when ext in ('.hlsl', '.fx') then 'hlsl'
    when ext in ('.wgsl') then 'wgsl'
    when ext in ('.sv', '.svh') then 'verilog'
    when ext in ('.vhd', '.vhdl') then 'vhdl'
    when ext in ('.sol') then 'solidity'
    when ext in ('.cairo') then 'cairo'
    when ext in ('.odin') then 'odin'
    when ext in ('.gleam') then 'gleam'
    when ext in ('.ha') then 'hare'
    when ext in ('.pony') then 'pony'
    when ext in ('.hx') then 'haxe'
    when ext in ('.lisp', '.cl', '.lsp') then 'commonlisp'
    when ext in ('.elm') then 'elm'
    when ext in ('.purs') then 'purescript'
    when ext in ('.nix') then 'nix'
    when ext in ('.proto') then 'proto'
    when ext in ('.jsonnet', '.libsonnet') then 'jsonnet'
    when ext in ('.kdl') then 'kdl'
    when ext in ('.ron') then 'ron'
    when ext in ('.prisma') then 'prisma'
    when ext in ('.thrift') then 'thrift'
    when ext in ('.star', '.bzl') then 'starlark'
    when ext in ('.f', '.for', '.f90', '.f95') then 'fortran'
    when ext in ('.cob', '.cbl') then 'cobol'
    when ext in ('.pas') then 'pascal'
    when ext in ('.adb', '.ads') then 'ada'
    when ext in ('.mm') then 'objc'
    when ext in ('.tex', '.sty') then 'latex'
    when ext in ('.typ') then 'typst'
    when ext in ('.org') then 'org'
  end"""
_FILES = f"files as (select distinct file_path, language, category, split_part(file_path, '/', -1) as name, {_EXT.format(p='file_path')} as ext from code_nodes)"
_TEXT_PATTERN = S.literal_regex("queue")
_TEXT_FILTER = r"regexp_matches(node_id, '\.py') and not regexp_matches(node_id, 'vendor/') and not regexp_matches(node_id, 'third_party/')"
_VEC = "[" + ",".join(f"{x!r}" for x in _query_vector()) + "]::double[]"
_LINES = """,
pos as (select *, case match_field when 'leading_context' then leading_context when 'content' then content else smart_content end as searched from ranked),
loc as (select *, strpos(searched, regexp_extract(searched, '{p}')) - 1 as off, length(regexp_extract(searched, '{p}')) as len,
  case when match_field = 'content' then content else coalesce(smart_content, '') end as shown from pos),
ln as (select *, length(left(content, off::int)) - length(replace(left(content, off::int), chr(10), '')) as l1,
  length(left(content, (off + len)::int)) - length(replace(left(content, (off + len)::int), chr(10), '')) as l2,
  length(left(shown, off::int)) - length(replace(left(shown, off::int), chr(10), '')) as l3 from loc)"""
_SHOWN = """case when match_field in ('smart_content', 'node_id') then start_line else start_line + l1 end::int as match_start_line,
case when match_field = 'smart_content' then end_line when match_field = 'node_id' then start_line else start_line + l2 end::int as match_end_line,
case when match_field = 'node_id' then node_id else coalesce(string_split(shown, chr(10))[l3 + 1], shown[:50]) end as snippet"""

ORACLE = {
    "search_text": f"""with recursive {CUR}, {_matched(_TEXT_PATTERN)}, hits as (select * from matched where match_field is not null and {_TEXT_FILTER}), {PENALTY}{_LINES.format(p=_TEXT_PATTERN)}
select node_id, round(score, 6) as score, match_field, {_SHOWN} from ln order by score desc, first_seq limit 50 offset 10""",
    "search_text_all": f"""with recursive {CUR}, {_matched(S.literal_regex("registry"))}, hits as (select * from matched where match_field is not null), {PENALTY}
select node_id, round(score, 6) as score, match_field, first_seq from ranked""",
    "search_regex_all": f"""with recursive {CUR}, {_matched(REGEX.pattern)}, hits as (select * from matched where match_field is not null), {PENALTY}{_LINES.format(p=REGEX.pattern)}
select node_id, round(score, 6) as score, match_field, {_SHOWN} from ln""",
    "search_semantic": f"""with {CUR}, q as (select {_VEC} as q),
c as (select node_id, 1 as raw, unnest(range(len(embedding))) as i, unnest(embedding) as vec from cur union all
  select node_id, 0, unnest(range(len(smart_content_embedding))), unnest(smart_content_embedding) from cur),
s as (select node_id, raw, i, case when list_dot_product(vec, vec) = 0 then 0 else greatest(0, list_cosine_similarity(vec, q)) end as s from c, q where len(vec) = 64),
b as (select *, row_number() over (partition by node_id order by s desc, raw desc, i) as r from s)
select node_id, round(s, 6) as score, case when raw = 1 then 'embedding' else 'smart_content_embedding' end as match_field, i::int as chunk_index from b where r = 1 and s >= 0.05""",
    "search_envelope": f"""with {CUR}, {_matched(_TEXT_PATTERN)}, ids as (select node_id from matched where match_field is not null and {_TEXT_FILTER}), {_FOLDERS}
select (select count(*) from ids) as total, least(50, greatest(0, (select count(*) from ids) - 10)) as showing, 10 as "offset", 50 as "limit", (select string_agg(folder || '=' || n, ',' order by folder) from folders) as folders""",
    "search_max": f"""with recursive {CUR}, {_matched(_TEXT_PATTERN)}, hits as (select * from matched where match_field is not null and {_TEXT_FILTER}), {PENALTY}{_LINES.format(p=_TEXT_PATTERN)},
page as (select node_id, score, {_SHOWN} from ln order by score desc, first_seq limit 50 offset 10)
select p.node_id, round(score, 6) as score, c.smart_content, c.content, case when match_end_line >= match_start_line then match_end_line - match_start_line + 1 end as n_lines, null::int as chunk_index from page p join cur c on c.node_id = p.node_id""",
    "search_regex_timed": f"with {CUR}, {_matched(SLOW.pattern)} select node_id, round(raw, 6) as score, match_field, first_seq from matched where match_field is not null",
    "tool_envelope": f"""with {CUR}, {_matched(_TEXT_PATTERN)}, ids as (select node_id from matched where match_field is not null and {_TEXT_FILTER})
select count(*) as total, least(50, greatest(0, count(*) - 10)) as showing, count(*) as filtered, '\\.py' as include, 'vendor/|third_party/' as exclude from ids""",
    "folder_distribution": f"with ids as (select distinct node_id from code_nodes), {_FOLDERS} select folder, n from folders",
    "folder_drill": f"with ids as (select distinct node_id from code_nodes where {_PATH} like 'lanternfs/%'), {_FOLDERS} select folder, n from folders",
    "vector_coverage": """select count(*) as n_nodes, count(*) filter (where len(embedding) > 0 or len(smart_content_embedding) > 0) as n_with_vectors,
round(1 - (count(*) filter (where len(embedding) > 0 or len(smart_content_embedding) > 0)) / count(*), 6) as missing_share from code_nodes""",
    "glob_filters": r"""with ids as (select distinct node_id from code_nodes)
select count(*) filter (where regexp_matches(node_id, '\.py(?:$|:)')) as py, count(*) filter (where regexp_matches(node_id, '\.rs(?:$|:)')) as ext_rs,
count(*) filter (where starts_with(node_id, 'callable:') or contains(node_id, 'callable:')) as callables, count(*) filter (where regexp_matches(node_id, 'inde.\.ts(?:$|:)')) as "index",
count(*) filter (where regexp_matches(node_id, '(queue|stage)')) as regex from ids""",
    "node_scalars": rf"""with n as (select distinct node_id, ts_kind, name, category, start_line, end_line, content, content_hash, {_PATH} as path from code_nodes)
select node_id, path, {_EXT.format(p='path')} as ext, {_CLASS} as class, regexp_matches(lower(path), '\.min\.(js|css|mjs)$') as minified,
case when contains(path, '/') then split_part(path, '/', 1) || '/' else '(root)' end as folder,
round(case when start_line is null or end_line is null then 4 else greatest(4, least(14, 3 + 1.5 * log2(greatest(1, end_line - start_line + 1) + 1))) end, 6) as size, (length(content) // 4)::int as tokens, sha256(content) <> content_hash as stale_hash,
array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(coalesce(name, ''), '([a-z])([A-Z])', '\1 \2', 'g')), '[ _]'), lambda w: w <> ''), ' ') as words,
length(regexp_replace(coalesce(content, ''), '^\s+|\s+$', '', 'g')) < 50 as trivial from n""",
    "languages": f"with {_FILES}, g as (select {_LANG} as detected, language from files where category = 'file') select coalesce(detected, '(none)') as detected, count(*) as n, count(*) filter (where detected = language) as n_same from g group by 1",
    "skip_summary": f"with {_FILES}, d as (select distinct file_path, name, ext from files) select case when ext = '' then '(no extension)' else ext end as ext, count(*) as n from d where {_LANG} is null or regexp_matches(lower(name), '\\.min\\.(js|css|mjs)$') group by 1",
    "extension_summary": f"with n as (select distinct node_id, {_PATH} as path from code_nodes) select case when {_EXT.format(p='path')} = '' then '(no ext)' else {_EXT.format(p='path')} end as ext, count(*) as n_nodes, count(distinct path) as n_files from n group by 1",
    "top_extensions": f"""with n as (select distinct node_id, {_PATH} as path from code_nodes), s as (select case when {_EXT.format(p='path')} = '' then '(no ext)' else {_EXT.format(p='path')} end as ext, count(*) as n_nodes from n group by 1)
select * from (select ext, n_nodes from s order by n_nodes desc, ext limit 5) union all select '(more)', greatest(0, count(*) - 5) from s""",
    "hash_embeddings": """with h as (select doc_id, sha256(text) as h from documents where text is not null),
v as (select doc_id, list_transform(range(48), lambda i: xor(('0x' || substr(h, ((i % 32) * 2 + 1)::int, 2))::int, i::int) / 127.5 - 1.0) as v from h)
select doc_id, round(v[1], 9) as first, round(v[48], 9) as last, round(list_sum(v), 6) as total from v""",
    "cosine_to_first": "select e.vec_id, round(greatest(0, list_cosine_similarity(e.embedding::double[], q.embedding::double[])), 6) as score from embeddings e, (select embedding from embeddings where vec_id = 0) q",
    "node_projection": f"""with {CUR}, ids as (select node_id from cur),
e as (select src, dst, min(edge_seq) as edge_seq, arg_max(edge_type, edge_seq) filter (where edge_type is not null) as edge_type from edges where src in (select node_id from ids) and dst in (select node_id from ids) group by 1, 2),
b as (select dst as id, string_agg(src, '|' order by edge_seq) as r from e where edge_type = 'references' group by 1), t as (select src as id, string_agg(dst, '|' order by edge_seq) as r from e where edge_type = 'references' group by 1)
select node_id, name, category, start_line, end_line, signature, language, coalesce(b.r, '') as referenced_by, coalesce(t.r, '') as "references" from cur left join b on b.id = node_id left join t on t.id = node_id""",
}
