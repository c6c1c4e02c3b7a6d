"""Queries of parsing, sources and streaming, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from heddle.operators import parsing
from heddle.session import shared_dir, table
from heddle.sources import files
from heddle.streaming import watch


def _files(spark: SparkSession, d: str, language: str) -> DataFrame:
    f = table(spark, d, "code_nodes", "file_path", "language", "content", "category").where((F.col("category") == "file") & (F.col("language") == language))
    return f.select("file_path", "language", "content").distinct()


def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    return parsing.parse(_files(spark, d, "markdown")).where("category = 'section'").select("node_id", "name", "start_line", "end_line", "start_byte", "end_byte", "signature", "content_hash")


def python_definitions(spark: SparkSession, d: str) -> DataFrame:
    return parsing.parse(_files(spark, d, "python")).select("node_id", "category", "name", "start_line", "end_line", "parent_node_id", "signature", "is_error")


def definitions(spark: SparkSession, d: str) -> DataFrame:
    """Types, functions and methods of every language that has a grammar beside Python."""
    f = table(spark, d, "code_nodes", "file_path", "language", "content", "category").where((F.col("category") == "file") & F.col("language").isin("javascript", "typescript", "go", "rust"))
    return parsing.parse(f.select("file_path", "language", "content").distinct()).select("node_id", "category", "ts_kind", "name", "start_line", "end_line", "parent_node_id", "signature", "is_error")


GRAMMARS = ["python", "javascript", "typescript", "go", "rust"]


def recorded_definitions(spark: SparkSession, d: str) -> DataFrame:
    """Types, functions and methods that the table records for whole files, as parsing them gives them again."""
    n = table(spark, d, "code_nodes", "node_id", "file_path", "language", "content", "category", "ts_kind", "truncated").where(F.col("language").isin(GRAMMARS))
    whole = n.where("category = 'file' and not truncated").select("file_path", "language", "content").distinct()
    found = parsing.parse(whole).where("category in ('callable', 'type')").select("node_id", "ts_kind", "file_path").distinct()
    recorded = n.where("category in ('callable', 'type')").select("node_id").distinct()
    return found.join(recorded, "node_id", "left_semi").select("node_id", "ts_kind", "file_path")


def project_markers(spark: SparkSession, d: str) -> DataFrame:
    """Project roots among the real paths and invented marker files beside them."""
    paths = table(spark, d, "code_nodes", "file_path").distinct().select(F.col("file_path").alias("path"))
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    invented = F.array(*map(F.lit, ["pyproject.toml", "setup.cfg", "Pipfile", "tsconfig.json", "package.json", "go.mod", "Cargo.toml", "pom.xml", "build.gradle.kts", "App.csproj", "All.sln", "Gemfile", "requirements.txt", "global.json", "README.md"]))
    marks = paths.select(folder.alias("dir")).distinct().select("dir", F.explode(invented).alias("name")).select(F.concat("dir", F.lit("/"), "name").alias("path"))
    return files.project_roots(paths.unionByName(marks))


def change_summary(spark: SparkSession, d: str) -> DataFrame:
    """Changes of each path, from the events as a change log."""
    e = table(spark, d, "events").select(F.col("event_type").alias("change_type"), F.concat(F.lit("src/f"), F.col("user_id").cast("string"), F.lit(".py")).alias("path"), F.struct("ts", "event_id").alias("ts"))
    return watch.collapse(e)


def progress_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rate of each user's last twenty events, as if they were completions."""
    e = table(spark, d, "events").select("user_id", "ts", F.col("event_id").alias("seq"))
    return watch.progress(e, ["user_id"]).select("user_id", "seq", "n_done", F.round("rate", 9).alias("rate"))


def snapshot_changes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_totalprice").alias("stamp"), "o_orderkey")
    before = o.where("o_orderkey % 11 <> 0")
    now = o.where("o_orderkey % 13 <> 0").withColumn("stamp", F.when(F.col("o_orderkey") % 7 == 0, F.col("stamp") + 1).otherwise(F.col("stamp")))
    return watch.snapshot_diff(before, now)


def streamed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Event counts per hour and type, through a stream that works off the events file."""
    schema = table(spark, d, "events").schema
    base = f"{shared_dir(spark)}/heddle-stream-{uuid.uuid4().hex}"
    out = f"{base}/out"
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    counts = watch.windowed_counts(events, "1 hour", "1 hour")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    done = spark.read.parquet(out)
    last = done.agg(F.max("batch")).first()[0]
    return done.where(F.col("batch") == last).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (markdown_sections, python_definitions, definitions, recorded_definitions, project_markers, change_summary, progress_rates, snapshot_changes, streamed_windows)}

_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"

ORACLE = {
    "markdown_sections": f"""with recursive g as (select row_number() over (order by file_path, content) as id, file_path, string_split(content, chr(10)) as ls from (select distinct file_path, content from code_nodes where category = 'file' and language = 'markdown' and content is not null)),
l as (select id, unnest(range(1, len(ls) + 1)) as i, unnest(ls) as line from g),
m as (select *, regexp_extract({_STRIP.format(x="line")}, '^(`{{3,}}|~{{3,}})') as mark from l),
st as (select id, 0::bigint as i, ''::varchar as fence, false as inside from g
  union all select s.id, m.i, case when mark = '' then s.fence when s.fence = '' then mark when mark[1] = s.fence[1] and length(mark) >= length(s.fence) then '' else s.fence end, mark <> '' or s.fence <> '' from st s join m on m.id = s.id and m.i = s.i + 1),
free as (select m.id, m.i, m.line from m join st on st.id = m.id and st.i = m.i where not st.inside),
h as (select id, i as a, {_STRIP.format(x="regexp_extract(line, '^## +(.+)$', 1)")} as heading from free where regexp_matches(line, '^## +(.+)$')),
ti as (select id, arg_min({_STRIP.format(x="regexp_extract(line, '^# +(.+)$', 1)")}, i) as title from free where regexp_matches(line, '^# +(.+)$') group by 1),
sp as (select id, a, coalesce(lead(a) over (partition by id order by a) - 1, (select len(ls) from g where g.id = h.id)) as b, heading, heading as name from h
  union all select id, 1, min(a) - 1, null, coalesce(any_value(title), 'Preamble') from h left join ti using (id) group by id having min(a) > 1),
x as (select g.file_path, sp.*, g.ls, row_number() over (partition by sp.id, name order by a) > 1 as again, regexp_replace(array_to_string(g.ls[a:b], chr(10)), '\\n\\n+$', chr(10)) as content, strlen(array_to_string(g.ls[1:a - 1], chr(10))) + case when a > 1 then 1 else 0 end as sb from sp join g on g.id = sp.id)
select 'section:' || file_path || ':' || name || case when again then '@' || a else '' end as node_id, name, a::int as start_line, b::int as end_line, sb::int as start_byte, (sb + strlen(content))::int as end_byte,
  case when heading is not null then '## ' || name else coalesce(nullif({_STRIP.format(x="ls[1]")}, ''), 'Preamble') end as signature, sha256(content) as content_hash from x""",
    "project_markers": """with f as (select distinct file_path as path from code_nodes), dirs as (select distinct regexp_replace(path, '/?[^/]*$', '') as dir from f),
p as (select path from f union select dir || '/' || m from dirs, (select unnest(['pyproject.toml', 'setup.cfg', 'Pipfile', 'tsconfig.json', 'package.json', 'go.mod', 'Cargo.toml', 'pom.xml', 'build.gradle.kts', 'App.csproj', 'All.sln', 'Gemfile', 'requirements.txt', 'global.json', 'README.md']) as m)),
m as (select regexp_replace(path, '/?[^/]*$', '') as dir, split_part(path, '/', -1) as f from p)
select dir as path, case when f in ('pyproject.toml', 'setup.py', 'setup.cfg', 'Pipfile') then 'python' when f = 'tsconfig.json' then 'typescript' when f = 'package.json' then 'javascript' when f = 'go.mod' then 'go'
  when f = 'Cargo.toml' then 'rust' when f in ('pom.xml', 'build.gradle', 'build.gradle.kts') then 'java' when f like '%.csproj' or f like '%.sln' then 'dotnet' when f = 'Gemfile' then 'ruby' end as language, min(f) as marker_file
from m where not regexp_matches('/' || dir || '/', '/([.]venv|venv|[.]env|env|node_modules|[.]git|[.]hg|[.]svn|__pycache__|[.]mypy_cache|[.]pytest_cache|[.]ruff_cache|[.]tox|[.]nox|site-packages|dist|build|[.]eggs|obj|bin)/')
group by 1, 2 having language is not null""",
    "recorded_definitions": """select distinct node_id, ts_kind, file_path from code_nodes where category in ('callable', 'type') and language in ('python', 'javascript', 'typescript', 'go', 'rust')
  and file_path in (select file_path from code_nodes where category = 'file' and not truncated and content is not null)""",
    "progress_rates": """select user_id, event_id as seq, n_done::int as n_done, round(case when span > 0 then (least(n_done, 20) - 1) * 1000000 / span end, 9) as rate
from (select *, row_number() over w as n_done, epoch_us(ts) - epoch_us(min(ts) over (partition by user_id order by ts, event_id rows between 19 preceding and current row)) as span from events window w as (partition by user_id order by ts, event_id))""",
    "change_summary": "select 'src/f' || user_id || '.py' as path, arg_max(event_type, {'a': ts, 'b': event_id}) as change_type, count(*) as n from events group by 1",
    "snapshot_changes": """with b as (select o_orderkey::varchar as path, o_totalprice as s from orders where o_orderkey % 11 <> 0), n as (select o_orderkey::varchar as path, case when o_orderkey % 7 = 0 then o_totalprice + 1 else o_totalprice end as s from orders where o_orderkey % 13 <> 0)
select * from (select case when b.s is null then 'added' when n.s is null then 'deleted' when b.s <> n.s then 'modified' end as change_type, path from b full join n using (path)) where change_type is not null""",
    "streamed_windows": "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
}
