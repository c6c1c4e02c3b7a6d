"""Text, regular-expression and vector search with hierarchy-aware ranking."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from heddle.functions import scalars as S
from heddle.operators import graph
from heddle.session import keep, only_row

META = set("*?[]^$|+{}()")
FIELDS = ["node_id", "content", "smart_content", "leading_context"]


class SearchError(ValueError):
    """A query that cannot be planned."""


@dataclass(frozen=True)
class QuerySpec:
    """What to search for; checked before anything is planned."""

    pattern: str
    mode: str = "auto"
    limit: int = 20
    offset: int = 0
    min_similarity: float = 0.25
    include: tuple[str, ...] = field(default=())
    exclude: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if not self.pattern or not self.pattern.strip():
            raise SearchError("blank pattern")
        if self.mode not in ("auto", "text", "regex", "semantic"):
            raise SearchError(f"unknown mode {self.mode!r}")
        if self.limit < 1 or self.offset < 0 or not 0 <= self.min_similarity <= 1:
            raise SearchError("limit, offset or min_similarity out of range")
        for p in (*self.include, *self.exclude):
            try:
                re.compile(p)
            except re.error as e:
                raise SearchError(f"invalid filter {p!r}: {e}") from e


def detect_mode(pattern: str) -> str:
    """Any metacharacter asks for a regular expression, anything else for meaning."""
    return "regex" if META & set(pattern) else "semantic"


def coverage(nodes: DataFrame) -> DataFrame:
    """One row: nodes, nodes with a vector, share without."""
    has = (F.size(F.coalesce("embedding", F.array())) > 0) | (F.size(F.coalesce("smart_content_embedding", F.array())) > 0)
    g = nodes.agg(F.count("*").alias("n_nodes"), F.count_if(has).alias("n_with_vectors"))
    return g.withColumn("missing_share", F.round(1 - F.col("n_with_vectors") / F.col("n_nodes"), 6))


def resolve_mode(spec: QuerySpec, nodes: DataFrame, have_embedder: bool = True) -> str:
    """The mode that runs: semantic falls back to text without an embedder or vectors."""
    mode = detect_mode(spec.pattern) if spec.mode == "auto" else spec.mode
    if mode == "semantic":
        usable = have_embedder and not nodes.where((F.size("embedding") > 0) | (F.size("smart_content_embedding") > 0)).limit(1).isEmpty()
        if not usable:
            if spec.mode == "semantic":
                raise SearchError("semantic search needs an embedder and vectors")
            return "text"
    return mode


def _path_filters(spec: QuerySpec, rows: DataFrame) -> DataFrame:
    """include keeps ids that match any of its patterns, exclude drops those that match any of its own."""
    if spec.include:
        rows = rows.where(S._any([F.col("node_id").rlike(p) for p in spec.include]))
    if spec.exclude:
        rows = rows.where(~S._any([F.col("node_id").rlike(p) for p in spec.exclude]))
    return rows


def rank_regex(nodes: DataFrame, pattern: str) -> DataFrame:
    """The rows of nodes that match, with match_field and score: their best field.

    Scores: node_id 1.0 if the match is the whole id, else 0.8;
    leading_context 0.6; content and smart_content 0.5, in this order at equal score."""
    hit = {c: F.col(c).isNotNull() & (F.length(c) > 0) & F.col(c).rlike(pattern) for c in FIELDS}
    text = F.regexp_substr("node_id", F.lit(pattern))
    score = (
        F.when(hit["node_id"], F.when(text == F.col("node_id"), 1.0).otherwise(0.8))
        .when(hit["leading_context"], 0.6)
        .when(hit["content"] | hit["smart_content"], 0.5)
    )
    where = (
        F.when(hit["node_id"], F.lit("node_id"))
        .when(hit["leading_context"], "leading_context")
        .when(hit["content"], "content")
        .when(hit["smart_content"], "smart_content")
    )
    return nodes.withColumn("match_field", where).where("match_field is not null").withColumn("score", score)


#: What a hit is shown with besides its rank.
SHOWN = ["match_start_line", "match_end_line", "snippet", "chunk_index", "chunk_offset"]


def locate(rows: DataFrame, pattern: str) -> DataFrame:
    """Adds lines and snippet of the match to rows of rank_regex."""
    # offset of the match in the winning field; a hit in the leading context is read
    # against the content for lines and against the summary for the snippet
    searched = F.when(F.col("match_field") == "leading_context", F.col("leading_context")).when(F.col("match_field") == "content", F.col("content")).otherwise(F.col("smart_content"))
    start = F.regexp_instr(searched, F.lit(pattern)) - 1
    length = F.length(F.regexp_substr(searched, F.lit(pattern)))
    newlines = lambda t, n: F.length(F.substring(t, F.lit(1), n)) - F.length(F.replace(F.substring(t, F.lit(1), n), F.lit("\n")))
    content = F.coalesce("content", F.lit(""))
    first = F.when(F.col("match_field").isin("smart_content", "node_id"), F.col("start_line")).otherwise(F.col("start_line") + newlines(content, start))
    last = F.when(F.col("match_field") == "smart_content", F.col("end_line")).when(F.col("match_field") == "node_id", F.col("start_line")).otherwise(F.col("start_line") + newlines(content, start + length))
    shown = F.when(F.col("match_field") == "content", content).otherwise(F.coalesce("smart_content", F.lit("")))
    snippet = F.when(F.col("match_field") == "node_id", F.col("node_id")).otherwise(F.coalesce(F.try_element_at(F.split(shown, "\n"), newlines(shown, start).cast("int") + 1), F.substring(shown, 1, 50)))
    return rows.withColumns({
        "match_start_line": first.cast("int"), "match_end_line": last.cast("int"), "snippet": snippet,
        "chunk_index": F.lit(None).cast("int"), "chunk_offset": F.lit(None).cast("struct<start_line:int,end_line:int>"),
    })


RANKED = ["node_id", "node_seq", "start_line", "end_line", "match_field", "score"]


def match_semantic(nodes: DataFrame, query: list[float], at_least: float) -> DataFrame:
    """Best chunk of each node over both vector fields; ties go to the lowest chunk, raw before summary."""
    q = F.array(*[F.lit(float(x)) for x in query])

    def scored(c: str, raw: int) -> Column:
        return F.transform(F.coalesce(F.col(c), F.array().cast("array<array<double>>")), lambda v, i: F.struct(F.when(F.size(v) == len(query), S.cosine(v, q)).otherwise(F.lit(None).cast("double")).alias("s"), F.lit(raw).alias("raw"), (-i).alias("neg")))

    best = F.array_max(F.filter(F.concat(scored("embedding", 1), scored("smart_content_embedding", 0)), lambda x: x["s"].isNotNull()))
    rows = nodes.withColumn("best_", best).where(F.col("best_.s") >= at_least)
    raw = F.col("best_.raw") == 1
    idx = -F.col("best_.neg")
    summary = F.when(F.length("smart_content") > 0, F.substring("smart_content", 1, 100))
    first = F.when(F.length("content") > 0, F.split_part("content", F.lit("\n"), F.lit(1)))
    return rows.select(
        "node_id", "node_seq", "start_line", "end_line", F.col("start_line").alias("match_start_line"), F.col("end_line").alias("match_end_line"),
        F.when(raw, "embedding").otherwise("smart_content_embedding").alias("match_field"), F.col("best_.s").alias("score"), F.coalesce(summary, first, F.col("node_id")).alias("snippet"),
        idx.cast("int").alias("chunk_index"), F.when(raw, F.try_element_at("embedding_chunk_offsets", idx.cast("int") + 1)).alias("chunk_offset"),
    )


def parent_penalty(hits: DataFrame, edges: DataFrame, penalty: float = 0.25) -> DataFrame:
    """Scores below 1 of hits with hits beneath them shrink by (1 - penalty) to the largest distance."""
    if penalty == 0.0:
        return hits
    chains = graph.ancestors(hits.select("node_id").distinct(), graph.parents(edges))
    in_hits = chains.join(hits.select(F.col("node_id").alias("ancestor_id")).distinct(), "ancestor_id", "left_semi")
    deep = in_hits.groupBy(F.col("ancestor_id").alias("pid")).agg(F.max("depth").alias("deep"))
    out = hits.join(deep, hits.node_id == deep.pid, "left").drop("pid")
    less = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") * F.pow(F.lit(1.0 - penalty), F.col("deep"))))
    return out.withColumn("score", F.when(F.col("deep").isNotNull() & (F.col("score") < 1.0), less).otherwise(F.col("score"))).drop("deep")


def _pattern(spec: QuerySpec, mode: str) -> str:
    return S.literal_regex(spec.pattern) if mode == "text" else spec.pattern


def hits_of(nodes: DataFrame, edges: DataFrame, spec: QuerySpec, mode: str, query_vector: list[float] | None = None, penalty: float = 0.25, located: bool = True) -> DataFrame:
    """All ranked hits before paging: filters, last versions only, penalty.

    Without ``located`` text and regular-expression hits carry their rank only.
    """
    if mode == "semantic":
        found = match_semantic(nodes, query_vector or [], spec.min_similarity)
    else:
        tried = within_time(nodes, spec.pattern) if mode == "regex" and may_explode(spec.pattern) else nodes
        found = rank_regex(tried, _pattern(spec, mode))
        found = locate(found, _pattern(spec, mode)).select(*RANKED, *SHOWN) if located else found.select(*RANKED)
    found = graph.current_only(_path_filters(spec, found), nodes)
    return parent_penalty(keep(found, "hits"), edges, penalty)


def page(hits: DataFrame, spec: QuerySpec) -> DataFrame:
    """Highest scores first, insertion order at equal score; one page."""
    ranked = hits.orderBy(F.col("score").desc(), "first_seq")
    return (ranked.offset(spec.offset) if spec.offset else ranked).limit(spec.limit)


def page_of(nodes: DataFrame, edges: DataFrame, spec: QuerySpec, mode: str, query_vector: list[float] | None = None, penalty: float = 0.25) -> DataFrame:
    """One page of hits in rank order; lines and snippets are looked up for the page alone."""
    if mode == "semantic":
        return page(hits_of(nodes, edges, spec, mode, query_vector, penalty), spec)
    shown = page(hits_of(nodes, edges, spec, mode, None, penalty, located=False), spec)
    texts = nodes.select(F.col("node_id").alias("nid"), F.col("node_seq").alias("seq"), *(c for c in FIELDS if c != "node_id"))
    rows = shown.join(texts, (shown.node_id == texts.nid) & (shown.node_seq == texts.seq))
    return locate(rows, _pattern(spec, mode)).select(*RANKED, *SHOWN, "first_seq").orderBy(F.col("score").desc(), "first_seq")


def search(nodes: DataFrame, edges: DataFrame, spec: QuerySpec, query_vector: list[float] | None = None, penalty: float = 0.25) -> DataFrame:
    """One page of hits in rank order."""
    return page_of(nodes, edges, spec, resolve_mode(spec, nodes, query_vector is not None), query_vector, penalty)


#: Columns of a hit; ``max`` adds the others, null where they do not apply.
MIN_COLUMNS = ["node_id", "start_line", "end_line", "match_start_line", "match_end_line", "smart_content", "snippet", "score", "match_field"]
MAX_COLUMNS = [*MIN_COLUMNS, "content", "matched_lines", "chunk_index", "chunk_offset"]


def project_hits(shown: DataFrame, nodes: DataFrame, detail: str = "min") -> DataFrame:
    """A page of hits with 9 columns (``min``) or 13 (``max``); matched_lines only for text and regular expressions."""
    texts = nodes.select(F.col("node_id").alias("nid"), F.col("node_seq").alias("seq"), "smart_content", "content")
    rows = shown.join(texts, (shown.node_id == texts.nid) & (shown.node_seq == texts.seq)).drop("nid", "seq")
    lines = F.sequence(F.col("match_start_line"), F.col("match_end_line"))
    rows = rows.withColumn("matched_lines", F.when(F.col("chunk_index").isNull() & (F.col("match_end_line") >= F.col("match_start_line")), lines))
    return rows.select("first_seq", *(MAX_COLUMNS if detail == "max" else MIN_COLUMNS))


_NESTED = re.compile(r"\((?:[^()\\]|\\.)*[+*}](?:[^()\\]|\\.)*\)[+*{]|\((?:[^()\\]|\\.)*\|(?:[^()\\]|\\.)*\)[+*{]")


def may_explode(pattern: str) -> bool:
    """Whether a repeated group holds a repetition or a choice, which can take exponential time."""
    return bool(_NESTED.search(pattern))


def within_time(nodes: DataFrame, pattern: str, seconds: float = 2.0) -> DataFrame:
    """The nodes with the fields that a pattern can be tried on: a field whose search takes longer
    than ``seconds`` is emptied, as if it did not match."""
    import regex

    known = regex.compile(pattern)

    @F.pandas_udf("boolean")
    def in_time(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> bool:
            try:
                return bool(text) and known.search(text, timeout=seconds) is not None
            except TimeoutError:
                return False

        return texts.map(one)

    return nodes.withColumns({c: F.when(in_time(F.col(c)), F.col(c)) for c in FIELDS if c != "node_id"})


def folder_distribution(ids: DataFrame, drill: float = 0.9) -> DataFrame:
    """(folder, n): by first path part; a part that holds ``drill`` or more of all is split by the second."""
    path = S.file_path(F.col("node_id"))
    rows = ids.select(S.folder(path).alias("f1"), S.second_folder(path).alias("f2"))
    small = rows.groupBy("f1", "f2").agg(F.count("*").alias("n"))
    top = only_row(small.groupBy("f1").agg(F.sum("n").alias("n1")).agg(F.sum("n1").alias("total"), F.max_by("f1", "n1").alias("f1"), F.max("n1").alias("n1")))
    big = top["f1"] if top["total"] and top["n1"] / top["total"] >= drill else None
    name = F.when(F.col("f1") == F.lit(big), F.col("f2")).otherwise(F.col("f1"))
    return small.groupBy(name.alias("folder")).agg(F.sum("n").cast("long").alias("n"))


def tool_envelope(hits: DataFrame, shown: DataFrame, spec: QuerySpec) -> DataFrame:
    """The envelope of tools: that of :func:`envelope` with the filters and, if there are any, how many
    hits they left."""
    filtered = F.lit(hits.count()).cast("long") if spec.include or spec.exclude else F.lit(None).cast("long")
    text = lambda xs: F.array(*map(F.lit, xs)) if xs else F.lit(None).cast("array<string>")
    return envelope(hits, shown, spec).withColumns({"include": text(spec.include), "exclude": text(spec.exclude), "filtered": filtered})


def envelope(hits: DataFrame, shown: DataFrame, spec: QuerySpec) -> DataFrame:
    """One row: total, showing, offset, limit, folders as a map."""
    folders = folder_distribution(hits).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("folder", "n")))).alias("folders"))
    return folders.select(F.lit(hits.count()).cast("long").alias("total"), F.lit(shown.count()).cast("long").alias("showing"), "folders", F.lit(spec.offset).alias("offset"), F.lit(spec.limit).alias("limit"))
