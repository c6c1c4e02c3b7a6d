"""Summaries and vectors through pluggable providers, and the pipeline that runs the stages.

A provider is a plain function on lists; the default ones are deterministic and offline.
Failures become a column, never a lost row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from heddle.functions import scalars as S
from heddle.operators import chunking, graph, incremental as inc, refs
from heddle.session import keep
from heddle.sources import files

# Prompt template and token limit by category.
TEMPLATES = {"file": ("file", 200), "type": ("type", 200), "callable": ("callable", 150), "section": ("section", 150), "block": ("block", 150)}
BASE_TEMPLATE = ("base", 100)
#: Prompt text is cut beyond so many tokens.
PROMPT_TOKENS = 4000


def stub_summaries(prompts: list[str]) -> list[str]:
    """First words of the text; stands in for a model."""
    return [" ".join(p.split()[:12]) for p in prompts]


def stub_vectors(texts: list[str], dim: int = 64) -> list[list[float]]:
    out = []
    for t in texts:
        digest = hashlib.sha256(t.encode()).digest()
        out.append([(digest[i % 32] ^ (i & 255)) / 127.5 - 1 for i in range(dim)])
    return out


def templates(nodes: DataFrame) -> DataFrame:
    """(node_id, template, max_tokens) by category."""
    names = F.create_map(*[F.lit(x) for k, v in TEMPLATES.items() for x in (k, v[0])])
    limits = F.create_map(*[F.lit(x) for k, v in TEMPLATES.items() for x in (k, v[1])])
    return nodes.select("node_id", F.coalesce(F.try_element_at(names, F.col("category")), F.lit(BASE_TEMPLATE[0])).alias("template"), F.coalesce(F.try_element_at(limits, F.col("category")), F.lit(BASE_TEMPLATE[1])).alias("max_tokens"))


def summarise(nodes: DataFrame, provider: Callable[[list[str]], list[str]] = stub_summaries, batch: int = 64) -> DataFrame:
    """(node_id, smart_content, smart_content_hash, status): skipped, placeholder, enriched or error.

    Fresh summaries are skipped, texts under fifty characters get a placeholder, blank
    answers and failures of a batch become error rows.
    """
    n = nodes.select("node_id", "category", "name", "content", "content_hash", "smart_content", "smart_content_hash")
    fresh, trivial = inc.summary_is_fresh(), S.is_trivial(F.col("content"))
    skipped = n.where(fresh).select("node_id", "smart_content", "smart_content_hash", F.lit("skipped").alias("status"))
    empty = n.where(~fresh & trivial).select("node_id", S.placeholder_summary(F.col("category"), F.col("name")).alias("smart_content"), F.col("content_hash").alias("smart_content_hash"), F.lit("placeholder").alias("status"))
    tokens = S.token_estimate(F.col("content"))
    work = n.where(~fresh & ~trivial).select("node_id", "content_hash", S.truncate_for_prompt(F.col("content"), tokens, F.lit(PROMPT_TOKENS)).alias("prompt"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), batch):
                part = b.iloc[k : k + batch]
                try:
                    texts = provider(part["prompt"].tolist())
                    status = ["enriched" if t and t.strip() else "error: blank" for t in texts]
                except Exception as e:  # noqa: BLE001
                    texts, status = [None] * len(part), [f"error: {e}"] * len(part)
                ok = [s == "enriched" for s in status]
                yield pd.DataFrame({"node_id": part["node_id"], "smart_content": [t if o else None for t, o in zip(texts, ok)], "smart_content_hash": [h if o else None for h, o in zip(part["content_hash"], ok)], "status": status})

    done = work.mapInPandas(run, "node_id string, smart_content string, smart_content_hash string, status string")
    return skipped.unionByName(empty).unionByName(done)


def embed(nodes: DataFrame, provider: Callable[[list[str]], list[list[float]]] = stub_vectors, batch: int = 16, most: int = 4000, overlap: int = 50) -> DataFrame:
    """(node_id, embedding, smart_content_embedding, embedding_hash, n_failed) of the nodes that are not fresh.

    Content, after its leading context, is chunked by tokens; summaries are one chunk. A
    failed batch counts one error per chunk and leaves its chunks out.
    """
    todo = nodes.where(~inc.embedding_is_fresh()).withColumn("hash_", inc.expected_embedding_hash())
    text = F.when(F.length("leading_context") > 0, F.concat("leading_context", F.lit("\n"), "content")).otherwise(F.col("content"))
    raw = chunking.by_tokens(todo.select("node_id", text.alias("content"), "start_line"), most, overlap).select("node_id", "chunk_index", "text", F.lit(False).alias("is_smart_content"))
    placeholder = F.coalesce(F.col("smart_content").startswith("[Empty content"), F.lit(False))
    smart = todo.where((F.length("smart_content") > 0) & ~placeholder).select("node_id", F.lit(0).alias("chunk_index"), F.col("smart_content").alias("text"), F.lit(True).alias("is_smart_content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), batch):
                part = b.iloc[k : k + batch]
                try:
                    vectors, failed = provider(part["text"].tolist()), False
                except Exception:  # noqa: BLE001
                    vectors, failed = [None] * len(part), True
                yield part[["node_id", "chunk_index", "is_smart_content"]].assign(vector=vectors, failed=failed)

    v = keep(raw.unionByName(smart).mapInPandas(run, "node_id string, chunk_index int, is_smart_content boolean, vector array<double>, failed boolean"), "vectors")
    whole = chunking.reassemble(v.where("not failed"))
    failed = v.groupBy("node_id").agg(F.count_if("failed").alias("n_failed"))
    return todo.select("node_id", F.col("hash_").alias("embedding_hash")).join(failed, "node_id").join(whole, "node_id", "left").select("node_id", "embedding", "smart_content_embedding", "embedding_hash", "n_failed")


@dataclass
class ScanSummary:
    """What a run of the pipeline did."""

    counts: dict[str, int] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def success(self) -> bool:
        return not self.errors


def discover(spark: SparkSession, roots: list[str], s: ScanSummary, **rules) -> DataFrame:
    """(path, size_bytes) of the files below the roots; their number and the missing roots go to the summary."""
    found, missing = files.scan(spark, roots, **rules)
    s.counts["files"] = found.count()
    s.errors += [f"missing: {m}" for m in missing]
    return found


Stage = Callable[[DataFrame, ScanSummary], DataFrame]


def run_pipeline(fresh: DataFrame, prior: DataFrame | None, occurrences: DataFrame | None, prior_edges: DataFrame | None = None, stages: list[Stage] = (), embedder=stub_vectors, summariser=stub_summaries, enabled_categories: list[str] | None = None, prior_meta: dict | None = None, meta: dict | None = None, force: bool = False, courtesy: Callable[[DataFrame, DataFrame], None] | None = None) -> tuple[DataFrame, DataFrame, ScanSummary]:
    """(nodes, edges, summary): carry forward, summarise, embed, resolve references, store.

    fresh: freshly parsed nodes; prior: nodes of the last run or None. Extra stages run on
    the nodes before storage. Each slow stage is written to the shared folder before the next.
    """
    s = ScanSummary()
    nodes = graph.upsert_nodes(fresh).drop("first_seq")
    if prior is not None:
        nodes = inc.carry_embeddings(inc.carry_summaries(nodes, prior).drop("carried"), prior).drop("carried")

    def save_early(nodes: DataFrame) -> None:
        """The graph as it is after a slow stage; parents that are missing as yet do not matter, a failure only warns."""
        if courtesy is not None:
            try:
                stored, edges, _ = graph.storage_stage(nodes, nodes.sparkSession.createDataFrame([], "src string, dst string, edge_type string, edge_seq long"))
                courtesy(stored, edges)
            except Exception as e:  # noqa: BLE001
                s.warnings.append(f"early save: {e}")

    if meta is not None:
        nodes, difference = inc.guard(nodes, prior_meta, meta, force)
        if difference:
            s.warnings.append(difference)
    nodes = keep(nodes, "merged")
    done = keep(summarise(nodes.where(inc.wants_summary(enabled_categories)), summariser), "summaries")
    for r in done.groupBy(F.split_part("status", F.lit(":"), F.lit(1)).alias("k")).count().collect():  # a handful of kinds
        s.counts[f"summaries_{r['k']}"] = r["count"]
    if s.counts.get("summaries_error"):
        s.errors.append(f"{s.counts['summaries_error']} summaries failed")
    nodes = keep(inc.overlay(nodes, done.where("status in ('enriched', 'placeholder')"), ["smart_content", "smart_content_hash"]), "summarised")
    save_early(nodes)
    vectors = keep(embed(nodes, embedder), "embedded")
    if (failed := vectors.agg(F.sum("n_failed")).first()[0] or 0) > 0:
        s.errors.append(f"{failed} chunks failed")
    nodes = inc.overlay(nodes, vectors, ["embedding", "smart_content_embedding", "embedding_hash"])
    save_early(nodes)
    for stage in stages:
        nodes = stage(nodes, s)
    nodes = keep(nodes, "nodes")
    reference = refs.cross_file(occurrences, nodes, prior_edges, inc.changed_files(nodes, prior) if prior is not None else None) if occurrences is not None else None
    empty = nodes.sparkSession.createDataFrame([], "src string, dst string, edge_type string, edge_seq long")
    typed = empty if reference is None else reference.select("src", "dst", F.lit("references").alias("edge_type"), F.xxhash64("src", "dst").alias("edge_seq"))
    stored, edges, orphans = graph.storage_stage(nodes, typed)
    s.counts["nodes"] = stored.count()
    s.counts["orphans"] = orphans.count()
    return stored, edges, s
