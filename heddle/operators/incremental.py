"""Incremental maintenance from content hashes: what changed, what can be carried forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from heddle.functions import scalars as S


def changed_files(current: DataFrame, prior: DataFrame) -> DataFrame:
    """(file_path): file nodes whose hash differs from the prior one or that are new."""
    cur = current.where("category = 'file'").select("node_id", "file_path", "content_hash").distinct()
    old = prior.where("category = 'file'").groupBy(F.col("node_id").alias("oid")).agg(F.max("content_hash").alias("old_hash"))
    j = cur.join(old, cur.node_id == old.oid, "left")
    return j.where(F.col("old_hash").isNull() | (F.col("old_hash") != F.col("content_hash"))).select("file_path").distinct()


def nodes_of_changed(current: DataFrame, changed: DataFrame) -> DataFrame:
    return current.join(changed, "file_path", "left_semi")


def expected_embedding_hash() -> Column:
    """Hash of what is embedded: the content, after its leading context where there is one."""
    return F.when(F.length("leading_context") > 0, F.sha2(F.concat("leading_context", F.lit("\n"), "content"), 256)).otherwise(F.col("content_hash"))


def _has(c: str) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def embedding_is_fresh() -> Column:
    """Whether a node needs no vectors: raw vector there where the content is not blank, hash as
    expected, and its summary, unless a placeholder, embedded too."""
    blank = F.length(F.regexp_replace(F.coalesce("content", F.lit("")), r"^\s+|\s+$", "")) == 0
    same = F.coalesce(F.col("embedding_hash") == expected_embedding_hash(), F.lit(False))
    placeholder = F.coalesce(F.col("smart_content").startswith("[Empty content"), F.lit(False))
    return (blank | _has("embedding")) & same & (placeholder | F.col("smart_content").isNull() | _has("smart_content_embedding"))


def summary_is_fresh() -> Column:
    return F.coalesce((F.col("smart_content_hash") == F.col("content_hash")) & F.col("smart_content").isNotNull(), F.lit(False))


def self_documenting() -> Column:
    """Sections of prose need no summary."""
    return (F.col("content_type") == "content") & (F.col("category") == "section") & F.col("language").isin("markdown", "rst")


def wants_summary(enabled_categories: list[str] | None = None) -> Column:
    """Nodes that are summarised: no sections of prose, and only the enabled categories if any are named."""
    wanted = ~F.coalesce(self_documenting(), F.lit(False))
    return wanted & F.col("category").isin(enabled_categories) if enabled_categories else wanted


class DimensionError(ValueError):
    """Stored vectors have another length than new ones would."""


def guard(nodes: DataFrame, prior: dict | None, current: dict, force: bool = False) -> tuple[DataFrame, str | None]:
    """(nodes, warning): another number of dimensions than before is an error, or, if forced, empties all
    stored vectors; other differences only warn."""
    difference = metadata_mismatch(prior or {}, current)
    if prior and prior.get("embedding_dimensions", current.get("embedding_dimensions")) != current.get("embedding_dimensions"):
        if not force:
            raise DimensionError(difference)
        vectors = {c: F.lit(None).cast(nodes.schema[c].dataType) for c in ("embedding", "smart_content_embedding", "embedding_hash") if c in nodes.columns}
        return nodes.withColumns(vectors), difference
    return nodes, difference


def carry_summaries(current: DataFrame, prior: DataFrame) -> DataFrame:
    """Copy summary, its hash, vectors and leading context from the prior node of the same hash;
    without a prior summary only vectors and leading context."""
    p = prior.select(F.col("node_id").alias("pid"), F.col("content_hash").alias("p_hash"), *(F.col(c).alias(f"p_{c}") for c in ("smart_content", "smart_content_hash", "embedding", "smart_content_embedding", "embedding_hash", "leading_context")))
    j = current.join(p, current.node_id == p.pid, "left")
    same = F.coalesce(F.col("p_hash") == F.col("content_hash"), F.lit(False))
    full = same & F.col("p_smart_content").isNotNull()
    some = full | (same & (_has("p_embedding") | _has("p_smart_content_embedding")))
    out = j.withColumn("carried", F.when(full, "summary").when(some, "vectors").otherwise("nothing"))
    for c in ("smart_content", "smart_content_hash"):
        out = out.withColumn(c, F.when(full, F.col(f"p_{c}")).otherwise(F.col(c)))
    for c in ("embedding", "smart_content_embedding", "embedding_hash", "leading_context"):
        out = out.withColumn(c, F.when(some, F.col(f"p_{c}")).otherwise(F.col(c)))
    return out.select(*current.columns, "carried")


def carry_embeddings(current: DataFrame, prior: DataFrame) -> DataFrame:
    """Copy the vector fields of a prior node whose embedding hash is what this node expects."""
    p = prior.select(F.col("node_id").alias("pid"), *(F.col(c).alias(f"p_{c}") for c in ("embedding", "smart_content_embedding", "embedding_hash", "embedding_chunk_offsets")))
    j = current.join(p, current.node_id == p.pid, "left").withColumn("expected", expected_embedding_hash())
    ok = F.coalesce(F.col("p_embedding_hash") == F.col("expected"), F.lit(False)) & (_has("p_embedding") | _has("p_smart_content_embedding"))
    out = j.withColumn("carried", ok)
    for c in ("embedding", "smart_content_embedding", "embedding_hash", "embedding_chunk_offsets"):
        out = out.withColumn(c, F.when(ok, F.col(f"p_{c}")).otherwise(F.col(c)))
    return out.select(*current.columns, "carried")


def overlay(base: DataFrame, results: DataFrame, columns: list[str]) -> DataFrame:
    """Replace ``columns`` of base by those of the results' row of the same node, where there is one."""
    r = results.select(F.col("node_id").alias("rid"), F.lit(True).alias("hit_"), *(F.col(c).alias(f"r_{c}") for c in columns))
    j = base.join(r, base.node_id == r.rid, "left")
    return j.select(*(F.when(F.col("hit_"), F.col(f"r_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns))


def metadata_mismatch(prior: dict, current: dict) -> str | None:
    """What differs between stored and current embedding settings: model, dimensions or chunk parameters."""
    for key in ("embedding_model", "embedding_dimensions", "chunk_params"):
        if key in prior and prior[key] != current.get(key):
            return f"{key}: {prior[key]!r} -> {current.get(key)!r}"
    return None


def fixture_index(nodes: DataFrame) -> DataFrame:
    """(content_hash, embedding, smart_content): by hash of the content, the last writer wins."""
    h = nodes.withColumn("h", S.content_hash(F.col("content")))
    return h.groupBy(F.col("h").alias("content_hash")).agg(F.max_by("embedding", F.when(_has("embedding"), F.col("node_seq"))).alias("embedding"), F.max_by("smart_content", F.when(F.col("smart_content").isNotNull(), F.col("node_seq"))).alias("smart_content"))
