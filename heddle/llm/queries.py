"""Queries of the llm problems with the SQL they are compared with, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from heddle.llm import bpe, docpairs, forest, mojibake, origin, packing, parsing, secrets, splitting
from heddle.session import keep, table


def _texts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes = table(spark, d, "code_nodes").where("node_id is not null").select(F.col("node_id").alias("record_id"), F.col("file_path").alias("path"), "content")
    configs = table(spark, d, "config_samples").select(F.col("config_id").cast("string").alias("record_id"), F.col("file_path").alias("path"), F.col("sample.auth.jwt.secret").alias("value"))
    return nodes, configs


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find(*_texts(spark, d)).select("source_table", "record_id", "line_no").distinct()


def p1_masked(spark: SparkSession, d: str) -> DataFrame:
    """Each record that holds a credential, with it masked."""
    return secrets.find(*_texts(spark, d), masked=True).select("source_table", "record_id", "masked").distinct()


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """(repo, source_file, language, content) of each record."""
    return table(spark, d, "symbols").select("repo", F.col("source.file").alias("source_file"), F.col("source.language").alias("language"), F.col("root.content").alias("content"), "record_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return parsing.broken_files(_sources(spark, d)).where("broken").select("source_file").distinct()


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of broken files per repository and language, with totals."""
    return parsing.rates(parsing.broken_files(_sources(spark, d)))


def _documented(spark: SparkSession, d: str) -> DataFrame:
    last = _sources(spark, d).where("source_file is not null").groupBy("source_file").agg(F.max_by(F.struct("repo", "language", "content"), "record_id").alias("r"))
    return docpairs.documented(last.select("r.repo", "source_file", "r.language", "r.content"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Functions whose own text documents them, or refers to a documented method that they override."""
    return _documented(spark, d).where("own or points").select("source_file", "qualified_name").distinct()


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Code, signature and documentation, own or inherited."""
    return _documented(spark, d)


def _embedded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_nodes", "node_id", "embedding")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return forest.similar_pairs(_embedded(spark, d), k=10, at_least=0.95)


def p5_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of each vector with the neighbour's summary."""
    n = forest.nearest(_embedded(spark, d), k=10)
    notes = table(spark, d, "code_nodes", "node_id", "smart_content").where("smart_content is not null")
    notes = notes.groupBy(F.col("node_id").alias("neighbor_id")).agg(F.min("smart_content").alias("smart_content"))
    return n.join(notes, "neighbor_id", "left").select("node_id", "vid", "rank", "neighbor_id", F.round("similarity", 6).alias("similarity"), "smart_content")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_nodes").where("category = 'file'").select("repo", "file_path", "language", "content")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return origin.classify(_files(spark, d)).where("kind is not null").select("file_path")


def p6_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Every file with its kind (null: written by hand) and the scores behind it."""
    return origin.classify(_files(spark, d))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_items(table(spark, d, "chunk_items"), table(spark, d, "code_nodes", "node_id", "content_type"), table(spark, d, "chunk_limits"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("oversized and piece = 0").select("node_id", "chunk_index", "smart").distinct()


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces with running numbers and line ranges."""
    return splitting.renumber(_pieces(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Number of documents, and of those whose ids decode to their text again (null texts to none)."""
    docs = table(spark, d, "documents", "doc_id", "text")
    back = bpe.decode(bpe.encode(docs, "doc_id", "text"), "doc_id", "ids").withColumnRenamed("text", "decoded")
    same = docs.join(back, "doc_id").select((F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))
    return same.agg(F.count("*").alias("n"), F.count_if("same").alias("n_same"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """Each text, or piece of an overlong one, with its container of 2,048 tokens."""
    ids = bpe.encode(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    sizes = keep(ids.select("doc_id", F.size("ids").alias("n_tokens")), "sizes")
    return packing.pack(sizes, "doc_id", "n_tokens", 2048)


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, the tokens in them and the share of their room that is used."""
    c = p9_containers(spark, d).where("container_id is not null").groupBy("container_id").agg(F.sum("size").alias("used"))
    return c.agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"), F.round(F.avg(F.col("used") / 2048), 6).alias("fill"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repair(table(spark, d, "documents", "doc_id", "text")).select("doc_id").distinct()


def p10_repaired(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repair(table(spark, d, "documents", "doc_id", "text"))


QUERIES = {
    "p1_found": p1_found,
    "p1_masked": p1_masked,
    "p3_found": p3_found,
    "p3_rates": p3_rates,
    "p4_found": p4_found,
    "p4_pairs": p4_pairs,
    "p5_found": p5_found,
    "p5_neighbors": p5_neighbors,
    "p6_found": p6_found,
    "p6_kinds": p6_kinds,
    "p7_found": p7_found,
    "p7_pieces": p7_pieces,
    "p8_ids": p8_ids,
    "p8_roundtrip": p8_roundtrip,
    "p9_containers": p9_containers,
    "p9_fill": p9_fill,
    "p10_found": p10_found,
    "p10_repaired": p10_repaired,
}

ORACLE = {
    "p5_found": """
with v as (select distinct node_id, vec from (select node_id, unnest(embedding) as vec from code_nodes)
  where len(vec) > 0 and list_sum(list_transform(vec, lambda x: abs(x))) > 0),
s as (select a.node_id as a, a.vec as va, b.node_id as b, max(list_cosine_similarity(a.vec, b.vec)) as sim
  from v a join v b on a.node_id <> b.node_id and len(a.vec) = len(b.vec) group by all),
r as (select *, row_number() over (partition by a, va order by sim desc, b) as r from s where sim >= 0.95)
select distinct least(a, b) as node_id_a, greatest(a, b) as node_id_b from r where r <= 10""",
    "p7_found": """
with kinds as (select node_id, min(content_type) as kind from code_nodes group by 1)
select distinct i.node_id, i.chunk_index, i.is_smart_content::int as smart
from chunk_items i left join kinds k using (node_id)
join chunk_limits l on l.kind = case when i.is_smart_content then 'smart_content' else k.kind end
where length(i.text) > l.max_chars""",
    "p8_roundtrip": "select count(*) as n, count(*) as n_same from documents",
}
