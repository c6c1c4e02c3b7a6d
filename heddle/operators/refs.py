"""Cross-file references from symbol occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from heddle.functions import scalars as S
from heddle.operators import graph
from heddle.session import keep

#: Reference rows of a symbol are spread over so many parts, so that an external symbol
#: that everything uses is no single task.
SALTS = 16


def usable(occ: DataFrame, skip: str | None = None) -> DataFrame:
    """Without empty and local symbols; ``skip`` is a pattern of documents to leave out."""
    o = occ.where((F.length("symbol") > 0) & ~F.col("symbol").startswith("local "))
    return o.where(~F.col("doc_path").rlike(skip)) if skip else o


def raw_edges(occ: DataFrame, skip: str | None = None) -> DataFrame:
    """(ref_file, def_file, symbol): a reference in another file than the symbol's last definition."""
    o = usable(occ, skip)
    is_def = F.col("symbol_roles").bitwiseAND(F.lit(1)) == 1
    defs = o.where(is_def).groupBy("symbol").agg(F.max_by("doc_path", "occ_id").alias("def_file"))
    salted = defs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    refs = o.where(~is_def).select("symbol", F.col("doc_path").alias("ref_file")).distinct()
    refs = refs.withColumn("salt", F.pmod(F.xxhash64("ref_file"), F.lit(SALTS)).cast("int"))
    return refs.join(salted, ["symbol", "salt"]).where("ref_file <> def_file").select("ref_file", "def_file", "symbol")


def name_parts(descriptor: Column) -> Column:
    """Names in a descriptor: path segments split at slashes outside backticks; quoted ones are
    skipped; Type#member(). gives both names, f(). one."""
    outside = F.regexp_replace(descriptor, "`[^`]*`", "`")
    segments = F.filter(F.split(outside, "/"), lambda s: (s != "") & ~s.startswith("`"))
    strip = lambda s: F.regexp_replace(s, r"[().]+$", "")
    def of(s: Column) -> Column:
        head, rest = F.split_part(s, F.lit("#"), F.lit(1)), strip(F.regexp_replace(s, "^[^#]*#", ""))
        typed = F.filter(F.array(F.when((head != "") & ~head.startswith("__"), head), F.when((rest != "") & ~rest.startswith("("), rest)), lambda x: x.isNotNull())
        plain = F.filter(F.array(F.when(s.endswith("().") & (strip(s) != ""), strip(s))), lambda x: x.isNotNull())
        return F.when(s.contains("#"), typed).otherwise(plain)
    return F.flatten(F.transform(segments, of))


def quoted_name(descriptor: Column) -> Column:
    """Names of descriptors that quote the symbol itself: `Type.member`(). as one dotted name."""
    return F.split(F.regexp_extract(descriptor, r"`([^`/]+)`(?:\(\))?\.?$", 1), r"\.")


def candidates(path: Column, parts: Column) -> Column:
    """Node ids a symbol may mean, best first: by full name, without its first part, the file."""
    full = F.array_join(parts, ".")
    short = F.array_join(F.slice(parts, 2, F.greatest(F.lit(1), F.size(parts))), ".")
    ids = lambda n, ok: [F.when(ok, F.concat(F.lit(f"{c}:"), path, F.lit(":"), n)) for c in ("callable", "class", "type")]
    return F.filter(F.array(*ids(full, full != ""), *ids(short, F.size(parts) > 1), F.concat(F.lit("file:"), path)), lambda x: x.isNotNull())


def map_to_nodes(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst) of raw edges with both ends found; unmapped ones and self-references drop out."""
    known = nodes.select(F.col("node_id").alias("known")).where("known is not null").distinct()
    # symbols of four parts carry no version; their last part is the descriptor
    d = F.coalesce(S.symbol_descriptor(F.col("symbol")), F.element_at(F.split("symbol", " "), -1))
    # descriptors without separators quote the whole name; others name it in segments
    parts = F.when(F.size(name_parts(d)) > 0, name_parts(d)).otherwise(F.filter(quoted_name(d), lambda x: x != ""))
    rows = raw.withColumn("rid", F.xxhash64("ref_file", "def_file", "symbol")).withColumn("parts", F.coalesce(parts, F.array().cast("array<string>")))
    both = rows.select("rid", F.explode(F.array(F.struct(F.lit("dst").alias("side"), candidates(F.col("def_file"), F.col("parts")).alias("c")), F.struct(F.lit("src").alias("side"), candidates(F.col("ref_file"), F.col("parts")).alias("c")))).alias("x"))
    flat = both.select("rid", "x.side", F.posexplode("x.c").alias("at", "candidate"))
    hit = flat.join(known, F.col("candidate") == F.col("known"), "left_semi").groupBy("rid", "side").agg(F.min_by("candidate", "at").alias("node"))
    ends = hit.groupBy("rid").agg(F.max(F.when(F.col("side") == "src", F.col("node"))).alias("src"), F.max(F.when(F.col("side") == "dst", F.col("node"))).alias("dst"))
    return ends.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct()


def reuse_prior(prior: DataFrame, changed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Prior reference edges whose ends both still exist and whose files both did not change."""
    ids = nodes.select("node_id").distinct()
    e = prior.where("edge_type = 'references'").withColumn("sf", S.file_path(F.col("src"))).withColumn("df", S.file_path(F.col("dst")))
    e = e.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    e = e.join(changed.withColumnRenamed("file_path", "sf"), "sf", "left_anti").join(changed.withColumnRenamed("file_path", "df"), "df", "left_anti")
    return e.select("src", "dst", "edge_seq")


def has_resolvable(nodes: DataFrame, changed: DataFrame) -> bool:
    """Whether a changed file holds a callable or a type."""
    found = nodes.where(F.split_part("node_id", F.lit(":"), F.lit(1)).isin("callable", "type")).select(S.file_path(F.col("node_id")).alias("file_path"))
    return not found.join(changed.select("file_path"), "file_path", "left_semi").limit(1).isEmpty()


def cross_file(occ: DataFrame, nodes: DataFrame, prior: DataFrame | None = None, changed: DataFrame | None = None) -> DataFrame:
    """(src, dst, origin): reused prior edges first, then fresh ones; one per pair, the first wins.

    All or nothing: if no changed file holds a callable or a type, nothing is resolved anew and the
    reused edges are the result; otherwise every occurrence is.
    """
    if prior is not None and changed is not None and not has_resolvable(nodes, changed):
        return reuse_prior(prior, changed, nodes).select("src", "dst", F.lit("reused").alias("origin")).distinct()
    fresh = keep(map_to_nodes(raw_edges(occ), nodes), "fresh").select("src", "dst", F.lit("fresh").alias("origin"), F.lit(1).alias("edge_seq"))
    if prior is None or changed is None:
        return fresh.drop("edge_seq")
    old = reuse_prior(prior, changed, nodes).select("src", "dst", F.lit("reused").alias("origin"), F.lit(0).alias("edge_seq"))
    return graph.first_edges(old.distinct().unionByName(fresh)).drop("edge_seq")
