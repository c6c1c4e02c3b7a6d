"""Results stay whole whatever their depth or number."""

import json
import sys

import pytest
from pyspark.sql import functions as F

from heddle.operators import enrich, graph, incremental, layout, refs, report, search
from heddle.sources import store
from heddle.streaming import watch


def test_chain_of_many_levels(spark):
    n = 1500
    up = spark.range(1, n + 1).select(F.col("id").cast("string").alias("node_id"), (F.col("id") - 1).cast("string").alias("parent_id"))
    start = spark.createDataFrame([(str(n),), ("3",)], "node_id string")
    got = graph.ancestors(start, up)
    assert got.where("node_id = '3'").count() == 3
    assert got.where(f"node_id = '{n}'").agg(F.count("*"), F.max("depth"), F.countDistinct("ancestor_id")).first() == (n, n, n)


def test_closed_chains_end(spark):
    up = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", "d"), ("e", None)], "node_id string, parent_id string")
    start = spark.createDataFrame([("a",), ("b",), ("d",), ("e",), (None,)], "node_id string")
    got = {(r.node_id, r.ancestor_id, r.depth) for r in graph.ancestors(start, up).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


def nodes(spark, rows):
    return spark.createDataFrame(rows, "node_id string, file_path string, start_line int, end_line int")


def test_treemap_places_every_node(spark):
    rows = [(f"n{k}", "/".join("abcdefgh"[: k % 8]) + ("/" if k % 8 else "") + f"f{k % 3}.py", k, k + 5) for k in range(200)] + [("top", "x.py", None, None), ("none", None, 1, 1)]
    got = {r.node_id: r for r in layout.treemap(nodes(spark, rows)).collect()}
    assert len(got) == 202 and got["top"].size == 4.0
    folders = {r.folder: r for r in layout.rectangles(nodes(spark, rows)).where("not local").collect()}
    assert max(folders) == "a/b/c/d/e/f/g"
    for f, r in folders.items():
        if "/" in f:
            p = folders[f.rsplit("/", 1)[0]]
            assert r.w < p.w + 1e-9 and r.h < p.h + 1e-9 and r.x >= p.x and r.y >= p.y
    assert layout.treemap(nodes(spark, []) ).count() == 0


def test_files_hold_every_row(spark, tmp_path):
    df = spark.range(3000).select("id", F.lit("</script>").alias("t"))
    assert store.save_json(df, "rows.json", str(tmp_path)) == 3000
    assert len(json.loads((tmp_path / "rows.json").read_text())) == 3000
    with pytest.raises(ValueError):
        store.save_json(df, "../rows.json", str(tmp_path))
    meta = spark.createDataFrame([("p",)], "project string")
    drawn = df.select(F.col("id").cast("string").alias("node_id"), "t", F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(4.0).alias("size"))
    edges = spark.createDataFrame([("e-0", "1", "2", "#f59e0b", False)], "id string, source string, target string, color string, hidden boolean")
    assert report.write_html(drawn, edges, meta, str(tmp_path / "page.html")) == 3000
    page = (tmp_path / "page.html").read_text()
    assert page.count('"node_id"') == 3000 and page.count("</script>") == 2


def test_patterns_with_a_time_limit(spark):
    assert search.may_explode(r"(a+)+b") and search.may_explode("(a|aa)*c") and not search.may_explode(r"def (merge|split)_\w+")
    row = [("x", "a" * 40, None, None), ("y", "aab", "aab", None)]
    df = spark.createDataFrame(row, "node_id string, content string, smart_content string, leading_context string")
    got = {r.node_id: r.content for r in search.within_time(df, r"^(a|a|aa)+b$", 0.2).collect()}
    assert got == {"x": None, "y": "aab"}


def test_guard_of_dimensions(spark):
    df = spark.createDataFrame([("a", [[1.0]], "h")], "node_id string, embedding array<array<double>>, embedding_hash string")
    now = {"embedding_dimensions": 64, "embedding_model": "m"}
    assert incremental.guard(df, None, now)[1] is None
    assert "model" in incremental.guard(df, {"embedding_dimensions": 64, "embedding_model": "old"}, now)[1]
    with pytest.raises(incremental.DimensionError):
        incremental.guard(df, {"embedding_dimensions": 32}, now)
    assert incremental.guard(df, {"embedding_dimensions": 32}, now, force=True)[0].first().embedding is None


def test_scan_process_ends():
    assert watch.run_scan([sys.executable, "-c", "raise SystemExit(3)"]) == 3
    assert watch.run_scan([sys.executable, "-c", "import time; time.sleep(30)"], timeout=0.5) == 124


def test_progress(spark):
    rows = [("w", k, k * 2) for k in range(30)]
    df = spark.createDataFrame(rows, "worker string, seq long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.seq: r for r in watch.eta_seconds(watch.progress(df, ["worker"]), 100).collect()}
    assert got[0].rate is None and got[29].rate == 0.5 and got[29].eta == 140.0


def test_graph_of_a_command(spark, tmp_path):
    catalog = store.Catalog(spark, [store.GraphEntry("default", str(tmp_path / "none"))])
    assert store.graph_listing(catalog)["count"] == 1
    for args in ((str(tmp_path / "file"), None), (None, "other"), (None, None)):
        with pytest.raises((store.GraphStoreError, store.UnknownGraphError)):
            store.choose(catalog, *args)


def test_references_all_or_nothing(spark):
    nodes = spark.createDataFrame([("file:a.py",), ("callable:a.py:f",), ("file:b.md",), ("section:b.md:x",)], "node_id string")
    prior = spark.createDataFrame([("callable:a.py:f", "section:b.md:x", "references", 1), ("callable:a.py:f", "file:a.py", "references", 2)], "src string, dst string, edge_type string, edge_seq long")
    occ = spark.createDataFrame([], "occ_id long, doc_path string, symbol string, symbol_roles int")
    prose = spark.createDataFrame([("b.md",)], "file_path string")
    code = spark.createDataFrame([("a.py",)], "file_path string")
    assert not refs.has_resolvable(nodes, prose) and refs.has_resolvable(nodes, code)
    assert [tuple(r) for r in refs.cross_file(occ, nodes, prior, prose).collect()] == [("callable:a.py:f", "file:a.py", "reused")]


def test_discovery_notes_missing_roots(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1")
    s = enrich.ScanSummary()
    assert enrich.discover(spark, [str(tmp_path), str(tmp_path / "none")], s).count() == 1
    assert s.counts["files"] == 1 and not s.success and "none" in s.errors[0]


def test_relevant_changes(spark):
    paths = ["/r/a.py", "/r/.a.py.swp", "/r/b~", "/r/.git/HEAD", "/r/build/x.o", "/r/logs/keep.log", "/r/logs/a.log"]
    df = spark.createDataFrame([("modified", p) for p in paths], "change_type string, path string")
    got = {r.path for r in watch.relevant(df, "/r", ["build/", "*.log", "!keep.log"]).collect()}
    assert got == {"/r/a.py", "/r/logs/keep.log"}
