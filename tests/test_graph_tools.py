import numpy as np

from heddle.operators import chunking, layout, parsing, refs, report
from heddle.sources import files, store


def words(text):
    return len(text.split())


def test_token_chunks():
    text = "\n".join(f"w{k} x y" for k in range(30))
    got = chunking.chunk_tokens(text, 30, 0, words)
    assert len(got) > 1 and got[0][1] == 1 and got[-1][2] == 30
    assert all(a[2] + 1 == b[1] for a, b in zip(got, got[1:]))
    overlapped = chunking.chunk_tokens(text, 30, 6, words)
    assert all(b[1] == a[2] - 1 for a, b in zip(overlapped, overlapped[1:]))
    assert chunking.chunk_tokens("", 5, 0, words) == [("", 1, 1)]


def test_long_line():
    line = "ab" * 4000
    pieces = [t for t, first, last in chunking.chunk_tokens("x\n" + line, 500, 0) if len(t) > 1]
    assert "".join(pieces) == line and {len(t) for t in pieces[:-1]} == {chunking.piece_length(8000, 2000, 500)} == {1800}


def test_fold_table():
    sizes = np.array([3, 5, 2, 9, 1])
    table = report.fold_table(sizes, 10)
    for s in range(11):
        t = s
        for c in sizes:
            t = t + c if t + c <= 10 else t + 1
        assert table[s] == t


def test_cluster_callables(spark):
    schema = "node_id string, category string, parent_node_id string, start_line int, end_line int, file_path string"
    rows = [("file:f", "file", None, 1, 9, "f")] + [(f"callable:f:{k}", "callable", "file:f", k, k + 1, "f") for k in range(150)]
    edges = spark.createDataFrame([(0, "callable:f:1", "callable:f:2", "references")], "edge_seq long, src string, dst string, edge_type string")
    shown, e, _ = report.cluster_callables(spark.createDataFrame(rows, schema), edges, 100)
    got = {r.node_id: r.n_clustered for r in shown.collect()}
    assert got == {"file:f": 1, "callable:f:_cluster_150": 150}
    assert [(r.src, r.dst) for r in e.collect()] == [("callable:f:_cluster_150",) * 2]
    many = [(f"file:{k}", "file", None, 1, 1, str(k)) for k in range(120)]
    assert report.cluster_callables(spark.createDataFrame(many, schema), edges, 100)[0].count() == 120


def test_markdown_sections():
    text = "# Top\n\n## Tasks\nx\n```\n## no\n```\n## Tasks\n\n\n## é\n"
    got = parsing.markdown_sections("a.md", text)
    assert [(n[4], n[6], n[7]) for n in got] == [("Top", 1, 2), ("Tasks", 3, 7), ("Tasks@8", 8, 10), ("é", 11, 12)]
    raw = text.encode()
    assert all(raw[n[8] : n[9]].decode() == n[10] for n in got)
    assert parsing.markdown_sections("a.md", "no heading") == []


def test_python_nodes(spark):
    src = "import os\n\n# about f\n@deco\ndef f():\n    pass\n\nclass A:\n    def m(self):\n        return 1\n"
    got, error = parsing.python_nodes("a.py", src)
    assert not error and [(n[0], n[15]) for n in got] == [("callable:a.py:f", "file:a.py"), ("type:a.py:A", "file:a.py"), ("callable:a.py:A.m", "type:a.py:A")]
    assert got[0][16].startswith("# about f")
    df = parsing.parse(spark.createDataFrame([("a.py", "python", "def ("), ("b.py", "python", None)], "file_path string, language string, content string"))
    assert [(r.node_id, r.is_error) for r in df.collect()] == [("file:a.py", True)]


def test_def_ref(spark):
    occ = [(0, "a.py", "s p k v greet().", 1), (1, "b.py", "s p k v greet().", 0), (2, "b.py", "s p k v main().", 1), (3, "b.py", "local 1", 0), (4, "b.py", "", 0), (5, "a.py", "s p k v greet().", 0)]
    got = refs.raw_edges(spark.createDataFrame(occ, "occ_id long, doc_path string, symbol string, symbol_roles int")).collect()
    assert [(r.ref_file, r.def_file) for r in got] == [("b.py", "a.py")]


def test_name_parts(spark):
    from pyspark.sql import functions as F

    rows = [("`pkg.module`/MyClass#method().", ["MyClass", "method"]), ("TaskApp/TaskService#AddTask().", ["TaskService", "AddTask"]), ("mod/f().", ["f"]), ("`example.com/x/y`/Type#Field.", ["Type", "Field"])]
    df = spark.createDataFrame(rows, "d string, want array<string>")
    assert df.where(refs.name_parts(F.col("d")) != F.col("want")).count() == 0


def test_hull():
    assert set(layout.hull([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (1, 0)])) == {(0, 0), (2, 0), (2, 2), (0, 2)}


def test_scan_and_ignore(tmp_path, spark):
    (tmp_path / ".git").mkdir()
    (tmp_path / ".gitignore").write_text("*.log\nbuild/\n!keep.log\n")
    (tmp_path / "src").mkdir()
    (tmp_path / "build").mkdir()
    for p in ("src/a.py", "src/x.log", "keep.log", "build/out.py", "src/go.mod"):
        (tmp_path / p).write_text("x = 1\n")
    found, missing = files.list_files([str(tmp_path), str(tmp_path / "none")])
    assert {p[len(str(tmp_path)) + 1 :] for p, _ in found} == {".gitignore", "src/a.py", "keep.log", "src/go.mod"}
    assert missing == [str(tmp_path / "none")]
    df, _ = files.scan(spark, [str(tmp_path)])
    assert [(r.language, r.marker_file) for r in files.project_roots(df).collect()] == [("go", "go.mod")]
    nodes = files.read_nodes(spark, df, str(tmp_path)).collect()
    assert any(r.node_id == "file:src/a.py" for r in nodes)


def test_store_and_catalog(tmp_path, spark):
    n = spark.createDataFrame([("a",)], "node_id string")
    e = spark.createDataFrame([], "src string, dst string")
    store.save_graph(n, e, str(tmp_path / "g"), embedding_model="m")
    c = store.Catalog(spark, [store.GraphEntry("other", "none"), store.GraphEntry("default", str(tmp_path / "g"))])
    assert c.get()[0].count() == 1 and c.get()[2]["embedding_model"] == "m"
    store.save_graph(n.union(n), e, str(tmp_path / "g"))
    assert c.get()[0].count() == 2
    assert [(r.name, r.available) for r in c.listing().collect()] == [("default", True), ("other", False)]


def test_settings():
    got = store.layered({"a": {"x": 1, "y": 2}, "graphs": [{"name": "g", "p": 1}]}, {"a": {"y": 3}, "graphs": [{"name": "g", "p": 2}, {"name": "h"}]}, store.env_settings("APP", {"APP_A__Z": "${HOME_X}"}))
    assert got == {"a": {"x": 1, "y": 3, "z": "${HOME_X}"}, "graphs": [{"name": "g", "p": 2}, {"name": "h"}]}


def test_docs(tmp_path, spark):
    (tmp_path / "a.md").write_text("hello")
    (tmp_path / "r.yaml").write_text("documents:\n- {id: a, title: A, category: c, tags: [x], path: a.md}\n")
    docs = store.load_docs(spark, str(tmp_path / "r.yaml"))
    assert store.get_document(docs, "a")["content"] == "hello" and store.get_document(docs, "zz") is None


def test_pipeline(spark):
    from heddle.operators import enrich

    schema = "node_id string, node_seq long, category string, name string, file_path string, content string, content_hash string, language string, content_type string, start_line int, end_line int, parent_node_id string, leading_context string, smart_content string, smart_content_hash string, embedding array<array<double>>, smart_content_embedding array<array<double>>, embedding_hash string, embedding_chunk_offsets array<struct<start_line:int,end_line:int>>"
    import hashlib

    def row(k, text):
        return (f"file:f{k}.py", k, "file", f"f{k}.py", f"f{k}.py", text, hashlib.sha256(text.encode()).hexdigest(), "python", "code", 1, 3, None, None, None, None, None, None, None, None)

    fresh = spark.createDataFrame([row(0, "word " * 40), row(1, "tiny"), row(2, "other " * 30)], schema)
    nodes, edges, s = enrich.run_pipeline(fresh, None, None)
    assert s.success and s.counts["summaries_enriched"] == 2 and s.counts["summaries_placeholder"] == 1
    again, _, s2 = enrich.run_pipeline(fresh, nodes.drop("first_seq"), None)
    assert s2.counts.get("summaries_enriched") is None and again.where("embedding is null").count() == 0

    def failing(texts):
        raise RuntimeError("down")

    _, _, s3 = enrich.run_pipeline(fresh, None, None, embedder=failing)
    assert not s3.success


def test_watch(tmp_path, spark):
    from heddle.streaming import watch

    src = tmp_path / "in"
    spark.createDataFrame([("added", "a.py", 1), ("modified", "a.py", 2), ("added", "b.tmp", 3)], "change_type string, path string, s int").selectExpr("change_type", "path", "timestamp_seconds(s) as ts").write.parquet(str(src))
    seen = []
    q = watch.watch(watch.change_stream(spark, str(src)), lambda df, n: seen.extend(tuple(r) for r in df.collect()), str(tmp_path / "cp"), once=True, ignore=r"\.tmp$")
    q.awaitTermination()
    assert seen == [("a.py", "modified", 2)]
    watch.stop(q)
    watch.stop(q)
