import pytest

from heddle.operators import search as op

NODE = "node_id string, node_seq long, start_line int, end_line int, content string, smart_content string, leading_context string, embedding array<array<double>>, smart_content_embedding array<array<double>>, embedding_chunk_offsets array<struct<start_line:int,end_line:int>>"
EDGE = "edge_seq long, src string, dst string, edge_type string"


def nodes(spark, rows):
    full = [(r[0], k, 1, 10, r[1] if len(r) > 1 else "", r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, None, None, None) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, NODE)


def test_parent_penalty(spark):
    n = nodes(spark, [("file:auth.py",), ("type:auth.py:Auth",), ("callable:auth.py:Auth.login",)])
    e = spark.createDataFrame([(0, "file:auth.py", "type:auth.py:Auth", None), (1, "type:auth.py:Auth", "callable:auth.py:Auth.login", None)], EDGE)
    got = op.search(n, e, op.QuerySpec("auth", "text")).collect()
    assert [(r.node_id.split(":")[0], round(r.score, 6)) for r in got] == [("callable", 0.8), ("type", 0.6), ("file", 0.45)]


def test_field_order_lines_and_snippet(spark):
    n = nodes(spark, [("a", "one\ntwo needle\nthree", "needle"), ("b", "x", "has needle"), ("c", "y\nz", "sum", "# needle"), ("needle", "")])
    e = spark.createDataFrame([], EDGE)
    got = {r.node_id: r for r in op.search(n, e, op.QuerySpec("needle", "text")).collect()}
    assert (got["a"].score, got["a"].match_field, got["a"].match_start_line, got["a"].snippet) == (0.5, "content", 2, "two needle")
    assert (got["b"].match_field, got["b"].match_end_line) == ("smart_content", 10)
    assert (got["c"].score, got["c"].match_field) == (0.6, "leading_context")
    assert got["needle"].score == 1.0


def test_filters_and_paging(spark):
    n = nodes(spark, [(f"file:src/f{k}.py", "word") for k in range(5)] + [("file:src/g.rs", "word")])
    e = spark.createDataFrame([], EDGE)
    got = op.search(n, e, op.QuerySpec("word", "text", limit=2, offset=1, include=(r"\.py",), exclude=("f0",))).collect()
    assert [r.node_id for r in got] == ["file:src/f2.py", "file:src/f3.py"]


def test_upsert_keeps_last_version(spark):
    n = nodes(spark, [("a", "old word"), ("b", "word"), ("a", "new")])
    got = op.search(n, spark.createDataFrame([], EDGE), op.QuerySpec("word", "text")).collect()
    assert [r.node_id for r in got] == ["b"]


def test_semantic_best_chunk(spark):
    rows = [("a", 0, 1, 2, "text", None, None, [[1.0, 0.0], [0.0, 1.0]], [[0.0, 1.0]], [(1, 1), (2, 2)]), ("b", 1, 1, 2, "t", "summary", None, [], [[1.0, 1.0]], None), ("c", 2, 1, 2, "", None, None, None, None, None)]
    n = spark.createDataFrame(rows, NODE)
    got = {r.node_id: r for r in op.search(n, spark.createDataFrame([], EDGE), op.QuerySpec("q", "semantic", min_similarity=0.5), [0.0, 1.0]).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].match_field, got["a"].chunk_index, got["a"].chunk_offset.start_line) == ("embedding", 1, 2)
    assert got["b"].match_field == "smart_content_embedding" and got["b"].snippet == "summary"


def test_modes(spark):
    assert op.detect_mode("a.*b") == "regex" and op.detect_mode("a.b") == "semantic"
    empty = spark.createDataFrame([], NODE)
    assert op.resolve_mode(op.QuerySpec("plain"), empty) == "text"
    with pytest.raises(op.SearchError):
        op.resolve_mode(op.QuerySpec("plain", "semantic"), empty)


@pytest.mark.parametrize("kw", [{"pattern": " "}, {"pattern": "a", "mode": "x"}, {"pattern": "a", "limit": 0}, {"pattern": "a", "include": ("((",)}])
def test_invalid_specs(kw):
    with pytest.raises(op.SearchError):
        op.QuerySpec(**kw)


def test_folder_drill(spark):
    ids = [f"file:tests/unit/t{k}.py" for k in range(5)] + [f"file:tests/integration/t{k}.py" for k in range(4)] + ["file:src/foo.py"]
    got = {r.folder: r.n for r in op.folder_distribution(spark.createDataFrame([(i,) for i in ids], "node_id string")).collect()}
    assert got == {"tests/unit/": 5, "tests/integration/": 4, "src/": 1}
