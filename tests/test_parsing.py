from heddle.operators import parsing

TEXTS = {
    "a/x.ts": ("typescript", "/** Keeps rows. */\nexport class Store extends Base {\n  // Adds a row.\n  add(row: number): void { this.rows.push(row) }\n}\ninterface Row { id: number }\nenum Kind { A, B }\nexport function load(path: string) {\n  return path\n}\nconst trim = (s: string) => s.trim()\n"),
    "a/y.go": ("go", "package p\n\n// Box holds things.\ntype Box struct {\n\tn int\n}\n\n// Size tells how many.\nfunc (b *Box) Size() int {\n\ttype local struct{}\n\treturn b.n\n}\n\nfunc New() *Box { return nil }\n"),
    "a/z.rs": ("rust", "/// A shape.\n#[derive(Debug)]\npub struct Shape<T> { side: T }\npub enum Kind { A, B }\ntrait Area { fn area(&self) -> u32; }\nimpl<T> Area for Shape<T> {\n    fn area(&self) -> u32 { 1 }\n}\nfn main() { struct Inner; }\n"),
    "a/w.js": ("javascript", "class Queue {\n  push(x) { return x }\n}\nfunction é() {}\nfunction é() {}\n"),
    "a/broken.go": ("go", "package p\nfunc {\n"),
    "a/q.css": ("css", "a { b: c }"),
}


def test_definitions_by_language(spark):
    rows = [(p, language, text) for p, (language, text) in TEXTS.items()] + [("n.go", "go", None), (None, "go", "package p")]
    got = [r for r in parsing.parse(spark.createDataFrame(rows, "file_path string, language string, content string")).collect()]
    below = {r.node_id: (r.ts_kind, r.start_line, r.end_line, r.parent_node_id) for r in got if r.category != "file"}
    assert below == {
        "type:a/x.ts:Store": ("class_declaration", 2, 5, "file:a/x.ts"), "callable:a/x.ts:Store.add": ("method_definition", 4, 4, "type:a/x.ts:Store"), "type:a/x.ts:Row": ("interface_declaration", 6, 6, "file:a/x.ts"),
        "type:a/x.ts:Kind": ("enum_declaration", 7, 7, "file:a/x.ts"), "callable:a/x.ts:load": ("function_declaration", 8, 10, "file:a/x.ts"), "callable:a/x.ts:trim": ("arrow_function", 11, 11, "file:a/x.ts"),
        "type:a/y.go:Box": ("type_declaration", 4, 6, "file:a/y.go"), "callable:a/y.go:Box.Size": ("method_declaration", 9, 12, "type:a/y.go:Box"), "callable:a/y.go:New": ("function_declaration", 14, 14, "file:a/y.go"),
        "type:a/z.rs:Shape": ("struct_item", 3, 3, "file:a/z.rs"), "type:a/z.rs:Kind": ("enum_item", 4, 4, "file:a/z.rs"), "type:a/z.rs:Area": ("trait_item", 5, 5, "file:a/z.rs"), "callable:a/z.rs:Area.area": ("function_item", 5, 5, "type:a/z.rs:Area"),
        "callable:a/z.rs:Shape.area": ("function_item", 7, 7, "type:a/z.rs:Shape"), "callable:a/z.rs:main": ("function_item", 9, 9, "file:a/z.rs"),
        "type:a/w.js:Queue": ("class_declaration", 1, 3, "file:a/w.js"), "callable:a/w.js:Queue.push": ("method_definition", 2, 2, "type:a/w.js:Queue"), "callable:a/w.js:é": ("function_declaration", 4, 4, "file:a/w.js"), "callable:a/w.js:é@5": ("function_declaration", 5, 5, "file:a/w.js"),
    }
    assert {r.file_path for r in got if r.category == "file" and r.is_error} == {"a/broken.go"} and sum(r.category == "file" for r in got) == 6
    by = {r.node_id: r for r in got}
    assert by["type:a/y.go:Box"].leading_context == "// Box holds things." and by["callable:a/x.ts:Store.add"].signature == "add(row: number): void"
    for r in got:
        text = TEXTS[r.file_path][1].encode()
        assert text[r.start_byte : r.end_byte].decode() == r.content


def test_handlers():
    assert "block" in parsing.handler("python").containers and "block" not in parsing.handler("go").containers
    assert parsing.handler("cobol") == parsing.handler(None) == parsing.DEFAULT
