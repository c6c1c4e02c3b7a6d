"""Parsing files into nodes: whole files, definitions of the languages with a grammar, Markdown sections.

A handler says how the nodes of a language are called and what its containers are; languages
without one get file nodes alone.
"""

from __future__ import annotations

import ast
import bisect
import hashlib
import re
from collections.abc import Iterator

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from heddle import syntax

NODE = "node_id string, category string, ts_kind string, name string, qualified_name string, file_path string, start_line int, end_line int, start_byte int, end_byte int, content string, content_hash string, signature string, language string, content_type string, parent_node_id string, leading_context string, is_error boolean"
_COLUMNS = [c.split()[0] for c in NODE.split(", ")]
#: Deepest level of definitions that become nodes.
DEEPEST = 4
#: Characters kept of the comments above a definition.
CONTEXT_CHARS = 2000
CODE = {"python", "typescript", "tsx", "javascript", "go", "rust", "java", "kotlin", "scala", "c", "cpp", "csharp", "ruby", "php", "swift", "bash", "sql", "lua", "r", "dockerfile", "hcl", "gdscript", "cuda", "css"}


@dataclass(frozen=True)
class Handler:
    """How a language names its nodes: the root, types, functions and methods; kinds that only hold
    others and become no nodes; how comments above a definition begin."""

    root: str
    type_kinds: tuple[tuple[str, str], ...] = ()
    function: str = "function_declaration"
    method: str = "method_definition"
    containers: frozenset[str] = frozenset(["program", "module", "source_file", "translation_unit", "class_body", "declaration_list", "statement_block"])
    above: tuple[str, ...] = ("//", "/*", "*", "@", "#[")


# Kinds by language; the first word of a definition tells which type it is.
HANDLERS = {
    "python": Handler("module", (("class", "class_definition"),), "function_definition", "function_definition", Handler("").containers | {"block"}, ("#", "@")),
    "javascript": Handler("program", (("class", "class_declaration"),)),
    "typescript": Handler("program", (("class", "class_declaration"), ("interface", "interface_declaration"), ("enum", "enum_declaration"))),
    "go": Handler("source_file", (("", "type_declaration"),), "function_declaration", "method_declaration", above=("//", "/*", "*")),
    "rust": Handler("source_file", (("struct", "struct_item"), ("union", "union_item"), ("enum", "enum_item"), ("trait", "trait_item")), "function_item", "function_item"),
    "markdown": Handler("document"),
    "tsx": Handler("program"),
}
DEFAULT = Handler("config_file")


def handler(language: str | None) -> Handler:
    """The handler of a language; others have the default one."""
    return HANDLERS.get(language or "", DEFAULT)


_FENCE = re.compile(r"^(`{3,}|~{3,})")


def _node(category, kind, name, qualified, path, start, end, sb, eb, content, signature, language, parent, context=None, error=False):
    node_id = f"{category}:{path}" + (f":{qualified}" if category != "file" else "")
    kind_of = "code" if language in CODE else "content"
    return (node_id, category, kind, name, qualified, path, start, end, sb, eb, content, hashlib.sha256(content.encode("utf-8", "replace")).hexdigest(), signature, language, kind_of, parent, context, error)


def file_node(path: str, language: str, text: str, error: bool = False) -> tuple:
    name = path.rsplit("/", 1)[-1]
    return _node("file", handler(language).root, name, name, path, 1, text.count("\n") + 1, 0, len(text.encode("utf-8", "replace")), text, None, language, None, None, error)


def markdown_sections(path: str, text: str) -> list[tuple]:
    """One node per second-level heading outside code fences; text before the first is a preamble
    named after the first top heading; a repeated name carries its line."""
    lines = text.split("\n")
    fence: str | None = None
    title: str | None = None
    marks: list[tuple[int, str]] = []
    for i, line in enumerate(lines):
        if m := _FENCE.match(line.strip()):
            if fence is None:
                fence = m.group(1)
            elif m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence):
                fence = None
            continue
        if fence is not None:
            continue
        if title is None and (m := re.match(r"^# +(.+)$", line)):
            title = m.group(1).strip()
        if m := re.match(r"^## +(.+)$", line):
            marks.append((i, m.group(1).strip()))
    if not marks:
        return []
    spans = [(None, 0, marks[0][0] - 1)] if marks[0][0] > 0 else []
    spans += [(name, at, (marks[k + 1][0] if k + 1 < len(marks) else len(lines)) - 1) for k, (at, name) in enumerate(marks)]
    seen: set[str] = set()
    out = []
    for heading, a, b in spans:
        name = heading if heading is not None else (title or "Preamble")
        qualified = f"{name}@{a + 1}" if name in seen else name
        seen.add(name)
        content = "\n".join(lines[a : b + 1])
        while content.endswith("\n\n"):
            content = content[:-1]
        sb = len("\n".join(lines[:a]).encode()) + (1 if a else 0)
        signature = f"## {name}" if heading is not None else (lines[a].strip() or "Preamble")
        out.append(_node("section", "section", name, qualified, path, a + 1, b + 1, sb, sb + len(content.encode()), content, signature, "markdown", f"file:{path}"))
    return out


def _context(lines: list[str], first: int, marks: tuple[str, ...] = ("#", "@")) -> str | None:
    """Comments and decorators right above line ``first``, in source order."""
    k = first - 2
    while k >= 0 and lines[k].lstrip().startswith(marks):
        k -= 1
    text = "\n".join(lines[k + 1 : first - 1]).strip()
    return (text[:CONTEXT_CHARS] + "\n[TRUNCATED]" if len(text) > CONTEXT_CHARS else text) or None


def python_nodes(path: str, text: str) -> tuple[list[tuple], bool]:
    """(definitions as nodes, whether the file has an error)."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [], True
    lines = text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line.encode("utf-8", "replace")) + 1)
    out: list[tuple] = []
    seen: dict[str, int] = {}

    def visit(body, owner: str, parent: str, depth: int) -> None:
        for n in body:
            is_type, is_call = isinstance(n, ast.ClassDef), isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))
            if not (is_type or is_call):
                for part in ("body", "orelse", "finalbody"):
                    visit([x for x in getattr(n, part, []) or [] if isinstance(x, ast.stmt)], owner, parent, depth)
                continue
            category, kind = ("type", "class_definition") if is_type else ("callable", "function_definition")
            qualified = f"{owner}{n.name}"
            key = f"{category}:{qualified}"
            if key in seen and seen[key] != n.lineno:
                qualified = f"{qualified}@{n.lineno}"
            seen.setdefault(key, n.lineno)
            content = "\n".join(lines[n.lineno - 1 : n.end_lineno])
            first = min([n.lineno, *(d.lineno for d in n.decorator_list)])
            above = [x for x in (_context(lines, first), "\n".join(lines[first - 1 : n.lineno - 1]).strip()) if x]
            out.append(_node(category, kind, n.name, qualified, path, n.lineno, n.end_lineno, starts[n.lineno - 1], starts[n.end_lineno] - 1, content, lines[n.lineno - 1].strip(), "python", parent, "\n".join(above)[: CONTEXT_CHARS + 12] or None))
            if depth < DEEPEST:
                visit(n.body, f"{qualified}.", out[-1][0], depth + 1)

    visit(tree.body, "", f"file:{path}", 1)
    return out, False


def definition_nodes(path: str, language: str, text: str) -> tuple[list[tuple], bool]:
    """(definitions as nodes, whether the file has an error) by the grammar of a language.

    Methods hang below their type where it stands in the file, all else below the file; a name
    that comes again carries its line.
    """
    found = syntax.definitions(text, language)
    if found is None:
        return [], True
    how = handler(language)
    lines = text.split("\n")
    ends = [0]
    for line in lines:
        ends.append(ends[-1] + len(line) + 1)
    line_at = lambda at: bisect.bisect_right(ends, at)
    sizes = [0]
    for line in lines:
        sizes.append(sizes[-1] + len(line.encode("utf-8", "replace")) + 1)
    byte_at = lambda at: sizes[line_at(at) - 1] + len(text[ends[line_at(at) - 1] : at].encode("utf-8", "replace"))
    out: list[tuple] = []
    types: dict[str, str] = {}
    seen: set[str] = set()
    for d in sorted(found, key=lambda d: (d.start, -d.end)):
        is_type = d.name.endswith(".")
        qualified = d.name.rstrip(".")
        owner, _, name = qualified.rpartition(".")
        first, last = line_at(d.start), line_at(max(d.start, d.end - 1))
        if is_type:
            word = text[d.start : d.end].split(None, 1)[0]
            kind = next((k for w, k in how.type_kinds if not w or w == word), "type_declaration")
        else:
            kind = how.method if owner else how.function
            if language in ("javascript", "typescript") and not owner and "function" not in text[d.start : d.head].split("(", 1)[0]:
                kind = "arrow_function"
        category = "type" if is_type else "callable"
        key = f"{category}:{qualified}"
        shown = f"{qualified}@{first}" if key in seen else qualified
        seen.add(key)
        signature = re.sub(r"\s+", " ", text[d.start : d.head]).strip()
        node = _node(category, kind, name, shown, path, first, last, byte_at(d.start), byte_at(d.end), text[d.start : d.end], signature, language, types.get(owner, f"file:{path}"), _context(lines, line_at(d.first), how.above))
        if is_type:
            types.setdefault(qualified, node[0])
        out.append(node)
    return out, False


def nodes_below(path: str, language: str | None, text: str) -> tuple[list[tuple], bool]:
    """(nodes below the file node, whether the file has an error)."""
    if language == "python":
        return python_nodes(path, text)
    if language == "markdown":
        return markdown_sections(path, text), False
    if handler(language).type_kinds:
        return definition_nodes(path, language, text)
    return [], False


def parse(files: DataFrame) -> DataFrame:
    """Nodes of files; files: (file_path, language, content). A file that does not parse keeps its
    file node, marked as an error; null contents give nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for path, language, text in zip(b["file_path"], b["language"], b["content"]):
                if not isinstance(text, str) or not isinstance(path, str):
                    continue
                below, error = nodes_below(path, language, text)
                rows.append(file_node(path, language, text, error))
                rows += below
            out = pd.DataFrame(rows, columns=_COLUMNS)
            yield out.astype({"start_line": "int32", "end_line": "int32", "start_byte": "int32", "end_byte": "int32"}) if rows else out

    return files.select("file_path", "language", "content").mapInPandas(run, NODE)
