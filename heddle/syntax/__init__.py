"""Lexer-state maps, bracket summaries and local grammars of the supported languages."""

from __future__ import annotations

import ast
import json
import re
import sys
import tomllib
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

from heddle.syntax import ecma, golang, python, rust, states
from heddle.syntax.base import Broken, Def

LANGUAGES = ["python", "javascript", "typescript", "go", "rust", "json", "toml", "yaml"]


_LEVEL = re.compile(r"(?![ \t\n#]|(?:elif|else|except|finally)\b|[)\]}])")


def statements(text: str) -> list[str]:
    """Top-level statements of a Python text: pieces that begin at the left margin, in the code
    state and outside brackets; decorators stay with what they decorate."""
    out, held, total = [], "", None
    for line in text.splitlines(keepends=True):
        outside = total is None or (total[states.CODE].exit == states.CODE and not total[states.CODE].open)
        if held and outside and _LEVEL.match(line) and not held.rstrip("\n").endswith("\\") and not held.rstrip().rsplit("\n", 1)[-1].startswith("@"):
            out.append(held)
            held, total = "", None
        held += line
        now = states.summarize("python", line)
        total = now if total is None else states.combine(total, now)
    return [*out, held] if held else out


#: What the interpreter says where not the grammar but a depth of its own parser ends.
_LIMITS = ("too many nested parentheses", "too many levels of indentation", "too many nested f-strings", "expressions nested too deeply")


def _python(text: str) -> list[Def]:
    """Python 3.12: the interpreter's own grammar, less what later versions added; texts that are
    too deep for its parser go to one without a depth."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError) as e:
            if any(x in str(e) for x in _LIMITS):
                return python.parse(text)
            raise Broken(str(e)) from None
        except (RecursionError, MemoryError):
            return python.parse(text)
    for node in ast.walk(tree):
        if getattr(node, "default_value", None) is not None:  # defaults of type parameters came with 3.13
            raise Broken("default of a type parameter")
    starts = [0, *(m.end() for m in re.finditer(r"\r\n|\n|\r", text))]
    lines = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]
    at = lambda line, column: starts[line - 1] + len(lines[line - 1].encode()[:column].decode("utf-8", "ignore"))
    defs: list[Def] = []

    def visit(body: list[ast.stmt], owner: str, bases: tuple[str, ...]) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                start = at(node.lineno, node.col_offset)
                first = min([start, *(at(d.lineno, 0) for d in node.decorator_list)])
                first += len(text[first:]) - len(text[first:].lstrip(" \t"))
                head = at(node.body[0].lineno, node.body[0].col_offset)
                defs.append(Def(owner + node.name, first, start, head, at(node.end_lineno, node.end_col_offset), ast.get_docstring(node), bases))
            elif isinstance(node, ast.ClassDef):
                named = [b.value if isinstance(b, ast.Subscript) else b for b in node.bases]
                above = tuple(b.id if isinstance(b, ast.Name) else b.attr for b in named if isinstance(b, (ast.Name, ast.Attribute)))
                begin = at(node.lineno, node.col_offset)
                defs.append(Def(f"{owner}{node.name}.", begin, begin, at(node.body[0].lineno, node.body[0].col_offset), at(node.end_lineno, node.end_col_offset), None, above))
                visit(node.body, f"{owner}{node.name}.", above)
            else:
                for part in ("body", "orelse", "finalbody"):
                    visit([x for x in getattr(node, part, []) if isinstance(x, ast.stmt)], owner, bases)
                for handler in getattr(node, "handlers", []):
                    visit(handler.body, owner, bases)

    visit(tree.body, "", ())
    return defs


def _json(text: str) -> None:
    def constant(name: str) -> None:
        raise ValueError(name)

    try:
        json.loads(text, parse_constant=constant)
    except ValueError as e:
        raise Broken(str(e)) from None
    except RecursionError:
        _deep_json(text)


_JSON = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))')


def _deep_json(text: str) -> None:
    """JSON of any depth: the open brackets are kept in a list."""
    stack: list[str] = []
    want, i, end = "value", 0, len(text.rstrip(" \t\n\r"))
    while i < end:
        m = _JSON.match(text, i)
        if not m:
            raise Broken(f"at {i}: no token")
        sign, value = m.groups()
        string = value is not None and value.startswith('"')
        if want in ("value", "first") and (value or sign in ("[", "{")):
            if value:
                want = "after"
            else:
                stack.append(sign)
                want = "first" if sign == "[" else "first key"
        elif want in ("key", "first key") and string:
            want = ":"
        elif want == ":" and sign == ":":
            want = "value"
        elif want == "after" and sign == "," and stack:
            want = "value" if stack[-1] == "[" else "key"
        elif stack and ((sign == "]" and stack[-1] == "[" and want in ("after", "first")) or (sign == "}" and stack[-1] == "{" and want in ("after", "first key"))):
            stack.pop()
            want = "after"
        else:
            raise Broken(f"at {m.end() - 1}: wanted {want}")
        i = m.end()
    if stack or want != "after":
        raise Broken(f"at {end}: wanted {want}")


def _toml(text: str) -> None:
    try:
        tomllib.loads(text.replace("\r\n", "\n"))
    except ValueError as e:
        raise Broken(str(e)) from None


def _yaml(text: str) -> None:
    import yaml  # without the library the check fails: a file that was not read is not valid

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    try:
        # events, unlike nodes, are made without recursion; what composing adds is the names of nodes
        anchors: set[str] = set()
        for event in yaml.parse(text, Loader=loader):
            anchor = getattr(event, "anchor", None)
            if isinstance(event, yaml.DocumentStartEvent):
                anchors.clear()
            elif anchor is not None and isinstance(event, yaml.AliasEvent) != (anchor in anchors):
                raise Broken(f"undefined or repeated anchor {anchor}")
            elif anchor is not None:
                anchors.add(anchor)
    except (yaml.YAMLError, ValueError) as e:
        raise Broken(str(e)[:200]) from None


_GRAMMARS = {
    "python": _python,
    "json": _json,
    "toml": _toml,
    "yaml": _yaml,
    "javascript": lambda t: ecma.parse(t, typed=False),
    "typescript": lambda t: ecma.parse(t, typed=True),
    "go": golang.parse,
    "rust": rust.parse,
}


#: Calls of the parsers that one character of a text may open.
FRAMES = 40


@contextmanager
def deep(text: str) -> Iterator[None]:
    """Room for calls as deep as the text may nest.  What still cannot be parsed, for want of memory,
    is an error of the job and no statement on the text."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(min(2**31 - 1, max(before, 10_000 + FRAMES * len(text))))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


def problem(text: str | None, language: str | None) -> str | None:
    """What is wrong with the text in its language, or None; unknown languages and null texts pass."""
    grammar = _GRAMMARS.get((language or "").lower())
    if grammar is None or text is None:
        return None
    text = text[1:] if text.startswith("\ufeff") else text
    try:
        with deep(text):
            grammar(text)
    except Broken as e:
        return str(e) or "broken"
    return None


def definitions(text: str, language: str) -> list[Def] | None:
    """Functions and methods of a valid file, and its types, whose names end in a dot; None if it is not valid."""
    grammar = _GRAMMARS.get((language or "").lower())
    if grammar is None:
        return []
    try:
        with deep(text):
            return grammar(text) or []
    except Broken:
        return None


__all__ = ["Broken", "Def", "LANGUAGES", "deep", "definitions", "problem", "states"]
