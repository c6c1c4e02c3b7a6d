"""Token cursor shared by the local grammars."""

from __future__ import annotations

from typing import NamedTuple


class Broken(Exception):
    """The text is not in the language."""


class Def(NamedTuple):
    """A function or method: Type.name or name; offsets of its first attribute, of itself
    without attributes, of the end of its signature and of its end; docstring if any.  A type
    is named with a dot at its end and has bases."""

    name: str
    first: int
    start: int
    head: int
    end: int
    doc: str | None = None
    bases: tuple[str, ...] = ()


class Tok:
    """kind: name, num, str, char, life, op or end; nl: a line end stands before it."""

    __slots__ = ("kind", "text", "start", "end", "nl")

    def __init__(self, kind: str, text: str, start: int, end: int, nl: bool = False):
        self.kind, self.text, self.start, self.end, self.nl = kind, text, start, end, nl

    def __repr__(self) -> str:
        return f"{self.kind}:{self.text!r}@{self.start}"


class Cursor:
    """Walks over a list of tokens that ends with an ``end`` token."""

    def __init__(self, toks: list[Tok]):
        self.toks, self.i = toks, 0

    @property
    def tok(self) -> Tok:
        return self.toks[self.i]

    def ahead(self, n: int = 1) -> Tok:
        return self.toks[min(self.i + n, len(self.toks) - 1)]

    def at(self, *texts: str) -> bool:
        t = self.toks[self.i]
        return t.text in texts and t.kind in ("op", "name")

    def next(self) -> Tok:
        t = self.toks[self.i]
        if t.kind != "end":
            self.i += 1
        return t

    def eat(self, *texts: str) -> bool:
        if self.at(*texts):
            self.i += 1
            return True
        return False

    def need(self, *texts: str) -> None:
        if not self.eat(*texts):
            self.fail("/".join(texts))

    def need_kind(self, kind: str) -> Tok:
        if self.tok.kind != kind:
            self.fail(kind)
        return self.next()

    def fail(self, wanted: str = "") -> None:
        t = self.tok
        raise Broken(f"at {t.start}: found {t.text[:20]!r}" + (f", wanted {wanted}" if wanted else ""))
