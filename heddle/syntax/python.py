"""Grammar of Python 3.12 for texts that nest deeper than the interpreter's own parser follows.

The interpreter gives up at fixed depths of brackets, blocks, formatted strings and trees.
This parser has no such depth: its recursion grows with the text alone, see ``syntax.deep``.
"""

from __future__ import annotations

import ast
import inspect
import re

from heddle.syntax.base import Broken, Cursor, Def, Tok

KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_SPACE = re.compile(r"(?:[ \t\f]|\\(?:\r\n|\n|\r)|\#[^\r\n]*)+")
_LINE = re.compile(r"\r\n|\n|\r")
_MARGIN = re.compile(r"[ \t\f]*")
_NAME = re.compile(r"[^\W\d]\w*")
_STR = re.compile(r"(?i:(?P<f>f|fr|rf)|br?|rb|r|u)?(?P<q>\"\"\"|'''|\"|')")
_ENDS = {q: re.compile(p, re.S) for q, p in {'"""': r'(?:\\.|(?!""").)*"""', "'''": r"(?:\\.|(?!''').)*'''", '"': r'(?:\\(?:\r\n|.)|[^"\\\r\n])*"', "'": r"(?:\\(?:\r\n|.)|[^'\\\r\n])*'"}.items()}
_NUM = re.compile(
    r"0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+"
    r"|(?:[0-9](?:_?[0-9])*\.(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?"
    r"|[0-9](?:_?[0-9])*(?:[eE][+-]?[0-9](?:_?[0-9])*[jJ]?|[jJ])|0(?:_?0)*(?![0-9_])|[1-9](?:_?[0-9])*"
)
_AFTER_NUM = re.compile(r"(?:and|else|for|if|in|is|not|or)\b")
_OP = re.compile(r"\*\*=|//=|>>=|<<=|\.\.\.|->|:=|[!=<>+\-*/%&|^@]=|\*\*|//|>>|<<|[-+*/%@&|^~<>()\[\]{},:.;=]")
_NAMED = re.compile(r"N\{[^}\r\n]*\}")
_CLOSER = {"(": ")", "[": "]", "{": "}"}
_AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
_COMPARE = frozenset("== != < > <= >= in is not".split())
_BINARY = {"or": 1, "and": 2, **dict.fromkeys(_COMPARE, 4), "|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "//": 10, "%": 10, "@": 10}
#: What an expression may stand for: a bare name, the target of any assignment, of "=", of del.
_BARE, _SINGLE, _TARGET, _DEL = 1, 2, 4, 8
_BASE = re.compile(r"(?:.*\.)?\s*([^\W\d]\w*)\s*(?:\[.*\])?", re.S)


def tokens(text: str) -> list[Tok]:
    """Tokens with line ends and margins; a formatted string is taken apart into its fields."""
    if "\0" in text:
        raise Broken("null character")
    out: list[Tok] = []
    margins = [(0, 0)]
    #: Open brackets; "f" with quote and rawness for a field, "s" for the text of a formatted string.
    stack: list[tuple[str, str, bool]] = []
    i, n = 0, len(text)
    fresh = True  # at the begin of a logical line

    def put(kind: str, what: str, end: int) -> int:
        out.append(Tok(kind, what, i, end))
        return end

    while True:
        if stack and stack[-1][0] in ("s", "d"):  # literal part of a formatted string, or its format after a colon
            part, quote, raw = stack[-1]
            begin = i
            while True:
                if i >= n or (len(quote) == 1 and text[i] in "\r\n"):
                    raise Broken(f"at {i}: string")
                if part == "s" and text.startswith(quote, i):
                    break
                if part == "d" and text[i] in "{}":
                    break
                if part == "d" and text.startswith(quote, i):
                    raise Broken(f"at {i}: format")
                if text[i] == "\\" and i + 1 < n:
                    named = None if raw else _NAMED.match(text, i + 1)
                    i = named.end() if named else i + 1 if text[i + 1] in "{}" else i + (3 if text.startswith("\r\n", i + 1) else 2)
                elif text[i] in "{}":
                    if text.startswith(text[i] * 2, i):
                        i += 2
                    elif text[i] == "{":
                        break
                    else:
                        raise Broken(f"at {i}: single brace")
                else:
                    i += 1
            literal = text[begin:i]
            if "\\" in literal and not raw:
                odd = (len(literal) - len(literal.rstrip("\\"))) % 2  # a backslash before a brace stands for itself
                _value(quote + literal + "\\" * odd + quote, begin)
            if part == "s" and text.startswith(quote, i):
                stack.pop()
                i = put("fend", quote, i + len(quote))
            elif text[i] == "}":
                stack.pop()  # the format
                stack.pop()  # the field
                i = put("fop", "f}", i + 1)
            else:
                stack.append(("f", quote, raw))
                i = put("fop", "f{", i + 1)
            continue
        if fresh and not stack:
            m = _MARGIN.match(text, i)
            margin = m.group().rpartition("\f")[2]
            at = m.end()
            if at >= n:
                i = at
                break
            if text[at] == "#" or _LINE.match(text, at):
                end = _LINE.search(text, at)
                if end is None:
                    i = n
                    break
                i = end.end()
                continue
            if not text.startswith("\\", at):
                i, fresh = at, False
                now = (len(margin.expandtabs(8)), len(margin.replace("\t", " ")))
                if now[0] > margins[-1][0]:
                    if now[1] <= margins[-1][1]:
                        raise Broken(f"at {i}: tabs")
                    margins.append(now)
                    put("indent", "", i)
                while now[0] < margins[-1][0]:
                    margins.pop()
                    put("dedent", "", i)
                if now != margins[-1]:
                    raise Broken(f"at {i}: margin")
            else:
                fresh = False
        if m := _SPACE.match(text, i):
            i = m.end()
        if i >= n:
            break
        if m := _LINE.match(text, i):
            if not stack:
                if out and out[-1].kind not in ("nl", "indent", "dedent"):
                    put("nl", "", m.end())
                fresh = True
            i = m.end()
            continue
        c = text[i]
        field = stack[-1] if stack and stack[-1][0] == "f" else None
        if field and c == "}":
            stack.pop()
            i = put("fop", "f}", i + 1)
        elif field and c == ":":
            stack.append(("d", *field[1:]))
            i = put("fop", "f:", i + 1)
        elif field and c == "!" and not text.startswith("!=", i):
            i = put("fop", "f!", i + 1)
        elif m := _STR.match(text, i):
            if m["f"]:
                stack.append(("s", m["q"], "r" in m["f"].lower()))
                i = put("fstart", m.group(), m.end())
            else:
                end = _ENDS[m["q"]].match(text, m.end())
                if end is None:
                    raise Broken(f"at {i}: string")
                word = text[i : end.end()]
                if "\\" in word or "b" in m.group().lower():
                    _value(word, i)
                i = put("bytes" if "b" in m.group().lower() else "str", word, end.end())
        elif m := _NAME.match(text, i):
            if not m.group().isidentifier():
                raise Broken(f"at {i}: name")
            i = put("name", m.group(), m.end())
        elif (c in "0123456789" or c == ".") and (m := _NUM.match(text, i)):
            if (text[m.end() : m.end() + 1].isidentifier() or text[m.end() : m.end() + 1].isdigit()) and not _AFTER_NUM.match(text, m.end()):
                raise Broken(f"at {i}: number")
            i = put("num", m.group(), m.end())
        elif m := _OP.match(text, i):
            op = m.group()
            if op in _CLOSER:
                stack.append((op, "", False))
            elif op in (")", "]", "}"):
                if not stack or _CLOSER.get(stack[-1][0]) != op:
                    raise Broken(f"at {i}: {op} matches nothing")
                stack.pop()
            i = put("op", op, m.end())
        else:
            raise Broken(f"at {i}: no token")
    if stack:
        raise Broken(f"at {n}: {stack[-1][0]} is not closed")
    if text.endswith("\\") and not fresh:
        raise Broken(f"at {n}: nothing to go on with")
    if out and out[-1].kind not in ("nl", "indent", "dedent"):
        put("nl", "", i)
    for _ in margins[1:]:
        put("dedent", "", i)
    put("end", "", i)
    return out


def _value(literal: str, at: int) -> None:
    try:
        ast.parse(literal)
    except (SyntaxError, ValueError) as e:
        raise Broken(f"at {at}: {e}") from None


class Parser(Cursor):
    """Recursive descent; expressions give what they may be the target of."""

    def __init__(self, text: str):
        super().__init__(tokens(text))
        self.text = text
        self.defs: list[Def] = []
        self.owner, self.bases = "", ()
        self.hidden = 0  # inside functions and cases nothing is recorded

    def module(self) -> None:
        while self.tok.kind != "end":
            self.statement()

    def last_end(self) -> int:
        k = self.i - 1
        while self.toks[k].kind in ("nl", "indent", "dedent"):
            k -= 1
        return self.toks[k].end

    def name(self) -> str:
        if self.tok.kind != "name" or self.tok.text in KEYWORDS:
            self.fail("name")
        return self.next().text

    # -- statements

    def block(self) -> tuple[int, str | None]:
        """Begin of the first statement and the documentation it is."""
        self.need(":")
        if self.tok.kind != "nl":
            k = self.i
            self.simple_line()
            return self.toks[k].start, self.doc(k)
        self.next()
        self.need_kind("indent")
        k = self.i
        begin = self.statement()
        doc = self.doc(k)
        while self.tok.kind != "dedent":
            if self.tok.kind == "end":
                self.fail()
            self.statement()
        self.next()
        return begin, doc

    def doc(self, k: int) -> str | None:
        """The text of the statement at token k, where it is one of strings alone."""
        strings = []
        while self.toks[k].kind == "str" or self.toks[k].text in ("(", ")"):
            if self.toks[k].kind == "str":
                strings.append(ast.literal_eval(self.toks[k].text))
            k += 1
        if not strings or not (self.toks[k].kind == "nl" or self.toks[k].text == ";") or self.toks[k - 1].text == "(":
            return None
        return inspect.cleandoc("".join(strings))

    def statement(self) -> int:
        t = self.tok
        word = t.text if t.kind == "name" else ""
        if t.kind in ("indent", "dedent"):
            self.fail("statement")
        if t.kind == "op" and t.text == "@":
            while self.eat("@"):
                self.named()
                self.need_kind("nl")
            begin = self.tok.start
            if self.at("async"):
                self.next()
                self.function(t.start, begin)
            elif self.at("class"):
                self.class_(begin)
            else:
                self.function(t.start, begin)
            return begin
        if word == "async":
            self.next()
            if self.at("def"):
                self.function(t.start, t.start)
            elif self.at("for"):
                self.for_()
            else:
                self.with_()
        elif word == "def":
            self.function(t.start, t.start)
        elif word == "class":
            self.class_(t.start)
        elif word == "if":
            self.next()
            self.named()
            self.block()
            while self.eat("elif"):
                self.named()
                self.block()
            self.otherwise()
        elif word == "while":
            self.next()
            self.named()
            self.block()
            self.otherwise()
        elif word == "for":
            self.for_()
        elif word == "with":
            self.with_()
        elif word == "try":
            self.try_()
        elif not (word == "match" and self.match_()):
            self.simple_line()
        return t.start

    def otherwise(self) -> None:
        if self.eat("else"):
            self.block()

    def function(self, first: int, start: int) -> None:
        self.need("def")
        name = self.name()
        if self.at("["):
            self.type_params()
        self.need("(")
        self.params(")", True)
        self.need(")")
        if self.eat("->"):
            self.expression()
        place = len(self.defs)
        self.hidden += 1
        head, doc = self.block()
        self.hidden -= 1
        if not self.hidden:
            self.defs.insert(place, Def(self.owner + name, first, start, head, self.last_end(), doc, self.bases))

    def class_(self, start: int) -> None:
        self.need("class")
        name = self.name()
        if self.at("["):
            self.type_params()
        bases: list[str] = []
        if self.eat("("):
            self.arguments(bases)
            self.need(")")
        before = self.owner, self.bases
        self.owner, self.bases = f"{self.owner}{name}.", tuple(bases)
        place, whole = len(self.defs), self.owner
        head, _ = self.block()
        self.owner, self.bases = before
        if not self.hidden:
            self.defs.insert(place, Def(whole, start, start, head, self.last_end(), None, tuple(bases)))

    def type_params(self) -> None:
        self.need("[")
        while True:
            if self.eat("*", "**"):
                self.name()
            else:
                self.name()
                if self.eat(":"):
                    self.expression()
            if not self.eat(",") or self.at("]"):
                break
        self.need("]")

    def params(self, closer: str, typed: bool) -> None:
        default = star = slash = False
        n = 0
        while not self.at(closer):
            if self.eat("**"):
                self.name()
                if typed and self.eat(":"):
                    self.expression()
                self.eat(",")
                return
            if self.at("/"):
                if star or slash or not n:
                    self.fail("parameter")
                self.next()
                slash = True
            elif self.eat("*"):
                if star:
                    self.fail("one star")
                star = True
                if self.at(","):
                    if self.ahead().text in (closer, "**") or self.ahead().kind != "name":
                        self.fail("named parameter")
                else:
                    self.name()
                    if typed and self.eat(":"):
                        self.star_expression()
            else:
                self.name()
                if typed and self.eat(":"):
                    self.expression()
                if self.eat("="):
                    self.expression()
                    default = True
                elif default and not star:
                    self.fail("default")
            n += 1
            if not self.eat(","):
                return

    def for_(self) -> None:
        self.need("for")
        self.targets()
        self.need("in")
        self.star_expressions()
        self.block()
        self.otherwise()

    def targets(self) -> None:
        """Targets up to the word "in"."""
        while True:
            self.eat("*")
            if not self.binary(5) & _TARGET:
                self.fail("target")
            if not self.eat(",") or self.at("in"):
                return

    def with_(self) -> None:
        self.need("with")
        mark = self.i
        if self.eat("("):
            try:
                self.items(")")
                self.need(")")
                if self.at(":"):
                    self.block_after_items()
                    return
            except _Stop as e:
                raise e.reason from None
            except Broken:
                pass
            self.i = mark
        self.items(":")
        self.block()

    def block_after_items(self) -> None:
        try:
            self.block()
        except Broken as e:
            raise _Stop(e) from None

    def items(self, closer: str) -> None:
        while True:
            self.expression()
            if self.eat("as"):
                if self.eat("*"):
                    self.fail("target")
                if not self.binary(5) & _TARGET:
                    self.fail("target")
            if not self.eat(",") or (closer == ")" and self.at(")")):
                return

    def try_(self) -> None:
        self.need("try")
        self.block()
        if self.eat("finally"):
            self.block()
            return
        if not self.at("except"):
            self.fail("except")
        star = self.ahead().text == "*"
        while self.eat("except"):
            if self.eat("*") != star:
                self.fail("except")
            if star or not self.at(":"):
                self.expression()
                if self.eat("as"):
                    self.name()
            self.block()
        self.otherwise()
        if self.eat("finally"):
            self.block()

    def match_(self) -> bool:
        """Whether a match statement begins here; the word may also be a name."""
        mark = self.i
        try:
            self.next()
            self.elements(":")
            self.need(":")
            self.need_kind("nl")
            self.need_kind("indent")
            if self.tok.text != "case":
                self.fail("case")
        except Broken:
            self.i = mark
            return False
        self.hidden += 1
        while self.tok.kind != "dedent":
            if self.tok.kind != "name" or self.tok.text != "case":
                self.fail("case")
            self.next()
            self.patterns(":", "if")
            if self.eat("if"):
                self.named()
            self.block()
        self.hidden -= 1
        self.next()
        return True

    def simple_line(self) -> None:
        while True:
            self.simple()
            if not self.eat(";") or self.tok.kind == "nl":
                break
        self.need_kind("nl")

    def ended(self) -> bool:
        return self.tok.kind == "nl" or self.at(";")

    def simple(self) -> None:
        t = self.tok
        word = t.text if t.kind == "name" else ""
        if word in ("pass", "break", "continue"):
            self.next()
        elif word == "return":
            self.next()
            if not self.ended():
                self.star_expressions()
        elif word == "raise":
            self.next()
            if not self.ended():
                self.expression()
                if self.eat("from"):
                    self.expression()
        elif word in ("global", "nonlocal"):
            self.next()
            self.name()
            while self.eat(","):
                self.name()
        elif word == "del":
            self.next()
            while True:
                if not self.binary(5) & _DEL:
                    self.fail("target")
                if not self.eat(",") or self.ended():
                    break
        elif word == "assert":
            self.next()
            self.expression()
            if self.eat(","):
                self.expression()
        elif word == "import":
            self.next()
            while True:
                self.dotted()
                if self.eat("as"):
                    self.name()
                if not self.eat(","):
                    break
        elif word == "from":
            self.from_()
        elif not (word == "type" and self.type_alias()):
            self.assignment()

    def dotted(self) -> None:
        self.name()
        while self.eat("."):
            self.name()

    def from_(self) -> None:
        self.next()
        dots = 0
        while self.eat(".", "..."):
            dots += 1
        if not dots or not self.at("import"):
            self.dotted()
        self.need("import")
        if self.eat("*"):
            return
        closed = self.eat("(")
        while True:
            self.name()
            if self.eat("as"):
                self.name()
            if not self.eat(",") or (closed and self.at(")")):
                break
        if closed:
            self.need(")")

    def type_alias(self) -> bool:
        t = self.ahead()
        if t.kind != "name" or t.text in KEYWORDS or self.ahead(2).text not in ("[", "="):
            return False
        self.next()
        self.next()
        if self.at("["):
            self.type_params()
        self.need("=")
        self.expression()
        return True

    def assignment(self) -> None:
        if self.at("yield"):
            self.yield_()
            return
        kind = self.star_expressions()
        if self.eat(":"):
            if not kind & _SINGLE:
                self.fail("target")
            self.expression()
            if self.eat("="):
                self.right()
        elif self.tok.kind == "op" and self.tok.text in _AUGMENTED:
            if not kind & _SINGLE:
                self.fail("target")
            self.next()
            self.right()
        else:
            while self.at("="):
                if not kind & _TARGET:
                    self.fail("target")
                self.next()
                kind = self.right()

    def right(self) -> int:
        if self.at("yield"):
            self.yield_()
            return 0
        return self.star_expressions()

    def yield_(self) -> None:
        self.need("yield")
        if self.eat("from"):
            self.expression()
        elif not self.ended() and not self.at(")", "=") and self.tok.kind != "fop":
            self.star_expressions()

    # -- patterns

    def patterns(self, *enders: str) -> None:
        star = self.sequence_item()
        if not self.at(","):
            if star:
                self.fail("pattern")
            return
        while self.eat(","):
            if self.at(*enders):
                return
            self.sequence_item()

    def sequence_item(self) -> bool:
        if self.eat("*"):
            self.name()
            return True
        self.pattern()
        return False

    def pattern(self) -> None:
        self.closed_pattern()
        while self.eat("|"):
            self.closed_pattern()
        if self.eat("as"):
            if self.name() == "_":
                self.fail("name")

    def closed_pattern(self) -> None:
        t = self.tok
        if t.kind in ("num", "str", "bytes", "fstart") or self.at("-", "None", "True", "False"):
            self.literal_pattern()
        elif self.eat("("):
            if self.eat(")"):
                return
            star = self.sequence_item()
            if star and not self.at(","):
                self.fail(",")
            while self.eat(",") and not self.at(")"):
                self.sequence_item()
            self.need(")")
        elif self.eat("["):
            while not self.at("]"):
                self.sequence_item()
                if not self.eat(","):
                    break
            self.need("]")
        elif self.eat("{"):
            while not self.at("}"):
                if self.eat("**"):
                    self.name()
                    self.eat(",")
                    break
                if self.tok.kind == "name" and self.tok.text not in KEYWORDS:
                    if self.ahead().text != ".":
                        self.fail("key")
                    self.dotted()
                else:
                    self.literal_pattern()
                self.need(":")
                self.pattern()
                if not self.eat(","):
                    break
            self.need("}")
        else:
            self.dotted()
            if self.eat("("):
                named = False
                while not self.at(")"):
                    if self.tok.kind == "name" and self.ahead().text == "=":
                        self.name()
                        self.next()
                        named = True
                    elif named:
                        self.fail("=")
                    self.pattern()
                    if not self.eat(","):
                        break
                self.need(")")

    def literal_pattern(self) -> None:
        if self.tok.kind in ("str", "bytes", "fstart"):
            self.strings()
        elif not self.eat("None", "True", "False"):
            self.eat("-")
            self.need_kind("num")
            if self.at("+", "-"):
                if self.toks[self.i - 1].text[-1] in "jJ" or self.ahead().text[-1:] not in ("j", "J"):
                    self.fail("imaginary")
                self.next()
                self.need_kind("num")

    # -- expressions

    def star_expressions(self) -> int:
        kind = self.star_expression()
        if not self.at(","):
            return kind
        kind &= ~(_SINGLE | _BARE)
        while self.eat(","):
            t = self.tok
            if t.kind in ("nl", "end", "fop") or self.at(")", "]", "}", "=", ";", ":") or (t.kind == "op" and t.text in _AUGMENTED):
                break
            kind &= self.star_expression()
        return kind

    def star_expression(self) -> int:
        if self.eat("*"):
            return self.binary(5) & _TARGET
        return self.expression()

    def star_named(self) -> int:
        if self.eat("*"):
            return self.binary(5) & _TARGET
        return self.named()

    def named(self) -> int:
        kind = self.expression()
        if self.at(":="):
            if not kind & _BARE:
                self.fail("name")
            self.next()
            self.expression()
            return 0
        return kind

    def expression(self) -> int:
        if self.at("lambda"):
            self.next()
            self.params(":", False)
            self.need(":")
            self.expression()
            return 0
        kind = self.binary(1)
        if self.at("if"):
            self.next()
            self.binary(1)
            self.need("else")
            self.expression()
            return 0
        return kind

    def binary(self, least: int) -> int:
        if least <= 3 and self.at("not"):
            self.next()
            self.binary(3)
            kind = 0
        else:
            kind = self.unary()
        while True:
            t = self.tok
            p = _BINARY.get(t.text, 0) if t.kind in ("op", "name") else 0
            if p < least or p == 0:
                return kind
            if t.text == "not":
                if self.ahead().text != "in":
                    return kind
                self.next()
            self.next()
            if t.text == "is":
                self.eat("not")
            self.binary(3 if p == 2 else p + 1)
            kind = 0

    def unary(self) -> int:
        if self.eat("+", "-", "~"):
            self.unary()
            return 0
        awaited = self.eat("await")
        kind = self.primary()
        if self.eat("**"):
            self.unary()
            return 0
        return 0 if awaited else kind

    def primary(self) -> int:
        kind = self.atom()
        while True:
            if self.eat("."):
                self.name()
                kind = _SINGLE | _TARGET | _DEL
            elif self.eat("("):
                self.arguments([])
                self.need(")")
                kind = 0
            elif self.eat("["):
                self.slices()
                self.need("]")
                kind = _SINGLE | _TARGET | _DEL
            else:
                return kind

    def slices(self) -> None:
        while True:
            if self.eat("*"):
                self.expression()
            else:
                if not self.at(":"):
                    self.named()
                for _ in range(2):
                    if self.eat(":") and not self.at(":", ",", "]"):
                        self.expression()
            if not self.eat(",") or self.at("]"):
                return

    def arguments(self, bases: list[str]) -> None:
        keyword = double = False
        n = 0
        while not self.at(")"):
            begin = self.tok.start
            if self.eat("**"):
                self.expression()
                double = True
            elif self.at("*"):
                if double:
                    self.fail("keyword")
                self.next()
                self.expression()
            elif self.tok.kind == "name" and self.ahead().text == "=" and self.ahead().kind == "op":
                self.name()
                self.next()
                self.expression()
                keyword = True
            else:
                if keyword or double:
                    self.fail("keyword")
                kind = self.named()
                if self.at("for", "async"):
                    self.clauses()
                    if n or not self.at(")"):
                        self.fail(")")
                    return
                if kind & _SINGLE and (m := _BASE.fullmatch(self.text[begin : self.toks[self.i - 1].end])):
                    bases.append(m[1])
            n += 1
            if not self.eat(","):
                return

    def clauses(self) -> None:
        while self.at("for", "async"):
            self.eat("async")
            self.need("for")
            self.targets()
            self.need("in")
            self.binary(1)
            while self.eat("if"):
                self.binary(1)

    def elements(self, closer: str) -> tuple[int, bool]:
        """Elements up to the closer; what they are together, and whether it is one without a comma."""
        star = self.at("*")
        kind = self.star_named()
        if self.at("for", "async") and closer != ":":
            if star:
                self.fail(closer)
            self.clauses()
            return 0, True
        if not self.at(","):
            if star and closer in (")", ":"):
                self.fail(",")
            return kind, True
        while self.eat(","):
            if self.at(closer):
                break
            kind &= self.star_named()
        return kind, False

    def atom(self) -> int:
        t = self.tok
        if t.kind == "name":
            if t.text in KEYWORDS:
                if t.text not in ("True", "False", "None"):
                    self.fail("operand")
                self.next()
                return 0
            self.next()
            return _BARE | _SINGLE | _TARGET | _DEL
        if t.kind == "num":
            self.next()
            return 0
        if t.kind in ("str", "bytes", "fstart"):
            self.strings()
            return 0
        if t.kind != "op":
            self.fail("operand")
        if t.text == "(":
            self.next()
            if self.eat(")"):
                return _TARGET | _DEL
            if self.at("yield"):
                self.yield_()
                kind = 0
            else:
                kind, alone = self.elements(")")
                kind &= ~_BARE if alone else _TARGET | _DEL
            self.need(")")
            return kind
        if t.text == "[":
            self.next()
            if self.eat("]"):
                return _TARGET | _DEL
            kind = self.elements("]")[0]
            self.need("]")
            return kind & (_TARGET | _DEL)
        if t.text == "{":
            self.next()
            if not self.at("}"):
                self.braces()
            self.need("}")
            return 0
        if t.text == "...":
            self.next()
            return 0
        self.fail("operand")

    def braces(self) -> None:
        pairs = self.pair()
        if self.at("for", "async"):
            if self.toks[self.i - 1].text == ",":
                self.fail("}")
            if pairs == "unpacked":
                self.fail("}")
            self.clauses()
            return
        while self.eat(","):
            if self.at("}"):
                return
            if (self.pair() in ("pair", "dict")) != (pairs in ("pair", "dict")):
                self.fail("element")

    def pair(self) -> str:
        """An element of a dictionary or set; "unpacked" where it is one of a set with a star."""
        if self.eat("**"):
            self.binary(5)
            if self.at("for", "async"):
                self.fail("}")
            return "dict"
        if self.eat("*"):
            self.binary(5)
            return "unpacked"
        walrus = self.ahead().text == ":="
        self.named()
        if self.at(":") and not walrus:
            self.next()
            self.expression()
            return "pair"
        return "element"

    def strings(self) -> None:
        kinds = set()
        while self.tok.kind in ("str", "bytes", "fstart"):
            t = self.next()
            kinds.add(t.kind == "bytes")
            if t.kind == "fstart":
                while self.tok.kind != "fend":
                    self.field()
                self.next()
        if len(kinds) > 1:
            self.fail("one kind of strings")

    def mark_of_field(self, text: str) -> bool:
        if self.tok.kind == "fop" and self.tok.text == text:
            self.next()
            return True
        return False

    def field(self) -> None:
        if not self.mark_of_field("f{"):
            self.fail("field")
        if self.at("yield"):
            self.yield_()
        else:
            self.star_expressions()
        self.eat("=")
        if self.mark_of_field("f!"):
            if self.tok.kind != "name" or self.tok.text not in ("s", "r", "a"):
                self.fail("conversion")
            self.next()
        if self.mark_of_field("f:"):
            while not (self.tok.kind == "fop" and self.tok.text == "f}"):
                self.field()
        if not self.mark_of_field("f}"):
            self.fail("}")


class _Stop(Exception):
    """Broken behind the point where another reading of the text was possible."""

    def __init__(self, reason: Broken):
        self.reason = reason


def parse(text: str) -> list[Def]:
    p = Parser(text)
    p.module()
    return p.defs
