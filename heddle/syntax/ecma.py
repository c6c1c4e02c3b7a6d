"""Local grammar of ECMAScript modules and, with types, of TypeScript."""

from __future__ import annotations

import re

from heddle.syntax.base import Broken, Def, Tok

RESERVED = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield await".split())
_SPACE = re.compile(r"(?:[ \t\v\f ﻿  -   　\r\n  ]+|//[^\n\r  ]*|/\*.*?\*/)+", re.S)
_LINE = re.compile(r"[\r\n  ]")
_NAME = re.compile(r"#?(?:[^\W\d]|[$_]|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))(?:\w|[$‌‍]|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))*")
_NUM = re.compile(r"0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:[1-9](?:_?[0-9])*|0)n(?![\w])|(?:(?:0|[1-9](?:_?[0-9])*)(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?")
_STR = re.compile(r"'(?:\\(?:\r\n|[\s\S])|[^'\\\n\r])*'|\"(?:\\(?:\r\n|[\s\S])|[^\"\\\n\r])*\"")
_BAD_ESCAPE = re.compile(r"\\(?:\\|x(?![0-9a-fA-F]{2})(?P<x>)|u(?!\{[0-9a-fA-F]+\}|[0-9a-fA-F]{4})(?P<u>)|[1-9](?P<o>)|.)", re.S)
_OP = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@]")
_REGEX = re.compile(r"/(?:\\[^\n\r]|\[(?:\\[^\n\r]|[^\]\\\n\r])*\]|[^/\\\[\n\r])+/[a-zA-Z]*")
_TEMPLATE = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$])*")
_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_ASSIGN = frozenset(["=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="])
_MODIFIERS = frozenset(["public", "private", "protected", "static", "readonly", "abstract", "override", "declare", "async", "accessor"])


class Parser:
    """Reads tokens on demand, so that the grammar tells regular expressions from divisions."""

    def __init__(self, text: str, typed: bool):
        self.text, self.typed = text, typed
        self.memo: dict[int, Tok] = {}
        self.tried: dict[tuple, tuple[Tok, int, list[Def]] | None] = {}
        self.no_in = False
        self.defs: list[Def] = []
        self.owner, self.bases = "", ()
        self.begin = (0, 0)  # of the current statement: with and without what may stand before it
        self.arrow_head: int | None = None  # end of the head of an arrow function that was the last expression
        self.functions = 0
        self.ambient = False
        start = text.find("\n") if text.startswith("#!") else 0
        self.tok = self.scan(max(start, 0))
        self.last_end = 0

    # -- tokens

    def scan(self, at: int) -> Tok:
        if (t := self.memo.get(at)) is not None:
            return t
        text, i, nl = self.text, at, False
        if m := _SPACE.match(text, i):
            nl = _LINE.search(m.group()) is not None
            i = m.end()
        if i >= len(text):
            t = Tok("end", "", i, i, True)
        elif text.startswith("/*", i):
            raise Broken(f"at {i}: comment")
        elif m := _NAME.match(text, i):
            t = Tok("name", m.group(), i, m.end(), nl)
        elif (text[i].isdigit() or (text[i] == "." and text[i + 1 : i + 2].isdigit())) and (m := _NUM.match(text, i)):
            if m.end() < len(text) and (text[m.end()].isalnum() or text[m.end()] in "_$"):
                raise Broken(f"at {i}: number")
            t = Tok("num", m.group(), i, m.end(), nl)
        elif text[i] in "'\"":
            m = _STR.match(text, i)
            if not m:
                raise Broken(f"at {i}: string")
            if "\\" in m.group():
                for e in _BAD_ESCAPE.finditer(m.group()):
                    if e.lastgroup:
                        raise Broken(f"at {i}: escape")
            t = Tok("str", m.group(), i, m.end(), nl)
        elif text[i] == "`":
            t = Tok("tmpl", "`", i, i + 1, nl)
        elif m := _OP.match(text, i):
            t = Tok("op", m.group(), i, m.end(), nl)
        else:
            raise Broken(f"at {i}: no token")
        self.memo[at] = t
        return t

    def fail(self, wanted: str = "") -> None:
        raise Broken(f"at {self.tok.start}: found {self.tok.text[:20]!r}" + (f", wanted {wanted}" if wanted else ""))

    def next(self) -> Tok:
        t = self.tok
        self.last_end = t.end
        self.tok = self.scan(t.end)
        return t

    def ahead(self) -> Tok:
        return self.scan(self.tok.end)

    def mark(self) -> tuple:
        return self.tok, self.last_end, self.no_in, self.functions, self.ambient, self.owner, self.bases, self.begin, len(self.defs)

    def back(self, m: tuple) -> None:
        self.tok, self.last_end, self.no_in, self.functions, self.ambient, self.owner, self.bases, self.begin, n = m
        del self.defs[n:]

    def define(self, name: str, first: int, start: int, head: int) -> None:
        if not self.functions:
            self.defs.append(Def(f"{self.owner}.{name}" if self.owner else name, first, start, head, self.last_end, None, self.bases))

    def define_type(self, name: str, start: int, head: int) -> None:
        if not self.functions:
            self.defs.append(Def(name + ".", start, start, head, self.last_end))

    def at(self, *texts: str) -> bool:
        return self.tok.text in texts and self.tok.kind in ("op", "name")

    def eat(self, *texts: str) -> bool:
        if self.at(*texts):
            self.next()
            return True
        return False

    def need(self, *texts: str) -> None:
        if not self.eat(*texts):
            self.fail("/".join(texts))

    def split(self, head: str) -> bool:
        """Take the head of an operator, as of >> in types."""
        t = self.tok
        if t.kind == "op" and t.text.startswith(head):
            self.last_end = t.start + len(head)
            self.tok = self.scan(self.last_end) if t.text == head else Tok("op", t.text[len(head) :], t.start + len(head), t.end)
            return True
        return False

    def attempt(self, what) -> bool:
        """Whether a reading holds; the state stays as before if not.  What methods gave at a place
        is kept, so that readings inside others are not tried again and again."""
        m = self.mark()
        key = (what.__name__, self.tok.start, self.tok.text, self.no_in, self.functions > 0, self.ambient, self.owner) if hasattr(what, "__self__") else None
        if key in self.tried:
            if (got := self.tried[key]) is None:
                return False
            self.tok, self.last_end, more = got
            self.defs += more
            return True
        got = None
        try:
            what()
            got = self.tok, self.last_end, self.defs[m[-1] :]
        except Broken:
            self.back(m)
        if key is not None:
            self.tried[key] = got
        return got is not None

    def is_name(self) -> bool:
        t = self.tok
        return t.kind == "name" and t.text not in RESERVED and not t.text.startswith("#")

    def binding_name(self) -> None:
        if not self.is_name() and not self.at("await", "yield"):
            self.fail("name")
        self.next()

    def semicolon(self) -> None:
        if not self.eat(";") and not self.at("}") and not self.tok.nl and self.tok.kind != "end":
            self.fail(";")

    # -- statements

    def module(self) -> None:
        while self.tok.kind != "end":
            self.statement(True)

    def block(self) -> None:
        self.need("{")
        while not self.at("}"):
            if self.tok.kind == "end":
                self.fail("}")
            self.statement(False)
        self.need("}")

    def statement(self, top: bool = False, single: bool = False, inner: bool = False) -> None:
        t = self.tok
        if not inner:
            self.begin = (t.start, t.start)
        word = t.text if t.kind == "name" else ""
        if t.kind == "op" and t.text == "{":
            self.block()
        elif t.kind == "op" and t.text == ";":
            self.next()
        elif word == "const" and self.typed and self.ahead().text == "enum":
            self.next()
            self.enum()
        elif word in ("var", "const") or (word == "let" and self.let_ahead()):
            if single and word != "var":
                self.fail("statement")
            self.next()
            self.declarations(word, top=top)
            self.semicolon()
        elif word == "function" or (word == "async" and self.ahead().text == "function" and not self.ahead().nl):
            self.eat("async")
            self.function(declared=True)
        elif word == "class" or (t.kind == "op" and t.text == "@"):
            self.decorators()
            self.begin = (self.begin[0], self.tok.start)
            if self.at("export") and top:
                self.export()
                return
            if self.typed and self.at("abstract"):
                self.next()
            self.class_(declared=True)
        elif word == "if":
            self.next()
            self.paren()
            self.statement(single=True)
            if self.eat("else"):
                self.statement(single=True)
        elif word == "for":
            self.for_()
        elif word == "while":
            self.next()
            self.paren()
            self.statement(single=True)
        elif word == "do":
            self.next()
            self.statement(single=True)
            self.need("while")
            self.paren()
            self.eat(";")
        elif word in ("continue", "break"):
            self.next()
            if self.is_name() and not self.tok.nl:
                self.next()
            self.semicolon()
        elif word == "return":
            if not self.functions:
                self.fail("statement")
            self.next()
            if not self.at(";", "}") and not self.tok.nl and self.tok.kind != "end":
                self.expression()
            self.semicolon()
        elif word == "throw":
            self.next()
            if self.tok.nl:
                self.fail("expression")
            self.expression()
            self.semicolon()
        elif word == "switch":
            self.next()
            self.paren()
            self.need("{")
            default = False
            while not self.at("}"):
                if self.eat("default"):
                    if default:
                        self.fail("case")
                    default = True
                else:
                    self.need("case")
                    self.expression()
                self.need(":")
                while not self.at("case", "default", "}"):
                    if self.tok.kind == "end":
                        self.fail("}")
                    self.statement()
            self.need("}")
        elif word == "try":
            self.next()
            self.block()
            handled = False
            if self.eat("catch"):
                handled = True
                if self.eat("("):
                    self.binding()
                    if self.typed and self.eat(":"):
                        self.type()
                    self.need(")")
                self.block()
            if self.eat("finally"):
                handled = True
                self.block()
            if not handled:
                self.fail("catch")
        elif word == "debugger":
            self.next()
            self.semicolon()
        elif word == "import" and self.ahead().text not in ("(", "."):
            if not top:
                self.fail("statement")
            self.import_()
        elif word == "export":
            if not top:
                self.fail("statement")
            self.export()
        elif self.typed and self.type_statement(top):
            pass
        elif t.kind == "name" and t.text not in RESERVED and self.ahead().text == ":" and self.ahead().kind == "op":
            self.next()
            self.next()
            self.statement(single=single)
        else:
            if word == "with" or word == "enum":
                self.fail("statement")
            self.expression()
            self.semicolon()

    def let_ahead(self) -> bool:
        n = self.ahead()
        return (n.kind == "name" and n.text not in ("in", "instanceof", "of")) or n.text in ("[", "{") or n.text == "of"

    def paren(self) -> None:
        self.need("(")
        self.inside(self.expression)
        self.need(")")

    def inside(self, what) -> None:
        no_in, self.no_in = self.no_in, False
        what()
        self.no_in = no_in

    def declarations(self, word: str, loop: bool = False, top: bool = False) -> None:
        begin = self.begin
        while True:
            pattern = self.at("{", "[")
            name = self.tok.text
            self.binding()
            if self.typed:
                self.eat("!")
                if self.eat(":"):
                    self.type()
            if self.eat("="):
                self.arrow_head = None
                self.assignment()
                if top and word == "const" and not pattern and self.arrow_head is not None:
                    self.define(name, *begin, self.arrow_head)
            elif not loop and (pattern or word == "const") and not self.ambient:
                self.fail("=")
            if not self.eat(","):
                return

    def binding(self) -> None:
        if self.eat("{"):
            while not self.at("}"):
                if self.eat("..."):
                    self.binding()
                else:
                    plain = self.is_name()
                    self.property_name()
                    if self.eat(":"):
                        self.binding_element()
                    else:
                        if not plain:
                            self.fail(":")
                        if self.eat("="):
                            self.inside(self.assignment)
                if not self.at("}"):
                    self.need(",")
            self.need("}")
        elif self.eat("["):
            while not self.at("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.binding_element()
                if not self.at("]"):
                    self.need(",")
            self.need("]")
        else:
            self.binding_name()

    def binding_element(self) -> None:
        self.binding()
        if self.eat("="):
            self.inside(self.assignment)

    def for_(self) -> None:
        self.need("for")
        self.eat("await")
        self.need("(")
        no_in, self.no_in = self.no_in, True
        iterating = False
        if self.at("var", "const") or (self.at("let") and self.let_ahead()):
            word = self.next().text
            m = self.mark()

            def each() -> None:
                self.binding()
                if not self.at("of", "in"):
                    self.fail()

            if self.attempt(each):
                iterating = True
            else:
                self.back(m)
                self.declarations(word)
        elif not self.at(";"):
            self.expression()
            iterating = self.at("of", "in")
        self.no_in = False
        if iterating:
            if self.next().text == "of":
                self.assignment()
            else:
                self.expression()
        else:
            self.need(";")
            if not self.at(";"):
                self.expression()
            self.need(";")
            if not self.at(")"):
                self.expression()
        self.no_in = no_in
        self.need(")")
        self.statement(single=True)

    def module_name(self) -> None:
        if self.tok.kind not in ("name", "str"):
            self.fail("name")
        self.next()

    def from_(self) -> None:
        self.need("from")
        if self.tok.kind != "str":
            self.fail("module")
        self.next()
        if self.at("with") or (self.at("assert") and not self.tok.nl):
            self.next()
            self.object()

    def specifiers(self) -> None:
        self.need("{")
        while not self.at("}"):
            if self.typed and self.at("type") and self.ahead().text not in (",", "}", "as"):
                self.next()
            self.module_name()
            if self.eat("as"):
                self.module_name()
            if not self.at("}"):
                self.need(",")
        self.need("}")

    def import_(self) -> None:
        self.need("import")
        if self.tok.kind == "str":
            self.next()
            if self.eat("with"):
                self.object()
            self.semicolon()
            return
        if self.typed and self.at("type") and (self.ahead().text in ("{", "*") or (self.ahead().kind == "name" and self.ahead().text != "from")):
            self.next()
        if self.is_name():
            self.next()
            if self.typed and self.eat("="):
                self.expression()
                self.semicolon()
                return
            if not self.eat(","):
                self.from_()
                self.semicolon()
                return
        if self.eat("*"):
            self.need("as")
            self.binding_name()
        else:
            self.specifiers()
        self.from_()
        self.semicolon()

    def export(self) -> None:
        self.need("export")
        self.begin = (self.begin[0], self.begin[0])
        if self.eat("default"):
            if self.at("function") or (self.at("async") and self.ahead().text == "function"):
                self.eat("async")
                self.function(declared=True, named=False)
            elif self.at("class", "@") or (self.typed and self.at("abstract") and self.ahead().text == "class"):
                self.decorators()
                self.eat("abstract")
                self.class_(declared=True, named=False)
            elif self.typed and self.at("interface"):
                self.statement(True)
            else:
                self.assignment()
                self.semicolon()
        elif self.eat("*"):
            if self.eat("as"):
                self.module_name()
            self.from_()
            self.semicolon()
        elif self.at("{") or (self.typed and self.at("type") and self.ahead().text in ("{", "*")):
            self.eat("type")
            if self.eat("*"):
                if self.eat("as"):
                    self.module_name()
                self.from_()
            else:
                self.specifiers()
                if self.at("from"):
                    self.from_()
            self.semicolon()
        elif self.typed and self.eat("="):
            self.expression()
            self.semicolon()
        elif self.typed and self.at("as"):
            self.next()
            self.need("namespace")
            self.binding_name()
            self.semicolon()
        elif self.typed and self.at("import"):
            self.import_()
        elif self.at("var", "let", "const", "function", "class", "async", "@") or (
            self.typed and self.at("interface", "type", "enum", "namespace", "module", "declare", "abstract")
        ):
            self.statement(True, inner=True)
        else:
            self.fail("declaration")

    # -- functions and classes

    def function(self, declared: bool = False, named: bool = True) -> None:
        begin = self.begin
        self.need("function")
        self.eat("*")
        name = self.tok.text
        if not self.at("(", "<"):
            self.binding_name()
        elif declared and named:
            self.fail("name")
        head = self.callable(bodiless=declared and self.typed)
        if declared and head is not None:
            self.define("default" if name in ("(", "<") else name, *begin, head)

    def callable(self, bodiless: bool = False) -> int | None:
        """Parameters and body; the end of the head if there is a body."""
        if self.typed and self.at("<"):
            self.type_params()
        self.params()
        if self.typed and self.eat(":"):
            self.return_type()
        head = self.last_end
        if self.at("{"):
            self.body()
            return head
        if not bodiless:
            self.fail("{")
        self.semicolon()
        return None

    def body(self) -> None:
        no_in, self.no_in = self.no_in, False
        ambient, self.ambient = self.ambient, False
        self.functions += 1
        self.block()
        self.functions -= 1
        self.no_in, self.ambient = no_in, ambient

    def params(self) -> None:
        self.need("(")
        no_in, self.no_in = self.no_in, False
        while not self.at(")"):
            self.decorators()
            rest = self.eat("...")
            if self.typed:
                while self.at("public", "private", "protected", "readonly", "override") and (self.ahead().kind == "name" or self.ahead().text in ("{", "[")):
                    self.next()
                if self.at("this"):
                    self.next()
                    self.need(":")
                    self.type()
                    if not self.at(")"):
                        self.need(",")
                    continue
            self.binding()
            if self.typed:
                self.eat("?")
                if self.eat(":"):
                    self.type()
            if not rest and self.eat("="):
                self.assignment()
            if not self.at(")"):
                if rest:
                    self.fail(")")
                self.need(",")
        self.no_in = no_in
        self.need(")")

    def decorators(self) -> None:
        while self.eat("@"):
            if self.at("("):
                self.paren()
            else:
                self.name_any()
                while self.eat("."):
                    self.name_any()
                if self.at("("):
                    self.args()

    def name_any(self) -> None:
        if self.tok.kind != "name":
            self.fail("name")
        self.next()

    def class_(self, declared: bool = False, named: bool = True) -> None:
        begin = self.tok.start
        self.need("class")
        outer = self.owner, self.bases
        self.owner, self.bases = (self.tok.text if self.is_name() else "default") if declared else "", ()
        if not declared:
            self.functions += 1  # members of class expressions are no methods of a named type
        if self.is_name() and not (self.typed and self.at("implements")):
            self.next()
        elif declared and named:
            self.fail("name")
        if self.typed and self.at("<"):
            self.type_params()
        if self.eat("extends"):
            self.bases = (self.tok.text,)
            self.unary_postfix()
            if self.typed and self.tok.kind == "op" and self.tok.text.startswith("<"):
                self.type_args()
        if self.typed and self.eat("implements"):
            self.type()
            while self.eat(","):
                self.type()
        head = self.last_end
        self.need("{")
        while not self.at("}"):
            if self.tok.kind == "end":
                self.fail("}")
            if not self.eat(";"):
                self.member()
        self.need("}")
        if declared and not self.functions:
            self.defs.append(Def(self.owner + ".", begin, begin, head, self.last_end, None, self.bases))
        self.owner, self.bases = outer
        if not declared:
            self.functions -= 1

    def ends_member_name(self) -> bool:
        n = self.ahead()
        return n.text in ("(", "=", ";", "}", ",") and n.kind == "op" or n.kind == "end" or (self.typed and n.kind == "op" and n.text in ("?", ":", "!", "<"))

    def member(self) -> None:
        first = self.tok.start
        self.decorators()
        start = self.tok.start
        if self.at("static") and self.ahead().text == "{":
            self.next()
            self.body()
            return
        while self.tok.kind == "name" and not self.ends_member_name():
            if self.at("static", "async", "accessor") or (self.typed and self.tok.text in _MODIFIERS):
                if self.ahead().nl and self.tok.text != "static" and not self.typed:
                    break
                self.next()
            else:
                break
        self.eat("*")
        if self.at("get", "set") and not self.ends_member_name() and not (self.ahead().nl and self.ahead().text == "*"):
            self.next()
        if self.typed and self.at("["):
            m = self.mark()

            def index() -> None:
                self.need("[")
                self.binding_name()
                self.need(":")
                self.type()
                self.need("]")
                self.need(":")
                self.type()

            if self.attempt(index):
                self.semicolon()
                return
            self.back(m)
        name = self.tok.text.strip("'\"")
        self.property_name(private=True)
        if self.typed:
            if not self.eat("?"):
                self.eat("!")
        if self.at("(") or (self.typed and self.at("<")):
            head = self.callable(bodiless=self.typed)
            if head is not None and self.owner:
                self.define(name, first, start, head)
            return
        if self.typed and self.eat(":"):
            self.type()
        if self.eat("="):
            self.functions += 1
            self.assignment()
            self.functions -= 1
        self.semicolon()

    def property_name(self, private: bool = False) -> None:
        if self.eat("["):
            self.inside(self.assignment)
            self.need("]")
        elif self.tok.kind in ("str", "num") or (self.tok.kind == "name" and (private or not self.tok.text.startswith("#"))):
            self.next()
        else:
            self.fail("property")

    # -- expressions

    def expression(self) -> str:
        kind = self.assignment()
        while self.eat(","):
            self.assignment()
            kind = "value"
        return kind

    def assignment(self) -> str:
        t = self.tok
        if t.kind == "name":
            if t.text == "yield" and self.functions:
                self.next()
                if not self.tok.nl and not self.at(")", "]", "}", ",", ";", ":", "in", "of") and self.tok.kind != "end":
                    self.eat("*")
                    self.assignment()
                return "value"
            if t.text == "async" and not self.ahead().nl and self.ahead().kind == "name" and self.ahead().text not in ("function", "in", "of", "instanceof", "as", "satisfies"):
                self.next()
                self.binding_name()
                self.arrow_body()
                return "value"
            if t.text not in RESERVED and self.ahead().text == "=>" and self.ahead().kind == "op":
                self.next()
                self.arrow_body()
                return "value"
        if self.at("(") or (self.at("async") and self.ahead().text in ("(", "<") and not self.ahead().nl) or (self.typed and self.at("<")):
            if self.attempt(self.arrow):
                self.arrow_body()
                return "value"
        asserted = self.typed and self.at("<")
        if asserted:
            self.need("<")
            self.type()
            if not self.split(">"):
                self.fail(">")
        kind = self.conditional()
        self.arrow_head = None
        if self.tok.kind == "op" and self.tok.text in _ASSIGN:
            if kind not in ("target", "pattern" if self.tok.text == "=" else "target"):
                self.fail("target")
            self.next()
            self.assignment()
            return "value"
        return "value" if asserted else kind

    def arrow(self) -> None:
        self.eat("async")
        if self.typed and self.at("<"):
            self.type_params()
        self.params()
        if self.typed and self.eat(":"):
            self.return_type()
        if not self.at("=>") or self.tok.nl:
            self.fail("=>")

    def arrow_body(self) -> None:
        if not self.at("=>"):
            self.fail("=>")
        head = self.tok.end
        self.next()
        if self.at("{"):
            self.body()
        else:
            self.functions += 1
            self.assignment()
            self.functions -= 1
        self.arrow_head = head

    def conditional(self) -> str:
        kind = self.binary(1)
        if self.at("?"):
            self.next()
            self.inside(self.assignment)
            self.need(":")
            self.assignment()
            return "value"
        return kind

    def binary(self, least: int) -> str:
        if self.tok.kind == "name" and self.tok.text.startswith("#") and self.ahead().text == "in":
            self.next()
            kind = "value"
        else:
            kind = self.unary()
        while True:
            t = self.tok
            if self.typed and t.kind == "name" and t.text in ("as", "satisfies") and not t.nl:
                self.next()
                if not self.eat("const"):
                    self.type()
                kind = "target" if kind == "target" else "value"
                continue
            p = _BINARY.get(t.text, 0) if t.kind == "op" or t.text in ("in", "instanceof") else 0
            if p < least or p == 0 or (t.text == "in" and self.no_in) or t.kind == "str":
                return kind
            self.next()
            self.binary(p if t.text == "**" else p + 1)
            kind = "value"

    def unary(self) -> str:
        if self.at("!", "~", "+", "-", "typeof", "void", "delete", "await"):
            self.next()
            self.unary()
            return "value"
        if self.at("++", "--"):
            self.next()
            if self.unary() != "target":
                self.fail("target")
            return "value"
        kind = self.unary_postfix()
        if self.at("++", "--") and not self.tok.nl:
            if kind != "target":
                self.fail("target")
            self.next()
            return "value"
        return kind

    def unary_postfix(self) -> str:
        kind = self.primary()
        optional = False
        while True:
            t = self.tok
            if t.kind == "tmpl":
                self.template()
                kind = "value"
            elif t.kind != "op":
                return kind
            elif t.text == ".":
                self.next()
                self.name_any()
                kind = "target" if not optional else "value"
            elif t.text == "?.":
                self.next()
                optional = True
                if self.at("("):
                    self.args()
                elif self.at("["):
                    self.next()
                    self.inside(self.expression)
                    self.need("]")
                else:
                    self.name_any()
                kind = "value"
            elif t.text == "[":
                self.next()
                self.inside(self.expression)
                self.need("]")
                kind = "target" if not optional else "value"
            elif t.text == "(":
                self.args()
                kind = "value"
            elif self.typed and t.text == "!" and not t.nl:
                self.next()
            elif self.typed and t.text in ("<", "<<"):
                if not self.attempt(self.call_types):
                    return kind
                kind = "value"
            else:
                return kind

    def call_types(self) -> None:
        self.type_args()
        if self.tok.kind == "tmpl" or self.at("("):
            return
        if self.at(")", "]", ",", ";", "}", ".", "?.", "=", "===", "!==", "&&", "||", "??") or self.tok.nl or self.tok.kind == "end":
            return
        self.fail("(")

    def args(self) -> None:
        self.need("(")
        no_in, self.no_in = self.no_in, False
        while not self.at(")"):
            self.eat("...")
            self.assignment()
            if not self.at(")"):
                self.need(",")
        self.no_in = no_in
        self.need(")")

    def template(self) -> None:
        """From the opening backtick to the closing one."""
        at = self.tok.end
        while True:
            m = _TEMPLATE.match(self.text, at)
            at = m.end()
            if at >= len(self.text):
                raise Broken(f"at {self.tok.start}: template")
            if self.text[at] == "`":
                self.last_end = at + 1
                self.tok = self.scan(at + 1)
                return
            self.tok = self.scan(at + 2)
            self.inside(self.expression)
            if not self.at("}"):
                self.fail("}")
            at = self.tok.end

    def primary(self) -> str:
        t = self.tok
        if t.kind in ("num", "str"):
            self.next()
            return "value"
        if t.kind == "tmpl":
            self.template()
            return "value"
        if t.kind == "op":
            if t.text in ("/", "/="):
                m = _REGEX.match(self.text, t.start)
                if not m:
                    self.fail("operand")
                self.last_end = m.end()
                self.tok = self.scan(m.end())
                return "value"
            if t.text == "(":
                self.next()
                no_in, self.no_in = self.no_in, False
                kind = self.grouped()
                self.no_in = no_in
                self.need(")")
                return kind
            if t.text == "[":
                self.next()
                no_in, self.no_in = self.no_in, False
                while not self.at("]"):
                    if self.eat(","):
                        continue
                    self.eat("...")
                    self.assignment()
                    if not self.at("]"):
                        self.need(",")
                self.no_in = no_in
                self.need("]")
                return "pattern"
            if t.text == "{":
                self.object()
                return "pattern"
            if t.text == "@":
                self.decorators()
                self.class_()
                return "value"
            self.fail("operand")
        if t.kind != "name":
            self.fail("operand")
        if t.text == "function":
            self.function()
        elif t.text == "async" and self.ahead().text == "function" and not self.ahead().nl:
            self.next()
            self.function()
        elif t.text == "class":
            self.class_()
        elif t.text == "new":
            self.next()
            if self.eat("."):
                self.need("target")
                return "value"
            self.new_target()
        elif t.text == "import":
            self.next()
            if self.eat("."):
                self.name_any()
            elif not self.at("("):
                self.fail("(")
        elif t.text == "super":
            self.next()
            if not self.at("(", ".", "["):
                self.fail("(")
        elif t.text in ("this", "null", "true", "false"):
            self.next()
        elif t.text in RESERVED or t.text.startswith("#"):
            self.fail("operand")
        else:
            self.next()
            return "target"
        return "value"

    def grouped(self) -> str:
        return "target" if self.expression() == "target" else "value"

    def new_target(self) -> None:
        if self.at("new"):
            self.next()
            self.new_target()
        else:
            self.primary()
        while True:
            if self.eat("."):
                self.name_any()
            elif self.eat("["):
                self.inside(self.expression)
                self.need("]")
            elif self.tok.kind == "tmpl":
                self.template()
            elif self.typed and self.at("!"):
                self.next()
            else:
                break
        if self.typed and self.at("<", "<<"):
            self.attempt(self.call_types)
        if self.at("("):
            self.args()

    def object(self) -> None:
        self.need("{")
        no_in, self.no_in = self.no_in, False
        while not self.at("}"):
            if self.eat("..."):
                self.assignment()
            else:
                self.property()
            if not self.at("}"):
                self.need(",")
        self.no_in = no_in
        self.need("}")

    def property(self) -> None:
        done = lambda: self.ahead().kind == "op" and self.ahead().text in ("(", ":", ",", "}", "=", "<")
        if self.at("async") and not done() and not self.ahead().nl:
            self.next()
        star = self.eat("*")
        if self.at("get", "set") and not done():
            self.next()
            star = True
        plain = self.is_name() or self.at("await", "yield")
        self.property_name()
        if self.at("(") or (self.typed and self.at("<")):
            self.callable()
        elif star:
            self.fail("(")
        elif self.eat(":"):
            self.assignment()
        elif not plain:
            self.fail(":")
        elif self.eat("="):
            self.assignment()

    # -- types

    def type_statement(self, top: bool) -> bool:
        t, n = self.tok, self.ahead()
        if t.kind != "name":
            return False
        if t.text == "interface" and n.kind == "name" and not n.nl:
            self.next()
            self.binding_name()
            if self.at("<"):
                self.type_params()
            if self.eat("extends"):
                self.type()
                while self.eat(","):
                    self.type()
            head = self.last_end
            self.type_members()
            self.define_type(n.text, t.start, head)
            return True
        if t.text == "type" and n.kind == "name" and not n.nl and n.text not in ("in", "instanceof"):
            self.next()
            self.binding_name()
            if self.at("<"):
                self.type_params()
            self.need("=")
            self.type()
            self.semicolon()
            return True
        if t.text == "enum":
            self.enum()
            self.define_type(n.text, t.start, n.end)
            return True
        if t.text in ("namespace", "module") and (n.kind == "name" or n.kind == "str") and not n.nl:
            self.next()
            self.next()
            while self.eat("."):
                self.name_any()
            if self.at("{"):
                self.need("{")
                while not self.at("}"):
                    if self.tok.kind == "end":
                        self.fail("}")
                    self.statement(True)
                self.need("}")
            else:
                self.semicolon()
            return True
        if t.text == "declare" and n.kind == "name" and not n.nl:
            self.next()
            ambient, self.ambient = self.ambient, True
            if self.at("global") and self.ahead().text == "{":
                self.next()
                self.need("{")
                while not self.at("}"):
                    if self.tok.kind == "end":
                        self.fail("}")
                    self.statement(True)
                self.need("}")
            else:
                self.statement(top)
            self.ambient = ambient
            return True
        if t.text == "abstract" and n.text == "class":
            self.next()
            self.class_(declared=True)
            return True
        return False

    def enum(self) -> None:
        self.need("enum")
        self.binding_name()
        self.need("{")
        while not self.at("}"):
            self.property_name()
            if self.eat("="):
                self.assignment()
            if not self.at("}"):
                self.need(",")
        self.need("}")

    def type_params(self) -> None:
        self.need("<")
        while not self.at(">"):
            while self.at("const", "in", "out") and self.ahead().kind == "name":
                self.next()
            self.binding_name()
            if self.eat("extends"):
                self.type()
            if self.eat("="):
                self.type()
            if not (self.tok.kind == "op" and self.tok.text.startswith(">")):
                self.need(",")
            elif self.tok.text != ">":
                break
        if not self.split(">"):
            self.fail(">")

    def type_args(self) -> None:
        if not self.split("<"):
            self.fail("<")
        while True:
            self.type()
            if not self.eat(","):
                break
        if not self.split(">"):
            self.fail(">")

    def return_type(self) -> None:
        if self.at("asserts") and self.ahead().kind == "name" and not self.ahead().nl:
            self.next()
            self.next()
            if self.eat("is"):
                self.type()
            return
        if (self.is_name() or self.at("this")) and self.ahead().text == "is" and not self.ahead().nl:
            self.next()
            self.next()
        self.type()

    def type(self) -> None:
        if self.tok.kind == "op" and self.tok.text in ("(", "<") or self.at("new", "abstract"):
            if self.attempt(self.function_type):
                return
        self.union()
        if self.at("extends") and not self.tok.nl:
            self.next()
            self.type_no_conditional()
            self.need("?")
            self.type()
            self.need(":")
            self.type()

    def type_no_conditional(self) -> None:
        if self.tok.kind == "op" and self.tok.text in ("(", "<") or self.at("new"):
            if self.attempt(self.function_type):
                return
        self.union()

    def function_type(self) -> None:
        self.eat("abstract")
        self.eat("new")
        if self.at("<"):
            self.type_params()
        self.params()
        self.need("=>")
        self.return_type()

    def union(self) -> None:
        self.eat("|", "&")
        self.type_operator()
        while self.at("|", "&"):
            self.next()
            self.type_operator()

    def type_operator(self) -> None:
        if self.at("keyof", "unique", "readonly") and (self.ahead().kind in ("name", "tmpl", "str") or self.ahead().text in ("(", "[", "{")):
            self.next()
            self.type_operator()
            return
        if self.at("infer"):
            self.next()
            self.binding_name()
            if self.at("extends"):
                m = self.mark()

                def bound() -> None:
                    self.need("extends")
                    self.union()
                    if self.at("?"):
                        self.fail()

                if not self.attempt(bound):
                    self.back(m)
            return
        self.type_postfix()

    def type_postfix(self) -> None:
        self.type_primary()
        while self.at("[") and not self.tok.nl:
            self.next()
            if not self.eat("]"):
                self.type()
                self.need("]")

    def type_primary(self) -> None:
        t = self.tok
        if t.kind in ("str", "num"):
            self.next()
        elif t.kind == "tmpl":
            self.type_template()
        elif t.kind == "op":
            if t.text == "-":
                self.next()
                if self.tok.kind != "num":
                    self.fail("number")
                self.next()
            elif t.text == "(":
                self.next()
                self.type()
                self.need(")")
            elif t.text == "[":
                self.next()
                while not self.at("]"):
                    self.eat("...")
                    if self.tok.kind == "name" and (self.ahead().text == ":" or (self.ahead().text == "?" and self.scan(self.ahead().end).text == ":")):
                        self.next()
                        self.eat("?")
                        self.need(":")
                        self.type()
                    else:
                        self.type()
                        self.eat("?")
                    if not self.at("]"):
                        self.need(",")
                self.need("]")
            elif t.text == "{":
                if not self.attempt(self.mapped):
                    self.type_members()
            else:
                self.fail("type")
        elif t.kind != "name":
            self.fail("type")
        elif t.text == "typeof":
            self.next()
            if self.at("import"):
                self.import_type()
            else:
                self.name_any()
                while self.eat("."):
                    self.name_any()
                if self.tok.kind == "op" and self.tok.text.startswith("<") and not self.tok.nl:
                    self.type_args()
        elif t.text == "import":
            self.import_type()
        elif t.text in ("void", "null", "this", "true", "false", "undefined"):
            self.next()
        elif t.text in RESERVED and t.text not in ("await", "yield"):
            self.fail("type")
        else:
            self.next()
            while self.eat("."):
                self.name_any()
            if self.tok.kind == "op" and self.tok.text in ("<", "<<") and not self.tok.nl:
                self.type_args()

    def import_type(self) -> None:
        self.need("import")
        self.need("(")
        self.type()
        if self.eat(","):
            self.object()
        self.need(")")
        while self.eat("."):
            self.name_any()
        if self.at("<"):
            self.type_args()

    def type_template(self) -> None:
        at = self.tok.end
        while True:
            at = _TEMPLATE.match(self.text, at).end()
            if at >= len(self.text):
                raise Broken(f"at {self.tok.start}: template")
            if self.text[at] == "`":
                self.last_end = at + 1
                self.tok = self.scan(at + 1)
                return
            self.tok = self.scan(at + 2)
            self.type()
            if not self.at("}"):
                self.fail("}")
            at = self.tok.end

    def mapped(self) -> None:
        self.need("{")
        if self.at("+", "-"):
            self.next()
        self.eat("readonly")
        self.need("[")
        self.binding_name()
        self.need("in")
        self.type()
        if self.eat("as"):
            self.type()
        self.need("]")
        if self.at("+", "-"):
            self.next()
        self.eat("?")
        if self.eat(":"):
            self.type()
        self.eat(";", ",")
        self.need("}")

    def type_members(self) -> None:
        self.need("{")
        while not self.at("}"):
            if self.tok.kind == "end":
                self.fail("}")
            if self.at("(", "<"):
                self.signature()
            elif self.at("new") and self.ahead().text in ("(", "<"):
                self.next()
                self.signature()
            else:
                if self.at("readonly", "get", "set") and not (self.ahead().kind == "op" and self.ahead().text in (":", "?", "(", ";", ",", "}", "<")):
                    self.next()
                m = self.mark()

                def index() -> None:
                    self.need("[")
                    self.binding_name()
                    self.need(":")
                    self.type()
                    self.need("]")

                if self.at("[") and self.attempt(index):
                    pass
                else:
                    self.back(m)
                    self.property_name()
                self.eat("?")
                if self.at("(", "<"):
                    self.signature()
                elif self.eat(":"):
                    self.type()
            if not self.eat(";", ",") and not self.at("}") and not self.tok.nl:
                self.fail(";")
        self.need("}")

    def signature(self) -> None:
        if self.at("<"):
            self.type_params()
        self.params()
        if self.eat(":"):
            self.return_type()


def parse(text: str, typed: bool) -> list[Def]:
    p = Parser(text, typed)
    p.module()
    return p.defs
