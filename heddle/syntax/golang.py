"""Local grammar of Go."""

from __future__ import annotations

import re

from heddle.syntax.base import Broken, Cursor, Def, Tok

KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_TOKEN = re.compile(
    r"""(?P<ws>[ \t\r]+)|(?P<nl>\n)|(?P<line>//[^\n]*)|(?P<block>/\*.*?\*/)
    |(?P<name>[^\W\d]\w*)
    |(?P<num>0[xX](?:_?[0-9a-fA-F])+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9_]+)?i?|0[bB](?:_?[01])+i?|0[oO](?:_?[0-7])+i?|(?:[0-9](?:_?[0-9])*\.?(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?i?)
    |(?P<raw>`[^`]*`)|(?P<str>"(?:\\.|[^"\\\n])*")|(?P<char>'(?:\\(?:[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[abfnrtv\\'"])|[^'\\\n])')
    |(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[+\-*/%&|^<>=!()\[\]{},;.:~])""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(?:[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[abfnrtv\\\"])")
_ENDS = frozenset(["break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])
_BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
_ASSIGN = frozenset(["=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="])


def tokens(text: str) -> list[Tok]:
    out: list[Tok] = []
    i, size = 0, len(text)

    def close() -> bool:
        if not out:
            return False
        t = out[-1]
        return t.kind in ("num", "str", "char") or (t.kind == "name" and (t.text not in KEYWORDS or t.text in _ENDS)) or (t.kind == "op" and t.text in _ENDS)

    while i < size:
        m = _TOKEN.match(text, i)
        if not m or m.end() == i:
            raise Broken(f"at {i}: no token")
        kind, value = m.lastgroup, m.group()
        if kind == "nl" or (kind == "block" and "\n" in value):
            if close():
                out.append(Tok("op", ";", i, i, True))
        elif kind in ("name", "num", "char", "op"):
            if kind == "num" and m.end() < size and (text[m.end()].isalnum() or text[m.end()] == "_"):
                raise Broken(f"at {i}: number")
            if kind == "num" and re.fullmatch(r"0[0-9_]*[89][0-9_]*", value):
                raise Broken(f"at {i}: octal")
            out.append(Tok(kind, value, i, m.end()))
        elif kind in ("str", "raw"):
            if kind == "str" and "\\" in value and _ESCAPE.sub("", value).count("\\"):
                raise Broken(f"at {i}: escape")
            out.append(Tok("str", value, i, m.end()))
        i = m.end()
    if close():
        out.append(Tok("op", ";", size, size, True))
    out.append(Tok("end", "", size, size))
    return out


class Parser(Cursor):
    def __init__(self, text: str):
        super().__init__(tokens(text))
        self.defs: list[Def] = []
        self.level = 0  # composite literals of plain type names are allowed at 0 and above

    def name(self) -> None:
        if self.tok.kind != "name" or self.tok.text in KEYWORDS:
            self.fail("name")
        self.i += 1

    def is_name(self) -> bool:
        return self.tok.kind == "name" and self.tok.text not in KEYWORDS

    def end(self) -> None:
        if not self.eat(";") and not self.at(")", "}"):
            self.fail(";")

    def file(self) -> None:
        self.need("package")
        self.name()
        self.end()
        while self.eat("import"):
            self.group(self.import_spec)
            self.end()
        while self.tok.kind != "end":
            if self.at("func"):
                self.func_decl()
            elif self.at("const", "var", "type"):
                self.top = True
                self.decl()
                self.top = False
            else:
                self.fail("declaration")
            if self.tok.kind != "end":
                self.need(";")

    def group(self, one) -> None:
        if self.eat("("):
            while not self.at(")"):
                one()
                if not self.at(")"):
                    self.need(";")
            self.need(")")
        else:
            one()

    def import_spec(self) -> None:
        if self.at(".") or self.is_name():
            self.i += 1
        if self.tok.kind != "str":
            self.fail("path")
        self.i += 1

    def decl(self) -> None:
        word = self.next().text
        self.group({"const": self.const_spec, "var": self.var_spec, "type": self.type_spec}[word])

    def names(self) -> None:
        self.name()
        while self.eat(","):
            self.name()

    def const_spec(self) -> None:
        self.names()
        if not self.at("=", ";", ")"):
            self.type()
        if self.eat("="):
            self.exprs()

    def var_spec(self) -> None:
        self.names()
        if not self.at("="):
            self.type()
        if self.eat("="):
            self.exprs()

    top = False  # outside functions

    def type_spec(self) -> None:
        t = self.tok
        self._type_spec()
        if self.top:
            self.defs.append(Def(t.text + ".", t.start, t.start, t.end, self.toks[self.i - 1].end))

    def _type_spec(self) -> None:
        self.name()
        if self.at("["):
            mark = self.i
            try:
                self.type_params()
                self.eat("=")
                self.type()
                return
            except Broken:
                self.i = mark
        self.eat("=")
        self.type()

    def type_params(self) -> None:
        self.need("[")
        while True:
            self.names()
            self.constraint()
            if not self.eat(",") or self.at("]"):
                break
        self.need("]")

    def constraint(self) -> None:
        while True:
            self.eat("~")
            self.type()
            if not self.eat("|"):
                break

    def func_decl(self) -> None:
        first = self.tok.start
        self.need("func")
        owner = ""
        if self.at("("):
            mark = self.i
            self.params()
            for t in self.toks[mark : self.i]:
                if t.text == "[":
                    break
                if t.kind == "name":
                    owner = t.text + "."
        name = self.tok.text
        self.name()
        if self.at("["):
            self.type_params()
        self.signature()
        head = self.toks[self.i - 1].end
        if self.at("{"):
            self.block()
        self.defs.append(Def(owner + name, first, first, head, self.toks[self.i - 1].end))

    def signature(self) -> None:
        self.params()
        if self.at("("):
            self.params()
        elif self.starts_type():
            self.type()

    def starts_type(self) -> bool:
        return self.is_name() or self.at("*", "[", "func", "map", "chan", "struct", "interface", "<-", "(")

    def params(self) -> None:
        """Either all parameters are named, or none is."""
        self.need("(")
        named = plain = 0
        bare = False  # the last one so far is a lone name
        while not self.at(")"):
            bare = False
            if self.eat("..."):
                self.type()
                plain += 1
            else:
                single = self.is_name()
                self.type()
                if not self.at(",", ")"):
                    if not single:
                        self.fail(",")
                    self.eat("...")
                    self.type()
                    named += 1
                else:
                    plain += not single
                    bare = single
            if not self.at(")"):
                self.need(",")
        if named and (plain or bare):
            self.fail("named parameters")
        self.need(")")

    def type(self) -> None:
        if self.eat("("):
            self.type()
            self.need(")")
        elif self.eat("*"):
            self.type()
        elif self.eat("["):
            if not self.eat("]"):
                if not self.eat("..."):
                    self.nested(self.expr)
                self.need("]")
            self.type()
        elif self.eat("map"):
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif self.eat("<-"):
            self.need("chan")
            self.type()
        elif self.eat("chan"):
            self.eat("<-")
            self.type()
        elif self.eat("func"):
            self.signature()
        elif self.eat("struct"):
            self.need("{")
            while not self.at("}"):
                if self.eat("*"):
                    self.type()
                else:
                    self.name()
                    if self.eat("."):
                        self.name()
                        if self.at("["):
                            self.type_args()
                    elif not self.at(";", "}") and self.tok.kind != "str":
                        while self.eat(","):
                            self.name()
                        self.type()
                if self.tok.kind == "str":
                    self.i += 1
                if not self.at("}"):
                    self.need(";")
            self.need("}")
        elif self.eat("interface"):
            self.need("{")
            while not self.at("}"):
                if self.is_name() and self.ahead().text == "(":
                    self.i += 1
                    self.signature()
                else:
                    self.constraint()
                if not self.at("}"):
                    self.need(";")
            self.need("}")
        else:
            self.name()
            if self.eat("."):
                self.name()
            if self.at("["):
                mark = self.i
                try:
                    self.type_args()
                except Broken:
                    self.i = mark

    def type_args(self) -> None:
        self.need("[")
        self.type()
        while self.eat(","):
            if self.at("]"):
                break
            self.type()
        self.need("]")

    def nested(self, what) -> None:
        level, self.level = self.level, 0
        what()
        self.level = level

    def block(self) -> None:
        self.need("{")
        self.nested(self.statements)
        self.need("}")

    def statements(self) -> None:
        while not self.at("}", "case", "default"):
            if self.tok.kind == "end":
                self.fail("}")
            if self.eat(";"):
                continue
            self.statement()
            if not self.at("}"):
                self.need(";")

    def statement(self) -> None:
        t = self.tok.text if self.tok.kind == "name" else ""
        if t in ("const", "var", "type"):
            self.decl()
        elif t == "return":
            self.i += 1
            if not self.at(";", "}"):
                self.exprs()
        elif t in ("break", "continue", "goto"):
            self.i += 1
            if self.is_name():
                self.i += 1
        elif t == "fallthrough":
            self.i += 1
        elif t in ("go", "defer"):
            self.i += 1
            self.expr()
        elif t == "if":
            self.if_()
        elif t == "for":
            self.for_()
        elif t == "switch":
            self.switch()
        elif t == "select":
            self.i += 1
            self.need("{")
            self.clauses(self.simple)
        elif self.at("{"):
            self.block()
        elif self.is_name() and self.ahead().text == ":" and self.ahead().kind == "op":
            self.i += 2
            if not self.at("}"):
                self.eat(";")
                if not self.at("}", "case", "default"):
                    self.statement()
        else:
            self.simple()

    def simple(self, range_ok: bool = False) -> None:
        if range_ok and self.eat("range"):
            self.expr()
            return
        self.exprs()
        if self.at("++", "--"):
            self.i += 1
        elif self.eat("<-"):
            self.expr()
        elif self.tok.kind == "op" and self.tok.text in _ASSIGN:
            op = self.next().text
            if range_ok and op in ("=", ":=") and self.eat("range"):
                self.expr()
            else:
                self.exprs()

    def header(self, what) -> None:
        level, self.level = self.level, -1
        what()
        self.level = level

    def if_(self) -> None:
        self.need("if")

        def head() -> None:
            if not self.at(";"):
                self.simple()
            if self.eat(";"):
                self.simple()

        if self.at("{"):
            self.fail("condition")
        self.header(head)
        self.block()
        if self.eat("else"):
            if self.at("if"):
                self.if_()
            else:
                self.block()

    def for_(self) -> None:
        self.need("for")

        def head() -> None:
            if not self.at(";"):
                self.simple(range_ok=True)
            if self.eat(";"):
                if not self.at(";"):
                    self.simple()
                self.need(";")
                if not self.at("{"):
                    self.simple()

        if not self.at("{"):
            self.header(head)
        self.block()

    def switch(self) -> None:
        self.need("switch")

        def head() -> None:
            if not self.at(";"):
                self.simple()
            if self.eat(";") and not self.at("{"):
                self.simple()

        if not self.at("{"):
            self.header(head)
        self.need("{")
        self.clauses(self.case_list)

    def case_list(self) -> None:
        self.type_or_expr()
        while self.eat(","):
            self.type_or_expr()

    def type_or_expr(self) -> None:
        mark = self.i
        try:
            self.expr()
        except Broken:
            self.i = mark
            self.type()

    def clauses(self, head) -> None:
        while self.at("case", "default"):
            if self.next().text == "case":
                head()
            self.need(":")
            self.nested(self.statements)
        self.need("}")

    def exprs(self) -> None:
        self.expr()
        while self.eat(","):
            self.expr()

    def expr(self, least: int = 1) -> None:
        self.unary()
        while self.tok.kind == "op" and (p := _BINARY.get(self.tok.text, 0)) >= least:
            self.i += 1
            self.expr(p + 1)

    def unary(self) -> None:
        while self.at("+", "-", "!", "^", "*", "&", "<-"):
            self.i += 1
        self.primary()

    def primary(self) -> None:
        t = self.tok
        plain = False  # a type that may be followed by a composite literal
        if t.kind in ("num", "str", "char"):
            self.i += 1
        elif t.text == "(" and t.kind == "op":
            self.i += 1
            self.nested(self.type_or_expr)
            self.need(")")
        elif t.text == "func":
            self.i += 1
            self.signature()
            if self.at("{"):
                self.block()
        elif t.text in ("[", "map", "struct") and t.kind in ("op", "name"):
            self.type()
            if self.at("{"):
                self.literal()
        elif t.text in ("chan", "interface"):
            self.type()
        elif self.is_name():
            self.i += 1
            plain = True
        else:
            self.fail("operand")
        while True:
            if self.eat("."):
                if self.eat("("):
                    if not self.eat("type"):
                        self.type()
                    self.need(")")
                    plain = False
                else:
                    self.name()
            elif self.eat("["):
                self.nested(self.index)
                self.need("]")
            elif self.eat("("):
                self.nested(self.args)
                self.need(")")
                plain = False
            elif self.at("{") and plain and self.level >= 0:
                self.literal()
                plain = False
            else:
                return

    def index(self) -> None:
        if not self.at(":"):
            self.type_or_expr()
            while self.eat(","):
                if self.at("]"):
                    return
                self.type()
        for _ in range(2):
            if self.eat(":") and not self.at("]", ":"):
                self.expr()

    def args(self) -> None:
        while not self.at(")"):
            self.type_or_expr()
            self.eat("...")
            if not self.at(")"):
                self.need(",")

    def literal(self) -> None:
        self.need("{")

        def elements() -> None:
            while not self.at("}"):
                for _ in range(2):
                    if self.at("{"):
                        self.literal()
                    else:
                        self.expr()
                    if not self.eat(":"):
                        break
                if not self.at("}"):
                    self.need(",")

        self.nested(elements)
        self.need("}")


def parse(text: str) -> list[Def]:
    p = Parser(text)
    p.file()
    return p.defs
