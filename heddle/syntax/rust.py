"""Local grammar of Rust 2021."""

from __future__ import annotations

import re

from heddle.syntax.base import Broken, Cursor, Def, Tok

KEYWORDS = frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while abstract become box do final macro override priv typeof unsized virtual yield try".split())
PATH_WORDS = frozenset(["self", "Self", "super", "crate"])
_TOKEN = re.compile(
    r"""(?P<ws>\s+)|(?P<line>//[^\n]*)
    |(?P<rawstr>(?:br|cr|r)(?P<h>\#*)".*?"(?P=h))
    |(?P<str>[bc]?"(?:\\.|[^"\\])*")
    |(?P<char>b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}|[nrt\\0'"])|[^'\\\n\t])')
    |(?P<life>'[^\W\d]\w*(?!'))
    |(?P<name>r\#[^\W\d]\w*|[^\W\d]\w*)
    |(?P<num>0x[0-9a-fA-F_]+(?:[iu](?:8|16|32|64|128|size))?|0b[01_]+(?:[iu](?:8|16|32|64|128|size))?|0o[0-7_]+(?:[iu](?:8|16|32|64|128|size))?|[0-9][0-9_]*(?:\.(?![.\w])|\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9_]+)?(?:f32|f64|[iu](?:8|16|32|64|128|size))?)
    |(?P<op><<=|>>=|\.\.\.|\.\.=|::|->|=>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|<<|>>|\.\.|[+\-*/%^!&|=<>@.,;:\#$?~(){}\[\]])""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}|\r?\n|[nrt\\0'\"])")
_BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, ">": 3, "<=": 3, ">=": 3, "|": 4, "^": 5, "&": 6, "<<": 7, ">>": 7, "+": 8, "-": 8, "*": 9, "/": 9, "%": 9}
_ASSIGN = frozenset(["=", "+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "<<=", ">>="])
_OPEN = {"(": ")", "[": "]", "{": "}"}


def tokens(text: str) -> list[Tok]:
    out: list[Tok] = []
    i, size = 0, len(text)
    if text.startswith("#!") and not text.startswith("#!["):
        i = text.find("\n") if "\n" in text else size
    while i < size:
        if text.startswith("/*", i):
            depth, j = 1, i + 2
            while depth:
                m = re.compile(r"/\*|\*/").search(text, j)
                if not m:
                    raise Broken(f"at {i}: comment")
                depth += 1 if m.group() == "/*" else -1
                j = m.end()
            i = j
            continue
        m = _TOKEN.match(text, i)
        if not m:
            raise Broken(f"at {i}: no token")
        kind, value = m.lastgroup, m.group()
        if kind == "h":
            kind = "rawstr"
        if kind not in ("ws", "line"):
            if kind == "str" and "\\" in value and "\\" in _ESCAPE.sub("", value):
                raise Broken(f"at {i}: escape")
            if kind == "num" and m.end() < size and (text[m.end()].isalnum() or text[m.end()] == "_"):
                raise Broken(f"at {i}: number")
            out.append(Tok("str" if kind == "rawstr" else kind, value, i, m.end()))
        i = m.end()
    out.append(Tok("end", "", size, size))
    return out


class Parser(Cursor):
    def __init__(self, text: str):
        super().__init__(tokens(text))
        self.defs: list[Def] = []
        self.owner = ""
        self.inside = 0  # bodies of functions around the current place

    # -- helpers

    def is_name(self) -> bool:
        t = self.tok
        return t.kind == "name" and (t.text not in KEYWORDS)

    def name(self) -> None:
        if not self.is_name():
            self.fail("name")
        self.i += 1

    def split(self, head: str) -> bool:
        """Take ``head`` off an operator that starts with it, as >> in types."""
        t = self.tok
        if t.kind != "op" or not t.text.startswith(head):
            return False
        if t.text == head:
            self.i += 1
        else:
            self.toks = self.toks[:]  # earlier marks keep their tokens
            self.toks[self.i] = Tok("op", t.text[len(head) :], t.start + len(head), t.end)
        return True

    def tree(self) -> None:
        """One token tree; brackets match."""
        t = self.next()
        if t.kind == "end":
            self.fail("token")
        if t.kind == "op" and t.text in _OPEN:
            while not (self.tok.kind == "op" and self.tok.text == _OPEN[t.text]):
                if self.tok.kind == "end" or (self.tok.kind == "op" and self.tok.text in ")]}"):
                    self.fail(_OPEN[t.text])
                self.tree()
            self.i += 1

    def attributes(self) -> None:
        while self.at("#"):
            self.i += 1
            self.eat("!")
            if not self.at("["):
                self.fail("[")
            self.tree()

    def list(self, close: str, one, sep: str = ",") -> None:
        while not self.at(close):
            one()
            if not self.at(close):
                self.need(sep)
        self.need(close)

    # -- items

    def file(self) -> None:
        while self.tok.kind != "end":
            self.item()

    def visibility(self) -> None:
        if self.eat("pub") and self.at("(") and self.ahead().text in ("crate", "self", "super", "in"):
            self.tree()

    def starts_item(self) -> bool:
        t, n = self.tok, self.ahead().text
        if t.kind != "name":
            return False
        if t.text in ("pub", "fn", "struct", "enum", "trait", "impl", "mod", "use", "static", "type"):
            return not (t.text == "static" and n in ("|", "||", "move"))
        if t.text == "const":
            return n not in ("{", "|", "||", "move", "async")
        if t.text == "unsafe":
            return n in ("fn", "impl", "trait", "extern", "mod")
        if t.text == "extern":
            return True
        if t.text == "async":
            return n in ("fn", "unsafe") and self.ahead(2).text != "{"
        if t.text == "union":
            return self.ahead().kind == "name" and self.ahead(2).text in ("{", "<", "where")
        if t.text == "macro_rules":
            return n == "!" and self.ahead(2).kind == "name"
        return False

    def item(self) -> None:
        mark = self.i
        self.attributes()
        if self.tok.kind != "end":
            self.visibility()
        begin, self.i = self.i, mark
        self._item()
        t = self.toks[begin]
        if not self.inside and begin < self.i and t.text in ("struct", "union", "enum", "trait"):
            name = self.toks[begin + 1]
            self.defs.append(Def(name.text + ".", t.start, t.start, name.end, self.toks[self.i - 1].end))

    def _item(self) -> None:
        first = self.tok.start
        self.attributes()
        start = self.tok.start
        if self.tok.kind == "end":
            return
        self.visibility()
        t = self.tok.text if self.tok.kind == "name" else ""
        if t in ("fn", "async", "unsafe", "extern", "const", "default") and self.fn_ahead():
            self.fn(first, start)
        elif t == "struct" or (t == "union" and self.starts_item()):
            self.i += 1
            self.name()
            self.generics()
            if self.at("("):
                self.tuple_fields()
                self.where()
                self.need(";")
            else:
                self.where()
                if not self.eat(";"):
                    self.fields()
        elif t == "enum":
            self.i += 1
            self.name()
            self.generics()
            self.where()
            self.need("{")
            self.list("}", self.variant)
        elif t in ("trait", "unsafe") and (t == "trait" or self.ahead().text == "trait"):
            self.eat("unsafe")
            self.need("trait")
            trait = self.tok.text
            self.name()
            self.generics()
            if self.eat(":"):
                self.bounds()
            if self.eat("="):
                self.bounds()
                self.where()
                self.need(";")
                return
            self.where()
            self.members(trait)
        elif t == "impl" or (t == "unsafe" and self.ahead().text == "impl"):
            self.eat("unsafe")
            self.need("impl")
            if self.at("<") and (self.ahead().kind == "life" or self.ahead().text in (">", "const", "#") or self.ahead().kind == "name"):
                mark = self.i, self.toks
                try:
                    self.generics()
                    if self.at("::"):
                        self.fail()
                except Broken:
                    self.i, self.toks = mark
            self.eat("const")
            self.eat("!")
            mark = self.i
            self.type()
            base = self.type_name(mark)
            owner = base
            if self.eat("for"):
                mark = self.i
                self.type()
                owner = self.type_name(mark)
            else:
                base = ""
            self.where()
            self.members(owner, base)
        elif t == "mod":
            self.i += 1
            self.name()
            if not self.eat(";"):
                self.need("{")
                while not self.at("}"):
                    if self.tok.kind == "end":
                        self.fail("}")
                    self.item()
                self.need("}")
        elif t == "use":
            self.i += 1
            self.use_tree()
            self.need(";")
        elif t == "extern":
            self.i += 1
            if self.eat("crate"):
                if not self.eat("self"):
                    self.name()
                if self.eat("as"):
                    self.underscore_name()
                self.need(";")
            else:
                if self.tok.kind == "str":
                    self.i += 1
                self.members()
        elif t in ("const", "static"):
            self.i += 1
            self.eat("mut")
            self.underscore_name()
            if self.eat(":"):
                self.type()
            if self.eat("="):
                self.expr()
            self.need(";")
        elif t == "type":
            self.type_alias()
        elif t == "macro_rules" and self.ahead().text == "!":
            self.i += 2
            self.name()
            brace = self.at("{")
            if not self.at("(", "[", "{"):
                self.fail("{")
            self.tree()
            if not brace:
                self.need(";")
        elif self.is_name() or self.at("::", *PATH_WORDS):
            self.mod_path()
            self.need("!")
            brace = self.at("{")
            if not self.at("(", "[", "{"):
                self.fail("macro")
            self.tree()
            if not brace:
                self.need(";")
        else:
            self.fail("item")

    def underscore_name(self) -> None:
        self.name()

    def mod_path(self) -> None:
        self.eat("::")
        while True:
            if self.at(*PATH_WORDS):
                self.i += 1
            else:
                self.name()
            if not self.eat("::"):
                return

    def fn_ahead(self) -> bool:
        k = self.i
        while self.toks[k].text in ("const", "async", "unsafe", "extern", "default") or (self.toks[k].kind == "str" and self.toks[k - 1].text == "extern"):
            k += 1
        return self.toks[k].text == "fn" and self.toks[k].kind == "name"

    def type_name(self, mark: int) -> str:
        """Last segment of the path that was read from ``mark`` on."""
        name = ""
        for t in self.toks[mark : self.i]:
            if t.text in ("<", "<<", "(", "["):
                break
            if t.kind == "name" and t.text not in ("dyn", "mut", "impl"):
                name = t.text
        return name

    def fn(self, first: int = 0, start: int = 0, bases: tuple[str, ...] = ()) -> None:
        while not self.eat("fn"):
            self.i += 1
        name = self.tok.text
        self.name()
        self.generics()
        self.need("(")
        self.list(")", self.param)
        if self.eat("->"):
            self.type()
        self.where()
        head = self.toks[self.i - 1].end
        if not self.eat(";"):
            self.inside += 1
            self.block()
            self.inside -= 1
        if not self.inside:
            self.defs.append(Def(f"{self.owner}.{name}" if self.owner else name, first, start, head, self.toks[self.i - 1].end, None, bases))

    def param(self) -> None:
        self.attributes()
        if self.eat("..."):
            return
        mark = self.i
        self.split("&")
        if self.tok.kind == "life":
            self.i += 1
        self.eat("mut")
        if self.eat("self"):
            if self.eat(":"):
                self.type()
            return
        self.i = mark
        self.pattern_single()
        self.need(":")
        if not self.eat("..."):
            self.type()

    def tuple_fields(self) -> None:
        self.need("(")

        def one() -> None:
            self.attributes()
            self.visibility()
            self.type()

        self.list(")", one)

    def fields(self) -> None:
        self.need("{")

        def one() -> None:
            self.attributes()
            self.visibility()
            self.name()
            self.need(":")
            self.type()

        self.list("}", one)

    def variant(self) -> None:
        self.attributes()
        self.visibility()
        self.name()
        if self.at("("):
            self.tuple_fields()
        elif self.at("{"):
            self.fields()
        if self.eat("="):
            self.expr()

    def members(self, owner: str = "", base: str = "") -> None:
        outer, self.owner = self.owner, owner
        self.need("{")
        while not self.at("}"):
            if self.tok.kind == "end":
                self.fail("}")
            first = self.tok.start
            self.attributes()
            start = self.tok.start
            if self.at("}"):
                break
            self.visibility()
            if self.at("default") and self.ahead().text in ("fn", "type", "const", "async", "unsafe"):
                self.i += 1
            if self.fn_ahead():
                self.fn(first, start, (base,) if base else ())
            elif self.at("type"):
                self.type_alias()
            elif self.at("const", "static"):
                self.i += 1
                self.eat("mut")
                self.underscore_name()
                self.need(":")
                self.type()
                if self.eat("="):
                    self.expr()
                self.need(";")
            elif self.is_name() or self.at(*PATH_WORDS, "::"):
                self.mod_path()
                self.need("!")
                brace = self.at("{")
                if not self.at("(", "[", "{"):
                    self.fail("macro")
                self.tree()
                if not brace:
                    self.need(";")
            else:
                self.fail("member")
        self.need("}")
        self.owner = outer

    def type_alias(self) -> None:
        self.need("type")
        self.name()
        self.generics()
        if self.eat(":"):
            self.bounds()
        self.where()
        if self.eat("="):
            self.type()
        self.where()
        self.need(";")

    def use_tree(self) -> None:
        self.eat("::")
        while True:
            if self.eat("*"):
                return
            if self.eat("{"):
                self.list("}", self.use_tree)
                return
            if self.at(*PATH_WORDS):
                self.i += 1
            else:
                self.name()
            if not self.eat("::"):
                break
        if self.eat("as"):
            self.underscore_name()

    # -- types

    def generics(self) -> None:
        if not self.split("<") if self.at("<") else True:
            return

        while not (self.tok.kind == "op" and self.tok.text.startswith(">")):
            self.attributes()
            if self.tok.kind == "life":
                self.i += 1
                if self.eat(":"):
                    self.bounds()
            elif self.eat("const"):
                self.name()
                self.need(":")
                self.type()
                if self.eat("="):
                    self.const_arg()
            else:
                self.name()
                if self.eat(":"):
                    self.bounds()
                if self.eat("="):
                    self.type()
            if not (self.tok.kind == "op" and self.tok.text.startswith(">")):
                self.need(",")
        self.split(">")

    def where(self) -> None:
        if not self.eat("where"):
            return
        while not self.at("{", ";", "="):
            if self.tok.kind == "life":
                self.i += 1
            else:
                self.for_lifetimes()
                self.type()
            self.need(":")
            self.bounds()
            if not self.at("{", ";", "="):
                self.need(",")

    def for_lifetimes(self) -> None:
        if self.at("for") and self.ahead().text == "<":
            self.i += 1
            self.generics()

    def bounds(self) -> None:
        while not self.at(",", ">", "{", ";", "=", ")", "where", ">>", ">=", ">>=", "]", "=>"):
            if self.tok.kind == "life":
                self.i += 1
            elif self.eat("("):
                self.bounds()
                self.need(")")
            elif self.at("use") and self.ahead().text == "<":
                self.i += 1
                self.generics()
            else:
                self.split("~")
                self.eat("const")
                self.eat("?")
                self.for_lifetimes()
                self.type_path()
            if not self.eat("+"):
                break

    def type(self) -> None:
        if self.tok.kind == "op":
            if self.eat("("):
                self.list(")", self.type)
            elif self.eat("!"):
                pass
            elif self.tok.text in ("&", "&&"):
                self.i += 1
                if self.tok.kind == "life":
                    self.i += 1
                self.eat("mut")
                self.type_no_plus()
            elif self.eat("*"):
                self.need("const", "mut")
                self.type_no_plus()
            elif self.eat("["):
                self.type()
                if self.eat(";"):
                    self.expr()
                self.need("]")
            elif self.at("<", "<<"):
                self.type_path()
            elif self.at("::"):
                self.type_path()
            else:
                self.fail("type")
            return
        if self.tok.kind != "name":
            self.fail("type")
        if self.at("dyn", "impl"):
            self.i += 1
            self.bounds()
            return
        self.for_lifetimes()
        if self.at("fn", "unsafe", "extern"):
            self.eat("unsafe")
            if self.eat("extern") and self.tok.kind == "str":
                self.i += 1
            self.need("fn")
            self.need("(")

            def one() -> None:
                self.attributes()
                if self.eat("..."):
                    return
                if self.is_name() and self.ahead().text == ":":
                    self.i += 2
                self.type()

            self.list(")", one)
            if self.eat("->"):
                self.type_no_plus()
            return
        self.type_path()
        if self.at("!") and self.ahead().text in ("(", "[", "{"):
            self.i += 1
            self.tree()
        elif self.at("+"):
            pass

    def type_no_plus(self) -> None:
        self.type()

    def type_path(self) -> None:
        if self.tok.kind == "op" and self.tok.text in ("<", "<<"):
            self.split("<")
            self.type()
            if self.eat("as"):
                self.type_path()
            if not self.split(">"):
                self.fail(">")
            self.need("::")
        else:
            self.eat("::")
        while True:
            if self.at(*PATH_WORDS):
                self.i += 1
            else:
                self.name()
            if self.at("::") and self.ahead().text in ("<", "<<"):
                self.i += 1
            if self.tok.kind == "op" and self.tok.text in ("<", "<<"):
                self.generic_args()
            elif self.at("("):
                self.need("(")
                self.list(")", self.type)
                if self.eat("->"):
                    self.type_no_plus()
            if not self.eat("::"):
                return

    def generic_args(self) -> None:
        self.split("<")
        while not (self.tok.kind == "op" and self.tok.text.startswith(">")):
            if self.tok.kind == "life":
                self.i += 1
            elif self.tok.kind in ("num", "str", "char") or self.at("-", "{", "true", "false"):
                self.const_arg()
            else:
                self.type()
                if self.eat("="):
                    if self.tok.kind in ("num", "str", "char") or self.at("-", "{", "true", "false"):
                        self.const_arg()
                    else:
                        self.type()
                elif self.eat(":"):
                    self.bounds()
            if not (self.tok.kind == "op" and self.tok.text.startswith(">")):
                self.need(",")
        self.split(">")

    def const_arg(self) -> None:
        if self.at("{"):
            self.block()
        else:
            self.eat("-")
            if self.at("true", "false") or self.tok.kind in ("num", "str", "char", "name"):
                self.i += 1
            else:
                self.fail("constant")

    # -- patterns

    def pattern(self) -> None:
        self.eat("|")
        self.pattern_single()
        while self.eat("|"):
            self.pattern_single()

    def pattern_single(self) -> None:
        t = self.tok
        if t.kind in ("num", "str", "char") or self.at("-", "true", "false"):
            self.eat("-")
            self.i += 1
            self.range_tail()
        elif self.at("..", "..="):
            self.i += 1
            if self.tok.kind in ("num", "char") or self.at("-"):
                self.eat("-")
                self.i += 1
        elif t.kind == "op" and t.text in ("&", "&&"):
            self.i += 1
            self.eat("mut")
            self.pattern_single()
        elif self.eat("("):
            self.list(")", self.pattern)
        elif self.eat("["):
            self.list("]", self.pattern)
        elif self.at("box"):
            self.i += 1
            self.pattern_single()
        elif self.at("ref", "mut"):
            self.eat("ref")
            self.eat("mut")
            self.name()
            if self.eat("@"):
                self.pattern_single()
        elif self.at("const") and self.ahead().text == "{":
            self.i += 1
            self.block()
        else:
            simple = self.is_name()
            self.path_expr()
            if self.at("!") and self.ahead().text in ("(", "[", "{"):
                self.i += 1
                self.tree()
            elif self.eat("("):
                self.list(")", self.pattern)
            elif self.eat("{"):

                def one() -> None:
                    self.attributes()
                    if self.eat(".."):
                        return
                    if (self.is_name() or self.tok.kind == "num") and self.ahead().text == ":":
                        self.i += 2
                        self.pattern()
                    else:
                        self.eat("ref")
                        self.eat("mut")
                        self.name()

                self.list("}", one)
            elif simple and self.eat("@"):
                self.pattern_single()
            else:
                self.range_tail()

    def range_tail(self) -> None:
        if self.at("..=", "...", ".."):
            self.i += 1
            if self.tok.kind in ("num", "char") or self.at("-"):
                self.eat("-")
                self.i += 1
            elif self.is_name() or self.at(*PATH_WORDS):
                self.path_expr()

    # -- expressions

    def block(self) -> None:
        self.need("{")
        while not self.at("}"):
            if self.tok.kind == "end":
                self.fail("}")
            if self.eat(";"):
                continue
            self.statement()
        self.need("}")

    def statement(self) -> None:
        self.attributes()
        if self.at("}"):
            return
        if self.at("let"):
            self.i += 1
            self.pattern()
            if self.eat(":"):
                self.type()
            if self.eat("="):
                self.expr()
                if self.eat("else"):
                    self.block()
            self.need(";")
            return
        if self.starts_item():
            self.item()
            return
        if self.block_like():
            closed = self.block_expr()
            if closed and not self.at(".", "?") and not (self.tok.kind == "op" and self.tok.text in ()):
                self.eat(";")
                return
            self.postfix_tail()
            self.operators(0, False)
        elif (self.is_name() or self.at(*PATH_WORDS)) and self.macro_statement():
            return
        else:
            self.expr()
        if not self.eat(";") and not self.at("}"):
            self.fail(";")

    def macro_statement(self) -> bool:
        """path!{...} ends a statement by itself."""
        k = self.i
        while self.toks[k].kind == "name" and self.toks[k + 1].text == "::":
            k += 2
        if self.toks[k].kind == "name" and self.toks[k + 1].text == "!" and self.toks[min(k + 2, len(self.toks) - 1)].text == "{":
            self.i = k + 2
            self.tree()
            if self.at(".", "?"):
                self.postfix_tail()
                self.operators(0, False)
                return False if not self.eat(";") and not self.at("}") else True
            self.eat(";")
            return True
        return False

    def block_like(self) -> bool:
        t = self.tok
        if t.kind == "life":
            return self.ahead().text == ":"
        if self.at("{", "if", "match", "while", "loop", "for"):
            return not (self.at("for") and self.ahead().text == "<")
        return (self.at("unsafe") and self.ahead().text == "{") or (self.at("const") and self.ahead().text == "{") or (self.at("async") and (self.ahead().text == "{" or (self.ahead().text == "move" and self.ahead(2).text == "{")))

    def block_expr(self) -> bool:
        if self.tok.kind == "life":
            self.i += 1
            self.need(":")
        if self.eat("unsafe", "const"):
            self.block()
        elif self.eat("async"):
            self.eat("move")
            self.block()
        elif self.at("{"):
            self.block()
        elif self.eat("loop"):
            self.block()
        elif self.eat("while"):
            self.expr(no_struct=True)
            self.block()
        elif self.eat("for"):
            self.pattern()
            self.need("in")
            self.expr(no_struct=True)
            self.block()
        elif self.eat("if"):
            self.expr(no_struct=True)
            self.block()
            if self.eat("else"):
                if self.at("if"):
                    self.block_expr()
                else:
                    self.block()
        elif self.eat("match"):
            self.expr(no_struct=True)
            self.need("{")
            while self.at("#"):
                self.attributes()
            while not self.at("}"):
                self.attributes()
                self.pattern()
                if self.eat("if"):
                    self.expr()
                self.need("=>")
                if self.block_like():
                    plain = self.at("{")
                    self.block_expr()
                    if self.at(".", "?"):
                        self.postfix_tail()
                        self.operators(0, False)
                        plain = False
                    elif not plain and self.tok.kind == "op" and self.tok.text in _BINARY:
                        self.operators(0, False)
                    elif plain:
                        self.eat(",")
                        continue
                    if not self.eat(",") and not self.at("}"):
                        continue
                else:
                    self.expr()
                    if not self.at("}"):
                        self.need(",")
            self.need("}")
        else:
            self.fail("expression")
        return True

    def expr(self, no_struct: bool = False) -> None:
        if self.at("..", "..="):
            self.i += 1
            if self.starts_expr(no_struct):
                self.binary(1, no_struct)
        else:
            self.binary(1, no_struct)
        self.operators(0, no_struct)

    def operators(self, least: int, no_struct: bool) -> None:
        """Binary operators after a first operand, then ranges and assignments."""
        self.binary_tail(1, no_struct)
        if self.at("..", "..="):
            self.i += 1
            if self.starts_expr(no_struct):
                self.binary(1, no_struct)
        if self.tok.kind == "op" and self.tok.text in _ASSIGN:
            self.i += 1
            self.expr(no_struct)

    def starts_expr(self, no_struct: bool) -> bool:
        t = self.tok
        if t.kind in ("num", "str", "char", "life"):
            return True
        if t.kind == "name":
            return t.text not in ("as", "else", "in", "where")
        if t.kind == "op":
            return t.text in ("(", "[", "-", "*", "!", "&", "&&", "|", "||", "<", "::") or (t.text == "{" and not no_struct)
        return False

    def binary(self, least: int, no_struct: bool) -> None:
        if self.eat("let"):
            self.pattern()
            self.need("=")
            self.binary(3, no_struct)
        else:
            self.unary(no_struct)
        self.binary_tail(least, no_struct)

    def binary_tail(self, least: int, no_struct: bool) -> None:
        while True:
            if self.at("as"):
                self.i += 1
                self.type()
                continue
            t = self.tok
            if t.kind != "op":
                return
            p = _BINARY.get(t.text, 0)
            if p < least or p == 0:
                return
            self.i += 1
            self.binary(p + 1, no_struct)
            if p == 3 and self.tok.kind == "op" and _BINARY.get(self.tok.text) == 3:
                self.fail("comparison cannot be chained")

    def unary(self, no_struct: bool) -> None:
        while self.tok.kind == "op" and self.tok.text in ("-", "*", "!", "&", "&&"):
            amp = self.tok.text in ("&", "&&")
            self.i += 1
            if amp:
                if self.at("raw") and self.ahead().text in ("const", "mut"):
                    self.i += 2
                else:
                    self.eat("mut")
        self.primary(no_struct)
        self.postfix_tail()

    def postfix_tail(self) -> None:
        while True:
            if self.eat("?"):
                continue
            if self.eat("."):
                if self.eat("await"):
                    continue
                if self.tok.kind == "num":
                    self.i += 1
                    continue
                if self.at(*PATH_WORDS):
                    self.fail("field")
                self.name()
                if self.at("::"):
                    self.i += 1
                    self.generic_args()
                    if not self.at("("):
                        self.fail("(")
                continue
            if self.eat("("):
                self.list(")", self.arg)
                continue
            if self.eat("["):
                self.expr()
                self.need("]")
                continue
            return

    def arg(self) -> None:
        self.attributes()
        self.expr()

    def path_expr(self) -> None:
        if self.tok.kind == "op" and self.tok.text in ("<", "<<"):
            self.split("<")
            self.type()
            if self.eat("as"):
                self.type_path()
            if not self.split(">"):
                self.fail(">")
            self.need("::")
        else:
            self.eat("::")
        while True:
            if self.at(*PATH_WORDS):
                self.i += 1
            else:
                self.name()
            if not self.eat("::"):
                return
            if self.tok.kind == "op" and self.tok.text in ("<", "<<"):
                self.generic_args()
                if not self.eat("::"):
                    return

    def closure(self) -> None:
        if self.at("for"):
            self.for_lifetimes()
        self.eat("const")
        self.eat("static")
        self.eat("async")
        self.eat("move")
        if not self.eat("||"):
            self.need("|")

            def one() -> None:
                self.attributes()
                self.pattern_single()
                if self.eat(":"):
                    self.type()

            self.list("|", one)
        if self.eat("->"):
            self.type()
            self.block()
        else:
            self.expr()

    def primary(self, no_struct: bool) -> None:
        t = self.tok
        if t.kind in ("num", "str", "char"):
            self.i += 1
        elif self.block_like():
            self.block_expr()
        elif self.at("|", "||", "move", "static") or (self.at("async") and self.ahead().text in ("|", "||", "move")) or (self.at("for") and self.ahead().text == "<"):
            self.closure()
        elif self.at("true", "false"):
            self.i += 1
        elif self.eat("return", "yield"):
            if self.starts_expr(no_struct):
                self.expr(no_struct)
        elif self.eat("break"):
            if self.tok.kind == "life":
                self.i += 1
            if self.starts_expr(no_struct):
                self.expr(no_struct)
        elif self.eat("continue"):
            if self.tok.kind == "life":
                self.i += 1
        elif self.eat("("):
            self.list(")", self.arg)
        elif self.eat("["):
            if not self.at("]"):
                self.arg()
                if self.eat(";"):
                    self.expr()
                    self.need("]")
                    return
                if not self.at("]"):
                    self.need(",")
            self.list("]", self.arg)
        else:
            self.path_expr()
            if self.at("!") and self.ahead().text in ("(", "[", "{"):
                self.i += 1
                self.tree()
            elif self.at("{") and not no_struct and self.struct_ahead():
                self.need("{")

                def one() -> None:
                    self.attributes()
                    if self.eat(".."):
                        if not self.at("}"):
                            self.expr()
                        return
                    if self.tok.kind == "num":
                        self.i += 1
                        self.need(":")
                        self.expr()
                        return
                    self.name()
                    if self.eat(":"):
                        self.expr()

                self.list("}", one)

    def struct_ahead(self) -> bool:
        a, b = self.ahead(1), self.ahead(2)
        if a.text == "}" or a.text == ".." or a.text == "#":
            return True
        return (a.kind in ("name", "num")) and b.text in (":", ",", "}")


def parse(text: str) -> list[Def]:
    p = Parser(text)
    p.file()
    return p.defs
