"""Lexer-state maps and bracket summaries of text chunks.

A chunk cannot know in which lexer state it begins, so it is scanned from every state its
language has.  The result maps each entry state to the exit state and to a bracket
summary: the closing brackets that match nothing inside the chunk and the opening ones
left over.  Summaries of neighbouring chunks compose associatively, so chunks of one
file can be reduced in any grouping, on any task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

CODE = "code"
_CLOSER = {"(": ")", "[": "]", "{": "}"}

#: Per language: pattern that leaves the code state, and per state the pattern that ends it.
#: A line that ends inside a "short" state is an error there.
_RULES: dict[str, tuple[re.Pattern[str], dict[str, re.Pattern[str]], frozenset[str]]] = {}


def _rule(name: str, enter: str, leave: dict[str, str], short: str = "") -> None:
    _RULES[name] = (re.compile(enter, re.S), {k: re.compile(v, re.S) for k, v in leave.items()}, frozenset(short.split()))


_rule(
    "python",
    r"(?P<comment>\#[^\n]*)|(?P<ft3>(?<!\w)(?:[fF][rR]?|[rR][fF])\"\"\")|(?P<fa3>(?<!\w)(?:[fF][rR]?|[rR][fF])''')|(?P<fq>(?<!\w)(?:[fF][rR]?|[rR][fF])\")|(?P<fa>(?<!\w)(?:[fF][rR]?|[rR][fF])')"
    r"|(?P<t3>\"\"\")|(?P<a3>''')|(?P<q>\")|(?P<a>')|(?P<o>[(\[{])|(?P<c>[)\]}])",
    {"t3": r"(?:\\.|(?!\"\"\").)*?\"\"\"", "a3": r"(?:\\.|(?!''').)*?'''", "q": r"(?:\\.|[^\"\\\n])*\"", "a": r"(?:\\.|[^'\\\n])*'", "ft3": "", "fa3": "", "fq": "", "fa": ""},
    "q a fq fa",
)
#: Marks that end a formatted string of Python, by state.
_FORMATTED = {"ft3": '"""', "fa3": "'''", "fq": '"', "fa": "'"}
_rule(
    "go",
    r"(?P<comment>//[^\n]*)|(?P<char>'(?:\\.|[^'\\\n])+')|(?P<block>/\*)|(?P<raw>`)|(?P<q>\")|(?P<o>[(\[{])|(?P<c>[)\]}])",
    {"block": r".*?\*/", "raw": r"[^`]*`", "q": r"(?:\\.|[^\"\\\n])*\""},
    "q",
)
_rule(
    "json",
    r"(?P<q>\")|(?P<o>[\[{])|(?P<c>[\]}])",
    {"q": r"(?:\\.|[^\"\\\n])*\""},
    "q",
)
_rule(
    "toml",
    r"(?P<comment>\#[^\n]*)|(?P<t3>\"\"\")|(?P<a3>''')|(?P<q>\")|(?P<a>')|(?P<o>[\[{])|(?P<c>[\]}])",
    {"t3": r"(?:\\.|(?!\"\"\").)*?\"{3,5}", "a3": r".*?'{3,5}", "q": r"(?:\\.|[^\"\\\n])*\"", "a": r"[^'\n]*'"},
    "q a",
)


#: Depths of nested comments and hashes of raw strings that have states of their own in Rust.
_DEPTHS, _HASHES = 9, 5
_rule(
    "rust",
    r"(?P<comment>//[^\n]*)|(?P<b1>/\*)|"
    + "|".join(rf"(?P<r{n}>(?<!\w)(?:br|cr|r){'#' * n}\")" for n in range(_HASHES, -1, -1))
    + r"|(?P<char>b?'(?:\\(?:u\{[0-9a-fA-F_]+\}|x[0-9a-fA-F]{2}|.)|[^\\'\n])')|(?P<life>'[^\W\d]\w*)|(?P<q>\")|(?P<o>[(\[{])|(?P<c>[)\]}])",
    {f"b{n}": "" for n in range(1, _DEPTHS + 1)} | {f"r{n}": rf".*?\"{'#' * n}" for n in range(_HASHES + 1)} | {"q": r"(?:\\.|[^\"\\])*\""},
)
_NESTING = re.compile(r"/\*|\*/")


def _comment(text: str, i: int, depth: int) -> tuple[int, int]:
    """(depth, place) where a comment that may hold others ends, or where the text does."""
    while depth and (m := _NESTING.search(text, i)):
        i, depth = m.end(), min(_DEPTHS, depth + (1 if m.group() == "/*" else -1))
    return depth, i


@dataclass(frozen=True)
class Summary:
    """Exit state and brackets for one entry state; broken: an error inside the chunk."""

    exit: str
    close: str
    open: str
    broken: bool


def states_of(language: str) -> list[str]:
    """Entry states of a language; empty where the lexer needs the grammar (ECMAScript, YAML)."""
    rule = _RULES.get(language)
    return [CODE, *(s for s in rule[1] if s not in rule[2])] if rule else []


def _formatted(text: str, i: int, mark: str) -> int | None:
    """End of a formatted string whose literal part goes on at i: fields in braces are code, in which
    strings of any kind, and fields of those, may stand; None if it does not end."""
    while i < len(text):
        if text.startswith(mark, i):
            return i + len(mark)
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "\n" and len(mark) == 1:
            return None
        elif c == "{" and not text.startswith("{{", i):
            end = _field(text, i + 1, mark)
            if end is None:
                return None
            i = end
        else:
            i += 2 if text.startswith("{{", i) else 1
    return None


_IN_FIELD = re.compile(r"(?P<f>(?<!\w)(?:[fF][rR]?|[rR][fF]))?(?P<q>\"\"\"|'''|\"|')|(?P<o>[(\[{])|(?P<c>[)\]}])|(?P<comment>\#[^\n]*)|(?P<spec>:)|(?P<not>!=|:=)")


def _field(text: str, i: int, mark: str) -> int | None:
    """End of a replacement field that begins at i, after its brace."""
    depth = 0
    while m := _IN_FIELD.search(text, i):
        i, kind = m.end(), m.lastgroup
        if m.group("q"):
            q = m.group("q")
            if m.group("f"):
                end = _formatted(text, i, q)
            else:
                at = _RULES["python"][1]["t3" if q == '"""' else "a3" if q == "'''" else "q" if q == '"' else "a"].match(text, i)
                end = at.end() if at else None
            if end is None:
                return None
            i = end
        elif kind == "o":
            depth += 1
        elif kind == "c":
            if depth == 0:
                return i if m.group() == "}" else None
            depth -= 1
        elif kind == "spec" and depth == 0:  # the format: literal text with fields of its own
            while i < len(text) and text[i] != "}":
                if text.startswith(mark, i) or (text[i] == "\n" and len(mark) == 1):
                    return None
                if text[i] == "{":
                    end = _field(text, i + 1, mark)
                    if end is None:
                        return None
                    i = end
                else:
                    i += 1
            return i + 1 if i < len(text) else None
    return None


def _scan(language: str, text: str, state: str) -> Summary:
    enter, leave, short = _RULES[language]
    close: list[str] = []
    opened: list[str] = []
    i, broken = 0, False
    while True:
        if state != CODE:
            if state[0] == "b" and language == "rust":
                depth, end = _comment(text, i, int(state[1:]))
                state, end = f"b{depth}", end if depth == 0 else None
            elif state in _FORMATTED and language == "python":
                end = _formatted(text, i, _FORMATTED[state])
            else:
                m = leave[state].match(text, i)
                end = m.end() if m else None
            if end is None:
                if state in short:
                    return Summary(CODE, "".join(close), "".join(opened), True)
                return Summary(state, "".join(close), "".join(opened), broken)
            i, state = end, CODE
        m = enter.search(text, i)
        if not m:
            return Summary(CODE, "".join(close), "".join(opened), broken)
        i, kind, value = m.end(), m.lastgroup, m.group()
        if kind == "o":
            opened.append(value)
        elif kind == "c":
            if opened:
                if _CLOSER[opened.pop()] != value:
                    broken = True
            else:
                close.append(value)
        elif kind in leave:
            state = kind


def summarize(language: str, text: str) -> dict[str, Summary]:
    """The lexer-state map of one chunk; chunks must end at a line end."""
    return {s: _scan(language, text, s) for s in states_of(language)}


def combine(left: dict[str, Summary], right: dict[str, Summary]) -> dict[str, Summary]:
    """The map of two neighbouring chunks; associative."""
    out = {}
    for entry, a in left.items():
        b = right[a.exit]
        opened, close, broken = list(a.open), list(a.close), a.broken or b.broken
        for c in b.close:
            if opened:
                if _CLOSER[opened.pop()] != c:
                    broken = True
            else:
                close.append(c)
        out[entry] = Summary(b.exit, "".join(close), "".join(opened) + b.open, broken)
    return out


def balanced(total: dict[str, Summary]) -> bool:
    """Whether a whole file, entered in the code state, ends there with all brackets matched."""
    s = total[CODE]
    return s.exit == CODE and not s.close and not s.open and not s.broken


_OPEN_FIELD = re.compile(r"\{[^{}\n]*$")


def chunks(text: str, size: int) -> list[str]:
    """Pieces of about ``size`` characters that end at line ends; no state ends inside a
    token there, as tokens over several lines are states themselves."""
    out, start = [], 0
    while len(text) - start > size:
        cut = text.find("\n", start + size)
        while cut > 0 and (text[cut - 1] == "\\" or _OPEN_FIELD.search(text, text.rfind("\n", 0, cut) + 1, cut)):
            cut = text.find("\n", cut + 1)  # a continued line stays whole, as does one with an open field
        if cut < 0:
            break
        out.append(text[start : cut + 1])
        start = cut + 1
    out.append(text[start:])
    return out
