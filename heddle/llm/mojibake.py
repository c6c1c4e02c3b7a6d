"""Garbled text from a wrong character encoding: find it and restore the original.

A smoothed character model (hashed trigrams, bigrams and single characters with fixed
table sizes) is counted over all lines that look undamaged.  Each passage, a run of words
in a line, is scored under every candidate chain "encode with the wrong codec, decode
with the right one"; the likeliest is taken if it gains more than a margin that grows
with the letters it changes and is validated for each kind of chain: on all clean lines
with letters beyond ASCII, on the same lines with their letters exchanged as if they were
of a language that the corpus does not hold, and on garbled copies of them.  A chain between codecs of one byte a letter has to
persuade a second judge, who knows no language: the text must lose letters of mixed
scripts, upper case after lower case and signs inside words, or else read as the corpus
does around every letter beyond ASCII.

Defined cases: null and empty texts are never affected; repeated rows give the same
result each; U+FFFD left behind by a failed decoding counts as affected, though it
cannot be restored; a garbled sequence named beside its clean form on the same line, or
quoted alone, is a mention and no damage.  Other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from heddle.session import keep

TRI, BI, UNI = 1 << 20, 1 << 18, 1 << 16
ROUNDS = 3
#: Longest bare sequence that counts as quoted, and the marks around it.
MENTION_CHARS, QUOTES = 8, "\"'`()"
#: Stands between words that are scored together.
APART = "\ue000"
#: Characters worked on at once in arrays, and words or lines remembered by a worker.
RUN, REMEMBERED = 200_000, 60_000
#: Gain that any repair needs, and what it costs to enter or leave a garbled run of words.
LEAST_GAIN, SWITCH = 3.0, 1.5
#: Share of clean words that may read worse around their letters beyond ASCII than the floor of support.
RARE = 0.05
#: Letters that a repair must change on a line if only the model, and not the form of the words,
#: speaks for it; fewer do where the words are about the commonest of the corpus.
FEW = 3
#: Digits that count of the support of a word.
DIGITS = 3
#: Margins a changed letter that are tried.
TRIES = [0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0]

#: Single-byte codecs a UTF-8 text may have been read with, most common first (fixed values).
UTF8_READ_AS = ["cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac-roman", "cp852", "koi8-r", "cp866", "cp1253", "cp1254", "iso8859-2", "iso8859-15"]
#: Multi-byte codecs a UTF-8 text may have been read with (fixed values).
UTF8_READ_AS_WIDE = ["cp932", "gb18030", "euc_jp"]
#: (read with, written with) for texts that are not UTF-8 (fixed values).
OTHER = [
    ("cp1252", "cp932"), ("latin-1", "cp932"), ("cp1252", "euc_jp"), ("latin-1", "euc_jp"),
    ("cp1252", "cp1251"), ("latin-1", "cp1251"), ("cp1252", "koi8-r"), ("latin-1", "koi8-r"), ("cp1252", "cp866"), ("latin-1", "cp866"), ("latin-1", "iso8859-5"),
    ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("koi8-r", "cp866"), ("mac-cyrillic", "cp1251"), ("cp1251", "mac-cyrillic"),
    ("cp1252", "cp1250"), ("latin-1", "cp1250"), ("latin-1", "iso8859-2"), ("cp1252", "iso8859-2"), ("cp1250", "cp1252"), ("iso8859-2", "cp1252"), ("cp1250", "iso8859-2"), ("iso8859-2", "cp1250"),
    ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp852", "cp1250"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1250", "cp852"), ("mac-roman", "cp1252"), ("cp1252", "mac-roman"),
    ("cp437", "cp1251"), ("cp850", "cp1251"), ("cp866", "koi8-r"), ("cp1251", "cp1252"),
]
LOST = "�"


@lru_cache(maxsize=None)
def byte_of(codec: str) -> dict[int, int]:
    """Code point to byte of a single-byte codec; bytes it leaves undefined stand for themselves."""
    out = {}
    for b in range(256):
        try:
            out[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            out.setdefault(b, b)
    return out


@lru_cache(maxsize=None)
def char_of(codec: str) -> list[str]:
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


@lru_cache(maxsize=None)
def _encoder(codec: str) -> dict[int, str]:
    """For str.translate: code point to the letter that latin-1 encodes to the byte.

    Latin-1 letters without a byte become a letter that cannot be encoded.
    """
    known = byte_of(codec)
    return {c: "\uffff" for c in range(128, 256) if c not in known} | {c: chr(b) for c, b in known.items() if c > 127}


def to_bytes(text: str, codec: str) -> bytes | None:
    """The bytes that decode to ``text`` under a single-byte codec, or None."""
    try:
        return text.translate(_encoder(codec)).encode("latin-1")
    except UnicodeEncodeError:
        return None


def undo(text: str, read: str, written: str) -> str | None:
    """Encode with the codec it was read with, decode with the one it was written with."""
    if read in UTF8_READ_AS_WIDE:
        try:
            raw = text.encode(read)
        except UnicodeEncodeError:
            return None
    else:
        raw = to_bytes(text, read)
        if raw is None:
            return None
    if written in ("utf-8", "cp932", "euc_jp"):
        try:
            return raw.decode(written)
        except UnicodeDecodeError:
            return None
    table = char_of(written)
    return "".join([table[b] for b in raw])


def possible(text: str) -> bool:
    """Whether a text may be what was written: no control below the blank, no unassigned code point."""
    return text.isprintable() or not any(c < " " or c == "\x7f" or unicodedata.category(c) in ("Cn", "Cs") for c in text)


def garble(text: str, read: str, written: str) -> str | None:
    """The inverse of :func:`undo`, for validation."""
    try:
        raw = text.encode(written)
        return raw.decode(read) if read in UTF8_READ_AS_WIDE else "".join([char_of(read)[b] for b in raw])
    except (UnicodeEncodeError, UnicodeDecodeError):
        return None


# ---------------------------------------------------------------- model


def _points(text: str) -> np.ndarray:
    """Code points; line ends and tabs count as blanks."""
    p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype("uint64")
    return np.maximum(p, np.uint64(32))


def _hashes(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table places of each character with its two, one and no predecessors; p starts with two fillers."""
    a, b, c = p[:-2], p[1:-1], p[2:]
    m1, m2, m3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    bi = b * m2 + c * m3
    tri = bi + a * m1
    mix = lambda h, size: ((h ^ (h >> np.uint64(29))) * m1 >> np.uint64(40)).astype("int64") & (size - 1)
    return mix(tri, TRI), mix(bi, BI), (c % UNI).astype("int64")


def _runs(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts of about RUN characters together, so that no array grows with a batch."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t) + 2
        if size >= RUN:
            yield run
            run, size = [], 0
    if run:
        yield run


def count_table(texts: list[str]) -> np.ndarray:
    """Counts of one batch, all tables end to end."""
    out = np.zeros(TRI + BI + UNI, "int64")
    for run in _runs(texts):
        t, b, u = _hashes(_points("\n\n" + "\n\n".join(run)))
        out[:TRI] += np.bincount(t, minlength=TRI)
        out[TRI : TRI + BI] += np.bincount(b, minlength=BI)
        out[TRI + BI :] += np.bincount(u, minlength=UNI)
    return out


class Model:
    """log P(text) = sum over characters of log(mix of trigram, bigram and single shares)."""

    def __init__(self, table: np.ndarray):
        tri, bi, uni = table[:TRI], table[TRI : TRI + BI], table[TRI + BI :]
        total = max(1, int(uni.sum()))
        self.tri, self.bi = tri.astype("float32"), bi.astype("float32")
        self.total = float(self.bi.sum())
        self.uni = ((uni + 0.02) / (total + 0.02 * UNI)).astype("float32")

    def score(self, words: list[str]) -> np.ndarray:
        """For each word: log likelihood of it and the blank after it, given a blank before it;
        the part of that which falls on letters beyond ASCII and the two after each; their number."""
        return np.concatenate([self._score(run) for run in _runs(words)] or [np.zeros((0, 3))])

    def _score(self, words: list[str]) -> np.ndarray:
        # the letter before the blank is one that no text has: the model falls back to shorter contexts
        p = _points(APART + " " + "".join(f"{w} {APART} " for w in words))
        t, b, u = _hashes(p)
        ctx_tri = np.concatenate([[0], b[:-1]])  # bigram that precedes the third character
        ctx_bi = np.concatenate([[32], u[:-1]])
        # what a table holds beyond the count of its context is another entry in the same place
        n_uni = self.uni[ctx_bi] * self.total
        bi_n = np.minimum(self.bi[b], n_uni)
        p_bi = (bi_n + 2.0 * self.uni[u]) / (n_uni + 2.0)
        n_bi = self.bi[ctx_tri]
        p_tri = (np.minimum(self.tri[t], n_bi) + 1.5 * p_bi) / (n_bi + 1.5)
        logp = np.log(p_tri)
        lengths = np.array([len(w) + 3 for w in words])
        ends = np.cumsum(lengths)
        logp[ends - 1] = logp[ends - 2] = 0.0  # the parting letter and its blank
        odd = p[2:] > 127
        odd[ends - 2] = False
        near = odd | np.concatenate([[False], odd[:-1]]) | np.concatenate([[False, False], odd[:-2]])
        near[ends - 1] = near[ends - 2] = False
        at = ends - lengths
        return np.stack([np.add.reduceat(logp, at), np.add.reduceat(np.where(near, logp, 0.0), at), np.add.reduceat(near.astype(float), at)], 1)


# ---------------------------------------------------------------- form of words

_WORD = re.compile(r"[^\x00-\x20]+")
_CORE = re.compile(r"^[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+$")
#: Signs that may stand between letters.
_JOINS = frozenset("’‘'·–—‐‑…\u00a0\u00ad\u2007\u2009\u200a\u200b\u200c\u200d\u202f\u2060\u3000\ufe0f\ufeff")
#: Typographic signs at which a word is taken apart where it holds garbled and intact parts.
_APART = re.compile("([‘’“”–—…«»\xa0])")
#: Signs that no text sets against a letter, on either side (fixed values).
_STRANGE = frozenset("¤¦¨¯´¸¬¶˛ˇ˘˙˝˚")


@lru_cache(maxsize=1 << 16)
def script(c: str) -> str:
    """Script of a letter, "!" for a sign that is strange beside letters, "" for any other character."""
    if not c.isalpha():
        return "!" if "\x80" <= c <= "\x9f" or "\u2500" <= c <= "\u259f" or c in _STRANGE or unicodedata.category(c) in ("Cn", "Co", "Cs") else ""
    if c < "\u0250" or "\u1e00" <= c <= "\u1eff":
        return "latin"
    if "\u0370" <= c <= "\u03ff" or "\u1f00" <= c <= "\u1fff":
        return "greek"
    if "\u0400" <= c <= "\u052f":
        return "cyrillic"
    return "wide" if c >= "\u3000" else "other"


@lru_cache(maxsize=1 << 17)
def breaks(word: str) -> int:
    """Places where a word is not formed like one of any language: scripts that meet, upper
    case after lower case beyond ASCII, signs between letters."""
    n, before, kind = 0, "", ""
    for k, c in enumerate(word):
        now = script(c)
        if before and not (before.isascii() and c.isascii()):
            if kind == "!" or now == "!":
                n += (kind or now) != "" and (before.isalpha() or c.isalpha())
            elif kind and now:
                if kind != now:
                    n += not ("wide" in (kind, now) and (before if now == "wide" else c).isascii())
                elif before.islower() and c.isupper():
                    n += 1
            elif kind and c not in _JOINS and not c.isdigit() and not unicodedata.combining(c) and word[k + 1 : k + 2].isalpha():
                n += 1  # a sign with a letter on both sides
        before, kind = c, now
    return n


@lru_cache(maxsize=1 << 17)
def beyond(word: str) -> tuple[int, bool]:
    """Number of the characters beyond ASCII, and whether one of them is no letter."""
    odd = [c for c in word if c > "\x7f"]
    return len(odd), not all(map(str.isalpha, odd))


# ---------------------------------------------------------------- repair of lines


@dataclass
class Repair:
    text: str
    gain: float
    chains: tuple[str, ...]
    words: tuple[tuple[str, str], ...]


class Weight(NamedTuple):
    """What speaks for a chain on a line."""

    gain: float
    letters: int
    support: float
    mended: int
    different: int
    signs: bool


@dataclass(frozen=True)
class Margins:
    """Gain asked for each changed letter by kind of chain, and the least support of a restored word."""

    utf8: float = 1.0
    other: float = 1.5
    floor: float = -4.5


@lru_cache(maxsize=None)
def exchanges(k: int) -> dict[int, str] | None:
    """For str.translate: what chain k of OTHER makes of each letter beyond ASCII, for chains of
    one byte a letter; letters that the read codec lacks stay."""
    read, written = OTHER[k]
    if written in ("cp932", "euc_jp"):
        return None
    table = char_of(written)
    return {c: table[b] for c, b in byte_of(read).items() if c > 127 and table[b] != chr(c)}


@lru_cache(maxsize=1 << 15)
def _other_chains(odd: frozenset[str], latin: bool) -> tuple[int, ...]:
    """Chains of OTHER that can apply to words with these letters beyond ASCII: they change one,
    and make no strange sign or foreign script of them where there was none."""
    out = []
    old = sum(script(c) == "!" or (latin and script(c) not in ("latin", "wide", "")) for c in odd)
    for k, (read, _) in enumerate(OTHER):
        table = exchanges(k)
        if table is None:
            if len(odd) > 1 and {ord(c) for c in odd} <= byte_of(read).keys():
                out.append(k)
            continue
        new = [table.get(ord(c), c) for c in odd]
        if not latin and all(script(c) == "!" for c in new):
            out.append(k)  # a word of signs alone
        elif new != list(odd) and sum(script(c) == "!" or (latin and script(c) not in ("latin", "wide", "")) for c in new) <= old:
            out.append(k)
    return tuple(out)


@lru_cache(maxsize=1 << 15)
def _utf8_chains(odd: frozenset[str]) -> tuple[str, ...]:
    """Codecs under which these letters may be bytes of UTF-8: one begins a character, one goes on."""
    out = []
    for read in UTF8_READ_AS:
        at = byte_of(read)
        raw = [at.get(ord(c), 0) for c in odd]
        if any(0xC2 <= b <= 0xF4 for b in raw) and any(0x80 <= b <= 0xBF for b in raw):
            out.append(read)
    if any(c >= "\u2e80" for c in odd):
        out += UTF8_READ_AS_WIDE
    return tuple(out)


def _from_utf8(word: str, read: str) -> str | None:
    """A word with its garbled UTF-8 undone; where it also holds intact signs, its parts one by one."""
    new = undo(word, read, "utf-8")
    if new is not None:
        return new
    parts = _APART.split(word)
    if len(parts) == 1:
        return None
    out = []
    for p in parts:
        new = p if p.isascii() or _APART.fullmatch(p) else undo(p, read, "utf-8")
        if new is None:
            return None
        out.append(new)
    return "".join(out)


class Repairer:
    """Best repair of lines under a model; words and lines are scored in batches."""

    def __init__(self, model: Model, margins: Margins):
        self.model, self.margins = model, margins
        self.scores: dict[str, tuple[float, float, float]] = {}
        self.words: dict[str, tuple[list[tuple[str, str]], dict[int, str]]] = {}

    def _learn(self, texts: set[str]) -> None:
        if len(self.scores) > 4 * REMEMBERED:
            self.scores.clear()
        fresh = sorted(t for t in texts if t not in self.scores)
        self.scores.update(zip(fresh, map(tuple, self.model.score(fresh).tolist())))

    def _word(self, word: str) -> tuple[list[tuple[str, str]], dict[int, str]]:
        """What a word may become: by UTF-8 chains (codec, restored), by the others (number, restored)."""
        if (got := self.words.get(word)) is None:
            if len(self.words) > REMEMBERED:
                self.words.clear()
            utf8, other = [], {}
            odd = frozenset(c for c in word if c > "\x7f")
            old = breaks(word)
            if LOST not in word:
                for read in _utf8_chains(odd):
                    new = _from_utf8(word, read)
                    if new is not None and new != word and breaks(new) <= old and possible(new):
                        utf8.append((read, new))
            for k in _other_chains(odd, any(c.isascii() and c.isalpha() for c in word)):
                table = exchanges(k)
                new = word.translate(table) if table is not None else undo(word, *OTHER[k])
                if table is not None and len(parts := _APART.split(word)) > 1:  # signs may have stayed intact
                    kept = "".join(p if _APART.fullmatch(p) else p.translate(table) for p in parts)
                    new = kept if breaks(kept) < breaks(new) else new
                if new is not None and new != word and breaks(new) <= old and possible(new):
                    other[k] = new
            got = self.words[word] = (utf8, other)
        return got

    def _run(self, order: list[str], k: int, forms: dict[str, tuple[list[tuple[str, str]], dict[int, str]]]) -> dict[str, str]:
        """The words of a line that chain k of OTHER changes: the likeliest way to enter and leave garbled runs."""
        score, clean, dirty = self.scores, (0.0, ()), (-SWITCH, ())
        for w in order:
            new = forms[w][1].get(k)
            gain = score[new][0] - score[w][0] if new is not None else 0.0
            stay, enter = dirty[0], clean[0] - SWITCH
            clean = clean if clean[0] >= dirty[0] - SWITCH else (dirty[0] - SWITCH, dirty[1])
            top = (stay, dirty[1]) if stay >= enter else (enter, clean[1])
            dirty = (top[0] + gain, (*top[1], w) if new is not None else top[1])
        best = max(clean, dirty, key=lambda x: x[0])
        return {w: forms[w][1][k] for w in best[1]}

    def _weigh(self, table: dict[str, str], words: Counter) -> Weight:
        """Gain, changed letters, mean support of the restored words, breaks mended on a line,
        letters of different words, and whether signs take part."""
        score = self.scores
        gain = sum((score[n][0] - score[w][0]) * words[w] for w, n in table.items())
        odd = {w: beyond(w) for w in table}
        letters = sum(n * words[w] for w, (n, _) in odd.items())
        near, n_near = sum(score[n][1] for n in table.values()), sum(score[n][2] for n in table.values())
        mended = sum((breaks(w) - breaks(n)) * words[w] for w, n in table.items())
        signs = any(sign for _, sign in odd.values())
        return Weight(gain, letters, near / n_near if n_near else 0.0, mended, sum(n for n, _ in odd.values()), signs)

    def proposals(self, lines: list[str]) -> dict[str, list[tuple[str, dict[str, str], Weight]]]:
        """Chains that make each line likelier, with the words they change and their weight."""
        order = {line: [w for w in _WORD.findall(line) if not w.isascii()] for line in lines}
        forms = {w: self._word(w) for w in {w for words in order.values() for w in words}}
        texts = set(forms)
        for utf8, other in forms.values():
            texts.update(n for _, n in utf8)
            texts.update(other.values())
        self._learn(texts)
        score = self.scores
        out = {}
        for line, words in order.items():
            tables: dict[str, dict[str, str]] = {}
            hopes: Counter = Counter()
            for w in words:
                utf8, other = forms[w]
                for read, new in utf8:
                    if score[new][0] > score[w][0]:
                        tables.setdefault(f"utf-8 as {read}", {})[w] = new
                for k, new in other.items():
                    hopes[k] += max(0.0, score[new][0] - score[w][0])
            for k, hope in hopes.items():
                if hope > LEAST_GAIN and (table := self._run(words, k, forms)):
                    tables[f"{OTHER[k][1]} as {OTHER[k][0]}"] = table
            if tables:
                counts = Counter(words)
                out[line] = [(name, table, self._weigh(table, counts)) for name, table in tables.items()]
        return out

    def accepts(self, name: str, weight: Weight, margin: float | None = None) -> bool:
        """Whether what speaks for a chain is enough, at the margin of its kind or a given one."""
        supported = weight.support >= self.margins.floor
        if name.startswith("utf-8 as"):
            least = self.margins.utf8 if margin is None else margin
            return (weight.signs or weight.mended > 0 or supported) and weight.gain > max(LEAST_GAIN, least * weight.letters)
        least = self.margins.other if margin is None else margin
        spoken = weight.mended > 0 or (supported and (weight.different >= FEW or weight.support >= self.margins.floor / 2))
        return spoken and weight.gain > max(LEAST_GAIN + SWITCH, least * weight.letters)

    def once(self, lines: list[str]) -> dict[str, Repair]:
        """One step for each line: the likeliest chain among those that gain more than the margin.

        Every chain works word by word, as no codec has a blank inside a character: a UTF-8
        chain changes the words that gain by it, any other the runs of words that do.
        """
        out = {}
        for line, options in self.proposals(lines).items():
            good = [o for o in options if self.accepts(o[0], o[2])]
            if good:
                name, table, weight = max(good, key=lambda o: o[2].gain)
                text = _WORD.sub(lambda m: table.get(m.group(), m.group()), line)
                utf8_words = tuple(sorted(table.items())) if name.startswith("utf-8 as") else ()
                out[line] = Repair(text, weight.gain, (name,), utf8_words)
        return out

    def lines(self, lines: list[str]) -> dict[str, Repair]:
        """Repair of each line that has one, over up to ROUNDS layers; other chains may follow
        where a line holds words garbled in different ways."""
        done: dict[str, Repair] = {}
        todo = {line: line for line in lines}
        for _ in range(ROUNDS):
            step = self.once(sorted(set(todo.values())))
            following = {}
            for origin, now in todo.items():
                if r := step.get(now):
                    p = done.get(origin)
                    done[origin] = Repair(r.text, r.gain + (p.gain if p else 0), (p.chains if p else ()) + r.chains, (p.words if p else ()) + r.words)
                    following[origin] = r.text
            todo = following
            if not todo:
                break
        return {k: v for k, v in done.items() if not mention(k, v)}


def mention(line: str, repair: Repair) -> bool:
    """Whether the line talks about garbled sequences: every changed word stands beside its
    clean form, or is a bare sequence between quotation marks."""
    if not repair.words:
        return False
    present = [_CORE.sub("", w) for w in _WORD.findall(line)]
    for old, new in repair.words:
        if _CORE.sub("", new) in present:
            continue
        core = _CORE.sub("", old)
        at = line.find(core)
        before, after = line[at - 1 : at], line[at + len(core) : at + len(core) + 1]
        if len(core) <= MENTION_CHARS and not any(c.isascii() for c in core) and before in QUOTES and after in QUOTES and before and after:
            continue
        return False
    return True


def lost(line: str) -> bool:
    """U+FFFD inside running text; one that stands alone between quotes or spaces while the
    line has no other is a mention."""
    n = line.count(LOST)
    if n == 0:
        return False
    at = line.index(LOST)
    before, after = line[at - 1 : at], line[at + 1 : at + 2]
    if n == 1 and not before.isalnum() and not after.isalnum():
        return False
    return True


def suspicious(line: str) -> bool:
    """Whether a line may be damaged: lost characters, control codes, words that are not formed
    like words, or that read as UTF-8 under a common codec; such lines are not trained on."""
    if line.isascii():
        return False
    if LOST in line or any("\x80" <= c <= "\x9f" for c in line):
        return True
    for w in set(_WORD.findall(line)):
        if not w.isascii():
            if breaks(w):
                return True
            for read in _utf8_chains(frozenset(c for c in w if c > "\x7f")):
                if read in ("cp1252", "cp1250", "cp1251", "cp437", "cp850", "mac-roman") and (n := undo(w, read, "utf-8")) is not None and len(n) < len(w):
                    return True
    return False


_LETTERS = {
    ("latin", False): [chr(c) for c in range(0xDF, 0x180) if chr(c).islower()],
    ("latin", True): [chr(c) for c in range(0xC0, 0x180) if chr(c).isupper()],
    ("cyrillic", False): [chr(c) for c in range(0x430, 0x460)],
    ("cyrillic", True): [chr(c) for c in range(0x400, 0x430)],
}


def disguise(line: str, seed: int) -> str:
    """The line as if of another language: each letter beyond ASCII becomes another one of its script and case."""
    out = []
    for c in line:
        pool = _LETTERS.get((script(c), c.isupper())) if c > "\x7f" else None
        out.append(pool[(ord(c) * 31 + seed * 17) % len(pool)] if pool else c)
    return "".join(out)


# ---------------------------------------------------------------- Spark


def train(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Count tables over all clean lines: per task one partial table, added up by place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(TRI + BI + UNI, "int64")
        known: dict[str, bool] = {}
        for batch in batches:
            keep: list[str] = []
            for t in batch["text"]:
                if not t:
                    continue
                if t.isascii():
                    keep.append(t)
                    continue
                for line in t.split("\n"):
                    bad = known.get(line)
                    if bad is None:
                        if len(known) > REMEMBERED:
                            known.clear()
                        bad = known[line] = suspicious(line)
                    if not bad:
                        keep.append(line)
            total += count_table(keep)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"place": at.astype("int32"), "n": total[at]})

    rows = docs.select(F.col(text_col).alias("text")).mapInPandas(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    got = rows.toPandas()  # at most TRI + BI + UNI rows, whatever the corpus
    table = np.zeros(TRI + BI + UNI, "int64")
    table[got["place"].to_numpy("int64")] = got["n"].to_numpy("int64")
    return table


_CHAINS = [(r, "utf-8") for r in UTF8_READ_AS] + OTHER
_KINDS, _PARTS = ("utf8", "other"), ("clean", "foreign", "bad")
#: For each kind of chain and part of the lines, how many pass none, the first, the first two ... of TRIES.
_PASSED = (len(_KINDS), len(_PARTS), len(TRIES) + 1)


def turn(line: str) -> int:
    """The chain that a clean line is garbled by, drawn by its text alone."""
    return crc32(line.encode("utf-8", "surrogatepass")) % len(_CHAINS)


def supports(words: list[str], model: Model) -> np.ndarray:
    """How words read around their letters beyond ASCII."""
    got = model.score(words)
    got = got[got[:, 2] > 0]
    return np.round(got[:, 1] / got[:, 2], DIGITS)


def floor_of(values: np.ndarray, counts: np.ndarray) -> float:
    """The support that a share of RARE of all words falls short of; values ascend."""
    if not len(values):
        return Margins.floor
    ends = np.cumsum(counts)
    place = RARE * (int(ends[-1]) - 1)
    low, high = (float(values[np.searchsorted(ends, int(k), side="right")]) for k in (np.floor(place), np.ceil(place)))
    return float(low + (high - low) * (place - np.floor(place)))


def tally(clean: list[str], repairer: Repairer) -> np.ndarray:
    """How many of clean lines, of their copies in an unknown language and of their garbled copies pass each margin."""
    out = np.zeros(_PASSED, "int64")
    parts: list[list[str]] = [clean, [], []]
    for x in clean:
        k = turn(x)
        if (y := disguise(x, k % 7)) != x:
            parts[1].append(y)
        if (y := garble(x, *_CHAINS[k])) and y != x:
            parts[2].append(y)
    for p, lines in enumerate(parts):
        offers = repairer.proposals(lines)
        for line in lines:
            passed = [0, 0]
            for name, _, weight in offers.get(line, ()):
                kind = 0 if name.startswith("utf-8 as") else 1
                while passed[kind] < len(TRIES) and repairer.accepts(name, weight, TRIES[passed[kind]]):
                    passed[kind] += 1
            for kind, n in enumerate(passed):
                out[kind, p, n] += 1
    return out


def margins_of(passed: np.ndarray, floor: float) -> Margins:
    """Margins that tell garbled lines best from clean ones, those of unknown languages among them."""
    hits = passed[:, :, ::-1].cumsum(axis=2)[:, :, ::-1][:, :, 1:]  # lines that pass each of TRIES
    errors = 3 * (hits[:, 0] + hits[:, 1]) - hits[:, 2]
    best = [np.flatnonzero(e == e.min()) for e in errors]
    return Margins(floor=floor, **{kind: TRIES[at[len(at) // 4]] for kind, at in zip(_KINDS, best)})


def judge(clean: list[str], model: Model) -> Margins:
    """The margins by these lines, less those that look damaged."""
    clean = sorted(set(x for x in clean if not suspicious(x)))
    words = sorted({w for x in clean for w in _WORD.findall(x) if not w.isascii()})
    floor = floor_of(*np.unique(supports(words, model), return_counts=True))
    return margins_of(tally(clean, Repairer(model, Margins(floor=floor))), floor)


def validate_margins(docs: DataFrame, shared: Broadcast, text_col: str = "text") -> Margins:
    """The margins by all different clean lines with letters beyond ASCII, as :func:`judge` gives them;
    shared: the count table."""

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = [x for x in batch["line"] if not suspicious(x)]
            yield pd.DataFrame({"line": lines, "turn": [turn(x) for x in lines]})

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"word": sorted({w for x in batch["line"] for w in _WORD.findall(x) if not w.isascii()})})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(shared.value)
        for batch in batches:
            yield pd.DataFrame({"support": supports(list(batch["word"]), model)})

    lines = docs.select(F.explode(F.split(F.col(text_col), "\n")).alias("line")).where("line rlike '[^\\\\x00-\\\\x7f]'").distinct()
    lines = keep(lines.mapInPandas(choose, "line string, turn int"), "clean_lines")
    # supports are rounded, so their number does not grow with the corpus
    got = lines.select("line").mapInPandas(words, "word string").distinct().mapInPandas(read, "support double").groupBy("support").count().toPandas().sort_values("support")
    floor = floor_of(got["support"].to_numpy("float64"), got["count"].to_numpy("int64"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repairer, total = Repairer(Model(shared.value), Margins(floor=floor)), np.zeros(_PASSED, "int64")
        for part in (list(b["line"].iloc[k : k + 500]) for b in batches for k in range(0, len(b), 500)):
            total += tally(part, repairer)
        yield pd.DataFrame({"place": range(total.size), "n": total.ravel()})

    # lines of one chain stand together, as they give the same garbled words
    rows = lines.sortWithinPartitions("turn").select("line").mapInPandas(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    passed = np.zeros(_PASSED, "int64")
    passed.ravel()[rows["place"].to_numpy("int64")] = rows["n"].to_numpy("int64")
    return margins_of(passed, floor)


def repair(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", margins: Margins | None = None) -> DataFrame:
    """(id, restored, chains, n_lines, recoverable) of the affected rows only.

    restored: the text with each affected passage repaired; chains: the distinct chains
    used; recoverable is false where characters were lost (U+FFFD).
    """
    table = train(docs, text_col)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(table.astype("uint32"))  # fixed size, about 5 MB
    if margins is None:
        margins = validate_margins(docs, shared, text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repairer = Repairer(Model(shared.value), margins)
        for batch in (b.iloc[k : k + 500] for b in batches for k in range(0, len(b), 500)):
            split = [(i, t.split("\n")) for i, t in zip(batch["id"], batch["text"]) if isinstance(t, str) and not t.isascii()]
            fixed = repairer.lines(sorted({x for _, ls in split for x in ls if not x.isascii()}))
            rows = []
            for i, ls in split:
                hit = [fixed[x] for x in ls if x in fixed]
                gone = sum(map(lost, ls))
                if hit or gone:
                    text = "\n".join(fixed[x].text if x in fixed else x for x in ls)
                    rows.append((i, text, sorted({c for r in hit for c in r.chains}), len(hit) + gone, not gone))
            yield pd.DataFrame(rows, columns=["id", "restored", "chains", "n_lines", "recoverable"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, restored string, chains array<string>, n_lines int, recoverable boolean").withColumnRenamed("id", id_col)
