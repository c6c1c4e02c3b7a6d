"""Functions paired with their documentation.

Files are parsed with the local grammars; each function or method comes out with its
code, signature, base types and documentation: the docstring, or else the comment that
ends directly above it.  Documentation that only points to the overridden method, or is
missing on a method whose type has bases, is resolved along the hierarchy of types: each
base is looked up in its own file, else in the repository; the bases of bases are joined
level by level until none is new, also through types that lack the method; of the methods
of that name the nearest documented one counts.  What stays empty is dropped.

Defined cases: files that are not valid in their language give nothing; a file recorded
several times counts once; null contents and unknown languages give nothing; equal
function names in one file are kept once, with the first documented one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from heddle import syntax
from heddle.session import keep

LEAST_WORDS = 4

#: Placeholders that stand for missing documentation (lower case).
PLACEHOLDERS = ["to be written", "todo", "fixme", "xxx", "tbd", "tba", "wip", "n/a", "not documented", "no documentation", "undocumented", "lorem ipsum", "add description", "add documentation", "description goes here", "document this", "document me"]
#: Comments that speak to tools.
DIRECTIVES = re.compile(
    r"^\s*(?:(?:noqa|type:\s*ignore|pylint|pyright|mypy|fmt|isort|yapf|pragma|nosec|flake8|ruff|coverage)\b.*|(?:eslint|tslint|prettier|jshint|jslint|istanbul|c8|v8|stylelint|biome|webpack)[-: ].*|@ts-(?:ignore|expect-error|nocheck|check).*|ts-\w+.*|go:\w+.*|\+build.*|nolint.*|lint:.*|export \w+$|rustfmt.*|clippy.*|@formatter:.*|#region.*|#endregion.*|sourceMappingURL.*)$",
    re.I | re.M,
)
_TAG_PARAM = re.compile(r"[@\\](?:param|arg|argument|property|prop|template|typeparam|tparam|throws|exception|raises)\b\s*(?:\{[^}]*\})?\s*(?:\[[^\]]*\]|[\w.$]+)?\s*-?")
_TAG = re.compile(r"\{@\w+[^}]*\}|[@\\]\w+\b\s*(?:\{[^}]*\})?")
_FIELD = re.compile(r"^\s*:(?:param|type|raises|return|returns|rtype|keyword|arg|ivar|var)[^:]*:", re.M)
_SECTION = re.compile(r"^\s*(?:#+\s*)?(?:args|arguments|parameters|params|returns|return|raises|yields|yield|throws|attributes|examples?|notes?|errors|panics|safety|see also|warns|other parameters)\s*:?\s*$", re.I | re.M)
_NAMED = re.compile(r"^\s*(?:[-*]\s*)?`?\*{0,2}\w+`?(?:\s*\([^)]*\))?\s*:(?=\s|$)", re.M)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_MARKS = re.compile(r"^[ \t]*(?:/\*+!?|\*+/|///?!?|//+|\*(?!/)|#+!?)[ \t]?|[ \t]*\*+/[ \t]*$", re.M)
_INHERIT = re.compile(r"\{?@inherit_?doc\}?|@override\b|see (?:the )?(?:base|parent|super) ?(?:class|type|method)?", re.I)
_CODE_LINE = re.compile(
    r"[;{}]\s*$|^[)\]}]+[,;]?$|^(?:if|elif|else|for|while|switch|case|match|try|except|catch|finally|with|def|func|fn|function|class|async|return|import|from|const|let|var|pub|use|throw|raise)\b.*[=(){}\[\];:]\s*\w*[,;:]?$"
    r"|^[\w.$\[\]'\"&*]+\s*(?::=|[-+*/|&^%]?=(?!=))\s*\S|^[\w.$:!]+\([^)]*\)?[;,]?$|^[\w.$]+\[[^\]]*\]|^return\b|=>|^[\w'\"]+,$|^@\w+(?:\.\w+)*(?:\(.*\))?$|^[\w.$:!]+\(.*\)[;,]?$|^(?:pass|break|continue)$"
)


def strip_marks(comment: str) -> str:
    """The text of a comment without its marks."""
    return _MARKS.sub("", comment)


def is_code(text: str) -> bool:
    """Whether most lines of a comment read as code."""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    if not lines:
        return False
    return sum(bool(_CODE_LINE.search(x)) for x in lines) * 2 >= len(lines) + (len(lines) == 1)


def own_words(name: str) -> set[str]:
    last = name.rsplit(".", 1)[-1]
    return {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+", last)} | {last.lower()}


def words_left(text: str, name: str) -> int:
    """Words that say something: without tags, placeholders, directives and the function's own name."""
    text = DIRECTIVES.sub(" ", text)
    for p in (_TAG_PARAM, _TAG, _FIELD, _SECTION, _NAMED):
        text = p.sub(" ", text)
    low = text.lower()
    for p in PLACEHOLDERS:
        low = re.sub(rf"(?<!\w){re.escape(p)}(?!\w)(?:[:\s]+(?:document|describe|write|explain|docs?|description)\w*)?", " ", low)
    own = own_words(name)
    n = 0
    for w in _WORD.findall(low):
        if w not in own:
            n += len(w) if re.match(r"[぀-ヿ一-鿿]", w) else 1  # scripts without spaces: by letter
    return n


def says_something(text: str | None, name: str) -> bool:
    return bool(text) and not is_code(text) and words_left(text, name) >= LEAST_WORDS


def comment_above(text: str, at: int, hash_marks: bool) -> str | None:
    """The comment that ends directly above (or before) ``at``, with further comments that
    touch it from above."""
    end = at
    parts: list[str] = []
    while True:
        gap = len(text[:end].rstrip(" \t"))
        head = text[:gap]
        if head.endswith("\n"):
            head = head[:-1].rstrip(" \t")
            if not head or head.endswith("\n"):
                break
        elif not head.endswith("*/"):
            break
        line_start = head.rfind("\n") + 1
        line = head[line_start:].lstrip()
        if not hash_marks and head.endswith("*/"):
            start = head.rfind("/*")
            if start < 0:
                break
            before = head[head.rfind("\n", 0, start) + 1 : start]
            if before.strip():
                break
            parts.append(head[start:])
            end = start
        elif line.startswith("#" if hash_marks else "//"):
            parts.append(line)
            end = line_start
        else:
            break
    return "\n".join(reversed(parts)) if parts else None


def pairs_of(text: str, language: str) -> list[tuple[str, str, str, str | None, list[str]]] | None:
    """(qualified name, signature, code, raw documentation, bases) of the functions of a valid file
    and of its types, whose names end in a dot, else None."""
    text = text.replace("\r\n", "\n")
    if text.startswith("﻿"):
        text = text[1:]
    found = syntax.definitions(text, language)
    if found is None:
        return None
    out = []
    for d in found:
        if d.name.endswith("."):
            out.append((d.name, "", "", None, list(d.bases)))
            continue
        doc = d.doc
        if doc is None:
            for at in dict.fromkeys((d.start, d.first)):
                at = at if text[:at].rstrip(" \t").endswith(("\n", "*/")) or not text[:at].strip() else text.rfind("\n", 0, at) + 1
                raw = comment_above(text, at, language == "python")
                if raw:
                    doc = strip_marks(raw)
                    break
        out.append((d.name, re.sub(r"\s+", " ", text[d.start : d.head]).strip(), text[d.first : d.end], doc, list(d.bases)))
    return out


FUNCTIONS = "repo string, source_file string, language string, qualified_name string, signature string, code string, doc string, bases array<string>, own boolean, inherits boolean, points boolean"


def functions(files: DataFrame) -> DataFrame:
    """All functions of valid files; files: (repo, source_file, language, content), one row per file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if not isinstance(r.content, str) or r.language is None:
                    continue
                for name, signature, code, doc, bases in pairs_of(r.content, r.language.lower()) or []:
                    own = says_something(doc, name)
                    points = not own and bool(doc and _INHERIT.search(doc))
                    inherits = not own and "." in name[:-1] and (bool(bases) or points)
                    rows.append((r.repo, r.source_file, r.language, name, signature, code, doc, bases, own, inherits, inherits and points))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FUNCTIONS.split(", ")])

    return files.mapInPandas(run, FUNCTIONS)


def bases(types: DataFrame) -> DataFrame:
    """(repo, source_file, type, base_file, base): each base of each type, where it is defined.

    types: (repo, source_file, type, bases).  A base in the same file goes before others; of several
    files of the repository that define it the smallest counts.
    """
    known = types.select("repo", "source_file", "type").distinct()
    up = types.select("repo", "source_file", "type", F.explode("bases").alias("base")).where("base <> type").distinct()
    here = known.select("repo", "source_file", F.col("type").alias("base"), F.lit(True).alias("here"))
    somewhere = known.groupBy("repo", F.col("type").alias("base")).agg(F.min("source_file").alias("elsewhere"))
    found = up.join(here, ["repo", "source_file", "base"], "left").join(somewhere, ["repo", "base"])
    return found.select("repo", "source_file", "type", F.when(F.col("here"), F.col("source_file")).otherwise(F.col("elsewhere")).alias("base_file"), "base")


def ancestors(start: DataFrame, up: DataFrame) -> DataFrame | None:
    """(repo, source_file, type, base_file, base, level): all types above each type of ``start``, at their
    least distance; None if there are none.  Types that inherit from each other are met once."""
    own = up.select("repo", F.col("source_file").alias("base_file"), F.col("type").alias("base"), F.col("base_file").alias("next_file"), F.col("base").alias("next"))
    keys = ["repo", "source_file", "type", "base_file", "base"]
    step = keep(start.join(up, ["repo", "source_file", "type"]).select(*keys, F.lit(1).alias("level")), "ancestors")
    every, level = step, 1
    if step.isEmpty():
        return None
    while True:
        level += 1
        further = step.join(own, ["repo", "base_file", "base"]).select("repo", "source_file", "type", F.col("next_file").alias("base_file"), F.col("next").alias("base")).distinct()
        step = keep(further.join(every, keys, "left_anti").withColumn("level", F.lit(level)), "ancestors")
        if step.isEmpty():
            return every
        every = every.unionByName(step)


def inherit(fns: DataFrame) -> DataFrame:
    """Resolve inherited documentation along the types of a repository.

    fns: functions and types; adds doc_from: the qualified name that the documentation was
    written for.  Drops types and what has no documentation.
    """
    cut = lambda c, k: F.substring_index(c, ".", k)
    type_of = F.expr("left(qualified_name, length(qualified_name) - length(substring_index(qualified_name, '.', -1)) - 1)")
    is_type = F.col("qualified_name").endswith(".")
    done = fns.where(F.col("own") & ~is_type).withColumn("doc_from", F.col("qualified_name"))
    open_ = fns.where(F.col("inherits") & ~is_type).withColumn("type", type_of).withColumn("method", cut("qualified_name", -1))
    if open_.isEmpty():
        return done
    declared = fns.where(is_type).withColumn("type", F.expr("left(qualified_name, length(qualified_name) - 1)"))
    by_method = fns.where(~is_type & F.col("qualified_name").contains(".")).withColumn("type", type_of)  # languages that name bases at their methods
    types = declared.unionByName(by_method).select("repo", "source_file", "type", "bases")
    above = ancestors(open_.select("repo", "source_file", "type").distinct(), bases(types))
    if above is None:
        return done
    have = done.where(F.col("qualified_name").contains(".")).select("repo", F.col("source_file").alias("base_file"), type_of.alias("base"), cut("qualified_name", -1).alias("method"), F.col("doc").alias("base_doc"))
    hits = open_.select("repo", "source_file", "type", "method", "qualified_name").distinct().join(above, ["repo", "source_file", "type"]).join(have, ["repo", "base_file", "base", "method"])
    nearest = F.min(F.struct("level", F.concat_ws(".", "base", "method").alias("doc_from"), "base_file", "base_doc")).alias("f")
    found = hits.groupBy("source_file", "qualified_name").agg(nearest)
    resolved = open_.join(found, ["source_file", "qualified_name"]).withColumn("doc", F.col("f.base_doc")).withColumn("doc_from", F.col("f.doc_from"))
    return done.unionByName(resolved.select(done.columns))


def documented(files: DataFrame) -> DataFrame:
    """One row per documented function: repo, source_file, language, qualified_name, signature, code, doc,
    own, points (its own comment refers to the method it overrides), doc_from."""
    fns = keep(functions(files), "functions")
    all_ = inherit(fns)
    first = Window.partitionBy("source_file", "qualified_name").orderBy(F.col("own").desc(), F.col("code"))
    return all_.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r", "inherits", "bases")
