"""Files as a source: scan with ignore rules, project roots, parsing into nodes."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from heddle.functions import scalars as S
from heddle.operators import parsing

# Files that mark a project root, by language; a star stands for any name.
MARKERS = {
    "python": ["pyproject.toml", "setup.py", "setup.cfg", "Pipfile"],
    "typescript": ["tsconfig.json"],
    "javascript": ["package.json"],
    "go": ["go.mod"],
    "rust": ["Cargo.toml"],
    "java": ["pom.xml", "build.gradle", "build.gradle.kts"],
    "dotnet": ["*.csproj", "*.sln"],
    "ruby": ["Gemfile"],
}
# Directories in which no project is looked for.
NO_PROJECTS = [".venv", "venv", ".env", "env", "node_modules", ".git", ".hg", ".svn", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".nox", "site-packages", "dist", "build", ".eggs", "obj", "bin"]
# Directories that are never walked into.
SKIP_DIRS = {".git"}


def ignore_regex(line: str) -> tuple[str, bool] | None:
    """(regular expression over paths relative to the ignore file, negated) of one line, or None."""
    rule = line.rstrip("\n").rstrip()
    if not rule or rule.startswith("#"):
        return None
    negated = rule.startswith("!")
    rule = rule[1:] if negated else rule
    rule = rule[1:] if rule.startswith("\\") else rule
    only_dir = rule.endswith("/")
    rule = rule.rstrip("/")
    anchored = "/" in rule
    rule = rule.lstrip("/")
    out, i = "", 0
    while i < len(rule):
        if rule.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif rule.startswith("/**", i) and i + 3 == len(rule):
            out, i = out + "/.*", i + 3
        elif rule[i] == "*":
            out += ".*" if rule.startswith("**", i) else "[^/]*"
            i += 2 if rule.startswith("**", i) else 1
        elif rule[i] == "?":
            out, i = out + "[^/]", i + 1
        elif rule[i] == "[" and (end := rule.find("]", i + 2)) > 0:
            inner = rule[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", end + 1
        else:
            out, i = out + re.escape(rule[i]), i + 1
    return ("" if anchored else "(?:.*/)?") + out + ("/.*" if only_dir else "(?:/.*)?"), negated


class IgnoreRules:
    """Rules of one ignore file; the last that matches decides."""

    def __init__(self, lines: list[str]):
        self.rules = [(re.compile(r[0]), r[1]) for line in lines if (r := ignore_regex(line))]

    def ignores(self, path: str) -> bool:
        hit = False
        for pattern, negated in self.rules:
            if pattern.fullmatch(path):
                hit = not negated
        return hit


def list_files(roots: list[str], ignore: list[str] = (), respect_ignore_files: bool = True, follow_links: bool = False) -> tuple[list[tuple[str, int]], list[str]]:
    """((path, size) of every file, missing roots): ignore files of the roots' ancestors up to the
    repository and of every directory on the way apply; a path is out if any of them ignores it.
    ``ignore`` are further patterns relative to each root."""
    found: list[tuple[str, int]] = []
    missing: list[str] = []
    extra = IgnoreRules(list(ignore))

    def rules_of(folder: str) -> tuple[str, IgnoreRules] | None:
        p = os.path.join(folder, ".gitignore")
        if respect_ignore_files and os.path.isfile(p):
            with open(p, encoding="utf-8", errors="replace") as f:
                return folder, IgnoreRules(f.readlines())
        return None

    def out(path: str, is_dir: bool, active: list[tuple[str, IgnoreRules]], root: str) -> bool:
        tail = "/x" if is_dir else ""
        if extra.ignores(os.path.relpath(path, root).replace(os.sep, "/") + tail):
            return True
        return any(r.ignores(os.path.relpath(path, base).replace(os.sep, "/") + tail) for base, r in active)

    for root in roots:
        if not os.path.exists(root):
            missing.append(root)
            continue
        active: list[tuple[str, IgnoreRules]] = []
        up = os.path.dirname(os.path.abspath(root))
        above = []
        while True:
            above.append(up)
            if os.path.isdir(os.path.join(up, ".git")) or os.path.dirname(up) == up:
                break
            up = os.path.dirname(up)
        if os.path.isdir(os.path.join(above[-1], ".git")) and not os.path.isdir(os.path.join(root, ".git")):
            active = [r for a in reversed(above) if (r := rules_of(a))]
        stack = [(root, active)]
        while stack:
            folder, rules = stack.pop()
            here = rules_of(folder)
            rules = [*rules, here] if here else rules
            for entry in sorted(os.scandir(folder), key=lambda e: e.name):
                if entry.is_symlink() and not follow_links:
                    continue
                if entry.is_dir(follow_symlinks=follow_links):
                    if entry.name not in SKIP_DIRS and not out(entry.path, True, rules, root):
                        stack.append((entry.path, rules))
                elif entry.is_file(follow_symlinks=follow_links) and not out(entry.path, False, rules, root):
                    found.append((entry.path, entry.stat().st_size))
    return sorted(found), missing


def scan(spark: SparkSession, roots: list[str], **rules) -> tuple[DataFrame, list[str]]:
    """((path, size_bytes), missing roots): the driver lists, executors read."""
    found, missing = list_files(roots, **rules)
    return spark.createDataFrame(found, "path string, size_bytes long"), missing


def scan_bulk(spark: SparkSession, root: str, ignore: list[str] = ()) -> DataFrame:
    """(path, size_bytes, content) of a whole tree read by the executors; patterns apply to relative paths."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^file:/*", "/")
    rel = F.regexp_replace(path, "^" + re.escape(root.rstrip("/")) + "/", "")
    files = raw.select(path.alias("path"), rel.alias("rel"), F.col("length").alias("size_bytes"), F.decode("content", "UTF-8").alias("content"))
    files = files.where(~F.col("rel").rlike(r"(?:^|/)\.git/"))
    for line in ignore:
        if (r := ignore_regex(line)) and not r[1]:
            files = files.where(~F.col("rel").rlike(f"^{r[0]}$"))
    return files.drop("rel")


def project_roots(files: DataFrame) -> DataFrame:
    """(path, language, marker_file): each folder with a marker file, one row per folder and language.

    Nested projects stay; what lies below a folder of installed packages or build output is
    none. Of several markers of a language the first by name counts.
    """
    name = F.element_at(F.split("path", "/"), -1)
    marker = lambda m: name.endswith(m[1:]) if m.startswith("*") else name == m
    found = [F.when(S._any([marker(m) for m in ms]), F.lit(language)) for language, ms in MARKERS.items()]
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    hit = files.where(~F.arrays_overlap(F.split(folder, "/"), F.array(*map(F.lit, NO_PROJECTS))))
    hit = hit.select(folder.alias("dir"), name.alias("marker_file"), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("language"))
    return hit.groupBy(F.col("dir").alias("path"), "language").agg(F.min("marker_file").alias("marker_file"))


def read_nodes(spark: SparkSession, files: DataFrame, base: str = "") -> DataFrame:
    """Nodes of every readable file in a known language; files: (path, size_bytes).

    Executors read their files themselves; files that cannot be read give nothing.
    """
    prefix = base.rstrip("/") + "/" if base else ""
    keep_ = files.where(S.detect_language(F.col("path")).isNotNull() & ~S.is_minified(F.col("path"))).withColumn("language", S.detect_language(F.col("path")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, language in zip(b["path"], b["language"]):
                try:
                    with open(path, encoding="utf-8", errors="replace", newline="") as f:
                        rows.append((path[len(prefix) :] if path.startswith(prefix) else path, language, f.read()))
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=["file_path", "language", "content"])

    return parsing.parse(keep_.mapInPandas(run, "file_path string, language string, content string"))
