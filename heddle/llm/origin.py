"""Generated, minified, third-party and data files among source files.

Per language a character trigram model of identifiers is counted over all files.  Each
file is then described by numbers: the cross-entropy of its identifiers (mangled names
cost many bits), the diversity of its names (templates repeat few), how many bits its
naming style costs under the style of its own repository, line lengths, blanks and the
share of literals; and by what its path, its comments and equal files elsewhere say.

Files that say themselves what they are (a known folder, name or comment) are the labels;
for each kind a logistic regression is fitted on every file twice, with and without these
signs, so that the numbers have to decide where nothing is said.  Only some files of a
kind say so; a probability is therefore divided by its mean over those that do (positive
and unlabelled examples), and marks from MARK on.  Where a file has enough names, its line
lengths and blanks are withheld, so that the names decide (if the model rests on enough).  Each of the three named
signals also marks alone, far beyond what is usual among the files of its language.

Defined cases: null and empty contents are judged by their path alone; repeated rows of
one file count once, and a file is marked if any of its contents is; equal contents in
several repositories count as third-party copies; a file whose language has no model is
judged by path, comments and lines; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from heddle.session import keep

LETTERS = 40  # a-z, digits as one class, _, $, start, end, other
SIZE = LETTERS**3
#: Score from which on a file is marked: its probability over the mean of the files that say so themselves.
MARK = 0.2
#: How much likelier the numbers must make these files than the average one, to mark without a sign;
#: and the probability that marks where they do not.
LIFT, PLAIN = 5.0, 0.5
#: Files that the regressions are fitted on at most, drawn by hash; counts, models and limits cover all.
FIT_ROWS = 20_000
#: Least limits of the named signals that mark alone: bits of a letter beyond the usual, share of
#: different names (numbers apart), bits of a name's style; and the names they need.
MANGLED, TEMPLATE, FOREIGN, LEAST_NAMES = 0.45, 0.3, 3.0, 20
#: Files of a repository and language that show its naming style.
LEAST_FILES = 10
#: A signal marks alone so many times the distance between median and upper quartile beyond the latter.
FENCE = 8
#: Shortest content that counts as a copy when other repositories hold it too.
COPY_CHARS = 200

# Directories that hold third-party code.
VENDOR_DIRS = ["vendor", "third_party", "third-party", "thirdparty", "3rdparty", "node_modules", "bower_components", "jspm_packages", "site-packages", "dist-packages", "godeps", "pods", "carthage", "_vendor", "vendored", "_vendored"]
# Directories that hold third-party code if a library's own folder follows.
VENDOR_PARENTS = ["extern", "externals", "external", "deps", "contrib-libs", "subprojects"]
# Directories that hold generated code.
GENERATED_DIRS = ["__generated__", "generated", "_generated", ".generated", "gen", "autogen", "auto_generated"]
# Directories that hold build output.
BUILD_DIRS = ["build", "dist", "out", "target"]

_GENERATED_NAME = re.compile(r"(?:\.(?:gen|generated|g|pb|pb\.gw|designer|autogen)\.[A-Za-z]+$)|(?:_pb2(?:_grpc)?\.pyi?$)|(?:[._-]generated\.[A-Za-z]+$)|(?:^zz_generated)|(?:\.pb\.[A-Za-z]+$)", re.I)
_MINIFIED_NAME = re.compile(r"[.-]min\.(?:js|mjs|cjs|css)$|[.-]bundle\.(?:js|mjs|cjs|css)$|[.-][0-9a-f]{8,}\.(?:js|mjs|cjs|css)$|\.chunk\.(?:js|css)$|\.prod(?:uction)?\.js$", re.I)
_DATA_NAME = re.compile(r"(?:^|[_-])(?:data|table|blob|dump|dataset|fixture)s?\.[a-z]+$", re.I)
_COMMENT = re.compile(r"^\s*(?://+!?|#+!?|/\*+!?|\*+|<!--|--|;+|%+)\s?(.*?)\s*(?:\*/|-->)?\s*$")
_GENERATED = re.compile(
    r"^(?:this (?:file|code|source|module|class|document) (?:was|is|has been) )?(?:auto(?:matically)?[- ]?)?(?:generated|produced|emitted)(?: automatically| code| file)?\b(?= (?:by|from|with|using|on|via)\b)"
    r"|^code generated\b|^@generated\b|^<auto-?generated|^auto-?generated\b|^(?:this (?:file|code) (?:is|was) )?machine[- ](?:generated|output|made|written)\b|^generated (?:code|file|source)\b|^automatically (?:generated|created)\b",
    re.I,
)
_NO_EDITS = re.compile(r"\bdo not (?:edit|modify|change)\b(?!.*\bbefore\b)|\b(?:edits|changes|modifications)\b.{0,40}\b(?:lost|overwritten|discarded)\b|\binstead of this file\b|\b(?:run|use) `?make \w+`? to (?:rebuild|regenerate|update)\b", re.I)
_UPSTREAM = re.compile(r"^(?:upstream|vendored from|copied from|imported from|taken from|forked from|original(?:ly)? (?:source|from)|origin|source|homepage)\s*[:=]?\s*(?:<?https?://|git@|\S+\.\w{2,}/)|\bwithout (?:local )?(?:changes|modification)s?\b.*\b(?:release|version|v?\d+\.\d+)|\b(?:release|version) v?\d+\.\d+\S*,? imported\b", re.I)
_AUTHORS = re.compile(r"(?:\(c\)|©|copyright)\s*(?:\(c\)|©)?\s*[\d, -]*\s*(?:by )?the ([\w.-]+) (?:authors|contributors|developers|team|project)\b", re.I)
_TITLE = re.compile(r"^@?([\w./-]+?)(?:\.js)? v?\d+\.\d+(?:\.\d+)?(?:[-+][\w.]+)?$")
_LICENCE = re.compile(r"\b(?:distributed|released|licensed|available) under\b", re.I)
_IDENT = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
_NOISE = re.compile(r"-----BEGIN [A-Z ]+-----.*?-----END [A-Z ]+-----|r#+\".*?\"#+|\"\"\".*?\"\"\"|'''.*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|//[^\n]*|#[^\n]*|/\*.*?\*/", re.S)
_NUMBERS = re.compile(r"(?:0x[0-9a-fA-F]+|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*[,\]})]")
_LONG_TEXT = re.compile(r"\"[A-Za-z0-9+/=_-]{40,}\"|'[A-Za-z0-9+/=_-]{40,}'|^[A-Za-z0-9+/=]{48,}$|(?:\\x[0-9a-fA-F]{2}){8,}", re.M)
#: Languages that are code; others hold data and text by nature and need stronger signs.
CODE = frozenset(["python", "typescript", "javascript", "go", "rust", "css", "java", "c", "cpp", "csharp", "ruby", "php"])

_CLASS = np.full(256, 39, "int64")
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz"):
    _CLASS[ord(_c)] = _i
    _CLASS[ord(_c.upper())] = _i
for _c in "0123456789":
    _CLASS[ord(_c)] = 26
_CLASS[ord("_")], _CLASS[ord("$")], _CLASS[10] = 27, 28, 29


def identifiers(text: str) -> list[str]:
    """Names outside strings and comments."""
    return _IDENT.findall(_NOISE.sub(" ", text))


def trigrams(names: list[str]) -> np.ndarray:
    """Places of the letter triples of the names, each between two start and one end mark."""
    if not names:
        return np.empty(0, "int64")
    c = _CLASS[np.frombuffer(("\n\n" + "\n\n".join(names) + "\n").encode("ascii", "replace"), "uint8")]
    t = c[:-2] * LETTERS * LETTERS + c[1:-1] * LETTERS + c[2:]
    return t[~((c[1:-1] == 29) & (c[2:] == 29))]


class Names:
    """Letter triples of the names of a language; what a file costs is judged without its own names."""

    def __init__(self, counts: np.ndarray):
        n = counts.reshape(LETTERS, LETTERS, LETTERS).astype("float32")
        bi = n.sum(0) + 0.1
        self.n, self.context = n.reshape(-1), n.sum(2).reshape(-1)
        self.bi = (bi / bi.sum(1, keepdims=True)).reshape(-1)
        self.rests_on = int(n[:, :, 29].sum())  # each name has one end mark
        at = np.flatnonzero(self.n)
        self.usual = float((self._bits(at, self.n[at], self.context[at // LETTERS]) * self.n[at]).sum() / max(1.0, self.n.sum()))

    def _bits(self, at: np.ndarray, n: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Bits of each letter after its two predecessors, with the bigram as fall-back."""
        return -np.log2((n + 8 * self.bi[at % (LETTERS * LETTERS)]) / (context + 8))

    def excess(self, names: list[str]) -> float:
        """Mean bits of a letter of the names beyond the usual."""
        at, own = np.unique(trigrams(names), return_counts=True)
        pairs, inverse = np.unique(at // LETTERS, return_inverse=True)
        own_context = np.bincount(inverse, weights=own, minlength=len(pairs))[inverse]
        bits = self._bits(at, np.maximum(0, self.n[at] - own), np.maximum(0, self.context[at // LETTERS] - own_context))
        return float((bits * own).sum() / own.sum()) - self.usual


def style(names: list[str]) -> tuple[int, int, int]:
    """Numbers of different snake_case, camelCase and PascalCase names of two words or more."""
    snake = camel = pascal = 0
    for n in names:
        n = n.strip("_$")
        if "_" in n:
            snake += 1
        elif len(n) > 3 and not n.islower() and not n.isupper():
            if n[0].islower():
                camel += 1
            elif any(c.isupper() for c in n[1:]):
                pascal += 1
    return snake, camel, pascal


def comments(text: str) -> tuple[list[str], list[str]]:
    """Comment lines among the first thirty lines and the last two; all others."""
    head, inside = [], []
    lines = text.split("\n")
    for k, line in enumerate(lines):
        if m := _COMMENT.match(line):
            (head if k < 30 or k >= len(lines) - 2 else inside).append(m.group(1).strip())
    return head, inside


#: What path and comments say: by kind the signs that label a file, then those that only count as features.
SIGNS = {
    "generated": ["generated_dir", "build_dir", "generated_name", "says_generated"],
    "minified": ["minified_name"],
    "third_party": ["vendor_dir", "says_upstream", "says_authors", "copied"],
    "data": ["data_name"],
}
HINTS = {"generated": ["says_no_edits", "inside_generated"], "minified": ["says_source_map"], "third_party": ["says_title", "says_licence", "inside_upstream"], "data": []}
KINDS = list(SIGNS)
LINES = ["blank", "packed", "mean_line"]
NUMBERS = ["excess", "sameness", "foreign", "few_names", "blank", "packed", "mean_line", "literal", "size", "list_of_data", "code"]
ALL = [*NUMBERS, *(x for v in SIGNS.values() for x in v), *(x for v in HINTS.values() for x in v)]


def path_signs(path: str) -> dict[str, bool]:
    parts = [p.lower() for p in path.split("/")]
    dirs, name = parts[1:-1], parts[-1]
    return {
        "vendor_dir": any(d in VENDOR_DIRS for d in dirs) or any(d in VENDOR_PARENTS for d in dirs[:-1]),
        "generated_dir": any(d in GENERATED_DIRS for d in dirs),
        "build_dir": any(d in BUILD_DIRS for d in dirs),
        "generated_name": bool(_GENERATED_NAME.search(name)),
        "minified_name": bool(_MINIFIED_NAME.search(name)),
        "data_name": bool(_DATA_NAME.search(name)) or any(d in ("data", "dataset", "datasets") for d in dirs),
    }


def comment_signs(repo: str, text: str) -> dict[str, bool]:
    head, inside = comments(text)
    titles = any(_TITLE.match(c) for c in head[:4])
    return {
        "says_generated": any(_GENERATED.search(c) for c in head),
        "says_no_edits": any(_NO_EDITS.search(c) for c in head),
        "says_upstream": any(_UPSTREAM.search(c) for c in head),
        "says_authors": any(m.group(1).lower() not in (repo.lower(), "this") for c in head for m in _AUTHORS.finditer(c)),
        "says_title": titles,
        "says_licence": titles and any(_LICENCE.search(c) for c in head),
        "says_source_map": any("sourceMappingURL" in c for c in head),
        "inside_generated": any(_GENERATED.search(c) for c in inside),
        "inside_upstream": any(_UPSTREAM.search(c) for c in inside),
    }


def numbers(language: str, text: str, model: Names | None) -> dict[str, float]:
    """Measures of a content; model: that of the names of its language."""
    size = len(text)
    names = sorted(set(identifiers(text)))
    snake, camel, pascal = style(names)
    lines = text.split("\n")
    literal = (sum(len(m.group()) for m in _NUMBERS.finditer(text)) + sum(len(m.group()) for m in _LONG_TEXT.finditer(text))) / size
    blank = (text.count(" ") + text.count("\n") + text.count("\t")) / size
    return {
        "excess": model.excess(names) if model is not None and len(names) >= LEAST_NAMES else 0.0,
        "sameness": 1 - len({re.sub(r"\d+", "", n) for n in names}) / len(names) if language in CODE and len(names) >= LEAST_NAMES else 0.0,
        "few_names": float(len(names) < LEAST_NAMES),
        "blank": blank,
        "packed": max(0.0, 1 - 10 * blank),
        "mean_line": float(np.log1p(size / len(lines))),
        "literal": literal,
        "size": float(np.log1p(size)),
        "list_of_data": float(text.lstrip()[:1] == "[") * literal,
        "code": float(language in CODE),
        "names": float(len(names)),
        "modelled": float(language in CODE and model is not None and len(names) >= LEAST_NAMES and model.rests_on >= LEAST_MODEL),
        "snake": float(snake),
        "camel": float(camel),
        "pascal": float(pascal),
    }


# ---------------------------------------------------------------- regression

#: What files of each kind are like (None: written by hand), so that small tables
#: have every class: excess, sameness, blank, mean line, literal, code.
PRIOR = [
    (None, 0.0, 0.0, 0.22, 3.6, 0.0, 1.0), (None, 0.2, 0.0, 0.25, 3.4, 0.02, 1.0), (None, -0.2, 0.05, 0.18, 3.7, 0.05, 1.0), (None, 0.0, 0.0, 0.2, 3.3, 0.0, 0.0),
    (None, 0.4, 0.0, 0.3, 3.5, 0.1, 1.0), (None, 0.0, 0.0, 0.15, 3.8, 0.15, 0.0),
    ("minified", 1.0, 0.0, 0.05, 6.5, 0.02, 1.0), ("minified", 0.8, 0.0, 0.03, 7.5, 0.0, 1.0), ("minified", 0.7, 0.0, 0.08, 5.5, 0.05, 1.0), ("minified", 0.0, 0.0, 0.03, 6.5, 0.0, 1.0),
    ("data", 0.0, 0.0, 0.3, 3.6, 0.7, 1.0), ("data", 0.0, 0.0, 0.15, 4.2, 0.85, 1.0), ("data", 0.0, 0.0, 0.25, 3.6, 0.5, 0.0), ("data", 0.3, 0.0, 0.05, 4.5, 0.9, 1.0),
    ("generated", 0.0, 0.8, 0.22, 3.6, 0.0, 1.0), ("generated", 0.0, 0.9, 0.2, 3.5, 0.05, 1.0),
]


#: Times that each row of PRIOR counts; penalties of numbers, signs and the constant.
WEIGHT = 3
RIDGE = np.array([0.5] * len(NUMBERS) + [0.02] * (len(ALL) - len(NUMBERS)) + [0.02])


def prior_rows() -> tuple[np.ndarray, list[str | None]]:
    """Rows of PRIOR without signs, and a hand-like row for each sign that labels."""
    columns = ["excess", "sameness", "blank", "mean_line", "literal", "code"]
    rows, kinds = [], []

    def add(kind: str | None, values: dict[str, float]) -> None:
        rows.append([values.get(c, 0.0) for c in ALL])
        kinds.append(kind)

    for kind, *values in PRIOR:
        add(kind, dict(zip(columns, values)) | {"size": 7.0, "packed": max(0.0, 1 - 10 * values[2]), "list_of_data": values[4] if kind == "data" and not values[5] else 0.0, "few_names": float(kind == "data" or (kind == "minified" and not values[0]))})
    hand = dict(zip(columns, PRIOR[0][1:])) | {"size": 7.0}
    for kind, signs in SIGNS.items():
        for sign in signs:
            if kind != "data":
                add(kind, hand | {sign: 1.0})
    return np.tile(np.array(rows), (WEIGHT, 1)), kinds * WEIGHT


def fit(sample: np.ndarray) -> dict[str, tuple[np.ndarray, float]]:
    """By kind the weights of ALL and a constant, for a logistic regression on the raw features,
    and what its probability is divided by.

    sample: rows of ALL.  A name that speaks of data is a label but no feature: it does not
    mark a file whose content is no data.
    """
    prior, prior_kind = prior_rows()
    x = np.concatenate([sample, prior]) if len(sample) else prior
    sign_at = {k: [ALL.index(s) for s in v] for k, v in SIGNS.items()}
    said = np.zeros((len(x), len(KINDS)), bool)
    for k, kind in enumerate(KINDS):
        said[:, k] = x[:, sign_at[kind]].any(1)
        said[len(sample) :, k] |= np.array([p == kind for p in prior_kind])
    data = KINDS.index("data")
    said[: len(sample), data] &= x[: len(sample), ALL.index("literal")] > 0.1
    n_numbers = len(NUMBERS)
    blind = x.copy()
    blind[:, n_numbers:] = 0.0
    full = x.copy()
    full[:, ALL.index("data_name")] = 0.0
    both = np.concatenate([full, blind])
    mean, spread = both.mean(0), both.std(0)
    mean[n_numbers:], spread[n_numbers:] = 0.0, 1.0
    spread[spread == 0] = 1.0
    z = np.concatenate([(both - mean) / spread, np.ones((len(both), 1))], 1)
    out = {}
    for k, kind in enumerate(KINDS):
        use = np.tile(said[:, k] | ~said.any(1), 2)  # files of other kinds stay out
        use[len(full) + len(sample) :] &= np.array([not row[n_numbers:].any() for row in prior])
        own = np.array([c in NUMBERS or c in SIGNS[kind] or c in HINTS[kind] for c in ALL] + [True])
        w = _newton(z[use] * own, np.tile(said[:, k], 2)[use].astype(float), RIDGE)
        against = np.append(w[:-1] < 0, False) & (np.arange(len(w)) >= n_numbers)
        if against.any():  # a sign never speaks against its kind: it may stand in many files that lack the label
            own &= ~against
            w = _newton(z[use] * own, np.tile(said[:, k], 2)[use].astype(float), RIDGE)
        raw = w[:-1] / spread
        blind_p = 1 / (1 + np.exp(-np.clip(z[len(full) :] @ w, -30, 30)))
        speaks = blind_p[said[:, k]].mean() if said[:, k].any() else 0.0
        out[kind] = np.concatenate([raw, [w[-1] - raw @ mean]]), float(speaks) if speaks >= LIFT * said[:, k].mean() else PLAIN / MARK
    return out


def _newton(x: np.ndarray, y: np.ndarray, ridge: np.ndarray, steps: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


# ---------------------------------------------------------------- Spark


def train(files: DataFrame) -> dict[str, Names]:
    """Identifier models by language, over all files.

    Per task only count tables are kept; what reaches the driver is bounded by CODE times
    letter triples.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tri: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, content in zip(batch["language"], batch["content"]):
                if isinstance(content, str) and language in CODE:
                    table = tri.setdefault(language, np.zeros(SIZE, "int64"))
                    table += np.bincount(trigrams(sorted(set(identifiers(content)))), minlength=SIZE)
        for k, v in tri.items():
            at = np.flatnonzero(v)
            yield pd.DataFrame({"language": k, "place": at, "n": v[at]})

    got = files.select("language", "content").mapInPandas(run, "language string, place long, n long").groupBy("language", "place").agg(F.sum("n").alias("n")).toPandas()
    out = {}
    for language, part in got.groupby("language"):
        table = np.zeros(SIZE, "int64")
        table[part["place"].to_numpy("int64")] = part["n"].to_numpy("int64")
        out[language] = Names(table)
    return out


_MEASURED = ["names", "modelled", "snake", "camel", "pascal"]
_SAID = [x for x in ALL if x not in NUMBERS and x != "copied"]


#: Names of a language that its model must rest on to decide alone.
LEAST_MODEL = 2000


def measure(files: DataFrame) -> DataFrame:
    """One row per file row: repo, file_path, language, hash of the content and every feature but
    those that need other files (foreign, copied)."""
    shared = files.sparkSession.sparkContext.broadcast(train(files))  # bounded: see train
    columns = [x for x in NUMBERS if x != "foreign"] + _MEASURED + _SAID
    schema = "repo string, file_path string, language string, h string, " + ", ".join(f"{c} double" for c in columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = shared.value
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                f = dict.fromkeys(columns, None) | {k: float(v) for k, v in path_signs(r.file_path).items()}
                if isinstance(r.content, str) and r.content.strip():
                    f |= numbers(r.language or "", r.content, models.get(r.language))
                    f |= {k: float(v) for k, v in comment_signs(r.repo or "", r.content).items()}
                rows.append((r.repo, r.file_path, r.language, r.h, *f.values()))
            yield pd.DataFrame(rows, columns=["repo", "file_path", "language", "h", *columns]).astype(dict.fromkeys(columns, "float64"))

    hashed = files.withColumn("h", F.when(F.length("content") >= COPY_CHARS, F.concat_ws("-", F.xxhash64("content"), F.length("content"))))
    return hashed.select("repo", "file_path", "language", "content", "h").mapInPandas(run, schema)


def features(files: DataFrame) -> DataFrame:
    """All features of every file: measures, the foreignness of its naming style and copies elsewhere."""
    m = keep(measure(files).replace(float("nan"), None), "measures")
    names = ["snake", "camel", "pascal"]
    own = F.col("snake") + F.col("camel") + F.col("pascal")
    n_own = F.when(own > 0, own)
    # every file counts alike, so that a large one does not make the style of its repository
    styles = m.groupBy(F.col("repo").alias("of"), F.col("language").alias("in")).agg(*(F.sum(F.col(c) / n_own).alias(f"all_{c}") for c in names), F.count(n_own).alias("all_files"))
    m = m.join(styles, F.col("repo").eqNullSafe(F.col("of")) & F.col("language").eqNullSafe(F.col("in")), "left").drop("of", "in")
    rest = {c: F.greatest(F.lit(0.0), F.col(f"all_{c}") - F.col(c) / n_own) + 0.25 for c in names}  # the repository without the file
    total = rest["snake"] + rest["camel"] + rest["pascal"]
    cost = sum((F.col(c) * -F.log2(rest[c] / total) for c in names), F.lit(0.0)) / own
    usual = sum((-rest[c] / total * F.log2(rest[c] / total) for c in names), F.lit(0.0))
    m = m.withColumn("foreign", F.when((own >= LEAST_NAMES) & (F.col("all_files") >= LEAST_FILES) & (F.col("code") == 1), cost - usual))
    copies = m.where("h is not null").groupBy("h").agg(F.min("repo").alias("r1"), F.max("repo").alias("r2")).where("r1 <> r2").select(F.col("h").alias("copy_of"))
    m = m.join(copies, m.h == F.col("copy_of"), "left").withColumn("copied", F.col("copy_of").isNotNull().cast("double")).drop("copy_of")
    # a content that is missing counts as an average one
    means = {c: F.coalesce(F.lit(v), F.lit(0.0)) for c, v in m.agg(*(F.avg(c).alias(c) for c in NUMBERS)).first().asDict().items()}
    given = {c: F.when(F.coalesce("modelled", F.lit(0.0)) == 0, F.col(c)) if c in LINES else F.col(c) for c in ALL}
    filled = {c: F.coalesce(v, means[c] if c in NUMBERS and c not in ("foreign", "sameness") else F.lit(0.0)) for c, v in given.items()}
    return keep(m.select("repo", "file_path", "language", "names", *(v.alias(c) for c, v in filled.items())), "features")


def score(weights: np.ndarray, over: float) -> Column:
    z = F.lit(float(weights[-1]))
    for c, w in zip(ALL, weights[:-1]):
        z = z + F.col(c) * float(w)
    return F.least(F.lit(1.0), 1 / (1 + F.exp(-z)) / over)


def limits(scored: DataFrame) -> DataFrame:
    """By language the values of the named signals that mark alone."""
    quartiles = lambda c: F.percentile_approx(c, F.array(F.lit(0.5), F.lit(0.75)), 1000)
    q = scored.where((F.col("code") == 1) & (F.col("names") >= LEAST_NAMES)).groupBy(F.col("language").alias("of")).agg(*(quartiles(c).alias(c) for c in ("excess", "sameness", "foreign")), F.count("*").alias("n"))
    beyond = lambda c: F.when(F.col("n") >= LEAST_FILES, F.col(c)[1] + FENCE * (F.col(c)[1] - F.col(c)[0]))
    return q.select("of", F.greatest(F.lit(MANGLED), beyond("excess")).alias("mangled"), F.greatest(F.lit(1 - TEMPLATE), F.least(F.lit(0.98), beyond("sameness"))).alias("template"), F.greatest(F.lit(FOREIGN), beyond("foreign")).alias("strange"))


def classify(files: DataFrame) -> DataFrame:
    """(repo, file_path, language, generated, minified, third_party, data, kind): scores (1
    where a named signal marks alone) and the strongest kind from MARK on, else null; files:
    (repo, file_path, language, content)."""
    files = files.select("repo", "file_path", "language", "content").where("file_path is not null")
    every = features(files)
    share = min(1.0, FIT_ROWS / max(1, every.count()))
    drawn = every.where(F.pmod(F.xxhash64("repo", "file_path", "size"), F.lit(1 << 40)) < int(share * (1 << 40))).select(*ALL)
    weights = fit(drawn.toPandas().to_numpy(float).reshape(-1, len(ALL)))  # about FIT_ROWS rows
    data_named = every.withColumn("data_name", F.lit(0.0))
    scored = data_named.withColumns({k: score(*w) for k, w in weights.items()})
    bound = limits(scored)
    scored = scored.join(bound, scored.language == bound.of, "left").drop("of")
    enough = (F.col("names") >= LEAST_NAMES) & (F.col("code") == 1)
    alone = {
        "minified": enough & (F.col("excess") >= F.coalesce("mangled", F.lit(MANGLED))),
        "generated": enough & (F.col("sameness") >= F.coalesce("template", F.lit(1 - TEMPLATE))),
        "third_party": F.col("foreign") >= F.coalesce("strange", F.lit(FOREIGN)),
    }
    scored = scored.withColumns({k: F.when(F.coalesce(v, F.lit(False)), 1.0).otherwise(F.col(k)) for k, v in alone.items()})
    one = scored.groupBy("file_path").agg(F.max("repo").alias("repo"), F.max("language").alias("language"), *(F.max(k).alias(k) for k in KINDS))
    top = F.greatest(*KINDS)
    kind = F.coalesce(*(F.when(F.col(k) == top, F.lit(k)) for k in KINDS))
    return one.withColumn("kind", F.when(top >= MARK, kind)).select("repo", "file_path", "language", *KINDS, "kind")
