"""Source files that do not parse.

Lexical stage: a chunk of a file gives a lexer-state map with bracket summaries (see
``syntax.states``); the maps of one file are reduced associatively, so the chunks of a
long file are scanned on different tasks.  Files that end outside code or leave brackets
open are broken; those that balance are parsed with the local grammar of their language,
however deep they nest.

Defined cases: null contents, and languages without a grammar, are not broken; a file that
cannot be parsed for want of memory or of PyYAML is an error of the job; an empty file is valid in every language but JSON; a file recorded several times is broken if any
record is; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from heddle import syntax
from heddle.syntax import states

#: Characters of a chunk; longer files are scanned in several tasks.
CHUNK = 65_536
_OUT = "repo string, source_file string, language string, broken boolean, reason string"


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            reason = None
            if isinstance(r.content, str):
                language = (r.language or "").lower()
                text = r.content.replace("\r\n", "\n")
                with syntax.deep(text):
                    if states.states_of(language) and not r.scanned and not states.balanced(states.summarize(language, text)):
                        reason = "unbalanced"
                reason = reason or syntax.problem(r.content, language)
            rows.append((r.repo, r.source_file, r.language, reason is not None, reason))
        yield pd.DataFrame(rows, columns=["repo", "source_file", "language", "broken", "reason"])


def _to_chunks(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                parts = states.chunks(r.content.replace("\r\n", "\n"), size)
                yield pd.DataFrame({"file_key": r.file_key, "language": r.language.lower(), "at": range(len(parts)), "chunk": parts})

    return run


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            with syntax.deep(r.chunk):
                maps = states.summarize(r.language, r.chunk)
            rows += [(r.file_key, r.at, entry, s.exit, s.close, s.open, s.broken) for entry, s in maps.items()]
        yield pd.DataFrame(rows, columns=["file_key", "at", "entry", "exit", "close", "open", "broken"])


def _fold(part: pd.DataFrame) -> pd.DataFrame:
    maps = [{r.entry: states.Summary(r.exit, r.close, r.open, bool(r.broken)) for r in g.itertuples(index=False)} for _, g in part.sort_values("at").groupby("at")]
    ok = states.balanced(functools.reduce(states.combine, maps))
    return pd.DataFrame({"file_key": [part["file_key"].iat[0]], "balanced": [ok]})


def long_file_balance(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(file_key, balanced) of files in languages with lexer-state maps; files: (file_key, language, content)."""
    parts = files.mapInPandas(_to_chunks(chunk), "file_key long, language string, at int, chunk string")
    maps = parts.repartition("file_key", "at").mapInPandas(_summaries, "file_key long, at int, entry string, exit string, close string, open string, broken boolean")
    return maps.groupBy("file_key").applyInPandas(_fold, "file_key long, balanced boolean")


def broken_files(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per file: repo, source_file, language, broken, reason.

    records: repo, source_file, language, content.
    """
    rec = records.select("repo", "source_file", "language", "content").where("source_file is not null")
    long_ = (F.length("content") > chunk) & F.lower("language").isin([x for x in syntax.LANGUAGES if states.states_of(x)])
    long_ = F.coalesce(long_, F.lit(False))
    checked = rec.where(~long_).withColumn("scanned", F.lit(False)).mapInPandas(_check, _OUT)
    big = rec.where(long_).withColumn("file_key", F.xxhash64("source_file", "language", "content"))
    balance = long_file_balance(big.select("file_key", "language", "content"), chunk)
    joined = big.join(balance, "file_key")
    unbalanced = joined.where("not balanced").select("repo", "source_file", "language", F.lit(True).alias("broken"), F.lit("unbalanced").alias("reason"))
    rest = joined.where("balanced").select("repo", "source_file", "language", "content", F.lit(True).alias("scanned")).mapInPandas(_check, _OUT)
    every = checked.unionByName(unbalanced).unionByName(rest)
    return every.groupBy("source_file").agg(F.max("repo").alias("repo"), F.max("language").alias("language"), F.max("broken").alias("broken"), F.min("reason").alias("reason"))


def rates(files: DataFrame) -> DataFrame:
    """(repo, language, n_files, n_broken, share); null repo or language marks a total."""
    g = files.rollup("repo", "language").agg(F.count("*").alias("n_files"), F.count_if("broken").alias("n_broken"))
    by_language = files.groupBy("language").agg(F.count("*").alias("n_files"), F.count_if("broken").alias("n_broken")).select(F.lit(None).cast("string").alias("repo"), "language", "n_files", "n_broken")
    return g.unionByName(by_language).withColumn("share", F.round(F.col("n_broken") / F.col("n_files"), 6))
