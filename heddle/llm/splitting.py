"""Splitting oversized items at natural boundaries.

Balanced targets: the least number of pieces is computed from the limit and the overlap,
cuts are aimed at equal distances, each is moved to the strongest boundary near its
target, and a piece is added wherever the limit could not be kept otherwise.

Defined cases: null and empty texts are never oversized and pass as they are, as do
items without a limit; repeated rows count once; a single line longer than the limit is
cut at the next weaker boundary, in the end between any two characters (never inside
CR LF or before a combining mark where that can be avoided); an overlap of the limit or
more counts as one character less than it; line numbers stay null where the item has none and
for smart content.  Limits and positions count Unicode code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from heddle.session import keep

#: Boundaries and their strength: a cut falls at the end of the match.
BOUNDARIES = [
    (7, re.compile(r"\n[ \t]*\r?\n(?=\S)")),  # blank line before text that is not indented
    (6, re.compile(r"\n(?=#{1,6} |(?:export |pub |async |static |public |private )*(?:def|class|func|function|fn|struct|impl|interface|enum|type|const|trait)\b)")),
    (5, re.compile(r"\n[ \t]*\r?\n")),
    (4, re.compile(r"\n(?=\S)")),
    (3, re.compile(r"\n")),
    (2, re.compile(r"[.!?;:](?=[ \t])[ \t]+|[。！？；][」』）]?")),
    (1, re.compile(r"[ \t]+|[,、，;)\]}]")),
]
#: Kinds of items that can have a limit.
KINDS = ["code", "content", "smart_content"]
#: A cut may move from its target by this share of a piece.
REACH = 0.25
#: Items of a node are numbered in blocks of so many, so that a node with very many is no single task.
BLOCK = 1000


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut may fall, ascending, and their strengths."""
    best: dict[int, int] = {}
    for strength, pattern in reversed(BOUNDARIES):
        for m in pattern.finditer(text):
            best[m.end()] = strength
    at = np.fromiter(sorted(best), "int64", len(best))
    return at, np.array([best[i] for i in at.tolist()], "int64")


def _safe(text: str, at: int, low: int) -> int:
    """The last place up to ``at`` that parts neither CR LF nor a letter from its marks."""
    import unicodedata

    p = at
    while p > low and p < len(text) and (unicodedata.combining(text[p]) or text[p] in "‍️" or text[p - 1] == "‍" or (text[p] == "\n" and text[p - 1] == "\r")):
        p -= 1
    return p if p > low else at


def cuts(text: str, limit: int, overlap: int) -> list[int]:
    """Ends of the pieces; the last is the length of the text."""
    size = len(text)
    if size <= limit:
        return [size]
    step = limit - overlap
    at, strength = boundaries(text)
    pieces = -(-(size - overlap) // step)  # least number that can hold the text
    ends: list[int] = []
    last, left = 0, pieces
    while True:
        most = last + (limit if not ends else step)
        if most >= size:
            return [*ends, size]
        left = max(left, 1 + -(-(size - most) // step))  # a piece more where the limit would fail
        share = (size - last) / left
        target = min(most, last + max(1, round(share)))
        reach = max(1, int(REACH * share))
        low = max(last + 1, target - reach, (overlap + 1) if not ends else 0)
        a, b = np.searchsorted(at, low), np.searchsorted(at, min(most, target + reach), side="right")
        if a < b:
            window, power = at[a:b], strength[a:b]
            top = window[power == power.max()]
            cut = int(top[np.argmin(np.abs(top - target))])
        else:
            cut = _safe(text, target, last)
        ends.append(cut)
        last = cut
        left -= 1


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces; each but the first starts ``overlap`` before the end of the one before."""
    limit = max(1, int(limit))
    overlap = max(0, min(int(overlap), limit - 1))
    out, before = [], None
    for end in cuts(text, limit, overlap):
        out.append((0 if before is None else max(0, before - overlap), end))
        before = end
    return out


PIECES = "node_id string, chunk_index int, smart int, piece int, text string, start_line int, end_line int, oversized boolean"


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            breaks = np.fromiter((m.start() for m in re.finditer("\n", r.text)), "int64")
            known = not r.smart and pd.notna(r.start_line)
            for k, (a, b) in enumerate(split_text(r.text, r.max_chars, r.overlap_chars)):
                first = last = None
                if known:
                    first = int(r.start_line) + int(np.searchsorted(breaks, a))
                    last = int(r.start_line) + int(np.searchsorted(breaks, max(a, b - 1)))
                rows.append((r.node_id, r.chunk_index, r.smart, k, r.text[a:b], first, last, True))
        out = pd.DataFrame(rows, columns=["node_id", "chunk_index", "smart", "piece", "text", "start_line", "end_line", "oversized"])
        yield out.astype({"start_line": "Int32", "end_line": "Int32"})


def split_items(items: DataFrame, nodes: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of every item: node_id, chunk_index (running per node and kind), smart, source_index,
    piece, text, start_line, end_line, oversized.

    items: node_id, chunk_index, text, is_smart_content, start_line, end_line; nodes: node_id,
    content_type; limits: kind, max_chars, overlap_chars.  An item with is_smart_content has kind
    smart_content, any other the content_type of its node.
    """
    it = items.select(
        "node_id", F.col("chunk_index").cast("int").alias("chunk_index"), "text",
        F.coalesce(F.col("is_smart_content"), F.lit(False)).cast("int").alias("smart"),
        F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"),
    )
    kinds = nodes.where("node_id is not null").groupBy("node_id").agg(F.min("content_type").alias("kind"))
    wanted = kinds.withColumnRenamed("node_id", "kind_of")
    it = it.join(wanted, (it.node_id == F.col("kind_of")) & (it.smart == 0), "left").drop("kind_of")
    it = it.withColumn("kind", F.when(F.col("smart") == 1, "smart_content").otherwise(F.col("kind")))
    lim = limits.where(F.col("kind").isin(KINDS)).groupBy(F.col("kind").alias("of")).agg(F.min("max_chars").cast("int").alias("max_chars"), F.min("overlap_chars").cast("int").alias("overlap_chars"))
    it = it.join(F.broadcast(lim), it.kind == lim.of, "left").drop("of", "kind").distinct()  # one row per kind: three rows
    big = F.length("text") > F.col("max_chars")
    cut = it.where(big).mapInPandas(_cut, PIECES)
    small = it.where(~F.coalesce(big, F.lit(False))).select(
        "node_id", "chunk_index", "smart", F.lit(0).alias("piece"), "text",
        F.when(F.col("smart") == 0, F.col("start_line")).alias("start_line"),
        F.when(F.col("smart") == 0, F.col("end_line")).alias("end_line"), F.lit(False).alias("oversized"),
    )
    return small.unionByName(cut)


def renumber(pieces: DataFrame) -> DataFrame:
    """chunk_index made to run over all pieces of a node and kind; the old one is source_index."""
    pieces = keep(pieces, "pieces")  # the cuts are made once, though both sides below need them
    block = pieces.withColumn("block", F.floor(F.coalesce("chunk_index", F.lit(0)) / BLOCK).cast("int"))
    sums = block.groupBy("node_id", "smart", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("node_id", "smart").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("node_id", "smart", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("node_id", "smart", "block").orderBy("chunk_index", "start_line", "piece", "text")
    numbered = block.withColumn("at", F.row_number().over(within) - 1)
    joined = numbered.alias("n").join(
        sums.alias("s"),
        F.col("n.node_id").eqNullSafe(F.col("s.node_id")) & (F.col("n.smart") == F.col("s.smart")) & (F.col("n.block") == F.col("s.block")),
    )
    return joined.select(
        "n.node_id", (F.col("s.base") + F.col("n.at")).cast("int").alias("chunk_index"), "n.smart",
        F.col("n.chunk_index").alias("source_index"), "n.piece", "n.text", "n.start_line", "n.end_line", "n.oversized",
    )
