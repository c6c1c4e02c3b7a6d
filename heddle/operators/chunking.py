"""Chunkers: by tokens over lines, by characters, for long lines; batches of chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

CHUNKS = "node_id string, chunk_index int, text string, start_line int, end_line int"
#: Token limit and overlap by kind of text.
LIMITS = {"code": (4000, 50), "content": (4000, 120), "smart_content": (8000, 0)}


def estimate(text: str) -> int:
    """Tokens where no counter is plugged in."""
    return len(text) // 4


# Share of the limit that a piece of an overlong line aims at, and its least length.
SPARE, LEAST_PIECE = 0.9, 100


def piece_length(length: int, tokens: int, most: int) -> int:
    """Characters of the pieces of an overlong line, from its own mean token length."""
    return max(LEAST_PIECE, int(most * length / max(tokens, 1) * SPARE))


def spans(sizes: np.ndarray, most: int, overlap: int, joined: Callable[[int, int], int]) -> Iterator[tuple[int, int]]:
    """(first, end) of the chunks of lines with these sizes, none of them above ``most``.

    Sums from the first line on turn both questions, how many further lines fit and how many of
    the last ones the next chunk repeats, into searches. A chunk has one new line at least, even
    where the repeated ones leave no room for it. joined: size of lines first..end as one text.
    """
    total = np.concatenate([[0], np.cumsum(sizes)])
    first = new = carried = 0
    while new < len(sizes):
        end = max(new + 1, int(np.searchsorted(total, total[new] + most - carried, "right")) - 1)
        yield first, end
        again = int(np.searchsorted(total, total[end] - overlap, "left")) if overlap > 0 else end
        first, new = max(first, again), end
        carried = joined(first, end) if first < end else 0


def chunk_tokens(text: str, most: int, overlap: int, count: Callable[[str], int] = estimate) -> list[tuple[str, int, int]]:
    """(text, first line, last line): lines are packed up to the limit; a chunk starts with the last
    lines of the one before as far as they fit the overlap; a chunk may exceed the limit by these.
    An overlong line stands alone, in pieces, and parts what is before it from what follows."""
    lines = text.split("\n")
    if count(text) <= most:
        return [(text, 1, len(lines))]
    sizes = np.array([count(line + "\n") for line in lines])
    out: list[tuple[str, int, int]] = []
    start = 0
    for stop in [*np.flatnonzero(sizes > most).tolist(), len(lines)]:
        part = lines[start:stop]
        for a, b in spans(sizes[start:stop], most, overlap, lambda a, b: count("\n".join(part[a:b]) + "\n")):
            out.append(("\n".join(part[a:b]).rstrip("\n"), start + a + 1, start + b))
        if stop < len(lines):
            width = piece_length(len(lines[stop]), count(lines[stop]), most)
            out += [(lines[stop][at : at + width], stop + 1, stop + 1) for at in range(0, len(lines[stop]), width)]
        start = stop + 1
    return out


def by_tokens(nodes: DataFrame, most: int, overlap: int, count: Callable[[str], int] = estimate) -> DataFrame:
    """Chunks of every node's content with lines counted in the file; a stateful fold per text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text, start in zip(batch["node_id"], batch["content"], batch["start_line"]):
                if isinstance(text, str) and text.strip():
                    rows += [(i, k, t, int(start) - 1 + a, int(start) - 1 + b) for k, (t, a, b) in enumerate(chunk_tokens(text, most, overlap, count))]
            yield pd.DataFrame(rows, columns=["node_id", "chunk_index", "text", "start_line", "end_line"])

    return nodes.select("node_id", "content", F.coalesce("start_line", F.lit(1)).alias("start_line")).mapInPandas(run, CHUNKS)


def by_chars(rows: DataFrame, id_col: str, text_col: str, most: int, overlap: int) -> DataFrame:
    """(id, chunk_index, text, start_line, end_line): a window of ``most`` characters moved by
    most - overlap until its start passes the end; pure expressions."""
    t = F.col(text_col)
    starts = F.when(F.length(t) <= most, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.length(t) - 1, F.lit(most - overlap)))
    x = rows.where(F.length(t) > 0).select(F.col(id_col), t.alias("t_"), F.posexplode(starts).alias("chunk_index", "at"))
    piece = F.substring(F.col("t_"), F.col("at") + 1, F.lit(most))
    before = F.substring(F.col("t_"), F.lit(1), F.col("at"))
    lines = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n")))
    first = lines(before) + 1
    return x.select(F.col(id_col), "chunk_index", piece.alias("text"), first.cast("int").alias("start_line"), (first + lines(piece)).cast("int").alias("end_line"))


def batches(chunks: DataFrame, order: list[str], size: int = 16, blocks: int = 64) -> DataFrame:
    """Adds batch: consecutive groups of ``size`` in the given order.

    Numbers are given in two steps, per hash block of the first key and then across blocks,
    so the whole is never sorted in one task; the order is by block, then by the keys.
    """
    b = chunks.withColumn("block_", F.pmod(F.xxhash64(order[0]), F.lit(blocks)))
    n = b.groupBy("block_").agg(F.count("*").alias("n_"))
    off = n.select("block_", F.coalesce(F.sum("n_").over(Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off_"))
    local = F.row_number().over(Window.partitionBy("block_").orderBy(*order)) - 1
    return b.withColumn("local_", local).join(F.broadcast(off), "block_").withColumn("batch", F.floor((F.col("off_") + F.col("local_")) / size)).drop("block_", "local_", "off_")


def reassemble(vectors: DataFrame) -> DataFrame:
    """(node_id, embedding, smart_content_embedding): chunk vectors in chunk order; missing chunks
    shorten the array; null where a kind has none. vectors: node_id, chunk_index, is_smart_content, vector."""
    one = lambda smart: F.array_sort(F.collect_list(F.when(F.col("is_smart_content") == F.lit(smart), F.struct("chunk_index", "vector"))))
    take = lambda c: F.when(F.size(c) > 0, F.transform(c, lambda x: x["vector"]))
    g = vectors.groupBy("node_id").agg(one(False).alias("r"), one(True).alias("s"))
    return g.select("node_id", take(F.col("r")).alias("embedding"), take(F.col("s")).alias("smart_content_embedding"))


def mean_vector(nodes: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(node_id, mean): element-wise mean of a node's chunk vectors of its first vector's length."""
    size = F.size(F.col(vec_col)[0])
    same = F.filter(vec_col, lambda v: F.size(v) == size)
    zero = F.transform(F.col(vec_col)[0], lambda x: F.lit(0.0))
    total = F.aggregate(same, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    return nodes.where(F.size(vec_col) > 0).select("node_id", F.transform(total, lambda x: x / F.size(same)).alias("mean"))
