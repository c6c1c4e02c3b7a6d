"""Level-wise walks: repeat a join until it gives nothing more."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from heddle.session import keep

#: Levels walked one at a time, as long as frontiers may be large; then several in one job.
SINGLE, TOGETHER = 2, 3


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def walk(start: DataFrame, step: Callable[[DataFrame], DataFrame], label: str, most: int | None = None, single: int = SINGLE, after_single: Callable[[list[DataFrame]], Callable[[DataFrame], DataFrame]] | None = None) -> list[DataFrame]:
    """Kept levels below ``start`` (column depth, from 0): step gives the next level from the last.

    Each job's levels are written to the shared folder, so that the next reads only the
    last of them.  after_single may give a cheaper step once the first levels are known.
    """
    done: list[DataFrame] = []
    frontier, depth = start, 0
    while most is None or depth < most:
        if depth == single and after_single is not None:
            step = after_single(done)
        count = 1 if depth < single else TOGETHER
        count = count if most is None else min(count, most - depth)
        chain, cur = [], frontier
        for _ in range(count):
            cur = step(cur)
            chain.append(cur)
        block = keep(union(chain), label)
        depth += count
        done.append(block)
        frontier = block.where(F.col("depth") == depth)
        if frontier.isEmpty():
            break
    return done
