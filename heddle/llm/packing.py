"""Filling fixed-capacity containers with items of varying length.

Only the histogram of the lengths, at most ``capacity`` numbers, reaches the driver.
There, combinations of up to three lengths that fill a container to within a window are
enumerated, non-negative least squares finds how often to repeat each so that the
histogram is used up, the repeats are rounded down to what the histogram holds, and
what is left is packed greedily, length by length.  The result is a short list of
patterns; the items find their place in it by their rank among items of equal length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

#: Combinations may leave this share of a container empty.
WINDOW = 1 / 1024
#: Gradient steps of the least-squares fit.
STEPS = 400
#: Steps after which combinations without use are set aside.
PRUNE = 50
#: More than any rank among items of one length.
RANKS = 1 << 48
#: Length groups are ranked in so many salted parts, so that a frequent length is no one task.
SALTS = 64


@dataclass
class Pattern:
    """``repeats`` containers, each holding ``count`` items of each ``size``."""

    sizes: dict[int, int]
    repeats: int


def combinations(present: np.ndarray, capacity: int, window: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index triples (into 0..capacity; 0 stands for none) of one to three lengths that
    sum to capacity - window .. capacity, in ascending order of their parts."""
    has = np.zeros(capacity + 1, bool)
    has[present] = True
    has[0] = False
    out = []
    for total in range(max(1, capacity - window), capacity + 1):
        if has[total]:
            out.append((np.array([0]), np.array([0]), np.array([total])))
        a = present[present * 2 <= total]
        b = a[has[total - a]]
        out.append((np.zeros(len(b), "int64"), b, total - b))
        for low in present[present * 3 <= total]:
            mid = present[(present >= low) & (present * 2 <= total - low)]
            mid = mid[has[total - low - mid]]
            out.append((np.full(len(mid), low), mid, total - low - mid))
    return out


def fit_repeats(hist: np.ndarray, parts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """min ||A x - hist|| over x >= 0 by accelerated projected gradient.

    parts: (n, 3) lengths of each combination, 0 for none; column j of A counts them.  Every
    PRUNE steps, combinations at zero that the gradient would not raise are set aside.
    """
    out = np.zeros(len(parts))
    at = np.arange(len(parts))
    for _ in range(max(1, steps // PRUNE)):
        x, pull = _descend(hist, parts[at], out[at], min(steps, PRUNE))
        out[:] = 0.0
        out[at] = x
        at = at[(x > 0) | (pull < 0)]
        if not len(at):
            break
    return out


def _descend(hist: np.ndarray, parts: np.ndarray, start: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The solution after so many steps from ``start``, and the gradient there."""
    n, m = len(parts), len(hist)

    def apply(x: np.ndarray) -> np.ndarray:
        full = sum(np.bincount(parts[:, k], weights=x, minlength=m) for k in range(3))
        full[0] = 0
        return full

    def back(r: np.ndarray) -> np.ndarray:
        r = r.copy()
        r[0] = 0
        return r[parts].sum(1)

    probe = np.random.default_rng(7).random(n)
    for _ in range(12):  # power iteration for the step length
        probe = back(apply(probe))
        top = np.linalg.norm(probe)
        probe /= max(top, 1e-12)
    rate = 1.0 / max(top * 1.05, 1e-12)
    x = y = start
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - rate * back(apply(y) - hist))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x, back(apply(x) - hist)


def plan(hist: np.ndarray, capacity: int, window: int | None = None) -> list[Pattern]:
    """Patterns that place every item of the histogram; hist[s] items have length s >= 1."""
    window = int(WINDOW * capacity) if window is None else window
    left = hist.astype("int64").copy()
    left[0] = 0
    patterns: list[Pattern] = []
    present = np.flatnonzero(left)
    combos = combinations(present, capacity, window) if len(present) else []
    if combos:
        parts = np.stack([np.concatenate([c[k] for c in combos]) for k in range(3)], 1)
        if len(parts):
            wanted = np.floor(fit_repeats(left.astype(float), parts) + 0.5).astype("int64")
            for j in np.argsort(-wanted, kind="stable"):
                if wanted[j] <= 0:
                    break
                sizes, counts = np.unique(parts[j][parts[j] > 0], return_counts=True)
                repeats = int(min(wanted[j], (left[sizes] // counts).min()))
                if repeats > 0:
                    left[sizes] -= repeats * counts
                    patterns.append(Pattern(dict(zip(sizes.tolist(), counts.tolist())), repeats))
    patterns += _greedy(left, capacity)
    return patterns


def _greedy(left: np.ndarray, capacity: int) -> list[Pattern]:
    """Largest length first, then the largest that still fits; equal containers at once."""
    patterns = []
    while (present := np.flatnonzero(left)).size:
        room, sizes = capacity, {}
        while room > 0:
            at = np.searchsorted(present, room, side="right") - 1
            while at >= 0 and left[present[at]] - sizes.get(int(present[at]), 0) <= 0:
                at -= 1
            if at < 0:
                break
            size = int(present[at])
            take = min(room // size, int(left[size]) - sizes.get(size, 0))
            sizes[size] = sizes.get(size, 0) + int(take)
            room -= int(take) * size
        repeats = min(int(left[s]) // c for s, c in sizes.items())
        for s, c in sizes.items():
            left[s] -= repeats * c
        patterns.append(Pattern(sizes, repeats))
    return patterns


def pieces(items: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """(id, piece_index, start, size): an item longer than a container is cut into full
    containers and a rest; any other is one piece.  Null and zero sizes give one piece of size 0."""
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    n = F.greatest(F.lit(1), F.ceil(size / capacity)).cast("int")
    return (
        items.select(F.col(id_col).alias("id"), size.alias("total"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece_index"))
        .withColumn("start", F.col("piece_index").cast("long") * capacity)
        .select("id", "piece_index", "start", F.least(F.lit(capacity).cast("long"), F.col("total") - F.col("start")).cast("int").alias("size"))
    )


def pack(items: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = 2048) -> DataFrame:
    """(id, piece_index, start, size, container_id): every piece in one container.

    Items without tokens (null or empty) need no room and get container null.  Ties
    between items of one length are broken by id, so the result is reproducible; rows
    repeated with the same id are packed once each.  An empty table gives no rows.
    """
    spark = items.sparkSession
    parts = pieces(items, id_col, size_col, capacity)
    hist = np.zeros(capacity + 1, "int64")
    for row in parts.where("size > 0").groupBy("size").count().collect():  # at most ``capacity`` rows
        hist[row["size"]] = row["count"]
    slots, base = [], 0
    taken: dict[int, int] = {}
    for p in plan(hist, capacity):
        for size, count in p.sizes.items():
            lo = taken.get(size, 0)
            taken[size] = lo + count * p.repeats
            slots.append((size, lo, taken[size], count, base))
        base += p.repeats
    # per length the ranks at which patterns begin, as one sorted array; patterns number a few
    # times ``capacity`` at most, whatever the number of items
    order = np.array(sorted(slots), "int64").reshape(-1, 5)
    shared = spark.sparkContext.broadcast((order[:, 0] * RANKS + order[:, 1], order[:, 1], order[:, 3], order[:, 4]))

    @F.pandas_udf("long")
    def container(size: pd.Series, rank: pd.Series) -> pd.Series:
        keys, lo, per, base = shared.value
        at = np.searchsorted(keys, size.to_numpy("int64") * RANKS + rank.to_numpy("int64"), side="right") - 1
        return pd.Series(base[at] + (rank.to_numpy("int64") - lo[at]) // per[at])

    parts = parts.withColumn("salt", F.pmod(F.xxhash64("id", "piece_index"), F.lit(SALTS)))
    counts = parts.where("size > 0").groupBy("size", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    local = F.row_number().over(Window.partitionBy("size", "salt").orderBy("id", "piece_index")) - 1
    ranked = (
        parts.where("size > 0")
        .withColumn("local", local)
        .join(offsets, ["size", "salt"])
        .withColumn("rank", F.col("off") + F.col("local"))
    )
    placed = ranked.select("id", "piece_index", "start", "size", container(F.col("size"), F.col("rank")).alias("container_id"))
    none = parts.where("size = 0").select("id", "piece_index", "start", "size", F.lit(None).cast("long").alias("container_id"))
    return placed.unionByName(none).withColumnRenamed("id", id_col)
