"""Most similar vectors for every vector: a hash-prefix forest.

Each tree gives every vector a long string of hyperplane bits; the vectors of a tree form
a sorted array, cut at variable-length prefixes into leaves.  The sample only spreads the
array over tasks: however large the collection, a task works off what it gets in pieces of
bounded size that end where short prefixes do and overlap.  Within a piece every vector
descends to the longest prefix it shares with enough others; all then ascend in step,
level by level, to shorter prefixes for more candidates.  The trees' candidates are
merged, and the similarity of what is left is computed exactly.

Exact copies of a vector are collapsed into one class before hashing, so neither a
frequent vector nor a repeated row makes a leaf grow; members come back at the end.
Vectors travel to the leaves as signed bytes; the error this makes is allowed for until
the exact comparison.

Prefixes separate close vectors from the rest; the nearest ones far below that are spread
over many leaves of every tree.  A search with a floor under CLOSE therefore goes over
cells around sampled centres: each vector asks the cells nearest to it, in that order, and
is compared exactly with all that they hold.  With PROBES cells or fewer that is every pair.

Defined cases: null and empty vectors, all-zero vectors and vectors with null, NaN or
infinite numbers are left out; vectors of different lengths are never compared; ties are
broken by node id; a table without vectors gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from heddle.session import keep

BITS = 64
TREES = 12
#: Vectors a leaf is aimed to hold.
LEAF = 512
#: Classes sampled to place the leaves; the index itself holds every vector.
SAMPLE = 20_000
#: Similarity lost at most by storing vectors as signed bytes (about three deviations).
BYTE_ERROR = 0.012
#: Candidates kept per vector, tree and leaf beyond k, for the ranks that bytes confuse.
SPARE = 6
SALTS = 32
#: Below this floor the search goes over cells instead of prefixes.
CLOSE = 0.8
#: Vectors a cell is aimed to hold; far larger ones are held in parts, which are asked alike.
CELL = 2048
#: Nearest cells that a vector asks.
PROBES = 4
#: Vectors compared with a cell at once.
BLOCK = 1024
#: A sorted array longer than so many leaves is worked off in pieces of that size.
PIECE = 16


def vectors(nodes: DataFrame, id_col: str = "node_id", vec_col: str = "embedding") -> DataFrame:
    """(node_id, vid, vec): every usable vector; equal vectors have equal vid, whatever their node."""
    v = nodes.select(F.col(id_col).alias("node_id"), F.explode(vec_col).alias("vec")).where("node_id is not null and size(vec) > 0")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall("vec", lambda x: x == 0)
    return v.where(~bad & ~zero).select("node_id", F.xxhash64("vec").alias("vid"), "vec")


def classes(vecs: DataFrame) -> DataFrame:
    """(vid, vec, owner): one row per distinct vector; owner is its node where it has one only, else null."""
    lo, hi = F.min(F.xxhash64("node_id")), F.max(F.xxhash64("node_id"))
    return vecs.groupBy("vid").agg(F.first("vec").alias("vec"), F.when(lo == hi, lo).alias("owner"))


def planes(dim: int, trees: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, trees * BITS)).astype("float32")


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def hash_strings(units: np.ndarray, trees: int) -> np.ndarray:
    """(n, trees) of 64 bits each; the first plane is the highest bit."""
    signs = (units.astype("float32") @ planes(units.shape[1], trees)) > 0
    packed = np.packbits(signs.reshape(len(units), trees, BITS), axis=2)
    return packed.view(">u8")[:, :, 0].astype("uint64")


def leaf_starts(sorted_hashes: np.ndarray, most: int) -> np.ndarray:
    """First hash of each leaf: prefixes are lengthened until a leaf holds at most ``most`` of the sample."""
    starts, todo = [], [(0, 0, len(sorted_hashes), 0)]
    while todo:
        prefix, lo, hi, depth = todo.pop()
        if hi - lo <= most or depth == BITS:
            starts.append(prefix)
            continue
        middle = prefix | (1 << (BITS - 1 - depth))
        cut = lo + int(np.searchsorted(sorted_hashes[lo:hi], np.uint64(middle)))
        todo += [(middle, cut, hi, depth + 1), (prefix, lo, cut, depth + 1)]
    return np.array(sorted(starts), "uint64")


def candidate_blocks(hashes: np.ndarray, enough: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Blocks (lo, hi, queries) of a sorted array: each query once, in the block of the longest
    prefix that it shares with at least ``enough`` entries, or in the whole array.

    All queries descend to full length and ascend together, four bits a step.
    """
    n = len(hashes)
    waiting = np.ones(n, bool)
    for length in range(BITS, -1, -4):
        keys = hashes >> np.uint64(BITS - length) if length else np.zeros(n, "uint64")
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        for lo, hi in zip(edges[:-1], edges[1:]):
            if hi - lo >= enough or length == 0:
                q = lo + np.flatnonzero(waiting[lo:hi])
                if len(q):
                    waiting[q] = False
                    yield int(lo), int(hi), q
        if not waiting.any():
            return


def score_leaf(leaf: pd.DataFrame, k: int, at_least: float, enough: int) -> pd.DataFrame:
    """(a, b, sim): for each query of the leaf its best k + SPARE candidates of other nodes."""
    leaf = leaf.drop_duplicates("vid")
    hashes, vid = leaf["hash"].to_numpy("int64").view("uint64"), leaf["vid"].to_numpy("int64")
    order = np.argsort(hashes, kind="stable")
    hashes, vid = hashes[order], vid[order]
    owner = leaf["owner"].fillna(0).to_numpy("int64")[order]
    ask = leaf["ask"].to_numpy(bool)[order]
    units = unit(np.stack([np.frombuffer(x, "int8") for x in leaf["bytes"]])[order].astype("float32"))
    out = []
    for lo, hi, q in candidate_blocks(hashes, enough):
        q = q[ask[q]]
        for part in np.array_split(q, max(1, len(q) * (hi - lo) // 4_000_000)):
            if not len(part):
                continue
            sims = units[part] @ units[lo:hi].T
            sims[part[:, None] == np.arange(lo, hi)] = -2
            sims[(owner[part][:, None] == owner[None, lo:hi]) & (owner[part] != 0)[:, None]] = -2
            best = min(k + SPARE, hi - lo)
            top = np.argpartition(-sims, best - 1, axis=1)[:, :best]
            value = np.take_along_axis(sims, top, 1)
            row, col = np.nonzero(value >= max(at_least, -1.5))
            out.append((vid[part[row]], vid[lo + top[row, col]], value[row, col]))
    a, b, s = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0, "float32"))
    return pd.DataFrame({"a": a, "b": b, "sim": s.astype("float32")})


def cut_at(hashes: np.ndarray, least: int) -> int:
    """Place from ``least`` on in a sorted array that parts the shortest common prefix; the last such place."""
    differ = hashes[least:] ^ hashes[least - 1 : -1]
    return least + int(len(differ) - 1 - np.argmax(differ[::-1]))


def sorted_pieces(batches: Iterator[pd.DataFrame], most: int, overlap: int) -> Iterator[pd.DataFrame]:
    """Pieces of the sorted array that arrives batch by batch: a leaf, or up to ``most`` entries of a
    longer one, cut where the shortest prefix ends in the second half.  Both neighbours of a cut
    see ``overlap`` entries beyond it.  The pieces do not depend on the batches.
    """
    held = None  # entries from the last cut on, after the overlap that precedes it
    before = 0  # how many entries of held lie before the cut
    for batch in batches:
        for _, part in batch.groupby("leaf", sort=True):
            if held is not None and held["leaf"].iat[0] != part["leaf"].iat[0]:
                yield held
                held, before = None, 0
            held = part if held is None else pd.concat([held, part], ignore_index=True)
            while len(held) >= before + most + overlap:
                inner = held["hash"].to_numpy("int64").view("uint64")[before : before + most]
                cut = before + cut_at(inner, most // 2)
                yield held.iloc[: cut + overlap]
                start = max(0, cut - overlap)
                held, before = held.iloc[start:].reset_index(drop=True), cut - start
    if held is not None:
        yield held


def sampled(cls: DataFrame, total: int) -> pd.DataFrame:
    """(vid, vec) of about SAMPLE classes at most, chosen by hash."""
    share = min(1.0, SAMPLE / max(1, total))
    return cls.select("vid", "vec").where(F.pmod(F.xxhash64("vid", F.lit(5)), F.lit(1 << 50)) < int(share * (1 << 50))).toPandas()


def candidates(
    cls: DataFrame, k: int, at_least: float = -2.0, queries: DataFrame | None = None, trees: int = TREES, leaf: int = LEAF, enough: int | None = None
) -> DataFrame:
    """(a, b, sim): candidate b of query class a with its similarity by signed bytes.

    cls: (vid, vec, owner), kept; queries: (vid) of the classes that ask, all if None.
    """
    spark = cls.sparkSession
    total = cls.count()
    enough = enough or 4 * (k + SPARE)
    if queries is not None:
        asked = queries.select(F.col("vid").alias("asked")).distinct()
        cls = cls.join(asked, cls.vid == asked.asked, "left").withColumn("ask", F.col("asked").isNotNull())
    else:
        cls = cls.withColumn("ask", F.lit(True))
    sample = sampled(cls, total)
    starts: dict[int, list[np.ndarray]] = {}
    for dim, part in sample.groupby(sample["vec"].map(len)):
        h = hash_strings(unit(np.stack(part["vec"].to_list())), trees)
        most = max(1, int(leaf * len(sample) / max(1, total)))
        starts[dim] = [leaf_starts(np.sort(h[:, t]), most) for t in range(trees)]
    shared = spark.sparkContext.broadcast(starts)  # at most SAMPLE numbers a tree

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby(batch["vec"].map(len)):
                units = unit(np.stack(part["vec"].to_list()))
                h = hash_strings(units, trees)
                scale = 127 / np.abs(units).max(axis=1, keepdims=True)
                raw = [x.tobytes() for x in np.rint(units * scale).astype("int8")]
                where = shared.value.get(dim) or [np.zeros(1, "uint64")] * trees
                for t in range(trees):
                    at = np.searchsorted(where[t], h[:, t], side="right") - 1
                    yield pd.DataFrame(
                        {"leaf": (dim * 1000 + t) * (1 << 32) + at, "hash": h[:, t].view("int64"), "vid": part["vid"].to_numpy(), "owner": part["owner"].astype("Int64").to_numpy(), "ask": part["ask"].to_numpy(), "bytes": raw}
                    )

    floor = at_least - BYTE_ERROR

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in sorted_pieces(batches, PIECE * leaf, leaf):
            yield score_leaf(piece, k, floor, enough)

    sent = cls.select("vid", "vec", "owner", "ask").mapInPandas(send, "leaf long, hash long, vid long, owner long, ask boolean, bytes binary")
    found = sent.repartition("leaf").sortWithinPartitions("leaf", "hash", "vid").mapInPandas(score, "a long, b long, sim float")
    return found.groupBy("a", "b").agg(F.max("sim").alias("sim"))


def cell_centres(units: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """At most n centres by spherical k-means."""
    units = units.astype("float32")
    centres = units[np.random.default_rng(3).permutation(len(units))[:n]]
    for _ in range(rounds):
        total = np.zeros_like(centres)
        np.add.at(total, (units @ centres.T).argmax(axis=1), units)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 0, total / np.maximum(norm, 1e-9), centres)
    return centres


def compare(base: pd.DataFrame, ask: pd.DataFrame, most: int, at_least: float) -> pd.DataFrame:
    """(a, b, similarity): for each vector of ``ask`` the nearest ``most`` of ``base`` of other nodes."""
    matrix = lambda part: unit(np.stack([np.frombuffer(x, "float64") for x in part["vec"]]))
    b, b_owner, held = base["vid"].to_numpy("int64"), base["owner"].fillna(0).to_numpy("int64"), matrix(base)
    held32 = held.astype("float32")
    out = []
    for lo in range(0, len(ask), BLOCK):
        part = ask.iloc[lo : lo + BLOCK]
        a, owner, units = part["vid"].to_numpy("int64"), part["owner"].fillna(0).to_numpy("int64"), matrix(part)
        sims = units.astype("float32") @ held32.T
        sims[a[:, None] == b[None]] = -2
        sims[(owner[:, None] == b_owner[None]) & (owner != 0)[:, None]] = -2
        best = min(most, len(b))
        top = np.argpartition(-sims, best - 1, axis=1)[:, :best]
        row, col = np.nonzero(np.take_along_axis(sims, top, 1) > -1.5)
        at = top[row, col]
        exact = np.einsum("ij,ij->i", units[row], held[at])
        ok = exact >= at_least
        out.append(pd.DataFrame({"a": a[row[ok]], "b": b[at[ok]], "similarity": exact[ok]}))
    return pd.concat(out)


def by_cells(cls: DataFrame, k: int, at_least: float = -2.0, queries: DataFrame | None = None, cell: int = CELL, probes: int = PROBES) -> DataFrame:
    """(a, b, similarity): the k + SPARE nearest classes b found for each query class a, exactly compared.

    cls and queries as of candidates.
    """
    total = cls.count()
    if queries is not None:
        asked = queries.select(F.col("vid").alias("asked")).distinct()
        cls = cls.join(asked, cls.vid == asked.asked, "left").withColumn("ask", F.col("asked").isNotNull())
    else:
        cls = cls.withColumn("ask", F.lit(True))
    sample = sampled(cls, total).sort_values("vid")
    places: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim, part in sample.groupby(sample["vec"].map(len)):
        units = unit(np.stack(part["vec"].to_list()))
        one = total / len(sample)  # classes that a sampled one stands for
        centres = cell_centres(units, max(1, round(len(part) * one / cell)))
        held = np.bincount((units.astype("float32") @ centres.T).argmax(axis=1), minlength=len(centres)) * one
        places[dim] = centres, np.maximum(1, np.ceil(held / (8 * cell))).astype("int64")
    shared = cls.sparkSession.sparkContext.broadcast(places)  # at most SAMPLE vectors

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, rows in batch.groupby(batch["vec"].map(len)):
                centres, parts = shared.value.get(dim) or (np.zeros((1, dim), "float32"), np.ones(1, "int64"))
                vid, ask, vec = rows["vid"].to_numpy("int64"), rows["ask"].to_numpy(bool), np.stack(rows["vec"].to_list()).astype("float64")
                near = np.argsort(-(unit(vec).astype("float32") @ centres.T), axis=1, kind="stable")[:, :probes]
                own = vid % parts[near[:, 0]]
                raw, owner = np.array([x.tobytes() for x in vec], object), rows["owner"].astype("Int64")
                for j in range(near.shape[1]):
                    for p in range(int(parts[near[:, j]].max())):
                        base = (own == p) & (j == 0)
                        at = np.flatnonzero((p < parts[near[:, j]]) & (base | ask))
                        if len(at):
                            yield pd.DataFrame({"cell": (dim << 40) + (near[at, j] << 20) + p, "rank": np.where(base[at], 0, 1), "vid": vid[at], "owner": owner.iloc[at].to_numpy(), "ask": ask[at], "vec": raw[at]})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, base = None, [], None  # base: all vectors of the cell, once the first that only asks has come

        def inside() -> Iterator[pd.DataFrame]:
            if base is not None and base["ask"].any():
                yield compare(base, base[base["ask"]], k + SPARE, at_least)

        for batch in batches:
            for (cell_, rank), part in batch.groupby(["cell", "rank"], sort=True):
                if cell_ != at:
                    if held:
                        base = pd.concat(held)
                        yield from inside()
                    at, held, base = cell_, [], None
                if rank == 0:
                    held.append(part)
                    continue
                if held:
                    base = pd.concat(held)
                    yield from inside()
                    held = []
                if base is not None:
                    yield compare(base, part, k + SPARE, at_least)
        if held:
            base = pd.concat(held)
            yield from inside()

    sent = cls.select("vid", "vec", "owner", "ask").mapInPandas(send, "cell long, rank int, vid long, owner long, ask boolean, vec binary")
    found = sent.repartition("cell").sortWithinPartitions("cell", "rank").mapInPandas(score, "a long, b long, similarity double")
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.col("similarity").desc(), "b"))
    return found.withColumn("r", best).where(F.col("r") <= k + SPARE).drop("r")


def cosine(a: str, b: str) -> F.Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def members(vecs: DataFrame, most: int) -> DataFrame:
    """(vid, node_id): of each class its ``most`` smallest node ids; large classes are cut per salt first."""
    m = vecs.select("vid", "node_id").distinct().withColumn("salt", F.pmod(F.xxhash64("node_id"), F.lit(SALTS)))
    first = m.withColumn("r", F.row_number().over(Window.partitionBy("vid", "salt").orderBy("node_id"))).where(F.col("r") <= most)
    return first.withColumn("r", F.row_number().over(Window.partitionBy("vid").orderBy("node_id"))).where(F.col("r") <= most).select("vid", "node_id")


def nearest(
    nodes: DataFrame, k: int = 10, at_least: float = -2.0, queries: DataFrame | None = None, id_col: str = "node_id", vec_col: str = "embedding", **index
) -> DataFrame:
    """(node_id, vid, neighbor_id, similarity, rank): the k nearest vectors of other nodes for each vector.

    at_least: only neighbours of this cosine or more; queries: (node_id) of the nodes that ask.
    A node with several vectors asks once for each; a neighbour with several equal vectors counts once.
    """
    vecs = vectors(nodes, id_col, vec_col)
    cls = keep(classes(vecs), "classes")
    asking = vecs.select("node_id", "vid").distinct()
    if queries is not None:
        q = queries.select(F.col("node_id").alias("q")).distinct()
        asking = asking.join(q, asking.node_id == F.col("q"), "left_semi")
    asking = keep(asking, "asking")
    asked = asking.select("vid") if queries is not None else None
    if at_least < CLOSE:
        exact = keep(by_cells(cls, k, at_least, asked, **index), "pairs")
    else:
        pairs = keep(candidates(cls, k, at_least, asked, **index), "pairs")
        left, right = cls.select(F.col("vid").alias("a"), F.col("vec").alias("va")), cls.select(F.col("vid").alias("b"), F.col("vec").alias("vb"))
        exact = pairs.join(left, "a").join(right, "b").select("a", "b", cosine("va", "vb").alias("similarity")).where(F.col("similarity") >= at_least)
    # equal vectors of different nodes: similarity 1 within the class
    owners = members(vecs, k + 1)
    own = cls.where("owner is null").select(F.col("vid").alias("a"), F.col("vid").alias("b"), F.lit(1.0).alias("similarity"))
    links = exact.unionByName(own)
    ask = asking.select(F.col("vid").alias("a"), "node_id")
    other = owners.select(F.col("vid").alias("b"), F.col("node_id").alias("neighbor_id"))
    full = ask.join(links, "a").join(other, "b").where("node_id <> neighbor_id")
    best = full.groupBy("node_id", "a", "neighbor_id").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("node_id", "a").orderBy(F.col("similarity").desc(), "neighbor_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("node_id", F.col("a").alias("vid"), "neighbor_id", "similarity", "rank")


def similar_pairs(nodes: DataFrame, k: int = 10, at_least: float = 0.95, **index) -> DataFrame:
    """(node_id_a, node_id_b), smaller first: a vector of one is among the k nearest of a vector of the other."""
    n = nearest(nodes, k, at_least, **index)
    return n.select(F.least("node_id", "neighbor_id").alias("node_id_a"), F.greatest("node_id", "neighbor_id").alias("node_id_b")).distinct()
