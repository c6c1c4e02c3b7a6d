"""Positions and groups for drawing: projection, clusters, labels, hulls, treemap.

The projection is PCA to two dimensions; a further non-linear embedding is not
distributed and left out.  Everything is deterministic.
"""

from __future__ import annotations

import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from heddle.functions import scalars as S
from heddle.operators.chunking import mean_vector
from heddle.operators import rounds
from heddle.session import keep, only_row

CANVAS = 5000.0
SALTS = 16
# Words that say nothing about a cluster.
STOP_WORDS = ["the", "and", "for", "with", "from", "this", "that", "self", "init", "test", "main", "get", "set", "new", "none", "true", "false", "return", "def", "class", "function", "const", "let", "var", "pub", "fn", "func", "type"]


def project(nodes: DataFrame, dim: int = 64) -> DataFrame:
    """(node_id, x, y): mean vectors of ``dim`` numbers by PCA to the plane, each axis scaled to +-CANVAS."""
    m = mean_vector(nodes.select("node_id", "embedding")).where(F.size("mean") == dim)
    v = m.select("node_id", array_to_vector("mean").alias("v"))
    if v.limit(2).count() < 2:
        return m.select("node_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    p = PCA(k=2, inputCol="v", outputCol="p").fit(v).transform(v).select("node_id", vector_to_array("p").alias("p"))
    r = only_row(p.agg(F.min(F.col("p")[0]).alias("x0"), F.max(F.col("p")[0]).alias("x1"), F.min(F.col("p")[1]).alias("y0"), F.max(F.col("p")[1]).alias("y1")))
    scale = lambda c, a, b: (c - a) / (b - a) * 2 * CANVAS - CANVAS if b > a else F.lit(0.0)
    return p.select("node_id", scale(F.col("p")[0], r["x0"], r["x1"]).alias("x"), scale(F.col("p")[1], r["y0"], r["y1"]).alias("y"))


def clusters(points: DataFrame, k: int = 20, seed: int = 42) -> DataFrame:
    """(node_id, x, y, cluster) by k-means in the plane; fewer clusters where there are fewer points."""
    n = points.limit(k).count()
    if n == 0:
        return points.withColumn("cluster", F.lit(0))
    v = points.withColumn("v", array_to_vector(F.array("x", "y")))
    return KMeans(k=max(1, min(k, n)), seed=seed, featuresCol="v", predictionCol="cluster").fit(v).transform(v).drop("v")


def tokens(nodes: DataFrame) -> DataFrame:
    """(node_id, token): words of name, file stem without a test prefix, and parent folder."""
    path = S.file_path(F.col("node_id"))
    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""), "^test_", "")
    parent = F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))
    words = F.concat(S.name_words(F.coalesce("name", F.lit(""))), S.name_words(stem), S.name_words(parent))
    t = nodes.select("node_id", F.explode(words).alias("token"))
    return t.where((F.length("token") >= 3) & ~F.col("token").isin(STOP_WORDS))


def cluster_labels(words: DataFrame, top: int = 4, most_share: float = 0.8) -> DataFrame:
    """(cluster, label): words of highest term frequency times log inverse cluster frequency, joined;
    words in more than ``most_share`` of the clusters do not count. words: (cluster, token)."""
    tf = words.groupBy("cluster", "token").agg(F.count("*").alias("tf"))
    n = words.select("cluster").distinct().count()
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    s = tf.join(df, "token").where(F.col("df") <= max(1.0, n * most_share))
    s = s.withColumn("score", F.col("tf") * (F.log((1 + n) / (1 + F.col("df"))) + 1)).where("score > 0")
    r = F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("score").desc(), "token"))
    best = s.withColumn("r", r).where(F.col("r") <= top)
    return best.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "token"))), lambda x: x["token"]), " · ").alias("label"))


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull by monotone chains, counter-clockwise."""
    p = sorted(set(points))
    if len(p) < 3:
        return p

    def half(seq):
        out: list[tuple[float, float]] = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return half(p) + half(reversed(p))


def hulls(points: DataFrame) -> DataFrame:
    """(cluster, at, x, y): hull corners of each cluster of three points or more; parts of a cluster
    are reduced to their own hulls first, so a large one is no single task."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        corners = hull(list(zip(part["x"], part["y"])))
        return pd.DataFrame({"cluster": part["cluster"].iat[0], "at": range(len(corners)), "x": [c[0] for c in corners], "y": [c[1] for c in corners]})

    schema = "cluster int, at int, x double, y double"
    salted = points.select("cluster", "x", "y", F.pmod(F.xxhash64("x", "y"), F.lit(SALTS)).alias("salt"))
    first = salted.groupBy("cluster", "salt").applyInPandas(lambda p: run(p), schema)
    final = first.groupBy("cluster").applyInPandas(lambda p: run(p), schema)
    many = final.groupBy("cluster").agg(F.count("*").alias("n")).where("n >= 3").select("cluster")
    return final.join(many, "cluster", "left_semi")


def centroids(points: DataFrame) -> DataFrame:
    """(cluster, x, y, n, color index)."""
    return points.groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).withColumn("color", F.col("cluster") % 20)


def place_rest(nodes: DataFrame, points: DataFrame, reach: float = 30.0) -> DataFrame:
    """(node_id, x, y) of nodes without vectors: beside their parent, shifted by a hash of their id, else at 0, 0."""
    rest = nodes.select("node_id", "parent_node_id").distinct().join(points.select("node_id"), "node_id", "left_anti")
    at = points.select(F.col("node_id").alias("pid"), F.col("x").alias("px"), F.col("y").alias("py"))
    shift = lambda salt: (F.pmod(F.xxhash64("node_id", F.lit(salt)), F.lit(2001)) / 1000.0 - 1.0) * reach
    j = rest.join(at, rest.parent_node_id == at.pid, "left")
    return j.select("node_id", F.when(F.col("pid").isNotNull(), F.col("px") + shift(1)).otherwise(0.0).alias("x"), F.when(F.col("pid").isNotNull(), F.col("py") + shift(2)).otherwise(0.0).alias("y"))


#: Share of a cell left free around and between folders; least distance of nodes in a cell.
PADDING, GAP = 0.03, 18.0


def folder_items(nodes: DataFrame) -> DataFrame:
    """(up, folder, depth, weight, local): what each folder's rectangle is shared among: the nodes of its own
    files as one item (local), first, then its subfolders by name. nodes: (node_id, file_path); "" is the top."""
    n = nodes.select(F.split(F.coalesce("file_path", F.lit("")), "/").alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    own = n.select(F.slice("p", 1, F.greatest(F.lit(0), F.size("p") - 1)).alias("dir"), "n").groupBy("dir").agg(F.sum("n").alias("n"))
    name = lambda k: F.array_join(F.slice("dir", 1, k), "/")
    local = own.select(name(F.size("dir")).alias("up"), F.lit(None).cast("string").alias("folder"), F.size("dir").alias("depth"), F.col("n").alias("weight"))
    chain = own.where("size(dir) > 0").select(F.explode(F.transform(F.sequence(F.lit(1), F.size("dir")), lambda k: F.struct(name(k - 1).alias("up"), name(k).alias("folder"), (k - 1).alias("depth")))).alias("c"), "n")
    below = chain.groupBy("c.up", "c.folder", "c.depth").agg(F.sum("n").alias("weight"))
    return local.unionByName(below).withColumn("local", F.col("folder").isNull())


def rectangles(nodes: DataFrame, canvas: float = 1000.0) -> DataFrame:
    """(up, folder, depth, local, x, y, w, h): the rectangle of every item of folder_items, at every depth.

    A folder is cut along its longer side by the items' weights; a level of folders a join.
    """
    w = Window.partitionBy("up").orderBy(F.col("local").desc(), "folder")
    whole = Window.partitionBy("up")
    items = keep(folder_items(nodes).withColumns({
        "before": F.coalesce(F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "at": F.row_number().over(w) - 1, "total": F.sum("weight").over(whole), "n": F.count("*").over(whole),
    }), "items")
    deepest = items.agg(F.max("depth")).first()[0]
    area = nodes.sparkSession.createDataFrame([("", 0.0, 0.0, canvas, canvas)], "pf string, px double, py double, pw double, ph double")
    out = []
    for depth in range((-1 if deepest is None else deepest) + 1):
        j = items.where(F.col("depth") == depth).join(area, F.col("up") == F.col("pf"))
        wide, pad_x, pad_y = F.col("pw") >= F.col("ph"), F.col("pw") * PADDING, F.col("ph") * PADDING
        side, pad = F.when(wide, F.col("pw")).otherwise(F.col("ph")), F.when(wide, pad_x).otherwise(pad_y)
        room = side - pad * (F.col("n") - 1)
        room, gap = F.when(room > 0, room).otherwise(side), F.when(room > 0, pad).otherwise(0.0)
        offset = room * F.col("before") / F.col("total") + gap * F.col("at")
        length = room * F.col("weight") / F.col("total")
        level = keep(j.select(
            "up", "folder", "depth", "local",
            (F.col("px") + pad_x + F.when(wide, offset).otherwise(0.0)).alias("x"), (F.col("py") + pad_y + F.when(wide, 0.0).otherwise(offset)).alias("y"),
            F.when(wide, length).otherwise(F.col("pw") - pad_x * 2).alias("w"), F.when(wide, F.col("ph") - pad_y * 2).otherwise(length).alias("h"),
        ).where("w > 0 and h > 0"), "rectangles")
        out.append(level)
        area = level.where("not local").select(F.col("folder").alias("pf"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("w").alias("pw"), F.col("h").alias("ph"))
    return rounds.union(out) if out else items.select("up", "folder", "depth", "local", *(F.lit(0.0).alias(c) for c in "xywh"))


def treemap(nodes: DataFrame, canvas: float = 1000.0) -> DataFrame:
    """(node_id, x, y, size): the nodes of a folder's own files on a grid inside its rectangle, by path and
    start line; ranks are taken per file and then across the files of a folder.

    nodes: (node_id, file_path, start_line, end_line), one row a node.
    """
    path = F.coalesce("file_path", F.lit(""))
    n = nodes.select("node_id", path.alias("file"), F.regexp_replace(F.regexp_extract(path, "^(.*)/[^/]*$", 1), "/+$", "").alias("dir"), "start_line", "end_line")
    files = n.groupBy("dir", "file").agg(F.count("*").alias("c"))
    by_file = Window.partitionBy("dir").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("dir", "file", F.coalesce(F.sum("c").over(by_file), F.lit(0)).alias("base"), F.sum("c").over(Window.partitionBy("dir")).alias("n"))
    within = F.row_number().over(Window.partitionBy("dir", "file").orderBy(F.coalesce("start_line", F.lit(0)), "node_id")) - 1
    ranked = n.withColumn("within", within).join(files, ["dir", "file"]).withColumn("i", F.col("base") + F.col("within"))
    cell = rectangles(nodes, canvas).where("local").select(F.col("up").alias("dir"), "x", "y", "w", "h")
    j = ranked.join(cell, "dir")
    one = F.lit(1).cast("long")
    fit = lambda c: F.greatest(one, F.floor(F.col(c) / GAP))
    j = j.withColumn("c0", F.greatest(one, F.least(F.ceil(F.sqrt(F.col("n"))), fit("w")))).withColumn("r0", F.greatest(one, F.least(F.ceil(F.col("n") / F.col("c0")), fit("h"))))
    more = (F.col("c0") * F.col("r0") < F.col("n")) & (F.col("c0") < fit("w"))
    j = j.withColumn("cols", F.when(more, F.col("c0") + 1).otherwise(F.col("c0"))).withColumn("rows", F.when(more, F.ceil(F.col("n") / F.col("cols"))).otherwise(F.col("r0")))
    over = F.greatest(F.lit(0), F.col("i") - F.col("cols") * F.col("rows") + 1)
    col = F.when(over > 0, F.col("cols") - 1).otherwise(F.col("i") % F.col("cols"))
    row = F.when(over > 0, F.col("rows") - 1).otherwise(F.floor(F.col("i") / F.col("cols")))
    return j.select(
        "node_id", F.round(F.col("x") + (col + 0.5) * F.col("w") / F.col("cols") + over * 2, 2).alias("x"), F.round(F.col("y") + (row + 0.5) * F.col("h") / F.col("rows") + over * 2, 2).alias("y"),
        F.round(S.line_size(F.col("start_line"), F.col("end_line")), 2).alias("size"),
    )


#: Terms of the fallback for nodes without vectors, and characters of a text that they are taken from
#: (the feature is defined on these).
TERMS, TERM_CHARS = 500, 500


def term_vectors(nodes: DataFrame) -> DataFrame:
    """(node_id, embedding): weights of the most frequent identifiers of name, signature and the beginning of
    the content, as one vector a node; stands in where fewer than half of the nodes have vectors."""
    from pyspark.ml.feature import IDF, CountVectorizer, Normalizer

    text = F.concat_ws(" ", "name", "signature", F.substring("content", 1, TERM_CHARS))
    words = nodes.select("node_id", F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z_][A-Za-z0-9_]{2,})"), 1), lambda t: F.lower(t)).alias("words"))
    counts = CountVectorizer(inputCol="words", outputCol="tf", vocabSize=TERMS).fit(words).transform(words)
    weighted = IDF(inputCol="tf", outputCol="w").fit(counts).transform(counts)
    v = Normalizer(inputCol="w", outputCol="v").transform(weighted)
    return v.select("node_id", F.array(vector_to_array("v")).alias("embedding"))


def points(nodes: DataFrame, dim: int = 64) -> DataFrame:
    """(node_id, x, y): project() by vectors, or by term_vectors where fewer than half of the nodes have any."""
    have = only_row(nodes.agg(F.count("*").alias("n"), F.count_if(F.size("embedding") > 0).alias("v")))
    if have["v"] * 2 >= have["n"]:
        return project(nodes, dim)
    terms = keep(term_vectors(nodes), "terms")
    width = terms.select(F.size(F.col("embedding")[0]).alias("w")).first()
    return project(terms, width["w"] if width else dim)
