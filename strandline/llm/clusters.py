"""Clusters of mutually similar rows (problem 4): power-iteration spectral clustering of a sparse affinity graph.

Near-identical rows count once for the clustering: of the pairs of a cosine from ``NEAR`` on one row stays and represents
the other. The graph joins the rows that stay with their most similar ones of their group (``nearest``), weighted by how
far the cosine lies above ``FLOOR``. Several vectors at once, random projections of the rows, are multiplied again and
again with the degree-normalised affinities: within a cluster they become equal, while the slow mixing between clusters
keeps these apart. The embedding is clustered by k-means, whose first centres are the means of the rows that edges join
within ``RADIUS``; in a round of Lloyd's each row moves to the nearest of its own and its neighbours' centres. Clusters
with one direction are joined, and an exact check holds every row against the directions of the clusters that it or its
neighbours are in: it is in none that it is not near enough to. A set of rows that are all near-identical is no cluster.

Centres, directions and candidates are tables that follow the edges of the graph: nothing is compared with all clusters,
and no table of clusters passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import discard, join_checked, materialize
from ..operators.graph import components
from .nearest import _matrix, nearest, vector_table

#: Neighbours of each row in the affinity graph.
NEIGHBOURS = 10
#: Cosine at which an affinity becomes zero: members of two clusters are hardly ever more similar.
FLOOR = 0.52
#: Vectors that are iterated at once, and rounds.
WIDTH = 16
ROUNDS = 8
#: Distance in the embedding within which an edge joins two rows to one first centre.
RADIUS = 0.12
#: Cosine from which two clusters' directions are one.
SAME = 0.82
#: Least cosine of a member with its cluster's direction.
MEMBER = 0.725
#: Cosine from which two rows are near-identical.
NEAR = 0.95
#: Two distinct rows are a cluster if fewer pairs of their cosine than this are to be expected by chance in their group.
CHANCE = 0.01


def _thinned(close: DataFrame) -> DataFrame:
    """Written table ``node, rep``: of the rows that pairs ``a, b, sim`` join, those that go, each with one that stays.

    No two that stay are a pair, and each that goes has a pair that stays: in rounds the rows that have more partners than
    any of their undecided partners (ties by hash) stay and their partners go, until no pair is left.
    """
    pairs = close.unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")).groupBy("a", "b").agg(F.max("sim").alias("sim"))
    pairs = materialize(pairs)
    order = pairs.groupBy("a").agg(F.struct((-F.count("*")).alias("d"), F.xxhash64("a").alias("h"), F.col("a").alias("n")).alias("o"))
    pairs = materialize(pairs.join(_named(order, "a", a="a", o="oa"), "a").join(_named(order, "a", a="b", o="ob"), "b"))
    out = pairs.select(F.col("a").alias("node"), F.col("b").alias("rep")).limit(0)
    while not pairs.isEmpty():
        stay = materialize(pairs.groupBy("a").agg(F.first("oa").alias("o"), F.min("ob").alias("least")).where(F.col("o") < F.col("least")).select("a"))
        go = materialize(pairs.join(stay, "a").groupBy("b").agg(F.max_by("a", F.struct("sim", "a")).alias("rep")).select(F.col("b").alias("node"), "rep"))
        done = stay.union(go.select("node"))
        left = materialize(pairs.join(done, "a", "left_anti").join(done.withColumnRenamed("a", "b"), "b", "left_anti").select("a", "b", "sim", "oa", "ob"))
        discard(pairs, stay)
        pairs, out = left, out.union(go)
    return materialize(out)


def told_apart(vectors: DataFrame, neighbours: int = NEIGHBOURS, dim: int = 64, near: float = NEAR) -> tuple[DataFrame, DataFrame]:
    """Written tables ``uid, rep`` and ``a, b, sim``: for every row the representative that it is near-identical to (or
    itself), and the neighbours among the representatives.

    Rows all of whose neighbours are near-identical see nothing else, so the search is repeated among the representatives
    until no such row is left; each time a group of near-identical rows shrinks several times.
    """
    owner, reps = vectors.select("uid", F.col("uid").alias("rep")), vectors
    while True:
        found = materialize(nearest(reps, k=neighbours, dim=dim).where(F.col("sim") > 0).select(F.col("uid").alias("a"), F.col("nuid").alias("b"), "sim"))
        close = found.where(F.col("sim") >= near)
        full = close.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= neighbours)
        if close.isEmpty():
            return materialize(owner), found
        classes = _thinned(close)
        moved = classes.select(F.col("node").alias("rep"), F.col("rep").alias("to"))
        owner = materialize(join_checked(owner, moved, ["rep"], "left", 16).select("uid", F.coalesce("to", "rep").alias("rep")))
        if full.isEmpty():
            ends = [classes.select(F.col("node").alias(c), F.col("rep").alias(f"c{c}")) for c in "ab"]
            ours = join_checked(join_checked(found, ends[0], ["a"], "left", 16), ends[1], ["b"], "left", 16)
            ours = ours.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"), "sim").where("a != b")
            return owner, materialize(ours.groupBy("a", "b").agg(F.max("sim").alias("sim")))
        discard(found)
        reps = materialize(join_checked(reps, classes.select(F.col("node").alias("uid")), ["uid"], "left_anti", 16))


def affinity_graph(found: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Written table ``a, b, w``: symmetric affinities between uids; each edge in both directions."""
    near = found.where(F.col("sim") > floor).select("a", "b", ((F.col("sim") - floor) / (1 - floor)).alias("w"))
    return materialize(near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.max("w").alias("w")))


def power_iteration(graph: DataFrame, vectors: DataFrame, dim: int = 64, width: int = WIDTH, rounds: int = ROUNDS, seed: int = 11) -> DataFrame:
    """Written table ``uid, x array<float>``: the embedding of every row with an edge.

    The normalised affinities are laid out once by the end that a round reads, and a round's sums lie by that end already,
    so a round shuffles nothing but partial sums.
    """
    spark = graph.sparkSession
    turn = (np.random.default_rng(seed).normal(size=(dim, width)) / np.sqrt(width)).astype(np.float32)
    names = [f"x{i}" for i in range(width)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), np.float32, dim) @ turn
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], ["b", *names])

    degree = graph.groupBy("a").agg(F.sum("w").alias("d"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    walk = graph.join(degree, "a").select("a", "b", (F.col("w") / F.col("d")).cast("float").alias("p")).repartition(parts, "b").persist(StorageLevel.MEMORY_AND_DISK)

    def step(state: DataFrame) -> DataFrame:
        return walk.join(state, "b").groupBy("a").agg(*(F.sum(F.col("p") * F.col(n)).cast("float").alias(n) for n in names)).withColumnRenamed("a", "b")

    state = vectors.select("uid", "vec").mapInArrow(project, "b bigint, " + ", ".join(f"{n} float" for n in names))
    for _ in range(rounds - 1):
        state = step(state)
    before = materialize(state)
    # the mean of two rounds: rows that only see each other would swap places for ever
    last = before.select("b", *(F.col(n).alias(f"y{n}") for n in names))
    out = materialize(step(before).join(last, "b").select(F.col("b").alias("uid"), F.array(*(((F.col(n) + F.col(f"y{n}")) / 2).cast("float") for n in names)).alias("x")))
    walk.unpersist()
    discard(before)
    return out


def _far(a: Column, b: Column) -> Column:
    """Squared distance of two points of the embedding."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _named(df: DataFrame, key: str, **names: str) -> DataFrame:
    return df.select(F.col(key).alias(names[key]), *(F.col(c).alias(n) for c, n in names.items() if c != key))


def embedding_clusters(graph: DataFrame, embedding: DataFrame, radius: float = RADIUS, width: int = WIDTH) -> DataFrame:
    """Written table ``uid, cluster``: k-means of the embedding along the graph.

    First centres: the means of the connected rows whose edges are shorter than ``radius``. Then each row with neighbours
    of other centres takes the nearest of these and its own.
    """
    edges = graph.where("a < b").select("a", "b")
    edges = edges.join(_named(embedding, "uid", uid="a", x="xa"), "a").join(_named(embedding, "uid", uid="b", x="xb"), "b")
    first = components(edges.where(_far(F.col("xa"), F.col("xb")) <= radius * radius).select("a", "b"), "a", "b")
    first = materialize(embedding.select("uid").join(first.withColumnRenamed("node", "uid"), "uid", "left").select("uid", F.coalesce("component", "uid").alias("cluster")))
    centres = embedding.join(first, "uid").groupBy("cluster").agg(F.array(*(F.avg(F.col("x")[i]).cast("float") for i in range(width))).alias("centre"))
    centres = materialize(centres)
    crossing = graph.select("a", "b").join(_named(first, "uid", uid="a", cluster="ca"), "a").join(_named(first, "uid", uid="b", cluster="cb"), "b").where("ca != cb")
    choices = crossing.select(F.col("a").alias("uid"), F.explode(F.array("ca", "cb")).alias("cluster")).distinct()
    choices = join_checked(choices.join(embedding, "uid"), centres, ["cluster"], "inner", 160)
    chosen = choices.groupBy("uid").agg(F.min_by("cluster", F.struct(_far(F.col("x"), F.col("centre")), "cluster")).alias("chosen"))
    return materialize(first.join(chosen, "uid", "left").select("uid", F.coalesce("chosen", "cluster").alias("cluster")))


def _sums(rows: DataFrame, dim: int) -> DataFrame:
    """``grp, cluster, apart, v``: of ``grp, cluster, vec`` the number and the sum of the unit vectors of each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cluster, label = np.unique(b.column(1).to_numpy(), return_inverse=True)
            grp = np.zeros(len(cluster), np.int32)
            grp[label] = b.column(0).to_numpy()
            total = np.zeros((len(cluster), dim))
            np.add.at(total, label, _matrix(b.column(2), np.float32, dim).astype(np.float64))
            ends = pa.array(np.arange(len(cluster) + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays([pa.array(grp), pa.array(cluster), pa.array(np.bincount(label, minlength=len(cluster))), pa.ListArray.from_arrays(ends, pa.array(total.ravel()))], ["grp", "cluster", "n", "v"])

    part = rows.select("grp", "cluster", "vec").mapInArrow(run, "grp int, cluster bigint, n bigint, v array<double>")
    return part.groupBy("cluster").agg(F.first("grp").alias("grp"), F.sum("n").alias("apart"), F.array(*(F.sum(F.col("v")[i]) for i in range(dim))).alias("v"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _chance_pairs(cosine: Column, rows: Column, dim: int) -> Column:
    """Pairs of at least this cosine to be expected (an upper bound) among as many random directions."""
    a = (dim - 1) / 2
    log = a * F.log(1 - cosine * cosine) - F.log(cosine * (dim - 1)) - (lgamma(0.5) + lgamma(a) - lgamma(a + 0.5))
    return F.when(cosine >= 1, 0.0).when(cosine <= 0, rows * rows).otherwise(rows * (rows - 1) / 2 * F.exp(log))


def directions(members: DataFrame, edges: DataFrame, rows: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Written tables ``was, cluster`` and ``cluster, d``: clusters that are no noise under the name that they go on with,
    and the unit direction of each.

    ``members`` has ``uid, grp, cluster, vec``, ``rows`` the number ``rows`` of rows of each ``grp``. Noise is a single row, and a
    pair no more similar than pairs of a group of that size are by chance. A cluster joins the larger one, among those
    that an edge leads to, whose direction is most like its own, from ``SAME`` on; two rows that are both members of a
    larger cluster join it as well.
    """
    found = join_checked(_sums(members, dim), rows, ["grp"], "inner", 16).withColumn("length", F.sqrt(_dot(F.col("v"), F.col("v"))))
    pair = F.col("length") * F.col("length") / 2 - 1
    found = materialize(found.where((F.col("apart") > 2) | ((F.col("apart") == 2) & (_chance_pairs(pair, F.col("rows").cast("double"), dim) <= CHANCE))).drop("rows", "grp"))
    ends = members.select("uid", "cluster")
    touching = edges.join(_named(ends, "uid", uid="a", cluster="i"), "a").join(_named(ends, "uid", uid="b", cluster="j"), "b").where("i != j").select("i", "j").distinct()
    touching = join_checked(touching, found.select(*(F.col(c).alias(n) for c, n in (("cluster", "i"), ("apart", "ai"), ("v", "vi"), ("length", "li")))), ["i"], "inner", 600)
    touching = join_checked(touching, found.select(*(F.col(c).alias(n) for c, n in (("cluster", "j"), ("apart", "aj"), ("v", "vj"), ("length", "lj")))), ["j"], "inner", 600)
    along = _dot(F.col("vi"), F.col("vj")) / F.col("lj")
    larger = touching.where(F.struct(-F.col("aj"), "j") < F.struct(-F.col("ai"), "i")).withColumn("along", along)
    larger = larger.where((F.col("along") >= SAME * F.col("li")) | ((F.col("ai") == 2) & (F.col("along") >= 2 * MEMBER)))
    joins = materialize(larger.groupBy("i").agg(F.max_by("j", F.struct(F.col("along"), "j")).alias("j")))
    names = found.select(F.col("cluster").alias("was"))
    if joins.isEmpty():
        named = materialize(names.withColumn("cluster", F.col("was")))
    else:
        root = components(joins, "i", "j").select(F.col("node").alias("was"), "component")
        named = materialize(names.join(root, "was", "left").select("was", F.coalesce("component", "was").alias("cluster")))
    whole = found.withColumnRenamed("cluster", "was").join(named, "was").groupBy("cluster").agg(F.array(*(F.sum(F.col("v")[i]) for i in range(dim))).alias("v"))
    length = F.greatest(F.sqrt(_dot(F.col("v"), F.col("v"))), F.lit(1e-9))
    return named, materialize(whole.select("cluster", F.transform("v", lambda x: x / length).alias("d")))


def place(rows: DataFrame, members: DataFrame, edges: DataFrame, named: DataFrame, unit: DataFrame, dim: int) -> DataFrame:
    """Written table ``uid, id, grp, vec, cluster``: of ``rows`` (``uid, rep, id, grp, vec``) those near enough to the direction of a
    cluster that their representative or a neighbour of it is in; each in the nearest."""
    now = join_checked(members.select("uid", F.col("cluster").alias("was")), named, ["was"], "inner", 16).select("uid", "cluster")
    around = edges.select("a", F.col("b").alias("uid")).join(now, "uid").select(F.col("a").alias("rep"), "cluster")
    choices = around.union(now.select(F.col("uid").alias("rep"), "cluster")).distinct()
    wide = join_checked(rows.select("uid", "rep", "vec").join(choices, "rep").select("uid", "vec", "cluster"), unit, ["cluster"], "inner", 600)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, d = _matrix(b.column(1), np.float32, dim), b.column(3).flatten().to_numpy().reshape(-1, dim)
            s = np.einsum("nd,nd->n", x, d)
            ok = pa.array(s >= MEMBER)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(2).filter(ok), pa.array(s).filter(ok)], ["uid", "cluster", "s"])

    near = wide.select("uid", "vec", "cluster", "d").mapInArrow(check, "uid bigint, cluster bigint, s double")
    best = near.groupBy("uid").agg(F.max_by("cluster", F.struct("s", "cluster")).alias("cluster"))
    return materialize(rows.join(best, "uid").select("uid", "rep", "id", "grp", "vec", "cluster"))


def cluster_rows(docs: DataFrame, id_col: str = "id", vec_col: str = "embedding", group_col: str = "level", order_col: str | None = "ingested_at", dim: int = 64) -> DataFrame:
    """Written table ``id, level, cluster_id, affinity`` of the rows that belong to a cluster.

    ``affinity`` is the sum of the affinities of a row (near-identical rows are one) to rows of its own cluster;
    ``cluster_id`` is the least id of the cluster. Rows in no cluster, with unusable vectors (see ``vector_table``) or with null
    id give nothing; rows of one id count once; rows with null level are a level of their own (null in the result).
    """
    vectors = vector_table(docs, id_col, vec_col, group_col, order_col, dim)
    owner, found = told_apart(vectors, dim=dim)
    graph = affinity_graph(found)
    edges = graph.select("a", "b")
    rows = materialize(vectors.groupBy("grp").agg(F.count("*").alias("rows")))
    every = vectors.join(owner, "uid")
    single = materialize(every.where("uid = rep"))
    groups = embedding_clusters(graph, power_iteration(graph, single, dim))
    members = materialize(single.join(groups, "uid"))
    for last in (False, True):  # directions of the spectral clusters, then of the rows that the check gives these
        named, unit = directions(members, edges, rows, dim)
        placed = place(every if last else single, members, edges, named, unit, dim)
        discard(members)
        members = placed
    ends = members.where("uid = rep").select("uid", "cluster")
    inside = graph.join(_named(ends, "uid", uid="a", cluster="ca"), "a").join(_named(ends, "uid", uid="b", cluster="cb"), "b")
    affinity = inside.where("ca = cb").groupBy(F.col("a").alias("rep")).agg(F.sum("w").alias("affinity"))
    least = members.groupBy("cluster").agg(F.min("id").alias("cluster_id"))
    out = join_checked(members, materialize(least), ["cluster"], "inner", 64).join(affinity, "rep", "left")
    level = F.when(F.col("grp") != -(2**31), F.col("grp"))
    return materialize(out.select("id", level.alias("level"), "cluster_id", F.coalesce("affinity", F.lit(0.0)).alias("affinity")))


def cluster_report(members: DataFrame, typical: int = 5) -> DataFrame:
    """``level, cluster_id, size, typical_ids``: of each cluster its size and its members of the highest internal affinity."""
    size = members.groupBy("cluster_id").agg(F.first("level").alias("level"), F.count("*").alias("size"))
    rank = Window.partitionBy("cluster_id").orderBy(F.col("affinity").desc(), "id")
    top = members.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= typical)
    top = top.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("typical_ids"))
    return size.join(top, "cluster_id").select("level", "cluster_id", "size", "typical_ids")


def same_cluster(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs ``id_a, id_b`` whose ids belong to the same cluster; distinct."""
    side = members.select("id", "cluster_id")
    a = side.select(F.col("id").alias("id_a"), F.col("cluster_id").alias("ca"))
    b = side.select(F.col("id").alias("id_b"), F.col("cluster_id").alias("cb"))
    return pairs.select("id_a", "id_b").distinct().join(a, "id_a").join(b, "id_b").where("ca = cb").select("id_a", "id_b")
