"""The k most similar vectors of every vector (problem 5): an inverted file over product-quantised residuals.

Coarse centroids cut the vectors into lists of about ``LIST_ROWS``; what is left of a vector after its centroid, in units
of its list's spread, is product-quantised to one byte for each of ``PARTS`` parts. The driver fits at most ``MAX_LISTS``
centroids; where the table asks for more, each list is cut again, where its codes are packed, into sub-lists of about
``LIST_ROWS`` with centroids of their own, so that the rows of a list never grow with the table. Each vector is a query to
the lists of its nearest centroids (of a larger list, to the sub-lists nearest to it); their number grows slowly with
that of the lists (``probes_of``), which keeps the recall. Queries of neighbouring lists form a block; to a block come
the codes (not the vectors) of the lists that any of its queries probes, in slices of about ``SLICE_ROWS`` codes, and each
query is scored with the codes of its own probes by the product of the full query with the vectors that the codes stand
for (asymmetric distances). The best ``KEEP`` codes of a query are scored again with the full vectors, which travel once to
each block that needs them.

Skew: the sample gives a dense region its share of centroids, and the spread of its lists sets the scale of its codes;
blocks of queries hold at most about ``BLOCK_ROWS`` rows, codes come in chunks, and vectors that are equal up to the
rounding of floats, whatever their lengths were, are searched once and given back at the end. ``exact_nearest`` compares all
rows with all, for tables where no loss at all is wanted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import first_rows, join_checked, materialize, spread
from ..operators.retrieval import knn_candidates

#: The model is fitted on at most so many vectors, taken by the hash of their id: ``ROWS_A_LIST`` for each list, at least
#: the lesser number. Every vector is indexed.
TRAINING_ROWS = 65_536
LEAST_TRAINING_ROWS = 16_384
ROWS_A_LIST = 40
#: Codebooks are fitted on at most so many residuals of these.
CODEBOOK_ROWS = 16_384
LIST_ROWS = 400
MAX_LISTS = 8192
#: Lists searched for each query: so many times the number of lists of ``LIST_ROWS`` to this power.
PROBES_FACTOR, PROBES_POWER = 6.7, 0.35
#: Of these the lists whose centroid is less similar by more than this than the nearest are passed over, but for the first few.
MARGIN, LEAST_PROBES = 0.25, 8
PARTS = 32
CODEWORDS = 256
#: Codes of each query that are scored again with full vectors.
KEEP = 16
#: Queries of a block at most; fewer where the cores would else lack blocks. The larger, the less often codes travel.
BLOCK_ROWS = 131_072
#: Queries of a block that are scored at once.
SCAN_ROWS = 12_288
CHUNK_ROWS = 4096
#: Codes that come to a block of queries at once; a block that asks for more takes them in several tasks.
SLICE_ROWS = 1 << 21
#: Coordinates of unit vectors are compared in steps of this size to find vectors that are equal up to rounding.
STEP = 2.0**-20


def _binary(x: np.ndarray) -> pa.Array:
    """A matrix as one binary value for each row."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    ends = np.arange(len(x) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    """The rows of a binary column without nulls, each ``width`` values, as a matrix over the column's own memory."""
    if not len(column):
        return np.empty((0, width), dtype)
    _, ends, values = column.buffers()
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(values, np.uint8)[ends[0] : ends[-1]].view(dtype).reshape(-1, width)


def _planes(u: np.ndarray) -> bytes:
    """Sorted numbers byte by byte, the like bytes of all beside each other: most of them compress to nothing."""
    return u.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def unit_vectors(rows: DataFrame, dim: int) -> DataFrame:
    """``id, grp, vec array`` to ``id, grp, vec binary``: float32 of length 1; rows with unusable vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.equal(pc.fill_null(pc.list_value_length(b.column(2)), -1), dim))
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            ok = np.isfinite(x).all(1) & (x != 0).any(1)
            b, x = b.filter(pa.array(ok)), x[ok]
            x = x / np.abs(x).max(1, keepdims=True) if len(x) else x
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _binary(x)], ["id", "grp", "vec"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, grp int, vec binary")


def vector_table(docs: DataFrame, id_col: str = "id", vec_col: str = "embedding", group_col: str | None = None, order_col: str | None = "ingested_at", dim: int = 64) -> DataFrame:
    """Written table ``uid, id, grp, vec`` of the usable vectors: one row for each id (the earliest by ``order_col``).

    Vectors that are null, of another size than ``dim``, all zero, or hold a null, NaN or infinity take no part, nor do
    rows with null id. A null group is a group of its own.
    """
    group = F.coalesce(F.col(group_col).cast("int"), F.lit(-(2**31))) if group_col else F.lit(0)
    rows = docs.select(F.col(id_col).alias("id"), group.alias("grp"), F.col(vec_col).cast("array<double>").alias("vec"), (F.col(order_col) if order_col else F.lit(0)).alias("ord"))
    rows = first_rows(spread(rows), "id", [F.col("ord").asc_nulls_last()]).select("id", "grp", "vec")
    return materialize(unit_vectors(rows, dim).select(F.monotonically_increasing_id().alias("uid"), "id", "grp", "vec"))


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, unit: bool) -> np.ndarray:
    """Lloyd's rounds from random rows; an empty centroid moves to a random row. ``unit``: by cosine."""
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        half = 0 if unit else (c * c).sum(1) / 2
        label = np.concatenate([np.argmax(x[a : a + 4096] @ c.T - half, axis=1) for a in range(0, len(x), 4096)])
        size = np.bincount(label, minlength=k)
        order = np.argsort(label, kind="stable")
        filled = size > 0
        starts = np.concatenate([[0], np.cumsum(size)])[:-1][filled]
        c[filled] = np.add.reduceat(x[order], starts, axis=0) / size[filled, None]
        c[~filled] = x[rng.choice(len(x), int((~filled).sum()))]
        if unit:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c.astype(np.float32)


def probes_of(n: int, list_rows: int = LIST_ROWS) -> int:
    """Lists (of ``list_rows``) that a query searches in a table of ``n`` rows."""
    return round(PROBES_FACTOR * max(1.0, n / list_rows) ** PROBES_POWER)


@dataclass
class Quantizer:
    """Coarse centroids (lists, dim), the spread of each list, and codebooks (parts, codewords, dim / parts)."""

    centroids: np.ndarray
    spread: np.ndarray
    codebooks: np.ndarray

    def assign(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """For every row the numbers of its nearest lists, its own list first (-1 for those passed over), and its code."""
        probes = min(probes, len(self.centroids))
        near = np.empty((len(x), probes), np.int32)
        for a in range(0, len(x), 2048):
            s = x[a : a + 2048] @ self.centroids.T
            top = np.argpartition(-s, probes - 1, axis=1)[:, :probes] if probes < s.shape[1] else np.broadcast_to(np.arange(probes), s.shape)
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, axis=1), axis=1), axis=1)
            s = np.take_along_axis(s, top, axis=1)
            far = s < s[:, :1] - MARGIN
            far[:, :LEAST_PROBES] = False
            near[a : a + 2048] = np.where(far, -1, top)
        rest = (x - self.centroids[near[:, 0]]) / self.spread[near[:, 0], None]
        code = np.empty((len(x), len(self.codebooks)), np.uint8)
        width = self.codebooks.shape[2]
        for m, book in enumerate(self.codebooks):
            part = rest[:, m * width : (m + 1) * width]
            code[:, m] = np.argmax(part @ book.T - (book * book).sum(1) / 2, axis=1)
        return near, code

    def decode(self, number: int, code: np.ndarray) -> np.ndarray:
        """The vectors that codes of a list stand for."""
        rest = np.concatenate([book[code[:, m]] for m, book in enumerate(self.codebooks)], axis=1)
        return self.centroids[number] + self.spread[number] * rest

    def chain(self) -> np.ndarray:
        """The lists in an order in which neighbours are near each other: from each to the nearest that is left."""
        c, left, at, out = self.centroids, np.ones(len(self.centroids), bool), 0, []
        for _ in range(len(c)):
            out.append(at)
            left[at] = False
            at = int(np.argmax(np.where(left, c @ c[at], -np.inf)))
        return np.array(out)


def fit(vectors: DataFrame, n: int, dim: int, list_rows: int = LIST_ROWS, max_lists: int = MAX_LISTS, seed: int = 7) -> Quantizer:
    """Fit on a bounded sample by the hash of the ids; the lists grow with ``n``, so that a list keeps its size."""
    rng = np.random.default_rng(seed)
    lists = min(max(1, n // list_rows), max_lists)
    most = min(TRAINING_ROWS, max(LEAST_TRAINING_ROWS, ROWS_A_LIST * lists))
    share = min(1.0, 1.1 * most / max(1, n))
    picked = vectors.select(F.xxhash64("id").alias("h"), "vec").where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * most).toPandas().sort_values("h")
    x = _matrix(pa.array(picked["vec"].head(most)), np.float32, dim)
    if not len(x):
        return Quantizer(np.eye(1, dim, dtype=np.float32), np.ones(1, np.float32), np.zeros((PARTS, CODEWORDS, dim // PARTS), np.float32))
    c = _kmeans(x, lists, 8, rng, unit=True)
    own = np.concatenate([np.argmax(x[a : a + 2048] @ c.T, axis=1) for a in range(0, len(x), 2048)])
    rest = x - c[own]
    size = np.bincount(own, minlength=len(c))
    square = np.bincount(own, (rest * rest).sum(1), minlength=len(c))
    overall = max(float(np.sqrt(square.sum() / len(x))), 1e-6)
    spread = np.where(size > 1, np.sqrt(square / np.maximum(size, 1)), overall)
    spread = np.maximum(spread, 1e-3 * overall).astype(np.float32)
    some = rng.choice(len(x), min(len(x), CODEBOOK_ROWS), replace=False)
    rest = rest[some] / spread[own[some], None]
    width = dim // PARTS
    books = np.zeros((PARTS, CODEWORDS, width), np.float32)
    for m in range(PARTS):
        book = _kmeans(rest[:, m * width : (m + 1) * width], CODEWORDS, 5, rng, unit=False)
        books[m, : len(book)] = book
    return Quantizer(c, spread, books)


@dataclass
class _Codes:
    """Codes of one sub-list: the list's number, the sub-list's centroid, uids, groups and codes of its rows."""

    lst: int
    centre: np.ndarray
    uid: np.ndarray
    grp: np.ndarray
    code: np.ndarray


def _sub_lists(number: int, code: np.ndarray, model: Quantizer, rows: int) -> np.ndarray:
    """The number of each code's sub-list: one for about ``rows`` codes."""
    k = len(code) // rows
    if k < 2:
        return np.zeros(len(code), np.int64)
    x = model.decode(number, code)
    c = _kmeans(x, k, 4, np.random.default_rng(number), unit=True)
    return np.argmax(x @ c.T, axis=1)


def _wanted(q: np.ndarray, near: np.ndarray, lists: list[_Codes], most: int) -> np.ndarray:
    """Which query scans which sub-list: of its lists those that are nearest, ``most`` at most."""
    numbers = np.array([x.lst for x in lists])
    asks = np.zeros((len(q), int(max(numbers.max(), near.max())) + 2), bool)
    asks[np.arange(len(q))[:, None], near] = True  # those passed over mark the last column, which no list has
    asks = asks[:, numbers]
    if len(lists) > most and int(asks.sum(1).max()) > most:
        s = np.where(asks, q @ np.stack([x.centre for x in lists]).T, -np.inf)
        last = -np.partition(-s, most - 1, axis=1)[:, most - 1]
        asks &= s >= last[:, None]
    return asks


def _scan(q: np.ndarray, uid: np.ndarray, grp: np.ndarray, near: np.ndarray, lists: list[_Codes], model: Quantizer, keep: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and uids of the ``keep`` best codes of every query in the sub-lists it scans; -inf and -1 where there are fewer."""
    n = len(q)
    best_s, best_u = np.full((n, keep), -np.inf, np.float32), np.full((n, keep), -1, np.int64)
    least = np.full(n, -np.inf, np.float32)
    asks = _wanted(q, near, lists, most) if lists and n else np.zeros((n, 0), bool)
    for number, x in enumerate(lists):
        sub = np.flatnonzero(asks[:, number])
        if not len(sub):
            continue
        s = model.decode(x.lst, x.code) @ q[sub].T
        if (x.grp != grp[0]).any() or (grp[sub] != grp[0]).any():
            s[x.grp[:, None] != grp[sub][None, :]] = -np.inf
        if len(mine := np.flatnonzero(np.isin(uid[sub], x.uid))):
            order = np.argsort(x.uid)
            s[order[np.searchsorted(x.uid[order], uid[sub[mine]])], mine] = -np.inf
        better = s > least[sub]  # what beats the last that a query keeps
        n_better = int(np.count_nonzero(better))
        if not n_better:
            continue
        if n_better > keep * len(sub):
            top = np.argpartition(s, max(0, len(s) - keep), axis=0)[-keep:]
            who, new_s, new_u = sub, np.take_along_axis(s, top, axis=0).T, x.uid[top].T
        else:
            col, row = np.nonzero(better.T)
            who, first, size = np.unique(col, return_index=True, return_counts=True)
            at, place = np.repeat(np.arange(len(who)), size), np.arange(len(col)) - np.repeat(first, size)
            new_s, new_u = np.full((len(who), int(size.max())), -np.inf, np.float32), np.full((len(who), int(size.max())), -1, np.int64)
            new_s[at, place], new_u[at, place] = s[row, col], x.uid[row]
            who = sub[who]
        best_s[who], best_u[who] = _best(np.concatenate([best_s[who], new_s], axis=1), np.concatenate([best_u[who], new_u], axis=1), keep)
        least[who] = best_s[who].min(1)
    best_u[np.isneginf(best_s)] = -1
    return best_s, best_u


def _best(s: np.ndarray, u: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    if s.shape[1] <= keep:
        return s, u
    top = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
    return np.take_along_axis(s, top, axis=1), np.take_along_axis(u, top, axis=1)


def _rerank(uid: np.ndarray, cand: np.ndarray, known: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact top ``k``: row of the query, row of the neighbour (both in ``known``), cosine. Ties go to the lesser id."""
    order = np.argsort(known)
    sorted_uid = known[order]
    name = np.empty(len(ids), np.int64)
    name[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    me = order[np.searchsorted(sorted_uid, uid)]
    at = order[np.minimum(np.searchsorted(sorted_uid, np.maximum(cand, 0)), len(order) - 1)]
    by_name = np.argsort(np.where(cand >= 0, name[at], len(ids)), axis=1, kind="stable")
    at, cand = np.take_along_axis(at, by_name, axis=1), np.take_along_axis(cand, by_name, axis=1)
    sim = np.concatenate([np.einsum("nkd,nd->nk", x[at[a : a + 4096]].astype(np.float64), x[me[a : a + 4096]].astype(np.float64)) for a in range(0, max(1, len(at)), 4096)])
    sim[cand < 0] = -np.inf
    top = np.argsort(-sim, axis=1, kind="stable")[:, :k]
    sim, at = np.take_along_axis(sim, top, axis=1), np.take_along_axis(at, top, axis=1)
    ok = ~np.isneginf(sim)
    return np.broadcast_to(me[:, None], at.shape)[ok], at[ok], np.clip(sim[ok], -1, 1)


def exact_nearest(vectors: DataFrame, k: int = 5, dim: int = 64) -> DataFrame:
    """As ``nearest``, but every row is compared with all rows of its group, in blocks: no loss, quadratic work."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(2), np.float32, dim)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["uid", "grp", "embedding"])

    flat = vectors.select("uid", "grp", "vec").mapInArrow(unpack, "uid bigint, grp int, embedding array<float>")
    hits = knn_candidates(flat, flat.withColumnRenamed("uid", "query_id"), k + 1, id_col="uid", dim=dim, group_col="grp").where("query_id != id")
    names = vectors.select("uid", "id")
    hits = hits.select(F.col("query_id").alias("uid"), F.col("id").alias("nuid"), F.least("score", F.lit(1.0)).alias("sim"))
    hits = hits.join(names, "uid").join(names.select(F.col("uid").alias("nuid"), F.col("id").alias("nid")), "nuid")
    order = Window.partitionBy("uid").orderBy(F.col("sim").desc(), "nid")
    return hits.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("id", "nid", "uid", "nuid", "sim")


def _equal_keys(vectors: DataFrame, dim: int) -> DataFrame:
    """Written table ``uid, id, ka, kb``: 128-bit keys of group and vector, alike for vectors that are equal up to rounding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.rint(_matrix(b.column(3), np.float32, dim) / STEP).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), _binary(x)], ["uid", "id", "grp", "steps"])

    kind = vectors.schema["id"].dataType.simpleString()
    rows = vectors.select("uid", "id", "grp", "vec").mapInArrow(run, f"uid bigint, id {kind}, grp int, steps binary")
    return materialize(rows.select("uid", "id", F.xxhash64("steps", "grp").alias("ka"), F.xxhash64(F.lit("second"), "grp", "steps").alias("kb")))


def nearest(vectors: DataFrame, k: int = 5, dim: int = 64, keep: int = KEEP, least: float = -1.0, probes: int | None = None, list_rows: int = LIST_ROWS, max_lists: int = MAX_LISTS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``id, nid, uid, nuid, sim``: for every row of a ``vector_table`` the ``k`` most similar others of its group.

    Only neighbours of a cosine of at least ``least`` come out. Among equal similarities the lesser id comes first.
    Vectors that are equal up to the rounding of floats are each other's neighbours at 1. A table with one row or none
    gives nothing; a row has fewer than ``k`` neighbours only where its group is that small or its part of the index
    holds no more. ``probes`` overrides ``probes_of``.
    """
    spark = vectors.sparkSession
    # equal vectors: searched once, under the least uid
    keyed = _equal_keys(vectors, dim)
    several = materialize(keyed.groupBy("ka", "kb").agg(F.count("*").alias("copies"), F.min("uid").alias("rep")).where("copies > 1").select("ka", "kb", "rep"))
    copied = several.count() > 0
    single, n = vectors, vectors.count()
    if copied:
        later = materialize(join_checked(keyed, several, ["ka", "kb"], "inner", 48).where("uid != rep").select("uid"))
        single = join_checked(vectors, later, ["uid"], "left_anti", 24)
        n -= later.count()  # lists, probes and sample go by what is searched
    if n == 0:
        return vectors.select("id", F.col("id").alias("nid"), "uid", F.col("uid").alias("nuid"), F.lit(0.0).alias("sim"))
    model = fit(single, n, dim, list_rows, max_lists)
    shared = spark.sparkContext.broadcast(model)
    kind = vectors.schema["id"].dataType.simpleString()
    probes = probes or probes_of(n, list_rows)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, code = shared.value.assign(_matrix(b.column(3), np.float32, dim), probes)
            ends = pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near[:, 0].copy()), _binary(code), pa.ListArray.from_arrays(ends, pa.array(near.ravel()))], ["uid", "id", "grp", "vec", "lst", "code", "near"])

    listed = materialize(single.select("uid", "id", "grp", "vec").mapInArrow(assign, f"uid bigint, id {kind}, grp int, vec binary, lst int, code binary, near array<int>"))
    size = np.zeros(len(model.centroids), np.int64)
    counts = listed.groupBy("lst").count().toPandas()  # one row for each of at most MAX_LISTS lists
    size[counts["lst"]] = counts["count"]
    # runs of neighbouring lists make blocks of queries; a list that is larger is dealt out over several
    rows = min(BLOCK_ROWS, max(256, n // (2 * spark.sparkContext.defaultParallelism)))
    order = model.chain()
    block = np.empty(len(size), np.int64)
    block[order] = (np.cumsum(size[order]) - size[order]) // rows
    plan = pd.DataFrame({"lst": np.arange(len(size), dtype=np.int32), "q": block.astype(np.int32), "m": -(-size // rows), "c": -(-size // CHUNK_ROWS), "size": size}).query("m > 0")
    plan = F.broadcast(spark.createDataFrame(plan, "lst int, q int, m bigint, c bigint, size bigint"))
    share = F.xxhash64("uid")
    planned = listed.join(plan, "lst").withColumn("j", F.pmod(share, F.col("m")).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        """Codes of one chunk of a list by sub-list: uids byte by byte, groups (one if all are alike), centroid, codes."""
        number, u, g = t["lst"][0].as_py(), t["uid"].to_numpy(), t["grp"].to_numpy()
        code = _matrix(t["code"].combine_chunks(), np.uint8, PARTS)
        order = np.argsort(u)
        u, g, code = u[order], g[order], code[order]
        part = _sub_lists(number, code, shared.value, 2 * list_rows)
        out: list[tuple] = []
        for p in np.unique(part):
            at = part == p
            own = g[at][:1] if (g[at] == g[at][0]).all() else g[at]
            centre = shared.value.decode(number, code[at]).mean(0, dtype=np.float64).astype(np.float32)
            out.append((_planes(u[at]), own.astype(np.int32).tobytes(), centre.tobytes(), code[at].tobytes()))
        return pa.table([pa.array([number] * len(out), pa.int32()), *(pa.array(c, pa.binary()) for c in zip(*out))], names=["lst", "us", "gs", "centre", "codes"])

    packed = planned.select("uid", "grp", "lst", F.pmod(share, F.col("c")).alias("part"), "code").groupBy("lst", "part").applyInArrow(pack, "lst int, us binary, gs binary, centre binary, codes binary")
    asks = planned.select(F.col("q").alias("cq"), F.col("j").alias("cj"), F.explode("near").alias("lst")).where("lst >= 0").distinct()
    asks = materialize(asks.join(plan.select("lst", "size"), "lst"))
    slices = materialize(asks.groupBy("cq", "cj").agg(F.ceil(F.sum("size") / slice_rows).cast("int").alias("slices")))  # one row for each block
    wanted = materialize(join_checked(asks, slices, ["cq", "cj"], "inner", 16).select("cq", "cj", "lst", F.pmod(F.xxhash64("lst", F.lit(3)), F.col("slices")).cast("int").alias("cs"), "slices"))
    codes = join_checked(packed, wanted, ["lst"], "inner", 32)
    asked = planned.select("q", "j", "uid", "grp", "vec", F.col("near").cast("array<smallint>").alias("near") if len(model.centroids) < 1 << 15 else "near")
    asked = join_checked(asked, slices.select(F.col("cq").alias("q"), F.col("cj").alias("j"), "slices"), ["q", "j"], "inner", 16)
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("s")).drop("slices")

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        names, types = ["q", "j", "us", "cand", "score"], [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        uid, grp = left["uid"].to_numpy(), left["grp"].to_numpy()
        order = np.argsort(uid)
        q = _matrix(left["vec"].combine_chunks(), np.float32, dim)[order]
        near = left["near"].combine_chunks().flatten().to_numpy().reshape(len(uid), -1)[order]
        uid, grp = uid[order], grp[order]
        lists = []
        for number, *data in zip(right["lst"].to_pylist(), *(right[n] for n in ("us", "gs", "centre", "codes"))):
            u, g, c, x = (v.as_buffer() for v in data)  # views, no copies
            lists.append(_Codes(number, np.frombuffer(c, np.float32), _from_planes(u), np.resize(np.frombuffer(g, np.int32), len(u) // 8), np.frombuffer(x, np.uint8).reshape(-1, PARTS)))
        slices = right["slices"][0].as_py() if right.num_rows else 1
        most = -(-2 * probes // slices)
        parts = [_scan(q[a:b], uid[a:b], grp[a:b], near[a:b], lists, shared.value, keep, most) for a, b in ((a, a + SCAN_ROWS) for a in range(0, len(uid), SCAN_ROWS))]
        score, cand = (np.concatenate(x) for x in zip(*parts))
        first = [left["q"][0].as_py(), left["j"][0].as_py(), uid.astype(np.int64).tobytes(), cand.astype(np.int64).tobytes(), score.astype(np.float32).tobytes()]
        return pa.table([pa.array([v], t) for v, t in zip(first, types)], names=names)

    scanned = asked.groupBy("q", "j", "s").cogroup(codes.groupBy("cq", "cj", "cs")).applyInArrow(scan, "q int, j int, us binary, cand binary, score binary")

    def merge(t: pa.Table) -> pa.Table:
        """The best codes of a block's slices, and the uids of all vectors that its reranking needs."""
        uid = np.frombuffer(t["us"][0].as_py(), np.int64)
        s, u = (np.concatenate([np.frombuffer(x, d).reshape(len(uid), -1) for x in t[c].to_pylist()], axis=1) for c, d in (("score", np.float32), ("cand", np.int64)))
        cand = _best(s, u, keep)[1]
        need = np.unique(np.concatenate([uid, cand[cand >= 0]]))
        return pa.table([t["q"][:1], t["j"][:1], t["us"][:1], pa.array([cand.tobytes()], pa.binary()), pa.array([need], pa.list_(pa.int64()))], names=["q", "j", "us", "cand", "need"])

    merged = materialize(scanned.groupBy("q", "j").applyInArrow(merge, "q int, j int, us binary, cand binary, need array<bigint>"))
    full = merged.select(F.col("q").alias("fq"), F.col("j").alias("fj"), F.explode("need").alias("uid")).join(listed.select("uid", "id", "vec"), "uid")

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        names, types = ["id", "nid", "uid", "nuid", "sim"], [right.schema.field("id").type, right.schema.field("id").type, pa.int64(), pa.int64(), pa.float64()]
        if not left.num_rows or not len(cand := left["cand"][0].as_py()):
            return pa.table([pa.array([], t) for t in types], names=names)
        uid = np.frombuffer(left["us"][0].as_py(), np.int64)
        known, ids = right["uid"].to_numpy(), right["id"].combine_chunks()
        x = _matrix(right["vec"].combine_chunks(), np.float32, dim)
        a, b, sim = _rerank(uid, np.frombuffer(cand, np.int64).reshape(len(uid), -1), known, np.array(ids.to_pylist()), x, k)
        return pa.table([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(known[a]), pa.array(known[b]), pa.array(sim)], names=names)

    found = merged.select("q", "j", "us", "cand").groupBy("q", "j").cogroup(full.groupBy("fq", "fj")).applyInArrow(rerank, f"id {kind}, nid {kind}, uid bigint, nuid bigint, sim double").where(F.col("sim") >= least)
    if not copied:
        return found
    # copies: of each set of equal vectors the k + 1 nearest, its own members among them; every member gets these without itself
    members = materialize(join_checked(keyed, several, ["ka", "kb"], "inner", 48).select("rep", "uid", "id"))
    rank = Window.partitionBy("rep").orderBy("id")
    firsts = materialize(members.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k + 1).select("rep", F.col("uid").alias("fuid"), F.col("id").alias("fid")))
    wide = join_checked(found.withColumnRenamed("uid", "of").withColumnRenamed("nuid", "rep"), firsts, ["rep"], "left", 64)
    wide = wide.select("of", F.coalesce("fid", "nid").alias("nid"), F.coalesce("fuid", "rep").alias("nuid"), "sim")
    among = firsts.select(F.col("rep").alias("of"), F.col("fid").alias("nid"), F.col("fuid").alias("nuid"), F.lit(1.0).alias("sim"))
    order = Window.partitionBy("of").orderBy(F.col("sim").desc(), "nid")
    best = wide.unionByName(among).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    best = materialize(best.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("r", "nid", "nuid", "sim"))).alias("best")))
    alone = single.select(F.col("uid").alias("rep"), "uid", "id").join(members.select("uid"), "uid", "left_anti")
    out = alone.unionByName(members).join(best, F.col("rep") == F.col("of"))
    out = out.select("id", "uid", F.explode(F.slice(F.filter("best", lambda x: x["nuid"] != F.col("uid")), 1, k)).alias("x"))
    return out.select("id", "x.nid", "uid", "x.nuid", "x.sim")
