"""Retrieval over batches of queries: lexical, dense, fused, graph-expanded, planned.

A hit is a row ``query_id, id, score`` and, ranked, ``rank`` (0-based). All legs work on all queries at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import BROADCAST_BYTES, first_rows, join_checked, materialize, spread
from ..functions import scores
from ..functions.text import analyze


#: Rows of a block of queries and of vectors that meet in one task of the exact search, documents and distinct term sets of one of BM25.
QUERY_ROWS, VECTOR_ROWS, DOCUMENT_ROWS, SET_ROWS = 65_536, 131_072, 65_536, 65_536
#: Queries whose cosines with its block of documents a task holds at once.
AT_ONCE = 32
#: Rows of which the highest cosine is looked at first, and what a cosine in single precision may be off by, twice and more.
GROUP, SLACK = 64, 4e-5
#: Frequent terms whose weights a task holds for all documents of its block.
DENSE_TERMS = 128


def ranked(hits: DataFrame, k: int | None = None, by: list[str] | None = None, tie: list[Column] | None = None) -> DataFrame:
    """0-based ``rank`` of the hits of each query by falling score, ties by ``tie`` (the id); the first ``k``."""
    order = Window.partitionBy(*(by or ["query_id"])).orderBy(F.col("score").desc(), *(tie or [F.col("id")]))
    out = hits.withColumn("rank", F.row_number().over(order))
    if k is not None:  # on the bare row number, so that each task keeps its first k only before the shuffle
        out = out.where(F.col("rank") <= k)
    return out.withColumn("rank", F.col("rank") - 1)


def chunks(table: DataFrame) -> DataFrame:
    """A chunk table with one row for each id, the first that was ingested."""
    return first_rows(spread(table), "id", [F.col("ingested_at").asc_nulls_last()])


def tokenized(docs: DataFrame, text: Column, id_col: str = "id") -> DataFrame:
    """Written table ``id, terms``: the terms of every document in order, from which statistics and postings are read."""
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    return materialize(rows.select("id", analyze(F.col("t")).alias("terms")))


def postings(terms: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``id, term, tf, doc_len`` of a ``tokenized`` table: one row for each distinct term of a document.

    ``doc_len`` is the number of its terms; a document without terms has no row. With ``wanted`` (a written table of
    terms) only these are kept, before anything is shuffled if their counted size allows a broadcast.
    """
    rows = terms.select("id", F.size("terms").alias("doc_len"), F.explode("terms").alias("term"))
    if wanted is not None:
        rows = join_checked(rows, wanted, ["term"], "left_semi", 64)
    return rows.groupBy("id", "term").agg(F.count("*").cast("int").alias("tf"), F.first("doc_len").alias("doc_len"))


def corpus_stats(terms: DataFrame) -> DataFrame:
    """One row ``n, avg_len``: documents, and their mean number of terms."""
    return terms.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("avg_len"))


def query_terms(queries: DataFrame, text: Column) -> DataFrame:
    """``query_id, term``: the distinct terms of each query."""
    return queries.select("query_id", F.explode(F.array_distinct(analyze(text))).alias("term"))


def document_frequency(terms: DataFrame, asked: DataFrame) -> DataFrame:
    """``term, df`` of the terms that are asked for."""
    return postings(terms, materialize(asked.select("term").distinct())).groupBy("term").agg(F.count("*").alias("df"))


def bm25(docs: DataFrame, text: Column, queries: DataFrame, query_text: Column, k: int | None = None) -> DataFrame:
    """``query_id, id, score``: BM25 of the documents that share a term with a query; of each query the ``k`` best at least.

    Pairs of a query and a document are far more than either, so they never become rows: blocks of queries and of
    documents meet in tasks that give away the best ``k`` of each query and block only, by the score rounded to 9 digits,
    then id. Without ``k`` all pairs come out. Queries with the same terms are scored once. The documents are read once;
    only the terms that are asked for are written, counted within the row.
    """
    spark = docs.sparkSession
    own = F.array_sort(F.array_distinct(F.flatten(F.collect_list(analyze(query_text)))))
    asked = materialize(queries.groupBy("query_id").agg(own.alias("terms")).where(F.size("terms") > 0))
    sets = materialize(asked.groupBy("terms").agg(F.min("query_id").alias("of")))
    counted = materialize(_counted_terms(docs.select("id", analyze(text).alias("terms")), materialize(sets.select(F.explode("terms").alias("term")).distinct())))
    total = counted.agg(F.count("*").alias("n"), F.avg("doc_len").alias("avg_len")).first()  # one row of statistics
    df = materialize(counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    weighed = join_checked(sets.select("of", F.explode("terms").alias("term")), df, ["term"], "inner", 64).withColumn("idf", scores.idf(F.lit(total["n"]), F.col("df")))
    weighed = materialize(weighed.groupBy("of").agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("t")).select("of", F.col("t.term").alias("terms"), F.col("t.idf").alias("idfs")))
    held = counted.where(F.size("terms") > 0)
    q_blocks = max(1, -(-weighed.count() // SET_ROWS))
    m = held.count()
    d_blocks = max(1, -(-m // DOCUMENT_ROWS), min(2 * spark.sparkContext.defaultParallelism // q_blocks, -(-m // 512)))
    left = _blocks(weighed, "of", q_blocks, "q", "d", d_blocks).groupBy("q", "d")
    right = _blocks(held, "id", d_blocks, "d", "q", q_blocks).groupBy("q", "d")
    average = total["avg_len"] or 1.0

    def meet(sets: pa.Table, docs: pa.Table) -> pa.Table:
        who, at, score = _bm25_block(sets, docs, average, k)
        return pa.table([sets["of"].take(pa.array(who)), docs["id"].take(pa.array(at)), pa.array(score)], names=["of", "id", "score"])

    kind_q, kind_d = queries.schema["query_id"].dataType.simpleString(), docs.schema["id"].dataType.simpleString()
    hits = left.cogroup(right).applyInArrow(meet, f"of {kind_q}, id {kind_d}, score double")
    if k is not None:  # of all blocks together, before the sets become queries again
        hits = ranked(hits.withColumn("score", F.round("score", 9)), k, by=["of"]).drop("rank")
    names = asked.join(sets, "terms").select("query_id", "of")
    return hits.join(names, "of").select("query_id", "id", "score")


def _blocks(rows: DataFrame, key: str, blocks: int, own: str, other: str, others: int) -> DataFrame:
    """``rows`` with the number ``own`` of their block by the hash of ``key``, once for each of the ``others`` blocks of the other side."""
    return rows.select("*", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))


def _counted_terms(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id, doc_len, terms, tfs`` from ``id, terms``: number of terms, the distinct ones and how often each stands there.

    Only terms of ``wanted`` (a written table) stay where its counted size allows a broadcast, else all; rows stay in place.
    """
    kept = None
    if wanted.count() * 64 <= BROADCAST_BYTES:
        kept = docs.sparkSession.sparkContext.broadcast(wanted.toArrow()["term"].combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            row, words = np.repeat(np.arange(len(size)), size), lists.flatten()
            if kept is not None:
                code = pc.index_in(words, value_set=kept.value)
                there = code.is_valid().to_numpy(zero_copy_only=False)
                row, code, words = row[there], code.drop_null().to_numpy(zero_copy_only=False), kept.value
            else:
                encoded = words.dictionary_encode()
                code, words = encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary
            width = max(1, len(words))
            pair, tf = np.unique(row * width + code, return_counts=True)
            ends = np.concatenate([[0], np.cumsum(np.bincount(pair // width, minlength=len(size)))]).astype(np.int32)
            terms, tfs = words.take(pa.array(pair % width)), pa.array(tf.astype(np.int32))
            cols = [b.column(0), pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, tfs)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "doc_len", "terms", "tfs"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, doc_len int, terms array<string>, tfs array<int>")


def _bm25_block(sets: pa.Table, docs: pa.Table, average: float, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``sets``, rows of ``docs`` and scores of the best ``k`` pairs of each set, ties by the documents' ids."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not sets.num_rows or not docs.num_rows:
        return none
    by_id = pc.sort_indices(docs["id"]).to_numpy()  # so that the lesser place is the lesser id
    place = np.empty(len(by_id), np.int64)
    place[by_id] = np.arange(len(by_id))
    lists, length = docs["terms"].combine_chunks(), docs["doc_len"].to_numpy()
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    doc, tf = np.repeat(place, size), docs["tfs"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    w = tf * (scores.K1 + 1) / (tf + scores.K1 * (1 - scores.B + scores.B * np.repeat(length, size) / average))  # as bm25_tf
    encoded = lists.flatten().dictionary_encode()
    code = encoded.indices.to_numpy(zero_copy_only=False)
    asked = sets["terms"].combine_chunks()
    term = pc.fill_null(pc.index_in(asked.flatten(), value_set=encoded.dictionary), -1).to_numpy(zero_copy_only=False)
    idf = np.zeros(len(encoded.dictionary) + 1)  # the last for terms that no document of the block has
    idf[term] = sets["idfs"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    doc, w = doc[order], (w * idf[code])[order]
    ends = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(encoded.dictionary)))])
    first = np.concatenate([[0], np.cumsum(pc.list_value_length(asked).to_numpy(zero_copy_only=False))])
    n, group = len(by_id), 64
    s, dense = np.zeros(-(-n // group) * group), {}
    who, at, score = [], [], []
    for i in range(sets.num_rows):
        s[:] = 0
        for t in term[first[i] : first[i + 1]]:
            if t < 0:
                continue
            a, b = ends[t], ends[t + 1]
            if b - a < n // 8:
                s[doc[a:b]] += w[a:b]
                continue
            if t not in dense and len(dense) < DENSE_TERMS:
                dense[t] = np.zeros(n)
                dense[t][doc[a:b]] = w[a:b]
            if t in dense:
                s[:n] += dense[t]
            else:
                s[doc[a:b]] += w[a:b]
        least = 0.0
        if k is not None and len(s) > k * group:  # at least k documents reach the k-th of the groups' highest scores
            least = np.partition(s.reshape(-1, group).max(1), -k)[-k] - 2e-9
        j = np.flatnonzero(s > max(least, 0.0))
        x = s[j]
        if k is not None:
            x = np.round(x, 9)
            best = np.lexsort((j, -x))[:k]
            j, x = j[best], x[best]
        who.append(np.full(len(j), i))
        at.append(j)
        score.append(x)
    return np.concatenate(who), by_id[np.concatenate(at)].astype(np.int64), np.concatenate(score)


def _vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column as they are, and their lengths."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    parts = [np.linalg.norm(x[a : a + 8192].astype(np.float64), axis=1) for a in range(0, len(x), 8192)]
    return x, np.maximum(np.concatenate(parts), 1e-300)


def _best_cosines(s: np.ndarray, q: np.ndarray, x: np.ndarray, x_norm: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``q`` (of length 1), rows of ``x`` and exact cosines of the best ``k`` of each query, with all ties to 9 digits.

    ``s`` are the cosines in single precision, -inf where a row doesn't count; they only choose what is computed exactly.
    """
    grouped = s.reshape(len(s), GROUP, -1)
    high = grouped.max(1)
    some = high if high.shape[1] >= 4 * k else s  # at least k rows reach the k-th of the groups' highest values
    most = min(k, some.shape[1])
    cut = np.maximum(-np.partition(-some, most - 1, axis=1)[:, most - 1] - SLACK, -2)
    i, at = np.nonzero(high >= cut[:, None])
    row, place = np.nonzero(grouped[i, :, at] >= cut[i, None])
    i, j = i[row], at[row] + place * high.shape[1]
    exact = np.einsum("nd,nd->n", q[i], x[j] / x_norm[j, None])
    order = np.lexsort((-exact, i))
    i, j, exact = i[order], j[order], exact[order]
    first, end = np.searchsorted(i, np.arange(len(s))), np.searchsorted(i, np.arange(len(s)), side="right")
    last = np.minimum(first + k, end) - 1  # of each query the k-th
    ok = exact >= exact[last[i]] - 2e-9 if len(i) else np.zeros(0, bool)  # all ties of the score rounded to 9 digits stay for the final ranking
    return i[ok], j[ok], exact[ok]


def knn_candidates(docs: DataFrame, queries: DataFrame, k: int, vec_col: str = "embedding", id_col: str = "id", dim: int = 64, group_col: str | None = None) -> DataFrame:
    """``query_id, id, score``: of each block of documents the ``k`` of the highest cosine for each query, all ties to 9 digits included.

    Both sides hold usable vectors only and are cut into blocks by the hash of their ids; each block of queries meets
    each block of documents in one task, so neither side passes through the driver or has to fit anywhere as a whole.
    With ``group_col`` (an integer of both sides) only documents of a query's group count.
    """
    spark = docs.sparkSession
    n, m = queries.count(), docs.count()
    q_blocks = max(1, -(-n // QUERY_ROWS))
    d_blocks = max(1, -(-m // VECTOR_ROWS), min(2 * spark.sparkContext.defaultParallelism // q_blocks, -(-m // 512)))

    def side(df: DataFrame, key: str, blocks: int, own: str, other: str, others: int) -> DataFrame:
        group = F.col(group_col).cast("int") if group_col else F.lit(0)
        kind = "array<float>" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"  # floats travel as such
        return _blocks(df.select(F.col(key).alias("k"), F.col(vec_col).cast(kind).alias("v"), group.alias("g")), "k", blocks, own, other, others)

    left = side(queries, "query_id", q_blocks, "q", "d", d_blocks).groupBy("q", "d")
    right = side(docs, id_col, d_blocks, "d", "q", q_blocks).groupBy("q", "d")

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        who, at, score = [], [], []
        if asked.num_rows and held.num_rows:
            (q, q_norm), (x, x_norm) = (_vectors(t["v"].combine_chunks(), dim) for t in (asked, held))
            single = np.zeros((len(x) + -len(x) % GROUP, dim), np.float32)
            np.divide(x, x_norm[:, None], out=single[: len(x)], casting="same_kind")
            g, h = asked["g"].to_numpy(), np.resize(held["g"].to_numpy(), len(single))
            room = np.empty((AT_ONCE, len(single)), np.float32)
            for a in range(0, len(q), AT_ONCE):
                b = q[a : a + AT_ONCE] / q_norm[a : a + AT_ONCE, None]
                s = np.matmul(b.astype(np.float32), single.T, out=room[: len(b)])
                s[:, len(x) :] = -np.inf
                if group_col:
                    s[g[a : a + AT_ONCE, None] != h[None, :]] = -np.inf
                i, j, exact = _best_cosines(s, b, x, x_norm, k)
                who.append(i + a)
                at.append(j)
                score.append(exact)
        cols = [np.concatenate(c) if c else np.zeros(0, t) for c, t in ((who, np.int64), (at, np.int64), (score, np.float64))]
        return pa.table([asked["k"].take(pa.array(cols[0])), held["k"].take(pa.array(cols[1])), pa.array(cols[2])], names=["query_id", "id", "score"])

    kind_q, kind_d = queries.schema["query_id"].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    return left.cogroup(right).applyInArrow(meet, f"query_id {kind_q}, id {kind_d}, score double")


def exact_knn(docs: DataFrame, queries: DataFrame, k: int, vec_col: str = "embedding", id_col: str = "id", dim: int = 64) -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` documents of the highest cosine, ties by id (see ``knn_candidates``)."""
    queries = materialize(queries.select("query_id", F.col(vec_col).alias("v_")))
    once = materialize(queries.groupBy("v_").agg(F.min("query_id").alias("query_id")))  # queries of one vector are searched once
    hits = knn_candidates(docs, once.select("query_id", F.col("v_").alias(vec_col)), k, vec_col, id_col, dim)
    hits = ranked(hits.withColumn("score", F.round("score", 9)), k)
    if once.count() == queries.count():
        return hits
    names = queries.join(once.withColumnRenamed("query_id", "of_"), "v_").select("query_id", "of_")
    return hits.withColumnRenamed("query_id", "of_").join(names, "of_").select("query_id", "id", "score", "rank")


def fuse(legs: list[DataFrame], k: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: ``query_id, id, score, rank`` from ranked legs; ties by first leg, then by rank in it."""
    rows = None
    for no, leg in enumerate(legs):
        x = leg.select("query_id", "id", "rank", F.lit(no).alias("leg"))
        rows = x if rows is None else rows.unionByName(x)
    fused = rows.groupBy("query_id", "id").agg(F.sum(scores.rrf(F.col("rank"))).alias("score"), F.min(F.struct("leg", "rank")).alias("seen"))
    return ranked(fused, k, tie=[F.col("seen"), F.col("id")]).drop("seen")


def hybrid(docs: DataFrame, text: Column, queries: DataFrame, query_text: Column, pool: int = 15, vec_col: str = "embedding") -> DataFrame:
    """``stage, query_id, id, score, rank`` of the stages ``dense``, ``bm25`` and ``fused``; the two legs are written once."""
    dense = materialize(exact_knn(docs.where("usable"), queries.where("usable"), pool, vec_col))
    lexical = materialize(ranked(bm25(docs, text, queries, query_text, pool).withColumn("score", F.round("score", 9)), pool))
    both = fuse([dense, lexical])
    cols = ["query_id", "id", "score", "rank"]
    out = [x.select(F.lit(name).alias("stage"), *cols) for name, x in (("dense", dense), ("bm25", lexical), ("fused", both))]
    return out[0].unionByName(out[1]).unionByName(out[2])


def reranked(fused: DataFrame, k: int) -> DataFrame:
    """The stage ``reranked`` without a model: the first ``k`` by score, ties as they were ranked."""
    return ranked(fused.withColumnRenamed("rank", "was"), k, tie=[F.col("was"), F.col("id")]).drop("was")


def retried(hits: DataFrame, top_k: int, attempts: int, step: int = 3) -> DataFrame:
    """``attempt`` and the hits that each attempt sees: ``step`` more with every retry."""
    rows = hits.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    return rows.where(F.col("rank") < top_k + step * F.col("attempt"))


def accumulate(hits: DataFrame) -> DataFrame:
    """Hits of several sub-queries as one list: ``query_id, id, score, rank``, each id at its highest score, ties by first seen.

    ``hits`` has ``query_id, step, id, score, rank``.
    """
    best = hits.groupBy("query_id", "id").agg(F.max("score").alias("score"), F.min(F.struct("step", "rank")).alias("seen"))
    return ranked(best, tie=[F.col("seen"), F.col("id")]).drop("seen")
