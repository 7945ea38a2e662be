"""Selection of pages, bookkeeping of loads, and the way from test rows back to their pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import join_checked, materialize

#: Words in a row that tie a passage to the documents that may hold it.
ANCHOR = 5


def skip_reasons(rows: DataFrame, reason: Column) -> DataFrame:
    """``reason, pages``: how many rows were left out for which reason; kept rows have none."""
    return rows.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("pages"))


def round_robin(ranked: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` of pages ``url, service, rank``: every service's first page, then every second, and so on; with ``place``."""
    first = ranked.orderBy("rank", "service").limit(cap)
    return first.withColumn("place", F.row_number().over(Window.orderBy("rank", "service")) - 1)  # at most cap rows


def cache_key(version: Column, model: Column, document: Column, chunk: Column) -> Column:
    """SHA-256 of what a generated context depends on, with null characters between the parts."""
    return F.sha2(F.concat_ws("\u0000", *(F.coalesce(c, F.lit("")) for c in (version, model, document, chunk))), 256)


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Rows of ``wanted`` whose ``key`` the cache lacks."""
    return wanted.join(cache.select(key).distinct(), key, "left_anti")


def summary_documents(nodes: DataFrame) -> DataFrame:
    """Summary nodes as documents: titled by their level, without url, chunk number and context."""
    title = F.concat(F.lit("Summary of level "), F.col("level").cast("string"))
    return nodes.select("id", title.alias("title"), F.lit("").alias("url"), F.lit(0).alias("chunk_id"), F.coalesce("content", F.lit("")).alias("content"), F.lit("").alias("context"), "level")


def tree_documents(rows: DataFrame) -> DataFrame:
    """Leaves and summaries of a tree (``level`` 0 and above) as one table of documents."""
    cols = ["id", "title", "url", "chunk_id", "content", "context", "level"]
    return rows.where("level = 0").select(*cols).unionByName(summary_documents(rows.where("level > 0")))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _runs(words: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` words."""
    none = F.array().cast("array<bigint>")

    def of(ws: Column) -> Column:
        last = F.size(ws) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.array_join(F.slice(ws, i + 1, n), " ")))).otherwise(none)

    return F.transform(F.array(words), of)[0]  # binds the words once, not once for each run


def holding(probes: DataFrame, docs: DataFrame, anchor: int = ANCHOR) -> DataFrame:
    """``probe_id, doc_id`` of every document (``doc_id, text``) that contains the ``probe`` of a row (``probe_id, probe``).

    The words within a probe, without its first and last, which may be cut, stand in a row in every text that contains it.
    Of probes with enough of them one run of ``anchor`` words, the rarest of the documents, ties them to the few documents
    with that run, and only these are looked through. Shorter probes are tied by their longest inner word, and those
    without any by nothing: they are held against all documents. Empty and null probes give nothing.
    """
    probes = probes.where("coalesce(probe, '') != ''").select("probe_id", "probe", F.slice(F.split("probe", r"\s+"), 2, F.greatest(F.size(F.split("probe", r"\s+")) - 2, F.lit(0))).alias("inner"))
    probes = materialize(probes.withColumn("inner", F.filter("inner", lambda w: w != "")))
    out = None
    for n, rows in ((anchor, probes.where(F.size("inner") >= anchor)), (1, probes.where((F.size("inner") < anchor) & (F.size("inner") > 0)))):
        if n > 1:
            runs = rows.select("probe_id", F.explode(F.array_distinct(_runs(F.col("inner"), n))).alias("run"))
        else:
            longest = F.array_max(F.transform("inner", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
            runs = rows.select("probe_id", F.xxhash64(longest).alias("run"))
        runs = materialize(runs)
        if runs.isEmpty():
            continue
        wanted = materialize(runs.select("run").distinct())
        held = docs.select("doc_id", F.explode(F.array_distinct(_runs(_words(F.col("text")), n))).alias("run"))
        held = materialize(join_checked(held, wanted, ["run"], "left_semi", 24))
        often = held.groupBy("run").agg(F.count("*").alias("n"))
        # a run that no document has means that none holds the probe
        best = runs.join(often, "run", "left").groupBy("probe_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("b"))
        pairs = best.where("b.n > 0").select("probe_id", F.col("b.run").alias("run")).join(held, "run").select("probe_id", "doc_id")
        found = pairs.join(rows.select("probe_id", "probe"), "probe_id").join(docs.select("doc_id", "text"), "doc_id")
        found = found.where(F.contains("text", F.col("probe"))).select("probe_id", "doc_id")
        out = found if out is None else out.unionByName(found)
    bare = materialize(probes.where(F.size("inner") == 0).select("probe_id", "probe"))
    if out is None or not bare.isEmpty():
        loose = docs.join(bare, F.contains("text", F.col("probe"))).select("probe_id", "doc_id")
        out = loose if out is None else out.unionByName(loose)
    return out


def rows_to_items(rows: DataFrame, docs: DataFrame, clip: int = 200) -> DataFrame:
    """``question, ground_truth, ground_truth_context, tags`` of generated rows (``row_id, question, reference, context``).

    The gold url is that of the first document (``doc_id, url, text``, in order of ``doc_id``) that contains the first
    ``clip`` characters of the row's context. Rows without such a document, url or reference are left out.
    """
    probes = rows.where("coalesce(reference, '') != ''").select(F.col("row_id").alias("probe_id"), F.substring("context", 1, clip).alias("probe"))
    found = holding(probes, docs).groupBy("probe_id").agg(F.min("doc_id").alias("doc_id")).join(docs.select("doc_id", "url"), "doc_id")
    kept = rows.join(found.where("coalesce(url, '') != ''").select(F.col("probe_id").alias("row_id"), "url"), "row_id")
    return kept.select("row_id", "question", F.col("reference").alias("ground_truth"), F.col("url").alias("ground_truth_context"), F.array(F.lit("synthetic")).alias("tags"))
