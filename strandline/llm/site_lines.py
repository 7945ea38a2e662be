"""Lines repeated across one site's documents (problem 3).

Every line is reduced to its letters in lower case and hashed together with its site to 128 bits, once; the documents of
each (site, line) are counted with map-side partial sums; keys over the thresholds (a number of documents, a share of
the site's) are joined back to the lines. A line
that stands in a third of all documents is one partial count for each map task, so it makes no hot reducer; on the way
back it is the small side that is broadcast if its counted size allows, else AQE splits the hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import first_rows, host, join_checked, materialize, spread

#: A line counts as repeated when at least this many distinct documents of its site hold it (a share may be asked as well).
MIN_DOCS = 8
#: Shorter lines (in letters) never count.
MIN_LETTERS = 20


def letters(line: Column) -> Column:
    """Letters (Unicode category L) of a line in lower case, in order."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")


def line_keys(content: Column, site: Column, min_letters: int = MIN_LETTERS) -> Column:
    """For each line split at ``\\n``: a 128-bit key of (site, letters), or null for a line with too few letters."""

    def key(line: Column) -> Column:
        x = letters(line)
        return F.when(F.length(x) >= min_letters, F.struct(F.xxhash64(x, site).alias("a"), F.xxhash64(F.lit("second"), site, x).alias("b")))

    return F.transform(F.split(content, "\n"), key)


def _keyed(docs: DataFrame, id_col: str, url_col: str, text_col: str, order_col: str | None, min_letters: int) -> DataFrame:
    """Written table ``id, site, keys``: the keys of each document's lines, worked out once."""
    rows = docs.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("site"), F.col(text_col).alias("text"), (F.col(order_col) if order_col else F.lit(0)).alias("ord"))
    rows = first_rows(spread(rows.where("site is not null and text is not null")), "id", [F.col("ord").asc_nulls_last()])
    return materialize(rows.select("id", "site", line_keys(F.col("text"), F.col("site"), min_letters).alias("keys")))


def _frequent(keyed: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    """Written table ``a, b, site, documents, of`` of the keys over the thresholds; ``of`` counts the site's documents."""
    seen = keyed.select("site", F.explode(F.array_distinct("keys")).alias("k")).where("k is not null")
    counted = seen.groupBy("k.a", "k.b").agg(F.first("site").alias("site"), F.count("*").alias("documents")).where(F.col("documents") >= min_docs)
    sites = materialize(keyed.groupBy("site").agg(F.count("*").alias("of")))
    return materialize(join_checked(counted, sites, ["site"], "inner", 96).where(F.col("documents") >= min_share * F.col("of")).select("a", "b", "site", "documents", "of"))


def repeated_lines(docs: DataFrame, id_col: str = "id", url_col: str = "url", text_col: str = "content", order_col: str | None = "ingested_at", min_docs: int = MIN_DOCS, min_share: float = 0.0, min_letters: int = MIN_LETTERS) -> DataFrame:
    """Lines of each document that stand in at least ``min_docs`` distinct documents, and a share of at least
    ``min_share`` of the documents, of the same site.

    Returns ``id, line_no`` (1-based, lines split at ``\\n``). Rows of one id count once (the earliest by
    ``order_col``); rows with null id, text or a url without host take no part; a line that a document holds several
    times counts once for it, and each of its places comes out; an empty table gives an empty result. Other columns
    of ``docs`` are ignored, whatever their names.
    """
    keyed = _keyed(docs, id_col, url_col, text_col, order_col, min_letters)
    frequent = _frequent(keyed, min_docs, min_share).select("a", "b")
    lines = keyed.select("id", F.posexplode("keys").alias("p", "k")).where("k is not null").select("id", (F.col("p") + 1).cast("int").alias("line_no"), "k.a", "k.b")
    return join_checked(lines, frequent, ["a", "b"], "left_semi", 64).select("id", "line_no")


def line_shares(docs: DataFrame, id_col: str = "id", url_col: str = "url", text_col: str = "content", order_col: str | None = "ingested_at", min_docs: int = MIN_DOCS, min_share: float = 0.0, min_letters: int = MIN_LETTERS) -> DataFrame:
    """``site, line_key, documents, share`` of each repeated line: in how many of its site's documents it stands."""
    rows = _frequent(_keyed(docs, id_col, url_col, text_col, order_col, min_letters), min_docs, min_share)
    return rows.select("site", F.concat_ws("-", F.hex("a"), F.hex("b")).alias("line_key"), "documents", (F.col("documents") / F.col("of")).alias("share"))


def without_lines(docs: DataFrame, lines: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """``docs`` with column ``cleaned``: the text without the listed lines, the others in order.

    ``lines`` has ``id, line_no``. Documents without listed lines keep their text as it is; a null text stays null;
    every row of ``docs`` comes out once, repeated ids included, with all its columns; one that is called ``cleaned`` is replaced.
    """
    drop = lines.groupBy(F.col("id").alias("_listed_id_")).agg(F.collect_set("line_no").alias("_listed_lines_"))
    joined = docs.join(drop, docs[id_col] == drop["_listed_id_"], "left")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(F.col("_listed_lines_"), (i + 1).cast("int"))), "\n")
    return joined.withColumn("cleaned", F.when(F.col("_listed_lines_").isNull(), F.col(text_col)).otherwise(kept)).drop("_listed_id_", "_listed_lines_")
