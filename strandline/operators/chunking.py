"""Sections, breadcrumbs and windows of markdown pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import materialize, running
from ..functions.text import decorated
from ..functions.urls import document_id

# Fixed value: what a heading line looks like.
HEADING = r"^(#{1,6})\s+(.+?)\s*$"
LEVELS = range(1, 7)


def headings(docs: DataFrame, id_col: str = "id", text_col: str = "content", title_col: str = "title") -> DataFrame:
    """``id, section_no, level, heading, breadcrumb`` of every heading outside fences.

    Only lines that are a fence or look like a heading leave the scan, so windows sort a few lines a page. The
    breadcrumb is the page's title and the open headings, joined by `` > ``, empty ones left out.
    """
    lines = F.split(F.regexp_replace(F.col(text_col), "\r\n", "\n"), "\n")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.trim(F.col(title_col)), F.lit("")).alias("title"), F.posexplode(lines).alias("line_no", "line"))
    rows = rows.withColumn("fence", F.rlike(F.col("line"), F.lit(r"^\s*```")).cast("int")).where(F.col("line").rlike(HEADING) | (F.col("fence") == 1))
    order = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("fences", F.sum("fence").over(order)).where("fence = 0 and fences % 2 = 0")
    rows = rows.select("id", "title", "line_no", F.length(F.regexp_extract("line", HEADING, 1)).alias("level"), F.regexp_extract("line", HEADING, 2).alias("heading"))
    rows = rows.withColumn("section_no", F.row_number().over(Window.partitionBy("id").orderBy("line_no")))
    last = {n: F.last(F.when(F.col("level") == n, F.struct("section_no", "heading")), ignorenulls=True).over(order) for n in LEVELS}
    rows = rows.select("*", *(c.alias(f"l{n}") for n, c in last.items()))
    open_ = []
    for n in LEVELS:
        above = [F.coalesce(F.col(f"l{m}.section_no"), F.lit(0)) for m in LEVELS if m < n]
        newest = F.greatest(*above, F.lit(0)) if above else F.lit(0)
        open_.append(F.when((F.col(f"l{n}.section_no") > newest) & (F.lit(n) <= F.col("level")), F.col(f"l{n}.heading")))
    crumb = F.array_join(F.filter(F.array(F.col("title"), *open_), lambda x: F.coalesce(x, F.lit("")) != ""), " > ")
    return rows.select("id", "section_no", "level", "heading", crumb.alias("breadcrumb"))


def sections(docs: DataFrame, id_col: str = "id", text_col: str = "content", title_col: str = "title") -> DataFrame:
    """``id, section_no, breadcrumb, text``: each section with its heading line, and section 0 before the first heading.

    The breadcrumb is the page's title and the headings that are open, joined by `` > ``, empty ones left out. Lines in
    fences are no headings. One pass over a row's lines finds where its sections begin; nothing is shuffled. A null text
    has no section; an empty one has the empty section 0.
    """
    lines = F.split(F.regexp_replace(F.col(text_col), "\r\n", "\n"), "\n")
    title = F.coalesce(F.trim(F.col(title_col)), F.lit(""))
    path_type, mark_type = "array<struct<level: int, title: string>>", "array<struct<line: int, crumb: string>>"
    crumb = lambda head, path: F.array_join(F.filter(F.concat(F.array(head), F.transform(path, lambda h: h["title"])), lambda x: x != ""), " > ")

    def step(state: Column, line: Column) -> Column:
        fence = F.rlike(line, F.lit(r"^\s*```"))
        heads = ~state["fenced"] & ~fence & F.rlike(line, F.lit(HEADING))
        level, name = F.length(F.regexp_extract(line, HEADING, 1)), F.regexp_extract(line, HEADING, 2)
        path = F.when(heads, F.concat(F.filter(state["path"], lambda h: h["level"] < level), F.array(F.struct(level.alias("level"), name.alias("title"))))).otherwise(state["path"])
        mark = F.when(heads, F.concat(state["marks"], F.array(F.struct(state["line"].alias("line"), crumb(state["title"], path).alias("crumb"))))).otherwise(state["marks"])
        return F.struct((state["line"] + 1).alias("line"), (state["fenced"] != fence).alias("fenced"), state["title"].alias("title"), path.cast(path_type).alias("path"), mark.cast(mark_type).alias("marks"))

    first = F.array(F.struct(F.lit(0).alias("line"), F.col("title").alias("crumb"))).cast(mark_type)
    start = F.struct(F.lit(0).alias("line"), F.lit(False).alias("fenced"), F.col("title").alias("title"), F.array().cast(path_type).alias("path"), first.alias("marks"))
    rows = docs.select(F.col(id_col).alias("id"), title.alias("title"), lines.alias("lines")).where("lines is not null")
    rows = rows.withColumn("marks", F.aggregate("lines", start, step)["marks"])
    end = lambda i: F.coalesce(F.get("marks", i + 1)["line"], F.size("lines"))
    parts = F.transform("marks", lambda m, i: F.struct(m["crumb"].alias("breadcrumb"), F.array_join(F.slice("lines", m["line"] + 1, end(i) - m["line"]), "\n").alias("text")))
    return rows.select("id", F.posexplode(parts).alias("section_no", "s")).select("id", "section_no", "s.breadcrumb", "s.text")


def window_bounds(sizes: np.ndarray, spaces: np.ndarray, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts that lie one behind the other: number of the text, start and end, in order.

    ``sizes`` are the texts' lengths, ``spaces`` the places of spaces in the whole, rising. All texts take one window at a
    time: it reaches ``size`` characters on or, where the text goes on, to the last space within them; the next starts
    ``overlap`` characters before its end, but at least one further on.
    """
    ends = np.cumsum(sizes)
    text = np.flatnonzero(sizes > 0)
    at = (ends - sizes)[text]
    out: list[np.ndarray] = []
    while len(text):
        reach = np.minimum(at + size, ends[text])
        before = np.searchsorted(spaces, reach)
        space = np.where(before > 0, np.append(spaces, -1)[before - 1], -1)
        stop = np.where((reach < ends[text]) & (space > at), space, reach)
        out.append(np.stack([text, at, stop]))
        on = stop < ends[text]
        text, at = text[on], np.maximum(stop - overlap, at + 1)[on]
    text, at, stop = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
    order = np.lexsort((at, text))
    return text[order], at[order], stop[order]


def windows(rows: DataFrame, keys: list[str], text_col: str, size: int, overlap: int) -> DataFrame:
    """``keys..., piece_no, piece`` for every window of every text that isn't blank, stripped, blank ones left out."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t or "").strip() for t in b.column(len(keys)).to_pylist()]
            whole = "".join(texts)
            spaces = np.flatnonzero(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
            text, at, stop = window_bounds(np.fromiter(map(len, texts), np.int64, len(texts)), spaces, size, overlap)
            pieces = [whole[a:z].strip() for a, z in zip(at, stop)]
            full = np.fromiter(map(bool, pieces), bool, len(pieces))
            text = text[full]
            no = np.arange(len(text)) - np.searchsorted(text, text)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(text)) for c in b.columns[: len(keys)]), pa.array(no.astype(np.int32)), pa.array([p for p in pieces if p], pa.string())], [*keys, "piece_no", "piece"])

    return rows.select(*keys, text_col).mapInArrow(run, f"{kinds}, piece_no int, piece string")


def chunk_windows(docs: DataFrame, id_col: str = "id", text_col: str = "content", size: int = 1000, overlap: int = 100) -> DataFrame:
    """``id, chunk_no, chunk`` for every window of every text; a null or blank text has none."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return windows(rows, ["id"], "text", size, overlap).withColumnsRenamed({"piece_no": "chunk_no", "piece": "chunk"})


def section_chunks(docs: DataFrame, id_col: str = "id", text_col: str = "content", title_col: str = "title", size: int = 2000, overlap: int = 200) -> DataFrame:
    """``id, section_no, piece_no, breadcrumb, chunk``: markdown cut at its headings, larger sections into windows.

    Blank sections give nothing; every chunk carries the breadcrumb of its section.
    """
    return windows(sections(docs, id_col, text_col, title_col), ["id", "section_no", "breadcrumb"], "text", size, overlap).select("id", "section_no", "piece_no", "breadcrumb", F.col("piece").alias("chunk"))


def chunk_documents(pages: DataFrame, note: Column | None = None) -> DataFrame:
    """``id, title, url, chunk_id, content, context`` of every chunk of the ``pages`` (``id, title, url, content, chunk_id``).

    The chunks of one url are numbered in reading order, blank ones not counted; the document id is made of url and number.
    The context is the breadcrumb and, on a line of its own, the situating ``note`` of the page where there is one; without
    ``note`` it is empty (the baseline). Pages without url take no part.
    """
    rows = pages.where("url is not null").select("id", "title", "url", "content", F.col("chunk_id").alias("page_place"), (note if note is not None else F.lit(None).cast("string")).alias("note"))
    chunks = materialize(section_chunks(rows))
    counts = chunks.groupBy("id").agg(F.count("*").alias("n"))
    counts = rows.select("id", "url", "page_place").join(counts, "id")
    base = running(counts, ["url"], ["page_place", "id"], {"end": F.col("n")}).select("id", (F.col("end") - F.col("n")).alias("base"), "n")
    own = running_in_row(chunks)
    out = own.join(base, "id").join(rows.select("id", "title", "url", "note"), "id")
    no = (F.col("base") + F.col("ordinal")).cast("int")
    context = decorated(F.col("breadcrumb"), F.col("note")) if note is not None else F.lit("")
    return out.select(document_id(F.col("url"), no).alias("id"), F.coalesce("title", F.lit("")).alias("title"), "url", no.alias("chunk_id"), F.col("chunk").alias("content"), context.alias("context"))


def running_in_row(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``ordinal``: the place of a chunk among those of its page's row."""
    order = Window.partitionBy("id").orderBy("section_no", "piece_no")
    return chunks.withColumn("ordinal", F.row_number().over(order) - 1)
