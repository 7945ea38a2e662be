"""Main body of pages (problem 2): a tree-structured graphical model over the nodes of a page.

The nodes of a page are its lines that aren't blank; a block's lines form a branch, a fence's lines hang on its opening
line, and a block hangs on the heading above it, or on the page if
it starts with a heading itself or has none above. Each node is article or furniture. Node potentials come
from a logistic model of the line's words, shape and place; parent-child potentials, one table for each pair of shapes,
from the labels of parents and children. Both are trained on labelled pages (``page_labels``). Sum-product messages
passed up and down each tree give the marginal of every line exactly.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import first_rows, host, spread
from .page_labels import label_lines, reduced
from .site_lines import without_lines

#: The model is trained on at most so many labelled pages, taken by the hash of their id, at most so many of one site.
TRAINING_PAGES = 3000
TRAINING_PAGES_OF_SITE = 120
TRAINING_CHARS = 50_000
#: A word, or word at an end, needs so many labelled lines to get a weight.
MIN_LINES = 3
#: So many edges of the rarest label halve the shrinking of a table of parent-child potentials.
EDGE_PRIOR = 10.0
#: Documents whose trees are handled together; a matter of speed only.
TREES = 256
#: A line is furniture from this marginal on.
THRESHOLD = 0.5

SHAPES = {"heading": 0, "item": 1, "link": 2, "table": 3, "code": 4, "sentence": 5, "phrase": 6, "quote": 7}
_N = len(SHAPES)
#: Relations of a node to its parent: next in its block, first of a block under a heading, first of a block of the page.
_CHAIN, _UNDER, _TOP = 0, 1, 2
_ITEM = re.compile(r"\s*(?:[-*•]|\d+[.)])\s+")
_TARGET = re.compile(r"\]\(([^)]*)\)")


@dataclass
class Page:
    """Nodes of one page: numbers of their lines (from 1), parents (-1: the page), depths, relations, shapes, feature names."""

    line_no: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    relation: list[int] = field(default_factory=list)
    shape: list[int] = field(default_factory=list)
    line: list[str] = field(default_factory=list)
    place: list[str] = field(default_factory=list)


def _shape(line: str) -> int:
    s = line.strip()
    if s.startswith("#") and re.match(r"#{1,6}\s", s):
        return SHAPES["heading"]
    if s.startswith(">"):
        return SHAPES["quote"]
    if s.startswith("|") and s.count("|") >= 4:
        return SHAPES["table"]
    if "](" in s:
        return SHAPES["link"]
    if _ITEM.match(line):
        return SHAPES["item"]
    if line.startswith("    "):
        return SHAPES["code"]
    return SHAPES["sentence" if s.rstrip("*_ ").endswith((".", "?", "!", ":", "。")) else "phrase"]


#: What the name of the page's own site becomes in a line.
BRAND = "thissite"


def brand_pattern(url: str | None) -> re.Pattern | None:
    """Finds the site's name (the words of its host's second-level label) in a line; None without a host."""
    labels = re.sub(r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?", "", (url or "").strip().lower()).split("/")[0].split(":")[0].split(".")
    words = [w for w in labels[-2].split("-") if len(w) >= 4] if len(labels) > 1 else []
    return re.compile(r"(?i)\b(?:" + "|".join(map(re.escape, words)) + r")\b") if words else None


def _ends(page: Page) -> None:
    """Add to every node's place how near it is to the page's ends, in nodes outside fences."""
    open_ = [i for i, line in enumerate(page.line) if line]
    for n, i in enumerate(open_):
        rest = len(open_) - 1 - n
        page.place[i] += f" @begin{min(n.bit_length(), 4)} @rest{min(rest.bit_length(), 4)}"


def parse(text: str, url: str | None = None) -> Page:
    """The tree of a page; the parent of every node comes before it. The name of the site of ``url`` is one word for all sites."""
    page, fence, brand = Page(), -1, brand_pattern(url)
    head, last, in_block = -1, -1, 0
    headings = {reduced(x) for x in re.findall(r"(?m)^#{1,6}\s+(.+?)\s*$", text)}
    for no, raw in enumerate(text.split("\n"), 1):
        line = raw.rstrip("\r")
        s = line.strip()
        if not s:
            if fence < 0:
                last, in_block = -1, 0
            continue
        i = len(page.line_no)
        opens = s.startswith("```")
        if fence >= 0:
            shape, parent, relation = SHAPES["code"], fence, _CHAIN
        else:
            shape = SHAPES["code"] if opens else _shape(line)
            parent, relation = (last, _CHAIN) if last >= 0 else (head, _UNDER) if head >= 0 and shape != SHAPES["heading"] else (-1, _TOP)
        page.line_no.append(no)
        page.parent.append(parent)
        page.depth.append(page.depth[parent] + 1 if parent >= 0 else 0)
        page.relation.append(relation)
        page.shape.append(shape)
        page.line.append("" if fence >= 0 or opens else brand.sub(BRAND, line) if brand else line)
        page.place.append("fence" if fence >= 0 or opens else ("listed" if shape != 0 and reduced(line) in headings else "top" if head < 0 else "under") + str(min(in_block, 2)))
        in_block += 1
        if opens:
            fence, last = (i, last) if fence < 0 else (-1, fence)
            if fence < 0:
                last = page.parent[i]
        elif fence < 0:
            last = i
            if shape == SHAPES["heading"]:
                head = i
    _ends(page)
    return page


def features(line: str, place: str, shape: int) -> list[str]:
    """Names of a line's features: its words, the first and the last of them, its shape, size, targets and place."""
    place, *ends = place.split(" ")
    if not line:
        return ["@" + place]
    words = reduced(line).split()
    target = _TARGET.search(line)
    t = "" if not target else "#" if target[1].startswith("#") else "/" if target[1].startswith("/") else "." if "." in target[1] else "x"
    s = line.strip().rstrip("*_|» ")
    out = list(dict.fromkeys(words)) + ends
    if words:
        out += ["^" + words[0], "$" + words[-1]]
        out += [a + " " + b for a, b in zip(words[:4], words[1:4])]
    out += [f"@{place}", f"@shape{shape}", f"@n{min(len(words), 12)}", f"@end{s[-1:] if not s[-1:].isalnum() else 'a'}", f"@to{t}", f"@bar{' | ' in s.strip('| ')}", f"@place{place[:-1]}{shape}", f"@colon{':' in line}", f"@size{min(len(s) // 30, 8)}", f"@longest{min(max(map(len, s.split()), default=0) // 12, 3)}"]
    if s.startswith("#"):
        out.append("@hash")
    return out


@dataclass
class Model:
    """Weights of line features, and tables of log potentials by ``relation, shape of parent, shape, label of parent, label``."""

    weight: dict[str, float]
    edge: np.ndarray
    top: np.ndarray


def train(pages: Iterable[tuple[str, str | None]], rounds: int = 400, decay: float = 2e-3) -> Model:
    """Fit the potentials to labelled pages (text, url): the nodes' by regularised logistic regression, the edges' by counts."""
    seen: dict[tuple, list[int]] = {}  # lines that come again count, but are worked on once
    edge = np.zeros((3, _N, _N, 2, 2))
    top = np.ones((_N, 2))
    for text, url in pages:
        page, marks = parse(text, url), label_lines(text.split("\n"))
        y = [int(bool(marks[n - 1])) for n in page.line_no]
        for i, p in enumerate(page.parent):
            if p >= 0:
                edge[page.relation[i], page.shape[p], page.shape[i], y[p], y[i]] += 1
            else:
                top[page.shape[i], y[i]] += 1
            seen.setdefault((page.line[i], page.place[i], page.shape[i]), [0, 0])[y[i]] += 1
    lists, times = [features(*key) for key in seen], np.array(list(seen.values()), dtype=np.float64).reshape(-1, 2)
    count: Counter[str] = Counter()
    for x, t in zip(lists, times.sum(1)):
        count.update({f: int(t) for f in x})
    index = {f: i for i, f in enumerate(sorted(f for f, n in count.items() if n >= MIN_LINES))}
    row, col = [], []
    for i, x in enumerate(lists):
        for f in x:
            if (j := index.get(f)) is not None:
                row.append(i)
                col.append(j)
    r, c = np.array(row, dtype=np.int64), np.array(col, dtype=np.int64)
    w, bias = np.zeros(len(index)), 0.0
    square, square_b = np.full(len(index), 1e-8), 1e-8
    n = max(1.0, times.sum())
    for _ in range(rounds):  # Adagrad over the whole sample
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, w[c], minlength=len(lists)) + bias, -30, 30)))
        miss = p * times.sum(1) - times[:, 1]
        g = np.bincount(c, miss[r], minlength=len(index)) / n + decay / n * w
        gb = miss.sum() / n
        square += g * g
        square_b += gb * gb
        w -= 0.8 * g / np.sqrt(square)
        bias -= 0.8 * gb / math.sqrt(square_b)
    weight = {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-4}
    weight[""] = float(bias)
    # a table is shrunk towards no influence where one of its four labels is rare
    rows, cols = edge.sum(-1, keepdims=True), edge.sum(-2, keepdims=True)
    rarest = np.minimum(rows.min(-2, keepdims=True), cols.min(-1, keepdims=True))
    n_edge = edge.sum((-1, -2), keepdims=True)
    tables = (np.log(edge + 0.5) + np.log(n_edge + 2) - np.log(rows + 1) - np.log(cols + 1)) * rarest / (rarest + EDGE_PRIOR)
    share = top / top.sum(1, keepdims=True)
    prior = top.sum(0) / top.sum()
    return Model(weight, tables, np.log(share / prior))


def marginals(model: Model, pages: list[Page], score: list[float]) -> np.ndarray:
    """Log odds of furniture for every node of all pages in order: messages up, then down, all trees level by level."""
    size = np.array([len(p.line_no) for p in pages])
    base = np.concatenate([[0], np.cumsum(size)])[:-1]
    parent = np.array([q for p in pages for q in p.parent], dtype=np.int64)
    parent = np.where(parent >= 0, parent + np.repeat(base, size), -1)
    depth = np.array([q for p in pages for q in p.depth], dtype=np.int64)
    relation = np.array([q for p in pages for q in p.relation], dtype=np.int64)
    shape = np.array([q for p in pages for q in p.shape], dtype=np.int64)
    h = np.array(score, dtype=np.float64)
    rooted = parent < 0
    h[rooted] += model.top[shape[rooted], 1] - model.top[shape[rooted], 0]
    table = model.edge[relation, shape[parent], shape]  # (node, label of parent, label); unused for roots
    order = np.argsort(depth, kind="stable")
    bound = np.searchsorted(depth[order], np.arange(depth.max() + 2)) if len(depth) else np.zeros(1, np.int64)
    up = np.zeros(len(h))
    for d in range(len(bound) - 2, 0, -1):
        at = order[bound[d] : bound[d + 1]]
        t, x = table[at], h[at]
        up[at] = np.logaddexp(t[:, 1, 0], t[:, 1, 1] + x) - np.logaddexp(t[:, 0, 0], t[:, 0, 1] + x)
        np.add.at(h, parent[at], up[at])
    for d in range(1, len(bound) - 1):
        at = order[bound[d] : bound[d + 1]]
        t, x = table[at], h[parent[at]] - up[at]
        h[at] += np.logaddexp(t[:, 0, 1], t[:, 1, 1] + x) - np.logaddexp(t[:, 0, 0], t[:, 1, 0] + x)
    return h


class Scorer:
    """Node potentials with a memory for lines that come again."""

    def __init__(self, model: Model, remembered: int = 200_000):
        self.model, self.remembered, self.known = model, remembered, {}

    def __call__(self, page: Page) -> list[float]:
        weight, known, out = self.model.weight, self.known, []
        for key in zip(page.line, page.place, page.shape):
            z = known.get(key)
            if z is None:
                z = weight[""] + sum(weight.get(f, 0.0) for f in features(*key))
                if len(known) >= self.remembered:
                    known.clear()
                known[key] = z
            out.append(z)
        return out


def fit(docs: DataFrame, id_col: str = "id", url_col: str = "url", text_col: str = "content", pages: int = TRAINING_PAGES) -> Model:
    """A model from a bounded sample of labelled pages, whatever the size of ``docs``: at most ``pages`` rows of at most
    ``TRAINING_CHARS`` characters by the hash of their id, at most ``TRAINING_PAGES_OF_SITE`` of a site, all chosen in Spark. Only
    for this sample text reaches the driver."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.xxhash64(id_col).alias("h"), F.col(url_col).alias("url"), F.col(text_col).alias("text"))
    share = max(1, rows.count() // (pages * 3 // 2))
    some = rows.where((F.pmod("h", F.lit(share)) == 0) & (F.length("text") <= TRAINING_CHARS)).withColumn("site", host(F.col("url")))
    rank = Window.partitionBy("site").orderBy("h", "text")
    picked = some.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= TRAINING_PAGES_OF_SITE).orderBy("h", "text").limit(pages)
    return train((r["text"], r["url"]) for r in picked.select("text", "url").collect())


def furniture_lines(docs: DataFrame, model: Model | None = None, id_col: str = "id", url_col: str = "url", text_col: str = "content", order_col: str | None = "ingested_at") -> DataFrame:
    """``id, line_no`` of the lines that aren't part of the article (lines split at ``\\n``, numbered from 1).

    Rows of one id count once (the earliest by ``order_col``); rows with null id or text give nothing; blank lines are
    never listed; a null url is no hindrance; other columns are ignored, whatever their names. The model is small (one
    weight for each known word) and of bounded size, so it is broadcast.
    """
    model = model or fit(docs, id_col, url_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(url_col).alias("url"), (F.col(order_col) if order_col else F.lit(0)).alias("ord")).where("text is not null")
    rows = first_rows(spread(rows), "id", [F.col("ord").asc_nulls_last()]).select("id", "text", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer, least = Scorer(model), math.log(THRESHOLD / (1 - THRESHOLD))
        for batch in batches:
            for at in range(0, batch.num_rows, TREES):
                part = batch.slice(at, TREES)
                pages = [parse(t, u) for t, u in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                odds = marginals(model, pages, [z for p in pages for z in scorer(p)])
                size = [len(p.line_no) for p in pages]
                no = np.array([n for p in pages for n in p.line_no], dtype=np.int32)
                doc = np.repeat(np.arange(len(pages)), size)
                hit = odds > least
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc[hit])), pa.array(no[hit], pa.int32())], ["id", "line_no"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, line_no int")


def page_bodies(docs: DataFrame, model: Model | None = None, id_col: str = "id", url_col: str = "url", text_col: str = "content", order_col: str | None = "ingested_at") -> DataFrame:
    """``id, body``: each id's article lines in order, blank lines kept; a null text gives a null body."""
    lines = furniture_lines(docs, model, id_col, url_col, text_col, order_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("content"), (F.col(order_col) if order_col else F.lit(0)).alias("ord"))
    rows = first_rows(rows, "id", [F.col("ord").asc_nulls_last()])
    return without_lines(rows, lines).select("id", F.col("cleaned").alias("body"))
