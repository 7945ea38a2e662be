"""Splitting oversized sections at natural boundaries (problem 1).

A document is cut into sections at its headings; a section over the limit is cut into pieces by lexical cohesion. The
section is a row of units (sentences, and lines in fences and lists); at each gap between units the words of the block
before it are compared with the words of the block after it. A valley of that similarity marks a change of topic. From
the start of a piece on, the deepest valley within the size window ends the piece, and the next piece starts ``overlap``
characters before that cut.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import first_rows, spread

LIMIT = 2000
OVERLAP = 200
#: Units of the block on each side of a gap.
BLOCK = 6
#: Gaps on each side among which a valley's shoulders are looked for.
REACH = 8
#: Depth that a break adds to its valley: an empty line, a line's end, a sentence's end.
BREAK_DEPTH = {"paragraph": 0.35, "line": 0.12, "sentence": 0.0}

HEADING = re.compile(r"(#{1,6})\s+(\S.*?)\s*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=\S)|(?<=[。！？])")
_WORDS = re.compile(r"[^\W_]+")


def sections(text: str) -> list[tuple[int, list[tuple[int, str]], str]]:
    """``(section_no, headings that are open, stripped text with its heading line)`` of a document; line breaks as ``\\n``."""
    out: list[tuple[int, list[tuple[int, str]], str]] = []
    lines: list[str] = []
    path: list[tuple[int, str]] = []
    fenced, no = False, 0
    for line in text.replace("\r\n", "\n").split("\n"):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        elif not fenced and line.startswith("#") and (m := HEADING.fullmatch(line)):
            out.append((no, path, "\n".join(lines).strip()))
            level = len(m[1])
            path = [h for h in path if h[0] < level] + [(level, m[2])]
            lines, no = [], no + 1
        lines.append(line)
    out.append((no, path, "\n".join(lines).strip()))
    return out


def _units(text: str) -> tuple[list[int], list[float]]:
    """Ends of the units of a section, and what the break there adds to the depth of its valley."""
    ends: list[int] = []
    gains: list[float] = []
    at, fenced = 0, False
    for line in text.split("\n"):
        if not line.strip():
            at += len(line) + 1
            if ends:
                ends[-1] = min(at, len(text))
                gains[-1] = BREAK_DEPTH["line" if fenced else "paragraph"]
            continue
        if line.lstrip().startswith("```"):
            fenced = not fenced
        elif not fenced and len(line) > 120:
            for m in _SENTENCE.finditer(line):
                if m.end() < len(line):
                    ends.append(at + m.end())
                    gains.append(BREAK_DEPTH["sentence"])
        at += len(line) + 1
        ends.append(min(at, len(text)))
        gains.append(0.0 if fenced else BREAK_DEPTH["line"])
    ends[-1] = len(text)
    return ends, gains


class _Blocks:
    """Word counts of the blocks on both sides of a gap, with their product and squares kept up as units come and go."""

    def __init__(self) -> None:
        self.counts: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self.square = [0, 0]
        self.dot = 0

    def change(self, side: int, words: Counter[str], sign: int) -> None:
        mine, other = self.counts[side], self.counts[1 - side]
        for w, n in words.items():
            had, n = mine.get(w, 0), sign * n
            self.dot += n * other.get(w, 0)
            self.square[side] += n * (2 * had + n)
            if had + n:
                mine[w] = had + n
            else:
                del mine[w]

    def similarity(self) -> float:
        return self.dot / math.sqrt(self.square[0] * self.square[1]) if self.dot else 0.0


def cohesion(text: str, ends: list[int]) -> np.ndarray:
    """For each gap after a unit but the last: cosine of the word counts of the blocks on both sides.

    The blocks slide over the units, so what is held is the words of two blocks, however long the text is.
    """
    out = np.zeros(max(0, len(ends) - 1))
    words = (Counter(_WORDS.findall(text[a:b].lower())) for a, b in zip(chain([0], ends), ends))
    blocks, before, after = _Blocks(), deque(), deque()
    for unit in islice(words, BLOCK):
        after.append(unit)
        blocks.change(1, unit, 1)
    for gap in range(len(out)):
        unit = after.popleft()
        blocks.change(1, unit, -1)
        blocks.change(0, unit, 1)
        before.append(unit)
        if len(before) > BLOCK:
            blocks.change(0, before.popleft(), -1)
        if (unit := next(words, None)) is not None:
            after.append(unit)
            blocks.change(1, unit, 1)
        out[gap] = blocks.similarity()
    return out


def depths(similarity: np.ndarray) -> np.ndarray:
    """Depth of the valley at each gap: how far its shoulders within reach rise above it on both sides."""
    n = len(similarity)
    left, right = similarity.copy(), similarity.copy()
    for d in range(1, min(REACH, n - 1) + 1):
        np.maximum(left[d:], similarity[:-d], out=left[d:])
        np.maximum(right[:-d], similarity[d:], out=right[:-d])
    return (left - similarity) + (right - similarity)


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces of ``text``: each at most ``limit`` long, each but the first starting ``overlap`` before the end of the last."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    ends, gains = _units(text)
    places = np.array(ends[:-1], dtype=np.int64)
    depth = depths(cohesion(text, ends)) + np.array(gains[:-1]) if len(places) else np.zeros(0)
    out, start, last = [], 0, 0
    while n - start > limit:
        low, high = max(last, start + limit // 2), start + limit  # a piece ends in (low, high]
        a, b = np.searchsorted(places, [low, high], side="right")
        if a == b:
            a = int(np.searchsorted(places, last + overlap, side="right"))
        if a < b:
            end = int(places[a + int(np.argmax(depth[a:b]))])
        else:
            space = max(text.rfind(" ", last + overlap + 1, high), text.rfind("\n", last + overlap + 1, high))
            end = space + 1 if space >= 0 else high
        out.append((start, end))
        last, start = end, end - overlap
    return [*out, (start, n)]


def split_oversized(docs: DataFrame, id_col: str = "id", text_col: str = "content", title_col: str | None = "title", limit: int = LIMIT, overlap: int = OVERLAP, order_col: str | None = "ingested_at") -> DataFrame:
    """Pieces of every section over ``limit`` characters.

    Returns ``id, section_no, piece_no, start, breadcrumb, text``: ``text`` without its first ``overlap`` characters
    (but for piece 0) appended in order gives the section again. The breadcrumb is the title and the open headings,
    empty ones left out. Rows with null id or text give nothing, as do documents without an oversized section; rows of
    one id count once (the earliest by ``order_col``); a text without any space is cut at the limit; other columns are
    ignored, whatever their names.
    """
    if not 0 <= overlap < limit // 4:
        raise ValueError("the overlap must be less than a quarter of the limit")
    title = F.col(title_col) if title_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), title.alias("title"), (F.col(order_col) if order_col else F.lit(0)).alias("ord"))
    rows = first_rows(spread(rows), "id", [F.col("ord").asc_nulls_last()]).where(F.length("text") > limit).select("id", "text", "title")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, text, head in zip(*(c.to_pylist() for c in batch.columns)):
                for no, path, body in sections(text):
                    if len(body) > limit:
                        crumb = " > ".join(x for x in [(head or "").strip(), *(h for _, h in path)] if x)
                        out += [(key, no, i, a, crumb, body[a:b]) for i, (a, b) in enumerate(cut(body, limit, overlap))]
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (batch.schema[0].type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()))], ["id", "section_no", "piece_no", "start", "breadcrumb", "text"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, section_no int, piece_no int, start int, breadcrumb string, text string")
