"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 6).

Prefix dynamic programming: of the encoding of every byte prefix of a word only the last token is stored. A token ``t``
that ends a prefix is the right one exactly when it is the whole prefix, or when the pair of the last token before it
and ``t`` is stable, i.e. encoding the bytes of the pair gives that pair again; one token always is. So a word costs
time in proportion to its length, a text can be continued without encoding it again, and an edit only touches the
words next to it.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import spread

#: Words whose ids a worker remembers before it starts afresh; a matter of speed only.
REMEMBERED = 400_000
#: A continued or edited text is cut into words again from so many words before the change: a contraction spans two.
BACK = 3


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class PrefixEncoder:
    """Encoder of texts and words over the lines ``base64(token) rank`` of a vocabulary file."""

    def __init__(self, vocabulary: bytes, pattern: str):
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.token = {r: t for t, r in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self.words = regex.compile(pattern)
        self.stable: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def _merged(self, data: bytes) -> list[int]:
        """Plain merging of a pair's few bytes: the lowest rank first, the leftmost of equals."""
        parts = [bytes([b]) for b in data]
        while len(parts) > 1:
            ranks = [self.rank.get(parts[i] + parts[i + 1], 1 << 30) for i in range(len(parts) - 1)]
            best = min(ranks)
            if best == 1 << 30:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def _fits(self, before: int, last: int) -> bool:
        pair = (before, last)
        found = self.stable.get(pair)
        if found is None:
            found = self.stable[pair] = self._merged(self.token[before] + self.token[last]) == [before, last]
        return found

    def prefixes(self, word: bytes) -> list[int]:
        """For each non-empty byte prefix of a word: the last token of its encoding."""
        last: list[int] = []
        self.grow(last, word)
        return last

    def grow(self, last: list[int], word: bytes) -> None:
        """Append to ``last`` what it lacks for all prefixes of ``word``, of which it holds the first ``len(last)``."""
        rank, longest = self.rank, self.longest
        for end in range(len(last) + 1, len(word) + 1):
            for start in range(max(0, end - longest), end):
                t = rank.get(word[start:end])
                if t is not None and (start == 0 or self._fits(last[start - 1], t)):
                    last.append(t)
                    break

    def walk(self, last: list[int]) -> tuple[int, ...]:
        """The ids of a word from its prefixes' last tokens."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.token[out[-1]])
        return tuple(reversed(out))

    def word_ids(self, word: str) -> tuple[int, ...]:
        ids = self.known.get(word)
        if ids is None:
            data = word.encode("utf-8", "surrogatepass")
            whole = self.rank.get(data)
            ids = (whole,) if whole is not None else self.walk(self.prefixes(data))
            if len(self.known) >= REMEMBERED:
                self.known.clear()
                self.stable.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, ids = self.known, self.word_ids
        for word in self.words.findall(text):
            out += known.get(word) or ids(word)
        return out

    def starts(self, text: str, at: int = 0) -> list[int]:
        return [m.start() for m in self.words.finditer(text, at)]

    def edit(self, text: str, ids: list[int], start: int, end: int, new: str) -> tuple[str, list[int]]:
        """``text`` with ``[start:end]`` replaced by ``new``, and its ids; only words near the edit are encoded again.

        An append is the edit with ``start == end == len(text)``.
        """
        changed = text[:start] + new + text[end:]
        old = self.starts(text)
        keep = max(0, bisect_left(old, start) - BACK)
        head = old[keep] if old and keep < len(old) else 0
        shift = len(new) - (end - start)
        begun = set(old[bisect_left(old, end + 1) :])
        middle: list[int] = []
        tail, back, match_at = len(changed), len(text), head
        synced = 0
        for m in self.words.finditer(changed, head):
            match_at = m.start()
            synced = synced + 1 if match_at - shift in begun else 0
            if synced > BACK:
                tail, back = match_at, match_at - shift
                break
            middle += self.word_ids(m.group())
        n_head = len(self.encode_span(text, ids, 0, head))
        rest = self.encode_span(text, ids, back, len(text))
        assert tail - back == shift or back == len(text)
        return changed, ids[:n_head] + middle + rest

    def encode_span(self, text: str, ids: list[int], start: int, end: int) -> list[int]:
        """The ids of ``text[start:end]``, taken from the ids of the whole text; both ends are starts of words."""
        if start >= end:
            return []
        size = [len(self.token[i]) for i in ids]
        at = np.concatenate([[0], np.cumsum(size)])
        a, b = (len(text[:x].encode("utf-8", "surrogatepass")) for x in (start, end))
        return ids[int(np.searchsorted(at, a)) : int(np.searchsorted(at, b))]


_ENCODERS: dict[int, PrefixEncoder] = {}


def _encoder(shared) -> PrefixEncoder:
    """One encoder for each worker process and vocabulary."""
    key = hash(shared.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PrefixEncoder(*shared.value)
    return _ENCODERS[key]


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, counts_only: bool = False) -> DataFrame:
    """``id_col, ids`` (or ``id_col, n_tokens``) of every row; no special tokens.

    Null and empty texts give an empty list (0); every row comes out, repeated ids and null ids included; strings that
    look like special tokens are ordinary text; other columns are ignored. ``vocabulary`` is the path of a file of
    ranks on the driver (under 1 MB, of fixed size, and so broadcast).
    """
    return _encoded(spread(docs.select(id_col, text_col)), id_col, text_col, vocabulary, counts_only)


def _encoded(docs: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None, counts_only: bool = False) -> DataFrame:
    with open(vocabulary or vocabulary_path(), "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), word_pattern()))
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    out_type = "n_tokens bigint" if counts_only else "ids array<int>"
    key_type = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            lists = [encoder.encode(t) if t else [] for t in batch.column(1).to_pylist()]
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            if counts_only:
                values, name = pa.array(size), "n_tokens"
            else:
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                flat = np.fromiter((i for x in lists for i in x), np.int32, int(ends[-1]))
                values, name = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), "ids"
            yield pa.RecordBatch.from_arrays([batch.column(0), values], ["k", name])

    return rows.mapInArrow(run, f"k {key_type}, {out_type}").withColumnRenamed("k", id_col)


def edit_corpus(edits: DataFrame, id_col: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """``id_col, text, ids`` after one edit of each encoded text, exact as if encoded anew.

    ``edits`` has ``id_col, text, ids, start, end, new``: characters ``[start, end)`` become ``new``; an append has both at
    the text's length. Only words next to the edit are encoded again. Null texts, ids and replacements count as empty;
    places outside the text are moved to its ends; other columns are ignored.
    """
    with open(vocabulary or vocabulary_path(), "rb") as f:
        shared = edits.sparkSession.sparkContext.broadcast((f.read(), word_pattern()))
    rows = edits.select(F.col(id_col).alias("k"), "text", "ids", F.col("start").cast("int"), F.col("end").cast("int"), "new")
    key_type = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            texts, lists = [], []
            for text, ids, start, end, new in zip(*(c.to_pylist() for c in batch.columns[1:])):
                text = text or ""
                a = min(max(start or 0, 0), len(text))
                b = min(max(end if end is not None else a, a), len(text))
                changed, now = encoder.edit(text, ids or [], a, b, new or "")
                texts.append(changed)
                lists.append(now)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(lists, pa.list_(pa.int32()))], ["k", "text", "ids"])

    return spread(rows).mapInArrow(run, f"k {key_type}, text string, ids array<int>").withColumnRenamed("k", id_col)
