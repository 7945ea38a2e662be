"""Text expressions: analysis, overlap, query classes, decoration, parsing of model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without content.
STOP_WORDS = (
    "the a an and or but if then else when what which how why where who whom "
    "this that these those is are was were be been being have has had do does "
    "did can could should would may might must will shall with without within "
    "into onto from for of to in on at by as it its they them their there "
    "here you your our we us not no nor so than too very just about over "
    "under again further once more most other some such only own same"
).split()

# Wordings that ask about the whole corpus.
BREADTH_MARKERS = (
    "compare", "comparison", "contrast", "versus", "vs", "difference between", "differences between", "overview",
    "summarize", "summarise", "summary", "overall", "in general", "broadly", "themes", "theme", "trends",
    "relationship between", "relationships between", "relationships", "relate", "interplay", "what are the main",
    "what are the key", "what are the common", "categories", "types of", "kinds of", "pros and cons",
    "advantages and disadvantages", "trade-offs", "tradeoffs", "high-level", "big picture", "landscape", "ecosystem",
    "across",
)

BREADTH_PATTERN = r"\b(" + "|".join(BREADTH_MARKERS) + r")\b"


def analyze(text: Column) -> Column:
    """Terms of a text in order: runs of letters and digits in lower case, stop words left out; none for a null text."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS))


def content_words(question: Column) -> Column:
    """Distinct words of four letters or more that aren't stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(question, F.lit(""))), F.lit(r"([a-z]{4,})"), 1)
    return F.array_except(words, F.array(*map(F.lit, STOP_WORDS)))


def content_word_overlap(question: Column, document: Column) -> Column:
    """Share of a question's content words that stand anywhere in the document; 1 without content words."""
    words, low = content_words(question), F.lower(F.coalesce(document, F.lit("")))
    hits = F.size(F.filter(words, lambda w: F.contains(low, w)))
    return F.when(F.size(words) == 0, 1.0).otherwise(hits / F.size(words))


def query_class(query: Column) -> Column:
    """``global`` for queries about the whole corpus, else ``local``."""
    return F.when(F.lower(F.coalesce(query, F.lit(""))).rlike(BREADTH_PATTERN), "global").otherwise("local")


def decorated(breadcrumb: Column, note: Column) -> Column:
    """Breadcrumb, and on a line of its own the situating note if there is one."""
    return F.concat(F.coalesce(breadcrumb, F.lit("")), F.when(F.coalesce(note, F.lit("")) != "", F.concat(F.lit("\n"), note)).otherwise(""))


def embed_input(context: Column, content: Column, most: int = 16_000) -> Column:
    """What is embedded of a chunk: its context and content, clipped to ``most`` characters."""
    return F.substring(F.concat_ws("\n\n", F.coalesce(context, F.lit("")), F.coalesce(content, F.lit(""))), 1, most)


def rerank_text(title: Column, content: Column, context: Column) -> Column:
    """Title, content and context, empty ones left out, with a blank line between them."""
    parts = F.array(*(F.coalesce(c, F.lit("")) for c in (title, content, context)))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n\n")


def first_filled(*cols: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))


def json_array_text(raw: Column) -> Column:
    """From the first ``[`` to the last ``]`` of a model's answer; null without them."""
    return F.nullif(F.regexp_extract(raw, r"(?s)(\[.*\])", 1), F.lit(""))


def record_fields(record: Column) -> Column:
    """Fields of one extraction record: outer brackets off, split at ``<|>``, stripped of spaces and quotes."""
    inner = F.regexp_replace(F.trim(record), r"(?s)^\((.*)\)$", "$1")
    return F.transform(F.split(inner, r"<\|>"), lambda x: F.regexp_replace(F.trim(x), r'^"+|"+$', ""))
