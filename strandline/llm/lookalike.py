"""One consistent form for texts that look the same (problem 8).

A text is first brought to one encoding of each sign: characters that don't show go, wide and narrow forms become plain
ones, accents are composed, every kind of space or hyphen becomes the plain one. Then each word is resolved: every
letter stands for the set of scripts in which a letter of the same look exists; the sets are intersected over the word.
If a script is left (Latin before Cyrillic before Greek), the whole word is spelled in it, which covers words mixed of
scripts as well as words wholly in another script's look-alikes; if none is left, each look-alike letter takes its
Latin form. The choice depends only on how the word looks, so words that look the same end up the same.
"""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import materialize, spread

# Letters that have the look of a Latin letter, by script, each before its Latin twin.
TWINS = {
    "Cyrl": "АA ВB СC ЕE ԌG НH ІI ӀI ЈJ КK МM ОO РP ԚQ ЅS ТT ѴV ԜW ХX ҮY ӘƏ ӨƟ ӔÆ аa сc ԁd еe һh іi јj ӏl оo рp ԛq ѕs ѵv ԝw хx уy әə өɵ ӕæ",
    "Grek": "ΑA ΒB ϹC ΕE ΗH ΙI ͿJ ΚK ΜM ΝN ΟO ΡP ΤT ΧX ΥY ΖZ ϲc ϳj οo νv",
    "Armn": "ԼL ՕO ՏS ՍU ցg հh ոn օo զq սu",
    "Cher": "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᏃZ",
}

LATIN_OF = {pair[0]: pair[1] for pairs in TWINS.values() for pair in pairs.split()}
_SPELL = {name: {pair[1]: pair[0] for pair in reversed(pairs.split())} for name, pairs in TWINS.items()}
#: Scripts in the order of preference.
SCRIPTS = ("Latn", *TWINS)
_IN = [(name, regex.compile(rf"\p{{Script={name}}}")) for name in SCRIPTS]

_WORD = regex.compile(r"[\p{L}\p{M}]+")
_MARK = regex.compile(r"\p{M}+")
#: Joins two pictures to one sign, so it shows.
_JOINED = regex.compile("(?<=[\\p{So}\\p{Sk}\\ufe0f])\\u200d(?=\\p{So})")
#: Format characters that a joined pair of pictures may have beside its joiner.
_STRAY = regex.compile("[\\u200b\\u200c\\u2060\\ufeff\\u00ad]")
#: Stands for a joiner that stays while the hidden characters go; no text may hold this noncharacter.
_KEEP = "\ufdd0"


def _hidden(c: str) -> bool:
    """Characters that take no room and show nothing: format characters, selectors, fillers, controls but tab and line feed."""
    o = ord(c)
    kind = unicodedata.category(c)
    if kind == "Cf":
        return not (0x600 <= o <= 0x605 or o in (0x6DD, 0x70F, 0x8E2) or 0x110BD <= o <= 0x110CD)
    if kind == "Cc":
        return c not in "\t\n\r"
    return 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= o <= 0x180F


def _single_table() -> dict[int, str | None]:
    """What each single character becomes, built from the Unicode data of Python by the rules above."""
    out: dict[int, str | None] = {}
    for o in range(sys.maxunicode + 1):
        c = chr(o)
        if 0xD800 <= o <= 0xDFFF:
            continue
        if _hidden(c):
            out[o] = None
            continue
        form = unicodedata.decomposition(c)
        if form.startswith(("<wide>", "<narrow>")):
            c = "".join(chr(int(x, 16)) for x in form.split()[1:])
        if unicodedata.category(c) == "Zs" or c == "\t":
            c = " "
        elif c in "\u2010\u2011\u2012\ufe63":
            c = "-"
        if c != chr(o):
            out[o] = c
    out[0x2028] = out[0x2029] = "\n"
    return out


_TABLE: dict[int, str | None] = {}


def _scripts(letter: str) -> frozenset[str]:
    """Scripts in which a letter of this look exists; ``letter`` is in its Latin form if it has one."""
    found = {name for name, p in _IN if p.match(letter)}
    return frozenset(found | {s for s, spell in _SPELL.items() if letter in spell})


_SETS: dict[str, frozenset[str]] = {}


def resolve_word(word: str) -> str:
    """A word of composed letters in the consistent script's spelling."""
    if word.isascii():
        return word
    parts = unicodedata.normalize("NFD", word)
    look = "".join(LATIN_OF.get(c, c) for c in parts)
    left: set[str] | None = None
    for c in _MARK.sub("", look):
        s = _SETS.get(c)
        if s is None:
            s = _SETS[c] = _scripts(c)
        left = set(s) if left is None else left & s
    script = next((s for s in SCRIPTS if left and s in left), "Latn" if not left else None)
    if script in _SPELL:
        look = "".join(_SPELL[script].get(c, c) for c in look)
    return unicodedata.normalize("NFC", look)


def consistent(text: str) -> str:
    """The one form of a text; equal for texts that look the same. Idempotent."""
    if not _TABLE:
        _TABLE.update(_single_table())
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.isascii():
        return text.translate(_TABLE)
    if "\u200d" in text:
        text = _JOINED.sub(_KEEP, _STRAY.sub("", text))
    # twice: a composed sign can be one that has a plain form of its own, and what stood between two parts is gone
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text.translate(_TABLE)).translate(_TABLE))
    return _WORD.sub(lambda m: resolve_word(m.group()), text).replace(_KEEP, "\u200d")


def consistent_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, form`` for every row: the consistent form of its text.

    Plain ASCII texts without control characters never leave the JVM's rows for Python. A null text stays null, an
    empty one stays empty; repeated and null ids come out as often as they came in; other columns are ignored.
    """

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else consistent(t) for t in texts.tolist()], dtype=object)

    plain = F.col("t").rlike(r"\A[\n\x20-\x7E]*\z")
    rows = spread(docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")))
    return rows.select(F.col("k").alias(id_col), F.coalesce(form(F.when(~plain, F.col("t"))), F.col("t")).alias("form"), F.col("t").alias("text"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text_key, form_key`` of texts that aren't blank; keys of 128 bits."""
    def key(c):
        return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit("second"), c).alias("b"))

    rows = consistent_texts(docs, id_col, text_col).where(F.col("form").rlike(r"[^ \n]"))
    return rows.select(F.col(id_col).alias("id"), key(F.col("text")).alias("text_key"), key(F.col("form")).alias("form_key")).where("id is not null").distinct()


def lookalike_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, class_id, links``: documents that look the same share ``class_id``, the least id among them.

    ``links`` counts the rows of the class whose text differs in its characters. One row for each id with a text that
    isn't blank (an id with several texts has one for each). Counts by text come before those by form, so a text in very
    many copies is one partial count for each task.
    """
    keyed = materialize(_keyed(docs, id_col, text_col))
    texts = keyed.groupBy("form_key", "text_key").agg(F.count("*").alias("same"), F.min("id").alias("least"))
    forms = texts.groupBy("form_key").agg(F.sum("same").alias("all"), F.min("least").alias("class_id"))
    per = texts.join(forms, "form_key").select("text_key", "class_id", (F.col("all") - F.col("same")).alias("links"))
    return keyed.join(per, "text_key").select("id", "class_id", "links").distinct()


def lookalike_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>_a < <id>_b`` of documents whose texts differ but look the same.

    Only forms with several texts go on. Their different texts are paired first, and each pair of texts then takes up
    the documents of both, so the rows that arise are those that come out: exact copies of one text never meet.
    """
    keyed = materialize(_keyed(docs, id_col, text_col))
    texts = keyed.select("form_key", "text_key").distinct()
    several = texts.groupBy("form_key").agg(F.count("*").alias("n")).where("n > 1").select("form_key")
    texts = materialize(texts.join(several, "form_key", "left_semi"))
    a, b = (texts.select("form_key", F.col("text_key").alias(f"text_{x}")) for x in "ab")
    paired = a.join(b, "form_key").where("text_a < text_b").select("text_a", "text_b")
    left, right = (keyed.select(F.col("text_key").alias(f"text_{x}"), F.col("id").alias(x)) for x in "ab")
    both = paired.join(left, "text_a").join(right, "text_b").where("a != b")
    return both.select(F.least("a", "b").alias(f"{id_col}_a"), F.greatest("a", "b").alias(f"{id_col}_b")).distinct()
