"""Url expressions: normal form, document ids, services, page preference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens of a url by preference of its page; the first that occurs counts.
PREFERENCE = (("/overview", 0), ("-overview", 0), ("/what-is", 1), ("/introduction", 1), ("/concepts", 2), ("/concept-", 2), ("/get-started", 3), ("/quickstart", 3), ("/how-to", 4), ("/tutorial", 5))
LEAST_PREFERRED = 9


def normal_url(url: Column) -> Column:
    """Trimmed, in lower case, without fragment, query, a locale as first segment, and slashes at the end."""
    u = F.regexp_replace(F.lower(F.trim(url)), r"[#?][\s\S]*$", "")
    return F.regexp_replace(F.regexp_replace(u, r"^([^/]+//[^/]+)/[a-z]{2}-[a-z]{2}(/|$)", "$1$2"), r"/+$", "")


def document_id(url: Column, index: Column) -> Column:
    """Url-safe base64 of the url without padding, the chunk's number, and 8 hex digits of the url's SHA-1."""
    code = F.regexp_replace(F.base64(F.encode(url, "utf-8")), r"[\r\n=]", "")
    return F.concat_ws("_", F.translate(code, "+/", "-_"), index.cast("string"), F.substring(F.sha1(url), 1, 8))


def service(url: Column) -> Column:
    """Second path segment of a page under a locale; null where there is none."""
    return F.nullif(F.regexp_extract(F.lower(url), r"^[^/]+//[^/]+/[a-z]{2}-[a-z]{2}/([^/?#]+)/", 1), F.lit(""))


def preference(url: Column) -> Column:
    """Lower is better: overview pages before concepts, starts, how-tos and tutorials."""
    out = F.lit(LEAST_PREFERRED)
    for token, score in reversed(PREFERENCE):
        out = F.when(F.contains(url, F.lit(token)), score).otherwise(out)
    return out
