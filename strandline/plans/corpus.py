"""Queries of page selection, bookkeeping of loads, test rows and parsed answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import first_rows, materialize, table
from ..functions import text, urls
from ..operators import corpus, loading, prompts, usage
from .registry import _CHUNKS, _ENTRIES, _PREF, _STOP, _TREE, _chunks, _url, query

_REASON = "CASE WHEN url IS NULL THEN 'no url' WHEN content IS NULL THEN 'no content' WHEN regexp_replace(content, '\\s+', '', 'g') = '' THEN 'blank content' END"


@query(f"WITH {_CHUNKS} SELECT {_REASON} AS reason, count(*) AS pages FROM chunks WHERE {_REASON} IS NOT NULL GROUP BY 1")
def skip_reasons(spark, d):
    """How many chunks a load leaves out for which reason."""
    blank = F.regexp_replace("content", r"\s+", "") == ""
    reason = F.when(F.col("url").isNull(), "no url").when(F.col("content").isNull(), "no content").when(blank, "blank content")
    return corpus.skip_reasons(_chunks(spark, d), reason)


@query(f"WITH {_CHUNKS} SELECT id, url, content FROM chunks WHERE content IS NOT NULL AND url IS NOT NULL ORDER BY id LIMIT 40")
def corpus_sample(spark, d):
    """The sample of 40 chunks that questions are written from."""
    return _chunks(spark, d).where("content is not null and url is not null").select("id", "url", "content").orderBy("id").limit(40)


@query(rf"""WITH pages AS (SELECT DISTINCT {_url('url')} AS url, nullif(regexp_extract(lower(url), '^[^/]+//[^/]+/[a-z]{{2}}-[a-z]{{2}}/([^/?#]+)/', 1), '') AS service FROM ms_docs WHERE url IS NOT NULL),
r AS (SELECT url, service, row_number() OVER (PARTITION BY service ORDER BY {_PREF}, url) - 1 AS rank FROM pages WHERE service IS NOT NULL AND NOT contains(url, '/media/') AND NOT contains(url, '/includes/') QUALIFY row_number() OVER (PARTITION BY service ORDER BY {_PREF}, url) <= 4)
SELECT url, service, CAST(rank AS INTEGER) AS rank, CAST(row_number() OVER (ORDER BY rank, service) - 1 AS INTEGER) AS place FROM r ORDER BY rank, service LIMIT 1000""")
def selected_pages(spark, d):
    """A corpus of at most 1,000 pages, taken from the services in turn."""
    from .registry import select_pages

    return corpus.round_robin(select_pages(spark, d), 1000).withColumn("place", F.col("place").cast("int"))


_KEY = "sha256('v1' || chr(0) || 'model' || chr(0) || coalesce(url, '') || chr(0) || coalesce(content, ''))"


@query(f"WITH {_CHUNKS}, k AS (SELECT id, {_KEY} AS key, contains(coalesce(context, ''), chr(10)) AS noted FROM chunks) SELECT id, key FROM k WHERE key NOT IN (SELECT key FROM k WHERE noted)")
def context_misses(spark, d):
    """Chunks whose situating note no chunk of the same page and text has yet."""
    key = corpus.cache_key(F.lit("v1"), F.lit("model"), F.col("url"), F.col("content"))
    rows = materialize(_chunks(spark, d).select("id", key.alias("key"), F.contains(F.coalesce("context", F.lit("")), F.lit("\n")).alias("noted")))
    return corpus.cache_misses(rows.select("id", "key"), rows.where("noted"))


@query(f"WITH {_CHUNKS} SELECT regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1) AS site, count(*) AS chunks, count(*) FILTER (NOT contains(coalesce(context, ''), chr(10))) AS fallbacks FROM chunks WHERE url IS NOT NULL GROUP BY 1")
def context_fallbacks(spark, d):
    """Chunks of each site that went without a situating note."""
    site = F.regexp_extract(F.lower(F.trim("url")), r"^[a-z][a-z0-9+.-]*://([^/?#:]+)", 1)
    rows = _chunks(spark, d).where("url is not null").groupBy(site.alias("site"))
    return rows.agg(F.count("*").alias("chunks"), F.count_if(~F.contains(F.coalesce("context", F.lit("")), F.lit("\n"))).alias("fallbacks"))


@query(f"WITH {_CHUNKS}, done AS (SELECT DISTINCT {_url('url')} AS page FROM raptor_sac WHERE level = 0 AND url IS NOT NULL) SELECT id, {_url('url')} AS page FROM chunks WHERE url IS NOT NULL AND {_url('url')} NOT IN (SELECT page FROM done)")
def pending_pages(spark, d):
    """Chunks of pages that no leaf was made of yet: what a job that is resumed still has to do."""
    job = _chunks(spark, d).where("url is not null").select("id", urls.normal_url(F.col("url")).alias("page"))
    done = table(spark, d, "raptor_sac").where("level = 0 and url is not null").select(urls.normal_url(F.col("url")).alias("page"))
    return loading.resume(job, done, "page").select("id", "page")


@query(f"WITH {_TREE} SELECT id, title, url, chunk_id, content, context, level FROM tree WHERE level = 0 UNION ALL SELECT id, 'Summary of level ' || level, '', 0, coalesce(content, ''), '', level FROM tree WHERE level > 0")
def tree_documents(spark, d):
    """Leaves and summaries as one table."""
    return corpus.tree_documents(first_rows(table(spark, d, "raptor_sac"), "id", [F.col("ingested_at").asc_nulls_last()]))


_OVERLAP = f"list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z]{{4,}}'), lambda w: w NOT IN ({_STOP})))"


@query(rf"""WITH {_CHUNKS}, c AS (SELECT *, split_part(context, chr(10), 2) AS note, {_OVERLAP} AS ws FROM chunks WHERE url IS NOT NULL AND content IS NOT NULL)
SELECT title AS question, note AS ground_truth, url AS ground_truth_context, ['synthetic'] AS tags FROM c
WHERE coalesce(title, '') <> '' AND coalesce(note, '') <> '' AND CASE WHEN len(ws) = 0 THEN 1.0 ELSE len(list_filter(ws, lambda w: contains(lower(content), w))) / len(ws) END <= 0.6""")
def screened_candidates(spark, d):
    """Questions read from JSON answers, without those that echo their page."""
    entry = F.array(F.struct(F.col("title").alias("question"), F.split_part("context", F.lit("\n"), F.lit(2)).alias("ground_truth")))
    raw = F.concat(F.lit("```json\n"), F.to_json(entry), F.lit("\n```"))
    return prompts.candidates(_chunks(spark, d).where("url is not null and content is not null").select("url", F.col("content").alias("document"), raw.alias("raw")))


@query(f"""WITH {_CHUNKS}, p AS (SELECT id AS row_id, title AS question, context AS reference, substr(content, 1, 200) AS probe FROM chunks WHERE CAST('0x' || right(id, 6) AS BIGINT) % 20 = 0 AND coalesce(context, '') <> '' AND coalesce(content, '') <> ''),
f AS (SELECT row_id, min(c.id) AS id FROM p JOIN chunks c ON contains(c.content, p.probe) WHERE coalesce(c.url, '') <> '' GROUP BY row_id)
SELECT row_id, question, reference AS ground_truth, c.url AS ground_truth_context, ['synthetic'] AS tags FROM p JOIN f USING (row_id) JOIN chunks c ON c.id = f.id""")
def provenance_items(spark, d):
    """Every twentieth chunk as a test row, with the url of the first chunk that contains the beginning of its text."""
    chunks = _chunks(spark, d)
    asked = chunks.where("cast(conv(right(id, 6), 16, 10) as bigint) % 20 = 0")
    rows = materialize(asked.select(F.col("id").alias("row_id"), F.col("title").alias("question"), F.col("context").alias("reference"), F.col("content").alias("context")))
    docs = chunks.where("coalesce(url, '') != ''").select(F.col("id").alias("doc_id"), "url", F.col("content").alias("text"))
    return corpus.rows_to_items(rows, docs)


_STRUCT = "to_json({'entryId': entry_id, 'stage': coalesce(stage, ''), 'inputTokens': coalesce(input_tokens, 0), 'cachedInputTokens': coalesce(cached_input_tokens, 0), 'outputTokens': coalesce(output_tokens, 0), 'requestUnits': coalesce(request_units, 0)})"


@query(f"WITH {_ENTRIES} SELECT entry_id, CAST({_STRUCT} AS VARCHAR) AS entry FROM entries")
def usage_structs(spark, d):
    """Ledger entries as JSON objects."""
    return usage.structs(table(spark, d, "usage_ledger"))


@query(r"""WITH r AS (SELECT id, upper(source) AS source, upper(target) AS target, coalesce(description, '') AS description, coalesce(CASE WHEN isfinite(weight) THEN weight END, 1.0) AS weight FROM (SELECT DISTINCT id, source, target, description, weight FROM graph_relationships WHERE source IS NOT NULL AND target IS NOT NULL))
SELECT DISTINCT id, 'relationship' AS kind, source, target, trim(description) AS description, weight FROM r WHERE NOT contains(description, '##') AND NOT contains(description, '"')""")
def extracted_records(spark, d):
    """Relationships written as extraction records and read back."""
    rows = table(spark, d, "graph_relationships").where("source is not null and target is not null").where(~F.contains(F.coalesce("description", F.lit("")), F.lit("##")) & ~F.contains(F.coalesce("description", F.lit("")), F.lit('"')))
    rows = rows.select("id", "source", "target", "description", "weight").distinct()
    weight = F.coalesce(F.when(F.isnan("weight"), None).otherwise(F.col("weight").cast("string")), F.lit("none"))
    record = F.concat(F.lit('("relationship"<|>"'), F.lower("source"), F.lit('"<|>"'), F.lower("target"), F.lit('"<|>"'), F.coalesce("description", F.lit("")), F.lit('"<|>'), weight, F.lit(")"))
    return prompts.extracted(rows.select("id", record.alias("raw"))).where("kind = 'relationship'").select("id", "kind", "source", "target", "description", "weight").distinct()


@query(f"WITH {_CHUNKS} SELECT id, coalesce(split_part(context, chr(10), 1), '') || CASE WHEN split_part(coalesce(context, ''), chr(10), 2) <> '' THEN chr(10) || split_part(context, chr(10), 2) ELSE '' END AS context FROM chunks")
def decorated_contexts(spark, d):
    """Breadcrumbs with their situating notes."""
    part = lambda i: F.split_part(F.coalesce("context", F.lit("")), F.lit("\n"), F.lit(i))
    return _chunks(spark, d).select("id", text.decorated(part(1), part(2)).alias("context"))
