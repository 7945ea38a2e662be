"""All queries of the core with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import first_rows, materialize, running, spread, table, union_all, usable_vector
from ..functions import scores, text, urls
from ..operators import chunking, evaluation, graph, loading, prompts, retrieval, usage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ---- pieces of SQL

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


def _terms(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}]+'), lambda w: w NOT IN ({_STOP}))"


def _url(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), '[#?][\s\S]*$', ''), '^([^/]+//[^/]+)/[a-z]{{2}}-[a-z]{{2}}(/|$)', '\1\2'), '/+$', '')"


_CHUNKS = "chunks AS (SELECT * FROM ms_docs WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1)"
_USABLE = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_CHUNK_TEXT = "concat_ws(' ', title, content, context)"


def _leaves_sql(where: str = "") -> str:
    return f"""leaves AS (
  SELECT id AS query_id, title, url, embedding, ({_USABLE}) AS usable FROM raptor_sac
  WHERE level = 0 AND id IS NOT NULL{where}
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1)"""


#: Every leaf whose hex number is divisible by 20 asks a question.
_LEAVES = _leaves_sql(" AND CAST('0x' || right(id, 6) AS BIGINT) % 20 = 0")


def _bm25_sql(prefix: str, docs: str, queries: str, k: int) -> str:
    """CTEs that end in ``{prefix}_hits (query_id, id, score, rank)``; ``docs`` selects id, text; ``queries`` query_id, text."""
    p = prefix
    return f"""
{p}_docs AS ({docs}),
{p}_terms AS (SELECT id, {_terms("text")} AS ts FROM {p}_docs),
{p}_stats AS (SELECT count(*) AS n, avg(len(ts)) AS avg_len FROM {p}_terms),
{p}_posts AS (SELECT id, term, count(*) AS tf, any_value(doc_len) AS doc_len FROM (SELECT id, len(ts) AS doc_len, unnest(ts) AS term FROM {p}_terms) GROUP BY id, term),
{p}_asked AS (SELECT DISTINCT query_id, unnest({_terms("text")}) AS term FROM ({queries})),
{p}_df AS (SELECT term, count(*) AS df FROM {p}_posts GROUP BY term),
{p}_scored AS (
  SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 9) AS score
  FROM {p}_asked JOIN {p}_posts USING (term) JOIN {p}_df USING (term) CROSS JOIN {p}_stats GROUP BY query_id, id),
{p}_hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM {p}_scored
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {k})"""


def _knn_sql(prefix: str, docs: str, queries: str, k: int) -> str:
    """CTE ``{prefix}_hits`` of the exact nearest; both sides select usable vectors ``embedding``."""
    return f"""
{prefix}_hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM (
    SELECT q.query_id, d.id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 9) AS score FROM ({queries}) q CROSS JOIN ({docs}) d)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {k})"""


def _rrf_sql(prefix: str, legs: list[str], k: int | None = None) -> str:
    rows = " UNION ALL ".join(f"SELECT query_id, id, rank, {i} AS leg FROM {leg}" for i, leg in enumerate(legs))
    order = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, id)"
    return f"""
{prefix}_hits AS (
  SELECT query_id, id, score, {order} - 1 AS rank FROM (
    SELECT query_id, id, sum(1.0 / (61 + rank)) AS score, min(leg * 1000000 + rank) AS seen FROM ({rows}) GROUP BY query_id, id)
  {f"QUALIFY {order} <= {k}" if k else ""})"""


_LEXICAL_QUERIES = "SELECT query_id, title AS text FROM leaves"
_DENSE_DOCS = f"SELECT id, embedding FROM chunks WHERE {_USABLE}"
_HIT = "query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank"


# ---- pieces of plans


def _chunk_text() -> Column:
    return F.concat_ws(" ", "title", "content", "context")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.chunks(table(spark, d, "ms_docs")).withColumn("usable", usable_vector(F.col("embedding"), 64))


def _leaves(spark: SparkSession, d: str, every: bool = False) -> DataFrame:
    """The leaves that ask a question, or ``every`` leaf."""
    rows = table(spark, d, "raptor_sac").where("level = 0")
    if not every:
        rows = rows.where("cast(conv(right(id, 6), 16, 10) as bigint) % 20 = 0")
    rows = first_rows(rows, "id", [F.col("ingested_at").asc_nulls_last()])
    return rows.select(F.col("id").alias("query_id"), "title", "url", "embedding", usable_vector(F.col("embedding"), 64).alias("usable"))


def _hit(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, "query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


# ---- sources, loading


@query("SELECT id, chunk_id, title FROM (SELECT DISTINCT id, chunk_id, title FROM ms_docs) ORDER BY id, chunk_id, title LIMIT 100")
def scan_sample(spark, d):
    """The first 100 chunks by id: a stable sample."""
    return table(spark, d, "ms_docs").select("id", "chunk_id", "title").distinct().orderBy("id", "chunk_id", F.col("title").asc_nulls_last()).limit(100)


@query(f"WITH {_CHUNKS} SELECT id, {_url('url')} AS page, CAST(row_number() OVER (PARTITION BY {_url('url')} ORDER BY chunk_id, id) - 1 AS INTEGER) AS ordinal FROM chunks WHERE url IS NOT NULL")
def reading_order(spark, d):
    """Chunks of every page in reading order."""
    rows = _chunks(spark, d).where("url is not null").select("id", urls.normal_url(F.col("url")).alias("page"), "chunk_id")
    return running(rows, ["page"], ["chunk_id", "id"]).select("id", "page", F.col("place").cast("int").alias("ordinal"))


_OLD = "old AS (SELECT DISTINCT id FROM raptor_sac WHERE level < 2 AND id IS NOT NULL), new AS (SELECT DISTINCT id FROM raptor_sac WHERE level > 0 AND id IS NOT NULL)"


@query(f"WITH {_OLD} SELECT (SELECT count(*) FROM new) AS rows, (SELECT count(*) FROM new WHERE id NOT IN (SELECT id FROM old)) AS inserted, (SELECT count(*) FROM old WHERE id NOT IN (SELECT id FROM new)) AS deleted")
def convergent_load(spark, d):
    """Counts of a load that turns levels 0 and 1 into levels 1 and 2."""
    rows = table(spark, d, "raptor_sac").where("id is not null")
    return loading.load_counts(rows.where("level < 2"), rows.where("level > 0"))


@query(f"WITH {_OLD} SELECT id FROM old WHERE id NOT IN (SELECT id FROM new)")
def stale_documents(spark, d):
    rows = table(spark, d, "raptor_sac").where("id is not null")
    return loading.stale(rows.where("level < 2"), rows.where("level > 0"))


@query(f"WITH {_OLD} SELECT r.id, level, count(*) AS n FROM raptor_sac r JOIN new USING (id) GROUP BY ALL")
def converged_table(spark, d):
    rows = table(spark, d, "raptor_sac").where("id is not null").select("id", "level")
    return loading.converge(rows.where("level < 2"), rows.where("level > 0")).groupBy("id", "level").agg(F.count("*").alias("n"))


# ---- functions over chunks


@query(rf"""WITH {_CHUNKS} SELECT id, {_url('url')} AS page,
  translate(replace(base64(encode(url)), '=', ''), '+/', '-_') || '_' || chunk_id || '_' || left(sha1(url), 8) AS document_id,
  nullif(regexp_extract(lower(url), '^[^/]+//[^/]+/[a-z]{{2}}-[a-z]{{2}}/([^/?#]+)/', 1), '') AS service
  FROM chunks WHERE url IS NOT NULL""")
def chunk_urls(spark, d):
    """Normal url, document id and service of every chunk."""
    u = F.col("url")
    return _chunks(spark, d).where("url is not null").select("id", urls.normal_url(u).alias("page"), urls.document_id(u, F.col("chunk_id")).alias("document_id"), urls.service(u).alias("service"))


_EMBED = "substr(coalesce(context, '') || chr(10) || chr(10) || coalesce(content, ''), 1, 16000)"


@query(f"""WITH {_CHUNKS} SELECT id, coalesce(nullif(title, ''), nullif(url, ''), id) AS label, sha256({_EMBED}) AS input_key, length({_EMBED}) AS input_chars,
  sha256(array_to_string(list_filter([coalesce(title, ''), coalesce(content, ''), coalesce(context, '')], lambda x: x <> ''), chr(10) || chr(10))) AS rerank_key FROM chunks""")
def chunk_inputs(spark, d):
    """Label, embedding input and rerank text of every chunk, the texts as cache keys."""
    e = text.embed_input(F.col("context"), F.col("content"))
    r = text.rerank_text(F.col("title"), F.col("content"), F.col("context"))
    return _chunks(spark, d).select("id", text.first_filled(F.col("title"), F.col("url"), F.col("id")).alias("label"), F.sha2(e, 256).alias("input_key"), F.length(e).cast("bigint").alias("input_chars"), F.sha2(r, 256).alias("rerank_key"))


_PREF = "CASE " + " ".join(f"WHEN contains(url, '{t}') THEN {s}" for t, s in urls.PREFERENCE) + f" ELSE {urls.LEAST_PREFERRED} END"


@query(rf"""WITH pages AS (SELECT DISTINCT {_url('url')} AS url, nullif(regexp_extract(lower(url), '^[^/]+//[^/]+/[a-z]{{2}}-[a-z]{{2}}/([^/?#]+)/', 1), '') AS service FROM ms_docs WHERE url IS NOT NULL)
  SELECT url, service, CAST(row_number() OVER (PARTITION BY service ORDER BY {_PREF}, url) - 1 AS INTEGER) AS rank FROM pages
  WHERE service IS NOT NULL AND NOT contains(url, '/media/') AND NOT contains(url, '/includes/')
  QUALIFY row_number() OVER (PARTITION BY service ORDER BY {_PREF}, url) <= 4""")
def select_pages(spark, d):
    """At most four pages of each service, overview pages first."""
    u = F.col("url")
    pages = table(spark, d, "ms_docs").where("url is not null").select(urls.normal_url(u).alias("url"), urls.service(u).alias("service")).distinct()
    pages = pages.where("service is not null and not contains(url, '/media/') and not contains(url, '/includes/')")
    order = Window.partitionBy("service").orderBy(urls.preference(u), "url")
    return pages.withColumn("rank", (F.row_number().over(order) - 1).cast("int")).where("rank < 4")


@query(rf"""SELECT doc_id, CASE WHEN regexp_matches(lower(text), '{text.BREADTH_PATTERN}') THEN 'global' ELSE 'local' END AS query_class FROM documents WHERE text IS NOT NULL""")
def query_classes(spark, d):
    """Whether each whole text asks about the whole corpus."""
    rows = table(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", text.query_class(F.col("text")).alias("query_class"))


_REST = "CASE WHEN contains(text, chr(10)) THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END"


@query(rf"""WITH q AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z]{{4,}}'), lambda w: w NOT IN ({_STOP}))) AS ws,
  lower({_REST}) AS rest FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, round(CASE WHEN len(ws) = 0 THEN 1.0 ELSE len(list_filter(ws, lambda w: contains(rest, w))) / len(ws) END, 6) AS overlap FROM q""")
def question_overlap(spark, d):
    """Share of the content words of a text's heading line that all the rest of the text holds."""
    rows = table(spark, d, "documents").where("text is not null")
    rest = F.regexp_extract("text", r"\A[^\n]*\n([\s\S]*)", 1)
    return rows.select("doc_id", F.round(text.content_word_overlap(F.split_part("text", F.lit("\n"), F.lit(1)), rest), 6).alias("overlap"))


_OPEN = ", ".join(f"last_value(CASE WHEN level = {n} THEN section_no END IGNORE NULLS) OVER w AS s{n}, last_value(CASE WHEN level = {n} THEN heading END IGNORE NULLS) OVER w AS h{n}" for n in chunking.LEVELS)
_CRUMB = ", ".join(f"CASE WHEN {n} <= level AND s{n} > greatest(0, {', '.join(f'coalesce(s{m}, 0)' for m in chunking.LEVELS if m < n) or '0'}) THEN h{n} END" for n in chunking.LEVELS)


@query(rf"""WITH {_CHUNKS}, lines AS (
  SELECT id, coalesce(trim(title), '') AS title, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM (SELECT id, title, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM chunks WHERE content IS NOT NULL)
), marked AS (
  SELECT *, regexp_matches(line, '^\s*```') AS fence, regexp_matches(line, '^(#{{1,6}})\s+(.+?)\s*$') AS head FROM lines
), counted AS (
  SELECT *, sum(fence::INT) OVER (PARTITION BY id ORDER BY line_no) AS fences FROM marked WHERE fence OR head
), heads AS (
  SELECT id, title, line_no, length(regexp_extract(line, '^(#{{1,6}})\s+(.+?)\s*$', 1)) AS level, regexp_extract(line, '^(#{{1,6}})\s+(.+?)\s*$', 2) AS heading, row_number() OVER (PARTITION BY id ORDER BY line_no) AS section_no
  FROM counted WHERE NOT fence AND fences % 2 = 0
), opened AS (SELECT *, {_OPEN} FROM heads WINDOW w AS (PARTITION BY id ORDER BY line_no ROWS UNBOUNDED PRECEDING))
SELECT id, CAST(section_no AS INTEGER) AS section_no, CAST(level AS INTEGER) AS level, heading,
  array_to_string(list_filter([title, {_CRUMB}], lambda x: coalesce(x, '') <> ''), ' > ') AS breadcrumb FROM opened""")
def headings(spark, d):
    """Sections of every chunk with their breadcrumbs."""
    return chunking.headings(_chunks(spark, d))


def _windows_sql(keys: str, size: int, overlap: int) -> str:
    """CTEs ``win`` and ``pieces (keys, a, piece)`` of the windows of ``src (keys, body)``, whose bodies are stripped; needs RECURSIVE."""

    def stop(a: str) -> str:
        gap = f"instr(reverse(substr(body, {a} + 1, {size})), ' ')"
        return f"CASE WHEN {a} + {size} < length(body) AND {gap} > 0 AND {a} + {size} - {gap} > {a} THEN {a} + {size} - {gap} ELSE least({a} + {size}, length(body)) END"

    return rf"""win AS (SELECT {keys}, body, 0 AS a, {stop('0')} AS z FROM src WHERE body <> ''
  UNION ALL SELECT {keys}, body, na, {stop('na')} FROM (SELECT *, greatest(z - {overlap}, a + 1) AS na FROM win WHERE z < length(body))),
pieces AS (SELECT * FROM (SELECT {keys}, a, regexp_replace(substr(body, a + 1, z - a), '^\s+|\s+$', '', 'g') AS piece FROM win) WHERE piece <> '')"""


@query(rf"""WITH RECURSIVE {_CHUNKS}, src AS (SELECT id, regexp_replace(content, '^\s+|\s+$', '', 'g') AS body FROM chunks WHERE content IS NOT NULL), {_windows_sql('id', 1000, 100)}
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY a) - 1 AS INTEGER) AS chunk_no, piece AS chunk FROM pieces""")
def chunk_windows(spark, d):
    """Overlapping windows of every chunk's text."""
    return chunking.chunk_windows(_chunks(spark, d))


_SECTIONS = rf"""lines AS (
  SELECT id, coalesce(trim(title), '') AS title, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM (SELECT id, title, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM chunks WHERE content IS NOT NULL)
), marked AS (
  SELECT *, regexp_matches(line, '^\s*```') AS fence, regexp_matches(line, '^(#{{1,6}})\s+(.+?)\s*$') AS head FROM lines
), counted AS (SELECT *, sum(fence::INT) OVER (PARTITION BY id ORDER BY line_no) AS fences FROM marked
), numbered AS (SELECT *, sum((head AND NOT fence AND fences % 2 = 0)::INT) OVER (PARTITION BY id ORDER BY line_no) AS section_no FROM counted
), heads AS (
  SELECT id, title, line_no, section_no, length(regexp_extract(line, '^(#{{1,6}})\s+(.+?)\s*$', 1)) AS level, regexp_extract(line, '^(#{{1,6}})\s+(.+?)\s*$', 2) AS heading FROM numbered WHERE head AND NOT fence AND fences % 2 = 0
), opened AS (SELECT *, {_OPEN} FROM heads WINDOW w AS (PARTITION BY id ORDER BY line_no ROWS UNBOUNDED PRECEDING)
), crumbs AS (SELECT id, section_no, array_to_string(list_filter([title, {_CRUMB}], lambda x: coalesce(x, '') <> ''), ' > ') AS breadcrumb FROM opened
), src AS (
  SELECT n.id, n.section_no, coalesce(any_value(c.breadcrumb), any_value(n.title)) AS breadcrumb, regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '^\s+|\s+$', '', 'g') AS body
  FROM numbered n LEFT JOIN crumbs c ON c.id = n.id AND c.section_no = n.section_no GROUP BY n.id, n.section_no
), {_windows_sql('id, section_no, breadcrumb', 2000, 200)},
chunked AS (SELECT id, section_no, CAST(row_number() OVER (PARTITION BY id, section_no ORDER BY a) - 1 AS INTEGER) AS piece_no, breadcrumb, piece AS chunk FROM pieces)"""


@query(f"WITH RECURSIVE {_CHUNKS}, {_SECTIONS} SELECT id, CAST(section_no AS INTEGER) AS section_no, piece_no, breadcrumb, chunk FROM chunked")
def section_chunks(spark, d):
    """Every text cut at its headings, larger sections into windows, with breadcrumbs."""
    return chunking.section_chunks(_chunks(spark, d))


_DOCUMENT_ID = "translate(replace(base64(encode(url)), '=', ''), '+/', '-_') || '_' || no || '_' || left(sha1(url), 8)"
_NOTE = "nullif(split_part(c.context, chr(10), 2), '')"
_NUMBERED = f"""numbered_ AS (SELECT s.*, c.title, c.url, {_NOTE} AS note, row_number() OVER (PARTITION BY c.url ORDER BY c.chunk_id, c.id, s.section_no, s.piece_no) - 1 AS no FROM chunked s JOIN chunks c USING (id) WHERE c.url IS NOT NULL)"""


@query(f"WITH RECURSIVE {_CHUNKS}, {_SECTIONS}, {_NUMBERED} SELECT {_DOCUMENT_ID} AS id, coalesce(title, '') AS title, url, CAST(no AS INTEGER) AS chunk_id, chunk AS content, '' AS context FROM numbered_")
def baseline_documents(spark, d):
    """Chunks of every page as documents without context."""
    return chunking.chunk_documents(_chunks(spark, d))


@query(f"WITH RECURSIVE {_CHUNKS}, {_SECTIONS}, {_NUMBERED} SELECT {_DOCUMENT_ID} AS id, coalesce(title, '') AS title, url, CAST(no AS INTEGER) AS chunk_id, chunk AS content, breadcrumb || CASE WHEN note IS NULL THEN '' ELSE chr(10) || note END AS context FROM numbered_")
def contextual_documents(spark, d):
    """Chunks of every page as documents with breadcrumb and situating note."""
    note = F.nullif(F.split_part("context", F.lit("\n"), F.lit(2)), F.lit(""))
    return chunking.chunk_documents(_chunks(spark, d), note)


_BUDGET = 250_000


@query(f"""WITH {_CHUNKS}, r AS (SELECT {_url('url')} AS page, id, coalesce(content, '') AS text, row_number() OVER w - 1 AS place, sum(length(coalesce(content, '')) + 7) OVER (w ROWS UNBOUNDED PRECEDING) - 7 AS ends
  FROM chunks WHERE url IS NOT NULL WINDOW w AS (PARTITION BY {_url('url')} ORDER BY chunk_id, id))
  SELECT page, id, CAST(place AS INTEGER) AS place, substr(text, 1, {_BUDGET}) AS text FROM r WHERE ends <= {_BUDGET} OR place = 0""")
def packed_pages(spark, d):
    """As many chunks of each page as fit the budget of a prompt, in reading order."""
    rows = _chunks(spark, d).where("url is not null").select("id", "chunk_id", "content", urls.normal_url(F.col("url")).alias("page"))
    return prompts.packed(rows, "page", ["chunk_id", "id"], "content", _BUDGET).withColumn("place", F.col("place").cast("int"))


@query(f"WITH {_CHUNKS} SELECT {_url('url')} AS page, string_agg(coalesce(content, ''), chr(10) || chr(10) ORDER BY chunk_id, id) AS text FROM chunks WHERE url IS NOT NULL GROUP BY 1")
def page_texts(spark, d):
    """The whole text of every page from its chunks."""
    rows = _chunks(spark, d).where("url is not null").select("id", "chunk_id", "content", urls.normal_url(F.col("url")).alias("page"))
    return prompts.page_texts(rows, "page", ["chunk_id", "id"], "content")


# ---- retrieval


@query(f"WITH {_CHUNKS}, t AS (SELECT {_terms(_CHUNK_TEXT)} AS ts FROM chunks) SELECT count(*) AS n, round(avg(len(ts)), 6) AS avg_len FROM t")
def corpus_stats(spark, d):
    stats = retrieval.corpus_stats(retrieval.tokenized(_chunks(spark, d), _chunk_text()))
    return stats.select("n", F.round("avg_len", 6).alias("avg_len"))


@query(f"WITH {_CHUNKS}, t AS (SELECT DISTINCT id, unnest({_terms(_CHUNK_TEXT)}) AS term FROM chunks), {_LEAVES}, q AS (SELECT DISTINCT unnest({_terms('text')}) AS term FROM ({_LEXICAL_QUERIES})) SELECT term, count(*) AS df FROM t JOIN q USING (term) GROUP BY term")
def document_frequencies(spark, d):
    """Document frequency of every term that is asked for."""
    return retrieval.document_frequency(retrieval.tokenized(_chunks(spark, d), _chunk_text()), retrieval.query_terms(_leaves(spark, d), F.col("title")))


@query(f"WITH {_CHUNKS}, {_LEAVES}, {_bm25_sql('b', f'SELECT id, {_CHUNK_TEXT} AS text FROM chunks', _LEXICAL_QUERIES, 15)} SELECT {_HIT} FROM b_hits")
def lexical_topk(spark, d):
    """BM25: the 15 best chunks of every asking leaf's title."""
    hits = retrieval.bm25(_chunks(spark, d), _chunk_text(), _leaves(spark, d), F.col("title"), 15)
    return _hit(retrieval.ranked(hits.withColumn("score", F.round("score", 9)), 15))


@query(f"WITH {_CHUNKS}, {_LEAVES}, {_knn_sql('k', _DENSE_DOCS, 'SELECT query_id, embedding FROM leaves WHERE usable', 15)} SELECT {_HIT} FROM k_hits")
def dense_topk(spark, d):
    """Exact cosine search: the 15 nearest chunks of every asking leaf."""
    return _hit(retrieval.exact_knn(_chunks(spark, d).where("usable"), _leaves(spark, d).where("usable"), 15))


_VEC = "SELECT vec_id AS id, embedding FROM embeddings"


@query(f"WITH {_knn_sql('k', _VEC, 'SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 20 = 0', 10)} SELECT {_HIT} FROM k_hits")
def embedding_topk(spark, d):
    """The ten nearest of every twentieth vector, itself among them."""
    rows = spread(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))
    return _hit(retrieval.exact_knn(rows, rows.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 10))


def _hybrid_sql(leaves: str) -> str:
    return f"""{_CHUNKS}, {leaves}, {_knn_sql("dense", _DENSE_DOCS, "SELECT query_id, embedding FROM leaves WHERE usable", 15)},
{_bm25_sql("lex", f"SELECT id, {_CHUNK_TEXT} AS text FROM chunks", "SELECT query_id, title AS text FROM leaves", 15)}, {_rrf_sql("fused", ["dense_hits", "lex_hits"])}"""


_HYBRID = _hybrid_sql(_LEAVES)


@query(f"WITH {_HYBRID} SELECT 'dense' AS stage, {_HIT} FROM dense_hits UNION ALL SELECT 'bm25', {_HIT} FROM lex_hits UNION ALL SELECT 'fused', {_HIT} FROM fused_hits")
def r4_hybrid(spark, d):
    """Dense and lexical legs of every asking leaf, fused by reciprocal rank."""
    return _hit(retrieval.hybrid(_chunks(spark, d), _chunk_text(), _leaves(spark, d), F.col("title")), "stage")


@query(f"WITH {_HYBRID} SELECT query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, id) - 1 AS INTEGER) AS rank FROM fused_hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, id) <= 8")
def reranked_hits(spark, d):
    """The stage after fusion without a model: the eight best."""
    stages = retrieval.hybrid(_chunks(spark, d), _chunk_text(), _leaves(spark, d), F.col("title"))
    return _hit(retrieval.reranked(stages.where("stage = 'fused'").drop("stage"), 8))


@query(f"WITH {_HYBRID} SELECT CAST(attempt AS INTEGER) AS attempt, query_id, id, CAST(rank AS INTEGER) AS rank FROM fused_hits, range(3) r(attempt) WHERE rank < 5 + 3 * attempt")
def retry_windows(spark, d):
    """What each of three attempts at an answer sees of the fused hits."""
    stages = retrieval.hybrid(_chunks(spark, d), _chunk_text(), _leaves(spark, d), F.col("title"))
    return retrieval.retried(stages.where("stage = 'fused'"), 5, 3).select("attempt", "query_id", "id", F.col("rank").cast("int").alias("rank"))


_STAGED = "staged AS (SELECT 'dense' AS stage, * FROM dense_hits UNION ALL SELECT 'bm25', * FROM lex_hits UNION ALL SELECT 'fused', * FROM fused_hits)"
_LABEL = "coalesce(nullif(title, ''), nullif(url, ''), id)"


@query(f"WITH {_HYBRID}, {_STAGED} SELECT stage, query_id, count(*) AS count, string_agg({_LABEL}, ', ' ORDER BY rank) AS detail FROM staged JOIN chunks USING (id) GROUP BY stage, query_id")
def stage_rows(spark, d):
    """Of each stage of each query the number of hits and their titles in order."""
    chunks = _chunks(spark, d)
    labels = chunks.select("id", text.first_filled(F.col("title"), F.col("url"), F.col("id")).alias("label"))
    hits = retrieval.hybrid(chunks, _chunk_text(), _leaves(spark, d), F.col("title")).join(labels, "id")
    titles = F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"])
    return hits.groupBy("stage", "query_id").agg(F.count("*").alias("count"), F.array_join(titles, ", ").alias("detail"))


@query(f"WITH {_HYBRID}, {_STAGED} SELECT stage, query_id, CAST(rank + 1 AS INTEGER) AS rank, {_LABEL} AS title, round(score, 3) AS score, url FROM staged JOIN chunks USING (id)")
def stage_tables(spark, d):
    """The ranked rows that each stage shows, counted from 1."""
    chunks = _chunks(spark, d)
    labels = chunks.select("id", text.first_filled(F.col("title"), F.col("url"), F.col("id")).alias("title"), "url")
    hits = retrieval.hybrid(chunks, _chunk_text(), _leaves(spark, d), F.col("title")).join(labels, "id")
    return hits.select("stage", "query_id", (F.col("rank") + 1).cast("int").alias("rank"), "title", F.round("score", 3).alias("score"), "url")


POOL = 15
_COMMUNITY_QUERIES = "SELECT DISTINCT id AS query_id, title AS text FROM graph_communities WHERE CAST(regexp_extract(id, '[0-9]+$') AS BIGINT) % 20 = 0"
_ENTITIES = "SELECT id, any_value(concat_ws(' ', name, description)) AS text FROM graph_entities GROUP BY id"
_ENTITY_BM25 = _bm25_sql("ent", _ENTITIES, _COMMUNITY_QUERIES, POOL)


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_entities").dropDuplicates(["id"])


def _communities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_communities").dropDuplicates(["id"])


def _best(docs: DataFrame, text_: Column, asked: DataFrame, k: int = POOL) -> DataFrame:
    hits = retrieval.bm25(docs, text_, asked, F.col("text"), k)
    return retrieval.ranked(hits.withColumn("score", F.round("score", 9)), k)


def _asking(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "graph_communities").where("cast(regexp_extract(id, '([0-9]+)$', 1) as bigint) % 20 = 0")
    return rows.select(F.col("id").alias("query_id"), F.col("title").alias("text")).distinct()


def _seeds(spark: SparkSession, d: str, asked: DataFrame) -> DataFrame:
    return _best(_entities(spark, d), F.concat_ws(" ", "name", "description"), asked)


def _graph_stages(spark: SparkSession, d: str, asked: DataFrame) -> DataFrame:
    """Stages ``local``, ``global`` and ``fused`` of the graph for questions ``query_id, text``."""
    local = materialize(graph.expand(materialize(_seeds(spark, d, asked)), _entities(spark, d), table(spark, d, "graph_relationships")))
    wide = asked.where(text.query_class(F.col("text")) == "global")
    wide = materialize(_best(_communities(spark, d), F.concat_ws(" ", "title", "summary"), wide))
    cols = ["query_id", "id", "score", "rank"]
    out = [x.select(F.lit(name).alias("stage"), *cols) for name, x in (("local", local), ("global", wide), ("fused", retrieval.fuse([local, wide])))]
    return union_all(out)


@query(f"WITH {_ENTITY_BM25} SELECT {_HIT} FROM ent_hits")
def entity_search(spark, d):
    """The best entities for every twentieth community's title."""
    return _hit(_seeds(spark, d, _asking(spark, d)))


_REPORTS = "SELECT id, any_value(concat_ws(' ', title, summary)) AS text FROM graph_communities GROUP BY id"


@query(f"WITH {_bm25_sql('com', _REPORTS, _COMMUNITY_QUERIES, POOL)} SELECT {_HIT} FROM com_hits")
def community_search(spark, d):
    """The best community reports for every twentieth community's title."""
    return _hit(_best(_communities(spark, d), F.concat_ws(" ", "title", "summary"), _asking(spark, d)))


_ADJ = """edges AS (SELECT DISTINCT id, upper(source) AS s, upper(target) AS t FROM graph_relationships WHERE source IS NOT NULL AND target IS NOT NULL),
adj AS (SELECT s AS key, id, t AS other FROM edges UNION ALL SELECT t, id, s FROM edges WHERE s <> t)"""
_EXPANSION = f"""{_ADJ}, weights AS (SELECT id, max(CASE WHEN isfinite(weight) THEN weight END) AS w FROM graph_relationships GROUP BY id),
found AS (SELECT query_id, adj.id, min(rank) AS seed FROM ent_hits JOIN (SELECT DISTINCT id AS eid, upper(name) AS key FROM graph_entities WHERE name IS NOT NULL) n ON n.eid = ent_hits.id JOIN adj USING (key) GROUP BY query_id, adj.id),
local_hits AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY leg, seed, id) - 1 AS rank FROM (
  SELECT query_id, id, score, 0 AS leg, rank AS seed FROM ent_hits UNION ALL SELECT query_id, id, coalesce(w, 1.0), 1, seed FROM found JOIN weights USING (id)))"""
_EXPANDED = f"{_ENTITY_BM25}, {_EXPANSION}"


@query(f"WITH {_EXPANDED} SELECT {_HIT} FROM local_hits")
def graph_expansion(spark, d):
    """The entities found and the edges one hop from them, in the order of these."""
    return _hit(graph.expand(_seeds(spark, d, _asking(spark, d)), _entities(spark, d), table(spark, d, "graph_relationships")))


def _graph_sql(questions: str) -> str:
    """CTEs of the stages ``local_hits, rep_hits, graph_hits`` for ``questions`` (``query_id, text``)."""
    wide = f"SELECT * FROM ({questions}) WHERE regexp_matches(lower(coalesce(text, '')), '{text.BREADTH_PATTERN}')"
    return f"{_bm25_sql('ent', _ENTITIES, questions, POOL)}, {_EXPANSION}, {_bm25_sql('rep', _REPORTS, wide, POOL)}, {_rrf_sql('graph', ['local_hits', 'rep_hits'])}"


@query(f"WITH {_graph_sql(_COMMUNITY_QUERIES)} SELECT 'local' AS stage, {_HIT} FROM local_hits UNION ALL SELECT 'global', {_HIT} FROM rep_hits UNION ALL SELECT 'fused', {_HIT} FROM graph_hits")
def graph_retrieval(spark, d):
    """Entities with their edges and, for queries about the whole corpus only, community reports, fused."""
    return _hit(_graph_stages(spark, d, _asking(spark, d)), "stage")


_TREE = "tree AS (SELECT * FROM raptor_sac WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1)"
_TREE_HYBRID = f"""{_TREE}, {_LEAVES}, {_knn_sql("dense", f"SELECT id, embedding FROM tree WHERE {_USABLE}", "SELECT query_id, embedding FROM leaves WHERE usable", POOL)},
{_bm25_sql("lex", f"SELECT id, {_CHUNK_TEXT} AS text FROM tree", "SELECT query_id, title AS text FROM leaves", POOL)}, {_rrf_sql("fused", ["dense_hits", "lex_hits"])}"""
_NAMED = {"tree:dense": "dense_hits", "tree:bm25": "lex_hits", "tree:fused": "fused_hits", "graph:local": "local_hits", "graph:global": "rep_hits", "graph:fused": "graph_hits", "fused": "both_hits"}


@query(f"WITH {_TREE_HYBRID}, {_graph_sql('SELECT query_id, title AS text FROM leaves')}, {_rrf_sql('both', ['fused_hits', 'graph_hits'])} " + " UNION ALL ".join(f"SELECT '{n}' AS stage, {_HIT} FROM {t}" for n, t in _NAMED.items()))
def combined_retrieval(spark, d):
    """The summary tree and the graph for every asking leaf, each with its own stages, and both fused."""
    leaves = materialize(_leaves(spark, d))
    tree = retrieval.chunks(table(spark, d, "raptor_sac")).withColumn("usable", usable_vector(F.col("embedding"), 64))
    parts = {
        "tree": materialize(retrieval.hybrid(tree, _chunk_text(), leaves, F.col("title"), POOL)),
        "graph": materialize(_graph_stages(spark, d, leaves.select("query_id", F.col("title").alias("text")))),
    }
    both = retrieval.fuse([x.where("stage = 'fused'") for x in parts.values()])
    named = [x.withColumn("stage", F.concat_ws(":", F.lit(name), "stage")) for name, x in parts.items()]
    return _hit(union_all([*named, both.withColumn("stage", F.lit("fused"))]), "stage")


_PARTS = "array_slice(list_filter(list_transform(regexp_split_to_array(coalesce(title, ''), ' and | - |[|]'), lambda x: trim(x)), lambda x: x <> ''), 1, 3)"
_SUB = f"""sub AS (SELECT query_id || '#' || i AS query_id, text, embedding, usable FROM (
  SELECT query_id, embedding, usable, unnest(ps) AS text, unnest(range(len(ps))) AS i FROM (SELECT *, CASE WHEN len(ps0) = 0 THEN [coalesce(title, '')] ELSE ps0 END AS ps FROM (SELECT *, {_PARTS} AS ps0 FROM leaves))))"""


@query(f"""WITH {_CHUNKS}, {_LEAVES}, {_SUB}, {_knn_sql("dense", _DENSE_DOCS, "SELECT query_id, embedding FROM sub WHERE usable", POOL)},
{_bm25_sql('lex', f'SELECT id, {_CHUNK_TEXT} AS text FROM chunks', 'SELECT query_id, text FROM sub', POOL)}, {_rrf_sql("sub", ["dense_hits", "lex_hits"])},
steps AS (SELECT split_part(query_id, '#', 1) AS query_id, CAST(split_part(query_id, '#', 2) AS INT) AS step, id, score, rank FROM sub_hits),
best AS (SELECT query_id, id, max(score) AS score, min(step * 1000000 + rank) AS seen FROM steps GROUP BY 1, 2)
SELECT 'iter_' || step AS stage, {_HIT} FROM steps UNION ALL
SELECT 'fused', query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, id) - 1 AS INTEGER) AS rank FROM best""")
def planned_retrieval(spark, d):
    """Each title cut into at most three sub-queries that are all retrieved at once; a hit keeps its highest score."""
    parts = F.slice(F.filter(F.transform(F.split(F.coalesce("title", F.lit("")), r" and | - |[|]"), lambda x: F.trim(x)), lambda x: x != ""), 1, 3)
    parts = F.when(F.size(parts) == 0, F.array(F.coalesce("title", F.lit("")))).otherwise(parts)
    sub = _leaves(spark, d).select("query_id", "embedding", "usable", F.posexplode(parts).alias("step", "text"))
    sub = materialize(sub.select(F.concat_ws("#", "query_id", "step").alias("query_id"), "text", "embedding", "usable"))
    hits = retrieval.hybrid(_chunks(spark, d), _chunk_text(), sub, F.col("text"), POOL).where("stage = 'fused'")
    named = materialize(hits.select(F.split_part("query_id", F.lit("#"), F.lit(1)).alias("query_id"), F.split_part("query_id", F.lit("#"), F.lit(2)).cast("int").alias("step"), "id", "score", "rank"))
    steps = named.select(F.concat(F.lit("iter_"), F.col("step")).alias("stage"), "query_id", "id", "score", "rank")
    return _hit(steps.unionByName(retrieval.accumulate(named).withColumn("stage", F.lit("fused"))), "stage")


# ---- graph


@query("SELECT DISTINCT id, name AS title, coalesce(name, '') || ' (' || coalesce(type, '') || '): ' || coalesce(description, '') AS content, coalesce(source_urls[1], '') AS url FROM graph_entities")
def entity_hits(spark, d):
    return graph.entity_hits(table(spark, d, "graph_entities")).distinct()


@query("SELECT DISTINCT id, title, coalesce(summary, '') AS content, coalesce(source_urls[1], '') AS url FROM graph_communities")
def community_hits(spark, d):
    return graph.community_hits(table(spark, d, "graph_communities")).distinct()


@query("SELECT DISTINCT id, concat_ws(' — ', source, target) AS title, coalesce(description, '') AS content, coalesce(source_urls[1], '') AS url, CASE WHEN isfinite(weight) THEN weight END AS score FROM graph_relationships")
def relationship_hits(spark, d):
    return graph.relationship_hits(table(spark, d, "graph_relationships")).distinct()


def _first_seen(rows: str, keys: str, value: str, seen: str, name: str) -> str:
    """A query ``keys, name``: the list of distinct non-empty values of each group in the order first seen."""
    return f"SELECT {keys}, list(x ORDER BY s, x) AS {name} FROM (SELECT {keys}, {value} AS x, min({seen}) AS s FROM {rows} WHERE coalesce({value}, '') <> '' GROUP BY ALL) GROUP BY ALL"


def _merged_sql(keys: str) -> str:
    """CTEs ``ds, ids, us`` of the groups of ``e (id, keys, description, source_urls)``."""
    return f"""eu AS (SELECT id, {keys}, unnest(source_urls) AS url, generate_subscripts(source_urls, 1) AS pos FROM e),
ds AS ({_first_seen('e', keys, 'description', 'id', 'descriptions')}), ids AS ({_first_seen('e', keys, 'id', 'id', 'source_ids')}), us AS ({_first_seen('eu', keys, 'url', '(id, pos)', 'urls')})"""


_GIVEN = "coalesce(array_to_string(descriptions, chr(10)), '') AS description, coalesce(source_ids, []) AS source_ids, coalesce(urls, []) AS source_urls"
_MERGED_ENTITIES = f"""e AS (SELECT id, upper(name) AS name, type, description, source_urls FROM graph_entities WHERE coalesce(name, '') <> ''), {_merged_sql('name')},
t AS (SELECT name, upper(type) AS type FROM e QUALIFY row_number() OVER (PARTITION BY name ORDER BY id, type NULLS FIRST) = 1), n AS (SELECT name, count(DISTINCT id) AS mentions FROM e GROUP BY name),
merged AS (SELECT name, type, mentions, {_GIVEN} FROM t JOIN n USING (name) LEFT JOIN ds USING (name) LEFT JOIN ids USING (name) LEFT JOIN us USING (name))"""


@query(f"WITH {_MERGED_ENTITIES} SELECT * FROM merged")
def merged_entities(spark, d):
    return graph.merge_entities(table(spark, d, "graph_entities"))


_MERGED_EDGES = f"""e AS (SELECT id, upper(source) AS source, upper(target) AS target, weight, description, source_urls FROM graph_relationships WHERE source IS NOT NULL AND target IS NOT NULL), {_merged_sql('source, target')},
w AS (SELECT source, target, coalesce(max(CASE WHEN isfinite(weight) THEN weight END), 1.0) AS weight FROM e GROUP BY ALL),
merged AS (SELECT source, target, weight, {_GIVEN} FROM w LEFT JOIN ds USING (source, target) LEFT JOIN ids USING (source, target) LEFT JOIN us USING (source, target))"""


@query(f"WITH {_MERGED_EDGES} SELECT * FROM merged")
def merged_relationships(spark, d):
    return graph.merge_relationships(table(spark, d, "graph_relationships"))


@query(f"""WITH {_MERGED_ENTITIES}, c AS (SELECT upper(name) AS name, min(community_id) AS c FROM graph_entities WHERE name IS NOT NULL GROUP BY 1)
SELECT 'entity-' || (row_number() OVER (ORDER BY source_ids[1], name) - 1) AS id, name, type, description, coalesce(c, -1) AS community_id, source_urls FROM merged LEFT JOIN c USING (name)""")
def entity_documents(spark, d):
    """Merged entities as numbered documents."""
    return graph.entity_documents(table(spark, d, "graph_entities"))


@query(f"WITH {_MERGED_EDGES} SELECT 'rel-' || (row_number() OVER (ORDER BY source_ids[1], source, target) - 1) AS id, source, target, description, weight, source_urls FROM merged")
def relationship_documents(spark, d):
    """Merged relationships as numbered documents."""
    return graph.relationship_documents(table(spark, d, "graph_relationships"))


@query()
def modularity_communities(spark, d):
    """Communities of high modularity of the merged relationships between known entities."""
    edges = materialize(graph.merge_relationships(table(spark, d, "graph_relationships")).select("source", "target", "weight"))
    nodes = table(spark, d, "graph_entities").select(F.upper("name").alias("node"))
    return graph.modularity_communities(edges, nodes)


@query(f"WITH {_ADJ} SELECT key, count(*) AS degree, count(DISTINCT other) AS neighbours FROM adj GROUP BY key")
def node_degrees(spark, d):
    return graph.adjacency(table(spark, d, "graph_relationships")).groupBy("key").agg(F.count("*").alias("degree"), F.countDistinct("other").alias("neighbours"))


@query("""WITH n AS (SELECT DISTINCT upper(name) AS n FROM graph_entities WHERE name IS NOT NULL) SELECT DISTINCT id, upper(source) AS source, upper(target) AS target FROM graph_relationships
WHERE upper(source) IN (SELECT n FROM n) AND upper(target) IN (SELECT n FROM n)""")
def known_edges(spark, d):
    return graph.known_edges(table(spark, d, "graph_relationships"), table(spark, d, "graph_entities"))


_WITHIN = """place AS (SELECT upper(name) AS n, min(coalesce(community_id, -1)) AS c FROM graph_entities WHERE name IS NOT NULL GROUP BY 1),
within_ AS (SELECT DISTINCT e.id, a.c AS community_id FROM graph_relationships e JOIN place a ON a.n = upper(source) JOIN place b ON b.n = upper(target) WHERE a.c = b.c AND a.c <> -1)"""


@query(f"""WITH {_WITHIN}, m AS (SELECT community_id, count(DISTINCT upper(name)) AS members FROM graph_entities WHERE community_id IS NOT NULL AND name IS NOT NULL GROUP BY 1),
u AS (SELECT community_id, unnest(source_urls) AS u FROM graph_entities WHERE community_id IS NOT NULL AND name IS NOT NULL UNION ALL SELECT w.community_id, unnest(r.source_urls) FROM within_ w JOIN graph_relationships r USING (id)),
nu AS (SELECT community_id, count(DISTINCT u) AS urls FROM u WHERE coalesce(u, '') <> '' GROUP BY 1), ne AS (SELECT community_id, count(*) AS edges FROM within_ GROUP BY 1)
SELECT community_id, members, coalesce(edges, 0) AS edges, coalesce(urls, 0) AS urls FROM m LEFT JOIN ne USING (community_id) LEFT JOIN nu USING (community_id)""")
def community_sizes(spark, d):
    return graph.community_sizes(table(spark, d, "graph_entities"), table(spark, d, "graph_relationships"))


@query("""WITH RECURSIVE e AS (SELECT upper(source) AS u, upper(target) AS v FROM graph_relationships WHERE source IS NOT NULL AND target IS NOT NULL), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r(node, root) USING KEY (node) AS (SELECT DISTINCT u, u FROM b UNION (SELECT b.v, min(r.root) FROM r JOIN b ON b.u = r.node JOIN recurring.r AS o ON o.node = b.v WHERE r.root < o.root GROUP BY b.v))
SELECT node, root AS component FROM r""")
def graph_components(spark, d):
    """Connected components of the relationships."""
    rows = table(spark, d, "graph_relationships").select(F.upper("source").alias("source"), F.upper("target").alias("target"))
    return graph.components(rows)


@query(f"""WITH {_WITHIN}, mu AS (SELECT community_id AS c, 0 AS leg, id, unnest(source_urls) AS url, generate_subscripts(source_urls, 1) AS pos FROM graph_entities WHERE community_id IS NOT NULL AND name IS NOT NULL
  UNION ALL SELECT w.community_id, 1, r.id, unnest(r.source_urls), generate_subscripts(r.source_urls, 1) AS pos FROM within_ w JOIN graph_relationships r USING (id)),
u AS ({_first_seen('mu', 'c', 'url', '(leg, id, pos)', 'urls')}), k AS (SELECT DISTINCT title, summary, CAST(regexp_extract(id, '[0-9]+$') AS INTEGER) AS c FROM graph_communities)
SELECT 'community-' || c AS id, title, coalesce(summary, '') AS summary, coalesce(urls, []) AS source_urls FROM k LEFT JOIN u USING (c)""")
def community_documents(spark, d):
    """Community reports as documents with the urls of members and edges."""
    return graph.community_documents(table(spark, d, "graph_communities"), table(spark, d, "graph_entities"), table(spark, d, "graph_relationships"))


@query("SELECT community_id, string_agg(name, ', ' ORDER BY name) AS members FROM (SELECT DISTINCT community_id, upper(name) AS name FROM graph_entities WHERE community_id IS NOT NULL AND name IS NOT NULL) GROUP BY community_id")
def community_members(spark, d):
    """The members of each community by its label."""
    rows = table(spark, d, "graph_entities").where("community_id is not null and name is not null").select("community_id", F.upper("name").alias("name")).distinct()
    return rows.groupBy("community_id").agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("members"))


_INPUTS = f"""{_WITHIN}, e AS (SELECT community_id, upper(name) AS name, min(id) AS id, arg_min(coalesce(type, ''), (id, coalesce(type, ''), coalesce(description, ''))) AS type, arg_min(coalesce(description, ''), (id, coalesce(type, ''), coalesce(description, ''))) AS description FROM graph_entities WHERE community_id IS NOT NULL AND name IS NOT NULL GROUP BY 1, 2),
p AS (SELECT community_id, string_agg('- ' || name || ' (' || type || '): ' || substr(description, 1, 120), chr(10) ORDER BY name) AS people FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY community_id ORDER BY name) <= 20) GROUP BY 1),
l AS (SELECT community_id, string_agg('- ' || source || ' -> ' || target || ': ' || substr(coalesce(description, ''), 1, 80), chr(10) ORDER BY id) AS links FROM (
  SELECT w.community_id, r.* FROM within_ w JOIN (SELECT id, min(source) AS source, min(target) AS target, min(description) AS description FROM graph_relationships GROUP BY id) r USING (id) QUALIFY row_number() OVER (PARTITION BY w.community_id ORDER BY id) <= 10) GROUP BY 1)"""


@query(f"WITH {_INPUTS} SELECT community_id, 'Entities:' || chr(10) || people || chr(10) || chr(10) || 'Relationships:' || chr(10) || coalesce(links, '(none)') AS prompt FROM p LEFT JOIN l USING (community_id)")
def report_inputs(spark, d):
    """What a community's report is written from."""
    entities, edges = table(spark, d, "graph_entities"), table(spark, d, "graph_relationships")
    one = edges.groupBy("id").agg(*(F.min(c).alias(c) for c in ("source", "target", "description")))
    return prompts.report_input(entities, graph.community_edges(edges, entities).distinct().join(one, "id"))


@query(r"""WITH k AS (SELECT DISTINCT CAST(regexp_extract(id, '[0-9]+$') AS INTEGER) AS c, title, summary FROM graph_communities),
f AS (SELECT community_id AS c, string_agg(substr(description, 1, 80), '; ' ORDER BY place) AS fallback FROM (SELECT community_id, coalesce(description, '') AS description, row_number() OVER (PARTITION BY community_id ORDER BY id, description) AS place FROM (SELECT DISTINCT community_id, id, description FROM graph_entities WHERE community_id IS NOT NULL)) WHERE place <= 5 GROUP BY 1)
SELECT c AS community_id, CASE WHEN trim(coalesce(title, '')) = '' THEN 'Community ' || c ELSE trim(title) END AS title, CASE WHEN summary IS NULL THEN coalesce(fallback, '') ELSE trim(summary) END AS summary FROM k LEFT JOIN f USING (c)""")
def report_fields(spark, d):
    """Title and summary read from the reports of communities; members' descriptions where a summary is missing."""
    rows = table(spark, d, "graph_communities").select(F.regexp_extract("id", r"([0-9]+)$", 1).cast("int").alias("community_id"), F.concat_ws("\n", F.coalesce("title", F.lit("")), "summary").alias("report")).distinct()
    people = table(spark, d, "graph_entities").where("community_id is not null").select("community_id", "id", "description").distinct()
    place = Window.partitionBy("community_id").orderBy("id", "description")
    first = people.withColumn("place", F.row_number().over(place)).where(F.col("place") <= 5)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", F.substring(F.coalesce("description", F.lit("")), 1, 80).alias("x")))), lambda r: r["x"])
    rows = rows.join(first.groupBy("community_id").agg(F.array_join(lines, "; ").alias("fallback")), "community_id", "left")
    return rows.select("community_id", prompts.report_fields(F.col("report"), F.col("community_id"), F.col("fallback")).alias("r")).select("community_id", "r.title", "r.summary")


_TOP5 = f"SELECT query_id, rank, {_url('url')} AS url, coalesce(content, '') AS content FROM k_hits JOIN chunks USING (id)"


@query(f"""WITH {_CHUNKS}, {_LEAVES}, {_knn_sql('k', _DENSE_DOCS, 'SELECT query_id, embedding FROM leaves WHERE usable', 5)},
p AS (SELECT query_id, string_agg('[' || (rank + 1) || '] (' || coalesce(url, '') || ') ' || content, chr(10) || chr(10) ORDER BY rank) AS passages FROM ({_TOP5}) GROUP BY query_id)
SELECT query_id, 'Sources:' || chr(10) || passages || chr(10) || chr(10) || 'Question: ' || coalesce(title, '') AS prompt FROM p JOIN leaves USING (query_id)""")
def grounding_prompts(spark, d):
    """The numbered whole passages that an asking leaf's answer would rest on, and its question."""
    chunks, leaves = _chunks(spark, d), materialize(_leaves(spark, d))
    hits = retrieval.exact_knn(chunks.where("usable"), leaves.where("usable"), 5)
    hits = hits.join(chunks.select("id", urls.normal_url(F.col("url")).alias("url"), "content"), "id")
    return prompts.grounding_prompt(hits, leaves.select("query_id", F.col("title").alias("question"), F.lit(None).cast("string").alias("previous_answer")))


# ---- usage

_ENTRIES = "entries AS (SELECT * FROM usage_ledger WHERE entry_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY recorded_at) = 1)"
_SUMS = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in usage.COUNTS)


@query(f"WITH {_ENTRIES} SELECT stage, deployment, count(*) AS calls, {_SUMS}, count(*) FILTER (usage_missing) AS missing FROM entries GROUP BY stage, deployment")
def usage_totals(spark, d):
    return usage.totals(table(spark, d, "usage_ledger"), "stage", "deployment")


@query(f"WITH {_ENTRIES} SELECT run_id, count(*) AS calls, {_SUMS}, count(*) FILTER (usage_missing) AS missing FROM entries GROUP BY run_id")
def usage_by_run(spark, d):
    return usage.totals(table(spark, d, "usage_ledger"), "run_id")


@query(f"""WITH {_ENTRIES} SELECT stage, date_trunc('hour', called_at) AS hour, count(*) AS calls, count(*) FILTER (recorded_at - called_at > INTERVAL 1 HOUR) AS late, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens
FROM entries WHERE called_at IS NOT NULL GROUP BY ALL""")
def usage_hourly(spark, d):
    return usage.hourly(table(spark, d, "usage_ledger"))


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session_no FROM m)
SELECT user_id AS user, CAST(session_no AS BIGINT) AS session_no, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM s GROUP BY ALL""")
def event_sessions(spark, d):
    return usage.sessions(table(spark, d, "events"), "user_id", "ts")


# ---- evaluation


def _eval_sql(hybrid: str) -> str:
    return f"""{hybrid}, gold AS (SELECT query_id, {_url('url')} AS url FROM leaves WHERE coalesce(url, '') <> ''),
staged AS (SELECT 'dense' AS mode, * FROM dense_hits UNION ALL SELECT 'bm25', * FROM lex_hits UNION ALL SELECT 'fused', * FROM fused_hits),
got AS (SELECT mode, query_id, {_url('c.url')} AS url, min(rank) AS rank FROM staged JOIN chunks c USING (id) WHERE rank < 5 GROUP BY ALL),
per AS (SELECT m.mode, g.query_id, got.rank FROM gold g CROSS JOIN (VALUES ('dense'), ('bm25'), ('fused')) m(mode) LEFT JOIN got ON got.mode = m.mode AND got.query_id = g.query_id AND got.url = g.url),
metrics AS (SELECT mode, query_id AS item_id, 'hit_rate' AS metric, (rank IS NOT NULL)::DOUBLE AS value FROM per UNION ALL SELECT mode, query_id, 'mrr', coalesce(1.0 / (rank + 1), 0.0) FROM per)"""


_EVAL = _eval_sql(_HYBRID)
#: The evaluation of every leaf, not of a sample of them.
_EVAL_EVERY = _eval_sql(_hybrid_sql(_leaves_sql()))


def _metrics(spark: SparkSession, d: str, every: bool = False) -> DataFrame:
    chunks, leaves = _chunks(spark, d), _leaves(spark, d, every)
    pages = chunks.select("id", urls.normal_url(F.col("url")).alias("url"))
    gold = leaves.where("coalesce(url, '') != ''").select("query_id", urls.normal_url(F.col("url")).alias("url"))
    stages = materialize(retrieval.hybrid(chunks, _chunk_text(), leaves, F.col("title")).join(pages, "id"))
    gold, out = materialize(gold), None
    for mode in ("dense", "bm25", "fused"):
        one = evaluation.hit_metrics(stages.where(F.col("stage") == mode), gold).select(F.lit(mode).alias("mode"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {_EVAL_EVERY} SELECT mode, item_id, metric, round(value, 6) AS value FROM metrics")
def eval_metrics(spark, d):
    """Hit rate and reciprocal rank of every leaf's own page, by stage."""
    return _metrics(spark, d, every=True).withColumn("value", F.round("value", 6))


@query(f"WITH {_EVAL} SELECT mode, metric, round(avg(value), 6) AS mean, count(*) AS valid, count(*) AS total FROM metrics GROUP BY mode, metric")
def eval_means(spark, d):
    return evaluation.means(_metrics(spark, d), "mode")


_MEANS = "m AS (SELECT mode, metric, round(avg(value), 6) AS mean, count(*) AS valid, count(*) AS total FROM metrics GROUP BY mode, metric)"


def _keyed_means(spark: SparkSession, d: str) -> DataFrame:
    """Means under their keys: those of every stage, and those of the last one alone."""
    rows = evaluation.means(_metrics(spark, d), "mode")
    staged = rows.select(evaluation.stage_key(F.col("metric"), F.col("mode")).alias("key"), "mean", "valid", "total")
    return staged.unionByName(rows.where("mode = 'fused'").select(F.col("metric").alias("key"), "mean", "valid", "total"))


@query(f"WITH {_EVAL}, {_MEANS} SELECT mode AS stage, max(CASE WHEN metric = 'hit_rate' THEN round(mean, 4) END) AS hit_rate, max(CASE WHEN metric = 'mrr' THEN round(mean, 4) END) AS mrr, CASE mode WHEN 'dense' THEN 0 WHEN 'bm25' THEN 1 ELSE 2 END AS position FROM m GROUP BY mode")
def eval_stages(spark, d):
    """The metrics of every stage side by side, stages in the order of retrieval."""
    return evaluation.stage_means(_keyed_means(spark, d))


@query(f"WITH {_EVAL}, {_MEANS} SELECT metric, round(mean, 4) AS mean_score, valid || '/' || total AS coverage FROM m WHERE mode = 'fused'")
def eval_overall(spark, d):
    """The metrics of whole runs with their coverage."""
    return evaluation.overall(_keyed_means(spark, d))


@query(f"WITH {_EVAL}, {_MEANS} SELECT a.mode, a.metric, a.mean, b.mean AS base, round(a.mean - b.mean, 6) AS diff FROM m a JOIN m b USING (metric) WHERE a.mode <> 'bm25' AND b.mode = 'bm25'")
def eval_against_baseline(spark, d):
    """The means of every mode beside those of the baseline."""
    return evaluation.against_baseline(evaluation.means(_metrics(spark, d), "mode"), "bm25")


@query(f"WITH {_EVAL_EVERY}, t AS (SELECT query_id AS item_id, CASE WHEN regexp_matches(lower(coalesce(title, '')), '{text.BREADTH_PATTERN}') THEN 'global' ELSE 'original' END AS tag FROM leaves) SELECT mode, tag, metric, round(avg(value), 6) AS mean, count(*) AS valid, count(*) AS total FROM metrics JOIN t USING (item_id) GROUP BY mode, tag, metric")
def eval_by_tag(spark, d):
    """Means of every leaf by tag; questions without a tag count as original."""
    wide = text.query_class(F.col("title")) == "global"
    tags = _leaves(spark, d, every=True).select(F.col("query_id").alias("item_id"), F.when(wide, F.array(F.lit("global"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    return evaluation.means(evaluation.by_tag(_metrics(spark, d, every=True).join(tags, "item_id")), "mode", "tag")


@query(f"WITH {_HYBRID}, {_STAGED} SELECT stage, CAST(row_number() OVER (ORDER BY min((query_id, CASE stage WHEN 'dense' THEN 0 WHEN 'bm25' THEN 1 ELSE 2 END))) - 1 AS INTEGER) AS position FROM staged GROUP BY stage")
def stages_seen(spark, d):
    """The names of the stages in the order in which queries first show them."""
    hits = retrieval.hybrid(_chunks(spark, d), _chunk_text(), _leaves(spark, d), F.col("title"))
    place = F.when(F.col("stage") == "dense", 0).when(F.col("stage") == "bm25", 1).otherwise(2)
    return evaluation.stages_seen(hits.select(F.col("query_id").alias("item"), place.alias("place"), "stage")).select("stage", F.col("position").cast("int").alias("position"))


@query()
def eval_intervals(spark, d):
    return evaluation.bootstrap_means(_metrics(spark, d), "mode")


@query()
def eval_paired_tests(spark, d):
    return evaluation.paired_tests(_metrics(spark, d), "bm25")


_PAIRS = "pairs AS (SELECT a.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score, round(list_cosine_similarity(a.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS other, a.label = b.label AS good FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 LEFT JOIN embeddings c ON c.vec_id = a.vec_id + 2)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's cosine with the next and the one after it, and whether the next has its label."""
    e = table(spark, d, "embeddings")
    a, b, c = (e.select((F.col("vec_id") - i).alias("id"), F.col("embedding").alias(f"v{i}"), F.col("label").alias(f"l{i}")) for i in range(3))
    rows = a.join(b, "id").join(c, "id", "left")
    return rows.select("id", F.round(scores.cosine(F.col("v0"), F.col("v1")), 6).alias("score"), F.round(scores.cosine(F.col("v0"), F.col("v2")), 6).alias("other"), (F.col("l0") == F.col("l1")).alias("faithful"))


_SWEEP = f"""{_PAIRS}, by_score AS (SELECT score AS s, count(*) FILTER (good) AS good, count(*) FILTER (NOT good) AS bad FROM pairs GROUP BY 1),
steps AS (SELECT coalesce(round((s + lead(s) OVER (ORDER BY s)) / 2, 7), round(s + 1e-6, 7)) AS threshold, sum(good) OVER (ORDER BY s) AS fa, sum(bad) OVER (ORDER BY s) AS ta FROM by_score UNION ALL SELECT 0.0, 0, 0),
sweep AS (SELECT threshold, CAST(g - fa AS BIGINT) AS true_pass, CAST(fa AS BIGINT) AS false_abstain, CAST(b - ta AS BIGINT) AS false_pass, CAST(ta AS BIGINT) AS true_abstain, CASE WHEN b > 0 THEN (b - ta) / b ELSE 0.0 END AS false_pass_rate, CASE WHEN g > 0 THEN fa / g ELSE 0.0 END AS false_abstain_rate
  FROM steps CROSS JOIN (SELECT sum(good) AS g, sum(bad) AS b FROM by_score))"""
_J = "round(1 - false_abstain_rate - false_pass_rate, 9)"


@query(f"WITH {_SWEEP} SELECT threshold, true_pass, false_abstain, false_pass, true_abstain, round(false_pass_rate, 6) AS false_pass_rate, round(false_abstain_rate, 6) AS false_abstain_rate, {_J} AS youden_j FROM sweep")
def threshold_sweep(spark, d):
    sweep = evaluation.threshold_sweep(_scored(spark, d))
    return sweep.select("threshold", "true_pass", "false_abstain", "false_pass", "true_abstain", *(F.round(c, 6).alias(c) for c in ("false_pass_rate", "false_abstain_rate")), "youden_j")


@query(f"WITH {_SWEEP} SELECT threshold, true_pass, false_pass, round({_J}, 6) AS youden_j FROM sweep ORDER BY {_J} DESC, threshold DESC LIMIT 1")
def recommended_threshold(spark, d):
    best = evaluation.recommended_threshold(evaluation.threshold_sweep(_scored(spark, d)))
    return best.select("threshold", "true_pass", "false_pass", F.round("youden_j", 6).alias("youden_j"))


@query(f"""WITH {_PAIRS}, c AS (SELECT count(*) AS items, count(*) FILTER ((score >= 0.5) <> good) AS online_wrong, count(*) FILTER ((other >= 0.5) <> good) AS offline_wrong, count(*) FILTER ((score >= 0.5) <> (other >= 0.5)) AS verdicts_differ,
count(*) FILTER (score IS NULL) AS online_missing, count(*) FILTER (other IS NULL) AS offline_missing, round(avg(abs(score - other)), 6) AS mean_gap, round(max(abs(score - other)), 6) AS max_gap FROM pairs)
SELECT *, (online_missing + offline_missing + online_wrong > 0) OR max_gap > 0.25 AS drifted FROM c""")
def canary_drift(spark, d):
    rows = materialize(_scored(spark, d))
    items = rows.select("id", F.col("faithful").alias("expected_pass"))
    online, offline = rows.select("id", "score"), rows.where("other is not null").select("id", F.col("other").alias("score"))
    return evaluation.canary(evaluation.joined_scores(items, online, offline), 0.5)


@query(f"WITH {_PAIRS} SELECT count(*) AS items, count(*) FILTER (score < 0.5) AS abstained, round(avg(score) FILTER (score >= 0.5), 6) AS faithfulness, round(avg((score < 0.5)::INT), 6) AS abstained_rate FROM pairs")
def answered_means(spark, d):
    """Answer metrics over the items that were answered; abstaining itself is a metric of all."""
    rows = _scored(spark, d).withColumn("abstained", F.col("score") < 0.5)
    kept = F.when(~F.col("abstained"), F.col("score"))
    return rows.agg(F.count("*").alias("items"), F.count_if("abstained").alias("abstained"), F.round(F.avg(kept), 6).alias("faithfulness"), F.round(F.avg(F.col("abstained").cast("int")), 6).alias("abstained_rate"))
