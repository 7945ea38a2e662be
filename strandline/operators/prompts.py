"""What goes into a model's prompt and what is read out of its answer, as expressions and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import running
from ..functions.text import content_word_overlap, json_array_text, record_fields

#: Characters between two packed passages.
SEPARATOR = 7


def packed(passages: DataFrame, by: str, order: list[str], text_col: str, budget: int) -> DataFrame:
    """The longest prefix of each group's passages whose lengths and separators fit the budget: ``by, id, place, text``.

    A first passage that is longer alone is cut at the budget. Null texts count as empty. Only lengths are placed and
    summed (see ``running``); the texts join the few passages that are kept.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = passages.select(by, "id", *[c for c in order if c not in (by, "id")], F.length(text).alias("size"))
    kept = running(sized, [by], order, {"end": F.col("size") + SEPARATOR}).where((F.col("end") - SEPARATOR <= budget) | (F.col("place") == 0))
    return kept.select(by, "id", "place").join(passages.select("id", text.alias("text")), "id").select(by, "id", "place", F.substring("text", 1, budget).alias("text"))


def page_texts(passages: DataFrame, by: str, order: list[str], text_col: str) -> DataFrame:
    """``by, text``: the whole text of each page, its passages in order with a blank line between them; a page is one row."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(F.col(text_col), F.lit("")).alias("text_"))))
    return passages.groupBy(by).agg(F.array_join(F.transform(rows, lambda r: r["text_"]), "\n\n").alias("text"))


def grounding_prompt(hits: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """``query_id, prompt``: the numbered passages ``[i] (url) content`` of each query's few ranked hits, whole.

    With ``questions`` (``query_id, question, previous_answer``) the question follows and, where there is a previous answer that
    could not be verified, a block that quotes it and asks for verified claims only stands before the passages.
    """
    line = F.concat(F.lit("["), (F.col("rank") + 1).cast("string"), F.lit("] ("), F.coalesce("url", F.lit("")), F.lit(") "), F.coalesce("content", F.lit("")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    rows = hits.groupBy("query_id").agg(F.array_join(lines, "\n\n").alias("prompt"))
    if questions is None:
        return rows
    rows = rows.join(questions.select("query_id", "question", "previous_answer"), "query_id")
    again = F.when(F.coalesce("previous_answer", F.lit("")) != "", F.concat(F.lit("Not verified, keep supported claims only:\n"), F.col("previous_answer"), F.lit("\n\n"))).otherwise("")
    return rows.select("query_id", F.concat(again, F.lit("Sources:\n"), F.col("prompt"), F.lit("\n\nQuestion: "), F.coalesce("question", F.lit(""))).alias("prompt"))


def _first_lines(rows: DataFrame, order: list[str], line: Column, most: int, name: str) -> DataFrame:
    """``community_id, name``: the first ``most`` lines of each community; cut before they are gathered."""
    place = Window.partitionBy("community_id").orderBy(*order)
    rows = rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy("community_id").agg(lines.alias(name))


def report_input(entities: DataFrame, edges: DataFrame, members: int = 20, clip: int = 120, most_edges: int = 10, edge_clip: int = 80) -> DataFrame:
    """``community_id, prompt``: the first members of each community by name, each with type and clipped description, and the
    first of the edges within it (``edges`` has ``id, community_id, source, target, description``); ``(none)`` without edges."""
    text = F.coalesce("description", F.lit(""))
    rows = entities.where("community_id is not null and name is not null").select("community_id", F.upper("name").alias("name"), F.struct("id", F.coalesce("type", F.lit("")).alias("type"), text.alias("description")).alias("r"))
    rows = rows.groupBy("community_id", "name").agg(F.min("r").alias("r"))
    line = F.concat(F.lit("- "), "name", F.lit(" ("), "r.type", F.lit("): "), F.substring("r.description", 1, clip))
    people = _first_lines(rows, ["name"], line, members, "people")
    line = F.concat(F.lit("- "), "source", F.lit(" -> "), "target", F.lit(": "), F.substring(text, 1, edge_clip))
    links = _first_lines(edges, ["id"], line, most_edges, "links")
    out = people.join(links, "community_id", "left")
    body = F.concat(F.lit("Entities:\n"), F.array_join("people", "\n"), F.lit("\n\nRelationships:\n"), F.coalesce(F.array_join("links", "\n"), F.lit("(none)")))
    return out.select("community_id", body.alias("prompt"))


def report_fields(report: Column, community: Column, fallback: Column) -> Column:
    """Title (first line) and summary (the rest) of a report; without them the community's number and ``fallback``."""
    text = F.trim(F.regexp_replace(F.coalesce(report, F.lit("")), "\r\n", "\n"))
    title = F.trim(F.split_part(text, F.lit("\n"), F.lit(1)))
    rest = F.regexp_extract(text, r"\A[^\n]*\n([\s\S]*)", 1)
    return F.struct(
        F.when(title == "", F.concat(F.lit("Community "), community.cast("string"))).otherwise(title).alias("title"),
        F.when(F.contains(text, F.lit("\n")), F.trim(rest)).otherwise(F.coalesce(fallback, F.lit(""))).alias("summary"),
    )


def candidates(raw: DataFrame, max_overlap: float = 0.6) -> DataFrame:
    """Screened question candidates of ``url, document, raw``: ``question, ground_truth, ground_truth_context, tags``.

    ``raw`` is a model's answer with a JSON array; entries without question or answer are left out, as are questions of which
    more than ``max_overlap`` of the content words stand in the whole document. The page's url is the gold context.
    """
    item = "array<struct<question: string, ground_truth: string>>"
    rows = raw.select("url", "document", F.explode(F.from_json(json_array_text(F.col("raw")), item)).alias("c")).select("url", "document", "c.*")
    rows = rows.where("coalesce(question, '') != '' and coalesce(ground_truth, '') != ''")
    rows = rows.where(content_word_overlap(F.col("question"), F.col("document")) <= max_overlap)
    return rows.select("question", "ground_truth", F.col("url").alias("ground_truth_context"), F.array(F.lit("synthetic")).alias("tags"))


def claim_verdicts(raw: Column) -> Column:
    """Claims of a judge's JSON answer as ``array<struct<claim, faithful, reason>>``; entries without a claim are left out."""
    item = F.from_json(json_array_text(raw), "array<struct<claim: string, verdict: string, reason: string>>")
    return F.transform(F.filter(item, lambda c: F.coalesce(c["claim"], F.lit("")) != ""), lambda c: F.struct(c["claim"].alias("claim"), verdict(c["verdict"]).alias("faithful"), F.coalesce(c["reason"], F.lit("")).alias("reason")))


def final_claims(trace: DataFrame) -> DataFrame:
    """``item_id, claims, grounded``: the claims of each item's last attempt (``item_id, attempt, claims``), and how many hold."""
    last = trace.groupBy("item_id").agg(F.max_by("claims", "attempt").alias("claims"))
    return last.select("item_id", "claims", F.size(F.filter("claims", lambda c: c["faithful"])).alias("grounded"))


def extracted(raw: DataFrame, text_col: str = "raw") -> DataFrame:
    """Records of extraction answers: ``kind, name, type, source, target, description, weight`` beside the other columns.

    Records are separated by ``##``, fields by ``<|>``. Names are in upper case; a weight that is no number is 1. Records
    with too few fields, another kind or an empty name are left out.
    """
    rows = raw.withColumn("f_", F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "##"))).withColumn("f_", record_fields(F.col("f_"))).drop(text_col)
    at = lambda i: F.try_element_at("f_", F.lit(i))
    kind = F.lower(at(1))
    entity = (kind == "entity") & (F.size("f_") >= 4) & (at(2) != "")
    edge = (kind == "relationship") & (F.size("f_") >= 5)
    number = F.regexp_extract(at(5), r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)$", 1)
    return rows.where(entity | edge).select(
        *[c for c in rows.columns if c != "f_"],
        kind.alias("kind"),
        F.when(entity, F.upper(at(2))).alias("name"),
        F.when(entity, at(3)).alias("type"),
        F.when(edge, F.upper(at(2))).alias("source"),
        F.when(edge, F.upper(at(3))).alias("target"),
        at(4).alias("description"),
        F.when(edge, F.coalesce(F.nullif(number, F.lit("")).cast("double"), F.lit(1.0))).alias("weight"),
    )


def next_action(score: Column, attempt: Column, threshold: float = 0.7, retries: int = 2) -> Column:
    """``pass``, ``retry`` or ``exhausted`` after a grounding score; without a score at once exhausted, NaN tries again."""
    more = F.when(attempt < retries, "retry").otherwise("exhausted")
    return F.when(score.isNull(), "exhausted").when(F.isnan(score), more).when(score >= threshold, "pass").otherwise(more)


def verdict(value: Column) -> Column:
    """A verdict given as text, number or truth value, as boolean; one that can't be read fails the query."""
    word = F.lower(F.trim(value.cast("string")))
    known = F.when(word.isin("true", "yes", "faithful", "supported"), True).when(word.isin("false", "no", "unfaithful", "unsupported"), False)
    number = F.when(word.rlike(r"^[+-]?\d+(\.\d+)?$"), word.cast("string").try_cast("double") >= 1)
    return F.coalesce(known, number, F.raise_error(F.concat(F.lit("no verdict: "), F.coalesce(word, F.lit("null")))).cast("boolean"))


def stage_order(stage: Column) -> Column:
    """Sort key of stages: sub-query steps by number, retrieval legs, others, then fused and reranked."""
    step = F.regexp_extract(stage, r"^iter_(\d+)$", 1)
    leads = ("dense", "bm25", "local", "global")
    place = F.when(step != "", 0).when(stage.isin(*leads), 1).when(stage == "fused", 3).when(stage == "reranked", 4).otherwise(2)
    order = F.when(step != "", step.cast("int")).otherwise(F.array_position(F.array(*map(F.lit, leads)), stage).cast("int"))
    return F.struct(place.alias("place"), order.alias("step"), stage.alias("stage"))
