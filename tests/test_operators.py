"""Operators on small inputs that pin down their semantics."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.common import first_rows, host, running, usable_vector
from strandline.functions import text, urls
from strandline.operators import chunking, corpus, evaluation, graph, loading, prompts, retrieval, usage
from strandline.plans import registry
from strandline.sources import json_lines
from strandline.streaming.usage import hourly_usage, ingest


def test_rrf_order_and_scores(spark):
    schema = "query_id int, id string, rank int"
    a = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 2)], schema)
    b = spark.createDataFrame([(1, "b", 0), (1, "d", 1)], schema)
    assert [r["id"] for r in retrieval.fuse([a, b]).orderBy("rank").collect()][0] == "b"
    one = spark.createDataFrame([(1, "a", 0)], schema)
    assert math.isclose(retrieval.fuse([one, one]).first()["score"], 2 / 61)
    assert retrieval.fuse([one.limit(0), one.limit(0)]).count() == 0


def test_bm25_prefers_the_rarer_term(spark):
    docs = spark.createDataFrame([("c0", "queue and function"), ("c1", "durable function"), ("c2", "cosmos store"), ("c3", None), ("c4", "")], "id string, t string")
    ask = spark.createDataFrame([(1, "durable functions function"), (2, "the of and"), (3, "cosmos")], "query_id int, q string")
    hits = retrieval.ranked(retrieval.bm25(docs, F.col("t"), ask, F.col("q"))).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in hits] == [(1, "c1"), (1, "c0"), (3, "c2")]


def test_bm25_gives_the_best_of_each_query_only(spark):
    words = "queue function store graph agent index vector cosmos".split()
    docs = spark.range(3000).selectExpr("concat('d', id) as id", "id % 250 as n").select("id", F.concat_ws(" ", *(F.when(F.pmod(F.xxhash64("n", F.lit(i)), F.lit(3)) == 0, F.lit(w)) for i, w in enumerate(words)), F.lit("page")).alias("t"))
    ask = spark.createDataFrame([(1, "queue page"), (2, "Page queue page"), (3, "cosmos index"), (4, "agent graph of vector"), (5, "absent"), (4, "store")], "query_id int, q string")
    every = retrieval.bm25(docs, F.col("t"), ask, F.col("q"))
    want = retrieval.ranked(every.withColumn("score", F.round("score", 9)), 15).orderBy("query_id", "rank").collect()
    best = retrieval.bm25(docs, F.col("t"), ask, F.col("q"), 15)
    assert best.groupBy("query_id").count().where("count > 15").count() == 0
    assert retrieval.ranked(best, 15).orderBy("query_id", "rank").collect() == want
    assert {r["query_id"] for r in want} == {1, 2, 3, 4} and len(want) == 60
    assert [r["id"] for r in want if r["query_id"] == 1] == [r["id"] for r in want if r["query_id"] == 2]


def test_bm25_without_a_broadcast_of_the_asked_terms(spark, monkeypatch):
    docs = spark.createDataFrame([("c0", "queue queue function"), ("c1", "durable function"), ("c2", None)], "id string, t string")
    ask = spark.createDataFrame([(1, "function queue")], "query_id int, q string")
    want = retrieval.bm25(docs, F.col("t"), ask, F.col("q"), 2).orderBy("id").collect()
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 0)
    assert retrieval.bm25(docs, F.col("t"), ask, F.col("q"), 2).orderBy("id").collect() == want and len(want) == 2


def test_exact_knn_searches_queries_of_one_vector_once(spark, monkeypatch):
    asked, plain = [], retrieval.knn_candidates
    monkeypatch.setattr(retrieval, "knn_candidates", lambda docs, queries, *more: (asked.append(queries.count()), plain(docs, queries, *more))[1])
    docs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [0.0, 1.0])], "id string, embedding array<float>")
    ask = spark.createDataFrame([("p#0", [1.0, 0.1]), ("p#1", [1.0, 0.1]), ("q#0", [0.1, 1.0])], "query_id string, embedding array<float>")
    hits = retrieval.exact_knn(docs, ask, 2, dim=2).orderBy("query_id", "rank").collect()
    assert asked == [2]
    assert [(r["query_id"], r["id"]) for r in hits] == [("p#0", "a"), ("p#0", "b"), ("p#1", "a"), ("p#1", "b"), ("q#0", "c"), ("q#0", "b")]


def test_bm25_scores_queries_of_the_same_terms_once(spark, monkeypatch):
    held, plain = [], retrieval._blocks
    monkeypatch.setattr(retrieval, "_blocks", lambda rows, key, *more: (held.append((key, rows.count())), plain(rows, key, *more))[1])
    docs = spark.createDataFrame([("a", "queue function"), ("b", "store")], "id string, t string")
    ask = spark.createDataFrame([("p#0", "Queue"), ("p#1", "the queue"), ("q#0", "store")], "query_id string, q string")
    hits = retrieval.bm25(docs, F.col("t"), ask, F.col("q"), 15).orderBy("query_id").collect()
    assert ("of", 2) in held
    assert [(r["query_id"], r["id"]) for r in hits] == [("p#0", "a"), ("p#1", "a"), ("q#0", "b")]


def test_exact_knn_ties_go_by_id(spark):
    docs = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0])], "id string, embedding array<double>")
    ask = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    hits = retrieval.exact_knn(docs, ask, 2, dim=2).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in hits] == [("a", 1.0), ("b", 1.0)]
    assert retrieval.exact_knn(docs, ask.limit(0), 2, dim=2).count() == 0
    assert retrieval.exact_knn(docs.limit(0), ask, 2, dim=2).count() == 0


def test_exact_knn_keeps_ties_of_the_rounded_score(spark):
    docs = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 2e-5]), ("c", [1.0, 1.0])], "id string, embedding array<double>")
    ask = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    assert [(r["id"], r["score"]) for r in retrieval.exact_knn(docs, ask, 1, dim=2).collect()] == [("a", 1.0)]


def test_accumulate_keeps_the_highest(spark):
    rows = spark.createDataFrame([(1, 0, "a", 0.2, 0), (1, 0, "b", 0.5, 1), (1, 1, "a", 0.9, 0)], "query_id int, step int, id string, score double, rank int")
    assert [(r["id"], r["score"]) for r in retrieval.accumulate(rows).orderBy("rank").collect()] == [("a", 0.9), ("b", 0.5)]


def windows_of(texts, size, overlap):
    """Windows by the definition, text by text: from each start the longest reach that ends at a space, if it can."""
    out = []
    for t in texts:
        t, start, mine = t.strip(), 0, []
        while t:
            reach = t[start : start + size]
            if start + len(reach) < len(t) and " " in reach[1:]:
                reach = reach[: 1 + reach[1:].rindex(" ")]
            mine.append(reach.strip())
            if start + len(reach) == len(t):
                break
            start = max(start + len(reach) - overlap, start + 1)
        out.append([x for x in mine if x])
    return out


def test_windows(spark):
    rng = random.Random(3)
    texts = [" ".join("w" * rng.randrange(1, 30) for _ in range(rng.randrange(1, 60))) for _ in range(40)] + ["", "  ", "ab", "x" * 95, " lead and trail ", "é日 本" * 40]
    df = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "id int, content string")
    for size, overlap in ((50, 10), (10, 0), (20, 19)):
        got = {}
        for r in chunking.chunk_windows(df, size=size, overlap=overlap).orderBy("id", "chunk_no").collect():
            got.setdefault(r["id"], []).append(r["chunk"])
        assert [got.get(i, []) for i in range(len(texts))] == windows_of(texts, size, overlap) and 99 not in got


def test_section_chunks(spark):
    t = "intro\n# A\ntext\n```\n# not one\n```\n### C\r\n## B\n#no\n# D\n" + "long line " * 300
    rows = chunking.section_chunks(spark.createDataFrame([("i", "T", t), ("n", None, None), ("e", None, ""), ("b", None, "text")], "id string, title string, content string")).orderBy("id", "section_no", "piece_no").collect()
    crumbs = [(r["id"], r["section_no"], r["breadcrumb"]) for r in rows if r["piece_no"] == 0]
    assert crumbs == [("b", 0, ""), ("i", 0, "T"), ("i", 1, "T > A"), ("i", 2, "T > A > C"), ("i", 3, "T > A > B"), ("i", 4, "T > D")]
    assert rows[2]["chunk"] == "# A\ntext\n```\n# not one\n```" and [r["piece_no"] for r in rows if r["section_no"] == 4] == [0, 1]
    assert all(len(r["chunk"]) <= 2000 for r in rows)


def test_chunk_documents_number_a_page_over_its_rows(spark):
    pages = spark.createDataFrame([("a", "T", "https://x/p", "# A\none\n# B\ntwo", 0), ("b", None, "https://x/p", "three", 1), ("c", "T", None, "x", 0), ("d", "T", "https://x/q", " ", 0)], "id string, title string, url string, content string, chunk_id int")
    got = chunking.chunk_documents(pages, F.lit("note")).orderBy("chunk_id").collect()
    assert [(r["chunk_id"], r["content"], r["context"]) for r in got] == [(0, "# A\none", "T > A\nnote"), (1, "# B\ntwo", "T > B\nnote"), (2, "three", "\nnote")]
    assert got[0]["id"].endswith("_0_" + hashlib.sha1(b"https://x/p").hexdigest()[:8])


def test_running_places_and_sums_in_split_groups(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", i, i % 5) for i in range(3000)] + [(None, 1, 2), (None, 2, 3)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    got = running(df, ["g"], ["o"], {"total": F.col("v")}).collect()
    seen, sums = {}, {}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        seen.setdefault(g, []).append(o)
        sums[g, o] = sums.get(g, 0) + v
        sums[g] = sums[g, o] = sum(x for h, p, x in rows if h == g and p <= o) if g is None else sums.get(g, 0) + v
    assert len(got) == len(rows) and all(seen[r["g"]][r["place"]] == r["o"] and sums[r["g"], r["o"]] == r["total"] for r in got)


def test_merges_keep_their_sources_in_order(spark):
    rows = [("e2", "Queue", "t2", "second", ["u2", "u1"]), ("e1", "QUEUE", "t1", "first", ["u1", ""]), ("e1", "QUEUE", "t1", "first", ["u1", ""]), ("e3", "queue", None, "first", None), ("e4", None, "t", "x", ["u"])]
    got = graph.merge_entities(spark.createDataFrame(rows, "id string, name string, type string, description string, source_urls array<string>")).collect()
    assert [tuple(r) for r in got] == [("QUEUE", "T1", 3, "first\nsecond", ["e1", "e2", "e3"], ["u1", "u2"])]
    edges = [("r1", "a", "b", 0.5, "x", ["u"]), ("r2", "A", "B", float("nan"), "y", ["v"]), ("r3", "b", "a", None, None, None)]
    got = graph.merge_relationships(spark.createDataFrame(edges, "id string, source string, target string, weight double, description string, source_urls array<string>")).orderBy("source").collect()
    assert [tuple(r) for r in got] == [("A", "B", 0.5, "x\ny", ["r1", "r2"], ["u", "v"]), ("B", "A", 1.0, "", ["r3"], [])]


def test_modularity_communities(spark):
    cliques = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "pqr" for i in range(6) for j in range(i)]
    edges = [*cliques, ("p0", "q0", 1.0), ("q1", "r1", 0.5), ("p2", "p2", 1.0), ("x", "p0", 9.0), ("p3", "q3", None)]
    df = spark.createDataFrame(edges, "source string, target string, weight double")
    nodes = spark.createDataFrame([(f"{c}{i}",) for c in "pqr" for i in range(6)] + [("alone",), (None,)], "node string")
    got = {r["node"]: r["community"] for r in graph.modularity_communities(df, nodes).collect()}
    assert got == {**{f"{c}{i}": f"{c}0" for c in "pqr" for i in range(6)}, "alone": "alone"}
    assert graph.modularity_communities(df.limit(0)).count() == 0


def test_components_that_are_not_done_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "source int, target int")
    assert graph.components(chain).select("component").distinct().count() == 1
    with pytest.raises(RuntimeError):
        graph.components(chain, rounds=1)


def test_passages_are_found_in_the_documents_that_hold_them(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    docs = [(f"d{i:02d}", f"u{i}", " ".join(rng.choice(words) for _ in range(80))) for i in range(30)] + [("z", "uz", None), ("y", None, "alpha beta gamma delta epsilon zeta eta theta")]
    probes = [(f"p{i}", "q", "r", docs[i][2][7 : 7 + n]) for i, n in enumerate([200, 150, 60, 14, 9, 5, 3, 2, 1])] + [("none", "q", "r", "nowhere at all in any of these documents"), ("null", "q", "r", None), ("empty", "q", "r", ""), ("noref", "q", None, docs[3][2]), ("nourl", "q", "r", "alpha beta gamma delta epsilon zeta eta")]
    df = spark.createDataFrame(docs, "doc_id string, url string, text string")
    rows = spark.createDataFrame(probes, "row_id string, question string, reference string, context string")
    want = {(p, d) for p, _, _, t in probes if t for d, _, x in docs if x and t in x}
    assert {tuple(r) for r in corpus.holding(rows.selectExpr("row_id probe_id", "context probe"), df).select("probe_id", "doc_id").collect()} == want
    items = {r["row_id"]: r["ground_truth_context"] for r in corpus.rows_to_items(rows, df).collect()}
    urls_of = {d: u for d, u, _ in docs}
    assert items == {p: urls_of[min(d for q, d in want if q == p)] for p, _, ref, t in probes if t and ref and any(q == p for q, _ in want) and urls_of[min(d for q, d in want if q == p)]}


def test_answers_are_read(spark):
    raw = [("u", "the queue holds rows", '```json\n[{"question": "what holds rows", "ground_truth": "a"}, {"question": "purpose of partitions", "ground_truth": "b"}, {"question": "", "ground_truth": "c"}, {"question": "x"}]\n```'), ("v", "d", "no json"), ("w", "d", None)]
    got = prompts.candidates(spark.createDataFrame(raw, "url string, document string, raw string")).collect()
    assert [tuple(r) for r in got] == [("purpose of partitions", "b", "u", ["synthetic"])]
    trace = spark.createDataFrame([("i", 0, '[{"claim": "a", "verdict": "yes"}]'), ("i", 1, '[{"claim": "a", "verdict": 1}, {"claim": "b", "verdict": false, "reason": "r"}, {"verdict": "yes"}]'), ("j", 0, None)], "item_id string, attempt int, raw string")
    last = {r["item_id"]: r for r in prompts.final_claims(trace.withColumn("claims", prompts.claim_verdicts(F.col("raw")))).collect()}
    assert last["i"]["grounded"] == 1 and [c["faithful"] for c in last["i"]["claims"]] == [True, False] and "j" in last
    r = spark.createDataFrame([("Title\nSum one\ntwo", 3, "f"), ("Only title", 4, "f"), (None, 5, None)], "r string, c int, f string")
    got = [tuple(x[0]) for x in r.orderBy("c").select(prompts.report_fields(F.col("r"), F.col("c"), F.col("f"))).collect()]
    assert got == [("Title", "Sum one\ntwo"), ("Only title", "f"), ("Community 5", "")]


def test_prompts_hold_whole_passages_and_previous_answers(spark):
    hits = spark.createDataFrame([(1, 1, None, None), (1, 0, "u", "c" * 5000)], "query_id int, rank int, url string, content string")
    ask = spark.createDataFrame([(1, "why?", "old")], "query_id int, question string, previous_answer string")
    got = prompts.grounding_prompt(hits, ask).first()["prompt"]
    assert got.startswith("Not verified") and "\nold\n" in got and "c" * 5000 in got and got.endswith("Question: why?") and "[2] () " in got


def test_stages_and_reports(spark):
    means = spark.createDataFrame([("mrr@fused", 0.5), ("mrr@dense", 0.25), ("hit_rate@bm25", 0.1), ("mrr@iter_1", 0.2), ("mrr", 0.5)], "key string, mean double").selectExpr("*", "3 AS valid", "4 AS total")
    assert [r["stage"] for r in evaluation.stage_means(means).orderBy("position").collect()] == ["iter_1", "dense", "bm25", "fused"]
    assert [tuple(r) for r in evaluation.overall(means).collect()] == [("mrr", 0.5, "3/4")]
    rows = spark.createDataFrame([("a", "m", 0.5), ("a", "n", float("nan")), ("b", "m", 1.0)], "mode string, metric string, mean double")
    assert {r["mode"]: json.loads(r["report"]) for r in evaluation.json_report(rows).collect()} == {"a": {"m": 0.5, "n": None}, "b": {"m": 1.0}}
    assert [tuple(r) for r in evaluation.against_baseline(rows, "b").collect()] == [("a", "m", 0.5, 1.0, -0.5)]
    hits = spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.5, 0), (1, "c", 0.9, 2)], "query_id int, id string, score double, rank int")
    assert [r["id"] for r in retrieval.reranked(hits, 2).orderBy("rank").collect()] == ["c", "b"]
    assert retrieval.retried(hits, 1, 2).groupBy("attempt").count().orderBy("attempt").collect() == [(0, 1), (1, 3)]


def test_headings(spark):
    t = "intro\n# A\ntext\n```\n# not one\n```\n### C\r\n## B\n#no\n# D"
    rows = chunking.headings(spark.createDataFrame([("i", "T", t), ("n", None, None)], "id string, title string, content string")).orderBy("section_no").collect()
    assert [(r["section_no"], r["level"], r["breadcrumb"]) for r in rows] == [(1, 1, "T > A"), (2, 3, "T > A > C"), (3, 2, "T > A > B"), (4, 1, "T > D")]


def test_urls(spark):
    rows = [(" HTTPS://Learn.X.example/en-us/svc/Page/?a=1#b ",), ("https://x.example/en-us/",), (None,), ("no url",)]
    got = [r[0] for r in spark.createDataFrame(rows, "u string").select(urls.normal_url(F.col("u"))).collect()]
    assert got == ["https://learn.x.example/svc/page", "https://x.example", None, "no url"]
    hosts = [r[0] for r in spark.createDataFrame([("HTTP://u:p@A.b:80/x",), ("a/b",), ("https://H",)], "u string").select(host(F.col("u"))).collect()]
    assert hosts == ["a.b", None, "h"]
    ids = spark.createDataFrame([("https://x/" + "p" * 100, 3)], "u string, i int").select(urls.document_id(F.col("u"), F.col("i"))).first()[0]
    assert "\n" not in ids and "=" not in ids and ids.endswith("_3_" + hashlib.sha1(("https://x/" + "p" * 100).encode()).hexdigest()[:8])


def test_text_functions(spark):
    row = spark.createDataFrame([("Compare A with B", "vsphere", '```json\n[{"a":1}]\n```', '("entity"<|>"X"<|>T<|>d)')], "a string, b string, c string, d string")
    got = row.select(text.query_class(F.col("a")), text.query_class(F.col("b")), text.json_array_text(F.col("c")), text.record_fields(F.col("d")), text.content_word_overlap(F.lit("of it"), F.lit("x")), text.first_filled(F.lit(""), F.lit(None).cast("string"), F.lit("z"))).first()
    assert got[0:3] == ("global", "local", '[{"a":1}]') and got[3] == ["entity", "X", "T", "d"] and got[4] == 1.0 and got[5] == "z"


def test_first_rows(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None), (None, 1, "z"), ("c", 1, "q"), ("c", 1, "q")], "id string, t int, v string")
    got = sorted((r["id"], r["v"]) for r in first_rows(rows, "id", [F.col("t")]).collect())
    assert got == [("a", "y"), ("b", None), ("c", "q")]
    assert first_rows(rows.limit(0), "id", [F.col("t")]).count() == 0


def test_usable_vector(spark):
    rows = [([1.0, 0.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0],), (None,), ([1.0, None],), ([float("inf"), 1.0],)]
    assert [r[0] for r in spark.createDataFrame(rows, "v array<double>").select(usable_vector(F.col("v"), 2)).collect()] == [True] + [False] * 6


def test_components(spark):
    edges = [("b", "a"), ("b", "c"), ("x", "y"), ("z", "z"), (None, "a")] + [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(30)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "source string, target string")).collect()}
    assert got["a"] == got["b"] == got["c"] == "a" and got["x"] == got["y"] == "x" and got["z"] == "z" and {got[f"n{i:02d}"] for i in range(31)} == {"n00"}


def test_loading(spark):
    table = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    export = spark.createDataFrame([("b", 2), ("c", 2)], "id string, v int")
    assert loading.load_counts(table, export).first() == (2, 1, 1)
    assert sorted(loading.converge(table, export).collect()) == [("b", 1), ("c", 2)]
    assert loading.load_counts(table, table).first() == (2, 0, 0)


def test_metrics_ignore_missing(spark):
    rows = spark.createDataFrame([("m", "1", "f", 1.0), ("m", "2", "f", float("nan")), ("m", "3", "f", None), ("m", "1", "g", None)], "mode string, item_id string, metric string, value double")
    got = evaluation.means(rows, "mode").collect()
    assert [(r["metric"], r["mean"], r["valid"], r["total"]) for r in got] == [("f", 1.0, 1, 3)]
    tagged = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None)], "i int, tags array<string>")
    assert sorted(r["tag"] for r in evaluation.by_tag(tagged).collect()) == ["a", "b", "original", "original"]


def test_intervals_and_paired_tests(spark):
    rows = [("base", str(i), "f", 0.1 * i) for i in range(8)] + [("better", str(i), "f", 0.1 * i + 0.2) for i in range(8)] + [("same", str(i), "f", 0.1 * i) for i in range(8)] + [("one", "0", "f", 0.5)]
    df = spark.createDataFrame(rows, "mode string, item_id string, metric string, value double")
    got = {r["mode"]: r for r in evaluation.paired_tests(df, "base").collect()}
    assert got["better"]["p_value"] < 0.05 and got["same"]["p_value"] == 1.0 and "one" not in got
    ci = {r["mode"]: r for r in evaluation.bootstrap_means(df, "mode").collect()}
    assert ci["base"]["low"] < ci["base"]["mean"] < ci["base"]["high"] and ci["one"]["low"] == ci["one"]["high"] == 0.5


def test_paired_tests_give_intervals_and_verdicts(spark):
    rows = [("base", str(i), "f", 0.1) for i in range(40)] + [("better", str(i), "f", 0.3 + 0.01 * (i % 5)) for i in range(40)] + [("mixed", str(i), "f", 0.1 + 0.2 * (-1) ** i) for i in range(40)]
    got = {r["mode"]: r for r in evaluation.paired_tests(spark.createDataFrame(rows, "mode string, item_id string, metric string, value double"), "base").collect()}
    assert got["better"]["p_value"] == 1 / 10_001 and got["better"]["significant"] and not got["mixed"]["significant"]
    assert 0.2 < got["better"]["ci_low"] < got["better"]["mean_diff"] < got["better"]["ci_high"] < 0.24
    assert got["mixed"]["ci_low"] < 0 < got["mixed"]["ci_high"]


def test_thresholds(spark):
    rows = [(0.9, True), (0.65, True), (0.6, True), (0.7, False), (0.5, False), (0.3, False)]
    sweep = evaluation.threshold_sweep(spark.createDataFrame(rows, "score double, faithful boolean"))
    best = evaluation.recommended_threshold(sweep, 0.0).first()
    assert best["threshold"] > 0.7 and math.isclose(best["false_abstain_rate"], 2 / 3)
    assert sweep.count() == 7


def test_canary_counts_missing(spark):
    rows = [("a", True, 0.9, 0.8), ("b", False, None, 0.1), ("c", True, float("nan"), 0.9)]
    got = evaluation.canary(spark.createDataFrame(rows, "id string, expected_pass boolean, online double, offline double"), 0.7).first()
    assert got["online_missing"] == 2 and got["drifted"] and got["online_wrong"] == 0


def test_usage_keeps_the_first_record(spark):
    rows = [(1, "s", 5, None, False, "2024-01-01 00:00:00", "2024-01-01 00:00:01"), (1, "s", 7, None, False, "2024-01-01 00:00:00", "2024-01-02 00:00:00"), (2, "s", None, 3, True, "2024-01-01 00:10:00", "2024-01-01 05:00:00")]
    df = spark.createDataFrame(rows, "entry_id int, stage string, input_tokens long, output_tokens long, usage_missing boolean, called_at string, recorded_at string")
    df = df.withColumns({c: F.col(c).cast("timestamp") for c in ("called_at", "recorded_at")}).withColumns({c: F.lit(None).cast("bigint") for c in ("cached_input_tokens", "request_units")})
    got = usage.totals(df, "stage").first()
    assert (got["calls"], got["input_tokens"], got["output_tokens"], got["missing"]) == (2, 5, 3, 1)
    assert usage.hourly(df).first()["late"] == 1


def test_sources(spark, tmp_path):
    items = tmp_path / "t.jsonl"
    items.write_text('{"question":"q","ground_truth":"g","ground_truth_context":"https://x"}\n\n{"question":"r","ground_truth":"g","ground_truth_context":["u",""," v"],"tags":["a"]}\n')
    got = json_lines.read_test_set(spark, str(items)).collect()
    assert [(r["gold_urls"], r["tags"]) for r in got] == [(["https://x"], []), (["u", " v"], ["a"])]
    data = b'{"id":"a","v":1}\n{"id":"b","v":2}\n'
    (tmp_path / "i.jsonl").write_bytes(data)
    entry = {"expected": 2, "exported": 2, "complete": True, "file": "i.jsonl", "sha256": hashlib.sha256(data).hexdigest()}

    def manifest(**change):
        (tmp_path / "manifest.json").write_text(json.dumps({"indexes": {"i": entry | change}}))
        return json_lines.read_export(spark, str(tmp_path), "i", "id string, v int")

    assert manifest().count() == 2
    for bad in ({"sha256": "0"}, {"exported": 3}, {"complete": False}):
        with pytest.raises(json_lines.ExportRefused):
            manifest(**bad)
    with pytest.raises(json_lines.ExportRefused):
        json_lines.read_export(spark, str(tmp_path), "other", "id string")
    with pytest.raises(json_lines.ExportRefused):
        manifest() and json_lines.read_export(spark, str(tmp_path), "i", "id string, w int")


def test_streams(spark, data, tmp_path):
    ledger = spark.read.parquet(f"{data}/usage_ledger.parquet")
    (tmp_path / "in").mkdir()
    ledger.write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ledger.schema).parquet(str(tmp_path / "in"))
    q = hourly_usage(stream).writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination()
    want = ledger.where("called_at is not null").dropDuplicates(["entry_id"]).count()
    assert spark.table("hours").agg(F.sum("calls")).first()[0] == want
    for _ in range(2):
        ingest(spark.readStream.schema(ledger.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), "entry_id").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == ledger.where("entry_id is not null").select("entry_id").distinct().count()


def test_packed_passages(spark):
    rows = spark.createDataFrame([("p", "a", "aaaa"), ("p", "b", "bbbb"), ("p", "c", "c"), ("q", "x", "x" * 40), ("r", "n", None)], "g string, id string, t string")
    got = [tuple(r) for r in prompts.packed(rows, "g", ["id"], "t", 15).orderBy("g", "place").collect()]
    assert got == [("p", "a", 0, "aaaa"), ("p", "b", 1, "bbbb"), ("q", "x", 0, "x" * 15), ("r", "n", 0, "")]


def test_extraction(spark):
    raw = '("entity"<|>"Queue"<|>Resource<|>holds rows)##entity<|>Topic<|>T<|>d##relationship<|>queue<|>topic<|>feeds<|>8##(relationship<|>a<|>b<|>c<|>strong)##garbage##entity<|><|>T<|>d##relationship<|>a<|>b<|>c'
    got = prompts.extracted(spark.createDataFrame([("c1", raw), ("c2", "nothing"), ("c3", None)], "chunk string, raw string")).collect()
    assert [(r["kind"], r["name"], r["source"], r["weight"]) for r in got] == [("entity", "QUEUE", None, None), ("entity", "TOPIC", None, None), ("relationship", None, "QUEUE", 8.0), ("relationship", None, "A", 1.0)]


def test_actions_and_verdicts(spark):
    rows = spark.createDataFrame([(0.9, 0), (0.1, 0), (0.1, 2), (None, 0), (float("nan"), 0), (float("nan"), 2)], "s double, a int")
    assert [r[0] for r in rows.select(prompts.next_action(F.col("s"), F.col("a"))).collect()] == ["pass", "retry", "exhausted", "exhausted", "retry", "exhausted"]
    words = spark.createDataFrame([("Yes",), ("0",), ("1.5",), (" false ",)], "v string")
    assert [r[0] for r in words.select(prompts.verdict(F.col("v"))).collect()] == [True, False, True, False]
    with pytest.raises(Exception, match="no verdict"):
        spark.createDataFrame([("maybe",)], "v string").select(prompts.verdict(F.col("v"))).collect()
    stages = spark.createDataFrame([("fused",), ("iter_10",), ("dense",), ("iter_2",), ("other",), ("reranked",)], "s string")
    assert [r[0] for r in stages.orderBy(prompts.stage_order(F.col("s"))).collect()] == ["iter_2", "iter_10", "dense", "other", "fused", "reranked"]


def test_report_input_takes_the_first_members(spark):
    rows = [(f"e{i:03d}", f"n{i:03d}", "d" * 300, 1) for i in range(50)] + [("x", None, "d", 1), ("y", "n000", None, 1)]
    edges = spark.createDataFrame([(f"r{i:02d}", 1, "a", "b", "e" * 100) for i in range(20)] + [("s", 2, "a", "b", None)], "id string, community_id int, source string, target string, description string")
    df = spark.createDataFrame(rows, "id string, name string, description string, community_id int").withColumn("type", F.lit("T"))
    got, links = prompts.report_input(df, edges).first()["prompt"].removeprefix("Entities:\n").split("\n\nRelationships:\n")
    assert links.split("\n") == ["- a -> b: " + "e" * 80] * 10
    assert prompts.report_input(df, edges.limit(0)).first()["prompt"].endswith("\n(none)")
    got = got.split("\n")
    assert len(got) == 20 and got[0] == "- N000 (T): " + "d" * 120


def test_canaries_test_sets_and_means(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": "a", "query": "q", "answer": "x", "contexts": ["c"], "label": "faithful"}\n\n{"id": "b", "query": "q", "answer": "x", "contexts": [], "label": "unfaithful", "note": "n"}\n')
    assert [(r["id"], r["label"], r["note"]) for r in json_lines.read_canary(spark, str(tmp_path / "c.jsonl")).orderBy("id").collect()] == [("a", "faithful", ""), ("b", "unfaithful", "n")]
    (tmp_path / "d.jsonl").write_text('{"id": "a", "label": "perhaps"}')
    with pytest.raises(Exception, match="unknown label perhaps"):
        json_lines.read_canary(spark, str(tmp_path / "d.jsonl")).collect()
    with pytest.raises(ValueError):
        json_lines.load_test_set(spark)
    assert json_lines.load_test_set(spark, synthetic=lambda: spark.range(3)).count() == 3
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "fused.json").write_text('{"means": {"mrr": 0.5, "x@y": 1.0}}')
    assert [tuple(r) for r in json_lines.read_means(spark, str(tmp_path / "m"), ["mrr", "hit_rate"]).collect()] == [("fused", 0.5, None)]


def test_eval_by_tag_counts_every_leaf(spark, data):
    leaves = registry.table(spark, data, "raptor_sac").where("level = 0 and id is not null and coalesce(url, '') != ''").select("id").distinct().count()
    rows = registry.QUERIES["eval_by_tag"](spark, data).where("metric = 'mrr'").groupBy("mode").sum("total").collect()
    assert len(rows) == 3 and {r["sum(total)"] for r in rows} == {leaves}


def test_eval_metrics_has_every_leaf(spark, data):
    leaves = registry.table(spark, data, "raptor_sac").where("level = 0 and id is not null and coalesce(url, '') != ''").select("id").distinct()
    rows = registry.QUERIES["eval_metrics"](spark, data).select("item_id").distinct()
    assert rows.count() == leaves.count() and rows.join(leaves, rows.item_id == leaves.id, "left_anti").count() == 0


def test_exact_knn_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2600, 64)).astype(np.float32)
    x[1000:1300] = x[7]  # more ties than rows are kept
    docs = spark.createDataFrame([(f"d{i:04d}", v.tolist()) for i, v in enumerate(x)], "id string, embedding array<float>").coalesce(1)
    ask = docs.where("id < 'd0070'").withColumnRenamed("id", "query_id")
    got = retrieval.exact_knn(docs, ask, 15).collect()
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = np.round(u[:70] @ u.T, 9)
    want = {(f"d{i:04d}", f"d{j:04d}", r) for i in range(70) for r, j in enumerate(np.lexsort((np.arange(len(x)), -s[i]))[:15])}
    assert {(r["query_id"], r["id"], r["rank"]) for r in got} == want
