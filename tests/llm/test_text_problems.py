"""Sections, page bodies, site lines, token ids and look-alike forms."""

import itertools
import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.llm import lookalike, page_body, queries, site_lines, split_sections, tokens
from strandline.llm.page_labels import label_lines


# ---- problem 1


def brute_sections(text):
    out, now, fence = [], [], False
    for line in text.replace("\r\n", "\n").split("\n"):
        if re.match(r"\s*```", line):
            fence = not fence
        elif not fence and re.fullmatch(r"#{1,6}\s+\S.*", line):
            out.append(now)
            now = []
        now.append(line)
    return ["\n".join(x).strip() for x in [*out, now]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word ", "Topic words here. ", "\n", "\n\n", "- item\n", "```\n", "# head\n", "x" * 700, "。", "\r\n", "end? "]), max_size=400))
def test_cut_is_whole_and_bounded(parts):
    text = "".join(parts).strip()
    pieces = split_sections.cut(text, 500, 60)
    whole = text[pieces[0][0] : pieces[0][1]]
    for (_, end), (start, stop) in itertools.pairwise(pieces):
        assert start == end - 60 and stop > end
        whole += text[end:stop]
    assert whole == text and all(b - a <= 500 for a, b in pieces)


def test_cut_finds_the_change_of_topic():
    a = [f"The orchard grows apple and pear trees in row {i}. " for i in range(25)]
    b = [f"A compiler parses tokens into syntax nodes at pass {i}. " for i in range(25)]
    text = "".join(a + b).strip()
    (first, *_rest) = split_sections.cut(text, 2000, 100)
    assert abs(first[1] - len("".join(a))) <= 60


def test_cohesion_against_counting_anew():
    random.seed(4)
    units = [" ".join(random.choice(["queue", "topic", "apple", "pear", f"w{random.randrange(900)}"]) for _ in range(random.randrange(9))) + ". " for _ in range(300)]
    ends = list(itertools.accumulate(map(len, units)))
    words = [re.findall(r"[a-z0-9]+", u) for u in units]
    want = []
    for g in range(1, len(units)):
        a, b = (Counter(w for u in part for w in u) for part in (words[max(0, g - split_sections.BLOCK) : g], words[g : g + split_sections.BLOCK]))
        norm = math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))
        want.append(sum(n * b[w] for w, n in a.items()) / norm if norm else 0.0)
    assert np.allclose(split_sections.cohesion("".join(units), ends), want)
    assert len(split_sections.cohesion("one", [3])) == 0


def test_memory_does_not_grow_with_the_words_of_a_section():
    import tracemalloc

    peaks = []
    for n in (20_000, 80_000):
        text = "".join(f"Unit {i} of w{i} and w{i + 1}. " for i in range(n))
        ends = list(itertools.accumulate(len(f"Unit {i} of w{i} and w{i + 1}. ") for i in range(n)))
        tracemalloc.start()
        split_sections.cohesion(text, ends)
        peaks.append(tracemalloc.get_traced_memory()[1] - 8 * n)  # besides the similarities themselves
        tracemalloc.stop()
    assert peaks[1] < 2 * peaks[0] + 100_000


def test_split_oversized(spark):
    long = "# A\n" + "para one. " * 250 + "\n```\n# no\n```\n## B\nshort"
    rows = [("a", long, "T", 1, "s"), ("a", long, "T", 2, "s"), ("b", None, "T", 1, "s"), ("c", "", None, 1, "s"), (None, long, "T", 1, "s"), ("d", "y" * 9000, None, 1, "s"), ("e", "# H\r\n" + "z\r\n" * 998, "", 1, "s")]
    df = spark.createDataFrame(rows, "id string, content string, title string, ingested_at int, text string")
    got = split_sections.split_oversized(df).orderBy("id", "section_no", "piece_no").collect()
    by = {}
    for r in got:
        by.setdefault((r["id"], r["section_no"]), []).append(r)
    assert set(by) == {("a", 1), ("d", 0)}
    assert by["a", 1][0]["breadcrumb"] == "T > A" and by["d", 0][0]["breadcrumb"] == ""
    for (key, no), pieces in by.items():
        body = brute_sections(dict((r[0], r[1]) for r in rows if r[0])[key])[no]
        assert pieces[0]["text"] + "".join(p["text"][200:] for p in pieces[1:]) == body and max(len(p["text"]) for p in pieces) <= 2000
    assert split_sections.split_oversized(df.limit(0)).count() == 0


def test_sections_against_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/ms_docs.parquet").where("content is not null").select("id", "content").distinct().collect()
    want = {(r["id"], i) for r in rows for i, s in enumerate(brute_sections(r["content"])) if len(s) > 2000}
    assert want and want == {tuple(r) for r in queries.p1_found(spark, data).collect()}


# ---- problem 2


def test_messages_give_the_exact_marginals():
    rng = np.random.default_rng(3)
    page = page_body.Page([1, 2, 3, 4, 5, 6], [-1, 0, 0, 1, 1, 4], [0, 1, 1, 2, 2, 3], [2, 1, 0, 0, 1, 0], [0, 1, 2, 3, 4, 5], [""] * 6, [""] * 6)
    model = page_body.Model({}, rng.normal(size=(3, page_body._N, page_body._N, 2, 2)), rng.normal(size=(page_body._N, 2)))
    score = rng.normal(size=6)
    weight = np.zeros((6, 2))
    for y in itertools.product((0, 1), repeat=6):
        e = sum(score[i] * y[i] for i in range(6)) + model.top[0, y[0]]
        e += sum(model.edge[page.relation[i], page.shape[p], page.shape[i], y[p], y[i]] for i, p in enumerate(page.parent) if p >= 0)
        for i in range(6):
            weight[i, y[i]] += math.exp(e)
    got = page_body.marginals(model, [page, page], [*score, *score])
    assert np.allclose(got, np.tile(np.log(weight[:, 1] / weight[:, 0]), 2))


def test_held_out_pages(spark, data):
    train = spark.read.parquet(data.replace("0.001", "0.01") + "/ms_docs.parquet").where("content is not null")
    test = spark.read.parquet(f"{data}/ms_docs.parquet").where("content is not null")
    got = {tuple(r) for r in page_body.furniture_lines(test, page_body.fit(train)).collect()}
    want = {(r["id"], n) for r in test.select("id", "content").distinct().collect() for n, y in enumerate(label_lines(r["content"].split("\n")), 1) if y}
    hit = len(got & want)
    assert hit / len(got) > 0.97 and hit / len(want) > 0.97


def test_wordings_taken_out_of_training(data):
    """Half of the annotated wordings are in no training page; most of their lines are told by shape, place and site name."""
    import pyarrow.parquet as pq

    from strandline.llm import page_labels

    def load(sf):
        rows = pq.read_table(f"{data.replace('0.001', sf)}/ms_docs.parquet", columns=["id", "url", "content"]).to_pylist()
        return list({r["id"]: (r["content"], r["url"]) for r in rows if r["content"]}.values())

    for half in (0, 1):
        held = re.compile("|".join(page_labels.WORDINGS[half::2]))
        train = []
        for text, url in load("0.01"):
            lines = text.split("\n")
            train.append(("\n".join(x for x, y in zip(lines, label_lines(lines)) if not (y and held.fullmatch(page_labels.reduced(x)))), url))
        model, test = page_body.train(train), load("0.001")
        pages = [page_body.parse(*p) for p in test]
        scorer = page_body.Scorer(model)
        odds = iter(page_body.marginals(model, pages, [z for p in pages for z in scorer(p)]))
        found = of = wrong = 0
        for (text, _), page in zip(test, pages):
            lines = text.split("\n")
            marks = label_lines(lines)
            for no in page.line_no:
                furniture = next(odds) > 0
                if marks[no - 1] and held.fullmatch(page_labels.reduced(lines[no - 1])):
                    found, of = found + furniture, of + 1
                wrong += furniture and not marks[no - 1]
        assert of > 100 and found / of > 0.65 and wrong <= 2


def test_page_edges(spark):
    page = "Sign in\n\n# A\n\nThe queue holds rows.\n```\nSign in\n```\n\n© 2020 Acme Works. All rights reserved in every region."
    rows = [(str(i), page, f"https://s{i % 3}.example/x", 1) for i in range(40)] + [("n", None, None, 1), ("e", "", None, 1), ("b", " \n\t\n", None, 1), (None, page, None, 1), ("l", "word " * 60_000, "", 1), ("0", page, None, 2)]
    df = spark.createDataFrame(rows, "id string, content string, url string, ingested_at int")
    model = page_body.fit(df)
    got = {tuple(r) for r in page_body.furniture_lines(df, model).collect()}
    assert {r for r in got if r[0] not in "l"} == {(str(i), n) for i in range(40) for n in (1, 10)}
    bodies = {r["id"]: r["body"] for r in page_body.page_bodies(df, model).collect()}
    assert bodies["n"] is None and bodies["e"] == "" and "rights" not in bodies["3"] and "queue" in bodies["3"]
    assert page_body.furniture_lines(df.limit(0)).count() == 0


# ---- problem 3


def test_site_lines_against_brute_force(spark, data):
    letters = lambda s: "".join(c for c in s.lower() if unicodedata.category(c).startswith("L"))
    rows = [(f"d{i}", f"https://{'A' if i % 2 else 'a'}.example/{i}", f"Legal NOTICE number {i}: all rights are reserved\nown line of document {'x' * (i + 5)}\nshort\nlegal notice number: all rights are reserved", 1) for i in range(9)]
    rows += [(f"o{i}", "https://b.example/", "Legal notice number: all rights are reserved", 1) for i in range(7)] + [("o0", "https://b.example/", "Legal notice number: all rights are reserved", 2)]
    rows += [("n", None, "Legal notice number: all rights are reserved", 1), ("m", "https://a.example", None, 1), ("k", "https://a.example", "", 1), (None, "https://a.example", "x", 1), ("u", "nothing", "Legal notice number: all rights are reserved", 1)]
    df = spark.createDataFrame(rows, "id string, url string, content string, ingested_at int").withColumn("site", F.lit("clash")).withColumn("k", F.lit(1))
    got = sorted(tuple(r) for r in site_lines.repeated_lines(df).collect())
    assert got == sorted((f"d{i}", n) for i in range(9) for n in (1, 4)) and letters("ÀB1c") == "àbc"
    cleaned = {r["id"]: r["cleaned"] for r in site_lines.without_lines(df, site_lines.repeated_lines(df)).collect()}
    assert cleaned["d2"] == "own line of document " + "x" * 7 + "\nshort" and cleaned["m"] is None and cleaned["o3"].startswith("Legal")
    assert site_lines.repeated_lines(df.limit(0)).count() == 0
    assert site_lines.repeated_lines(df, min_share=1.0).count() == 0  # a.example has ten documents, nine hold the line
    assert site_lines.repeated_lines(df, min_share=0.9).count() == len(got)
    assert [tuple(r)[0::2] for r in site_lines.line_shares(df).collect()] == [("a.example", 9)] and site_lines.line_shares(df).first()["share"] == 0.9


# ---- problem 6


@pytest.fixture(scope="module")
def encoder():
    with open(tokens.vocabulary_path(), "rb") as f:
        return tokens.PrefixEncoder(f.read(), tokens.word_pattern())


@pytest.fixture(scope="module")
def public():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from("aeinrst '\n\tl1日本é👩‍"), st.characters(codec="utf-8")), max_size=80))
def test_ids_are_those_of_the_public_tokenizer(encoder, public, text):
    assert encoder.encode(text) == public(text)


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_edits_and_appends_are_exact(encoder, data):
    alphabet = st.text(alphabet="abrl'e  \nst1é日", max_size=40)
    text, new = data.draw(alphabet), data.draw(alphabet)
    a = data.draw(st.integers(0, len(text)))
    b = data.draw(st.integers(a, len(text)))
    changed, ids = encoder.edit(text, encoder.encode(text), a, b, new)
    assert changed == text[:a] + new + text[b:] and ids == encoder.encode(changed)


def test_prefixes_hold_every_prefix(encoder, public):
    word = "internationalization"
    last = encoder.prefixes(word.encode())
    for n in range(1, len(word) + 1):
        assert list(encoder.walk(last[:n])) == public(word[:n])


def test_corpus_ids(spark, data, public):
    rows = [(1, None), (2, ""), (3, "<|endoftext|> x"), (4, "x" * 50_000), (5, " \n "), (None, "a"), (5, "again")]
    got = sorted((r["doc_id"] or 0, r["ids"]) for r in tokens.encode_corpus(spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.lit(1))).collect())
    assert got == sorted((i or 0, public(t) if t else []) for i, t in rows)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert {r["doc_id"]: r["ids"] for r in queries.p6_ids(spark, data).collect()} == {r["doc_id"]: public(r["text"]) if r["text"] else [] for r in docs}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.encode_corpus(empty).count() == 0


# ---- problem 8

SAME = [
    ("server", "sеrvеr"), ("Ｔｅｘｔ １", "Text 1"), ("café", "café"), ("a b", "a b"), ("a​b­", "ab"), ("well‑known", "well-known"),
    ("ОН", "OH"), ("сервер", "cервep"), ("Ω", "Ω"), ("Å", "Å"), ("x;", "x;"), ("カ", "ｶ"), ("a\r\nb", "a\nb"), ("ガ", "ｶﾞ"), ("ΤΟΝΕ", "TONE"), ("é", "e‍́"),
]
DIFFERENT = [("a", "A"), ("e", "é"), ("10²", "102"), ("③", "3"), ("a b", "a  b"), ("O", "0"), ("l", "1"), ("–", "-"), ("👩‍💻", "👩💻"), ("ab", "a b"), ("я", "r"), ("ß", "ss")]


def test_forms():
    for a, b in SAME:
        assert lookalike.consistent(a) == lookalike.consistent(b), (a, b)
    for a, b in DIFFERENT:
        assert lookalike.consistent(a) != lookalike.consistent(b), (a, b)
    assert lookalike.consistent("cервep") == "сервер" and lookalike.consistent("sеrvеr") == "server"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aеoоοсcH ́‍­😀👩ｶﾞ"), st.characters(codec="utf-8")), max_size=30))
def test_forms_are_idempotent(text):
    once = lookalike.consistent(text)
    assert lookalike.consistent(once) == once


def test_lookalike_pairs_against_brute_force(spark, data):
    random.seed(2)
    rows = [(1, "server one"), (2, "sеrver one"), (3, "server one"), (4, "server one"), (5, None), (6, ""), (7, " "), (8, " "), (9, "other"), (10, "Server one"), (9, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("clash"))
    got = {tuple(r) for r in lookalike.lookalike_pairs(df).collect()}
    assert got == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)}
    assert lookalike.lookalike_pairs(df).columns == ["doc_id_a", "doc_id_b"]
    classes = {r["id"]: (r["class_id"], r["links"]) for r in lookalike.lookalike_classes(df).collect()}
    assert classes == {1: (1, 2), 2: (1, 3), 3: (1, 2), 4: (1, 3), 9: (9, 0), 10: (10, 0)}
    assert lookalike.lookalike_pairs(df.limit(0)).count() == 0
    docs = spark.read.parquet(f"{data}/documents.parquet").where("text is not null").select("doc_id", "text").collect()
    forms = [(r["doc_id"], r["text"], lookalike.consistent(r["text"])) for r in docs]
    want = {(min(a[0], b[0]), max(a[0], b[0])) for a, b in itertools.combinations(forms, 2) if a[2] == b[2] and a[1] != b[1] and a[2].strip()}
    assert {tuple(r) for r in queries.p8_found(spark, data).collect()} == want


def test_planted_spellings_are_found(spark):
    """The truth is planted: each text comes in spellings made by hand, and beside texts that a reader can tell apart."""
    plain = [f"Open the cache page {i} and check each peer" for i in range(30)]
    spell = [lambda t: t, lambda t: t.replace("cache", "c\u0430\u0441h\u0435"), lambda t: t.replace(" the ", "\u00a0the\u2009"), lambda t: t.replace("Open", "\uff2f\uff50\uff45\uff4e"), lambda t: t.replace("peer", "pe\u200ber")]
    apart = [lambda t: t.replace("Open", "open"), lambda t: t.replace("peer", "p\u00e9er"), lambda t: t + " ", lambda t: t.replace("page", "page\u00b2")]
    rows, of = [], {}
    for i, t in enumerate(plain):
        for n, f in enumerate([*spell, *apart]):
            rows.append((len(rows), f(t)))
            of[len(rows) - 1] = (i, min(n, len(spell)) if n < len(spell) else None)
    got = {tuple(r) for r in lookalike.lookalike_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(of, 2) if of[a][0] == of[b][0] and None not in (of[a][1], of[b][1])}


def test_edits_of_the_tables(spark, data, public):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    want = {r["doc_id"]: public((r["text"] or "") + " ".join(["", *(x for x in (r["lang"], r["source"]) if x is not None)])) for r in docs}
    assert {r["doc_id"]: r["ids"] for r in queries.p6_edits(spark, data).collect()} == want


def test_corpus_edits(spark, public):
    rows = [(1, "the queue", 9, 9, " holds rows"), (2, "the queue holds", 4, 9, "topic"), (3, None, 0, 0, "x"), (4, "don'", 4, 99, "t stop"), (5, "gone", 0, 4, None)]
    df = spark.createDataFrame([(i, t, public(t) if t else None, a, b, n) for i, t, a, b, n in rows], "doc_id long, text string, ids array<int>, start int, end int, new string")
    got = {r["doc_id"]: (r["text"], r["ids"]) for r in tokens.edit_corpus(df).collect()}
    want = {1: "the queue holds rows", 2: "the topic holds", 3: "x", 4: "don't stop", 5: ""}
    assert got == {i: (t, public(t) if t else []) for i, t in want.items()}
