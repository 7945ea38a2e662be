"""Nearest vectors, clusters and mixtures."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from strandline.llm import clusters, mixing, nearest, queries


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def table_of(spark, ids, x, extra=None):
    pdf = pd.DataFrame({"id": ids, "embedding": [v.tolist() if v is not None else None for v in x], "ingested_at": 1})
    for k, v in (extra or {}).items():
        pdf[k] = v
    return spark.createDataFrame(pdf, "id string, embedding array<float>, ingested_at int" + "".join(f", {k} int" for k in extra or {}))


def recall(spark, x, ids, k=5):
    rows = nearest.nearest(nearest.vector_table(table_of(spark, ids, x)), k).collect()
    s = unit(x) @ unit(x).T
    np.fill_diagonal(s, -9)
    floor = np.sort(s, axis=1)[:, -k]
    at = {i: n for n, i in enumerate(ids)}
    assert all(abs(s[at[r["id"]], at[r["nid"]]] - r["sim"]) < 1e-5 for r in rows)
    return sum(s[at[r["id"]], at[r["nid"]]] >= floor[at[r["id"]]] - 1e-6 for r in rows) / (k * len(ids))


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = unit(rng.normal(size=(60, 64)))
    x = (unit(centres[rng.integers(0, 60, 5000)] + rng.normal(size=(5000, 64)) * 0.09) * rng.uniform(0.5, 2, (5000, 1))).astype(np.float32)
    assert recall(spark, x, [f"v{i:05d}" for i in range(len(x))]) >= 0.9


def test_recall_on_the_tables(spark, data):
    rows = nearest.vector_table(queries.table(spark, data, "ms_docs").select("id", "embedding", "ingested_at")).select("id", "vec").collect()
    x = np.stack([np.frombuffer(r["vec"], np.float32) for r in rows])
    assert recall(spark, x, [r["id"] for r in rows]) >= 0.99


def test_copies_bad_vectors_and_ties(spark):
    rng = np.random.default_rng(6)
    x = [v for v in rng.normal(size=(30, 64)).astype(np.float32)]
    ids = [f"a{i:02d}" for i in range(30)]
    x += [x[0] * 2] * 40  # a hot group of copies, of another length
    ids += [f"c{i:02d}" for i in range(40)]
    bad = np.full(64, np.nan, np.float32), np.zeros(64, np.float32), np.ones(32, np.float32), None
    x += list(bad)
    ids += ["b0", "b1", "b2", "b3"]
    x += [x[3]]
    ids += ["a03"]  # a repeated row
    got = {}
    for r in nearest.nearest(nearest.vector_table(table_of(spark, ids, x, {"uid": 1, "sim": 2})), 5).collect():
        got.setdefault(r["id"], []).append((round(r["sim"], 5), r["nid"]))
    assert len(got) == 70 and all(len(v) == 5 for v in got.values()) and not any(i.startswith("b") for i in got)
    group = sorted(["a00", *(f"c{i:02d}" for i in range(40))])
    for i in ("a00", "c00", "c05", "c39"):
        assert sorted(n for s, n in got[i]) == [g for g in group if g != i][:5] and all(s == 1.0 for s, _ in got[i])
    s = unit(np.array(x[:30])) @ unit(np.array(x[:30])).T
    near = {i for i in range(1, 30) if s[i, 0] >= np.sort(np.delete(s[i], i))[-1]}
    assert all(sorted(got[f"a{i:02d}"], key=lambda t: (-t[0], t[1]))[0][1] == "a00" for i in near)


def test_many_copies_join_no_more_rows_than_come_out(spark, monkeypatch):
    """Neighbours of a set of copies are cut to the nearest before every copy gets them; queries are scored in parts."""
    joined, plain = [], nearest.join_checked

    def counting(left, right, on, how, width):
        out = plain(left, right, on, how, width)
        joined.append(out.count())
        return out

    monkeypatch.setattr(nearest, "join_checked", counting)
    monkeypatch.setattr(nearest, "SCAN_ROWS", 3, raising=False)
    x = np.random.default_rng(8).normal(size=(8, 64)).astype(np.float32)
    ids = [f"v{i:04d}" for i in range(1200)]
    rows = nearest.nearest(nearest.vector_table(table_of(spark, ids, [x[i % 4] for i in range(1200 - 4)] + list(x[4:]))), 5).collect()
    assert max(joined) <= 2400
    got = {}
    for r in rows:
        got.setdefault(r["id"], []).append((-r["sim"], r["nid"]))
    assert len(got) == 1200 and all(len(v) == 5 for v in got.values())
    for i in (0, 4, 5, 999):
        assert [n for _, n in sorted(got[ids[i]])] == [n for n in ids[i % 4 : 1196 : 4] if n != ids[i]][:5]


def test_small_and_empty_tables(spark):
    x = np.eye(64, dtype=np.float32)
    assert nearest.nearest(nearest.vector_table(table_of(spark, ["a"], [x[0]])), 5).count() == 0
    assert nearest.nearest(nearest.vector_table(table_of(spark, ["a", "b"], [x[0], x[0]])), 5).count() == 2
    assert nearest.nearest(nearest.vector_table(table_of(spark, ["a"], [x[0]]).limit(0)), 5).count() == 0


def test_pairs_on_the_tables(spark, data):
    rows = nearest.vector_table(queries.table(spark, data, "ms_docs").select("id", "embedding", "ingested_at").unionByName(queries.table(spark, data, "raptor_sac").select("id", "embedding", "ingested_at"))).select("id", "vec").collect()
    ids, x = [r["id"] for r in rows], np.stack([np.frombuffer(r["vec"], np.float32) for r in rows])
    s = x @ x.T
    np.fill_diagonal(s, -9)
    want = {tuple(sorted((ids[i], ids[j]))) for i in range(len(ids)) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.95}
    assert {tuple(r) for r in queries.p5_found(spark, data).collect()} == want


def test_exact_search_and_sub_lists_and_slices(spark, data):
    """Few lists, so that they are cut into sub-lists, and small slices; the exact search against numpy, groups and ties included."""
    rng = np.random.default_rng(12)
    centres = unit(rng.normal(size=(20, 64)))
    x = unit(centres[rng.integers(0, 20, 6000)] + rng.normal(size=(6000, 64)) * 0.1).astype(np.float32)
    x = np.concatenate([x, x[:30] * rng.uniform(0.5, 3, (30, 1)).astype(np.float32)])  # equal up to rounding
    ids, level = [f"v{i:05d}" for i in range(len(x))], [i % 2 for i in range(len(x))]
    vectors = nearest.vector_table(table_of(spark, ids, x, {"level": level}), group_col="level")
    exact = {}
    for r in nearest.exact_nearest(vectors, 5).collect():
        exact.setdefault(r["id"], []).append((-round(r["sim"], 5), r["nid"]))
    s = unit(x.astype(np.float64)) @ unit(x.astype(np.float64)).T
    s[np.not_equal.outer(level, level)] = -9
    np.fill_diagonal(s, -9)
    assert len(exact) == len(x) and all(np.allclose(-np.sort(-s[i])[:5], [-a for a, _ in sorted(exact[ids[i]])], atol=2e-5) for i in range(len(x)))
    found = nearest.nearest(vectors, 5, list_rows=50, max_lists=2, slice_rows=700).collect()
    got = {}
    for r in found:
        got.setdefault(r["id"], set()).add(r["nid"])
    hit = sum(n in got.get(i, ()) or -a <= s[ids.index(i)][[ids.index(m) for m in got.get(i, ())]].min() + 1e-5 for i in ids[:300] for a, n in exact[i])
    assert hit >= 0.9 * 5 * 300 and all(len(v) == 5 for v in got.values())


# ---- problem 4


def planted(rng, sizes, noise):
    d = unit(rng.normal(size=(len(sizes), 64)))
    rows, label = [], []
    for c, n in enumerate(sizes):
        for _ in range(n):
            side = rng.normal(size=64)
            side -= (side @ d[c]) * d[c]
            cos = rng.uniform(0.76, 0.85)
            rows.append(cos * d[c] + np.sqrt(1 - cos**2) * side / np.linalg.norm(side))
            label.append(c)
    rows += list(unit(rng.normal(size=(noise, 64))))
    return (np.array(rows) * rng.uniform(0.5, 2, (len(rows), 1))).astype(np.float32), label + [-1] * noise


def test_planted_clusters_come_back(spark):
    x, label = planted(np.random.default_rng(8), [300, 120, 60, 30, 15, 8], 60)
    ids = [f"r{i:04d}" for i in range(len(x))]
    level = [0 if c % 2 == 0 else 1 if c >= 0 else 0 for c in label]
    bad = table_of(spark, ["z0", "z1"], [np.zeros(64, np.float32), None], {"level": [0, 0]})
    df = table_of(spark, ids, x, {"level": level}).unionByName(bad)
    members = clusters.cluster_rows(df)
    got = {r["id"]: r["cluster_id"] for r in members.collect()}
    by = {}
    for i, c in zip(ids, label):
        by.setdefault(c, []).append(got.get(i))
    assert all(x is None for x in by[-1])
    for c in range(6):
        assert len(set(by[c])) == 1 and by[c][0] is not None
    assert len({by[c][0] for c in range(6)}) == 6
    report = clusters.cluster_report(members).orderBy(F.col("size").desc()).collect()
    assert [r["size"] for r in report] == [300, 120, 60, 30, 15, 8] and all(len(r["typical_ids"]) == 5 for r in report)
    pairs = spark.createDataFrame([(ids[0], ids[1]), (ids[0], ids[301]), (ids[0], ids[-1]), ("q", "z0"), (ids[0], ids[1])], "id_a string, id_b string")
    assert [tuple(r) for r in clusters.same_cluster(pairs, members).collect()] == [(ids[0], ids[1])]


def test_copies_and_tight_and_small_clusters(spark):
    rng = np.random.default_rng(9)
    x, label = planted(rng, [40, 30], 40)
    d = unit(rng.normal(size=(2, 64)))
    copies = list(x[:1] * rng.uniform(0.5, 2, (400, 1)))  # of a member
    near = list(unit(unit(x[-1:]) + rng.normal(size=(30, 64)) * 0.01))  # near-copies of noise
    tight = list(unit(d[0] + rng.normal(size=(20, 64)) * 0.03))  # mean cosine about 0.97, none near-identical
    two = [unit(0.8 * d[1] + 0.6 * unit(r - (r @ d[1]) * d[1])) for r in rng.normal(size=(2, 64))]
    x = [np.float32(v) for v in [*x, *copies, *near, *tight, *two]]
    label = label + [0] * 400 + [-1] * 30 + [2] * 20 + [3] * 2
    ids = [f"r{i:04d}" for i in range(len(x))]
    level = [1 if c == 3 else 0 for c in label]
    got = {r["id"]: r["cluster_id"] for r in clusters.cluster_rows(table_of(spark, ids, x, {"level": level})).collect()}
    by = {}
    for i, c in zip(ids, label):
        by.setdefault(c, set()).add(got.get(i))
    assert by[-1] == {None}
    assert all(len(by[c]) == 1 and None not in by[c] for c in range(4)) and len({*by[0], *by[1], *by[2], *by[3]}) == 4


def test_clusters_of_nothing(spark):
    df = table_of(spark, ["a", "b"], [np.eye(64, dtype=np.float32)[0], np.eye(64, dtype=np.float32)[1]], {"level": [0, 0]})
    assert clusters.cluster_rows(df).count() == 0 and clusters.cluster_rows(df.limit(0)).count() == 0


# ---- problem 7


def test_mixture_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "word " * int(rng.integers(1, 40)), "big") for i in range(400)] + [(1000 + i, "a b c d", "small") for i in range(10)] + [(2000 + i, t, s) for i, (t, s) in enumerate([(None, "big"), ("", "big"), ("x", None), ("x", "other"), ("tiny", "tiny")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("weight", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.01, 4), ("tiny", 0.4, 3), ("none", 0.05, 2), ("zero", 0.0, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mixture(docs, targets, buckets=16)
    pdf = mixed.toPandas()
    total = int(pdf["n_tokens"].sum())
    assert set(pdf["source"]) == {"big", "small", "tiny"} and len(pdf) == 413
    used = (pdf["n_tokens"] * pdf["copies"]).groupby(pdf["source"]).sum()
    assert abs(used["big"] - 0.5 * total) <= 40
    small = pdf[pdf["source"] == "small"]
    assert small["copies"].max() <= 4 and abs(used["small"] - min(0.01 * total, 4 * small["n_tokens"].sum())) <= 8
    report = {r["source"]: r for r in mixing.mixture_report(mixed, targets).collect()}
    assert {s for s, r in report.items() if r["short"]} == {"tiny", "none"} and abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9
    one = mixing.mixture(docs, targets, buckets=1).toPandas()
    assert pdf.sort_values("doc_id")["copies"].tolist() == one.sort_values("doc_id")["copies"].tolist()
    assert mixing.mixture(docs.limit(0), targets).count() == 0


def test_quality_raises_the_chance(spark):
    docs = spark.createDataFrame([(i, "one two three four", "s") for i in range(2000)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("s", 0.3, 1)], "source string, target_share double, max_repeats int")
    weight = F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.2)
    got = mixing.mixture(docs, targets, quality=weight).where("copies = 1").toPandas()
    assert abs(len(got) - 600) <= 1 and (got["doc_id"] % 2 == 0).mean() > 0.7


def test_scan_scores_by_one_product_of_matrices(monkeypatch):
    rng = np.random.default_rng(2)
    books = rng.normal(size=(nearest.PARTS, nearest.CODEWORDS, 2)).astype(np.float32) * 0.1
    model = nearest.Quantizer(unit(rng.normal(size=(1, 64))).astype(np.float32), np.ones(1, np.float32), books)
    code = rng.integers(0, 256, (800, nearest.PARTS)).astype(np.uint8)
    q = unit(rng.normal(size=(4000, 64))).astype(np.float32)
    uid, zero = np.arange(4000), np.zeros(4000, np.int32)
    lists = [nearest._Codes(0, model.centroids[0], np.arange(5000, 5800), np.zeros(800, np.int32), code)]
    decoded, plain = [], nearest.Quantizer.decode
    monkeypatch.setattr(nearest.Quantizer, "decode", lambda self, number, code: (decoded.append(len(code)), plain(self, number, code))[1])
    score, _ = nearest._scan(q, uid, zero, np.zeros((4000, 1), np.int32), lists, model, 16, 8)
    assert decoded == [800]  # not a lookup of every part for every pair
    best = np.sort(q @ plain(model, 0, code).T, axis=1)[:, -16:]
    assert np.allclose(best, np.sort(score, axis=1), atol=1e-5)


def test_copies_do_not_thin_the_sample(spark, monkeypatch):
    seen, plain = [], nearest.fit
    monkeypatch.setattr(nearest, "fit", lambda vectors, n, *more: (seen.append((n, vectors.count())), plain(vectors, n, *more))[1])
    x = unit(np.random.default_rng(4).normal(size=(300, 64)))
    rows = nearest.nearest(nearest.vector_table(table_of(spark, [f"v{i:05d}" for i in range(3000)], [x[i % 300] for i in range(3000)])), 5)
    assert rows.count() == 15000 and seen == [(300, 300)]
