"""Small cases with known answers for the general operators."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from difflode.functions.repo import canonical_repo, canonical_split
from difflode.functions.scores import wilson
from difflode.functions.words import jaccard, word_set
from difflode.operators.components import connected_components
from difflode.operators.joins import interval_overlaps
from difflode.operators.metrics import cluster_metrics, cohen_kappa, ranking_metrics
from difflode.operators.ranking import rank_within
from difflode.operators.shortids import resolve_short_ids
from difflode.operators.audit import hash_chain, verify_chain


@pytest.mark.parametrize("raw, want", [
    ("Owner/Name", "owner/name"), (" owner/name ", "owner/name"), ("owner__name", "owner/name"), ("https://git.example/Owner/Name.git", "owner/name"),
    ("git@git.example:owner/name.git", "owner/name"), ("git.example/owner/Name", "owner/name"), ("owner/name/", "owner/name"), ("", None), ("  ", None), (None, None),
])
def test_canonical_repo(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "r string").select(canonical_repo(F.col("r"))).first()[0] == want


def test_canonical_split(spark):
    df = spark.createDataFrame([("Train",), ("training",), ("final-test",), ("val",), (" ",), (None,)], "s string")
    assert [r[0] for r in df.select(canonical_split(F.col("s"))).collect()] == ["train", "train", "test", "dev", None, None]


def test_words(spark):
    df = spark.createDataFrame([("Übergröße x_1, X_1!", "x_1 übergröße"), (None, "")], "a string, b string")
    r = df.select(F.size(word_set(F.col("a"))), jaccard(word_set(F.col("a")), word_set(F.col("b")))).collect()
    assert (r[0][0], r[0][1]) == (2, 1.0) and (r[1][0], r[1][1]) == (0, None)


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(300):03d}", f"n{rng.randrange(300):03d}") for _ in range(220)] + [("hub", f"n{i:03d}") for i in range(0, 300, 7)] + [(None, "n001")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u and v and u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in parent}
    least = {}
    for x, r in want.items():
        least[r] = min(least.get(r, x), x)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {x: least[r] for x, r in want.items()}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_short_ids(spark):
    full, other = "ab" * 20, "cd" * 20
    df = spark.createDataFrame([(full,), (full[:12],), (full[:7],), (other,), ("ffff",), (None,), ("",)], "i string")
    got = {(r["id"], r["full_id"]) for r in resolve_short_ids(df, "i").collect()}
    assert {(full, full), (full[:12], full), (full[:7], full), (other, other), ("ffff", "ffff")} <= got
    assert all(f.startswith(i) for i, f in got)


def test_rank_within_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else rng.choice(["a", None]), rng.random(), i) for i in range(600)]
    got = {r["i"]: r["rank"] for r in rank_within(spark.createDataFrame(rows, "g string, s double, i int"), ["g"], [F.col("s").desc(), F.col("i").asc()]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            want[r[2]] = k
    assert got == want


def test_wilson_known(spark):
    low, high = wilson(F.lit(288), F.lit(300))
    r = spark.range(1).select(low, high).first()
    assert (round(r[0], 4), round(r[1], 4)) == (0.9314, 0.9770)


def test_kappa_known(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (1, 1, 0), (1, 0, 0)], "g int, a int, b int")
    r = cohen_kappa(df, "a", "b", ["g"]).first()
    assert (r["agreement"], r["kappa"]) == (0.75, 0.5)


def test_ranking_known(spark):
    df = spark.createDataFrame([(0, .1), (0, .3), (1, .7), (1, .9)], "y int, s double")
    r = ranking_metrics(df, "y", "s").first()
    assert (r["auroc"], r["auprc"], r["accuracy"]) == (1.0, 1.0, 1.0)


def test_pair_f1_known(spark):
    df = spark.createDataFrame([("s", "i1", "x"), ("s", "i1", "x"), ("s", "i2", "x")], "s string, g string, p string")
    assert cluster_metrics(df, "s", "g", "p").first()["pair_f1"] == 0.5


def test_intervals(spark):
    df = spark.createDataFrame([("f", "a", 1, 5), ("f", "b", 8, 2), ("f", "c", 200, 400), ("f", "d", 590, 3), ("g", "e", 1, 5)], "f string, k string, s long, n long")
    got = {(r["a"], r["b"]) for r in interval_overlaps(df, ["f"], "k", "s", "n", 3).collect()}
    assert got == {("a", "b"), ("c", "d")}


def test_chain_detects_a_change(spark):
    df = spark.createDataFrame([("g", i, f"v{i}") for i in range(5)], "g string, o int, v string")
    ok = hash_chain(df, "g", "o", "v")
    assert verify_chain(ok, "g", "o", "v", "link").count() == 0
    bad = ok.withColumn("v", F.when(F.col("o") == 2, "x").otherwise(F.col("v")))
    assert {r["o"] for r in verify_chain(bad, "g", "o", "v", "link").collect()} == {2, 3, 4}


def test_running_sums_and_medians(spark):
    from difflode.operators.ranking import running_sums
    from difflode.operators.stats import kmeans_bounds, medians

    rng = random.Random(3)
    rows = [(i, rng.choice([1.0, 2.0, 3.0, rng.random()]), "hot" if i % 3 else rng.choice(["a", None])) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, v double, g string")
    got = {r["i"]: r["s"] for r in running_sums(df, [F.col("v").desc(), F.col("i").asc()], {"s": "v"}).collect()}
    at = 0.0
    for i, v, _ in sorted(rows, key=lambda r: (-r[1], r[0])):
        at += v
        assert abs(got[i] - at) < 1e-9
    import statistics

    med = {r["g"]: (r["n"], r["median"]) for r in medians(df, "g", "v").collect()}
    assert med == {g: (len(x), statistics.median(x)) for g in ("hot", "a", None) for x in [[r[1] for r in rows if r[2] == g]]}
    two = spark.createDataFrame([(0.1,), (0.12,), (0.9,), (0.88,), (None,), (float("nan"),)], "v double")
    assert [(r["centre"], r["upper_bound"]) for r in kmeans_bounds(two, "v", 2).orderBy("centre_no").collect()] == [(0.11, 0.5), (0.89, None)]
    assert kmeans_bounds(two.where("false"), "v", 2).count() == 0


def test_bounded_pairs_are_the_first_of_all(spark):
    from difflode.functions.scores import stable_key
    from difflode.operators.selection import bounded_pairs

    df = spark.createDataFrame([("hot", i) for i in range(40)] + [("small", i) for i in range(100, 104)] + [("one", 7), (None, 8)], "g string, k int")
    order = {g: [r["k"] for r in df.where(F.col("g") == g).orderBy(stable_key("s", F.col("k")), "k").collect()] for g in ("hot", "small", "one")}
    want = {(g, n, a, b) for g, ks in order.items() for n, (a, b) in enumerate(itertools.combinations(ks, 2)) if n < 50}
    assert {tuple(r) for r in bounded_pairs(df, "g", "k", 50, "s", []).collect()} == want


def test_strict_threshold_and_fallback(spark):
    from difflode.operators.metrics import threshold_by_precision

    df = spark.createDataFrame([(1, .9), (1, .8), (0, .7), (1, .6), (0, .5)], "y int, s double")
    assert tuple(threshold_by_precision(df, "y", "s", 0.9).first()) == (0.8, 1, 1, False)
    assert tuple(threshold_by_precision(df, "y", "s", 0.7).first()) == (0.8, 1, 1, False)
    bad = spark.createDataFrame([(0, .9), (1, .8), (0, .7)], "y int, s double")
    assert tuple(threshold_by_precision(bad, "y", "s", 0.9, 0.4).first()) == (0.4, None, 2, True)


def test_hunk_overlaps_of_planted_hunks(spark):
    from difflode.functions.changes import hunk_range

    rows = [("s", "f", "a", "@@ -10,5 +10,6 @@"), ("s", "f", "b", "@@ -17 +18 @@"), ("s", "f", "c", "@@ -40,2 +41,2 @@"), ("s", "g", "d", "@@ -10,5 +10,6 @@"), ("s", "f", "e", None)]
    df = spark.createDataFrame(rows, "s string, f string, u string, p string")
    u = df.select("s", "f", "u", *[c.alias(n) for n, c in hunk_range(F.col("p")).items()]).where("old_start is not null")
    assert {(r["a"], r["b"]) for r in interval_overlaps(u, ["s", "f"], "u", "old_start", "old_len", 3).collect()} == {("a", "b")}


def test_tfidf_counts_the_query_as_a_document(spark):
    import math

    from difflode.operators.retrieval import tfidf_top_k

    pool = {"p1": "red apple", "p2": "red sky"}
    q = "red apple pie"
    df = {w: sum(w in t.split() for t in [*pool.values(), q]) for w in (q + " sky").split()}
    vec = lambda t: {w: t.split().count(w) * math.log((1 + 3) / (1 + df[w])) + 1 for w in t.split()}
    cos = lambda a, b: sum(a.get(w, 0) * x for w, x in b.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    got = {r["example_id"]: r["cosine"] for r in tfidf_top_k(spark.createDataFrame([("q", q)], "id string, text string"), spark.createDataFrame(list(pool.items()), "id string, text string"), 5).collect()}
    assert got == {k: round(cos(vec(q), vec(t)), 6) for k, t in pool.items()}


def test_platt_line_is_where_the_gradient_vanishes(spark):
    import math

    from difflode.operators.scoring import fit_platt

    rng = random.Random(9)
    rows = [(int(rng.random() < 1 / (1 + math.exp(-(2 * x - 0.5)))), 1 / (1 + math.exp(-x))) for x in (rng.gauss(0, 1.5) for _ in range(800))]
    n, a, b = fit_platt(spark.createDataFrame(rows + [(None, 0.5), (1, float("nan"))], "y int, p double"), "p", "y").first()
    err = [(1 / (1 + math.exp(-(a * math.log(p / (1 - p)) + b))) - y, math.log(p / (1 - p))) for y, p in rows]
    assert n == 800 and abs(sum(e for e, _ in err) / 800) < 1e-5 and abs(sum(e * x for e, x in err) / 800 + 1e-3 * a) < 1e-5
    assert abs(a - 2) < 0.4 and tuple(fit_platt(spark.createDataFrame([(1, 0.5)], "y int, p double"), "p", "y").first()) == (1, 1.0, 0.0)
