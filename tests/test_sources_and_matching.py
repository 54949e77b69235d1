"""Readers, writers, fingerprints, upserts, matching and retrieval on small inputs."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from difflode.operators.matching import best_matching, pack_groups
from difflode.operators.retrieval import tfidf_top_k
from difflode.sources import files


def test_csv_header_and_line_breaks(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('﻿"sha", repo\na,"line one\nline two"\nb,  \n', encoding="utf-8")
    got = [tuple(r) for r in files.read_csv(spark, str(p), ("sha", "repo")).collect()]
    assert got == [("a", "line one\nline two"), ("b", None)]
    with pytest.raises(ValueError, match="subject"):
        files.read_csv(spark, str(p), ("subject",))


def test_json_lines_modes_and_round_trip(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    df = files.read_json_lines(spark, str(p), "a long", strict=False)
    assert sorted(((r["a"], r["_corrupt_record"]) for r in df.collect()), key=str) == [(1, None), (2, None), (None, "not json")]
    with pytest.raises(Exception):
        files.read_json_lines(spark, str(p), "a long").collect()
    files.write_rows(spark.createDataFrame([(1, "x")], "b int, a string"), str(tmp_path / "o.csv"), "csv")
    assert files.read_any(spark, str(tmp_path / "o.csv")).columns == ["a", "b"]
    with pytest.raises(ValueError):
        files.read_any(spark, "x.sqlite")


def test_pointer_fingerprint_upsert(spark):
    df = spark.createDataFrame([("version https://git-lfs.x/v1",), ("text",), (None,)], "t string")
    assert [r[0] for r in df.select(files.is_pointer(F.col("t"))).collect()] == [True, False, False]
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert files.fingerprint(a, ["k", "v"]) == files.fingerprint(a.orderBy(F.desc("k")).repartition(3), ["v", "k"])
    assert files.fingerprint(a, ["k"]) != files.fingerprint(a.union(a), ["k"])
    got = {tuple(r) for r in files.upsert(a, spark.createDataFrame([(2, "z"), (None, "n")], "k int, v string"), ["k"]).collect()}
    assert got == {(1, "x"), (2, "z"), (None, "n")}


def test_best_matching_against_all_permutations():
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (2, 4), (4, 2), (5, 5), (3, 6)):
        g = rng.integers(0, 9, (n, m)).astype(float)
        got = best_matching(g)
        assert len({r for r, _ in got}) == len({c for _, c in got}) == min(n, m)
        big = g if n <= m else g.T
        want = max(sum(big[i, p[i]] for i in range(len(big))) for p in itertools.permutations(range(big.shape[1]), len(big)))
        assert sum(g[r, c] for r, c in got) == want


def test_pack_groups_places_everything(spark):
    w = spark.createDataFrame([(f"r{i}", (i * 7) % 13 + 1) for i in range(60)], "g string, w int")
    got = pack_groups(w, "g", "w", [("a", 0.75), ("b", 0.25)], "s").join(w, "g").groupBy("split").agg(F.sum("w").alias("w")).collect()
    sums = {r["split"]: r["w"] for r in got}
    assert abs(sums["a"] / sum(sums.values()) - 0.75) < 0.02


def test_tfidf_guard_and_ties(spark):
    pool = spark.createDataFrame([("p1", "red apple tree", "g1"), ("p2", "red apple tree", "g2"), ("p3", "blue sky", "g2"), ("p4", None, "g3")], "id string, text string, g string")
    q = spark.createDataFrame([("q1", "Red apple, tree", "g1"), ("q2", "", "g9")], "id string, text string, g string")
    got = [(r["query_id"], r["example_id"], r["rank"], r["cosine"]) for r in tfidf_top_k(q, pool, 2, "g").collect()]
    assert got == [("q1", "p2", 1, 1.0)]
    assert [r["example_id"] for r in tfidf_top_k(q, pool, 2).orderBy("rank").collect()] == ["p1", "p2"]


def test_discover_merge_and_picks(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.csv").write_text("k\n1\n")
    (tmp_path / "y_old.csv").write_text("k\n1\n")
    (tmp_path / "z.txt").write_text("k")
    assert [r["path"].rsplit("/", 1)[-1] for r in files.discover(spark, str(tmp_path), "*.csv", ("_old",)).collect()] == ["x.csv"]
    (tmp_path / "1.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "2.jsonl").write_text('{"a": 3}\n')
    assert files.merge_json_lines(spark, [str(tmp_path / "1.jsonl"), str(tmp_path / "2.jsonl")], "a long", str(tmp_path / "out.jsonl")) == 3
    (tmp_path / "arr.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert sorted(r["a"] for r in files.read_any(spark, str(tmp_path / "arr.json")).collect()) == [1, 2]
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), (None, 1, "n")], "k string, t int, v string")
    want = spark.createDataFrame([("a",), ("a",), (None,), ("c",)], "k string")
    assert [tuple(r) for r in files.wanted_last(rows, want, "k", [F.col("t")]).collect()] == [("a", 2, "y")]
    got = {r["k"]: r["v"] for r in files.merge_first([rows.where("k = 'a' and t = 1"), rows.where("k is not null and t > 0 and v != 'y'")], ["k"]).collect()}
    assert got == {"a": "x", "b": "z"}


def test_average_link_against_plain_merging(spark):
    from difflode.operators.clusters import average_link, merge

    rng = np.random.default_rng(6)
    for n, k in ((1, 1), (5, 2), (9, 3)):
        sim = np.triu(rng.random((n, n)), 1)
        sim = sim + sim.T
        groups = [[i] for i in range(n)]
        while len(groups) > k:
            best = max(((np.mean([sim[a, b] for a in groups[i] for b in groups[j]]), -i, -j) for i in range(len(groups)) for j in range(i + 1, len(groups))))
            groups[-best[1]] += groups.pop(-best[2])
        of = merge(sim, k)
        assert {frozenset(np.flatnonzero(of == c).tolist()) for c in set(of.tolist())} == {frozenset(g) for g in groups}
    rows = [("s1", "u1", "a/x.py", "src", ["f"], 0), ("s1", "u2", "a/x.py", "src", ["f"], 0), ("s1", "u3", "b/y.md", "doc", None, 1), ("s2", "u4", None, None, [], 0), (None, "u5", "a", None, [], 0)]
    df = spark.createDataFrame(rows, "sample_id string, unit_id string, file_path string, file_role string, identifiers array<string>, gold int")
    assert {tuple(r) for r in average_link(df, "sample_id", "unit_id", "gold").collect()} == {("s1", 3, 2, 1.0), ("s2", 1, 1, 0.0)}
