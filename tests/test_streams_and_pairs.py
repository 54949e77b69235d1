"""Streams that resume, and scores of pairs."""

from pyspark.sql import functions as F

from difflode.operators.pairing import geometric_mean, pair_precheck
from difflode.operators.selection import cascade_top_k, neighbour_pairs
from difflode.streaming.ingest import first_deliveries


def test_ingest_goes_on_where_it_stopped(spark, tmp_path):
    src, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    spark.createDataFrame([("a", "x"), ("a", "x"), (None, "n")], "k string, v string").coalesce(1).write.parquet(src)
    assert [tuple(r) for r in first_deliveries(spark, src, "k", ["v"], out, state).collect()] == [("a", "x")]
    spark.createDataFrame([("a", "late"), ("b", "y")], "k string, v string").coalesce(1).write.mode("append").parquet(src)
    assert {tuple(r) for r in first_deliveries(spark, src, "k", ["v"], out, state).collect()} == {("a", "x"), ("b", "y")}


def test_geometric_mean(spark):
    r = spark.range(1).select(geometric_mean(F.lit(0.5), F.lit(0.5)), geometric_mean(F.lit(0.0), F.lit(1.0)), geometric_mean(F.lit(None).cast("double"), F.lit(1.0))).first()
    assert abs(r[0] - 0.5) < 1e-12 and r[1] == 0.0


def test_precheck_conflicts(spark):
    rows = [("feat", "fix", ["a"], ["a"], ["m"], ["m"], ["x"], ["y"]), ("feat", "feat", ["a"], ["b"], ["m"], ["n"], ["x"], ["y"]), ("feat", "fix", ["a"], ["b"], ["m"], ["n"], ["x"], ["x"]), ("feat", "fix", ["a"], ["b"], ["m"], ["n"], ["x"], ["y"]), ("feat", None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "type_a string, type_b string, files_a array<string>, files_b array<string>, modules_a array<string>, modules_b array<string>, words_a array<string>, words_b array<string>")
    got = [(r["first_conflict"], r["weight"]) for r in pair_precheck(df).collect()]
    assert got[:4] == [("shared_file", 0.0), ("same_type", 0.0), ("same_words", 0.0), ("none", 1.0)]
    assert got[4] == ("same_words", 0.0)


def test_neighbour_pairs_are_linear(spark):
    df = spark.createDataFrame([("hot", i) for i in range(50)] + [(None, 99)], "g string, k int")
    p = neighbour_pairs(df, "g", "k", 3, "s", [])
    assert p.count() == 49 + 48 + 47 and p.where("key_a = key_b").count() == 0


def test_cascade_fills_levels_in_order_and_never_from_the_own_repository(spark):
    pool = spark.createDataFrame([(f"e{i}", "r1" if i < 6 else "r2", float(i), "t", "u" if i == 7 else "w") for i in range(9)], "example_id string, repo string, score double, broad string, exact string")
    q = spark.createDataFrame([("q", "r1", "t", "u"), ("n", None, None, None)], "query_id string, repo string, broad string, exact string")
    got = [(r["query_id"], r["example_id"], r["level"], r["rank"]) for r in cascade_top_k(q, pool, ["exact", "broad"], 3).orderBy("rank").collect()]
    assert got == [("q", "e7", 0, 1), ("q", "e8", 1, 2), ("q", "e6", 1, 3)]
