"""The registered queries on the smallest tables."""

import os

import duckdb
import pytest

from difflode.llm import queries, sql

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name, columns", [
    ("p1_found", ["sample_id", "family_key"]), ("p1_splits", ["sample_id", "family_key", "split"]), ("p2_found", ["field", "id_a", "id_b"]), ("p2_groups", ["field", "id", "class_id", "group_id", "links"]),
    ("p3_found", ["origin", "record_id", "file_path"]), ("p3_decided", ["origin", "decided_by", "files"]), ("p4_found", ["pool", "record_id"]), ("p4_share", ["pool", "kept", "dropped", "largest"]), ("p5_found", ["origin", "id_a", "id_b"]),
    ("p5_groups", ["origin", "id", "is_train", "class_id", "links"]), ("p5_report", ["origin", "split", "repo", "pairs", "eval_records"]), ("p6_found", ["origin", "record_id", "line_no"]), ("p6_masked", ["origin", "record_id", "masked_text", "n"]),
    ("p7_ids", ["doc_id", "ids"]), ("p7_offsets", ["doc_id", "ids", "starts", "sizes"]), ("p8_containers", ["plan_id", "container_id", "doc_id", "part", "start", "tokens"]), ("p8_summary", ["plan_id", "containers", "tokens", "least", "fill"]), ("p9_shares", ["area", "documents", "share"]),
])
def test_columns_rows_and_no_repeats(spark, name, columns):
    df = queries.queries()[name](spark, DATA)
    assert df.columns == columns
    rows = [tuple(str(v) for v in r) for r in df.collect()]
    assert rows and len(rows) == len(set(rows))


def test_p1_splits_keep_families_and_shares(spark):
    got = queries.queries()["p1_splits"](spark, "/root/testdata/sf0.01").toPandas()
    assert got.groupby("family_key")["split"].nunique().max() == 1 and got["sample_id"].is_unique
    # no family but the largest stands against the plan
    share = got["split"].value_counts(normalize=True)
    assert abs(share["train"] - 0.8) < 0.05


def test_p9_finds_rows_on_a_table_with_hundreds_of_labels(spark):
    import pandas as pd

    data = "/root/testdata/sf0.1"
    got = queries.queries()["p9_found"](spark, data)
    assert got.columns == ["doc_id", "area"]
    rows = {tuple(r) for r in got.collect()}
    lab = pd.read_parquet(f"{data}/subject_labels.parquet").dropna().drop_duplicates()
    votes = lab.groupby(["doc_id", "area"]).annotator_id.nunique()
    both = {k for k, n in votes.items() if n >= 2 and k[1] != "none"}
    assert len(both & rows) >= 0.9 * len(both)


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    got, want = queries.queries()[name](spark, DATA).toPandas(), con.sql(sql.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    plain = lambda df: sorted(tuple(str(v) for v in r) for r in df[cols].itertuples(index=False))
    assert plain(got) == plain(want)
