"""The pN_ queries over a data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from difflode.functions.repo import canonical_repo
from difflode.llm import caps, handwritten, nearcopies, overlap, packing, secrets, splits, subjects, tokens
from difflode.plans.lineage import cut
from difflode.sources.tables import table


def _families(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "edit_units").select("sample_id", F.explode("source_atomic_commit_ids").alias("commit_id"))
    return splits.families(table(spark, d, "attribution_samples").select("sample_id", "repo"), units)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _families(spark, d)


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(cut(_families(spark, d)), table(spark, d, "split_plan")).select("sample_id", "family_key", "split")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "commit_log").select(F.lit("message").alias("field"), F.col("log_id").alias("id"), F.col("message").alias("text"))
    pool = table(spark, d, "commit_pool")
    return log.union(pool.select(F.lit("commit_message"), "row_id", "commit_message")).union(pool.select(F.lit("git_diff"), "row_id", "git_diff"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nearcopies.near_copies(_texts(spark, d), "field", "id", "text").select("field", "id_a", "id_b")


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return nearcopies.near_groups(_texts(spark, d), "field", "id", "text")


def _pools(spark: SparkSession, d: str) -> DataFrame:
    few = table(spark, d, "fewshot_pool").select(
        F.lit("fewshot_pool").alias("pool"), F.col("example_id").alias("record_id"), canonical_repo(F.col("repo")).alias("contributor"), F.col("quality_score").alias("score")
    )
    cand = table(spark, d, "candidates").select(
        F.lit("candidates").alias("pool"), F.col("sha").alias("record_id"), canonical_repo(F.col("repo")).alias("contributor"), F.col("score")
    )
    return few.union(cand)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return caps.cap_records(_pools(spark, d), table(spark, d, "contributor_caps")).where("dropped").select("pool", "record_id")


def p4_share(spark: SparkSession, d: str) -> DataFrame:
    """Rows kept and dropped, and the largest repository's rows, by pool when no repository may have more than a twentieth of a pool's output."""
    parts = []
    for pool in ("fewshot_pool", "candidates"):
        none = spark.createDataFrame([], "pool string, max_rows int")
        x = caps.cap_records(_pools(spark, d).where(F.col("pool") == pool), none, max_share=0.05).groupBy("pool", "contributor").agg(F.sum((~F.col("dropped")).cast("long")).alias("k"), F.sum(F.col("dropped").cast("long")).alias("d"))
        parts.append(x.groupBy("pool").agg(F.sum("k").alias("kept"), F.sum("d").alias("dropped"), F.max(F.when(F.col("contributor").isNotNull(), F.col("k"))).alias("largest")))
    return parts[0].union(parts[1])


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlap.split_overlaps(table(spark, d, "attribution_samples"), table(spark, d, "fewshot_pool"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select("origin", F.least("id_train", "id_eval").alias("id_a"), F.greatest("id_train", "id_eval").alias("id_b")).distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(_overlaps(spark, d), table(spark, d, "attribution_samples"), table(spark, d, "fewshot_pool"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Samples and examples with similar texts on the other side of the splits: their class and its number of links, copies not paired."""
    return overlap.overlap_groups(overlap.split_texts(table(spark, d, "attribution_samples"), table(spark, d, "fewshot_pool")), "origin", "id", "text")


def _files(spark: SparkSession, d: str) -> DataFrame:
    """The files of both tables with the evidence of their patches; a pool diff is taken apart once, and its parts meet the listed files by path."""
    units = table(spark, d, "edit_units").select(F.lit("edit_units").alias("origin"), F.col("unit_id").alias("record_id"), "file_path", "repo", handwritten.content_evidence(F.col("patch_text")).alias("evidence"))
    pool = table(spark, d, "commit_pool").where("row_id is not null")
    parts = pool.select("row_id", F.explode(handwritten.sections(F.col("git_diff"))).alias("part"))
    parts = parts.select("row_id", F.explode(handwritten.section_paths(F.col("part"))).alias("file_path"), handwritten.content_evidence(F.col("part")).alias("evidence"))
    parts = parts.groupBy("row_id", "file_path").agg(F.max("evidence").alias("evidence"))
    listed = pool.select("row_id", "repo", F.explode(handwritten.listed_files(F.col("changed_files"))).alias("file_path")).distinct()
    found = listed.join(parts, ["row_id", "file_path"], "left")
    return units.union(found.select(F.lit("commit_pool"), F.col("row_id").cast("string"), "file_path", "repo", "evidence"))


def _attributes(spark: SparkSession, d: str) -> DataFrame:
    """``repo, path, text`` of the attribute files: edit units of such a file, and its sections in the diffs of the pool."""
    def kept(patch):
        return F.array_join(F.transform(F.filter(F.split(patch, "\n"), lambda x: x.rlike("^[+ ]")), lambda x: F.substring(x, F.lit(2), F.length(x))), "\n")

    name = r"(?:^|/)\.gitattributes$"
    units = table(spark, d, "edit_units").where(F.col("file_path").rlike(name)).select("repo", F.col("file_path").alias("path"), kept(F.col("patch_text")).alias("text"))
    pool = table(spark, d, "commit_pool").where(F.col("git_diff").contains(".gitattributes")).select("repo", F.explode(handwritten.sections(F.col("git_diff"))).alias("part"))
    pool = pool.select("repo", F.regexp_extract(F.substring_index("part", "\n", 1), r" \"?b/([^\"\r]+)\"?\r?$", 1).alias("path"), kept(F.col("part")).alias("text"))
    return units.union(pool.where(F.col("path").rlike(name)))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(_files(spark, d), _attributes(spark, d))


def p3_decided(spark: SparkSession, d: str) -> DataFrame:
    """Files that nobody wrote by hand, by table and by what decided so."""
    return handwritten.decided(_files(spark, d), _attributes(spark, d)).groupBy("origin", "decided_by").agg(F.count(F.lit(1)).alias("files"))


def _patches(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "edit_units").select(F.lit("edit_units").alias("origin"), F.col("unit_id").alias("record_id"), F.col("patch_text").alias("text"))
    pool = table(spark, d, "commit_pool").select(F.lit("commit_pool"), F.col("row_id").cast("string"), F.col("git_diff"))
    return units.union(pool).where("record_id is not null and text is not null")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    words = secrets.dictionary(table(spark, d, "edit_units"), "identifiers")
    return secrets.find_secrets(_patches(spark, d), ["origin", "record_id"], "text", words).distinct()


def p6_masked(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct patch and diff, its credentials masked."""
    words = secrets.dictionary(table(spark, d, "edit_units"), "identifiers")
    return secrets.find_secrets(_patches(spark, d), ["origin", "record_id"], "text", words, masked=True).distinct()


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def p7_offsets(spark: SparkSession, d: str) -> DataFrame:
    """The ids with the start of every pre-token and its number of ids."""
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text", offsets=True)


def _packed(spark: SparkSession, d: str) -> DataFrame:
    plans = table(spark, d, "pack_plan")
    names = sorted(r[0] for r in plans.select("tokenizer").distinct().collect() if r[0])
    counts = tokens.count_tokens(table(spark, d, "documents").where("doc_id is not null"), "doc_id", "text", names)
    long = counts.select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("tokenizer"), F.col(f"n_{n}").alias("tokens"), F.col(f"loss_{n}").alias("loss")) for n in names])).alias("s")).select("doc_id", "s.*")
    return packing.pack(packing.split_items(long, plans))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p8_summary(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_summary(_packed(spark, d), table(spark, d, "pack_plan"))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_areas(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subject_areas"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "area")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(_subjects(spark, d), table(spark, d, "documents"), table(spark, d, "subject_areas"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit() and callable(v)}
