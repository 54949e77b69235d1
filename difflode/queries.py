"""Queries of the general operators over a data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from difflode.functions import changes as ch
from difflode.functions import scores as sc
from difflode.functions.repo import canonical_repo, canonical_sha, canonical_split
from difflode.operators import audit, joins, matching, pairing, retrieval, selection, stats
from difflode.operators import metrics as mt
from difflode.catalog import parts
from difflode.oracle import oracle_sql as _own_sql
from difflode.sources.tables import table as T
from difflode.functions.words import words
from difflode.streaming.ingest import first_deliveries
from difflode.streaming.windows import windowed_counts

r6 = mt.r6
_STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _one(s: SparkSession, d: str, name: str, key: str, cols: tuple[str | Column, ...]) -> DataFrame:
    """One row a record of a table that is delivered repeatedly: the key and what is asked for, computed before the shuffle by key."""
    return T(s, d, name).select(key, *[c for c in cols if not isinstance(c, str) or c != key]).dropDuplicates([key])


def _log(s: SparkSession, d: str, *cols: str | Column) -> DataFrame:
    return _one(s, d, "commit_log", "log_id", cols)


def _pool(s: SparkSession, d: str, *cols: str | Column) -> DataFrame:
    return _one(s, d, "commit_pool", "row_id", cols)


def _units(s: SparkSession, d: str, *cols: str | Column) -> DataFrame:
    return _one(s, d, "edit_units", "unit_id", cols)


def _samples(s: SparkSession, d: str, *cols: str | Column) -> DataFrame:
    return _one(s, d, "attribution_samples", "sample_id", tuple(canonical_split(F.col("split")).alias("split") if isinstance(c, str) and c == "split" else c for c in cols))


def _few(s: SparkSession, d: str, *cols: str | Column) -> DataFrame:
    return _one(s, d, "fewshot_pool", "example_id", cols)


def _cand(s: SparkSession, d: str, *cols: str | Column) -> DataFrame:
    return _one(s, d, "candidates", "sha", cols)


def _repo() -> Column:
    return canonical_repo(F.col("repo")).alias("repo")


def _clean(score: str) -> Column:
    return F.when(~F.isnan(score), F.col(score)).alias("score")


def message_features(s, d):
    """Counts and markers of every commit message."""
    f = ch.message_features(F.col("message"))
    return _log(s, d, *[c.alias(n) for n, c in f.items()])


def diff_features(s, d):
    """Size and spread of every pool diff."""
    f = ch.diff_counts(F.col("git_diff"))
    x = _pool(s, d, *[c.alias(n) for n, c in f.items()])
    changed = F.filter("per_file", lambda c: c > 0)
    return x.select("row_id", "n_files", "n_hunks", "added", "deleted", "changed", r6(sc.entropy_of(changed)).alias("entropy"), r6(sc.gini_of(changed)).alias("gini"),
                    r6(F.coalesce(F.try_divide(F.array_max("per_file").cast("double"), "changed"), F.lit(0.0))).alias("dominant"))


def role_confusion(s, d):
    """Stored role against the role of the path ladder."""
    x = _units(s, d, F.coalesce(F.nullif(F.trim("file_role"), F.lit("")), F.lit("missing")).alias("stored"), ch.path_role(F.col("file_path")).alias("derived"))
    return x.groupBy("stored", "derived").agg(F.count(F.lit(1)).alias("n"))


def module_spread(s, d):
    """Files and units of each first folder."""
    return _units(s, d, "file_path").where("file_path is not null").groupBy(ch.module_of(F.col("file_path")).alias("module")).agg(F.count(F.lit(1)).alias("units"), F.count_distinct("file_path").alias("files"))


def repo_identity(s, d):
    """Every spelling of a repository with its canonical name and form."""
    raw = F.col("repo")
    form = (F.when(raw.isNull() | (F.trim(raw) == ""), "blank").when(raw.rlike("^[a-z]+://"), "address").when(raw.rlike("^[^/]+@[^/]+:"), "ssh").when(raw.rlike("__"), "joined").when(raw.rlike("^[^/]+/[^/]+/[^/]+$"), "host").otherwise("slug"))
    return _log(s, d, "repo").groupBy(raw.alias("spelling"), canonical_repo(raw).alias("repo"), form.alias("form")).agg(F.count(F.lit(1)).alias("n"))


def type_prevalence(s, d):
    """z-score of each commit type's share over the types."""
    return stats.prevalence_z(_pool(s, d, "type"), "type")


def repo_stats(s, d):
    """Mean and deviation of file counts by repository, and the distance of the mean from all rows in deviations."""
    return stats.group_stats(_pool(s, d, _repo(), "file_count"), "repo", "file_count")


def length_protocol(s, d):
    """Half-even index quantiles of subject lengths by type."""
    return mt.index_quantiles(_pool(s, d, "type", F.length("subject").cast("bigint").alias("v")).where("type is not null"), "type", "v", [0.1, 0.5, 0.85, 0.9])


def robust_reference(s, d):
    """Median and median absolute deviation of message scores by form of the message."""
    return stats.median_mad(_log(s, d, "message_score", F.when(F.col("message").rlike("\n"), "long").otherwise("short").alias("g")), "g", "message_score")


def _votes(s, d):
    lab = T(s, d, "subject_labels").select("doc_id", "area", "annotator_id").distinct()
    two = lab.groupBy("doc_id").agg(F.min("annotator_id").alias("a"), F.max("annotator_id").alias("b")).where("a < b")
    areas = T(s, d, "subject_areas").select("area")
    have = lab.join(two, "doc_id").groupBy("doc_id", "area").agg(F.max((F.col("annotator_id") == F.col("a")).cast("int")).alias("x"), F.max((F.col("annotator_id") == F.col("b")).cast("int")).alias("y"))
    grid = two.select("doc_id", F.explode(F.array(*[F.lit(r[0]) for r in areas.orderBy("area").collect()])).alias("area"))
    return grid.join(have, ["doc_id", "area"], "left").select("doc_id", "area", F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))


def annotator_agreement(s, d):
    """Agreement and kappa of two annotators for each area."""
    return mt.cohen_kappa(_votes(s, d), "x", "y", ["area"])


def annotator_confusion(s, d):
    """Votes of both, one or neither annotator."""
    return _votes(s, d).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


def count_agreement(s, d):
    """Quadratic-weighted kappa of the stated and the gold number of intents."""
    return mt.weighted_kappa(_samples(s, d, "gold_count", "k"), "gold_count", "k")


def count_quality(s, d):
    """Accuracy and error of the stated number of intents by split."""
    return mt.count_metrics(_samples(s, d, "gold_count", "k", "split"), "gold_count", "k", "split")


def verified_precision(s, d):
    """Share of verified examples by pair of types, with Wilson interval."""
    return mt.precision_report(_few(s, d, "type_pair", "verified_multi_intent"), "type_pair", F.col("verified_multi_intent") == 1)


def score_ranking(s, d):
    """How well the quality score ranks eligible examples."""
    return mt.ranking_metrics(_few(s, d, "fewshot_eligible", "quality_score"), "fewshot_eligible", "quality_score")


def score_reliability(s, d):
    """Mean score and rate of eligible examples in ten bins."""
    return mt.reliability(_few(s, d, "fewshot_eligible", "quality_score"), "fewshot_eligible", "quality_score")


def precision_threshold(s, d):
    """Highest threshold of the quality score at which precision reaches 0.8."""
    return mt.threshold_by_precision(_few(s, d, "fewshot_eligible", "quality_score"), "fewshot_eligible", "quality_score", 0.8)


def selective_risk(s, d):
    """Share of ineligible examples among the surest tenths."""
    return mt.risk_coverage(_few(s, d, "quality_score", (1 - F.col("fewshot_eligible")).alias("wrong")), "wrong", "quality_score")


def intent_clusters(s, d):
    """Clustering metrics of files against gold intents, for each sample."""
    return mt.cluster_metrics(_units(s, d, "sample_id", "gold_intent_id", "file_path").where("sample_id is not null"), "sample_id", "gold_intent_id", "file_path")


def file_baseline(s, d):
    """Mean clustering metrics of the file baseline by split."""
    m = intent_clusters(s, d).join(_samples(s, d, "split"), "sample_id")
    return m.groupBy("split").agg(F.count(F.lit(1)).alias("samples"), r6(F.avg("pair_f1")).alias("pair_f1"), r6(F.avg("bcubed_f1")).alias("bcubed_f1"))


def score_tiers(s, d):
    """Tiers of messages by calibrated score: strictly above 0.6 is A, above 0.4 is B, the rest C."""
    p = sc.platt(F.col("message_score"), 1.2, -0.1)
    return _log(s, d, "message_score").where("message_score is not null and not isnan(message_score)").groupBy(F.when(p > 0.6, "A").when(p > 0.4, "B").otherwise("C").alias("tier")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(p)).alias("mean_p"), r6(F.avg(sc.bernoulli_entropy(p))).alias("mean_entropy"))


def calibrated_scores(s, d):
    """Quality scores through isotonic knots."""
    p = sc.isotonic_predict(F.col("quality_score"), [(0.1, 0.05), (0.4, 0.3), (0.7, 0.8), (0.9, 0.95)])
    return _few(s, d, "quality_score").where(F.col("quality_score").isNotNull() & ~F.isnan("quality_score")).select("example_id", r6(p).alias("p"))


def quota_sample(s, d):
    """Five records of each language in hash order."""
    return selection.quota_sample(_pool(s, d, F.coalesce("language", F.lit("unknown")).alias("language")), "language", "row_id", 5, "13").select("row_id", "language", "rank")


def proportional_sample(s, d):
    """A tenth of each language in hash order, at least one."""
    return selection.proportional_sample(_pool(s, d, F.coalesce("language", F.lit("unknown")).alias("language")), "language", "row_id", 0.1, "7").select("row_id", "language", "rank")


def round_robin_sample(s, d):
    """Thirty records, one of each type in turn."""
    return selection.round_robin(_pool(s, d, F.coalesce("type", F.lit("unknown")).alias("type")), "type", "row_id", 30, "5").select("position", "row_id", "type")


def score_bands(s, d):
    """Five bands of the quality score within each pair of types."""
    return selection.score_bands(_few(s, d, "type_pair", "quality_score"), "type_pair", "example_id", "quality_score", 5).select("example_id", "type_pair", "band")


def hash_splits(s, d):
    """Stateless split of repositories, and its rows."""
    x = _log(s, d, _repo()).where("repo is not null")
    return x.groupBy(selection.hash_split(F.col("repo"), [("train", 0.8), ("dev", 0.1), ("test", 0.1)], "3").alias("split")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("repo").alias("repos"))


def split_usage(s, d):
    """Samples, repositories and weights of each split."""
    return _samples(s, d, _repo(), "split", "is_multi_intent").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("repo").alias("repos"), F.sum(F.col("is_multi_intent").cast("bigint")).alias("multi"))


def split_repo_overlap(s, d):
    """Repositories that two splits share."""
    return joins.overlap_matrix(_samples(s, d, _repo(), "split"), "split", "repo")


def table_repo_overlap(s, d):
    """Shared repositories and Jaccard of every two tables."""
    names = ["attribution_samples", "candidates", "commit_log", "commit_pool", "fewshot_pool"]
    x = None
    for n in names:
        y = T(s, d, n).select(F.lit(n).alias("t"), canonical_repo(F.col("repo")).alias("repo"))
        x = y if x is None else x.union(y)
    return joins.overlap_matrix(x, "t", "repo")


def first_delivery(s, d):
    """The earliest delivery of each candidate, and how many there were."""
    x = joins.first_wins(T(s, d, "candidates"), ["sha"], [F.col("ingested_at").asc_nulls_last(), F.col("subject").asc_nulls_last()], ["ingested_at"])
    return x.select("sha", F.date_format("ingested_at", _STAMP).alias("arrived"), "deliveries")


def latest_delivery(s, d):
    """The latest delivery of each example (keep last); missing arrival times count as earliest."""
    x = joins.first_wins(T(s, d, "fewshot_pool"), ["example_id"], [F.col("updated_at").desc_nulls_last()], ["updated_at"])
    return x.select("example_id", F.date_format("updated_at", _STAMP).alias("arrived"), "deliveries")


def best_evidence(s, d):
    """For each repository the candidate with the highest score, ties to the smaller id."""
    x = _cand(s, d, _repo(), _clean("score")).where("repo is not null")
    return x.groupBy("repo").agg(F.min_by("sha", F.struct(F.col("score").isNull().alias("n"), (-F.col("score")).alias("s"), F.col("sha"))).alias("sha"), F.max("score").alias("score"))


def subject_overlap(s, d):
    """Normalised subjects that occur in several tables."""
    v = ch.normalized_subject(F.col("subject")).alias("v")
    x = _few(s, d, v).select(F.lit("f").alias("t"), "v").union(_cand(s, d, v).select(F.lit("c"), "v")).union(_log(s, d, v).select(F.lit("l"), "v"))
    g = x.where("v is not null and v != ''").groupBy("v").agg(F.count_distinct("t").alias("tables"), F.count(F.lit(1)).alias("rows"))
    return g.groupBy("tables").agg(F.count(F.lit(1)).alias("subjects"), F.sum("rows").alias("rows"))


def reject_ladder(s, d):
    """First failing reason of every candidate."""
    sub, msg = F.coalesce(F.trim("subject"), F.lit("")), F.coalesce(F.trim("message"), F.lit(""))
    steps = [("no_repo", canonical_repo(F.col("repo")).isNull()), ("no_subject", sub == ""), ("short_subject", F.length(sub) < 20), ("no_message", msg == ""),
             ("noise", F.lower(sub).rlike("^(merge|revert|wip|fixup|bump)")), ("no_score", F.col("score").isNull() | F.isnan("score"))]
    return joins.ladder(T(s, d, "candidates"), steps).select("sha", "reason").dropDuplicates(["sha"]).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def reason_counts(s, d):
    """How often each reason of the message score occurs, with its mean score."""
    x = _log(s, d, "message_score", F.array_sort(F.array_distinct("message_reasons")).alias("r"))
    return x.select(F.explode("r").alias("reason"), "message_score").groupBy("reason").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.when(~F.isnan("message_score"), F.col("message_score")))).alias("mean_score"))


def known_exclusions(s, d):
    """Candidates left after removing the known revisions and then the repositories of the examples, and how many each took."""
    few = _few(s, d, "sha", "repo")
    known = few.select(canonical_sha(F.col("sha")).alias("k"))
    repos = few.select(canonical_repo(F.col("repo")).alias("k"))
    return joins.exclusion_counts(_cand(s, d, _repo()).select(canonical_sha(F.col("sha")).alias("sha"), "repo"), [("sha", known), ("repo", repos)])


def status_matrix(s, d):
    """Quality against message status; missing ones are unknown."""
    u = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("UNKNOWN"))
    return _few(s, d, "quality_status", "message_status").groupBy(u(F.col("quality_status")).alias("quality"), u(F.col("message_status")).alias("message")).agg(F.count(F.lit(1)).alias("n"))


def split_divergence(s, d):
    """Total variation distance of the source kinds of every two splits."""
    return stats.tvd(_samples(s, d, "split", "source_kind").where("split is not null"), "split", "source_kind")


def coverage_curve(s, d):
    """Share of samples with at most k gold intents, by split."""
    return stats.coverage_curve(_samples(s, d, "split", "gold_count").where("split is not null and gold_count is not null"), "split", "gold_count")


def yield_table(s, d):
    """Counts by type and language, by each alone, and in total."""
    return _pool(s, d, F.coalesce("type", F.lit("unknown")).alias("type"), F.coalesce("language", F.lit("unknown")).alias("language")).cube("type", "language").agg(F.count(F.lit(1)).alias("n"))


def label_shortfall(s, d):
    """Rows of each type and language against a minimum of twenty, zero-filled."""
    x = _pool(s, d, "type", "language").where("type is not null and language is not null")
    grid = x.select("type").distinct().join(x.select("language").distinct(), F.lit(True))
    n = x.groupBy("type", "language").agg(F.count(F.lit(1)).alias("n"))
    c = F.coalesce("n", F.lit(0))
    return grid.join(n, ["type", "language"], "left").select("type", "language", c.alias("n"), F.greatest(F.lit(0), 20 - c).alias("short"))


def hunk_overlaps(s, d):
    """Pairs of hunks of a sample's file whose ranges come within three lines."""
    u = _units(s, d, "sample_id", "file_path", *[c.alias(n) for n, c in ch.hunk_range(F.col("patch_text")).items()]).where("old_start is not null")
    return joins.interval_overlaps(u, ["sample_id", "file_path"], "unit_id", "old_start", "old_len", 3)


def delivery_chain(s, d):
    """Hash chain over the records of each repository in order of their id: links, and a digest over all."""
    x = _log(s, d, _repo(), F.lower("sha").alias("sha")).where("repo is not null and sha is not null")
    return audit.hash_chain(x, "repo", "log_id", "sha").groupBy("repo").agg(F.count(F.lit(1)).alias("links"), F.min("link").alias("least"), F.max("link").alias("greatest"))


def integrity_counters(s, d):
    """Referential counters between units and samples."""
    return audit.reference_counters(_units(s, d, "sample_id", "gold_intent_id"), _samples(s, d, F.map_keys("gold_unit_to_intent").alias("units")))


def document_slices(s, d):
    """Overlapping slices of documents."""
    n = F.coalesce(F.col("n_chars"), F.lit(0))
    slices = [("short", n < 300), ("long", n > 3000), ("code", F.coalesce(F.col("text").contains("```"), F.lit(False))), ("list", F.coalesce(F.col("text").contains("\n- "), F.lit(False))), ("labelled_en", F.coalesce(F.col("lang") == "en", F.lit(False))), ("all", F.lit(True))]
    x = T(s, d, "documents").select("doc_id", n.alias("n"), F.explode(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in slices]), lambda v: v.isNotNull())).alias("slice"))
    return x.groupBy("slice").agg(F.count(F.lit(1)).alias("docs"), r6(F.avg("n")).alias("mean_chars"))


def neighbour_pairs(s, d):
    """Records paired with their next three in hash order within a repository, if types differ and files do not meet."""
    files = F.array_distinct(F.transform(F.regexp_extract_all(F.col("git_diff"), F.lit(r"diff --git a/(\S+) b/"), 1), lambda x: x))
    x = _pool(s, d, _repo(), "type", files.alias("files")).where("files is not null")
    p = selection.neighbour_pairs(x, "repo", "row_id", 3, "11", ["type", "files"])
    ok = p.where((F.col("type_a") != F.col("type_b")) & ~F.arrays_overlap("files_a", "files_b"))
    return ok.select("repo", F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"), (F.size("files_a") + F.size("files_b")).cast("bigint").alias("files"))


def example_cascade(s, d):
    """Three examples for each sample's commit: same pair and signature, same pair, same raw signature; never of its repository."""
    few = _few(s, d, _repo(), _clean("quality_score"), "type_pair", "type_signature_canonical", "type_signature_raw", "split").withColumn("exact", F.concat_ws("|", "type_pair", "type_signature_raw"))
    q = few.where(canonical_split(F.col("split")).isin("dev", "test")).select(F.col("example_id").alias("query_id"), "repo", "exact", "type_pair", "type_signature_raw")
    return selection.cascade_top_k(q, few.where(canonical_split(F.col("split")) == "train"), ["exact", "type_pair", "type_signature_raw"], 3)


def file_list_check(s, d):
    """Whether the stated number of files is that of the list, by the form of the list."""
    c = F.col("changed_files")
    form = F.when(c.isNull(), "null").when(c.rlike(r"^\s*\["), "json").when(c.contains("|"), "bar").when(c.contains("\n"), "lines").when(c.contains(","), "comma").otherwise("one")
    n = F.when(form == "json", F.size(F.from_json(c, "array<string>"))).otherwise(F.size(F.split(c, r"\s*[|\n,]\s*")))
    return _pool(s, d, "changed_files", "file_count").groupBy(form.alias("form")).agg(F.count(F.lit(1)).alias("n"), F.sum((n == F.col("file_count")).cast("bigint")).alias("agree"), F.max(n).cast("bigint").alias("most"))


def repo_caps(s, d):
    """The three best candidates of each repository, highest score first."""
    x = _cand(s, d, _repo(), _clean("score")).where("repo is not null")
    w = Window.partitionBy("repo").orderBy(F.col("score").desc_nulls_last(), "sha")
    return x.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("repo", "sha", "rank")


def provenance_filter(s, d):
    """Samples all of whose units have exact provenance, and the others by their worst status."""
    order = F.when(F.col("provenance_status") == "exact", 0).when(F.col("provenance_status") == "fuzzy", 1).otherwise(2)
    x = _units(s, d, "sample_id", "provenance_status").where("sample_id is not null").groupBy("sample_id").agg(F.max(order).alias("worst"), F.count(F.lit(1)).alias("units"))
    return x.groupBy(F.element_at(F.array(F.lit("exact"), F.lit("fuzzy"), F.lit("other")), F.col("worst") + 1).alias("worst")).agg(F.count(F.lit(1)).alias("samples"), F.sum("units").alias("units"))


def breaking_changes(s, d):
    """Priority class of commit types, and breaking changes in each."""
    p = F.when(F.lower("type").isin("feat", "fix"), 0).when(F.lower("type").isin("refactor", "perf"), 1).otherwise(2)
    f = ch.message_features(F.col("subject"))
    return _pool(s, d, "type", "subject").groupBy(p.alias("priority")).agg(F.count(F.lit(1)).alias("n"), F.sum(f["is_breaking"].cast("bigint")).alias("breaking"), F.sum(f["multi_marker"].cast("bigint")).alias("multi"))


def score_centres(s, d):
    """Two boundaries of message scores by one-dimensional k-means with three centres."""
    return stats.kmeans_bounds(_log(s, d, "message_score").where("message_score is not null and not isnan(message_score)"), "message_score", 3)


def bootstrap_precision(s, d):
    """Share of verified examples with a repository-cluster bootstrap interval."""
    return stats.cluster_bootstrap(_few(s, d, _repo(), (F.col("verified_multi_intent") == 1).cast("double").alias("x")).where("repo is not null and x is not null"), "repo", "x", 200, 17)


def tfidf_neighbours(s, d):
    """The three nearest training subjects of each evaluation example, never of its repository."""
    x = _few(s, d, F.col("subject").alias("text"), _repo(), canonical_split(F.col("split")).alias("split")).withColumnRenamed("example_id", "id")
    return retrieval.tfidf_top_k(x.where(F.col("split").isin("dev", "test")), x.where("split = 'train'"), 3, "repo")


def matched_accuracy(s, d):
    """Share of units that the best matching of files to gold intents explains, for each sample."""
    return matching.matched_accuracy(_units(s, d, "sample_id", "gold_intent_id", "file_path"), "sample_id", "gold_intent_id", "file_path")


def split_packing(s, d):
    """Repositories of the samples packed whole into splits, and what each split gets."""
    w = _samples(s, d, _repo()).where("repo is not null").groupBy("repo").agg(F.count(F.lit(1)).alias("w"))
    return matching.pack_groups(w, "repo", "w", [("train", 0.8), ("dev", 0.1), ("test", 0.1)], "1").join(w, "repo").groupBy("split").agg(F.count(F.lit(1)).alias("repos"), F.sum("w").alias("n"))


def edit_unit_records(s, d):
    """The hunks of every pool diff: file, place in the file, and added and deleted lines."""
    rest = lambda c: F.slice(c, F.lit(2), F.size(c))
    x = T(s, d, "commit_pool").where("git_diff is not null").select("row_id", F.posexplode(rest(F.split(F.concat(F.lit("\n"), "git_diff"), "\ndiff --git "))).alias("file_no", "part"))
    h = x.select("row_id", "file_no", F.regexp_extract("part", r"^a/(\S+) b/", 1).alias("file_path"), F.posexplode(rest(F.split("part", "\n@@ "))).alias("hunk_no", "hunk"))
    lines = rest(F.split("hunk", "\n"))
    count = lambda sign: F.size(F.filter(lines, lambda v: v.startswith(sign))).cast("bigint")
    return h.select("row_id", "file_no", "file_path", "hunk_no", count("+").alias("added"), count("-").alias("deleted")).dropDuplicates(["row_id", "file_no", "hunk_no"])


def exclusion_reasons(s, d):
    """All reasons to leave a pool commit out; a commit may have several."""
    sub, f = F.lower(F.coalesce("subject", F.lit(""))), ch.diff_counts(F.col("git_diff"))
    rules = [("merge", sub.startswith("merge")), ("revert", sub.startswith("revert")), ("release", sub.rlike("^(release|bump|chore\\(release)")), ("style", F.coalesce(F.lower("type") == "style", F.lit(False))),
             ("no_diff", f["n_files"] == 0), ("tiny", f["changed"] < 3), ("wide", f["n_files"] > 4), ("lock_file", F.coalesce(F.col("changed_files").rlike(r"\.lock|go\.sum|package-lock"), F.lit(False)))]
    x = _pool(s, d, F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules]), lambda v: v.isNotNull()).alias("reasons")).select(F.explode("reasons").alias("reason"))
    return x.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def deliverable(s, d):
    """Examples ready for use by quality and message status, and the first gate that stops the others."""
    x = joins.ladder(_few(s, d, "verified_multi_intent", "fewshot_eligible", "quality_score", "repo", "intent_k"), [("not_verified", F.col("verified_multi_intent") != 1), ("not_eligible", F.col("fewshot_eligible") != 1), ("no_score", F.col("quality_score").isNull() | F.isnan("quality_score")), ("low_score", F.col("quality_score") < 0.5), ("no_repo", canonical_repo(F.col("repo")).isNull())], "ready")
    return x.groupBy("reason", "intent_k").agg(F.count(F.lit(1)).alias("n"))


def diff_duplicates(s, d):
    """Pool diffs that are equal once index and hunk-position lines are dropped: groups by size."""
    keep = F.filter(F.split("git_diff", "\n"), lambda v: ~(v.startswith("index ") | v.startswith("@@ ")))
    g = _pool(s, d, F.when(F.col("git_diff") != "", F.sha2(F.array_join(keep, "\n"), 256)).alias("h")).where("h is not null").groupBy("h").agg(F.count(F.lit(1)).alias("copies"))
    return g.groupBy("copies").agg(F.count(F.lit(1)).alias("groups"))


def disjoint_flags(s, d):
    """Candidates by whether their commit or repository occurs among the pool's sources."""
    pool = _pool(s, d, "sha", "repo")
    shas = pool.select(canonical_sha(F.col("sha")).alias("a")).where("a is not null").distinct()
    repos = pool.select(canonical_repo(F.col("repo")).alias("b")).where("b is not null").distinct()
    x = _cand(s, d, _repo()).select(canonical_sha(F.col("sha")).alias("sha"), "repo")
    x = x.join(shas, F.col("sha") == F.col("a"), "left").join(repos, F.col("repo") == F.col("b"), "left")
    return x.groupBy(F.col("a").isNotNull().alias("sha_known"), F.col("b").isNotNull().alias("repo_known")).agg(F.count(F.lit(1)).alias("n"))


def seed_stability(s, d):
    """Overlap of the quota samples of three seeds."""
    x = None
    for seed in ("1", "2", "3"):
        y = selection.quota_sample(_pool(s, d, F.coalesce("language", F.lit("unknown")).alias("language")), "language", "row_id", 20, seed).select(F.lit(seed).alias("seed"), "row_id")
        x = y if x is None else x.union(y)
    return joins.overlap_matrix(x, "seed", "row_id")


def background_rates(s, d):
    """Units without a gold intent by derived role, clipped ones left out, with denominators."""
    x = _units(s, d, "file_path", "gold_intent_id", "context_clipped").where("not coalesce(context_clipped, false)")
    return x.groupBy(ch.path_role(F.col("file_path")).alias("role")).agg(F.count(F.lit(1)).alias("units"), F.sum(F.col("gold_intent_id").isNull().cast("bigint")).alias("background"), r6(F.avg(F.col("gold_intent_id").isNull().cast("double"))).alias("rate"))


def sample_rates(s, d):
    """Shares with a denominator of their own each, by source kind; null where nothing counts."""
    x = _samples(s, d, "source_kind", "is_multi_intent", "gold_count", "k", "sample_weight")
    return x.groupBy("source_kind").agg(F.count("is_multi_intent").alias("n_multi"), r6(F.avg(F.col("is_multi_intent").cast("double"))).alias("multi_rate"), F.count("gold_count").alias("n_gold"), r6(F.avg((F.col("gold_count") == F.col("k")).cast("double"))).alias("k_agrees"), r6(F.avg(F.when(~F.isnan("sample_weight"), F.col("sample_weight")))).alias("mean_weight"))


def intent_types(s, d):
    """Samples of each intent type, and how many types they have."""
    x = _samples(s, d, F.array_sort(F.array_distinct("intent_types")).alias("t"))
    return x.select(F.explode("t").alias("type"), F.size("t").alias("k")).groupBy("type").agg(F.count(F.lit(1)).alias("samples"), r6(F.avg("k")).alias("mean_types"))


def type_signatures(s, d):
    """Canonical signatures of the pair of types: sorted, without scope, joined by a plus sign."""
    parts = F.array_sort(F.array_distinct(F.transform(F.split(F.lower("type_signature_raw"), r"[+|,/& ]+"), lambda v: F.regexp_replace(v, r"\(.*\)|!", ""))))
    return _few(s, d, "type_signature_raw").where("type_signature_raw is not null").groupBy(F.array_join(F.filter(parts, lambda v: v != ""), "+").alias("signature")).agg(F.count(F.lit(1)).alias("n"))


def masked_subjects(s, d):
    """Subjects with identifiers, numbers and paths masked, and how many share a mask."""
    m = F.regexp_replace(F.regexp_replace(F.regexp_replace("subject", r"[A-Za-z0-9]+(_[A-Za-z0-9]+)+", "ID"), r"[0-9]+", "N"), r"[A-Za-z]+(/[A-Za-z]+)+", "PATH")
    return _log(s, d, m.alias("mask")).where("mask is not null").groupBy("mask").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def shard_plan(s, d):
    """Contiguous shards of a hundred pool records in order of their id: first, last and size."""
    from difflode.operators.ranking import rank_within

    r = rank_within(_pool(s, d, F.lit(0).alias("g")), ["g"], [F.col("row_id").asc()])
    return r.groupBy(F.floor((F.col("rank") - 1) / 100).cast("bigint").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"), F.max("row_id").alias("last"))


def commit_dates(s, d):
    """Commit dates by the form they are written in, and those in ISO form by year."""
    c = F.trim("commit_date")
    form = F.when(c.isNull(), "null").when(c == "", "blank").when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T"), "iso").when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), "day_first_iso").when(c.rlike("^[0-9]{9,}$"), "epoch").when(c.rlike("^[A-Z][a-z]{2},? "), "named").otherwise("other")
    return _log(s, d, "commit_date").groupBy(form.alias("form"), F.when(form == "iso", F.substring(c, 1, 4)).alias("year")).agg(F.count(F.lit(1)).alias("n"))


def difficulty_levels(s, d):
    """Difficulty of samples by intents, files and modules of their units."""
    u = _units(s, d, "sample_id", "file_path", "gold_intent_id").where("sample_id is not null and file_path is not null").groupBy("sample_id").agg(F.count_distinct("file_path").alias("files"), F.count_distinct(ch.module_of(F.col("file_path"))).alias("modules"), F.count_distinct("gold_intent_id").alias("intents"))
    points = (F.col("intents") > 1).cast("int") + (F.col("files") > 2).cast("int") + (F.col("modules") > 2).cast("int")
    return u.groupBy(F.substring(F.lit("ABCD"), points + 1, F.lit(1)).alias("level")).agg(F.count(F.lit(1)).alias("samples"), r6(F.avg("files")).alias("mean_files"))


def message_polarity(s, d):
    """Polarity of the first verb of a subject: adding, removing, changing or none."""
    w = F.lower(F.regexp_extract(F.regexp_replace("subject", r"^[a-z]+(\([^)]*\))?!?: |^\[[^]]*\] |^[a-z]+/[a-z]+: ", ""), r"^([A-Za-z]+)", 1))
    p = F.when(w.isin("add", "create", "introduce", "enable", "load", "mount"), "adds").when(w.isin("remove", "delete", "drop", "stop", "disable", "drain", "expire", "flush"), "removes").when(w.isin("use", "let", "move", "merge", "split", "compact", "prune", "seal"), "changes").otherwise("none")
    return _cand(s, d, "subject", "score").where("subject is not null").groupBy(p.alias("polarity")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.when(~F.isnan("score"), F.col("score")))).alias("mean_score"))


def pair_precheck(s, d):
    """First conflict and weight of records paired with their next two in hash order within a repository."""
    files = F.array_distinct(F.regexp_extract_all(F.col("git_diff"), F.lit(r"diff --git a/(\S+) b/"), 1))
    x = _pool(s, d, _repo(), "type", files.alias("files"), F.array_distinct(words(F.col("subject"))).alias("words")).where("files is not null")
    x = x.withColumn("modules", F.array_distinct(F.transform("files", lambda f: F.when(f.contains("/"), F.substring_index(f, "/", 1)).otherwise("."))))
    p = pairing.pair_precheck(selection.neighbour_pairs(x, "repo", "row_id", 2, "19", ["type", "files", "modules", "words"]))
    return p.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"), "first_conflict", "weight")


def gate_report(s, d):
    """Gates on the example pool: observed rate, threshold and whether it passes."""
    x = _few(s, d, "verified_multi_intent", "fewshot_eligible", "quality_score", "repo")
    ok = ~F.isnan("quality_score")
    a = x.agg(F.avg((F.col("verified_multi_intent") == 1).cast("double")).alias("verified"), F.avg((F.col("fewshot_eligible") == 1).cast("double")).alias("eligible"), F.avg(F.when(ok, F.col("quality_score"))).alias("mean_score"),
              F.avg(canonical_repo(F.col("repo")).isNull().cast("double")).alias("no_repo"), F.avg(F.col("quality_score").isNull().cast("double")).alias("no_score"))
    gates = [("verified", "min", 0.5), ("eligible", "min", 0.5), ("mean_score", "min", 0.4), ("no_repo", "max", 0.05), ("no_score", "max", 0.05)]
    rows = F.array(*[F.struct(F.lit(n).alias("gate"), F.round(F.col(n), 6).alias("observed"), F.lit(t).alias("threshold"), (F.col(n) >= t if k == "min" else F.col(n) <= t).alias("passes")) for n, k, t in gates])
    return a.select(F.explode(rows).alias("r")).select("r.*")


def stream_first_deliveries(s, d):
    """Every candidate's first delivery, by a stream that adds what its table lacks."""
    return first_deliveries(s, f"{d}/candidates.parquet", "sha", ["subject"], order="ingested_at")


def stream_event_windows(s, d):
    """Hourly counts of event types by a stream with a watermark."""
    return windowed_counts(s, d)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries here and in the catalog."""
    out = _own_sql()
    for part in parts():
        out |= part.oracle_sql()
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every public function above by name, and the queries of the catalog."""
    skip = {"queries", "oracle_sql"}
    out = {k: v for k, v in globals().items() if callable(v) and not k.startswith("_") and k not in skip and getattr(v, "__module__", "") == __name__}
    for part in parts():
        out |= part.queries()
    return out
