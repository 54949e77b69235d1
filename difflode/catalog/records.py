"""Queries that pick, compare, split and summarise records, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from difflode.functions.changes import normalized_subject
from difflode.functions.repo import canonical_repo, canonical_sha, canonical_split
from difflode.functions.scores import clip_prob, isotonic_predict, stable_key
from difflode.operators.joins import ladder
from difflode.operators.metrics import r6
from difflode.operators.ranking import rank_within, running_sums
from difflode.operators.stats import medians
from difflode.oracle import repo as repo_sql
from difflode.oracle import split as split_sql
from difflode.plans.lineage import cut
from difflode.sources.files import is_pointer
from difflode.sources.tables import table as T

KNOTS = [(0.1, 0.05), (0.4, 0.3), (0.7, 0.8), (0.9, 0.95)]


def _one(s: SparkSession, d: str, name: str, key: str, *cols: str | Column) -> DataFrame:
    return T(s, d, name).select(key, *cols).dropDuplicates([key])


def _repo() -> Column:
    return canonical_repo(F.col("repo")).alias("repo")


def _num(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def wanted_messages(s, d):
    """The last delivered log record of each candidate's revision; a missing arrival counts as earliest, ties go to the larger id."""
    want = T(s, d, "candidates").select(canonical_sha(F.col("sha")).alias("sha")).where("sha is not null").distinct()
    log = T(s, d, "commit_log").select("log_id", canonical_sha(F.col("sha")).alias("sha"), F.coalesce("ingested_at", F.lit("1970-01-01").cast("timestamp_ntz")).alias("at"))
    return log.join(want, "sha", "left_semi").groupBy("sha").agg(F.max_by("log_id", F.struct("at", "log_id")).alias("log_id"))


def recent_records(s, d):
    """Pool records by whether their date can be read and lies within two years of 2025-06-01."""
    day = F.regexp_extract(F.coalesce("commit_date", F.lit("")), r"^\s*([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    state = F.when(day == "", "unread").when(day >= "2023-06-02", "recent").otherwise("old")
    return _one(s, d, "commit_pool", "row_id", state.alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def bridge_rejects(s, d):
    """First reason to keep a pool record out; a revision counts as repeated only if an earlier record of it was kept."""
    b = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    steps = [("no_type", b("type")), ("bad_id", ~F.coalesce(F.lower(F.trim("sha")).rlike("^[0-9a-f]{40}$"), F.lit(False))), ("no_repo", canonical_repo(F.col("repo")).isNull()), ("no_subject", b("subject")), ("no_message", b("commit_message")),
             ("no_diff", b("git_diff")), ("short_diff", F.length("git_diff") < 400), ("pointer", is_pointer(F.col("git_diff")))]
    x = cut(ladder(T(s, d, "commit_pool"), steps, "kept").select("row_id", canonical_sha(F.col("sha")).alias("sha"), "reason").dropDuplicates(["row_id"]))
    first = x.where("reason = 'kept'").groupBy("sha").agg(F.min("row_id").alias("first"))
    y = x.join(first, "sha", "left").select(F.when((F.col("reason") == "kept") & (F.col("row_id") != F.col("first")), "repeated_id").otherwise(F.col("reason")).alias("reason"))
    return y.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def source_classes(s, d):
    """Pool records as accepted, for review or rejected, with the reason; a diff counts as repeated against earlier accepted ones only."""
    body = F.array_join(F.filter(F.split("git_diff", "\n"), lambda v: ~v.startswith("index ")), "\n")
    x = cut(_one(s, d, "commit_pool", "row_id", F.when(F.col("git_diff") != "", F.sha2(body, 256)).alias("h"), _repo(), F.length(F.trim(F.coalesce("commit_message", F.lit("")))).alias("n")))
    r = F.when(F.col("h").isNull(), "no_diff").when(F.col("repo").isNull(), "no_repo").when(F.col("n") < 60, "short_message").otherwise("ok")
    x = x.withColumn("reason", r)
    first = x.where("reason = 'ok'").groupBy("h").agg(F.min("row_id").alias("first"))
    y = x.join(first, "h", "left").withColumn("reason", F.when((F.col("reason") == "ok") & (F.col("row_id") != F.col("first")), "repeated_diff").otherwise(F.col("reason")))
    kind = F.when(F.col("reason") == "ok", "accepted").when(F.col("reason") == "short_message", "review").otherwise("rejected")
    return y.groupBy(kind.alias("class"), "reason").agg(F.count(F.lit(1)).alias("n"))


def threshold_report(s, d):
    """Coverage, precision and recall of eligible examples strictly above three thresholds of the quality score."""
    x = _one(s, d, "fewshot_pool", "example_id", "fewshot_eligible", _num("quality_score").alias("q")).where("q is not null and fewshot_eligible is not null")
    y = x.select(F.explode(F.array(F.lit(0.4), F.lit(0.55), F.lit(0.7))).alias("tau"), "q", "fewshot_eligible")
    on = F.col("q") > F.col("tau")
    g = y.groupBy("tau").agg(F.count(F.lit(1)).alias("n"), F.sum(on.cast("bigint")).alias("selected"), F.sum((on & (F.col("fewshot_eligible") == 1)).cast("bigint")).alias("tp"), F.sum((F.col("fewshot_eligible") == 1).cast("bigint")).alias("pos"))
    return g.select("tau", "selected", r6(F.col("selected") / F.col("n")).alias("coverage"), r6(F.try_divide("tp", "selected")).alias("precision"), r6(F.try_divide("tp", "pos")).alias("recall"))


def rule_against_model(s, d):
    """Precision and recall of a rule (verified) and a model (score above 0.6) against eligibility, and how often either abstains."""
    x = _one(s, d, "fewshot_pool", "example_id", (F.col("fewshot_eligible") == 1).alias("gold"), (F.col("verified_multi_intent") == 1).alias("rule"), (_num("quality_score") > 0.6).alias("model")).where("gold is not null")
    y = x.select("gold", F.explode(F.array(F.struct(F.lit("rule").alias("who"), F.col("rule").alias("says")), F.struct(F.lit("model").alias("who"), F.col("model").alias("says")))).alias("r")).select("gold", "r.*")
    k = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    g = y.groupBy("who").agg(k(F.col("gold") & F.col("says")).alias("tp"), k(F.col("says")).alias("yes"), k(F.col("gold")).alias("pos"), F.avg(F.col("says").isNull().cast("double")).alias("a"))
    return g.select("who", r6(F.try_divide("tp", "yes")).alias("precision"), r6(F.try_divide("tp", "pos")).alias("recall"), r6(F.col("a")).alias("abstains"))


def probability_gap(s, d):
    """Brier score and log-loss of the quality score and of its calibrated form, and what calibration gains."""
    x = _one(s, d, "fewshot_pool", "example_id", F.col("fewshot_eligible").cast("double").alias("t"), _num("quality_score").alias("p")).where("p is not null and t is not null").withColumn("c", isotonic_predict(F.col("p"), KNOTS))
    brier = lambda p: F.avg((F.col(p) - F.col("t")) * (F.col(p) - F.col("t")))
    loss = lambda p: F.avg(-(F.col("t") * F.log(clip_prob(F.col(p))) + (1 - F.col("t")) * F.log(1 - clip_prob(F.col(p)))))
    return x.agg(F.count(F.lit(1)).alias("n"), r6(brier("p")).alias("brier_raw"), r6(brier("c")).alias("brier_calibrated"), r6(brier("p") - brier("c")).alias("brier_gain"), r6(loss("p")).alias("loss_raw"), r6(loss("c")).alias("loss_calibrated"), r6(loss("p") - loss("c")).alias("loss_gain"))


def _strategies(s: SparkSession, d: str) -> DataFrame:
    x = _one(s, d, "fewshot_pool", "example_id", F.coalesce(_num("quality_score"), F.lit(-1.0)).alias("p"), F.coalesce(F.col("verified_multi_intent") == 1, F.lit(False)).alias("rule"), (F.col("fewshot_eligible") == 1).alias("gold")).withColumn("model", F.col("p") > 0.6)
    why = F.array(
        F.struct(F.lit("rule_only").alias("strategy"), F.col("rule").alias("on"), F.when(F.col("rule"), "rule_positive").otherwise("rule_not_positive").alias("reason")),
        F.struct(F.lit("model_only").alias("strategy"), F.col("model").alias("on"), F.when(F.col("model"), "model_above").otherwise("model_not_above").alias("reason")),
        F.struct(F.lit("model_then_rule").alias("strategy"), (F.col("model") & F.col("rule")).alias("on"), F.when(F.col("model") & F.col("rule"), "both_positive").when(F.col("model"), "rule_not_positive").otherwise("model_not_above").alias("reason")),
    )
    y = cut(x.select("example_id", "p", "gold", F.explode(why).alias("w")).select("example_id", "p", "gold", "w.*"))
    ranked = rank_within(y.where("on"), ["strategy"], [F.col("p").desc(), F.col("example_id").asc()]).select("strategy", "example_id", (F.col("rank") <= 25).alias("kept"))
    return y.join(ranked, ["strategy", "example_id"], "left").withColumn("selected", F.coalesce("kept", F.lit(False)))


def selection_strategies(s, d):
    """Examples by strategy and reason; each strategy keeps its 25 most probable, the others are marked as trimmed."""
    reason = F.when(F.col("on") & ~F.col("selected"), F.concat("reason", F.lit("_trimmed"))).otherwise(F.col("reason"))
    return _strategies(s, d).groupBy("strategy", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def strategy_metrics(s, d):
    """Precision, recall, F1 and noise of each strategy's selection against eligibility."""
    k = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    g = _strategies(s, d).where("gold is not null").groupBy("strategy").agg(k(F.col("selected")).alias("n"), k(F.col("selected") & F.col("gold")).alias("tp"), k(F.col("gold")).alias("pos"))
    p, r = F.try_divide("tp", "n"), F.try_divide("tp", "pos")
    return g.select("strategy", "n", r6(p).alias("precision"), r6(r).alias("recall"), r6(F.try_divide(2 * p * r, p + r)).alias("f1"), r6(1 - p).alias("noise"))


def balanced_subset(s, d):
    """The first twenty samples with one intent and the first twenty with two, in order of their id."""
    x = rank_within(_one(s, d, "attribution_samples", "sample_id", "k").where("k in (1, 2)"), ["k"], [F.col("sample_id").asc()])
    return x.where("rank <= 20").select("sample_id", "k", "rank")


def repo_dev_split(s, d):
    """A fifth of the repositories to dev by SHA-1 order, the others to train: repositories and samples."""
    w = cut(_one(s, d, "attribution_samples", "sample_id", _repo()).where("repo is not null").groupBy("repo").agg(F.count(F.lit(1)).alias("w")))
    r = rank_within(w.withColumn("g", F.lit(0)).withColumn("k", F.sha1(F.concat(F.lit("7:"), "repo"))), ["g"], [F.col("k").asc(), F.col("repo").asc()])
    n = w.agg(F.count(F.lit(1)).alias("n"))
    return r.join(n, F.lit(True)).groupBy(F.when(F.col("rank") <= F.floor(F.col("n") * 0.2), "dev").otherwise("train").alias("split")).agg(F.count(F.lit(1)).alias("repos"), F.sum("w").alias("samples"))


def capped_sample(s, d):
    """Sixty samples in SHA-1 order, at most two of a repository."""
    x = _one(s, d, "attribution_samples", "sample_id", _repo()).where("repo is not null").withColumn("k", F.sha1(F.concat(F.lit("11:"), "sample_id")))
    few = rank_within(x, ["repo"], [F.col("k").asc(), F.col("sample_id").asc()]).where("rank <= 2")
    return few.orderBy("k", "sample_id").limit(60).select("sample_id", "repo")


def interleaved_blocks(s, d):
    """Units of each sample dealt round-robin over its intents: how many, and how often neighbours differ in intent.

    Follows from the counts of units by intent: after the second most frequent intent is
    used up, only equal neighbours follow.
    """
    c = _one(s, d, "edit_units", "unit_id", "sample_id", "gold_intent_id").where("sample_id is not null and gold_intent_id is not null").groupBy("sample_id", "gold_intent_id").agg(F.count(F.lit(1)).alias("n"))
    x = c.groupBy("sample_id").agg(F.sum("n").alias("blocks"), F.sort_array(F.collect_list(F.struct("n", F.col("gold_intent_id").alias("i"))), asc=False).alias("a"))
    m1, m2 = F.col("a")[0]["n"], F.coalesce(F.get("a", 1)["n"], F.lit(0))
    last = F.array_max(F.transform(F.filter("a", lambda r: r["n"] >= m2), lambda r: r["i"]))
    same = F.when(F.size("a") == 1, F.col("blocks") - 1).when(m1 > m2, m1 - m2 - 1 + (last == F.col("a")[0]["i"]).cast("int")).otherwise(0)
    return x.select("sample_id", "blocks", (F.col("blocks") - 1 - same).cast("bigint").alias("switches"))


def unit_pair_counts(s, d):
    """Pairs of units of a sample, and how many share file, folder or role; from counts, no pair is formed."""
    u = cut(_one(s, d, "edit_units", "unit_id", "sample_id", "file_path", F.regexp_replace("file_path", r"/?[^/]*$", "").alias("folder"), "file_role").where("sample_id is not null"))
    two = lambda c: F.sum(c * (c - 1) / 2).cast("bigint")
    out = u.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).select("sample_id", (F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("pairs"))
    for col, name in (("file_path", "same_file"), ("folder", "same_folder"), ("file_role", "same_role")):
        p = u.where(F.col(col).isNotNull()).groupBy("sample_id", col).agg(F.count(F.lit(1)).alias("n")).groupBy("sample_id").agg(two(F.col("n")).alias(name))
        out = out.join(p, "sample_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def leakage_keys(s, d):
    """Values of five keys that several splits of the samples share, by key and pair of splits."""
    x = _one(s, d, "attribution_samples", "sample_id", canonical_split(F.col("split")).alias("split"), _repo(), F.sha1(F.trim("diff_text")).alias("diff"), "intent_subjects", "source_kind").where("split is not null")
    pair = lambda name, c: F.struct(F.lit(name).alias("key"), c.alias("value"))
    lists = F.coalesce(F.transform("intent_subjects", lambda v: pair("subject", v)), F.array().cast("array<struct<key:string,value:string>>"))
    own = T(s, d, "edit_units").select("sample_id", F.explode("source_atomic_commit_ids").alias("v")).select("sample_id", F.lit("source_id").alias("key"), canonical_sha(F.col("v")).alias("value"))
    rows = x.select("split", F.explode(F.concat(F.array(pair("repo", F.col("repo")), pair("diff", F.col("diff")), pair("source_kind", F.col("source_kind"))), lists)).alias("p")).select("split", "p.*")
    rows = rows.union(own.join(x.select("sample_id", "split"), "sample_id").select("split", "key", "value")).where("value is not null and value != ''")
    sets = rows.groupBy("key", "value").agg(F.array_sort(F.collect_set("split")).alias("gs")).where("size(gs) > 1")
    pairs = F.flatten(F.transform("gs", lambda a: F.transform(F.filter("gs", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select("key", F.explode(pairs).alias("p")).groupBy("key", "p.a", "p.b").agg(F.count(F.lit(1)).alias("shared"))


def exemplar_exclusions(s, d):
    """Training examples kept out because an evaluation example has their repository, revision or subject, or a candidate their revision; and those left."""
    x = cut(_one(s, d, "fewshot_pool", "example_id", canonical_split(F.col("split")).alias("split"), _repo(), canonical_sha(F.col("sha")).alias("sha"), normalized_subject(F.col("subject")).alias("subject")))
    ev, tr = x.where("split in ('dev', 'test')"), x.where("split = 'train'")
    blocks = [("repo", "repo", ev.select("repo")), ("revision", "sha", ev.select("sha")), ("subject", "subject", ev.select("subject").where("subject != ''")), ("candidate", "sha", T(s, d, "candidates").select(canonical_sha(F.col("sha")).alias("sha")))]
    for name, col, src in blocks:
        k = src.select(F.col(col).alias(f"__{name}")).where(F.col(f"__{name}").isNotNull()).distinct()
        tr = tr.join(k, F.col(col) == F.col(f"__{name}"), "left")
    why = F.filter(F.array(*[F.when(F.col(f"__{n}").isNotNull(), F.lit(n)) for n, _, _ in blocks]), lambda v: v.isNotNull())
    return tr.select(F.explode(F.when(F.size(why) > 0, why).otherwise(F.array(F.lit("kept")))).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def repo_holdout(s, d):
    """Whole repositories in hash order until a fifth of the examples is held out, and a fifth of each label in hash order: examples and positives."""
    x = cut(_one(s, d, "fewshot_pool", "example_id", _repo(), F.col("fewshot_eligible").alias("y")).where("repo is not null and y is not null"))
    w = x.groupBy("repo").agg(F.count(F.lit(1)).alias("w"), F.sum("y").alias("p")).withColumn("k", stable_key("5", F.col("repo")))
    total = w.agg(F.sum("w").alias("total"))
    r = running_sums(w, [F.col("k").asc(), F.col("repo").asc()], {"upto": "w"}).join(total, F.lit(True))
    a = r.groupBy(F.lit("repository").alias("kind"), (F.col("upto") - F.col("w") < 0.2 * F.col("total")).alias("held_out")).agg(F.sum("w").alias("n"), F.sum("p").alias("positives"))
    q = rank_within(x.withColumn("k", stable_key("6", F.col("example_id"))), ["y"], [F.col("k").asc(), F.col("example_id").asc()])
    n = x.groupBy(F.col("y").alias("__y")).agg(F.count(F.lit(1)).alias("__n"))
    b = q.join(n, F.col("y") == F.col("__y")).groupBy(F.lit("label").alias("kind"), (F.col("rank") <= F.floor(F.col("__n") * 0.2)).alias("held_out")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))
    return a.union(b)


def queue_overlap(s, d):
    """Revisions by the set of tables that hold them."""
    x = None
    for n in ("candidates", "commit_log", "commit_pool", "fewshot_pool"):
        y = T(s, d, n).select(F.lit(n).alias("q"), canonical_sha(F.col("sha")).alias("sha"))
        x = y if x is None else x.union(y)
    g = x.where("sha is not null").groupBy("sha").agg(F.array_join(F.array_sort(F.collect_set("q")), "+").alias("tables"))
    return g.groupBy("tables").agg(F.count(F.lit(1)).alias("n"))


def score_summaries(s, d):
    """Number, mean, deviation, least, median and greatest quality score by split."""
    x = cut(_one(s, d, "fewshot_pool", "example_id", canonical_split(F.col("split")).alias("split"), _num("quality_score").alias("q")).where("q is not null"))
    m = medians(x, "split", "q").select(F.col("split").alias("__s"), "median")
    g = x.groupBy("split").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("q")).alias("mean"), r6(F.stddev_pop("q")).alias("sd"), F.min("q").alias("least"), F.max("q").alias("most"))
    return g.join(m, F.col("split").eqNullSafe(F.col("__s"))).select("split", "n", "mean", "sd", "least", r6(F.col("median")).alias("median"), "most")


def slot_collapse(s, d):
    """Samples by number of intents with units: how many, the share whose largest intent has four fifths of the units, and the mean entropy (base 2)."""
    c = _one(s, d, "edit_units", "unit_id", "sample_id", "gold_intent_id").where("sample_id is not null and gold_intent_id is not null").groupBy("sample_id", "gold_intent_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    x = c.groupBy("sample_id").agg(F.count(F.lit(1)).alias("slots"), F.max("n").alias("m"), F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("h"))
    return x.groupBy("slots").agg(F.count(F.lit(1)).alias("samples"), r6(F.avg((F.col("m") >= 0.8 * F.col("t")).cast("double"))).alias("collapsed"), r6(F.avg(F.log2("t") - F.col("h") / F.col("t"))).alias("entropy"))


def trivial_clusters(s, d):
    """Pairwise F1 of putting all units of a sample into one cluster, averaged by number of units; samples of one unit count as 0."""
    c = _one(s, d, "edit_units", "unit_id", "sample_id", "gold_intent_id").where("sample_id is not null and gold_intent_id is not null").groupBy("sample_id", "gold_intent_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    two = lambda v: v * (v - 1) / 2
    x = c.groupBy("sample_id").agg(F.sum("n").alias("t"), F.sum(two(F.col("n"))).alias("g"))
    f = F.coalesce(F.try_divide(2 * F.col("g"), F.col("g") + two(F.col("t"))), F.lit(0.0))
    return x.groupBy(F.least(F.col("t"), F.lit(10.0)).cast("int").alias("units")).agg(F.count(F.lit(1)).alias("samples"), r6(F.avg(f)).alias("pair_f1"))


def review_errors(s, d):
    """Errors of few-shot records by kind; a record may have several."""
    rules = [("no_repo", canonical_repo(F.col("repo")).isNull()), ("bad_id", ~F.coalesce(F.lower(F.trim("sha")).rlike("^[0-9a-f]{40}$"), F.lit(False))), ("no_subject", F.coalesce(F.trim("subject"), F.lit("")) == ""), ("k_against_pair", F.coalesce(F.col("intent_k") != F.size(F.split("type_pair", r"\+")), F.lit(True))),
             ("eligible_but_unverified", F.coalesce((F.col("fewshot_eligible") == 1) & (F.col("verified_multi_intent") != 1), F.lit(False))), ("no_score", F.col("quality_score").isNull() | F.isnan("quality_score")), ("signature_not_sorted", F.coalesce(F.array_join(F.array_sort(F.split("type_signature_canonical", r"\+")), "+") != F.col("type_signature_canonical"), F.lit(False)))]
    x = _one(s, d, "fewshot_pool", "example_id", F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules]), lambda v: v.isNotNull()).alias("errors"))
    return x.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def batch_plan(s, d):
    """Samples in hash order in batches of 50, of 100, and the rest: sizes and first sample."""
    x = _one(s, d, "attribution_samples", "sample_id", F.lit(0).alias("g")).withColumn("k", stable_key("21", F.col("sample_id")))
    r = rank_within(x, ["g"], [F.col("k").asc(), F.col("sample_id").asc()])
    return r.groupBy(F.when(F.col("rank") <= 50, 1).when(F.col("rank") <= 150, 2).otherwise(3).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.min_by("sample_id", "rank").alias("first"))


def blind_order(s, d):
    """The candidates of each repository in hash order under the letters A to D, for blinded review."""
    x = _one(s, d, "candidates", "sha", _repo()).where("repo is not null").withColumn("k", stable_key("31", F.col("sha")))
    r = rank_within(x, ["repo"], [F.col("k").asc(), F.col("sha").asc()]).where("rank <= 4")
    return r.select("repo", F.substring(F.lit("ABCD"), F.col("rank").cast("int"), F.lit(1)).alias("letter"), "sha")


def shared_identifiers(s, d):
    """Identifiers that several units of a sample change, by language: contexts, units in them, and the most units of one."""
    x = _one(s, d, "edit_units", "unit_id", "sample_id", F.coalesce("language", F.lit("unknown")).alias("language"), F.array_distinct("identifiers").alias("ids")).where("sample_id is not null")
    c = x.select("sample_id", "language", F.explode("ids").alias("id")).where("id is not null").groupBy("sample_id", "language", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return c.groupBy("language").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("units"), F.max("n").alias("most"))


def masked_patches(s, d):
    """Patches with identifiers of several words, numbers and strings masked: patches, changed ones and distinct masks by language."""
    m = F.regexp_replace(F.regexp_replace(F.regexp_replace("patch_text", r'"[^"\n]*"', "S"), r"[A-Za-z0-9]+(_[A-Za-z0-9]+)+", "ID"), r"[0-9]+", "N")
    x = _one(s, d, "edit_units", "unit_id", F.coalesce("language", F.lit("unknown")).alias("language"), F.md5(m).alias("mask"), (m != F.col("patch_text")).alias("changed")).where("mask is not null")
    return x.groupBy("language").agg(F.count(F.lit(1)).alias("patches"), F.sum(F.col("changed").cast("bigint")).alias("changed"), F.count_distinct("mask").alias("masks"))


def table_registry(s, d):
    """Rows, records and rows without a key of every record table."""
    keys = {"attribution_samples": "sample_id", "candidates": "sha", "commit_log": "log_id", "commit_pool": "row_id", "documents": "doc_id", "edit_units": "unit_id", "fewshot_pool": "example_id"}
    out = None
    for n, k in keys.items():
        x = T(s, d, n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows"), F.count_distinct(k).alias("records"), F.sum(F.col(k).isNull().cast("bigint")).alias("no_key"))
        out = x if out is None else out.union(x)
    return out


def mined_order(s, d):
    """Candidates that pass the gates in their final order: score, length of the subject, id; first forty."""
    x = _one(s, d, "candidates", "sha", _repo(), F.length(F.trim(F.coalesce("subject", F.lit("")))).alias("n"), _num("score").alias("score")).where("repo is not null and n >= 20 and score is not null").withColumn("g", F.lit(0))
    return rank_within(x, ["g"], [F.col("score").desc(), F.col("n").asc(), F.col("sha").asc()]).where("rank <= 40").select("sha", "rank")


def best_candidates(s, d):
    """One candidate of each repository: those that pass before others, then the least penalty, then the smaller id."""
    bad = [F.length(F.coalesce("subject", F.lit(""))) > 72, F.coalesce(F.col("subject").rlike("(?i)^(merge|revert|wip)"), F.lit(False)), F.coalesce(F.trim("message"), F.lit("")) == "", F.coalesce(F.col("subject").endswith("."), F.lit(False))]
    penalty = sum((b.cast("int") for b in bad), F.lit(0))
    x = _one(s, d, "candidates", "sha", _repo(), (bad[1] | bad[2]).alias("rejected"), penalty.alias("penalty")).where("repo is not null")
    return x.groupBy("repo").agg(F.min(F.struct("rejected", "penalty", "sha")).alias("b")).select("repo", "b.sha", "b.penalty", (~F.col("b.rejected")).alias("accepted"))


def calibration_error(s, d):
    """Expected and maximal calibration error of the quality score over ten bins closed at both ends, so that inner bounds count twice."""
    x = _one(s, d, "fewshot_pool", "example_id", F.col("fewshot_eligible").cast("double").alias("t"), _num("quality_score").alias("p")).where("p is not null and t is not null")
    bins = F.filter(F.array(*[F.when((F.col("p") >= i / 10) & (F.col("p") <= (i + 1) / 10), F.lit(i)) for i in range(10)]), lambda v: v.isNotNull())
    g = x.select("p", "t", F.explode(bins).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("p") - F.avg("t")).alias("gap"))
    total = x.agg(F.count(F.lit(1)).alias("total"))
    return g.join(total, F.lit(True)).agg(r6(F.sum(F.col("n") * F.col("gap") / F.col("total"))).alias("ece"), r6(F.max("gap")).alias("mce"))


def area_under_risk(s, d):
    """Mean over all prefixes of the examples by falling score (ties by id) of the share that is not eligible."""
    x = _one(s, d, "fewshot_pool", "example_id", (1 - F.col("fewshot_eligible")).alias("wrong"), _num("quality_score").alias("p")).where("p is not null and wrong is not null").withColumn("one", F.lit(1))
    r = running_sums(x, [F.col("p").desc(), F.col("example_id").asc()], {"errors": "wrong", "seen": "one"})
    return r.agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("errors") / F.col("seen"))).alias("aurc"))


def quantile_families(s, d):
    """Subject lengths at the half, nine tenths and 95 %: by half-even index, nearest rank and linear interpolation."""
    x = _one(s, d, "commit_log", "log_id", F.length("subject").cast("double").alias("v"), F.lit(0).alias("g")).where("v is not null")
    r = cut(rank_within(x, ["g"], [F.col("v").asc(), F.col("log_id").asc()]).select("v", "rank"))
    n = r.agg(F.max("rank").alias("n"))
    y = r.join(n, F.lit(True))
    rows = None
    for q in (0.5, 0.9, 0.95):
        at = lambda i: F.max(F.when(F.col("rank") == i, F.col("v")))
        pos = (F.col("n") - 1) * F.lit(q)
        z = y.agg(F.lit(q).alias("q"), at(F.bround(pos, 0) + 1).alias("half_even"), at(F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(q)))).alias("nearest"), at(F.floor(pos) + 1).alias("lo"), at(F.ceil(pos) + 1).alias("hi"), F.max(pos - F.floor(pos)).alias("w"))
        z = z.select("q", "half_even", "nearest", r6(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("w")).alias("linear"))
        rows = z if rows is None else rows.union(z)
    return rows


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (wanted_messages, recent_records, bridge_rejects, source_classes, threshold_report, rule_against_model, probability_gap, selection_strategies, strategy_metrics, balanced_subset, repo_dev_split, capped_sample, interleaved_blocks, unit_pair_counts, leakage_keys, exemplar_exclusions, repo_holdout, queue_overlap, score_summaries,
           slot_collapse, trivial_clusters, review_errors, batch_plan, blind_order, shared_identifiers, masked_patches, table_registry, mined_order, best_candidates, calibration_error, area_under_risk, quantile_families)
    return {f.__name__: f for f in own}


# --- SQL ------------------------------------------------------------------------

_SHA = "nullif(lower(trim({c})), '')"
_POOL = "(SELECT DISTINCT row_id, repo, sha, type, subject, commit_message, git_diff, commit_date FROM commit_pool)"
_FEW = "(SELECT DISTINCT * EXCLUDE (updated_at) FROM fewshot_pool)"
_Q = "CASE WHEN isnan(quality_score) THEN NULL ELSE quality_score END"
_SAMPLES = "(SELECT DISTINCT sample_id, repo, split, k, diff_text, intent_subjects, source_kind FROM attribution_samples)"
_UNITS = "(SELECT DISTINCT unit_id, sample_id, file_path, file_role, gold_intent_id FROM edit_units)"
_INTENTS = f"c AS (SELECT sample_id, gold_intent_id, count(*)::DOUBLE AS n FROM {_UNITS} WHERE sample_id IS NOT NULL AND gold_intent_id IS NOT NULL GROUP BY ALL)"


def _blank(c: str) -> str:
    return f"coalesce(trim({c}), '') = ''"


def oracle_sql() -> dict[str, str]:
    strategies = f"""x AS (SELECT example_id, coalesce({_Q}, -1) AS p, coalesce(verified_multi_intent = 1, false) AS rule, fewshot_eligible = 1 AS gold FROM {_FEW}),
 y AS (SELECT example_id, p, gold, 'rule_only' AS strategy, rule AS o, CASE WHEN rule THEN 'rule_positive' ELSE 'rule_not_positive' END AS reason FROM x UNION ALL SELECT example_id, p, gold, 'model_only', p > 0.6, CASE WHEN p > 0.6 THEN 'model_above' ELSE 'model_not_above' END FROM x UNION ALL SELECT example_id, p, gold, 'model_then_rule', p > 0.6 AND rule, CASE WHEN p > 0.6 AND rule THEN 'both_positive' WHEN p > 0.6 THEN 'rule_not_positive' ELSE 'model_not_above' END FROM x),
 z AS (SELECT *, o AND row_number() OVER (PARTITION BY strategy, o ORDER BY p DESC, example_id) <= 25 AS selected FROM y)"""
    knots = "CASE WHEN p <= 0.1 THEN 0.05 WHEN p <= 0.4 THEN 0.05 + (p - 0.1) * 0.25 / 0.3 WHEN p <= 0.7 THEN 0.3 + (p - 0.4) * 0.5 / 0.3 WHEN p <= 0.9 THEN 0.8 + (p - 0.7) * 0.15 / 0.2 ELSE 0.95 END"
    loss = lambda c: f"avg(-(t * ln(greatest(1e-8, least(1 - 1e-8, {c}))) + (1 - t) * ln(1 - greatest(1e-8, least(1 - 1e-8, {c})))))"
    pair_count = lambda c, n: f"(SELECT sample_id, sum(n * (n - 1) / 2)::BIGINT AS {n} FROM (SELECT sample_id, {c} AS c, count(*) AS n FROM u WHERE {c} IS NOT NULL GROUP BY ALL) GROUP BY 1)"
    fam = lambda q: f"SELECT {q}::DOUBLE AS q, max(v) FILTER (r = round_even((n - 1) * {q}::DOUBLE, 0) + 1) AS half_even, max(v) FILTER (r = greatest(1, ceil(n * {q}::DOUBLE))) AS nearest, round(quantile_cont(v, {q}), 6) AS linear FROM x"
    keys = {"attribution_samples": "sample_id", "candidates": "sha", "commit_log": "log_id", "commit_pool": "row_id", "documents": "doc_id", "edit_units": "unit_id", "fewshot_pool": "example_id"}
    errors = [("no_repo", f"{repo_sql('repo')} IS NULL"), ("bad_id", "NOT coalesce(regexp_matches(lower(trim(sha)), '^[0-9a-f]{40}$'), false)"), ("no_subject", _blank("subject")), ("k_against_pair", "coalesce(intent_k <> len(string_split(type_pair, '+')), true)"),
              ("eligible_but_unverified", "coalesce(fewshot_eligible = 1 AND verified_multi_intent <> 1, false)"), ("no_score", "quality_score IS NULL OR isnan(quality_score)"), ("signature_not_sorted", "coalesce(array_to_string(list_sort(string_split(type_signature_canonical, '+')), '+') <> type_signature_canonical, false)")]
    norm = "trim(regexp_replace(lower(subject), '[^a-z0-9]+', ' ', 'g'))"
    return {
        "wanted_messages": f"SELECT sha, log_id FROM (SELECT {_SHA.format(c='sha')} AS sha, log_id, row_number() OVER (PARTITION BY {_SHA.format(c='sha')} ORDER BY coalesce(ingested_at, TIMESTAMP '1970-01-01') DESC, log_id DESC) AS r FROM commit_log) WHERE r = 1 AND sha IN (SELECT {_SHA.format(c='sha')} FROM candidates)",
        "recent_records": f"SELECT CASE WHEN d = '' THEN 'unread' WHEN d >= '2023-06-02' THEN 'recent' ELSE 'old' END AS state, count(*) AS n FROM (SELECT regexp_extract(coalesce(commit_date, ''), '^\\s*([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1) AS d FROM {_POOL}) GROUP BY 1",
        "bridge_rejects": f"""WITH x AS (SELECT row_id, {_SHA.format(c='sha')} AS sha, CASE WHEN {_blank('type')} THEN 'no_type' WHEN NOT coalesce(regexp_matches(lower(trim(sha)), '^[0-9a-f]{{40}}$'), false) THEN 'bad_id' WHEN {repo_sql('repo')} IS NULL THEN 'no_repo' WHEN {_blank('subject')} THEN 'no_subject' WHEN {_blank('commit_message')} THEN 'no_message' WHEN {_blank('git_diff')} THEN 'no_diff' WHEN length(git_diff) < 400 THEN 'short_diff' WHEN starts_with(trim(git_diff), 'version https://git-lfs') THEN 'pointer' ELSE 'kept' END AS reason FROM {_POOL})
 SELECT CASE WHEN reason = 'kept' AND row_id <> min(row_id) OVER (PARTITION BY sha, reason) THEN 'repeated_id' ELSE reason END AS reason, count(*) AS n FROM (SELECT reason, row_id, sha FROM x) GROUP BY ALL""".replace("SELECT CASE WHEN reason = 'kept' AND row_id <> min(row_id) OVER (PARTITION BY sha, reason) THEN 'repeated_id' ELSE reason END AS reason, count(*) AS n FROM (SELECT reason, row_id, sha FROM x) GROUP BY ALL", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN reason = 'kept' AND row_id <> min(row_id) OVER (PARTITION BY sha, reason) THEN 'repeated_id' ELSE reason END AS reason FROM x) GROUP BY 1"),
        "source_classes": f"""WITH x AS (SELECT row_id, CASE WHEN git_diff <> '' THEN sha256(array_to_string(list_filter(string_split(git_diff, chr(10)), lambda v: NOT starts_with(v, 'index ')), chr(10))) END AS h, {repo_sql('repo')} AS r, length(trim(coalesce(commit_message, ''))) AS n FROM {_POOL}), y AS (SELECT *, CASE WHEN h IS NULL THEN 'no_diff' WHEN r IS NULL THEN 'no_repo' WHEN n < 60 THEN 'short_message' ELSE 'ok' END AS q FROM x),
 z AS (SELECT CASE WHEN q = 'ok' AND row_id <> min(row_id) OVER (PARTITION BY h, q) THEN 'repeated_diff' ELSE q END AS reason FROM y) SELECT CASE reason WHEN 'ok' THEN 'accepted' WHEN 'short_message' THEN 'review' ELSE 'rejected' END AS class, reason, count(*) AS n FROM z GROUP BY reason""",
        "threshold_report": f"WITH x AS (SELECT {_Q} AS q, fewshot_eligible AS y FROM {_FEW} WHERE fewshot_eligible IS NOT NULL AND {_Q} IS NOT NULL) SELECT tau::DOUBLE AS tau, count(*) FILTER (q > tau) AS selected, round(count(*) FILTER (q > tau) / count(*), 6) AS coverage, round(count(*) FILTER (q > tau AND y = 1) / nullif(count(*) FILTER (q > tau), 0), 6) AS precision, round(count(*) FILTER (q > tau AND y = 1) / nullif(count(*) FILTER (y = 1), 0), 6) AS recall FROM x, (VALUES (0.4::DOUBLE), (0.55), (0.7)) v(tau) GROUP BY tau",
        "rule_against_model": f"WITH x AS (SELECT fewshot_eligible = 1 AS g, verified_multi_intent = 1 AS r, {_Q} > 0.6 AS m FROM {_FEW} WHERE fewshot_eligible IS NOT NULL), y AS (SELECT 'rule' AS who, g, r AS s FROM x UNION ALL SELECT 'model', g, m FROM x) SELECT who, round(count(*) FILTER (g AND s) / nullif(count(*) FILTER (s), 0), 6) AS precision, round(count(*) FILTER (g AND s) / nullif(count(*) FILTER (g), 0), 6) AS recall, round(avg((s IS NULL)::INT), 6) AS abstains FROM y GROUP BY who",
        "probability_gap": f"WITH x AS (SELECT fewshot_eligible::DOUBLE AS t, {_Q} AS p FROM {_FEW} WHERE fewshot_eligible IS NOT NULL AND {_Q} IS NOT NULL), y AS (SELECT *, {knots} AS c FROM x) SELECT count(*) AS n, round(avg((p - t) * (p - t)), 6) AS brier_raw, round(avg((c - t) * (c - t)), 6) AS brier_calibrated, round(avg((p - t) * (p - t)) - avg((c - t) * (c - t)), 6) AS brier_gain, round({loss('p')}, 6) AS loss_raw, round({loss('c')}, 6) AS loss_calibrated, round({loss('p')} - {loss('c')}, 6) AS loss_gain FROM y",
        "selection_strategies": f"WITH {strategies} SELECT strategy, CASE WHEN o AND NOT selected THEN reason || '_trimmed' ELSE reason END AS reason, count(*) AS n FROM z GROUP BY ALL",
        "strategy_metrics": f"WITH {strategies}, g AS (SELECT strategy, count(*) FILTER (selected) AS n, count(*) FILTER (selected AND gold) AS tp, count(*) FILTER (gold) AS pos FROM z WHERE gold IS NOT NULL GROUP BY 1) SELECT strategy, n, round(tp / nullif(n, 0), 6) AS precision, round(tp / nullif(pos, 0), 6) AS recall, round(2 * tp / nullif(n + pos, 0), 6) AS f1, round(1 - tp / nullif(n, 0), 6) AS noise FROM g",
        "balanced_subset": f"SELECT * FROM (SELECT sample_id, k, row_number() OVER (PARTITION BY k ORDER BY sample_id) AS rank FROM {_SAMPLES} WHERE k IN (1, 2)) WHERE rank <= 20",
        "repo_dev_split": f"WITH w AS (SELECT repo, count(*) AS w FROM (SELECT {repo_sql('repo')} AS repo FROM {_SAMPLES}) WHERE repo IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY sha1('7:' || repo), repo) AS i, count(*) OVER () AS n FROM w) SELECT CASE WHEN i <= floor(n * 0.2) THEN 'dev' ELSE 'train' END AS split, count(*) AS repos, sum(w)::BIGINT AS samples FROM r GROUP BY 1",
        "capped_sample": f"WITH x AS (SELECT sample_id, {repo_sql('repo')} AS repo, sha1('11:' || sample_id) AS k FROM {_SAMPLES}), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY k, sample_id) AS i FROM x WHERE repo IS NOT NULL) SELECT sample_id, repo FROM r WHERE i <= 2 ORDER BY k, sample_id LIMIT 60",
        "interleaved_blocks": f"WITH u AS (SELECT unit_id, sample_id, gold_intent_id AS i, row_number() OVER (PARTITION BY sample_id, gold_intent_id ORDER BY unit_id) AS r FROM {_UNITS} WHERE sample_id IS NOT NULL AND gold_intent_id IS NOT NULL), o AS (SELECT sample_id, i, lag(i) OVER (PARTITION BY sample_id ORDER BY r, i) AS p FROM u) SELECT sample_id, count(*) AS blocks, count(*) FILTER (p <> i) AS switches FROM o GROUP BY sample_id",
        "unit_pair_counts": f"WITH u AS (SELECT *, regexp_replace(file_path, '/?[^/]*$', '') AS folder FROM {_UNITS} WHERE sample_id IS NOT NULL), n AS (SELECT sample_id, (count(*) * (count(*) - 1) / 2)::BIGINT AS pairs FROM u GROUP BY 1) SELECT n.sample_id, pairs, coalesce(same_file, 0) AS same_file, coalesce(same_folder, 0) AS same_folder, coalesce(same_role, 0) AS same_role FROM n LEFT JOIN {pair_count('file_path', 'same_file')} a USING (sample_id) LEFT JOIN {pair_count('folder', 'same_folder')} b USING (sample_id) LEFT JOIN {pair_count('file_role', 'same_role')} c USING (sample_id)",
        "leakage_keys": f"""WITH x AS (SELECT sample_id, {split_sql('split')} AS split, {repo_sql('repo')} AS repo, sha1(trim(diff_text)) AS diff, intent_subjects, source_kind FROM {_SAMPLES}), r AS (SELECT split, 'repo' AS key, repo AS v FROM x UNION ALL SELECT split, 'diff', diff FROM x UNION ALL SELECT split, 'source_kind', source_kind FROM x UNION ALL SELECT split, 'subject', unnest(intent_subjects) FROM x
 UNION ALL SELECT split, 'source_id', {_SHA.format(c='c')} FROM (SELECT sample_id, unnest(source_atomic_commit_ids) AS c FROM edit_units) JOIN x USING (sample_id)), d AS (SELECT DISTINCT split, key, v FROM r WHERE split IS NOT NULL AND v <> '') SELECT p.key, p.split AS a, q.split AS b, count(*) AS shared FROM d p JOIN d q ON p.key = q.key AND p.v = q.v AND p.split < q.split GROUP BY ALL""",
        "exemplar_exclusions": f"""WITH x AS (SELECT {split_sql('split')} AS split, {repo_sql('repo')} AS repo, {_SHA.format(c='sha')} AS sha, {norm} AS subject FROM {_FEW}), e AS (SELECT * FROM x WHERE split IN ('dev', 'test')), t AS (SELECT list_filter([CASE WHEN repo IN (SELECT repo FROM e WHERE repo IS NOT NULL) THEN 'repo' END, CASE WHEN sha IN (SELECT sha FROM e WHERE sha IS NOT NULL) THEN 'revision' END, CASE WHEN subject IN (SELECT subject FROM e WHERE subject <> '') THEN 'subject' END,
 CASE WHEN sha IN (SELECT {_SHA.format(c='sha')} FROM candidates WHERE sha IS NOT NULL) THEN 'candidate' END], lambda v: v IS NOT NULL) AS w FROM x WHERE split = 'train') SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN len(w) > 0 THEN w ELSE ['kept'] END) AS reason FROM t) GROUP BY 1""",
        "repo_holdout": f"""WITH x AS (SELECT example_id, {repo_sql('repo')} AS repo, fewshot_eligible AS y FROM {_FEW} WHERE fewshot_eligible IS NOT NULL), k AS (SELECT * FROM x WHERE repo IS NOT NULL), w AS (SELECT repo, count(*) AS w, sum(y) AS p FROM k GROUP BY 1), r AS (SELECT *, sum(w) OVER (ORDER BY sha256('5|' || repo), repo) AS u, sum(w) OVER () AS t FROM w), q AS (SELECT y, row_number() OVER (PARTITION BY y ORDER BY sha256('6|' || example_id), example_id) AS i, count(*) OVER (PARTITION BY y) AS n FROM k)
 SELECT 'repository' AS kind, u - w < 0.2 * t AS held_out, sum(w)::BIGINT AS n, sum(p)::BIGINT AS positives FROM r GROUP BY 2 UNION ALL SELECT 'label', i <= floor(n * 0.2), count(*), sum(y)::BIGINT FROM q GROUP BY 2""",
        "queue_overlap": "WITH x AS (" + " UNION ALL ".join(f"SELECT '{n}' AS q, {_SHA.format(c='sha')} AS sha FROM {n}" for n in ("candidates", "commit_log", "commit_pool", "fewshot_pool")) + ") SELECT tables, count(*) AS n FROM (SELECT sha, string_agg(DISTINCT q, '+' ORDER BY q) AS tables FROM x WHERE sha IS NOT NULL GROUP BY sha) GROUP BY 1",
        "score_summaries": f"SELECT split, count(*) AS n, round(avg(q), 6) AS mean, round(stddev_pop(q), 6) AS sd, min(q) AS least, round(median(q), 6) AS median, max(q) AS most FROM (SELECT {split_sql('split')} AS split, {_Q} AS q FROM {_FEW}) WHERE q IS NOT NULL GROUP BY split",
        "slot_collapse": f"WITH {_INTENTS}, x AS (SELECT sample_id, count(*) AS slots, max(n) AS m, sum(n) AS t, sum(n * log2(n)) AS h FROM c GROUP BY 1) SELECT slots, count(*) AS samples, round(avg((m >= 0.8::DOUBLE * t)::INT), 6) AS collapsed, round(avg(log2(t) - h / t), 6) AS entropy FROM x GROUP BY slots",
        "trivial_clusters": f"WITH {_INTENTS}, x AS (SELECT sample_id, sum(n) AS t, sum(n * (n - 1) / 2) AS g FROM c GROUP BY 1) SELECT least(t, 10)::INT AS units, count(*) AS samples, round(avg(coalesce(2 * g / nullif(g + t * (t - 1) / 2, 0), 0)), 6) AS pair_f1 FROM x GROUP BY 1",
        "review_errors": "SELECT error, count(*) AS n FROM (SELECT unnest([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in errors) + f"]) AS error FROM {_FEW}) WHERE error IS NOT NULL GROUP BY 1",
        "batch_plan": f"WITH r AS (SELECT sample_id, row_number() OVER (ORDER BY sha256('21|' || sample_id), sample_id) AS i FROM {_SAMPLES}) SELECT CASE WHEN i <= 50 THEN 1 WHEN i <= 150 THEN 2 ELSE 3 END AS batch, count(*) AS n, arg_min(sample_id, i) AS first FROM r GROUP BY 1",
        "blind_order": f"SELECT repo, substr('ABCD', i::INT, 1) AS letter, sha FROM (SELECT repo, sha, row_number() OVER (PARTITION BY repo ORDER BY sha256('31|' || sha), sha) AS i FROM (SELECT DISTINCT sha, {repo_sql('repo')} AS repo FROM candidates) WHERE repo IS NOT NULL) WHERE i <= 4",
        "shared_identifiers": "WITH u AS (SELECT unit_id, any_value(sample_id) AS sample_id, coalesce(any_value(language), 'unknown') AS language, any_value(identifiers) AS ids FROM edit_units GROUP BY unit_id), c AS (SELECT sample_id, language, i, count(*) AS n FROM (SELECT sample_id, language, unnest(list_distinct(ids)) AS i FROM u WHERE sample_id IS NOT NULL) WHERE i IS NOT NULL GROUP BY ALL HAVING count(*) > 1) SELECT language, count(*) AS contexts, sum(n)::BIGINT AS units, max(n) AS most FROM c GROUP BY language",
        "masked_patches": "WITH m AS (SELECT coalesce(language, 'unknown') AS language, patch_text, regexp_replace(regexp_replace(regexp_replace(patch_text, '\"[^\"\\n]*\"', 'S', 'g'), '[A-Za-z0-9]+(_[A-Za-z0-9]+)+', 'ID', 'g'), '[0-9]+', 'N', 'g') AS mask FROM (SELECT DISTINCT unit_id, language, patch_text FROM edit_units) WHERE patch_text IS NOT NULL) SELECT language, count(*) AS patches, sum((mask <> patch_text)::INT)::BIGINT AS changed, count(DISTINCT mask) AS masks FROM m GROUP BY language",
        "table_registry": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows, count(DISTINCT {k}) AS records, coalesce(sum(({k} IS NULL)::INT), 0)::BIGINT AS no_key FROM {n}" for n, k in keys.items()),
        "mined_order": f"WITH x AS (SELECT DISTINCT sha, {repo_sql('repo')} AS repo, length(trim(coalesce(subject, ''))) AS n, CASE WHEN isnan(score) THEN NULL ELSE score END AS s FROM candidates) SELECT sha, rank FROM (SELECT sha, row_number() OVER (ORDER BY s DESC, n, sha) AS rank FROM x WHERE repo IS NOT NULL AND n >= 20 AND s IS NOT NULL) WHERE rank <= 40",
        "best_candidates": f"WITH x AS (SELECT sha, {repo_sql('repo')} AS repo, coalesce(regexp_matches(subject, '(?i)^(merge|revert|wip)'), false) AS a, {_blank('message')} AS b, (length(coalesce(subject, '')) > 72)::INT AS c, coalesce(ends_with(subject, '.'), false)::INT AS e FROM (SELECT DISTINCT sha, repo, subject, message FROM candidates)), y AS (SELECT *, a OR b AS rejected, a::INT + b::INT + c + e AS penalty FROM x WHERE repo IS NOT NULL) SELECT repo, sha, penalty, NOT rejected AS accepted FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY rejected, penalty, sha) AS r FROM y) WHERE r = 1",
        "calibration_error": f"WITH x AS (SELECT fewshot_eligible::DOUBLE AS t, {_Q} AS p FROM {_FEW} WHERE fewshot_eligible IS NOT NULL AND {_Q} IS NOT NULL), g AS (SELECT b, count(*) AS n, abs(avg(p) - avg(t)) AS gap FROM x JOIN generate_series(0, 9) s(b) ON p >= b::DOUBLE / 10 AND p <= (b + 1)::DOUBLE / 10 GROUP BY b) SELECT round(sum(n * gap / (SELECT count(*) FROM x)), 6) AS ece, round(max(gap), 6) AS mce FROM g",
        "area_under_risk": f"WITH x AS (SELECT example_id, 1 - fewshot_eligible AS w, {_Q} AS p FROM {_FEW} WHERE fewshot_eligible IS NOT NULL AND {_Q} IS NOT NULL), r AS (SELECT sum(w) OVER o / row_number() OVER o AS e FROM x WINDOW o AS (ORDER BY p DESC, example_id ROWS UNBOUNDED PRECEDING)) SELECT count(*) AS n, round(avg(e), 6) AS aurc FROM r",
        "quantile_families": "WITH x AS (SELECT v, row_number() OVER (ORDER BY v) AS r, count(*) OVER () AS n FROM (SELECT length(subject)::DOUBLE AS v FROM (SELECT DISTINCT log_id, subject FROM commit_log) WHERE subject IS NOT NULL)) " + " UNION ALL ".join(fam(q) for q in ("0.5", "0.9", "0.95")),
    }
