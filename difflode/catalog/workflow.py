"""Queries of review, annotation and planning states, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from difflode.catalog.pairs import HIGH, MEDIUM, pair_groups
from difflode.functions.repo import canonical_repo, canonical_sha, canonical_split
from difflode.functions.scores import stable_key
from difflode.operators.joins import ladder
from difflode.operators.metrics import r6
from difflode.operators.ranking import rank_within
from difflode.oracle import repo as repo_sql
from difflode.oracle import split as split_sql
from difflode.plans.lineage import cut
from difflode.sources.tables import table as T

COMMON = tuple(sorted({*HIGH, "feat+refactor", "docs+test"}))
QUOTAS = {1: 10, 2: 20, 3: 10}
# Verbs that say what a change does, and the points of the rules on subjects and messages.
ACTIONS = r"\b(add|adds|fix|fixes|remove|removes|update|updates|support|enable|disable|implement|refactor|rename|move|improve|introduce|replace|use)\b"
POINTS = (("semicolon", 16.0), ("also", 11.0), ("linked_actions", 10.0), ("many_verbs", 9.0), ("two_verbs", 4.0), ("list", 6.0), ("mixes", 9.0))


def _one(s: SparkSession, d: str, name: str, key: str, *cols: str | Column) -> DataFrame:
    return T(s, d, name).select(key, *cols).dropDuplicates([key])


def _repo() -> Column:
    return canonical_repo(F.col("repo")).alias("repo")


def _filled(c: str) -> Column:
    return F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))


def eligibility(s, d):
    """First reason that keeps a sample out of the count protocol."""
    steps = [("no_split", canonical_split(F.col("split")).isNull()), ("no_count", F.col("gold_count").isNull() | F.col("k").isNull()), ("count_disagrees", F.col("gold_count") != F.col("k")), ("no_repo", canonical_repo(F.col("repo")).isNull()), ("no_diff", F.coalesce(F.trim("diff_text"), F.lit("")) == ""), ("many", F.col("k") > 3)]
    x = ladder(T(s, d, "attribution_samples"), steps, "eligible").select("sample_id", "reason").dropDuplicates(["sample_id"])
    return x.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def split_guards(s, d):
    """Rows that each use of the samples and examples must not see: evaluation rows in training, training rows in tests, rows without a split."""
    a = _one(s, d, "attribution_samples", "sample_id", canonical_split(F.col("split")).alias("split")).select(F.lit("attribution_samples").alias("name"), "split")
    x = a.union(_one(s, d, "fewshot_pool", "example_id", canonical_split(F.col("split")).alias("split")).select(F.lit("fewshot_pool"), "split"))
    rules = F.array(*[F.struct(F.lit(use).alias("use"), bad.alias("bad")) for use, bad in (("training", ~F.coalesce(F.col("split") == "train", F.lit(False))), ("tuning", ~F.coalesce(F.col("split").isin("train", "dev"), F.lit(False))), ("testing", ~F.coalesce(F.col("split") == "test", F.lit(False))))])
    return x.select("name", F.explode(rules).alias("r")).groupBy("name", "r.use").agg(F.sum(F.col("r.bad").cast("bigint")).alias("forbidden"), F.count(F.lit(1)).alias("rows"))


def attached_messages(s, d):
    """Candidates with the message of the log where their own is missing: by the side that the message came from."""
    log = T(s, d, "commit_log").select(canonical_sha(F.col("sha")).alias("k"), _filled("message").alias("m")).where("k is not null and m is not null").groupBy("k").agg(F.min("m").alias("other"))
    x = _one(s, d, "candidates", "sha", canonical_sha(F.col("sha")).alias("k"), _filled("message").alias("own")).join(log, "k", "left")
    side = F.when(F.col("own").isNotNull() & F.col("other").isNotNull(), "own_of_both").when(F.col("own").isNotNull(), "own").when(F.col("other").isNotNull(), "attached").otherwise("none")
    return x.groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


def repo_lookup(s, d):
    """Candidates by how well their repository is known from the pool; an unknown one counts as having no records and no language."""
    meta = _one(s, d, "commit_pool", "row_id", _repo(), "language").where("repo is not null").groupBy("repo").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("language").alias("languages"))
    x = _one(s, d, "candidates", "sha", _repo()).join(meta, "repo", "left").select(F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("languages", F.lit(0)).alias("languages"))
    size = F.when(F.col("records") == 0, "unknown").when(F.col("records") < 5, "few").when(F.col("records") < 50, "some").otherwise("many")
    return x.groupBy(size.alias("known")).agg(F.count(F.lit(1)).alias("candidates"), r6(F.avg("languages")).alias("mean_languages"))


def cached_coverage(s, d):
    """Candidates by tier of their score, and how many have a cached text in the log or a cached diff in the pool."""
    key = lambda n, c: T(s, d, n).where(F.coalesce(F.trim(c), F.lit("")) != "").select(canonical_sha(F.col("sha")).alias("k")).where("k is not null").distinct()
    score = F.when(~F.isnan("score"), F.col("score"))
    tier = F.when(score >= 10, "A").when(score >= 5, "B").when(score.isNotNull(), "C").otherwise("none")
    x = _one(s, d, "candidates", "sha", canonical_sha(F.col("sha")).alias("k"), tier.alias("tier"))
    x = x.join(key("commit_log", "message").withColumn("text", F.lit(1)), "k", "left").join(key("commit_pool", "git_diff").withColumn("diff", F.lit(1)), "k", "left")
    return x.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("with_text"), F.count("diff").alias("with_diff"))


def pair_members(s, d):
    """The accepted pairs with the ids and types of their members, in order."""
    m = _one(s, d, "commit_pool", "row_id", "sha", "type")
    x = pair_groups(s, d).select("repo", "place", F.posexplode(F.array("first", "second")).alias("pos", "row_id")).join(m, "row_id")
    g = x.groupBy("repo", "place").agg(F.array_sort(F.collect_list(F.struct("pos", "sha", "type"))).alias("m"))
    return g.select("repo", "place", F.array_join(F.transform("m", lambda r: F.coalesce(r["sha"], F.lit("-"))), "+").alias("shas"), F.array_join(F.transform("m", lambda r: F.coalesce(r["type"], F.lit("-"))), "+").alias("types"))


def plan_coverage(s, d):
    """Pool records with a diff by whether an accepted pair holds them, and why not: alone in their repository, or no acceptable partner."""
    x = _one(s, d, "commit_pool", "row_id", _repo(), F.col("git_diff").isNotNull().alias("has")).where("has and repo is not null")
    n = x.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    used = pair_groups(s, d).select(F.explode(F.array("first", "second")).alias("row_id")).distinct().withColumn("used", F.lit(True))
    y = x.join(n, "repo").join(used, "row_id", "left")
    return y.groupBy(F.when(F.col("used"), "covered").when(F.col("n") == 1, "alone").otherwise("no_partner").alias("state")).agg(F.count(F.lit(1)).alias("n"))


def signature_minimums(s, d):
    """Eligible training examples of each common signature against a minimum of three."""
    x = _one(s, d, "fewshot_pool", "example_id", canonical_split(F.col("split")).alias("split"), "type_signature_canonical", "fewshot_eligible").where("split = 'train' and fewshot_eligible = 1")
    n = x.groupBy(F.col("type_signature_canonical").alias("signature")).agg(F.count(F.lit(1)).alias("n"))
    want = s.createDataFrame([(c,) for c in COMMON], "signature string")
    return want.join(n, "signature", "left").select("signature", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) < 3).alias("short"))


def threshold_methods(s, d):
    """Examples whose status differs between two ways to set the bounds of pass and warn: fixed ones, and thirds of the scores."""
    x = cut(_one(s, d, "fewshot_pool", "example_id", F.when(~F.isnan("quality_score"), F.col("quality_score")).alias("q")).where("q is not null").withColumn("g", F.lit(0)))
    n = x.agg(F.count(F.lit(1)).alias("n"))
    r = rank_within(x, ["g"], [F.col("q").asc(), F.col("example_id").asc()]).join(n, F.lit(True))
    at = lambda f: F.max(F.when(F.col("rank") == F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(f))), F.col("q")))
    b = r.agg(at(0.33).alias("lo"), at(0.67).alias("hi"))
    status = lambda lo, hi: F.when(F.col("q") >= hi, "pass").when(F.col("q") >= lo, "warn").otherwise("reject")
    y = x.join(b, F.lit(True)).select(status(F.lit(0.4), F.lit(0.7)).alias("fixed"), status(F.col("lo"), F.col("hi")).alias("thirds"))
    return y.groupBy("fixed", "thirds").agg(F.count(F.lit(1)).alias("n"))


def output_quality(s, d):
    """Subjects by split: how many, those of a good form, mean length, and the share that another example repeats."""
    x = cut(_one(s, d, "fewshot_pool", "example_id", canonical_split(F.col("split")).alias("split"), F.trim("subject").alias("t")).where("t is not null and t != ''"))
    rep = x.groupBy(F.lower("t").alias("l")).agg(F.count(F.lit(1)).alias("c"))
    y = x.withColumn("l", F.lower("t")).join(rep, "l")
    ok = (F.length("t") <= 72) & ~F.col("t").endswith(".") & ~F.col("t").contains("\n")
    return y.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(ok.cast("bigint")).alias("good_form"), r6(F.avg(F.length("t"))).alias("mean_chars"), r6(F.avg((F.col("c") > 1).cast("double"))).alias("repeated"))


def annotation_states(s, d):
    """Labelled documents by state: one annotator, two who agree, two who differ in part or in all."""
    lab = T(s, d, "subject_labels").where("doc_id is not null and annotator_id is not null and area is not null").select("doc_id", "annotator_id", "area").distinct()
    a = lab.groupBy("doc_id", "annotator_id").agg(F.array_sort(F.collect_set("area")).alias("areas"))
    g = a.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("areas").alias("views"), F.size(F.array_intersect(F.min_by("areas", "annotator_id"), F.max_by("areas", "annotator_id"))).alias("shared"))
    state = F.when(F.col("n") == 1, "single").when(F.col("views") == 1, "agreed").when(F.col("shared") > 0, "partly").otherwise("conflict")
    return g.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("docs"))


def adjudicated_labels(s, d):
    """Areas by how their labels are resolved: both annotators, one of two (for adjudication), or the only one."""
    lab = T(s, d, "subject_labels").where("doc_id is not null and annotator_id is not null and area is not null").select("doc_id", "annotator_id", "area").distinct()
    k = lab.groupBy("doc_id").agg(F.count_distinct("annotator_id").alias("k"))
    v = lab.groupBy("doc_id", "area").agg(F.count(F.lit(1)).alias("v")).join(k, "doc_id")
    return v.groupBy("area").agg(F.sum((F.col("v") >= 2).cast("bigint")).alias("agreed"), F.sum(((F.col("v") == 1) & (F.col("k") >= 2)).cast("bigint")).alias("open"), F.sum((F.col("k") == 1).cast("bigint")).alias("single"))


def blind_review_sample(s, d):
    """A tenth of the documents with two annotators, at least one, in hash order."""
    lab = T(s, d, "subject_labels").where("doc_id is not null and annotator_id is not null").groupBy("doc_id").agg(F.count_distinct("annotator_id").alias("k")).where("k >= 2").withColumn("g", F.lit(0)).withColumn("h", stable_key("51", F.col("doc_id")))
    n = lab.agg(F.count(F.lit(1)).alias("n"))
    return rank_within(lab, ["g"], [F.col("h").asc(), F.col("doc_id").asc()]).join(n, F.lit(True)).where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.1))).select("doc_id", "rank")


def annotator_scores(s, d):
    """Each annotator against the areas that all annotators of a document gave: labels, and the share of them that all gave."""
    lab = T(s, d, "subject_labels").where("doc_id is not null and annotator_id is not null and area is not null").select("doc_id", "annotator_id", "area").distinct()
    k = lab.groupBy("doc_id").agg(F.count_distinct("annotator_id").alias("k")).where("k >= 2")
    v = lab.groupBy("doc_id", "area").agg(F.count(F.lit(1)).alias("v"))
    return lab.join(k, "doc_id").join(v, ["doc_id", "area"]).groupBy("annotator_id").agg(F.count(F.lit(1)).alias("labels"), r6(F.avg((F.col("v") == F.col("k")).cast("double"))).alias("shared"))


def strata_readiness(s, d):
    """Samples of each number of intents and split against quotas of ten, twenty and ten."""
    x = _one(s, d, "attribution_samples", "sample_id", canonical_split(F.col("split")).alias("split"), F.least("gold_count", F.lit(3)).alias("k")).where("split in ('train', 'dev', 'test') and k >= 1")
    n = x.groupBy("split", "k").agg(F.count(F.lit(1)).alias("n"))
    want = s.createDataFrame([(sp, k, q) for sp in ("train", "dev", "test") for k, q in QUOTAS.items()], "split string, k int, quota long")
    return want.join(n, ["split", "k"], "left").select("split", "k", "quota", F.coalesce("n", F.lit(0)).alias("n"), F.greatest(F.lit(0), F.col("quota") - F.coalesce("n", F.lit(0))).alias("short"))


def delivery_conflicts(s, d):
    """Records that were delivered more than once, and how many of them with different contents, by table."""
    out = None
    for n, k, cols in (("candidates", "sha", ["repo", "subject", "message"]), ("commit_pool", "row_id", ["repo", "sha", "commit_message", "git_diff"]), ("edit_units", "unit_id", ["file_path", "patch_text"]), ("fewshot_pool", "example_id", ["repo", "sha", "subject"])):
        h = F.md5(F.concat_ws("|", *[F.coalesce(c, F.lit("-")) for c in cols]))
        g = T(s, d, n).select(F.col(k).cast("string").alias("k"), h.alias("h")).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("a"), F.max("h").alias("b")).where("n > 1")
        x = g.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("repeated"), F.coalesce(F.sum((F.col("a") != F.col("b")).cast("bigint")), F.lit(0)).alias("in_conflict"))
        out = x if out is None else out.union(x)
    return out


def reason_priorities(s, d):
    """Candidates by the priority that their reasons give, and the number of reasons."""
    r = F.coalesce("reasons", F.array().cast("array<string>"))
    has = lambda p: F.exists(r, lambda v: v.startswith(p))
    p = F.when(F.size(r) == 0, "none").when(has("noise"), "low").when(has("semicolon") | has("many"), "high").otherwise("normal")
    x = _one(s, d, "candidates", "sha", p.alias("priority"), F.size(F.array_distinct(r)).alias("k"))
    return x.groupBy("priority").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("k")).alias("mean_reasons"))


def relaxed_selection(s, d):
    """Thirty samples of two intents by the first of three conditions that enough samples meet; a laxer one replaces a stricter one."""
    cond = [("verified", (F.col("source_kind") == "real_adjudicated") & (F.col("w") >= 0.7)), ("weighted", F.col("w") >= 0.7), ("any", F.lit(True))]
    x = cut(_one(s, d, "attribution_samples", "sample_id", "k", "source_kind", F.coalesce(F.when(~F.isnan("sample_weight"), F.col("sample_weight")), F.lit(0.0)).alias("w")).where("k = 2"))
    n = x.agg(*[F.sum(F.coalesce(c, F.lit(False)).cast("int")).alias(k) for k, c in cond]).first()
    name, c = next(((k, c) for k, c in cond[:-1] if (n[k] or 0) >= 30), cond[-1])
    return x.where(c).orderBy("sample_id").limit(30).select("sample_id", F.lit(name).alias("rule"))


def rule_scores(s, d):
    """Points of candidates that no example has, by rules on subject and message: the two best of each repository."""
    t, m = F.coalesce("subject", F.lit("")), F.lower(F.concat_ws("\n", F.coalesce("subject", F.lit("")), F.coalesce("message", F.lit(""))))
    low = F.lower(t)
    verbs = F.size(F.regexp_extract_all(low, F.lit(ACTIONS), 1))
    items = F.size(F.regexp_extract_all(F.coalesce("message", F.lit("")), F.lit(r"(?:^|\n)[ \t]*(?:[-*+] |[0-9]+[.)] )"), 0))
    hit = {"semicolon": t.contains(";"), "also": m.rlike(r"\b(also|additionally|plus|as well)\b"), "linked_actions": low.rlike(r"\band\b|&") & (verbs >= 2), "many_verbs": verbs >= 3, "two_verbs": verbs == 2, "list": items >= 2, "mixes": low.rlike(r"\b(fix|fixed|fixes)\b") & low.rlike(r"\b(add|adds|support|enable|implement)\b")}
    points = reduce(lambda a, b: a + b, [F.when(hit[k], p).otherwise(0.0) for k, p in POINTS])
    known = T(s, d, "fewshot_pool").select(canonical_sha(F.col("sha")).alias("k")).where("k is not null").distinct()
    x = _one(s, d, "candidates", "sha", _repo(), points.alias("points")).withColumn("k", canonical_sha(F.col("sha"))).join(known, "k", "left_anti").where("repo is not null")
    return rank_within(x, ["repo"], [F.col("points").desc(), F.col("sha").asc()]).where("rank <= 2").select("repo", "sha", "points", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (eligibility, split_guards, attached_messages, repo_lookup, cached_coverage, pair_members, plan_coverage, signature_minimums, threshold_methods, output_quality, annotation_states, adjudicated_labels, blind_review_sample, annotator_scores, strata_readiness, delivery_conflicts, reason_priorities, relaxed_selection, rule_scores)
    return {f.__name__: f for f in own}


# --- SQL ------------------------------------------------------------------------

_SHA = "nullif(lower(trim({c})), '')"
_LAB = "lab AS (SELECT DISTINCT doc_id, annotator_id, area FROM subject_labels WHERE doc_id IS NOT NULL AND annotator_id IS NOT NULL AND area IS NOT NULL)"
_CAND = "(SELECT sha, any_value(repo) AS repo, any_value(subject) AS subject, any_value(message) AS message, any_value(score) AS score, any_value(reasons) AS reasons FROM candidates GROUP BY sha)"


def oracle_sql() -> dict[str, str]:
    from difflode.catalog.pairs import oracle_sql as pairs_sql

    groups = f"({pairs_sql()['pair_groups']})"
    smp = "(SELECT DISTINCT sample_id, repo, split, k, gold_count, diff_text, source_kind, sample_weight FROM attribution_samples)"
    few = "(SELECT DISTINCT * EXCLUDE (updated_at) FROM fewshot_pool)"
    q = "CASE WHEN isnan(quality_score) THEN NULL ELSE quality_score END"
    status = lambda lo, hi: f"CASE WHEN q >= {hi} THEN 'pass' WHEN q >= {lo} THEN 'warn' ELSE 'reject' END"
    tables = (("candidates", "sha", ["repo", "subject", "message"]), ("commit_pool", "row_id", ["repo", "sha", "commit_message", "git_diff"]), ("edit_units", "unit_id", ["file_path", "patch_text"]), ("fewshot_pool", "example_id", ["repo", "sha", "subject"]))
    pts = {"semicolon": "contains(t, ';')", "also": "regexp_matches(m, '\\b(also|additionally|plus|as well)\\b')", "linked_actions": "regexp_matches(l, '\\band\\b|&') AND v >= 2", "many_verbs": "v >= 3", "two_verbs": "v = 2", "list": "i >= 2", "mixes": "regexp_matches(l, '\\b(fix|fixed|fixes)\\b') AND regexp_matches(l, '\\b(add|adds|support|enable|implement)\\b')"}
    return {
        "eligibility": f"SELECT CASE WHEN {split_sql('split')} IS NULL THEN 'no_split' WHEN gold_count IS NULL OR k IS NULL THEN 'no_count' WHEN gold_count <> k THEN 'count_disagrees' WHEN {repo_sql('repo')} IS NULL THEN 'no_repo' WHEN coalesce(trim(diff_text), '') = '' THEN 'no_diff' WHEN k > 3 THEN 'many' ELSE 'eligible' END AS reason, count(*) AS n FROM {smp} GROUP BY 1",
        "split_guards": f"WITH x AS (SELECT 'attribution_samples' AS name, {split_sql('split')} AS split FROM {smp} UNION ALL SELECT 'fewshot_pool', {split_sql('split')} FROM {few}) " + " UNION ALL ".join(f"SELECT name, '{u}' AS use, sum((NOT coalesce(split IN ({ok}), false))::INT)::BIGINT AS forbidden, count(*) AS rows FROM x GROUP BY name" for u, ok in (("training", "'train'"), ("tuning", "'train', 'dev'"), ("testing", "'test'"))),
        "attached_messages": f"WITH l AS (SELECT DISTINCT {_SHA.format(c='sha')} AS k FROM commit_log WHERE coalesce(trim(message), '') <> ''), x AS (SELECT coalesce(trim(message), '') <> '' AS own, {_SHA.format(c='sha')} IN (SELECT k FROM l WHERE k IS NOT NULL) AS o FROM {_CAND}) SELECT CASE WHEN own AND coalesce(o, false) THEN 'own_of_both' WHEN own THEN 'own' WHEN o THEN 'attached' ELSE 'none' END AS side, count(*) AS n FROM x GROUP BY 1",
        "repo_lookup": f"WITH m AS (SELECT repo, count(*) AS r, count(DISTINCT language) AS l FROM (SELECT DISTINCT row_id, {repo_sql('repo')} AS repo, language FROM commit_pool) WHERE repo IS NOT NULL GROUP BY 1), x AS (SELECT coalesce(r, 0) AS r, coalesce(l, 0) AS l FROM (SELECT {repo_sql('repo')} AS repo FROM {_CAND}) c LEFT JOIN m USING (repo)) SELECT CASE WHEN r = 0 THEN 'unknown' WHEN r < 5 THEN 'few' WHEN r < 50 THEN 'some' ELSE 'many' END AS known, count(*) AS candidates, round(avg(l), 6) AS mean_languages FROM x GROUP BY 1",
        "cached_coverage": f"WITH x AS (SELECT {_SHA.format(c='sha')} AS k, CASE WHEN isnan(score) THEN NULL ELSE score END AS s FROM {_CAND}) SELECT CASE WHEN s >= 10 THEN 'A' WHEN s >= 5 THEN 'B' WHEN s IS NOT NULL THEN 'C' ELSE 'none' END AS tier, count(*) AS n, sum((k IN (SELECT {_SHA.format(c='sha')} FROM commit_log WHERE coalesce(trim(message), '') <> '' AND sha IS NOT NULL))::INT)::BIGINT AS with_text, sum((k IN (SELECT {_SHA.format(c='sha')} FROM commit_pool WHERE coalesce(trim(git_diff), '') <> '' AND sha IS NOT NULL))::INT)::BIGINT AS with_diff FROM x GROUP BY 1",
        "pair_members": f"WITH m AS (SELECT DISTINCT row_id, coalesce(sha, '-') AS sha, coalesce(type, '-') AS type FROM commit_pool) SELECT repo, place, a.sha || '+' || b.sha AS shas, a.type || '+' || b.type AS types FROM {groups} g JOIN m a ON a.row_id = g.first JOIN m b ON b.row_id = g.second",
        "plan_coverage": f"WITH g AS {groups}, x AS (SELECT row_id, {repo_sql('repo')} AS repo FROM (SELECT DISTINCT row_id, repo, git_diff FROM commit_pool) WHERE git_diff IS NOT NULL), y AS (SELECT *, count(*) OVER (PARTITION BY repo) AS n FROM x WHERE repo IS NOT NULL) SELECT CASE WHEN row_id IN (SELECT first FROM g UNION ALL SELECT second FROM g) THEN 'covered' WHEN n = 1 THEN 'alone' ELSE 'no_partner' END AS state, count(*) AS n FROM y GROUP BY 1",
        "signature_minimums": f"WITH w AS (SELECT unnest([{', '.join(repr(c) for c in COMMON)}]) AS signature), n AS (SELECT type_signature_canonical AS signature, count(*) AS n FROM {few} WHERE {split_sql('split')} = 'train' AND fewshot_eligible = 1 GROUP BY 1) SELECT signature, coalesce(n, 0) AS n, coalesce(n, 0) < 3 AS short FROM w LEFT JOIN n USING (signature)",
        "threshold_methods": f"WITH x AS (SELECT {q} AS q FROM {few}), r AS (SELECT q, row_number() OVER (ORDER BY q) AS r, count(*) OVER () AS n FROM x WHERE q IS NOT NULL), b AS (SELECT max(q) FILTER (r = greatest(1, ceil(n * 0.33::DOUBLE))) AS lo, max(q) FILTER (r = greatest(1, ceil(n * 0.67::DOUBLE))) AS hi FROM r) SELECT {status('0.4', '0.7')} AS fixed, {status('lo', 'hi')} AS thirds, count(*) AS n FROM r, b GROUP BY ALL",
        "output_quality": f"WITH x AS (SELECT {split_sql('split')} AS split, trim(subject) AS t FROM {few}), y AS (SELECT *, count(*) OVER (PARTITION BY lower(t)) AS c FROM x WHERE t <> '') SELECT split, count(*) AS n, sum((length(t) <= 72 AND NOT ends_with(t, '.') AND NOT contains(t, chr(10)))::INT)::BIGINT AS good_form, round(avg(length(t)), 6) AS mean_chars, round(avg((c > 1)::INT), 6) AS repeated FROM y GROUP BY split",
        "annotation_states": f"WITH {_LAB}, a AS (SELECT doc_id, annotator_id, list_sort(list(area)) AS v FROM lab GROUP BY ALL), g AS (SELECT doc_id, count(*) AS n, count(DISTINCT v) AS views, len(list_intersect(arg_min(v, annotator_id), arg_max(v, annotator_id))) AS shared FROM a GROUP BY 1) SELECT CASE WHEN n = 1 THEN 'single' WHEN views = 1 THEN 'agreed' WHEN shared > 0 THEN 'partly' ELSE 'conflict' END AS state, count(*) AS docs FROM g GROUP BY 1",
        "adjudicated_labels": f"WITH {_LAB}, k AS (SELECT doc_id, count(DISTINCT annotator_id) AS k FROM lab GROUP BY 1), v AS (SELECT doc_id, area, count(*) AS v FROM lab GROUP BY ALL) SELECT area, sum((v >= 2)::INT)::BIGINT AS agreed, sum((v = 1 AND k >= 2)::INT)::BIGINT AS open, sum((k = 1)::INT)::BIGINT AS single FROM v JOIN k USING (doc_id) GROUP BY area",
        "blind_review_sample": "WITH k AS (SELECT doc_id FROM subject_labels WHERE doc_id IS NOT NULL AND annotator_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT annotator_id) >= 2), r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('51|' || doc_id), doc_id) AS rank, count(*) OVER () AS n FROM k) SELECT doc_id, rank FROM r WHERE rank <= greatest(1, floor(n * 0.1))",
        "annotator_scores": f"WITH {_LAB}, k AS (SELECT doc_id, count(DISTINCT annotator_id) AS k FROM lab GROUP BY 1 HAVING count(DISTINCT annotator_id) >= 2), v AS (SELECT doc_id, area, count(*) AS v FROM lab GROUP BY ALL) SELECT annotator_id, count(*) AS labels, round(avg((v = k)::INT), 6) AS shared FROM lab JOIN k USING (doc_id) JOIN v USING (doc_id, area) GROUP BY annotator_id",
        "strata_readiness": f"WITH w AS (SELECT * FROM (VALUES ('train'), ('dev'), ('test')) a(split), (VALUES {', '.join(f'({k}, {n})' for k, n in QUOTAS.items())}) b(k, quota)), n AS (SELECT {split_sql('split')} AS split, least(gold_count, 3) AS k, count(*) AS n FROM {smp} WHERE gold_count >= 1 GROUP BY ALL) SELECT w.split, w.k, quota, coalesce(n, 0) AS n, greatest(0, quota - coalesce(n, 0)) AS short FROM w LEFT JOIN n ON n.split = w.split AND n.k = w.k",
        "delivery_conflicts": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS repeated, coalesce(sum((c > 1)::INT), 0)::BIGINT AS in_conflict FROM (SELECT {k}, count(DISTINCT concat_ws('|', {', '.join(f'coalesce({c}, chr(45))' for c in cols)})) AS c FROM {n} GROUP BY {k} HAVING count(*) > 1)" for n, k, cols in tables),
        "reason_priorities": f"WITH x AS (SELECT coalesce(reasons, []) AS r FROM {_CAND}) SELECT CASE WHEN len(r) = 0 THEN 'none' WHEN len(list_filter(r, lambda v: starts_with(v, 'noise'))) > 0 THEN 'low' WHEN len(list_filter(r, lambda v: starts_with(v, 'semicolon') OR starts_with(v, 'many'))) > 0 THEN 'high' ELSE 'normal' END AS priority, count(*) AS n, round(avg(len(list_distinct(r))), 6) AS mean_reasons FROM x GROUP BY 1",
        "relaxed_selection": f"WITH x AS (SELECT sample_id, source_kind, coalesce(CASE WHEN isnan(sample_weight) THEN NULL ELSE sample_weight END, 0) AS w FROM {smp} WHERE k = 2), n AS (SELECT count(*) FILTER (source_kind = 'real_adjudicated' AND w >= 0.7) AS a, count(*) FILTER (w >= 0.7) AS b FROM x) SELECT sample_id, CASE WHEN a >= 30 THEN 'verified' WHEN b >= 30 THEN 'weighted' ELSE 'any' END AS rule FROM x, n WHERE CASE WHEN a >= 30 THEN source_kind = 'real_adjudicated' AND w >= 0.7 WHEN b >= 30 THEN w >= 0.7 ELSE true END ORDER BY sample_id LIMIT 30",
        "rule_scores": f"""WITH c AS (SELECT sha, {repo_sql('repo')} AS repo, coalesce(subject, '') AS t, lower(coalesce(subject, '')) AS l, lower(coalesce(subject, '') || chr(10) || coalesce(message, '')) AS m, len(regexp_extract_all(lower(coalesce(subject, '')), '{ACTIONS}')) AS v, len(regexp_extract_all(coalesce(message, ''), '(?:^|\\n)[ \\t]*(?:[-*+] |[0-9]+[.)] )')) AS i FROM {_CAND} WHERE coalesce(lower(trim(sha)) NOT IN (SELECT lower(trim(sha)) FROM fewshot_pool WHERE trim(sha) <> ''), true)),
 p AS (SELECT sha, repo, ({' + '.join(f'CASE WHEN {pts[k]} THEN {n} ELSE 0 END' for k, n in POINTS)})::DOUBLE AS points FROM c WHERE repo IS NOT NULL) SELECT * FROM (SELECT repo, sha, points, row_number() OVER (PARTITION BY repo ORDER BY points DESC, sha) AS rank FROM p) WHERE rank <= 2""",
    }
