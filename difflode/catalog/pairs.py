"""Queries that pair records of a repository and score the pairs, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from difflode.catalog.text import GENERIC
from difflode.functions.repo import canonical_repo
from difflode.functions.scores import stable_key
from difflode.functions.words import jaccard
from difflode.operators.clusters import average_link
from difflode.operators.metrics import r6
from difflode.operators.selection import bounded_pairs
from difflode.oracle import repo as repo_sql
from difflode.sources.tables import table as T

# Spellings of types, pairs of types that go well or fairly together, types that never pair, verbs that contradict each other.
TYPE_NAMES = {"feature": "feat", "features": "feat", "bugfix": "fix", "bug": "fix", "hotfix": "fix", "doc": "docs", "documentation": "docs", "tests": "test", "testing": "test", "perfomance": "perf", "performance": "perf", "optimize": "perf", "optimization": "perf", "chore-release": "chore_release", "chore/release": "chore_release"}
HIGH = ("docs+feat", "docs+fix", "feat+test", "fix+perf", "fix+refactor", "fix+test", "perf+refactor")
MEDIUM = ("docs+test", "feat+fix", "feat+refactor", "refactor+test")
FORBIDDEN = ("revert", "merge", "release", "chore_release")
OPPOSITES = ((("add", "introduce"), ("remove", "delete")), (("enable",), ("disable",)), (("increase", "raise"), ("decrease", "lower")), (("create",), ("delete", "remove")), (("introduce",), ("revert",)), (("rename",), ("restore",)), (("allow",), ("prevent",)), (("start",), ("stop",)))
VERBS = tuple(sorted({w for a, b in OPPOSITES for w in (*a, *b)}))
ATTEMPTS, ACCEPTED = 120, 30


def canonical_type(c: Column) -> Column:
    """The type without scope and mark, by its usual name; empty for null."""
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\(.*\)|!|:", "")
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in TYPE_NAMES.items() for x in (F.lit(k), F.lit(v))]), t), t)


def _list(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9_]+"), 0), lambda x: F.length(x) >= 2))


def _sources(s: SparkSession, d: str) -> DataFrame:
    """What pairing needs of every pool record with a diff; texts are reduced to words before any shuffle."""
    text = F.lower(F.concat_ws(" ", F.trim(F.coalesce("subject", F.lit(""))), F.trim(F.coalesce("commit_message", F.lit("")))))
    files = F.array_distinct(F.regexp_extract_all(F.col("git_diff"), F.lit(r"diff --git a/(\S+) b/"), 1))
    lines = F.size(F.filter(F.split("git_diff", "\n"), lambda x: x.rlike(r"^[+-]") & ~x.rlike(r"^(\+\+\+|---)")))
    empty = (F.trim(F.coalesce("subject", F.lit(""))) == "") | (F.trim(F.coalesce("commit_message", F.lit(""))) == "")
    generic = reduce(lambda a, b: a | b, [text.contains(g) for g in GENERIC]) | (F.trim(text) == "")
    return T(s, d, "commit_pool").where("git_diff is not null").select(
        "row_id", canonical_repo(F.col("repo")).alias("repo"), F.lower(F.trim(F.coalesce("sha", F.lit("")))).alias("sha"), canonical_type(F.col("type")).alias("type"), files.alias("files"), lines.alias("lines"), empty.alias("empty"), generic.alias("generic"),
        _tokens(text).alias("words"), _tokens(F.col("subject")).alias("subject_words"), F.array_distinct(F.transform(files, lambda f: F.when(f.contains("/"), F.substring_index(f, "/", 1)).otherwise("."))).alias("modules"),
    ).dropDuplicates(["row_id"]).where("repo is not null")


def source_precheck(p: DataFrame) -> DataFrame:
    """``p`` with ``skip_reason, status, weight`` of pairs with the columns of ``_sources`` as ``_a`` and ``_b``.

    Five scores are multiplied: how telling the messages are, how well the types go
    together, whether directions contradict, whether texts repeat each other (by their
    words alone), and whether the subjects or modules are related. The first reason to
    skip sets the weight to 0; a score below 1 is a warning.
    """
    a, b = (lambda c: F.col(f"{c}_a")), (lambda c: F.col(f"{c}_b"))
    pair = F.array_join(F.array_sort(F.array(a("type"), b("type"))), "+")
    message = F.when(a("generic") & b("generic"), 0.0).when(a("generic") | b("generic"), 0.6).otherwise(1.0)
    kind = F.when(a("type").isin(*FORBIDDEN) | b("type").isin(*FORBIDDEN), 0.0).when(pair.isin(*HIGH), 1.0).when(pair.isin(*MEDIUM), 0.8).otherwise(0.6)
    has = lambda side, words: F.arrays_overlap(side("words"), _list(words))
    against = reduce(lambda x, y: x | y, [(has(a, x) & has(b, y)) | (has(a, y) & has(b, x)) for x, y in OPPOSITES])
    objects = F.size(F.array_except(F.array_intersect(a("words"), b("words")), _list(VERBS))) > 0
    semantic = F.when(against & objects, 0.0).when(against, 0.5).otherwise(1.0)
    complementary = (a("type") != b("type")) & (pair.contains("test") | pair.contains("docs"))
    alike = F.coalesce(jaccard(a("words"), b("words")), F.lit(1.0))
    repeat = F.when((a("type") == b("type")) & (a("type") != "") & (alike >= 0.92), 0.0).when(alike >= 0.75, 0.5).otherwise(1.0)
    near = F.greatest(F.coalesce(jaccard(a("subject_words"), b("subject_words")), F.lit(1.0)), F.when(F.arrays_overlap(a("modules"), b("modules")), 0.4).otherwise(0.0), F.when(complementary, 0.7).otherwise(0.0))
    relation = F.when(near <= 0.1, 0.7).otherwise(1.0)
    skip = F.when((a("sha") == "") | (b("sha") == "") | (a("sha") == b("sha")), "same_or_no_id").when(a("empty") | b("empty"), "empty_text").when(message == 0, "both_generic").when(kind == 0, "forbidden_type").when(semantic == 0, "contradiction").when(repeat == 0, "near_duplicate").otherwise("none")
    product = message * kind * semantic * repeat * relation
    return p.withColumn("skip_reason", skip).withColumn("weight", F.when(skip == "none", product).otherwise(0.0)).withColumn("status", F.when(skip != "none", "skip").when(product < 1, "warn").otherwise("pass"))


COLUMNS = ["sha", "type", "files", "lines", "empty", "generic", "words", "subject_words", "modules"]


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return source_precheck(bounded_pairs(_sources(s, d), "repo", "row_id", ATTEMPTS, "41", COLUMNS))


def source_pairs(s, d):
    """The first 120 pairs of each repository in hash order with status, first reason to skip and weight."""
    return _pairs(s, d).select("repo", F.col("key_a").alias("first"), F.col("key_b").alias("second"), "status", "skip_reason", r6(F.col("weight")).alias("weight"))


def pair_groups(s, d):
    """The first thirty acceptable ones of these pairs by repository: no shared file, at most twelve files and 400 lines, not skipped."""
    ok = (F.col("status") != "skip") & ~F.arrays_overlap("files_a", "files_b") & (F.size(F.array_union("files_a", "files_b")) <= 12) & (F.col("lines_a") + F.col("lines_b") <= 400)
    from pyspark.sql import Window

    # a repository has at most ATTEMPTS pairs, so its window is bounded
    w = Window.partitionBy("repo").orderBy("attempt")
    return _pairs(s, d).where(ok).withColumn("place", F.row_number().over(w)).where(F.col("place") <= ACCEPTED).select("repo", "place", F.col("key_a").alias("first"), F.col("key_b").alias("second"))


def pair_types(s, d):
    """Pairs by the two types, with the mean weight of those that are not skipped."""
    pair = F.array_join(F.array_sort(F.array("type_a", "type_b")), "+")
    return _pairs(s, d).groupBy(pair.alias("types")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("status") == "skip").cast("bigint")).alias("skipped"), r6(F.avg(F.when(F.col("status") != "skip", F.col("weight")))).alias("mean_weight"))


def unit_clusters(s, d):
    """Units of each sample merged by average similarity into as many clusters as it has intents: clusters and pairwise F1 against the intents."""
    u = T(s, d, "edit_units").select("unit_id", "sample_id", "file_path", "file_role", "identifiers", "gold_intent_id").dropDuplicates(["unit_id"]).where("sample_id is not null and gold_intent_id is not null")
    return average_link(u, "sample_id", "unit_id", "gold_intent_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (source_pairs, pair_groups, pair_types, unit_clusters)}


# --- SQL ------------------------------------------------------------------------

def _sql_list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _sql_type(c: str) -> str:
    t = f"regexp_replace(lower(trim(coalesce({c}, ''))), '\\(.*\\)|!|:', '', 'g')"
    return f"CASE {t} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_NAMES.items()) + f" ELSE {t} END"


def oracle_sql() -> dict[str, str]:
    tok = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9_]+'), lambda x: length(x) >= 2))"
    text = "lower(trim(coalesce(subject, '')) || ' ' || trim(coalesce(commit_message, '')))"
    jac = lambda c: f"coalesce(len(list_intersect(a_{c}, b_{c})) / nullif(len(a_{c}) + len(b_{c}) - len(list_intersect(a_{c}, b_{c})), 0), 1)"
    against = " OR ".join(f"(list_has_any(a_words, {_sql_list(x)}) AND list_has_any(b_words, {_sql_list(y)})) OR (list_has_any(a_words, {_sql_list(y)}) AND list_has_any(b_words, {_sql_list(x)}))" for x, y in OPPOSITES)
    cols = ["sha", "type", "files", "lines", "empty", "generic", "words", "subject_words", "modules"]
    base = f"""WITH x AS (SELECT row_id, {repo_sql('repo')} AS repo, lower(trim(coalesce(sha, ''))) AS sha, {_sql_type('type')} AS type, list_distinct(regexp_extract_all(git_diff, 'diff --git a/(\\S+) b/', 1)) AS files, len(list_filter(string_split(git_diff, chr(10)), lambda v: regexp_matches(v, '^[+-]') AND NOT regexp_matches(v, '^(\\+\\+\\+|---)'))) AS lines,
 trim(coalesce(subject, '')) = '' OR trim(coalesce(commit_message, '')) = '' AS empty, {' OR '.join(f"contains({text}, '{g}')" for g in GENERIC)} OR trim({text}) = '' AS generic, {tok(text)} AS words, {tok('subject')} AS subject_words FROM (SELECT DISTINCT row_id, repo, sha, type, subject, commit_message, git_diff FROM commit_pool) WHERE git_diff IS NOT NULL),
 y AS (SELECT *, list_distinct(list_transform(files, lambda f: CASE WHEN contains(f, '/') THEN split_part(f, '/', 1) ELSE '.' END)) AS modules, row_number() OVER (PARTITION BY repo ORDER BY sha256('41|' || row_id), row_id) - 1 AS i FROM x WHERE repo IS NOT NULL),
 p AS (SELECT a.repo, a.row_id AS first, b.row_id AS second, row_number() OVER (PARTITION BY a.repo ORDER BY a.i, b.i) - 1 AS attempt, {', '.join(f'a.{c} AS a_{c}, b.{c} AS b_{c}' for c in cols)} FROM y a JOIN y b ON a.repo = b.repo AND a.i < b.i QUALIFY attempt < {ATTEMPTS}),
 q AS (SELECT *, least(a_type, b_type) || '+' || greatest(a_type, b_type) AS types, {jac('words')} AS alike, ({against}) AS contra, len(list_filter(list_intersect(a_words, b_words), lambda w: NOT list_contains({_sql_list(VERBS)}, w))) > 0 AS objects FROM p),
 r AS (SELECT *, CASE WHEN a_generic AND b_generic THEN 0 WHEN a_generic OR b_generic THEN 0.6 ELSE 1 END::DOUBLE AS s1, CASE WHEN list_contains({_sql_list(FORBIDDEN)}, a_type) OR list_contains({_sql_list(FORBIDDEN)}, b_type) THEN 0 WHEN list_contains({_sql_list(HIGH)}, types) THEN 1 WHEN list_contains({_sql_list(MEDIUM)}, types) THEN 0.8 ELSE 0.6 END::DOUBLE AS s2, CASE WHEN contra AND objects THEN 0 WHEN contra THEN 0.5 ELSE 1 END::DOUBLE AS s3,
  CASE WHEN a_type = b_type AND a_type <> '' AND alike >= 0.92 THEN 0 WHEN alike >= 0.75 THEN 0.5 ELSE 1 END::DOUBLE AS s4, CASE WHEN greatest({jac('subject_words')}, CASE WHEN list_has_any(a_modules, b_modules) THEN 0.4 ELSE 0 END, CASE WHEN a_type <> b_type AND (contains(types, 'test') OR contains(types, 'docs')) THEN 0.7 ELSE 0 END) <= 0.1 THEN 0.7 ELSE 1 END::DOUBLE AS s5 FROM q),
 t AS (SELECT *, CASE WHEN a_sha = '' OR b_sha = '' OR a_sha = b_sha THEN 'same_or_no_id' WHEN a_empty OR b_empty THEN 'empty_text' WHEN s1 = 0 THEN 'both_generic' WHEN s2 = 0 THEN 'forbidden_type' WHEN s3 = 0 THEN 'contradiction' WHEN s4 = 0 THEN 'near_duplicate' ELSE 'none' END AS skip_reason, s1 * s2 * s3 * s4 * s5 AS product FROM r),
 z AS (SELECT *, CASE WHEN skip_reason <> 'none' THEN 'skip' WHEN product < 1 THEN 'warn' ELSE 'pass' END AS status, CASE WHEN skip_reason = 'none' THEN product ELSE 0 END AS weight FROM t)"""
    return {
        "source_pairs": f"{base} SELECT repo, first, second, status, skip_reason, round(weight, 6) AS weight FROM z",
        "pair_groups": f"{base} SELECT repo, place, first, second FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY attempt) AS place FROM z WHERE status <> 'skip' AND NOT list_has_any(a_files, b_files) AND len(list_distinct(list_concat(a_files, b_files))) <= 12 AND a_lines + b_lines <= 400) WHERE place <= {ACCEPTED}",
        "pair_types": f"{base} SELECT types, count(*) AS n, sum((status = 'skip')::INT)::BIGINT AS skipped, round(avg(weight) FILTER (status <> 'skip'), 6) AS mean_weight FROM z GROUP BY types",
    }
