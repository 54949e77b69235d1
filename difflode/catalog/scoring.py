"""Queries of profiles, signals, bounds and thresholds, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from difflode.functions import signals as sg
from difflode.functions.scores import bernoulli_entropy
from difflode.operators import scoring as so
from difflode.operators.metrics import r6
from difflode.operators.stats import medians
from difflode.oracle import repo as repo_sql
from difflode.functions.repo import canonical_repo
from difflode.sources.tables import table as T

MESSAGE = ["subject_len", "body_lines", "paragraphs", "prefix_match", "prefix_type", "multi", "noisy", "release_like", "issue_refs"]
DIFF = ["file_count", "hunk_count", "changed", "module_count", "method_count"]
SHARES = ["file_gini", "edit_entropy", "dominant_edit", "role_purity"]


def _messages(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "commit_pool").select("row_id", *[c.alias(n) for n, c in sg.message_profile(F.col("commit_message")).items()]).dropDuplicates(["row_id"])


def _diffs(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "commit_pool").select("row_id", "repo", "type", *[c.alias(n) for n, c in sg.diff_profile(F.col("git_diff")).items()]).dropDuplicates(["row_id"])


def _both(s: SparkSession, d: str) -> DataFrame:
    pool = T(s, d, "commit_pool")
    return pool.select("row_id", "type", *[c.alias(n) for n, c in sg.message_profile(F.col("commit_message")).items()], *[c.alias(n) for n, c in sg.diff_profile(F.col("git_diff")).items()]).dropDuplicates(["row_id"])


def message_profile(s, d):
    """Structure, markers and references of every pool message, and how focused its lines are."""
    focus = sg.tightness(T(s, d, "commit_pool").select("row_id", "commit_message").dropDuplicates(["row_id"]), "row_id", F.col("commit_message"))
    x = _messages(s, d).join(focus, "row_id", "left")
    return x.select("row_id", *MESSAGE, (F.col("issue_refs") == 1).alias("single_issue"), r6(F.coalesce("tightness", F.lit(0.0))).alias("tightness"))


def diff_profile(s, d):
    """Size, spread, roles, kinds of edits and identifier focus of every pool diff."""
    focus = sg.identifier_focus(T(s, d, "commit_pool").select("row_id", "git_diff").dropDuplicates(["row_id"]), "row_id", F.col("git_diff"))
    x = _diffs(s, d).join(focus, "row_id", "left")
    return x.select("row_id", *DIFF, F.array_join("role_list", ",").alias("roles"), *[r6(F.col(c)).alias(c) for c in SHARES], r6(F.coalesce("identifier_focus", F.lit(0.0))).alias("identifier_focus"))


def message_bounds(s, d):
    """Bounds of subject lengths, body lines and paragraphs."""
    return so.message_bounds(_messages(s, d))


def scope_bounds(s, d):
    """Bounds of file, line, hunk and module counts."""
    return so.scope_bounds(_diffs(s, d))


def feature_stats(s, d):
    """Mean and deviation of six diff features by repository, and over all rows."""
    cols = ["file_count", "hunk_count", "changed", "module_count", "file_gini", "edit_entropy"]
    x = _diffs(s, d).where("file_count > 0").select(canonical_repo(F.col("repo")).alias("repo"), *cols).where("repo is not null")
    aggs = [a for c in cols for a in (r6(F.avg(c)).alias(f"{c}_mean"), r6(F.stddev_pop(c)).alias(f"{c}_sd"))]
    return x.rollup("repo").agg(F.count(F.lit(1)).alias("n"), *aggs)


def type_values(s, d):
    """z-score of each type's share with the median of all as default."""
    x = T(s, d, "commit_pool").select("row_id", "type").dropDuplicates(["row_id"])
    return so.type_values(x, "type").select("type", r6(F.col("z")).alias("z"), r6(F.col("default_z")).alias("default_z"))


def _signals(s: SparkSession, d: str) -> DataFrame:
    return so.signal_table(_both(s, d), "row_id")


def signal_values(s, d):
    """The twelve signals of every pool record."""
    return _signals(s, d).select("row_id", *[r6(F.col(c)).alias(c) for c in so.SIGNALS])


def signal_weights(s, d):
    """The weight of each signal by its deviation."""
    w = so.signal_weights(_signals(s, d))
    return w.select(F.explode(F.array(*[F.struct(F.lit(c).alias("signal"), r6(F.col(f"w_{c}")).alias("weight")) for c in so.SIGNALS])).alias("r")).select("r.*")


def intent_scores(s, d):
    """Score from 0 to 100 of every pool record, with its logit."""
    return so.scored(_signals(s, d), "row_id").select("row_id", F.round("logit", 4).alias("logit"), F.round(100 * F.col("prob"), 3).alias("score"))


def signal_reasons(s, d):
    """How often each strongest signal is the first reason."""
    x = _signals(s, d).select(F.get(so.reasons({c: F.col(c) for c in so.SIGNALS}), 0).alias("reason"))
    return x.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def score_bins(s, d):
    """Four bins between quantiles of the message score."""
    x = so.quantile_bins(T(s, d, "commit_log").select("log_id", "message_score").dropDuplicates(["log_id"]), "message_score")
    return x.select("bin", r6(F.col("lower")).alias("lower"), r6(F.col("upper")).alias("upper"), "n")


def entropy_gate(s, d):
    """The lowest message score from which on scores are at least as sure as the median score."""
    return so.gate_by_entropy(T(s, d, "commit_log").select("log_id", "message_score").dropDuplicates(["log_id"]), "message_score")


def confidence_weights(s, d):
    """Confidence of candidates' message scores by entropy and by their distance from the median in deviations, averaged by tenth."""
    x = T(s, d, "commit_log").select("log_id", "message_score").dropDuplicates(["log_id"]).where("message_score is not null and not isnan(message_score)")
    mid = medians(x.select(F.lit(0).alias("g"), "message_score"), "g", "message_score").select("median")
    sd = x.agg(F.stddev_pop("message_score").alias("sd"))
    z = F.greatest(F.lit(0.0), F.abs(F.col("message_score") - F.col("median")) / (F.col("sd") + 1e-9))
    weight = (1 - bernoulli_entropy(F.col("message_score")) / 0.6931471805599453) * (1 - z / (1 + z))
    y = x.join(mid, F.lit(True)).join(sd, F.lit(True)).select(F.least(F.lit(9), F.floor(F.col("message_score") * 10)).cast("int").alias("tenth"), weight.alias("w"))
    return y.groupBy("tenth").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("w")).alias("mean_weight"))


def platt_fit(s, d):
    """Slope and intercept of the line in log odds that calibrates the quality score to eligibility."""
    return so.fit_platt(T(s, d, "fewshot_pool").select("example_id", "quality_score", "fewshot_eligible").dropDuplicates(["example_id"]), "quality_score", "fewshot_eligible")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (message_profile, diff_profile, message_bounds, scope_bounds, feature_stats, type_values, signal_values, signal_weights, intent_scores, signal_reasons, score_bins, entropy_gate, confidence_weights, platt_fit)}


# --- SQL ------------------------------------------------------------------------

_TRIM = "' ' || chr(9) || chr(13)"


def _in(words: tuple[str, ...], col: str) -> str:
    return " OR ".join(f"contains({col}, '{w}')" for w in words)


M_CTE = f"""m AS (SELECT row_id, type, replace(coalesce(commit_message, ''), chr(13), '') AS m FROM (SELECT DISTINCT row_id, type, commit_message FROM commit_pool)),
ml AS (SELECT *, list_filter(list_transform(string_split(m, chr(10)), lambda x: trim(x, {_TRIM})), lambda x: x <> '') AS ls FROM m), ms AS (SELECT *, coalesce(ls[1], '') AS subject, ' ' || lower(m) || ' ' AS low FROM ml),
mf AS (SELECT row_id, type, ls, length(subject)::BIGINT AS subject_len, greatest(len(ls) - 1, 0)::BIGINT AS body_lines, len(list_filter(regexp_split_to_array(m, '\\n[ \\t\\n]*\\n'), lambda x: regexp_replace(x, '[ \\t\\n]', '', 'g') <> ''))::BIGINT AS paragraphs,
 regexp_matches(subject, '{sg.PREFIX}') AS prefix_match, regexp_extract(subject, '{sg.PREFIX}', 1) AS prefix_type, regexp_matches(m, '(^|\\n)[ \\t]*[*-] ') OR {_in(sg.MULTI_MARKERS, 'low')} AS multi,
 regexp_matches(low, '\\b({"|".join(sg.NOISY_MARKERS)})\\b') AS noisy, {_in(sg.RELEASE_MARKERS, 'low')} AS release_like, len(regexp_extract_all(m, '{sg.ISSUE}'))::BIGINT AS issue_refs FROM ms)"""
_CHANGED = "regexp_matches(x, '^[+-]') AND NOT regexp_matches(x, '^(\\+\\+\\+|---)')"
_ROLE = "CASE " + " ".join(f"WHEN regexp_matches(lower(p), '{form}') THEN '{role}'" for role, form in sg.ROLE_FORMS) + " ELSE 'source' END"
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(x, '{form}') THEN '{kind}'" for kind, form in sg.EDIT_FORMS) + " ELSE 'other' END"
_NO = "[" + ", ".join(f"'{w}'" for w in sg.NO_MODULE) + "]"
_KINDS = [*[k for k, _ in sg.EDIT_FORMS], "other"]
_ROLES = [*[r for r, _ in sg.ROLE_FORMS], "source"]
_count = lambda col, names: "[" + ", ".join(f"len(list_filter({col}, lambda k: k = '{n}'))" for n in names) + "]"
D_CTE = f"""d0 AS (SELECT row_id, repo, type, coalesce(git_diff, '') AS d FROM (SELECT DISTINCT row_id, repo, type, git_diff FROM commit_pool)),
d1 AS (SELECT *, string_split(chr(10) || d, chr(10) || 'diff --git ')[2:] AS ps, string_split(d, chr(10)) AS rs FROM d0),
d2 AS (SELECT row_id, repo, type, list_transform(ps, lambda p: regexp_extract(replace(string_split(p, chr(10))[1], chr(13), ''), '^a/(.+?) b/(.+)$', 2)) AS paths, list_transform(ps, lambda p: len(list_filter(string_split(p, chr(10)), lambda x: {_CHANGED}))) AS pf,
 list_filter(rs, lambda x: starts_with(x, '@@')) AS hs, list_transform(list_filter(rs, lambda x: {_CHANGED}), lambda x: trim(substr(x, 2), {_TRIM})) AS ch FROM d1),
d3 AS (SELECT *, list_transform(ch, lambda x: {_KIND}) AS ks, list_transform(paths, lambda p: {_ROLE}) AS roles, list_distinct(list_filter(list_transform(hs, lambda x: trim(regexp_extract(x, '@@.*@@[ \\t]*(.+)$', 1), {_TRIM})), lambda x: x <> '')) AS meth,
 list_transform(list_filter(paths, lambda p: ({_ROLE}) = 'source'), lambda p: list_filter(string_split(lower(p), '/'), lambda x: x <> '')) AS sp FROM d2),
d4 AS (SELECT *, {_count('ks', _KINDS)} AS kc, {_count('roles', _ROLES)} AS rc, CASE WHEN len(list_filter(pf, lambda x: x > 0)) > 0 THEN list_filter(pf, lambda x: x > 0) ELSE list_transform(paths, lambda p: 1) END AS gc,
 list_distinct(list_transform(sp, lambda f: coalesce(list_filter(f, lambda x: NOT list_contains({_NO}, x))[1], f[1], ''))) AS mods FROM d3),
df AS (SELECT row_id, repo, type, len(paths)::BIGINT AS file_count, len(hs)::BIGINT AS hunk_count, len(ch)::BIGINT AS changed, len(mods)::BIGINT AS module_count, len(meth)::BIGINT AS method_count, list_sort(list_distinct(roles)) AS role_list, ch,
 coalesce(1 - list_sum(list_transform(gc, lambda x: (x / list_sum(gc)) * (x / list_sum(gc)))), 0) AS file_gini, coalesce(-list_sum(list_transform(list_filter(kc, lambda x: x > 0), lambda x: x / list_sum(kc) * ln(x / list_sum(kc) + 1e-9))), 0) AS edit_entropy,
 CASE WHEN len(ks) > 0 THEN list_max(kc) / len(ks) ELSE 0 END AS dominant_edit, CASE WHEN len(paths) > 0 THEN list_max(rc) / len(paths) ELSE 0 END AS role_purity FROM d4)"""


def _q(src: str, col: str, q: str, where: str = "true") -> str:
    return f"(SELECT v FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM (SELECT {col}::DOUBLE AS v FROM {src} WHERE {where})) WHERE i = round_even((n - 1) * {q}::DOUBLE, 0))"


_MB = f"""mb AS (SELECT greatest(1, {_q('mf', 'subject_len', '0.1', 'subject_len > 0')}) AS subject_min, greatest(1, {_q('mf', 'subject_len', '0.9', 'subject_len > 0')}) AS subject_max, {_q('mf', 'body_lines', '0.5')} AS body_compact, {_q('mf', 'body_lines', '0.85')} AS body_fragmented,
 {_q('mf', 'paragraphs', '0.5')} AS paragraph_compact, {_q('mf', 'paragraphs', '0.85')} AS paragraph_fragmented)"""
_SCOPES = (("file_count", "file"), ("changed", "patch"), ("hunk_count", "hunk"), ("module_count", "module"))
_SB = "sb AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, {_q('df', c, '(1/3)')} AS small_max, {_q('df', c, '(2/3)')} AS medium_max, {_q('df', c, '0.9')} AS large_min" for c, _ in _SCOPES) + ")"
_TV = """tg AS (SELECT type, count(*)::DOUBLE AS n FROM (SELECT DISTINCT row_id, type FROM commit_pool) WHERE type <> '' GROUP BY type), tv AS (SELECT type, (n - avg(n) OVER ()) / sum(n) OVER () / greatest(stddev_pop(n) OVER () / sum(n) OVER (), 1e-9) AS z FROM tg)"""


def _ramp(v: str, n: str) -> str:
    lo, hi = f"(SELECT small_max FROM sb WHERE name = '{n}')", f"(SELECT large_min FROM sb WHERE name = '{n}')"
    return f"CASE WHEN {hi} <= {lo} THEN 0 ELSE 1 - 2 * (greatest({lo}, least({hi}, {v}::DOUBLE)) - {lo}) / ({hi} - {lo}) END"


_SIG = f"""sg AS (SELECT mf.row_id, CASE WHEN prefix_match THEN 1.0 ELSE -1.0 END::DOUBLE AS prefix_valid, CASE WHEN subject_len BETWEEN round_even(subject_min, 0) AND round_even(subject_max, 0) THEN 1.0 ELSE -1.0 END::DOUBLE AS subject_compact,
 CASE WHEN body_lines <= round_even(body_compact, 0) AND paragraphs <= round_even(paragraph_compact, 0) THEN 1.0 WHEN body_lines >= round_even(body_fragmented, 0) OR paragraphs >= round_even(paragraph_fragmented, 0) THEN -1.0 ELSE 0.0 END::DOUBLE AS body_compact,
 CASE WHEN multi THEN -1.0 ELSE 1.0 END::DOUBLE AS single_focus, CASE WHEN noisy THEN -1.0 ELSE 1.0 END::DOUBLE AS clean_message, CASE WHEN release_like THEN -1.0 ELSE 1.0 END::DOUBLE AS not_release,
 coalesce(tv.z, (SELECT median(z) FROM tv), 0) AS type_signal, {_ramp('file_count', 'file_count')} AS file_scope, {_ramp('changed', 'changed')} AS patch_scope, {_ramp('hunk_count', 'hunk_count')} AS hunk_scope,
 CASE WHEN len(role_list) = 0 THEN 0.0 WHEN len(role_list) = 1 THEN 1.0 WHEN list_contains(role_list, 'source') AND len(list_filter(role_list, lambda r: r = 'ci')) = 0 THEN 1 - (len(role_list) - 1) / 5.0 ELSE -1.0 END::DOUBLE AS role_focus,
 CASE WHEN module_count = 0 THEN 1.0 ELSE {_ramp('module_count', 'module_count')} END::DOUBLE AS module_focus FROM mf JOIN df USING (row_id) LEFT JOIN tv ON tv.type = mf.type, mb)"""
_ALL = f"WITH {M_CTE}, {D_CTE}, {_MB}, {_SB}, {_TV}, {_SIG}"
_SD = "sd AS (SELECT " + ", ".join(f"greatest(stddev_pop({c}), 1e-6) AS {c}" for c in so.SIGNALS) + " FROM sg), st AS (SELECT *, " + " + ".join(so.SIGNALS) + " AS total FROM sd)"
_SCORE = "x AS (SELECT sg.row_id, " + " + ".join(f"st.{c} / total * sg.{c}" for c in so.SIGNALS) + " AS pooled FROM sg, st), y AS (SELECT row_id, (pooled - (SELECT median(pooled) FROM x)) / greatest((SELECT stddev_pop(pooled) FROM x), 1e-6) AS logit FROM x)"
_P = "p AS (SELECT {c} AS p FROM (SELECT DISTINCT log_id, message_score FROM commit_log) WHERE message_score IS NOT NULL AND NOT isnan(message_score))"
_CLIP = "greatest(1e-8, least(1 - 1e-8, message_score::DOUBLE))"


def oracle_sql() -> dict[str, str]:
    h = "(-(q * ln(q) + (1 - q) * ln(1 - q)) / 0.6931471805599453)"
    return {
        "message_profile": f"""WITH {M_CTE}, t AS (SELECT row_id, l, unnest(regexp_extract_all(lower(ls[l]), '[a-z_][a-z0-9_]+')) AS w FROM (SELECT row_id, ls, unnest(generate_series(1, len(ls))) AS l FROM mf)), c AS (SELECT row_id, l, w, count(*) AS n FROM t GROUP BY ALL), r AS (SELECT row_id, l, max(n) / sum(n) AS r FROM c GROUP BY row_id, l), g AS (SELECT row_id, sum(r) AS s FROM r GROUP BY row_id)
 SELECT row_id, {', '.join(MESSAGE)}, issue_refs = 1 AS single_issue, round(coalesce(s / len(ls), 0), 6) AS tightness FROM mf LEFT JOIN g USING (row_id)""",
        "diff_profile": f"""WITH {D_CTE}, c AS (SELECT row_id, w, count(*) AS n FROM (SELECT row_id, unnest(regexp_extract_all(lower(array_to_string(ch, chr(10))), '[a-z_][a-z0-9_]+')) AS w FROM df) GROUP BY ALL), r AS (SELECT row_id, n, row_number() OVER (PARTITION BY row_id ORDER BY n DESC) AS k FROM c), g AS (SELECT row_id, sum(n) FILTER (k <= 3) / sum(n) AS f FROM r GROUP BY row_id)
 SELECT row_id, {', '.join(DIFF)}, array_to_string(role_list, ',') AS roles, {', '.join(f'round({c}, 6) AS {c}' for c in SHARES)}, round(coalesce(f, 0), 6) AS identifier_focus FROM df LEFT JOIN g USING (row_id)""",
        "message_bounds": f"WITH {M_CTE}, {_MB} SELECT * FROM mb",
        "scope_bounds": f"WITH {D_CTE}, {_SB} SELECT * FROM sb",
        "feature_stats": f"WITH {D_CTE}, x AS (SELECT {repo_sql('repo')} AS repo, file_count, hunk_count, changed, module_count, file_gini, edit_entropy FROM df WHERE file_count > 0) SELECT repo, count(*) AS n, "
        + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_sd" for c in ("file_count", "hunk_count", "changed", "module_count", "file_gini", "edit_entropy")) + " FROM x WHERE repo IS NOT NULL GROUP BY ROLLUP (repo)",
        "type_values": f"WITH {_TV} SELECT type, round(z, 6) AS z, round(median(z) OVER (), 6) AS default_z FROM tv",
        "signal_values": f"{_ALL} SELECT row_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in so.SIGNALS) + " FROM sg",
        "signal_weights": f"{_ALL}, {_SD} " + " UNION ALL ".join(f"SELECT '{c}' AS signal, round({c} / total, 6) AS weight FROM st" for c in so.SIGNALS),
        "intent_scores": f"{_ALL}, {_SD}, {_SCORE} SELECT row_id, round(logit, 4) AS logit, round(100 * greatest(1e-8, least(1 - 1e-8, 1 / (1 + exp(-logit)))), 3) AS score FROM y",
        "signal_reasons": f"{_ALL}, u AS (" + " UNION ALL ".join(f"SELECT row_id, {i} AS i, '{c}' AS name, {c} AS v FROM sg WHERE {c} <> 0" for i, c in enumerate(so.SIGNALS)) + "), f AS (SELECT row_id, arg_min(CASE WHEN v > 0 THEN 'pos:' ELSE 'neg:' END || name, k) AS reason FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(v) DESC, i) AS k FROM u) GROUP BY row_id) SELECT reason, count(*) AS n FROM sg LEFT JOIN f USING (row_id) GROUP BY reason",
        "score_bins": f"WITH {_P.format(c=_CLIP)}, b AS (SELECT " + ", ".join(f"{_q('p', 'p', str(i / 4))} AS b{i}" for i in range(5)) + "), c AS (SELECT CASE " + " ".join(f"WHEN p >= b{i} THEN {3 - i}" for i in reversed(range(4))) + " ELSE 3 END AS bin, count(*) AS n FROM p, b GROUP BY 1) SELECT bin, round(lower, 6) AS lower, round(upper, 6) AS upper, coalesce(n, 0) AS n FROM ("
        + " UNION ALL ".join(f"SELECT {3 - i} AS bin, b{i} AS lower, b{i + 1} AS upper FROM b" for i in range(4)) + ") LEFT JOIN c USING (bin)",
        "entropy_gate": f"WITH {_P.format(c='greatest(0, least(1, message_score::DOUBLE))')}, e AS (SELECT p, {h} AS h FROM (SELECT p, greatest(1e-8, least(1 - 1e-8, p)) AS q FROM p)), t AS (SELECT p, avg(h) OVER w AS m, count(*) OVER w AS n FROM e WINDOW w AS (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), ok AS (SELECT * FROM t WHERE m <= (SELECT median(h) FROM e) + 1e-12) SELECT coalesce((SELECT min(p) FROM ok), (SELECT min(p) FROM e)) AS gate, coalesce((SELECT max(n) FROM ok), (SELECT count(*) FROM e)) AS selected",
        "confidence_weights": f"WITH {_P.format(c='message_score::DOUBLE')}, a AS (SELECT median(p) AS m, stddev_pop(p) AS sd FROM p), z AS (SELECT p, greatest(1e-8, least(1 - 1e-8, p)) AS q, abs(p - m) / (sd + 1e-9) AS z FROM p, a) SELECT least(9, floor(p * 10))::INT AS tenth, count(*) AS n, round(avg((1 - {h}) * (1 - z / (1 + z))), 6) AS mean_weight FROM z GROUP BY 1",
    }
