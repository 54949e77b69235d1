"""Queries of rules on subjects, messages, paths and tokens, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from difflode.catalog.scoring import D_CTE, M_CTE
from difflode.functions import signals as sg
from difflode.operators.metrics import r6
from difflode.operators.ranking import rank_within
from difflode.operators.scoring import quantiles
from difflode.plans.lineage import cut
from difflode.sources.tables import table as T

# Words of adding and removing, words that carry no meaning, forms that take something back, empty phrases, verbs that open a subject, connectors of actions.
POSITIVE = ("add", "enable", "allow", "introduce", "support", "create", "improve", "upgrade", "update", "migrate", "refactor", "optimize")
NEGATIVE = ("remove", "disable", "drop", "deprecate", "delete", "revert", "rollback", "undo")
SEMANTIC_STOPS = ("the", "and", "for", "with", "from", "into", "that", "this", "fix", "feat", "chore", "docs", "refactor", "test", "build", "style", "perf", "ci", "api", "code", "file")
REVERTS = r"\b(revert|rollback|roll\s+back|undo)\b"
GENERIC = ("update", "fix bug", "cleanup", "minor update", "misc changes", "changes", "wip", "tweak", "improve", "refactor", "work in progress")
GENERIC_FORMS = r"\b(update code|improve functionality|misc(ellaneous)? changes?|cleanup|various fixes?|improve system stability)\b"
HEAD_VERBS = ("add", "allow", "avoid", "bump", "clean", "convert", "create", "disable", "drop", "enable", "fix", "handle", "implement", "improve", "introduce", "migrate", "move", "optimize", "prevent", "refactor", "remove", "rename", "replace", "set", "simplify", "support", "update", "use")
CONNECTORS = (" and ", " also ", " plus ", " then ", " additionally ", " meanwhile ", " follow-up ", ";", " / ", " & ")
GOAL_VERBS = r"\b(add|update|remove|rename|move|switch|implement|support|fix|improve|introduce|enable|disable|migrate|validate)\b"
SUBSTANTIVE, WEAK = ("fix", "feat", "refactor", "perf", "test"), ("docs", "style", "build", "ci", "chore")
# File roles of edit units by their path; the first form that matches counts.
UNIT_ROLES = (
    ("lockfile", r"(^|/)(package-lock\.json|pnpm-lock\.yaml|yarn\.lock|poetry\.lock|cargo\.lock|pipfile\.lock|go\.sum|composer\.lock|gemfile\.lock)$"),
    ("build", r"(^|/)(makefile|dockerfile|pom\.xml|build\.gradle|setup\.py|pyproject\.toml|package\.json|cargo\.toml|go\.mod)$|cmake|docker"),
    ("generated", r"(^|/)(generated|vendor|dist)(/|$)"), ("test", r"(^|/)tests?(/|$)|(^|/)test_[^/]*$|_test\.py$"),
    ("doc", r"(^|/)(readme|changelog)\.md$|\.(md|rst|txt|adoc)$|(^|/)docs?(/|$)"), ("config", r"\.(json|ya?ml|toml|ini|cfg|conf|env)$|(^|/)(\.github|configs?)(/|$)|(^|/)\.[^/]*$"),
)


def _one(s: SparkSession, d: str, name: str, key: str, *cols: str | Column) -> DataFrame:
    return T(s, d, name).select(key, *cols).dropDuplicates([key])


def _text(*cols: str) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.trim(c), F.lit("")) for c in cols]))


def _words(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def occurrences(text: Column, part: str) -> Column:
    """How often a part occurs in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def action_count(subject: Column) -> Column:
    """One and the connectors of a subject; 0 for an empty one."""
    s = F.concat(F.lit(" "), F.lower(F.trim(F.coalesce(subject, F.lit("")))), F.lit(" "))
    return F.when(F.trim(s) == "", 0).otherwise(1 + reduce(lambda a, b: a + b, [occurrences(s, c) for c in CONNECTORS]))


def action_polarity(s, d):
    """Candidates by the polarity of their words, and whether they take something back."""
    t = _text("subject", "message")
    tokens = F.regexp_extract_all(t, F.lit("[a-z0-9]+"), 0)
    pos, neg = F.arrays_overlap(tokens, _words(POSITIVE)), F.arrays_overlap(tokens, _words(NEGATIVE))
    p = F.when(pos & neg, "mixed").when(pos, "positive").when(neg, "negative").otherwise("neutral")
    x = _one(s, d, "candidates", "sha", p.alias("polarity"), t.rlike(REVERTS).alias("is_revert"))
    return x.groupBy("polarity", "is_revert").agg(F.count(F.lit(1)).alias("n"))


def subject_signatures(s, d):
    """Signatures of subjects (sorted words that carry meaning) that several records share."""
    tokens = F.regexp_extract_all(F.regexp_replace(F.lower("subject"), r"[/_.:\-]+", " "), F.lit("[a-z0-9]+"), 0)
    sig = F.array_join(F.array_sort(F.array_distinct(F.filter(tokens, lambda x: (F.length(x) >= 3) & ~x.isin(*SEMANTIC_STOPS) & ~x.rlike("^[0-9]+$")))), "|")
    x = _one(s, d, "commit_log", "log_id", sig.alias("signature")).where("signature != ''")
    return x.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def generic_messages(s, d):
    """Candidates whose text says little, and why."""
    t = F.trim(_text("subject", "message"))
    tokens = F.array_distinct(F.filter(F.regexp_extract_all(F.translate(t, "-_", "  "), F.lit("[a-z0-9_]+"), 0), lambda x: F.length(x) >= 2))
    bank = sorted({w for g in GENERIC for w in g.split() if len(w) >= 2} | {"change", "changes", "code"})
    why = F.when(t == "", "empty").when(reduce(lambda a, b: a | b, [t.contains(g) for g in GENERIC]), "phrase").when((F.size(tokens) > 0) & (F.size(tokens) <= 3) & (F.size(F.array_except(tokens, _words(tuple(bank)))) == 0), "short").otherwise("informative")
    return _one(s, d, "candidates", "sha", why.alias("why")).groupBy("why").agg(F.count(F.lit(1)).alias("n"))


def subject_surface(s, d):
    """Surface features of candidates' subjects."""
    t = F.regexp_replace(F.coalesce("subject", F.lit("")), r"^\s+|\s+$", "")
    head = F.regexp_extract(F.regexp_replace(F.lower(t), r"^[a-z]+(\([^)]+\))?:\s*", ""), "([a-z0-9_]+)", 1)
    flag = lambda c: c.cast("int")
    return _one(
        s, d, "candidates", "sha", F.size(F.regexp_extract_all(t, F.lit("[A-Za-z0-9_]+"), 0)).alias("tokens"), flag(t.rlike(r"(?i)\band\b")).alias("has_and"), flag(t.contains(",")).alias("has_comma"),
        flag(t.rlike(r"(^|[^:A-Za-z0-9_])[a-z]+(\([^)]+\))?:")).alias("has_prefix"), flag(t.rlike("#[0-9]+")).alias("has_issue"), flag((t != "") & ~t.rlike(r"\n|(^|\n)\s*([-*]|[0-9]+\.)\s+")).alias("one_sentence"),
        flag(head.isin(*HEAD_VERBS)).alias("imperative"), flag(t.rlike("(?i)" + GENERIC_FORMS)).alias("generic"),
    )


def action_counts(s, d):
    """Pool subjects by the number of actions that they join."""
    return _one(s, d, "commit_pool", "row_id", action_count(F.col("subject")).alias("actions")).groupBy("actions").agg(F.count(F.lit(1)).alias("n"))


def audit_labels(s, d):
    """Labels of pool records by an ordered list of rules, with the rule and its confidence."""
    low = F.trim(F.regexp_replace(F.lower(F.coalesce("commit_message", F.lit(""))), r"[ \t\r\n]+", " "))
    p = sg.diff_profile(F.col("git_diff"))
    x = _one(s, d, "commit_pool", "row_id", F.coalesce(F.col("commit_message").contains("* "), F.lit(False)).alias("bullets"), low.contains(" and ").alias("conj"), F.size(F.regexp_extract_all(low, F.lit(GOAL_VERBS), 1)).alias("verbs"), p["file_count"].alias("files"), p["changed"].alias("changed"), F.size(p["role_list"]).alias("roles"))
    rules = [(F.col("bullets"), 0, 0.94, "bullet_list"), (F.col("conj") & (F.col("verbs") >= 3), 0, 0.76, "conjoined_actions"), ((F.col("files") <= 3) & (F.col("roles") <= 2) & (F.col("changed") <= 80), 1, 0.95, "compact_change"),
             ((F.col("files") <= 8) & (F.col("roles") <= 2), 1, 0.9, "cohesive_change"), ((F.col("files") <= 20) & (F.col("roles") <= 3), 1, 0.8, "moderate_scope"), (F.lit(True), 1, 0.68, "broad_scope")]
    r = F.coalesce(*[F.when(c, F.struct(F.lit(v).alias("label"), F.lit(k).alias("confidence"), F.lit(n).alias("rule"))) for c, v, k, n in rules])
    return x.select(r.alias("r")).groupBy("r.label", "r.confidence", "r.rule").agg(F.count(F.lit(1)).alias("n"))


def weak_labels(s, d):
    """Labels of pool records by rules whose bounds are quantiles of the pool: all of eleven for yes, any of four or two of six for no, else none."""
    pool = T(s, d, "commit_pool")
    m, f = sg.message_profile(F.col("commit_message")), sg.diff_profile(F.col("git_diff"))
    x = cut(pool.select("row_id", "type", *[m[c].alias(c) for c in ("prefix_match", "multi", "noisy", "release_like", "issue_refs")], action_count(F.element_at(F.split(F.coalesce("commit_message", F.lit("")), "\r?\n"), 1)).alias("actions"), f["file_count"].alias("files"), f["module_count"].alias("modules"), f["changed"].alias("changed"), F.size(f["role_list"]).alias("roles")).dropDuplicates(["row_id"]))
    q = quantiles(x, {c: [0.35, 0.4, 0.7, 0.75] for c in ("files", "modules", "changed", "roles")})
    pick = lambda c, k: F.max(F.when(F.col("name") == c, F.col(k)))
    b = q.agg(*[pick(c, "q35").alias(f"{c}_low") for c in ("files", "modules", "changed")], *[pick(c, "q75").alias(f"{c}_high") for c in ("files", "modules", "changed")], F.greatest(F.lit(1.0), pick("roles", "q40")).alias("roles_low"), F.greatest(F.lit(1.0), pick("roles", "q70")).alias("roles_high"))
    y = x.join(b, F.lit(True))
    wide = [F.col(c) >= F.col(f"{c}_high") for c in ("files", "modules", "changed", "roles")] + [F.col("issue_refs") >= 2, F.col("actions") >= 2]
    narrow = [F.col(c) <= F.col(f"{c}_low") for c in ("files", "modules", "changed", "roles")] + [F.col("issue_refs") <= 1, F.col("actions") <= 1, F.col("prefix_match"), ~F.col("multi"), ~F.col("noisy"), ~F.col("release_like"), F.coalesce(F.col("type").isin(*SUBSTANTIVE), F.lit(False))]
    stated = F.coalesce(F.col("type").isin(*WEAK), F.lit(False)) | F.col("multi") | F.col("noisy") | F.col("release_like")
    kind = F.when(reduce(lambda a, c: a & c, narrow), "positive").when(stated, "negative_stated").when(reduce(lambda a, c: a + c, [c.cast("int") for c in wide]) >= 2, "negative_structure").otherwise("abstain")
    return y.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def hashed_tokens(s, d):
    """Weights of edit units' identifiers in 256 buckets by MD5, units at length one: units and total weight of each bucket."""
    x = _one(s, d, "edit_units", "unit_id", F.filter(F.transform("identifiers", lambda v: F.lower(v)), lambda v: v.isNotNull() & (v != "")).alias("ids"))
    b = x.select("unit_id", F.explode("ids").alias("t")).select("unit_id", (F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("bigint") % 256).alias("bucket")).groupBy("unit_id", "bucket").agg(F.count(F.lit(1)).cast("double").alias("c"))
    n = b.groupBy("unit_id").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    return b.join(n, "unit_id").groupBy("bucket").agg(F.count(F.lit(1)).alias("units"), F.round(F.sum(F.col("c") / F.col("norm")), 4).alias("weight"))


def token_ids(s, d):
    """Identifiers of the edit units with the number of units and their place in the sorted vocabulary."""
    x = _one(s, d, "edit_units", "unit_id", F.array_distinct("identifiers").alias("ids")).select(F.explode("ids").alias("token")).where("token is not null")
    v = x.groupBy("token").agg(F.count(F.lit(1)).alias("units")).withColumn("g", F.lit(0))
    return rank_within(v, ["g"], [F.col("token").asc()]).select("token", "units", F.col("rank").alias("id"))


def compact_messages(s, d):
    """Messages over 200 characters cut to 70 % head and 30 % tail with a note between: how many, and the length of all."""
    t, n, most = F.coalesce("message", F.lit("")), F.length(F.coalesce("message", F.lit(""))), 200
    cut_ = F.concat(F.substring(t, 1, 140), F.lit("\n\n[... truncated "), (n - most).cast("string"), F.lit(" chars ...]\n\n"), F.substring(t, n - 59, F.lit(60)))
    x = _one(s, d, "commit_log", "log_id", (n > most).alias("was_cut"), F.length(F.when(n > most, cut_).otherwise(t)).cast("bigint").alias("chars"))
    return x.groupBy("was_cut").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))


def path_events(s, d):
    """Paths that each pool diff touches, adds, deletes and renames."""
    whole = F.split(F.concat(F.lit("\n"), F.regexp_replace(F.coalesce("git_diff", F.lit("")), "\r", "")), "\ndiff --git ")
    parts = F.slice(whole, F.lit(2), F.size(whole))
    head = lambda p: F.substring_index(p, "\n", 1)
    new = lambda ps: F.transform(ps, lambda p: F.regexp_extract(head(p), r"^a/(.+?) b/(.+)$", 2))
    both = F.concat(F.transform(parts, lambda p: F.regexp_extract(head(p), r"^a/(.+?) b/(.+)$", 1)), new(parts), F.filter(F.transform(parts, lambda p: F.regexp_extract(p, r"\nrename from ([^\n]+)", 1)), lambda x: x != ""), F.filter(F.transform(parts, lambda p: F.regexp_extract(p, r"\nrename to ([^\n]+)", 1)), lambda x: x != ""))
    size = lambda c: F.size(F.array_distinct(F.filter(c, lambda x: x != ""))).cast("bigint")
    return _one(
        s, d, "commit_pool", "row_id", size(both).alias("touched"), size(new(F.filter(parts, lambda p: p.rlike(r"\nnew file mode |\n--- /dev/null")))).alias("added"),
        size(new(F.filter(parts, lambda p: p.rlike(r"\ndeleted file mode |\n\+\+\+ /dev/null")))).alias("deleted"), F.size(F.filter(parts, lambda p: p.rlike(r"\nrename from ") & p.rlike(r"\nrename to "))).cast("bigint").alias("renamed"),
    )


def module_definitions(s, d):
    """Distinct modules of the edit units under four definitions: first telling part, first part, first two parts, folder."""
    p = F.regexp_replace(F.regexp_replace("file_path", r"\\", "/"), r"^[./]+", "")
    parts = F.split(p, "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    x = _one(s, d, "edit_units", "unit_id", sg.primary_module(p).alias("telling"), F.get(parts, 0).alias("first"), F.array_join(F.slice(parts, 1, 2), "/").alias("two"), F.array_join(dirs, "/").alias("folder"), F.col("file_path").isNotNull().alias("ok")).where("ok")
    return x.agg(*[F.count_distinct(c).alias(c) for c in ("telling", "first", "two", "folder")])


def role_taxonomies(s, d):
    """Edit units by their role in two taxonomies."""
    p = F.lower("file_path")
    other = F.coalesce(*[F.when(p.rlike(form), r) for r, form in UNIT_ROLES], F.lit("source"))
    x = _one(s, d, "edit_units", "unit_id", sg.role_of(F.col("file_path")).alias("change_role"), other.alias("unit_role"), F.col("file_path").isNotNull().alias("ok")).where("ok")
    return x.groupBy("change_role", "unit_role").agg(F.count(F.lit(1)).alias("n"))


def url_repos(s, d):
    """Repositories and ids in the addresses of pool records: how many have them, and how many agree with the record."""
    u = F.coalesce("commit_url", F.lit(""))
    rx = r"^https?://[^/]+/([^/]+/[^/]+)/commit/([0-9a-fA-F]+)"
    x = _one(s, d, "commit_pool", "row_id", F.lower(F.regexp_extract(u, rx, 1)).alias("repo"), (F.lower(F.regexp_extract(u, rx, 2)) == F.lower("sha")).alias("same"))
    return x.groupBy((F.col("repo") != "").alias("has_repo")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("repo").alias("repos"), F.sum(F.coalesce("same", F.lit(False)).cast("bigint")).alias("same_id"))


def message_grounding(s, d):
    """Share of a pool message's words that occur among the words of its diff, by type."""
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]+"), 0), lambda x: F.length(x) >= 4))
    x = _one(s, d, "commit_pool", "row_id", "type", words(F.col("commit_message")).alias("m"), words(F.col("git_diff")).alias("e")).where("size(m) > 0")
    return x.select("type", (F.size(F.array_intersect("m", "e")) / F.size("m")).alias("r")).groupBy("type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("r")).alias("grounded"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (action_polarity, subject_signatures, generic_messages, subject_surface, action_counts, audit_labels, weak_labels, hashed_tokens, token_ids, compact_messages, path_events, module_definitions, role_taxonomies, url_repos, message_grounding)
    return {f.__name__: f for f in own}


# --- SQL ------------------------------------------------------------------------

def _list(values: tuple[str, ...] | list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _case(col: str, forms: tuple[tuple[str, str], ...], default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '{f}') THEN '{n}'" for n, f in forms) + f" ELSE '{default}' END"


def _joined(a: str, b: str) -> str:
    return f"lower(coalesce(trim({a}), '') || ' ' || coalesce(trim({b}), ''))"


def _actions(col: str) -> str:
    s = f"(' ' || lower(trim(coalesce({col}, ''))) || ' ')"
    return f"CASE WHEN trim({s}) = '' THEN 0 ELSE 1 + " + " + ".join(f"(length({s}) - length(replace({s}, '{c}', ''))) // {len(c)}" for c in CONNECTORS) + " END"


def oracle_sql() -> dict[str, str]:
    cand = "(SELECT DISTINCT sha, subject, message FROM candidates)"
    bank = sorted({w for g in GENERIC for w in g.split() if len(w) >= 2} | {"change", "changes", "code"})
    quant = lambda c, q: f"(SELECT v FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM (SELECT {c}::DOUBLE AS v FROM x)) WHERE i = round_even((n - 1) * {q}::DOUBLE, 0))"
    unit_role = _case("lower(file_path)", UNIT_ROLES, "source")
    change_role = _case("lower(file_path)", sg.ROLE_FORMS, "source")
    words4 = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z]+'), lambda x: length(x) >= 4))"
    return {
        "action_polarity": f"WITH t AS (SELECT {_joined('subject', 'message')} AS t FROM {cand}), p AS (SELECT t, list_has_any(regexp_extract_all(t, '[a-z0-9]+'), {_list(POSITIVE)}) AS a, list_has_any(regexp_extract_all(t, '[a-z0-9]+'), {_list(NEGATIVE)}) AS b FROM t) SELECT CASE WHEN a AND b THEN 'mixed' WHEN a THEN 'positive' WHEN b THEN 'negative' ELSE 'neutral' END AS polarity, regexp_matches(t, '{REVERTS}') AS is_revert, count(*) AS n FROM p GROUP BY ALL",
        "subject_signatures": f"WITH t AS (SELECT array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(regexp_replace(lower(subject), '[/_.:\\-]+', ' ', 'g'), '[a-z0-9]+'), lambda x: length(x) >= 3 AND NOT list_contains({_list(SEMANTIC_STOPS)}, x) AND NOT regexp_matches(x, '^[0-9]+$')))), '|') AS signature FROM (SELECT DISTINCT log_id, subject FROM commit_log)) SELECT signature, count(*) AS n FROM t WHERE signature <> '' GROUP BY 1 HAVING count(*) > 1",
        "generic_messages": f"WITH t AS (SELECT trim({_joined('subject', 'message')}) AS t FROM {cand}), w AS (SELECT t, list_distinct(list_filter(regexp_extract_all(translate(t, '-_', '  '), '[a-z0-9_]+'), lambda x: length(x) >= 2)) AS ws FROM t) SELECT CASE WHEN t = '' THEN 'empty' WHEN {' OR '.join(f"contains(t, '{g}')" for g in GENERIC)} THEN 'phrase' WHEN len(ws) BETWEEN 1 AND 3 AND len(list_filter(ws, lambda x: NOT list_contains({_list(bank)}, x))) = 0 THEN 'short' ELSE 'informative' END AS why, count(*) AS n FROM w GROUP BY 1",
        "subject_surface": f"""WITH t AS (SELECT sha, regexp_replace(coalesce(subject, ''), '^\\s+|\\s+$', '', 'g') AS t FROM {cand})
 SELECT sha, len(regexp_extract_all(t, '[A-Za-z0-9_]+'))::INT AS tokens, regexp_matches(t, '(?i)\\band\\b')::INT AS has_and, contains(t, ',')::INT AS has_comma, regexp_matches(t, '(^|[^:A-Za-z0-9_])[a-z]+(\\([^)]+\\))?:')::INT AS has_prefix, regexp_matches(t, '#[0-9]+')::INT AS has_issue,
 (t <> '' AND NOT regexp_matches(t, '\\n|(^|\\n)\\s*([-*]|[0-9]+\\.)\\s+'))::INT AS one_sentence, list_contains({_list(HEAD_VERBS)}, regexp_extract(regexp_replace(lower(t), '^[a-z]+(\\([^)]+\\))?:\\s*', ''), '([a-z0-9_]+)', 1))::INT AS imperative, regexp_matches(t, '(?i){GENERIC_FORMS}')::INT AS generic FROM t""",
        "action_counts": f"SELECT {_actions('subject')} AS actions, count(*) AS n FROM (SELECT DISTINCT row_id, subject FROM commit_pool) GROUP BY 1",
        "audit_labels": f"""WITH {D_CTE}, t AS (SELECT row_id, coalesce(contains(commit_message, '* '), false) AS b, trim(regexp_replace(lower(coalesce(commit_message, '')), '[ \\t\\r\\n]+', ' ', 'g')) AS l FROM (SELECT DISTINCT row_id, commit_message FROM commit_pool)), x AS (SELECT *, len(regexp_extract_all(l, '{GOAL_VERBS}')) AS v, len(role_list) AS r FROM t JOIN df USING (row_id)),
 y AS (SELECT CASE WHEN b THEN 'bullet_list' WHEN contains(l, ' and ') AND v >= 3 THEN 'conjoined_actions' WHEN file_count <= 3 AND r <= 2 AND changed <= 80 THEN 'compact_change' WHEN file_count <= 8 AND r <= 2 THEN 'cohesive_change' WHEN file_count <= 20 AND r <= 3 THEN 'moderate_scope' ELSE 'broad_scope' END AS rule FROM x)
 SELECT CASE WHEN rule IN ('bullet_list', 'conjoined_actions') THEN 0 ELSE 1 END AS label, (CASE rule WHEN 'bullet_list' THEN 0.94 WHEN 'conjoined_actions' THEN 0.76 WHEN 'compact_change' THEN 0.95 WHEN 'cohesive_change' THEN 0.9 WHEN 'moderate_scope' THEN 0.8 ELSE 0.68 END)::DOUBLE AS confidence, rule, count(*) AS n FROM y GROUP BY rule""",
        "weak_labels": f"""WITH {M_CTE}, {D_CTE}, a AS (SELECT row_id, {_actions("regexp_split_to_array(coalesce(commit_message, ''), chr(13) || '?' || chr(10))[1]")} AS actions FROM (SELECT DISTINCT row_id, commit_message FROM commit_pool)),
 x AS (SELECT mf.row_id, mf.type, prefix_match, multi, noisy, release_like, issue_refs, actions, file_count AS files, module_count AS modules, changed, len(role_list) AS roles FROM mf JOIN df USING (row_id) JOIN a USING (row_id)), b AS (SELECT {', '.join(f"{quant(c, '0.35')} AS {c}_low, {quant(c, '0.75')} AS {c}_high" for c in ('files', 'modules', 'changed'))}, greatest(1, {quant('roles', '0.4')}) AS roles_low, greatest(1, {quant('roles', '0.7')}) AS roles_high)
 SELECT CASE WHEN {' AND '.join(f'{c} <= {c}_low' for c in ('files', 'modules', 'changed', 'roles'))} AND issue_refs <= 1 AND actions <= 1 AND prefix_match AND NOT multi AND NOT noisy AND NOT release_like AND coalesce(list_contains({_list(SUBSTANTIVE)}, type), false) THEN 'positive' WHEN coalesce(list_contains({_list(WEAK)}, type), false) OR multi OR noisy OR release_like THEN 'negative_stated'
 WHEN {' + '.join(f'({c} >= {c}_high)::INT' for c in ('files', 'modules', 'changed', 'roles'))} + (issue_refs >= 2)::INT + (actions >= 2)::INT >= 2 THEN 'negative_structure' ELSE 'abstain' END AS kind, count(*) AS n FROM x, b GROUP BY 1""",
        "hashed_tokens": "WITH t AS (SELECT unit_id, lower(unnest(identifiers)) AS t FROM (SELECT unit_id, any_value(identifiers) AS identifiers FROM edit_units GROUP BY unit_id)), b AS (SELECT unit_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 256 AS bucket, count(*)::DOUBLE AS c FROM t WHERE t <> '' GROUP BY ALL), n AS (SELECT unit_id, sqrt(sum(c * c)) AS norm FROM b GROUP BY 1) SELECT bucket, count(*) AS units, round(sum(c / norm), 4) AS weight FROM b JOIN n USING (unit_id) GROUP BY bucket",
        "token_ids": "WITH t AS (SELECT unnest(list_distinct(identifiers)) AS token FROM (SELECT unit_id, any_value(identifiers) AS identifiers FROM edit_units GROUP BY unit_id)) SELECT token, count(*) AS units, row_number() OVER (ORDER BY token) AS id FROM t WHERE token IS NOT NULL GROUP BY token",
        "compact_messages": "WITH t AS (SELECT coalesce(message, '') AS t, length(coalesce(message, '')) AS n FROM (SELECT DISTINCT log_id, message FROM commit_log)) SELECT n > 200 AS was_cut, count(*) AS n, sum(CASE WHEN n > 200 THEN 200 + length(chr(10) || chr(10) || '[... truncated ' || (n - 200) || ' chars ...]' || chr(10) || chr(10)) ELSE n END)::BIGINT AS chars FROM t GROUP BY 1",
        "path_events": """WITH p AS (SELECT row_id, string_split(chr(10) || replace(coalesce(git_diff, ''), chr(13), ''), chr(10) || 'diff --git ')[2:] AS ps FROM (SELECT DISTINCT row_id, git_diff FROM commit_pool)), q AS (SELECT row_id, ps, list_transform(ps, lambda p: regexp_extract(string_split(p, chr(10))[1], '^a/(.+?) b/(.+)$', 1)) AS o, list_transform(ps, lambda p: regexp_extract(string_split(p, chr(10))[1], '^a/(.+?) b/(.+)$', 2)) AS w FROM p)
 SELECT row_id, len(list_distinct(list_filter(list_concat(o, w, list_transform(ps, lambda p: regexp_extract(p, '\\nrename from ([^\\n]+)', 1)), list_transform(ps, lambda p: regexp_extract(p, '\\nrename to ([^\\n]+)', 1))), lambda x: x <> '')))::BIGINT AS touched,
 len(list_distinct(list_filter(list_transform(list_filter(ps, lambda p: regexp_matches(p, '\\nnew file mode |\\n--- /dev/null')), lambda p: regexp_extract(string_split(p, chr(10))[1], '^a/(.+?) b/(.+)$', 2)), lambda x: x <> '')))::BIGINT AS added, len(list_distinct(list_filter(list_transform(list_filter(ps, lambda p: regexp_matches(p, '\\ndeleted file mode |\\n\\+\\+\\+ /dev/null')), lambda p: regexp_extract(string_split(p, chr(10))[1], '^a/(.+?) b/(.+)$', 2)), lambda x: x <> '')))::BIGINT AS deleted,
 len(list_filter(ps, lambda p: regexp_matches(p, '\\nrename from ') AND regexp_matches(p, '\\nrename to ')))::BIGINT AS renamed FROM q""",
        "module_definitions": f"WITH u AS (SELECT string_split(regexp_replace(replace(file_path, '\\', '/'), '^[./]+', ''), '/') AS f FROM (SELECT DISTINCT unit_id, file_path FROM edit_units) WHERE file_path IS NOT NULL), v AS (SELECT f, list_filter(list_transform(f, lambda x: lower(x)), lambda x: x <> '') AS g FROM u) SELECT count(DISTINCT coalesce(list_filter(g, lambda x: NOT list_contains({_list(sg.NO_MODULE)}, x))[1], g[1], '')) AS telling, count(DISTINCT f[1]) AS first, count(DISTINCT array_to_string(f[:2], '/')) AS two, count(DISTINCT array_to_string(f[:-2], '/')) AS folder FROM v",
        "role_taxonomies": f"SELECT {change_role} AS change_role, {unit_role} AS unit_role, count(*) AS n FROM (SELECT DISTINCT unit_id, file_path FROM edit_units) WHERE file_path IS NOT NULL GROUP BY ALL",
        "url_repos": "WITH t AS (SELECT lower(regexp_extract(coalesce(commit_url, ''), '^https?://[^/]+/([^/]+/[^/]+)/commit/([0-9a-fA-F]+)', 1)) AS repo, lower(regexp_extract(coalesce(commit_url, ''), '^https?://[^/]+/([^/]+/[^/]+)/commit/([0-9a-fA-F]+)', 2)) = lower(sha) AS same FROM (SELECT DISTINCT row_id, commit_url, sha FROM commit_pool)) SELECT repo <> '' AS has_repo, count(*) AS n, count(DISTINCT repo) AS repos, sum(coalesce(same, false)::INT)::BIGINT AS same_id FROM t GROUP BY 1",
        "message_grounding": f"WITH t AS (SELECT type, {words4('commit_message')} AS m, {words4('git_diff')} AS e FROM (SELECT DISTINCT row_id, type, commit_message, git_diff FROM commit_pool)) SELECT type, count(*) AS n, round(avg(len(list_intersect(m, e)) / len(m)), 6) AS grounded FROM t WHERE len(m) > 0 GROUP BY type",
    }
