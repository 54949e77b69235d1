"""Profiles of messages and diffs for scoring how many intents a change has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from difflode.functions.scores import entropy_of, gini_of

# Markers of several intents, of drafts and of releases, and what the forms of subjects, references and identifiers are.
MULTI_MARKERS = (";", " also ", " additionally ", " meanwhile ", " plus ", " follow-up ", " follow up ")
NOISY_MARKERS = ("wip", "save", "fixup", "tmp", "todo", "qs")
RELEASE_MARKERS = ("release", "version bump", "bump version")
PREFIX = r"^([a-z]+)(?:\([^)]+\))?(!)?: (.+)$"
ISSUE = r"(?i)(?:#[0-9]+|(?:issue|fixe?[sd]?|close[sd]?)[ \t\n]*#?[0-9]+)"
TOKEN = r"[a-zA-Z_][a-zA-Z0-9_]+"
# Folders that name no module, and the ladder of file roles; the first role whose form matches the lower-case path counts.
NO_MODULE = ("", ".", "..", "__pycache__", "src", "lib", "app", "apps", "packages", "pkg", "core", "internal", "tests", "test", "docs")
ROLE_FORMS = (
    ("docs", r"(^|/)docs/|(^|/)(readme\.md|readme\.rst|changelog\.md|changes\.md)$|\.(md|rst|adoc)$"),
    ("ci", r"^\.github/workflows/|^\.circleci/|^\.travis\.yml$|\.github/workflows\.yml$"),
    ("test", r"/(test|tests|spec|__tests__)/|(^|/)test_[^/]*$|(_test\.py|_test\.go|\.spec\.ts|\.spec\.js|\.test\.ts|\.test\.js)$"),
    ("build", r"(^|/)(package\.json|package-lock\.json|pnpm-lock\.yaml|yarn\.lock|cargo\.toml|cargo\.lock|pom\.xml|build\.gradle|gradle\.properties|requirements\.txt|makefile|dockerfile)$"),
    ("config", r"\.(json|yaml|yml|toml|ini|cfg)$|/config/|(^|/)(\.editorconfig|tsconfig|eslint)[^/]*$"),
)
# The forms of a changed line, in the order in which they are tried.
EDIT_FORMS = (("import", r"^(import|from) "), ("declaration", r"^(class|def|function|interface|type)[ \t]"), ("comment", r"^(#|//|/\*|\*)"), ("call", r"\(.*\)|\).*\("), ("assignment", r"[=:]"))


def _plain(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\r]+|[ \t\r]+$", "")


def message_profile(message: Column) -> dict[str, Column]:
    """Features of a message by name; an empty or null message has zeros."""
    m = F.regexp_replace(F.coalesce(message, F.lit("")), "\r", "")
    lines = F.filter(F.transform(F.split(m, "\n"), _plain), lambda x: x != "")
    subject = F.coalesce(F.when(F.size(lines) > 0, F.element_at(lines, 1)), F.lit(""))
    low = F.concat(F.lit(" "), F.lower(m), F.lit(" "))
    has = lambda words: F.array_max(F.array(*[low.contains(w) for w in words]))
    bullets = m.rlike(r"(^|\n)[ \t]*[*-] ")
    refs = F.regexp_count(m, F.lit(ISSUE))
    return {
        "subject_len": F.length(subject).cast("bigint"),
        "body_lines": F.greatest(F.size(lines) - 1, F.lit(0)).cast("bigint"),
        "paragraphs": F.size(F.filter(F.split(m, r"\n[ \t\n]*\n"), lambda x: F.regexp_replace(x, r"[ \t\n]", "") != "")).cast("bigint"),
        "prefix_match": subject.rlike(PREFIX),
        "prefix_type": F.regexp_extract(subject, PREFIX, 1),
        "multi": bullets | has(MULTI_MARKERS),
        "noisy": low.rlike(r"\b(" + "|".join(NOISY_MARKERS) + r")\b"),
        "release_like": has(RELEASE_MARKERS),
        "issue_refs": refs.cast("bigint"),
    }


def tightness(df: DataFrame, key: str, message: Column) -> DataFrame:
    """``key, tightness``: the mean over non-blank lines of the share of a line's most frequent identifier; lines without one count as 0.

    Lines and tokens are rows, so a message of any length is counted in linear work.
    """
    lines = F.filter(F.split(F.regexp_replace(F.coalesce(message, F.lit("")), "\r", ""), "\n"), lambda x: F.regexp_replace(x, r"[ \t]", "") != "")
    x = df.select(key, F.posexplode(lines).alias("__line", "__text"))
    t = x.select(key, "__line", F.explode_outer(F.regexp_extract_all(F.lower("__text"), F.lit(r"[a-z_][a-z0-9_]+"), 0)).alias("__t"))
    c = t.groupBy(key, "__line", "__t").agg(F.count("__t").alias("n"))
    r = c.groupBy(key, "__line").agg(F.coalesce(F.try_divide(F.max("n").cast("double"), F.sum("n")), F.lit(0.0)).alias("r"))
    return r.groupBy(key).agg(F.avg("r").alias("tightness"))


def role_of(path: Column) -> Column:
    """The role of a file by the first form that its path has; source if none."""
    p, out = F.lower(path), None
    for role, form in ROLE_FORMS:
        out = F.when(p.rlike(form), role) if out is None else out.when(p.rlike(form), role)
    return out.otherwise("source")


def primary_module(path: Column) -> Column:
    """The first folder or name of a path that names a module, else the first part."""
    parts = F.filter(F.split(F.lower(path), "/"), lambda x: x != "")
    named = F.filter(parts, lambda x: ~x.isin(*NO_MODULE))
    return F.when(F.size(parts) == 0, "").otherwise(F.coalesce(F.get(named, 0), F.get(parts, 0)))


def changed_lines(diff: Column) -> Column:
    """Contents of the added and deleted lines, trimmed; file headers are left out."""
    rows = F.filter(F.split(F.coalesce(diff, F.lit("")), "\n"), lambda x: x.rlike(r"^[+-]") & ~x.rlike(r"^(\+\+\+|---)"))
    return F.transform(rows, lambda x: _plain(F.substring(x, F.lit(2), F.length(x))))


def _same(name: str):
    return lambda x: F.when(x == name, 1)


def diff_profile(diff: Column) -> dict[str, Column]:
    """Features of a diff by name; without a diff all are zero. The share of the three most frequent identifiers is ``identifier_focus``, a table."""
    d = F.coalesce(diff, F.lit(""))
    whole = F.split(F.concat(F.lit("\n"), d), "\ndiff --git ")
    parts = F.slice(whole, F.lit(2), F.size(whole))
    paths = F.transform(parts, lambda p: F.regexp_extract(F.regexp_replace(F.substring_index(p, "\n", 1), "\r", ""), r"^a/(.+?) b/(.+)$", 2))
    per_file = F.transform(parts, lambda p: F.size(F.filter(F.split(p, "\n"), lambda x: x.rlike(r"^[+-]") & ~x.rlike(r"^(\+\+\+|---)"))))
    hunks = F.filter(F.split(d, "\n"), lambda x: x.startswith("@@"))
    methods = F.array_distinct(F.filter(F.transform(hunks, lambda x: _plain(F.regexp_extract(x, r"@@.*@@[ \t]*(.+)$", 1))), lambda x: x != ""))
    kind = lambda x: F.coalesce(*[F.when(x.rlike(form), name) for name, form in EDIT_FORMS], F.lit("other"))
    kinds = F.transform(changed_lines(diff), kind)
    tally = lambda values, names: F.array(*[F.size(F.array_compact(F.transform(values, _same(n)))) for n in names])
    counts = tally(kinds, [*[n for n, _ in EDIT_FORMS], "other"])
    used = F.filter(counts, lambda c: c > 0)
    roles = F.transform(paths, role_of)
    role_counts = tally(roles, [*[n for n, _ in ROLE_FORMS], "source"])
    source = F.filter(paths, lambda p: role_of(p) == "source")
    touched = F.filter(per_file, lambda c: c > 0)
    ones = F.transform(paths, lambda p: F.lit(1))
    return {
        "file_count": F.size(parts).cast("bigint"), "hunk_count": F.size(hunks).cast("bigint"), "changed": F.size(kinds).cast("bigint"),
        "role_list": F.array_sort(F.array_distinct(roles)), "module_count": F.size(F.array_distinct(F.transform(source, primary_module))).cast("bigint"),
        "file_gini": gini_of(F.when(F.size(touched) > 0, touched).otherwise(ones)), "method_count": F.size(methods).cast("bigint"),
        "edit_entropy": entropy_of(used), "dominant_edit": F.coalesce(F.try_divide(F.array_max(counts).cast("double"), F.size(kinds)), F.lit(0.0)),
        "role_purity": F.coalesce(F.try_divide(F.array_max(role_counts).cast("double"), F.size(parts)), F.lit(0.0)),
    }


def identifier_focus(df: DataFrame, key: str, diff: Column) -> DataFrame:
    """``key, identifier_focus``: the share of the three most frequent identifiers among all of the changed lines; records without any have no row."""
    t = df.select(key, F.explode(F.regexp_extract_all(F.lower(F.array_join(changed_lines(diff), "\n")), F.lit(r"[a-z_][a-z0-9_]+"), 0)).alias("__t"))
    c = t.groupBy(key, "__t").agg(F.count(F.lit(1)).alias("n"))
    top = F.slice(F.sort_array(F.collect_list("n"), asc=False), 1, 3)
    return c.groupBy(key).agg((F.aggregate(top, F.lit(0).cast("bigint"), lambda a, x: a + x) / F.sum("n")).alias("identifier_focus"))


def ramp(value: Column, compact: Column, wide: Column) -> Column:
    """1 up to the compact bound, -1 from the wide one on, linear between; 0 where the bounds are out of order."""
    v = F.greatest(compact, F.least(wide, value.cast("double")))
    return F.when(wide <= compact, 0.0).otherwise(1.0 - 2.0 * (v - compact) / (wide - compact))


def role_focus(roles: Column) -> Column:
    """1 for one role, a little less for source with supporting roles, -1 for other mixtures, 0 for none."""
    n = F.size(roles)
    support = F.forall(roles, lambda r: r.isin("source", "test", "docs", "config", "build"))
    return F.when(n == 0, 0.0).when(n == 1, 1.0).when(F.array_contains(roles, "source") & support, 1.0 - (n - 1) / 5.0).otherwise(-1.0)
