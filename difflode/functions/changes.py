"""Features of commit messages, paths and diffs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_nonempty(*cols: Column) -> Column:
    """The first of the columns that is neither null nor blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])


def subject_line(message: Column) -> Column:
    """The first line that is not blank, trimmed; null if there is none."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(message, "\r", ""), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(lines) > 0, F.element_at(lines, 1))


def message_features(message: Column) -> dict[str, Column]:
    """Counts and markers of a message; zeros and false for a null or empty one."""
    m = F.regexp_replace(F.coalesce(message, F.lit("")), "\r", "")
    lines = F.filter(F.split(m, "\n"), lambda x: F.trim(x) != "")
    subject = F.coalesce(subject_line(m), F.lit(""))
    low = F.lower(subject)
    return {
        "subject": subject,
        "n_chars": F.length(m).cast("bigint"),
        "n_lines": F.size(lines).cast("bigint"),
        "subject_chars": F.length(subject).cast("bigint"),
        "n_bullets": F.size(F.filter(lines, lambda x: x.rlike(r"^[ \t]*([-*]|[0-9]+[.)])[ \t]"))).cast("bigint"),
        "n_paragraphs": F.size(F.filter(F.split(m, "\n[ \t]*\n"), lambda x: F.trim(F.regexp_replace(x, "[\n\t]", "")) != "")).cast("bigint"),
        "prefix": F.regexp_extract(low, r"^([a-z]+)(\([^)]*\))?!?: ", 1),
        "is_breaking": m.rlike(r"BREAKING[ -]CHANGE") | low.rlike(r"^[a-z]+(\([^)]*\))?!: "),
        "has_issue": m.rlike(r"#[0-9]+"),
        "has_trailer": m.rlike(r"(^|\n)[A-Z][A-Za-z]+-[A-Za-z-]+: "),
        "is_noise": low.rlike(r"^(merge |revert |wip|fixup!|squash!|bump |release )"),
        "multi_marker": low.rlike(r"( and | also |; | plus |, )"),
    }


ROLES = ("test", "ci", "docs", "build", "config", "source")


def path_role(path: Column) -> Column:
    """The role of a file by its path; the first matching step of the ladder wins."""
    p = F.lower(F.regexp_replace(path, r"\\", "/"))
    return (
        F.when(p.isNull() | (F.trim(p) == ""), "unknown")
        .when(p.rlike(r"(^|/)(test|tests|__tests__|spec)/|(^|/)test_[^/]*$|[._](test|spec)\.[a-z]+$"), "test")
        .when(p.rlike(r"(^|/)(\.github|\.gitlab|\.circleci|ci)/|(^|/)(jenkinsfile|\.travis\.yml)$"), "ci")
        .when(p.rlike(r"(^|/)(doc|docs)/|\.(md|rst|txt|adoc)$"), "docs")
        .when(p.rlike(r"(^|/)(build|scripts|tools)/|(^|/)(makefile|dockerfile|cmakelists\.txt|pom\.xml|build\.gradle)$"), "build")
        .when(p.rlike(r"(^|/)(config|conf)/|\.(ya?ml|json|toml|ini|cfg|lock)$"), "config")
        .when(p.rlike(r"\.(py|js|ts|go|c|h|cc|cpp|java|rs|sh|rb|cs|kt|scala|php|swift)$"), "source")
        .otherwise("other")
    )


def module_of(path: Column) -> Column:
    """The first folder of a path, ``.`` for a file at the root."""
    p = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./|/)+", "")
    return F.when(p.contains("/"), F.substring_index(p, "/", 1)).otherwise(".")


def diff_counts(diff: Column) -> dict[str, Column]:
    """Files, hunks, added and deleted lines of a unified diff, and how its changes spread over files."""
    whole = F.split(F.concat(F.lit("\n"), F.coalesce(diff, F.lit(""))), "\ndiff --git ")
    parts = F.slice(whole, F.lit(2), F.size(whole))

    def lines(part: Column, sign: str, head: str) -> Column:
        return F.size(F.filter(F.split(part, "\n"), lambda x: x.startswith(sign) & ~x.startswith(head)))

    added = F.transform(parts, lambda p: lines(p, "+", "+++"))
    deleted = F.transform(parts, lambda p: lines(p, "-", "---"))
    changed = F.zip_with(added, deleted, lambda a, b: a + b)
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x).cast("bigint")
    return {
        "n_files": F.size(parts).cast("bigint"),
        "n_hunks": F.size(F.filter(F.split(F.coalesce(diff, F.lit("")), "\n"), lambda x: x.startswith("@@ "))).cast("bigint"),
        "added": add(added),
        "deleted": add(deleted),
        "changed": add(changed),
        "per_file": changed,
    }


def hunk_range(patch: Column) -> dict[str, Column]:
    """Start and length of the old and new side in the first hunk header; a missing length is 1."""
    rx = r"@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"
    part = lambda i: F.nullif(F.regexp_extract(patch, rx, i), F.lit("")).cast("bigint")
    return {"old_start": part(1), "old_len": F.coalesce(part(2), F.when(part(1).isNotNull(), F.lit(1))), "new_start": part(3), "new_len": F.coalesce(part(4), F.when(part(3).isNotNull(), F.lit(1)))}


def normalized_subject(subject: Column) -> Column:
    """Lower case, letters and digits only, single blanks."""
    return F.trim(F.regexp_replace(F.lower(subject), r"[^a-z0-9]+", " "))


def parse_binary_label(label: Column) -> Column:
    """1, 0 or null (abstain) from the spellings of yes and no."""
    s = F.lower(F.trim(label))
    return F.when(s.isin("1", "true", "yes", "y", "positive"), 1).when(s.isin("0", "false", "no", "n", "negative"), 0)
