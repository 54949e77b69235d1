"""Generated, minified and vendored files told apart from hand-written source."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from difflode.functions.repo import canonical_repo
from difflode.plans.lineage import cut, stored

#: Attribute lines of common tools, the seeds of mining. A seed counts as ``SEED_FILES`` files of which ``SEED_HITS``
#: show evidence, so that it holds where there are few files and falls where many files of a collection speak against it.
EQUIVALENT_ATTRIBUTES = """
node_modules/** linguist-vendored
**/node_modules/** linguist-vendored
**/bower_components/** linguist-vendored
**/jspm_packages/** linguist-vendored
**/third_party/** linguist-vendored
**/third-party/** linguist-vendored
**/thirdparty/** linguist-vendored
**/Pods/** linguist-vendored
**/Carthage/Checkouts/** linguist-vendored
**/Godeps/_workspace/** linguist-vendored
vendor/** linguist-vendored
**/vendor/*.*/** linguist-vendored
**/site-packages/** linguist-vendored
**/*-[0-9]*.[0-9]*.[0-9]*/** linguist-vendored
*-[0-9]*.[0-9]*.[0-9]*.js linguist-vendored
*.min.js linguist-generated
*.min.css linguist-generated
*-min.js linguist-generated
*.bundle.js linguist-generated
*.bundle.css linguist-generated
*.chunk.js linguist-generated
*.chunk.css linguist-generated
*.js.map linguist-generated
*.css.map linguist-generated
*.mjs.map linguist-generated
*.ts.map linguist-generated
package-lock.json linguist-generated
npm-shrinkwrap.json linguist-generated
yarn.lock linguist-generated
pnpm-lock.yaml linguist-generated
bun.lockb linguist-generated
poetry.lock linguist-generated
Pipfile.lock linguist-generated
uv.lock linguist-generated
pdm.lock linguist-generated
Cargo.lock linguist-generated
Gemfile.lock linguist-generated
composer.lock linguist-generated
Podfile.lock linguist-generated
pubspec.lock linguist-generated
packages.lock.json linguist-generated
flake.lock linguist-generated
mix.lock linguist-generated
gradle.lockfile linguist-generated
go.sum linguist-generated
*.snap linguist-generated
**/__snapshots__/** linguist-generated
**/generated-sources/** linguist-generated
**/generated-test-sources/** linguist-generated
*_pb2.py linguist-generated
*_pb2.pyi linguist-generated
*_pb2_grpc.py linguist-generated
*.pb.go linguist-generated
*.pb.gw.go linguist-generated
*.pb.cc linguist-generated
*.pb.h linguist-generated
*_pb.js linguist-generated
*_pb.d.ts linguist-generated
*.pbobjc.h linguist-generated
*.designer.cs linguist-generated
*.Designer.cs linguist-generated
*.g.cs linguist-generated
*.g.i.cs linguist-generated
*.g.dart linguist-generated
*.g.rs linguist-generated
*.g.ts linguist-generated
*.freezed.dart linguist-generated
*.generated.* linguist-generated
*_generated.go linguist-generated
zz_generated* linguist-generated
*.tab.c linguist-generated
*.tab.h linguist-generated
*.tab.cc linguist-generated
lex.*.c linguist-generated
lex.yy.* linguist-generated
moc_*.c linguist-generated
moc_*.cpp linguist-generated
*.moc linguist-generated
qrc_*.cpp linguist-generated
"""

#: What a comment line of a generated or copied file begins with.
_MARKS = (
    r"@generated\b|<auto-?generated|code generated by\b|generated (?:by|from|file|code)\b|auto-?generated\b|automatically generated\b|machine[- ](?:written|generated)\b|"
    r"this (?:file|code) (?:is|was|has been) (?:auto-?generated|automatically generated|generated|produced automatically|machine[- ]generated)|"
    r"do not (?:edit|modify|change)(?: this file)?(?: by hand| manually|[.:;!]|\s*$)|vendored:|vendored (?:copy|from)|verbatim copy of\b|this file is a copy of"
)
MARK = rf"(?im)^[+\- ]?[ \t]*(?://+|#+|/\*+!?|\*+|--+|;+|<!--+|%+|\(\*|\"{{3}}|'{{3}})[ \t!]*(?:{_MARKS})"
SOURCE_MAP = r"(?m)^[+\- ]?\s*\{\"version\":\s*3,|\"mappings\":\s*\"[A-Za-z0-9+/,;]{20,}|^[+\- ]?\s*//[#@] sourceMappingURL="
SNAPSHOT = r"(?m)^[+\- ]?// Jest Snapshot v\d"
BLOB_LINE = r"^[+\- ]?\s*(?:[\[({]*\s*(?:[-+]?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)[uUlLfF]*\s*[,;]\s*){4,}[^A-Za-z_]*[0-9a-fA-FxX.]*[\])}]*[,;]?|[\"'](?:[A-Za-z0-9+/=]{40,}|(?:\\\\x[0-9a-fA-F]{2}){8,})[\"'][,;+)\s]*|[A-Za-z0-9+/]{60,}={0,2})\s*$"
#: Lines of lock files, and what a text must hold to be searched for them.
LOCK_LINE = r"^[+\- ]?\s*(?:\"?integrity\"?:?\s+\"?sha\d+-[A-Za-z0-9+/=]{20,}|checksum = \"[0-9a-f]{32,}\"|\S+ v\S+ h1:[A-Za-z0-9+/=]{20,}|\"?resolved\"?:?\s+\"https?://|\{?\s*file = \".*hash = \"sha256:|\"sha256:[0-9a-f]{64}\")"
LOCK_ANY = r"integrity\W|checksum = |\sh1:|resolved\W|sha256:"
LONG = 300
#: A mined pattern needs so many files and a lower bound of their share with evidence in the content (Wilson, z = 2.58).
MINED_FILES, MINED_SHARE, Z = 40, 0.12, 2.58
SEED_FILES, SEED_HITS = 20, 8


def glob_regex(pattern: str) -> str:
    """A regular expression for whole relative paths, by the rules of attribute files.

    A pattern without a slash matches the name in any directory, one with a slash is
    anchored; ``*`` and ``?`` stop at slashes, ``**`` does not. A pattern that ends with a
    slash names directories, which have no attributes, and so matches no file.
    """
    if pattern.endswith("/"):
        return r"^(?!)$"
    p, anchored = (pattern[1:], True) if pattern.startswith("/") else (pattern, "/" in pattern)
    out, i = ("" if anchored else r"(?:.*/)?"), 0
    while i < len(p):
        c = p[i]
        if p.startswith("**/", i):
            out, i = out + r"(?:.*/)?", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out, i = out + r"/.+", i + 3
        elif c == "*":
            out, i = out + (r".*" if p.startswith("**", i) else r"[^/]*"), i + (2 if p.startswith("**", i) else 1)
        elif c == "?":
            out, i = out + r"[^/]", i + 1
        elif c == "[" and (j := p.find("]", i + 2)) > 0:
            body = p[i + 1 : j].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", j + 1
        elif c == "\\" and i + 1 < len(p):
            out, i = out + re.escape(p[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


def parse_attributes(text: str | None) -> list[tuple[int, str, str, bool | None]]:
    """``(line, pattern, attribute, value)`` of the lines that set, unset (``-``) or unspecify (``!``, no value) ``generated`` or ``vendored``."""
    rows = []
    for n, line in enumerate((text or "").splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#") or line.startswith("[attr]"):
            continue
        m = re.match(r'"((?:\\.|[^"])*)"\s+(.*)|(\S+)\s+(.*)', line)
        if not m:
            continue
        pattern, rest = (m[1], m[2]) if m[1] is not None else (m[3], m[4])
        if pattern.startswith("!"):
            continue
        for a in rest.split():
            name, _, value = a.lstrip("-!").partition("=")
            kind = {"linguist-generated": "generated", "gitlab-generated": "generated", "linguist-vendored": "vendored"}.get(name)
            if kind:
                rows.append((n, pattern, kind, None if a.startswith("!") else not a.startswith("-") and value.lower() not in ("false", "0", "no")))
    return rows


def clean_path(path: Column) -> Column:
    """A path with forward slashes and without leading ones or ``./``."""
    return F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), r"^(?:\.?/)+", "")


def rule_key(pattern: str, folder: str) -> tuple[str, str]:
    """What a path must have for a pattern to be worth trying on it: a name, an ending from a dot on, a folder, or nothing known."""
    special = re.compile(r"[*?\[\\]")
    if "/" not in pattern:
        if not special.search(pattern):
            return "name", pattern
        if pattern.startswith("*.") and not special.search(pattern[1:]):
            return "end", pattern[1:]
        return "any", ""
    head = pattern.lstrip("/").split("/")
    fixed = head[: next((i for i, x in enumerate(head) if special.search(x)), len(head) - 1)]
    whole = "/".join([*([folder] if folder else []), *fixed])
    return ("folder", whole) if fixed else ("any", "")


def path_keys(path: Column) -> Column:
    """The keys of a path that rules may have: its name, every ending of the name, every folder it lies in, and none."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    dots = F.split(name, r"\.")
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("key"))
    ends = F.when(F.size(dots) > 1, F.transform(F.sequence(F.lit(2), F.size(dots)), lambda i: key("end", F.concat(F.lit("."), F.array_join(F.slice(dots, i, F.size(dots)), "."))))).otherwise(F.array().cast("array<struct<kind:string,key:string>>"))
    folders = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: key("folder", F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array().cast("array<struct<kind:string,key:string>>"))
    return F.concat(F.array(key("name", name), key("any", F.lit(""))), ends, folders)


def attribute_rules(files: DataFrame) -> DataFrame:
    """``repo, depth, line, kind, key, regex, attribute, value`` from ``repo, path, text`` of attribute files."""
    cols = ["repo", "depth", "line", "kind", "key", "regex", "attribute", "value"]

    def rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for repo, path, text in zip(pdf["repo"], pdf["path"], pdf["text"]):
                folder = path.rpartition("/")[0]
                prefix = re.escape(folder + "/") if folder else ""
                for line, pattern, kind, value in parse_attributes(text):
                    rows.append((repo, len(folder.split("/")) if folder else 0, line, *rule_key(pattern, folder), "^" + prefix + glob_regex(pattern)[1:], kind, value))
            yield pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(cols)})

    src = files.select("repo", "path", "text").where("repo is not null and path is not null and text is not null")
    return src.mapInPandas(rules, "repo string, depth int, line int, kind string, key string, regex string, attribute string, value boolean")


def declared(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """``repo, path, is_declared`` where a rule matches: the deepest file's last line decides for each attribute.

    A path meets the rules of its repository that share its name, an ending or a folder,
    and those of no such key; the expressions are tried on these pairs only, compiled once a task.
    """
    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict[str, re.Pattern] = {}
        for batch in batches:
            keep = []
            for path, regex in zip(batch.column("path").to_pylist(), batch.column("regex").to_pylist()):
                rx = compiled.get(regex)
                if rx is None:
                    rx = compiled[regex] = re.compile(regex)
                keep.append(rx.match(path) is not None)
            yield batch.filter(pa.array(keep, pa.bool_()))

    keyed = paths.select("repo", "path").distinct().select("repo", "path", F.explode(path_keys(F.col("path"))).alias("k")).select("repo", "path", "k.*")
    pairs = keyed.join(rules, ["repo", "kind", "key"]).select("repo", "path", "depth", "line", "regex", "attribute", "value")
    hit = pairs.mapInArrow(tried, pairs.schema)
    last = hit.groupBy("repo", "path", "attribute").agg(F.max_by(F.struct("value"), F.struct("depth", "line")).alias("v"))
    return last.groupBy("repo", "path").agg(F.max("v.value").alias("is_declared"))


def content_evidence(text: Column) -> Column:
    """Whether a patch shows that its file is generated, copied, minified or data.

    A marking comment (in strings it does not count), a source map, a snapshot head, a very
    long line of code without spaces, mostly rows of numbers or encoded data, or mostly
    digests of packages.
    """
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: (F.length(F.trim(x)) > 1) & ~x.rlike(r"^(?:@@ |diff --git |index |--- |\+\+\+ )"))
    dense = F.exists(
        F.split(t, "\n"),
        lambda x: (F.length(x) >= LONG)
        & (F.length(F.translate(x, " \t", "")) * 100 >= F.length(x) * 92)
        & (F.length(F.translate(x, "{}();=", "")) * 100 <= F.length(x) * 94),
    )
    rows = F.size(F.filter(lines, lambda x: x.rlike(BLOB_LINE)))
    locks = F.size(F.filter(lines, lambda x: x.rlike(LOCK_LINE)))
    return t.rlike(MARK) | t.rlike(SOURCE_MAP) | t.rlike(SNAPSHOT) | dense | ((rows >= 3) & (rows * 2 >= F.size(lines))) | (t.rlike(LOCK_ANY) & (locks >= 2) & (locks * 5 >= F.size(lines) * 2))


def name_features(path: Column) -> Column:
    """Patterns that the name of a file is an instance of: the name, its last parts, its first one or two parts; digits count alike."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\d+", "#")
    found = [("end:", r"([._-][A-Za-z0-9#]+\.[A-Za-z0-9#]+)$"), ("end:", r"(-#\.#\.#\.[a-z]+)$"), ("begin:", r"^([A-Za-z]+[_.-])"), ("begin:", r"^([A-Za-z]+[_.-][A-Za-z]+[_.-])")]
    return F.array_distinct(F.filter(F.array(F.concat(F.lit("name:"), name), *[F.when(name.rlike(rx), F.concat(F.lit(k), F.regexp_extract(name, rx, 1))) for k, rx in found]), lambda x: x.isNotNull()))


def folder_features(path: Column) -> Column:
    """Patterns that the folders of a path are instances of: the first one, each one, each two that follow; digits count alike, and names of versioned folders."""
    parts = F.split(path, "/")
    dirs = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.regexp_replace(F.regexp_replace(x, r"\d+", "#"), r"^.*(?=-#\.#)", "*"))
    none = F.array().cast("array<string>")
    pairs = F.transform(F.arrays_zip(F.slice(dirs, 1, F.size(dirs) - 1).alias("a"), F.slice(dirs, 2, F.size(dirs) - 1).alias("b")), lambda x: F.concat(F.lit("pair:"), x["a"], F.lit("/"), x["b"]))
    return F.array_distinct(F.concat(
        F.when(F.size(dirs) > 0, F.array(F.concat(F.lit("root:"), F.element_at(parts, 1)))).otherwise(none),
        F.transform(dirs, lambda x: F.concat(F.lit("dir:"), x)), F.when(F.size(dirs) > 1, pairs).otherwise(none),
    ))


def seed_features(path: Column) -> Column:
    """The seeds that match a path, as ``seed:`` and the pattern."""
    seeds = [line.split()[0] for line in EQUIVALENT_ATTRIBUTES.split("\n") if line]
    every = "|".join(f"(?:{glob_regex(s)[1:-1]})" for s in seeds)
    each = F.filter(F.array(*[F.when(path.rlike(glob_regex(s)), F.lit(f"seed:{s}")) for s in seeds]), lambda x: x.isNotNull())
    return F.when(path.rlike(f"^(?:{every})$"), each).otherwise(F.array().cast("array<string>"))


def accepted(paths: DataFrame, features: str) -> DataFrame:
    """``feature`` of the patterns whose files show evidence often enough; ``paths`` has ``path, evidence``, one row a path.

    Each distinct path counts once, so copies and hot repositories do not weigh more; all
    paths are counted, with partial aggregation.
    """
    f = paths.select(F.explode(features).alias("feature"), F.col("evidence").cast("int").alias("e"))
    seed = F.col("feature").startswith("seed:")
    c = f.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("k")).where(seed | (F.col("n") >= MINED_FILES))
    n, k, z2 = F.col("n") + F.when(seed, SEED_FILES).otherwise(0), F.col("k") + F.when(seed, SEED_HITS).otherwise(0), Z * Z
    p = k / n
    low = (p + z2 / (2 * n) - Z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n)
    return c.where(low >= MINED_SHARE).select("feature")


def mined(files: DataFrame) -> DataFrame:
    """``path, pattern`` of the paths that a mined pattern (``mined``) or only a seed (``seed``) explains.

    ``files`` has ``path, evidence``. Names are mined first, then folders on the paths that
    no name explains, so that a folder of some generated files does not stand for all in it.
    """
    one = files.where("path != ''").groupBy("path").agg(F.max("evidence").alias("evidence"))
    paths = stored(one.select("path", "evidence", F.concat(seed_features(F.col("path")), name_features(F.col("path"))).alias("names"), folder_features(F.col("path")).alias("folders")))

    def explained(left: DataFrame, features: str) -> DataFrame:
        hit = left.select("path", F.explode(features).alias("feature")).join(accepted(left, features), "feature")
        return hit.groupBy("path").agg(F.min(F.when(F.col("feature").startswith("seed:"), "seed").otherwise("mined")).alias("pattern"))

    first = cut(explained(paths, "names"))
    second = explained(paths.join(first, "path", "left_anti"), "folders")
    # a seed that also lies in a mined folder is explained by mining
    alone = explained(paths.join(first.where("pattern = 'mined'"), "path", "left_anti"), "folders").select("path").join(first, "path", "left_semi").withColumn("pattern", F.lit("mined"))
    return first.union(second).union(alone).groupBy("path").agg(F.min("pattern").alias("pattern"))


def decided(files: DataFrame, attribute_files: DataFrame | None = None) -> DataFrame:
    """``origin, record_id, file_path, decided_by`` of the files that nobody wrote by hand.

    ``files`` has ``origin, record_id, file_path, repo, evidence`` (of the content, see
    ``content_evidence``). What a repository declares in attribute files decides first
    (``attribute_files``: ``repo, path, text``), for and against; where it declares
    nothing, patterns mined from the whole collection, seeds of mining or the content of
    the patch decide: ``declared``, ``mined``, ``seed`` or ``content``. Null paths and
    evidence are no evidence; a row without both is left out; copies give one row.
    """
    f = stored(files.select("origin", "record_id", "file_path", canonical_repo(F.col("repo")).alias("repo"), F.coalesce(clean_path(F.col("file_path")), F.lit("")).alias("path"), F.coalesce("evidence", F.lit(False)).alias("evidence")))
    f = f.join(mined(f), "path", "left")
    by = F.coalesce("pattern", F.when(F.col("evidence"), "content"))
    if attribute_files is not None:
        own = attribute_files.select(canonical_repo(F.col("repo")).alias("repo"), clean_path(F.col("path")).alias("path"), "text")
        d = declared(f.where("repo is not null").select("repo", "path"), attribute_rules(own)).select(F.col("repo").alias("r"), F.col("path").alias("p"), "is_declared")
        f = f.join(d, (F.col("repo") == F.col("r")) & (F.col("path") == F.col("p")), "left")
        by = F.when(F.col("is_declared"), "declared").when(F.col("is_declared").isNull(), by)
    return f.withColumn("decided_by", by).where("decided_by is not null").groupBy("origin", "record_id", "file_path").agg(F.min("decided_by").alias("decided_by"))


def not_handwritten(files: DataFrame, attribute_files: DataFrame | None = None) -> DataFrame:
    """``origin, record_id, file_path`` of the files that nobody wrote by hand, see ``decided``."""
    return decided(files, attribute_files).select("origin", "record_id", "file_path")


def listed_files(col: Column) -> Column:
    """The entries of a list written with separators or as JSON, as written there; null for null."""
    json = F.from_json(col, "array<string>")
    plain = F.transform(F.split(col, r"\s*[|;\n,]\s*"), lambda x: F.trim(x))
    return F.filter(F.when(col.rlike(r"^\s*\["), json).otherwise(plain), lambda x: x.isNotNull() & (x != ""))


def sections(diff: Column) -> Column:
    """The parts of a diff, one for each file, each starting with the two paths."""
    parts = F.split(F.concat(F.lit("\n"), diff), r"\ndiff --git ")
    return F.slice(parts, 2, F.size(parts))


def section_paths(part: Column) -> Column:
    """The distinct old and new path of a part of a diff."""
    head = F.regexp_replace(F.substring_index(part, "\n", 1), r"\r$", "")
    half = ((F.length(head) - 1) / 2).cast("int")
    old, new = F.substring(head, F.lit(1), half), F.substring(head, half + 2, half)
    same = (F.length(head) % 2 == 1) & old.startswith("a/") & new.startswith("b/") & (F.substring(old, F.lit(3), half) == F.substring(new, F.lit(3), half))
    two = F.array(F.regexp_extract(head, r"^\"?a/(.*?)\"? \"?b/", 1), F.regexp_extract(head, r" \"?b/(.*?)\"?$", 1))
    return F.when(same, F.array(F.substring(old, F.lit(3), half))).otherwise(F.array_distinct(F.filter(two, lambda x: x != "")))
