"""Readers and writers for CSV and JSON lines, with the checks raw exports need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fixed value: what the first line of a file holds whose content was not fetched.
POINTER = "version https://git-lfs"


def clean_header(name: str) -> str:
    """A column name without byte order mark, quotes and outer blanks."""
    return name.lstrip("﻿").strip().strip("\"'").strip()


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """All columns of a CSV file as text, with quoted line breaks; blank values are null.

    Header names are cleaned; a missing required column is an error that names it.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = raw.toDF(*[clean_header(c) for c in raw.columns])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in df.columns])


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines by a declared schema; a bad line fails the read if strict, else it stands in ``_corrupt_record``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    s = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(s.add("_corrupt_record", "string")).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_any(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Dispatch on the suffix: parquet, csv, json or jsonl."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        return read_csv(spark, path)
    if kind in ("json", "jsonl"):
        # a .json file may hold one array, a .jsonl file one object a line
        reader = spark.read.option("multiLine", kind == "json")
        return reader.schema(schema).json(path) if schema else reader.json(path)
    raise ValueError(f"no reader for .{kind}")


def is_pointer(text: Column) -> Column:
    """Whether a text is the stand-in for content that was not fetched."""
    return F.coalesce(F.trim(text).startswith(POINTER), F.lit(False))


def fingerprint(df: DataFrame, columns: list[str]) -> str:
    """One digest of the rows of some columns, whatever their order; each row once for each time it occurs.

    Row digests are counted and folded into 256 sums before they meet, so nothing large
    reaches the driver.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)
    h = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")
    parts = df.select(F.substring(row, 63, 2).alias("part"), h.alias("h")).groupBy("part").agg(F.sum("h").alias("s"), F.count(F.lit(1)).alias("n"))
    out = parts.agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", "part", F.col("s").cast("string"), F.col("n").cast("string"))))), 256)).first()
    return out[0]


def write_rows(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Write parquet, csv (with header) or json through Spark's committer; columns in name order for csv."""
    if kind == "csv":
        df.select(*sorted(df.columns)).write.mode(mode).option("header", True).option("escape", '"').csv(path)
    elif kind in ("parquet", "json"):
        df.write.mode(mode).format(kind).save(path)
    else:
        raise ValueError(f"no writer for {kind}")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` whose key ``new`` lacks, and all of ``new``; keys compare null-safely."""
    n = new.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return old.join(n, on, "left_anti").unionByName(new, allowMissingColumns=True)


def merge_json_lines(spark: SparkSession, paths: list[str], schema: StructType | str, target: str) -> int:
    """All rows of several JSON-lines files as one table at ``target``; blank lines are skipped. Returns the number of rows."""
    spark.read.schema(schema).json(paths).write.mode("errorifexists").json(target)
    return spark.read.schema(schema).json(target).count()


def discover(spark: SparkSession, root: str, pattern: str = "*.csv", without: tuple[str, ...] = ()) -> DataFrame:
    """``path, length, modified`` of the files below a folder whose name has the pattern; names that hold one of ``without`` are left out. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    name = F.element_at(F.split("path", "/"), -1)
    for w in without:
        found = found.where(~name.contains(w))
    return found.dropDuplicates(["path"])


def wanted_last(df: DataFrame, wanted: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Of the keys in ``wanted`` the row that is last in the given order; rows are picked by their key before they meet."""
    rows = df.join(wanted.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")
    rest = [c for c in df.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("r")).select(key, "r.*")


def merge_first(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """The union of several tables in which each key comes from the first table that has it; of equal keys in one table one row is kept."""
    all_ = None
    for i, t in enumerate(tables):
        x = t.withColumn("__from", F.lit(i))
        all_ = x if all_ is None else all_.unionByName(x, allowMissingColumns=True)
    rest = [c for c in all_.columns if c not in keys and c != "__from"]
    return all_.groupBy(*keys).agg(F.min_by(F.struct(*rest), "__from").alias("r")).select(*keys, "r.*")
