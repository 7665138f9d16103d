"""File events as tables: listings by pattern, and what changed between two of them."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, path: str, include: str = "*", recursive: bool = True) -> DataFrame:
    """path, length and modified of the files that match; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", include).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def glob_pattern(pattern: str) -> str:
    """A glob as a regular expression of whole paths: ``**`` crosses folders, ``*`` and ``?`` do not."""
    parts = re.split(r"(\*\*/?|\*|\?)", pattern)
    each = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(each.get(p) or re.escape(p) for p in parts) + "$"


def chosen(files: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Files whose path matches an ``include`` glob (any, if there are none) and no ``exclude`` glob."""
    any_of = lambda globs: F.col("path").rlike("|".join(map(glob_pattern, globs)))
    rows = files.where(any_of(include)) if include else files
    return rows.where(~any_of(exclude)) if exclude else rows


def file_events(before: DataFrame | None, after: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """path, kind (create, change, delete, rename) and old_path (of a rename) between two listings (path, length,
    modified, and file_id if files are known by more than their path); without a listing before, the initial scan
    creates all. A file that has another path and the same file_id is renamed."""
    rows = chosen(after, include, exclude)
    if before is None:
        return rows.select("path", F.lit("create").alias("kind"), F.lit(None).cast("string").alias("old_path"))
    known = "file_id" in before.columns and "file_id" in after.columns
    own = lambda df, name: df.select("path", F.struct("length", "modified").alias(name), *([F.col("file_id").alias(f"{name}_id")] if known else []))
    both = own(chosen(before, include, exclude), "_b").join(own(rows, "_a"), "path", "full")
    kind = F.when(F.col("_b").isNull(), "create").when(F.col("_a").isNull(), "delete").when(F.col("_a") != F.col("_b"), "change")
    out = both.withColumn("kind", kind).where("kind is not null")
    if not known:
        return out.select("path", "kind", F.lit(None).cast("string").alias("old_path"))
    gone = out.where("kind = 'delete'").select(F.col("_b_id").alias("id"), F.col("path").alias("old_path"))
    new = out.where("kind = 'create'").select(F.col("_a_id").alias("id"), F.col("path").alias("new_path"))
    moved = new.join(gone, "id").groupBy("id").agg(F.min("new_path").alias("new_path"), F.min("old_path").alias("old_path"))
    moved = moved.select("new_path", "old_path")
    named = out.join(moved, F.col("path") == F.col("new_path"), "left").select("path", F.when(F.col("new_path").isNotNull(), "rename").otherwise(F.col("kind")).alias("kind"), "old_path")
    return named.join(moved.select(F.col("old_path").alias("path")), "path", "left_anti")
