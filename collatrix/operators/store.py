"""Tables that a comparison keeps: files by content, extracted versions, results of figures, and workspaces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Versions and comparisons that are kept.
KEPT_VERSIONS, KEPT_WORKSPACES = 30, 15


def newest_rows(rows: DataFrame, at: str, key: str, most: int) -> DataFrame:
    """The rows that retention keeps: the newest by `at`, of equals those of least key. A limit in order: each task keeps
    its own newest, so no task sorts the table."""
    return rows.orderBy(F.desc(at), key).limit(most)


def missing(wanted: DataFrame, known: DataFrame, key: Sequence[str]) -> DataFrame:
    """Work that no result is kept for."""
    return wanted.join(known.select(*key), list(key), "left_anti")


def put_absent(files: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The files to append to the store: each content once, and none that is there."""
    return files.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def cached_or(wanted: DataFrame, cached: DataFrame, key: Sequence[str], fresh: DataFrame) -> DataFrame:
    """Results by key: those that are kept, and fresh ones for the rest."""
    return wanted.select(*key).distinct().join(cached, list(key)).unionByName(missing(fresh, cached, key).join(wanted.select(*key).distinct(), list(key)))


def figure_key(version: int, a: str, b: str):
    """The name under which the results of two files are kept."""
    return F.concat(F.lit(f"fig{version}:"), F.col(a), F.lit(":"), F.col(b))


def listed(workspaces: DataFrame, versions: DataFrame) -> DataFrame:
    """Workspaces with any version, with how many, and their place from the newest on. Workspaces: (workspace_id, updated);
    versions: (workspace_id, hash, …)."""
    sizes = versions.groupBy("workspace_id").agg(F.count("*").alias("n_versions"))
    return workspaces.join(sizes, "workspace_id")


def restored(versions: DataFrame, files: DataFrame) -> DataFrame:
    """Versions of workspaces with `found`: whether their file is still stored."""
    return versions.join(files.select("hash", F.lit(True).alias("_there")).distinct(), "hash", "left").withColumn("found", F.coalesce("_there", F.lit(False))).drop("_there")


def unused(files: DataFrame, versions: DataFrame, kept: DataFrame, workspace: str, key: str) -> DataFrame:
    """Stored files that no kept workspace has."""
    used = versions.join(kept.select(workspace), workspace, "left_semi")
    return files.join(used.select(key).distinct(), key, "left_anti")
