"""Keeping an index current: diffs, updates, deletes, purges, verification rounds and project upserts.

Every operation returns new DataFrames; callers write them to a new snapshot or by dynamic partition overwrite,
never over a path that is being read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import DAY, dirname
from lexmill.operators.files import apply_ignore_rules, route_extractor


def latest(rows: DataFrame, key: str = "filename", *order: str) -> DataFrame:
    """The newest row of each key."""
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")


def file_diff(stored: DataFrame, listing: DataFrame) -> DataFrame:
    """filename, status: new, changed (listed later than stored), deleted, unchanged. One shuffle of file names."""
    both = stored.select("filename", "filetime").join(listing.select("filename", "mtime"), "filename", "full_outer")
    status = F.when(F.col("filetime").isNull(), "new").when(F.col("mtime").isNull(), "deleted").when(F.col("filetime") < F.col("mtime"), "changed").otherwise("unchanged")
    return both.select("filename", "filetime", "mtime", status.alias("status"))


def update_files(stored: DataFrame, listing: DataFrame) -> DataFrame:
    """filename, filetime after an incremental update."""
    diff = file_diff(stored, listing)
    return diff.where("status <> 'deleted'").select("filename", F.when(F.col("status") == "unchanged", F.col("filetime")).otherwise(F.col("mtime")).alias("filetime"))


def update_entities(entities: DataFrame, diff: DataFrame, fresh: DataFrame) -> DataFrame:
    """Entities after an update: those of unchanged files, and the fresh ones of new and changed files."""
    gone = diff.where("status <> 'unchanged'").select("filename")
    added = diff.where("status IN ('new', 'changed')").select("filename")
    return entities.join(gone, "filename", "left_anti").unionByName(fresh.join(added, "filename", "left_semi"))


def delete_files(rows: DataFrame, names: DataFrame) -> DataFrame:
    return rows.join(names.select("filename"), "filename", "left_anti")


def reindex_files(rows: DataFrame, names: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows after some files were deleted and indexed again; files without fresh rows are gone."""
    return delete_files(rows, names).unionByName(fresh.join(names.select("filename").distinct(), "filename", "left_semi"))


def update_postings(found: DataFrame, entities: DataFrame, diff: DataFrame, fresh: DataFrame) -> DataFrame:
    """Postings after an update: entities (with ids) of new, changed and deleted files lose theirs, `fresh` postings come."""
    gone = entities.join(diff.where("status <> 'unchanged'").select("filename"), "filename", "left_semi").select("id")
    return found.join(gone, "id", "left_anti").unionByName(fresh)


def rebuild_project(rows: DataFrame, fresh: DataFrame, project: str) -> DataFrame:
    """Rows after a full rebuild of one project; those of other projects stay as they are."""
    return delete_project(rows, project).unionByName(fresh.where(F.col("project_root") == project))


def delete_project(rows: DataFrame, project: str) -> DataFrame:
    return rows.where(~F.col("project_root").eqNullSafe(F.lit(project)))


def delete_project_everywhere(project: str, files: DataFrame, entities: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Files, entities (by file) and postings (by entity) without a project, and one row: how many of each go."""
    own = files.where(F.col("project_root") == project).select("filename")
    gone = entities.join(own, "filename", "left_semi").select("id")
    lost = found.join(gone, "id", "left_semi")
    counts = own.agg(F.count("*").alias("files")).join(gone.agg(F.count("*").alias("entities"))).join(lost.agg(F.count("*").alias("postings")))
    return delete_project(files, project), entities.join(own, "filename", "left_anti"), found.join(gone, "id", "left_anti"), counts


def purge(files: DataFrame, listing: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Files that are still listed and, with `rules`, that no ignore rule hides now."""
    names = listing.select("filename").distinct()
    return files.join(names if rules is None else apply_ignore_rules(names, rules), "filename", "left_semi")


def verify_batch(files: DataFrame, now: int, oldest: int = 50) -> DataFrame:
    """All files, with verified_time set to now for those verified within a day and the `oldest` others."""
    recent = F.col("verified_time") >= F.lit(now - DAY)
    chosen = files.where(~recent).orderBy("verified_time", "filename").limit(oldest).select("filename").withColumn("due", F.lit(True))
    rows = files.join(chosen, "filename", "left")
    return rows.withColumn("verified_time", F.when(recent | F.coalesce("due", F.lit(False)), F.lit(now).cast("long")).otherwise(F.col("verified_time"))).drop("due")


def near_changes(listing: DataFrame, stored: DataFrame, changed: DataFrame) -> DataFrame:
    """Listed but unknown files in the directories of changed files and in their parents."""
    own = changed.select(dirname(F.col("filename")).alias("directory"))
    dirs = own.unionByName(own.select(dirname(F.col("directory")).alias("directory"))).distinct()
    near = listing.withColumn("directory", dirname(F.col("filename"))).join(dirs, "directory", "left_semi")
    return near.join(stored.select("filename"), "filename", "left_anti").select("filename")


def discover(listing: DataFrame, stored: DataFrame, changed: DataFrame, table: DataFrame, rules: DataFrame) -> DataFrame:
    """near_changes() that an extractor of `table` takes and no ignore rule hides: filename, extractor."""
    return route_extractor(apply_ignore_rules(near_changes(listing, stored, changed), rules), table)


def upsert_projects(stored: DataFrame, touched: DataFrame, now: int, indexed: bool = False) -> DataFrame:
    """project_root, project_name, registered_at, last_accessed: new ones are inserted, known ones touched. With `indexed`
    the touched ones get last_indexed too."""
    t = touched.select("project_root", F.col("project_name").alias("new_name"), F.lit(True).alias("hit"))
    both = stored.join(t, "project_root", "full_outer")
    stamp, hit = F.lit(now).cast("long"), F.coalesce("hit", F.lit(False))
    before = F.col("last_indexed") if "last_indexed" in stored.columns else F.lit(None).cast("long")
    extra = [F.when(hit, stamp).otherwise(before).alias("last_indexed")] if indexed else []
    return both.select("project_root", F.coalesce("project_name", "new_name").alias("project_name"), F.coalesce("registered_at", stamp).alias("registered_at"), F.when(hit, stamp).otherwise(F.col("last_accessed")).alias("last_accessed"), *extra)


def due_projects(projects: DataFrame, now: int, seconds: int = 60) -> DataFrame:
    return projects.where(F.col("last_update_check").isNull() | (F.lit(now) - F.col("last_update_check") >= seconds))


def run_report(diff: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """One row: files indexed, skipped and removed; with `entities` (of the new and changed files) their number too."""
    counts = diff.agg(F.count_if(F.col("status").isin("new", "changed")).alias("indexed"), F.count_if(F.col("status") == "unchanged").alias("skipped"), F.count_if(F.col("status") == "deleted").alias("removed"))
    return counts if entities is None else counts.join(F.broadcast(entities.agg(F.count("*").alias("entities"))))  # two rows of scalars
