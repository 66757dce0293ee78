"""Incremental scan: what became of each file between two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, action, old_path, id) from snapshots: ``old`` (id, path, size, mtime, hash, state), ``new`` (path, size, mtime, hash, ok).

    unchanged: known, present, size and time equal; modified: known but not
    so; failed: to be looked at, but ``ok`` is false; then unknown files, in
    path order, by the file with their hash once the known ones are updated,
    the present one with the least id, or else any: moved if that is gone
    (old_path), duplicate if it is there, new if there is none. A file that
    was moved or is new is there for those after it, so of several unknown
    ones with one hash all but the first are duplicates. missing: known, not
    seen, not moved and not missing before. ``id`` is the file's in ``old``.
    """
    o = old.select("id", "path", F.col("size").alias("o_size"), F.col("mtime").alias("o_mtime"), F.col("hash").alias("o_hash"), "state")
    both = o.join(new.withColumn("seen", F.lit(True)), "path", "full_outer")
    known, seen = F.col("id").isNotNull(), F.col("seen").isNotNull()
    same = (F.col("state") == "present") & (F.col("o_size") == F.col("size")) & (F.col("o_mtime") == F.col("mtime"))
    none = F.lit(None).cast("string").alias("old_path")
    settled = both.where(known & seen).withColumn("action", F.when(same, "unchanged").when(F.col("ok"), "modified").otherwise("failed"))
    failed = both.where(~known & seen & ~F.col("ok")).select("path", F.lit("failed").alias("action"), none, "id")
    # The files by hash as unknown ones find them.
    hashes = settled.select(F.when(same, F.col("o_hash")).otherwise(F.col("hash")).alias("hash"), "id", "path", (F.col("action") == "failed").alias("absent"), F.lit(False).alias("gone"))
    hashes = hashes.unionByName(both.where(known & ~seen).select(F.col("o_hash").alias("hash"), "id", "path", (F.col("state") != "present").alias("absent"), F.lit(True).alias("gone")))
    best = hashes.groupBy("hash").agg(F.min(F.struct("absent", "id", "gone", "path")).alias("best"))
    fresh = both.where(~known & seen & F.col("ok")).select("hash", "path")
    first = fresh.groupBy("hash").agg(F.min("path").alias("first"))
    met = fresh.join(first, "hash", "left").join(best, "hash", "left")
    moved = F.col("best.gone") & (F.col("path") == F.col("first"))
    action = F.when(F.col("best").isNull() & F.coalesce(F.col("path") == F.col("first"), F.lit(True)), "new").when(moved, "moved").otherwise("duplicate")
    put = met.select("path", action.alias("action"), F.when(moved, F.col("best.path")).alias("old_path"), F.when(moved, F.col("best.id")).alias("id"))
    gone = both.where(known & ~seen & (F.col("state") != "missing"))
    missing = gone.join(put.where("action = 'moved'").select(F.col("old_path").alias("path")), "path", "left_anti").select("path", F.lit("missing").alias("action"), none, "id")
    return settled.select("path", "action", none, "id").unionByName(failed).unionByName(put).unionByName(missing)


def report(actions: DataFrame) -> DataFrame:
    """(action, n)."""
    return actions.groupBy("action").agg(F.count("*").alias("n"))


def next_snapshot(old: DataFrame, new: DataFrame) -> DataFrame:
    """The snapshot (id, path, size, mtime, hash, state) after a scan.

    Files that were there, moved or are new are present, copies duplicate,
    known ones that failed in error; what is gone stays as missing under its
    old path. Files without an id yet have null.
    """
    actions = classify(old, new)
    state = F.when(F.col("action") == "failed", "error").when(F.col("action") == "duplicate", "duplicate").otherwise("present")
    there = actions.where("action <> 'missing' AND NOT (action = 'failed' AND id IS NULL)").join(new.drop("ok"), "path").select("id", "path", "size", "mtime", "hash", state.alias("state"))
    # A file that is unchanged keeps the hash it was known by.
    there = there.join(old.select("id", F.col("hash").alias("o_hash"), (F.col("state") == "present").alias("was"), F.col("size").alias("o_size"), F.col("mtime").alias("o_mtime")), "id", "left")
    kept = F.col("was") & (F.col("size") == F.col("o_size")) & (F.col("mtime") == F.col("o_mtime")) & (F.col("state") == "present")
    there = there.select("id", "path", "size", "mtime", F.when(kept, F.coalesce("o_hash", "hash")).otherwise(F.col("hash")).alias("hash"), "state")
    lost = old.join(there.where("id IS NOT NULL").select("id"), "id", "left_anti").withColumn("state", F.lit("missing"))
    return there.unionByName(lost.select("id", "path", "size", "mtime", "hash", "state"))
