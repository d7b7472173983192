"""Processing only what is new or changed since the last successful run (problem 3)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.operators.versioned import ADDRESS, Version, VersionedTable, addressed, changes, diff, same_path


def pending(spark: SparkSession, catalog_files: list[str], items: DataFrame, finished: str = "completed") -> DataFrame:
    """Catalogue records whose current finished state no run has processed, by diffing two versions.

    The catalogue is append-only, so its files are the data files of every version. The *processed*
    version deletes all records but the states that ``items`` records as ``done``; the *target* version
    deletes all records but the current state of each id, and that one too unless its ``status`` is
    ``finished`` (blanks and case aside). The records added between the two are due. Current means the greatest ``updated_at`` (``created_at`` where NULL), then the
    greatest ``loaded_at``, NULL being least; of exact repeats the first stored record counts. A state without ``updated_at``
    cannot have been recorded and is due. Records without ``id`` are never due. Items that are doubled,
    have NULLs or name unknown documents have no effect. Extra columns are carried along.

    Both windows of states are aggregates by id with partial aggregation, so an id that has a third of
    all rows is reduced before the shuffle. Only addresses, ids and timestamps are moved.
    """
    rows = addressed(spark, catalog_files)
    keys = rows.select(*ADDRESS, "id", "status", "updated_at", "created_at", "loaded_at")
    rank = F.struct(F.coalesce("updated_at", "created_at").alias("u"), F.col("loaded_at").alias("l"))
    best = keys.filter("id IS NOT NULL").groupBy("id").agg(
        F.max(F.struct(rank.alias("rank"), F.struct(*ADDRESS).alias("at"))).alias("top"),
    )
    # max() picks the last stored of exact repeats; the first stored one is the record of the version
    first = (
        keys.join(best.select(F.col("id").alias("_id"), F.col("top.rank").alias("_rank")), (F.col("id") == F.col("_id")) & rank.eqNullSafe(F.col("_rank")))
        .groupBy("id")
        .agg(F.min(F.struct(*ADDRESS, F.lower(F.trim(F.regexp_replace("status", r"\s+", " "))).alias("status"))).alias("at"))
        .filter(F.col("at.status") == finished)
        .select("at._file", "at._pos")
    )
    done = items.filter(F.col("outcome") == "done").select(F.col("document_id").alias("id"), "updated_at").dropna().dropDuplicates()
    addresses = keys.select(*ADDRESS)
    target = Version(2, tuple(catalog_files), addresses.join(first, list(ADDRESS), "left_anti"), "target")
    processed = Version(1, tuple(catalog_files), keys.join(done, ["id", "updated_at"], "left_anti").select(*ADDRESS), "processed")
    return diff(spark, processed, target).filter("_change = 'added'").drop("_change")


def due(spark: SparkSession, catalog: DataFrame, items: DataFrame) -> DataFrame:
    """:func:`pending` over all files behind ``catalog``; an empty catalogue has none due."""
    files = sorted(same_path(p) for p in catalog.inputFiles())
    return pending(spark, files, items) if files else catalog.limit(0)


def run_incremental(source: VersionedTable, output: VersionedTable, step: Callable[[DataFrame], DataFrame], key: str = "id", stamp: str = "updated_at") -> int | None:
    """One run: apply ``step`` to the records of ``source`` added since the version that ``output`` has processed.

    The processed version is stored in the manifest that publishes the run's result. A run that dies
    before that leaves files which no manifest names, and the next run starts from the same version: no
    record is skipped and none appears twice. Results of records that ``source`` has removed or
    replaced are deleted through the output's own deletion vectors, found by ``key``. If several added records share
    a key, the one with the greatest ``stamp`` is processed. Returns the output's new version, or None if
    nothing was new.
    """
    seen = output.version()
    start, end = int(seen.meta.get("processed", 0)) if seen else 0, source.latest()
    parts = changes(source, start, end)
    if not parts:
        return None
    delta = parts[0]
    for p in parts[1:]:
        delta = delta.unionByName(p, allowMissingColumns=True)
    keys = delta.select(key).distinct()
    added = delta.filter("_change = 'added'")
    if len(parts) > 1:
        # addresses do not outlive a compaction, so what became of a record is read from the newest version
        now = source.read(end)
        added = delta.limit(0) if now is None else now.join(keys, key, "left_semi").withColumns({"_file": F.lit(""), "_pos": F.lit(0).cast("long"), "_change": F.lit("added")})
    newest = Window.partitionBy(key).orderBy(F.col(stamp).desc_nulls_last(), F.col("_file").desc(), F.col("_pos").desc())
    added = added.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank", "_change", *ADDRESS)
    gone = None
    if seen and seen.files:
        stored = addressed(source.spark, seen.files)
        stored = stored if seen.deleted is None else stored.join(seen.deleted, list(ADDRESS), "left_anti")
        gone = stored.join(keys, key, "left_semi").select(*ADDRESS)
    return output.commit(append=step(added), delete=gone, meta={"processed": end}, base=seen.number if seen else 0)
