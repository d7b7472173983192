"""Immutable table versions: data files plus deletion vectors, and record deltas between two versions."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that name a record inside a version.
ADDRESS = ("_file", "_pos")


@dataclass(frozen=True)
class Version:
    """One immutable version of a table.

    ``files`` are the paths of its Parquet files. ``deleted`` holds the deletion vector: one
    (``_file``, ``_pos``) row for each record of those files that is not part of the version, or None.
    ``deleted_id`` names the vector; two versions with the same name share it. ``meta`` is what the
    writer stored with the commit. ``rewrites`` is the version whose records this one holds in new files, if it was made by :meth:`VersionedTable.compact`.
    """

    number: int
    files: tuple[str, ...]
    deleted: DataFrame | None = None
    deleted_id: str | None = None
    meta: dict = field(default_factory=dict)
    rewrites: int | None = None


def addressed(spark: SparkSession, files: tuple[str, ...] | list[str]) -> DataFrame:
    """All records of ``files`` with their address in ``_file`` and ``_pos``."""
    return spark.read.parquet(*files).withColumns({"_file": F.col("_metadata.file_path"), "_pos": F.col("_metadata.row_index")})


def same_path(path: str) -> str:
    """``path`` as ``_metadata.file_path`` spells it."""
    return path if "://" in path or not path.startswith("file:/") else "file://" + path[len("file:") :]


def diff(spark: SparkSession, old: Version | None, new: Version) -> DataFrame:
    """Records that ``new`` has and ``old`` lacks (``_change`` 'added') or the other way round ('removed').

    Only manifests decide what is read: files in one version alone are read whole, less their deleted
    records. Files in both are touched only where the deletion vectors differ: a record deleted in ``old``
    alone was added, one deleted in ``new`` alone was removed. Record values are never compared.
    ``old`` None stands for the empty version. The result has the table's columns, ``_file``, ``_pos``
    and ``_change``; it is empty if both versions are the same.
    """
    before, after = set(old.files if old else ()), set(new.files)
    none = spark.createDataFrame([], "_file string, _pos long")
    gone = {"old": (old.deleted if old and old.deleted is not None else none).select(*ADDRESS), "new": (new.deleted if new.deleted is not None else none).select(*ADDRESS)}
    parts = []
    for files, vector, change in ((after - before, gone["new"], "added"), (before - after, gone["old"], "removed")):
        if files:
            parts.append(addressed(spark, sorted(files)).join(vector, list(ADDRESS), "left_anti").withColumn("_change", F.lit(change)))
    both = sorted(before & after)
    if both and not (old and old.deleted_id == new.deleted_id):
        changed = (
            gone["old"]
            .withColumn("_side", F.lit(1))
            .unionByName(gone["new"].withColumn("_side", F.lit(2)))
            .groupBy(*ADDRESS)
            .agg(F.bit_or("_side").alias("_side"))
            .filter("_side < 3")
            .select(*ADDRESS, F.when(F.col("_side") == 1, "added").otherwise("removed").alias("_change"))
        )
        parts.append(addressed(spark, both).join(changed, list(ADDRESS)))
    if not parts:
        return addressed(spark, sorted(after | before)).withColumn("_change", F.lit("added")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


class VersionedTable:
    """A table kept as Parquet files under ``root`` with one JSON manifest a version.

    A manifest is written in full under a name that no reader looks at and then given its own, which fails if that is taken: so of
    two writers one loses, and a writer that dies at any point leaves nothing but files that no manifest names. Files are never changed in place. Works
    on any file system that Hadoop can reach and that renames atomically.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self, number: int) -> str:
        return f"{self.root}/_versions/{number:012d}.json"

    def latest(self) -> int:
        """Number of the newest version, 0 if there is none."""
        folder = self._path(f"{self.root}/_versions")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max([0, *(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())])

    def _stored(self, number: int) -> dict:
        stream = self._fs.open(self._path(self._manifest(number)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def version(self, number: int | None = None) -> Version | None:
        """Version ``number`` (the newest if None); None for number 0."""
        number = self.latest() if number is None else number
        if number == 0:
            return None
        m = self._stored(number)
        deleted = self.spark.read.parquet(*m["vectors"]) if m["vectors"] else None
        return Version(number, tuple(m["files"]), deleted, ",".join(m["vectors"]) or None, m["meta"], m.get("rewrites"))

    def read(self, number: int | None = None) -> DataFrame | None:
        """The records of a version, or None if there is no version."""
        v = self.version(number)
        if v is None or not v.files:
            return None
        rows = addressed(self.spark, v.files)
        return (rows if v.deleted is None else rows.join(v.deleted, list(ADDRESS), "left_anti")).drop(*ADDRESS)

    def _written(self, df: DataFrame, kind: str, by: str | None = None) -> list[str]:
        folder = f"{self.root}/{kind}/{uuid.uuid4().hex}"
        (df.write.partitionBy(by) if by else df.write).parquet(folder)
        return sorted(same_path(p) for p in self.spark.read.parquet(folder).inputFiles()) if kind == "data" else [folder]

    def _publish(self, number: int, body: dict) -> int:
        """Make ``body`` the manifest of version ``number``; FileExistsError if there is one."""
        draft, final = self._path(f"{self.root}/_versions/_draft-{uuid.uuid4().hex}"), self._path(self._manifest(number))
        stream = self._fs.create(draft, False)
        try:
            stream.write(json.dumps(body).encode())
        finally:
            stream.close()
        try:
            self._named(draft, final)
        except Exception as e:
            if self._fs.exists(final):
                raise FileExistsError(f"version {number} of {self.root} exists") from e
            raise
        finally:
            self._fs.delete(draft, False)
        return number

    def _named(self, draft, final) -> None:
        """Give a file its final name unless that is taken."""
        if self._fs.getScheme() == "file":
            # a rename would replace the other writer's file here, a link does not
            os.link(draft.toUri().getPath(), final.toUri().getPath())
            return
        sc = self.spark.sparkContext
        rename = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = sc._gateway.new_array(rename, 1)
        options[0] = rename.valueOf("NONE")
        sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration()).rename(draft, final, options)

    def commit(self, append: DataFrame | None = None, delete: DataFrame | None = None, meta: dict | None = None, base: int | None = None, by: str | None = None) -> int:
        """A new version: the newest one plus the rows of ``append``, less the records addressed by ``delete``.

        ``meta`` is stored in the same manifest, hence takes effect with the data or not at all. ``base``
        is the version the caller has seen; FileExistsError is raised if another writer came first. With ``by`` the new files are
        parted by that column, which is then in their paths only.
        """
        base = self.latest() if base is None else base
        old = self._stored(base) if base else {"files": [], "vectors": [], "meta": {}}
        files = old["files"] + (self._written(append, "data", by) if append is not None else [])
        vectors = old["vectors"] + (self._written(delete.select(*ADDRESS), "deleted") if delete is not None else [])
        return self._publish(base + 1, {"files": files, "vectors": vectors, "meta": meta or {}})

    def compact(self) -> int | None:
        """A new version with the records of the newest in new files, without deletion vectors, so that manifests and scans do not grow with every commit.

        :func:`changes` sees no change in it. Returns its number, or None if there is nothing to gain. Tables parted by a column are not for it.
        """
        base = self.latest()
        old = self._stored(base) if base else {"files": [], "vectors": []}
        if not old["vectors"] and len(old["files"]) < 2:
            return None
        rows = self.read(base)
        files = self._written(rows, "data") if rows is not None else []
        return self._publish(base + 1, {"files": files, "vectors": [], "meta": old["meta"], "rewrites": base})


def changes(table: VersionedTable, start: int, end: int) -> list[DataFrame]:
    """The deltas that lead from version ``start`` to ``end``, one for each stretch between compactions (:func:`diff`); mostly one."""
    if start >= end:
        return []
    parts, low = [], start
    for number in range(start + 1, end + 1):
        if table.version(number).rewrites is not None:
            if number - 1 > low:
                parts.append(diff(table.spark, table.version(low), table.version(number - 1)))
            low = number
    return parts + ([diff(table.spark, table.version(low), table.version(end))] if end > low else [])
