import datetime as dt

import pytest

from leafmill.operators.incremental import due, run_incremental
from leafmill.operators.prefix import block_prefix_sum
from leafmill.operators.versioned import VersionedTable, diff

SCHEMA = "id long, status string, created_at timestamp, updated_at timestamp, loaded_at timestamp, outcome string"
ITEMS = "run_id long, document_id long, updated_at timestamp, outcome string"


def day(n):
    return None if n is None else dt.datetime(2025, 1, n)


def catalog(spark, path, rows):
    spark.createDataFrame([(i, s, day(1), day(u), day(l), "clash") for i, s, u, l in rows], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def items(spark, rows):
    return spark.createDataFrame([(1, d, day(u), o) for d, u, o in rows], ITEMS)


def test_due(spark, tmp_path):
    c = catalog(spark, str(tmp_path / "c"), [
        (1, "completed", 2, 2), (1, " Completed ", 3, 3),  # newer state not done
        (2, "COMPLETED", 2, 2), (2, "completed", 2, 2),  # repeated, done
        (3, "completed", None, 2),  # never updated
        (4, "completed", 2, 2), (4, "failed", 2, 3),  # later load wins
        (5, "completed", 4, 2), (5, "processing", 3, 9),  # late old state
        (6, None, 2, 2), (None, "completed", 2, 2),
        (7, "completed", 2, 2), (7, "completed", 2, 2),  # repeated, due once
    ])
    i = items(spark, [(1, 2, "done"), (2, 2, "done"), (2, 2, "done"), (5, 4, "error"), (3, None, "done"), (None, 2, "done"), (7, 3, "done"), (99, 2, "done")])
    got = due(spark, c, i)
    assert sorted(r.id for r in got.collect()) == [1, 3, 5, 7]
    assert {r.outcome for r in got.collect()} == {"clash"}


def test_due_empty(spark, tmp_path):
    c = catalog(spark, str(tmp_path / "c"), [])
    assert due(spark, c, items(spark, [])).count() == 0
    full = catalog(spark, str(tmp_path / "f"), [(1, "completed", 2, 2)])
    assert [r.id for r in due(spark, full, items(spark, [])).collect()] == [1]


def test_versions_diff_by_manifest(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.latest() == 0 and t.version() is None and t.read() is None
    t.commit(append=spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"))
    t.commit(append=spark.createDataFrame([(3, "c")], "id long, v string"))
    from leafmill.operators.versioned import addressed

    t.commit(delete=addressed(spark, t.version().files).filter("id = 2"))
    assert sorted(r.id for r in t.read().collect()) == [1, 3]
    assert sorted(r.id for r in t.read(2).collect()) == [1, 2, 3]
    change = lambda a, b: sorted((r.id, r._change) for r in diff(spark, t.version(a), t.version(b)).collect())
    assert change(0, 3) == [(1, "added"), (3, "added")]
    assert change(1, 3) == [(2, "removed"), (3, "added")]
    assert change(3, 1) == [(2, "added"), (3, "removed")]
    assert change(3, 3) == []
    with pytest.raises(FileExistsError):
        t.commit(append=spark.createDataFrame([(9, "z")], "id long, v string"), base=2)


def test_failed_run_neither_skips_nor_repeats(spark, tmp_path):
    source, out = VersionedTable(spark, str(tmp_path / "s")), VersionedTable(spark, str(tmp_path / "o"))
    rows = lambda *r: spark.createDataFrame([(i, v, day(u)) for i, v, u in r], "id long, v string, updated_at timestamp")
    source.commit(append=rows((1, "a", 1), (2, "b", 1)))
    assert run_incremental(source, out, lambda d: d) == 1
    assert run_incremental(source, out, lambda d: d) is None
    source.commit(append=rows((2, "b2", 2), (2, "b3", 3), (3, "c", 2)))

    class Lost(Exception):
        pass

    real, calls = out.commit, []

    def dies(**k):
        out._written(k["append"], "data")  # results are on disk, but the run ends before the manifest
        calls.append(1)
        raise Lost

    out.commit = dies
    with pytest.raises(Lost):
        run_incremental(source, out, lambda d: d)
    out.commit = real
    assert run_incremental(source, out, lambda d: d) == 2 and calls
    assert sorted((r.id, r.v) for r in out.read().collect()) == [(1, "a"), (2, "b3"), (3, "c")]
    assert run_incremental(source, out, lambda d: d) is None


def test_block_prefix_sum(spark):
    from pyspark.sql import functions as F

    rows = [(k, i, i % 7) for k in (1, None) for i in range(50)]
    got = block_prefix_sum(spark.createDataFrame(rows, "k long, i long, v long"), ["k"], F.floor(F.col("i") / 8), ["i"], F.col("v"), "before")
    assert all(r.before == sum(j % 7 for j in range(r.i)) for r in got.collect())
    assert got.count() == 100


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", ["_written", "_publish", "_named"])
def test_a_writer_that_dies_leaves_the_table_usable(spark, tmp_path, step):
    """Ends at every step of a commit; before the manifest has its name nothing is seen of it, and the next commit takes the number."""
    t = VersionedTable(spark, str(tmp_path / "t"))
    rows = lambda i: spark.createDataFrame([(i,)], "id long")
    t.commit(append=rows(1))

    def dies(*a, **k):
        raise Crash

    real = getattr(t, step)
    setattr(t, step, dies)
    with pytest.raises(Crash):
        t.commit(append=rows(2))
    setattr(t, step, real)
    again = VersionedTable(spark, str(tmp_path / "t"))
    assert again.latest() == 1 and [r.id for r in again.read().collect()] == [1]
    (tmp_path / "t" / "_versions" / "_draft-left-by-a-crash").write_text("")
    assert again.commit(append=rows(3)) == 2 and sorted(r.id for r in again.read().collect()) == [1, 3]
    assert not [f for f in (tmp_path / "t" / "_versions").iterdir() if f.name.startswith("_draft") and "crash" not in f.name]


def test_manifests_on_other_file_systems_are_renamed_without_overwriting(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, str(tmp_path / "t"))
    real = t._fs

    class Other:
        def __getattr__(self, name):
            return (lambda: "other") if name == "getScheme" else getattr(real, name)

    t._fs = Other()
    assert t.commit(append=spark.createDataFrame([(1,)], "id long")) == 1 and t.read().count() == 1
    with pytest.raises(FileExistsError):
        t.commit(append=spark.createDataFrame([(2,)], "id long"), base=0)
    assert t.latest() == 1 and t.read().count() == 1


def test_compaction_changes_no_record(spark, tmp_path):
    from leafmill.operators.versioned import addressed, changes

    source, out = VersionedTable(spark, str(tmp_path / "s")), VersionedTable(spark, str(tmp_path / "o"))
    rows = lambda *r: spark.createDataFrame([(i, v, day(u)) for i, v, u in r], "id long, v string, updated_at timestamp")
    source.commit(append=rows((1, "a", 1), (2, "b", 1)))
    assert source.compact() is None or source.version().rewrites == 1
    assert run_incremental(source, out, lambda d: d) == 1
    source.commit(append=rows((3, "c", 2), (4, "d", 2)))
    source.commit(delete=addressed(spark, source.version().files).filter("id IN (2, 4)"))
    at = source.latest()
    assert source.compact() == at + 1 and source.version().deleted is None and source.compact() in (None, at + 2)
    assert changes(source, at, source.latest()) == []
    source.commit(append=rows((5, "e", 3)))
    source.commit(delete=addressed(spark, source.version().files).filter("id = 3"))
    assert run_incremental(source, out, lambda d: d) == 2
    assert sorted(r.id for r in out.read().collect()) == [1, 5]
    assert out.compact() == 3 and run_incremental(source, out, lambda d: d) is None
