"""Versioned tables: failed writes, conflicts, deletes; levelled upserts: bounded folders, retries."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from equityspark.sources.versions import VersionConflict, VersionedTable
from equityspark.streaming import levels

SCHEMA = "doc_id long, ticker string, date date, x double"


def rows(ids, x=1.0):
    return [(i, f"T{i % 3}", dt.date(2024, 1, 1 + i % 4), x) for i in ids]


def data_files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


@pytest.fixture
def table(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["doc_id"], "date")
    t.append(spark.createDataFrame(rows(range(20)), SCHEMA))
    return t


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_delete_writes_no_data_and_compaction_folds_it_in(spark, table):
    before = [f for f in data_files(table.path)]
    table.delete(spark.createDataFrame([(3,), (7,), (99,)], "doc_id long"))
    new = [f for f in data_files(table.path) if f not in before]
    names = {c for f in new for c in spark.read.parquet(f).columns}
    assert names <= {"doc_id"} and sum(spark.read.parquet(f).count() for f in new) == 2
    assert ids(table.read()) == [i for i in range(20) if i not in (3, 7)]
    table.append(spark.createDataFrame(rows([3], 5.0), SCHEMA))  # a deleted id may come back
    assert ids(table.read()) == [i for i in range(20) if i != 7] and table.read().where("doc_id = 3").first()["x"] == 5.0
    want = sorted(map(tuple, table.read().select("doc_id", "ticker", "date", "x").collect()))
    table.compact()
    assert table.manifest()["deletes"] == [] and len(table.manifest()["data"]) == 1
    assert sorted(map(tuple, table.read().select("doc_id", "ticker", "date", "x").collect())) == want
    assert ids(table.read(1)) == list(range(20))
    assert table.vacuum() == 3 and sorted(map(tuple, table.read().select("doc_id", "ticker", "date", "x").collect())) == want


def test_replace_append_new_and_null_keys(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "p"), ["ticker"], "date")
    assert t.delete(spark.createDataFrame([("T1",)], "ticker string")) == 0
    t.replace(spark.createDataFrame([*rows(range(12)), (50, None, dt.date(2024, 1, 1), 1.0)], SCHEMA))
    t.replace(spark.createDataFrame(rows([1, 4], 9.0), SCHEMA))  # T1 whole
    got = {(r["doc_id"], r["x"]) for r in t.read().collect()}
    assert got == {(i, 1.0) for i in range(12) if i % 3 != 1} | {(1, 9.0), (4, 9.0), (50, 1.0)}
    t.append_new(spark.createDataFrame([*rows([2, 100]), (101, "NEW", dt.date(2024, 2, 1), 2.0)], SCHEMA))
    assert {r["doc_id"] for r in t.read().collect()} == {d for d, _ in got} | {101}


def test_stopped_write_leaves_the_old_version(spark, table, monkeypatch):
    def stop(*a, **k):
        raise KeyboardInterrupt

    monkeypatch.setattr(VersionedTable, "_publish", stop)
    for change in (lambda: table.replace(spark.createDataFrame(rows([1], 9.0), SCHEMA)), lambda: table.delete(spark.createDataFrame([(1,)], "doc_id long")), table.compact):
        with pytest.raises(KeyboardInterrupt):
            change()
        assert ids(table.read()) == list(range(20)) and table.versions() == [1]
    monkeypatch.undo()
    assert table.vacuum() == 4  # what was staged and never published
    assert ids(table.read()) == list(range(20))


def test_second_writer_from_the_same_version_fails(spark, table):
    state = table.manifest()
    table.append(spark.createDataFrame(rows([30]), SCHEMA))
    with pytest.raises(VersionConflict):
        table._publish(state, deletes=[])
    assert ids(table.read()) == [*range(20), 30]


def test_files_do_not_follow_the_partition_values(spark, tmp_path):
    many = [(i, f"T{i % 3}", None if i == 7 else dt.date(2024, 1, 1) + dt.timedelta(days=i % 60), 1.0) for i in range(240)]
    t = VersionedTable(spark, str(tmp_path / "t"), ["doc_id"], "date")
    t.append(spark.createDataFrame(many, SCHEMA))
    t.delete(spark.createDataFrame([(i,) for i in range(0, 240, 2)], "doc_id long"))
    t.compact()
    assert len(data_files(t.path)) <= 3 * 4  # three folders of the session's four partitions, not one file a date
    got = {(r["doc_id"], r["ticker"], r["date"], r["x"]) for r in t.read().collect()}
    assert got == {r for r in many if r[0] % 2} and t.read().columns == ["doc_id", "ticker", "date", "x"]


# ---- levels --------------------------------------------------------------
CHANGES = "ticker string, date date, v long, ts timestamp"


def changes(n, seed):
    rng = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    return [(f"T{rng.randrange(9)}", dt.date(2024, 1, 1 + rng.randrange(3)), rng.randrange(10**6), t0 + dt.timedelta(seconds=rng.randrange(10**7))) for _ in range(n)]


def test_levels_stay_few_and_equal_the_batch_result(spark, tmp_path):
    root, seen = str(tmp_path), []
    for i in range(30):
        part = changes(6, i)
        seen += part
        spark.createDataFrame(part, CHANGES).coalesce(1).write.mode("append").parquet(f"{root}/in")
    s = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    levels.upsert_levels(s, f"{root}/out", f"{root}/cp", ["ticker", "date"], ["ts", "v"], fanout=3, file_rows=10).awaitTermination()
    live = levels.active(levels.folders(spark, f"{root}/out"))
    assert [(a, z) for _, a, z in live] == [(0, 26), (27, 29)]
    assert len(levels.folders(spark, f"{root}/out")) <= 2 + 2 * 3
    want = {}
    for t, d, v, ts in seen:
        want[t, d] = max(want.get((t, d), (dt.datetime.min, 0)), (ts, v))
    got = levels.read_levels(spark, f"{root}/out", ["ticker", "date"], ["ts", "v"], CHANGES)
    assert {(r["ticker"], r["date"]): (r["ts"], r["v"]) for r in got.collect()} == want
    files = data_files(f"{root}/out/{levels._name(3, 0, 26)}")
    assert 1 < len(files) <= 3
    levels.compact(spark, f"{root}/out", f"{root}/all", ["ticker", "date"], ["ts", "v"], CHANGES)
    assert spark.read.parquet(f"{root}/all").count() == len(want)


def test_reader_takes_the_widest_complete_folders():
    found = [(2, 0, 8), (1, 0, 2), (1, 9, 11), (0, 9, 9), (0, 12, 12), (1, 6, 8)]
    assert levels.active(sorted(found, key=lambda x: (-x[0], x[1]))) == [(2, 0, 8), (1, 9, 11), (0, 12, 12)]
    assert levels.active([]) == []


def test_hundred_batches_leave_log_many_folders():
    found, fan = [], 8
    for b in range(100):
        found.append((0, b, b))
        width, level = fan, 0
        while (b + 1) % width == 0:
            level += 1
            found.append((level, b + 1 - width, b))
            width *= fan
    assert len(levels.active(sorted(found, key=lambda x: (-x[0], x[1])))) == 1 + 4 + 4


def test_empty_levels(spark, tmp_path):
    assert levels.read_levels(spark, str(tmp_path / "none"), ["ticker"], ["ts"], CHANGES).count() == 0
