"""Archives as logs of runs: several streams, compaction, ranges, what is written, and writers that meet."""

import os
import random

import pytest

from meshframe.operators import archive
from meshframe.streaming import incremental


def axis(spark, n, name="x"):
    return spark.range(n).selectExpr(f"cast(id as double) {name}", "id idx")


def folder(spark, path, rows, files=2):
    spark.createDataFrame(rows, "x double, v double").repartition(files).write.parquet(path)
    return incremental.file_stream(spark, path, "x double, v double")


def held(a):
    return {r.i_x: (r.v__sum, r.v__count) for r in a.sums().collect()}


def plain(rows):
    out = {}
    for x, v in rows:
        s, n = out.get(int(x), (0.0, 0))
        out[int(x)] = (s + v, n + 1)
    return out


def test_two_streams_share_an_archive(spark, tmp_path):
    """Each row counts once: with own checkpoints, with both streams staged at once, and after restarts."""
    rng = random.Random(1)
    one, two = ([(float(rng.randrange(30)), float(rng.randrange(100))) for _ in range(40)] for _ in range(2))
    streams = [folder(spark, str(tmp_path / n), rows) for n, rows in (("a", one), ("b", two))]
    a = archive.Archive(spark, str(tmp_path / "archive"), {"x": axis(spark, 30)}, ["v"])
    for n, s in enumerate(streams):
        incremental.into_archive(s, a, str(tmp_path / f"cp{n}"), every=5)
    assert held(a) == plain(one + two)
    for n, s in enumerate(streams):  # nothing new
        incremental.into_archive(s, archive.Archive(spark, a.path, a.axes, ["v"], existing="append"), str(tmp_path / f"cp{n}"))
    assert held(a) == plain(one + two)
    spark.createDataFrame(one[:7], "x double, v double").write.mode("append").parquet(str(tmp_path / "a"))
    incremental.into_archive(streams[0], a, str(tmp_path / "cp0"))
    assert held(a) == plain(one + two + one[:7])


def test_staged_runs_of_two_streams_do_not_meet(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 5.0)], "x double, v double")
    a = archive.Archive(spark, str(tmp_path / "archive"), {"x": axis(spark, 4)}, ["v"])
    a.stage(df, "e0", "one")
    a.stage(df, "e0", "two")
    a.flush(0, "one")
    assert held(a) == {1: (5.0, 1)} and a.mark("one") == 0 and a.mark("two") == -1 and len(a.fragments("two")) == 1
    a.flush(0, "two")
    assert held(a) == {1: (10.0, 2)} and a.mark("two") == 0


def _bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_flushes_write_little(spark, tmp_path, monkeypatch):
    """Ten flushes of 1 % each write less than twice their own data, and the runs of a zone stay few."""
    cells = 40_000
    a = archive.Archive(spark, str(tmp_path / "archive"), {"x": axis(spark, cells)}, ["v"], keep=100)
    a.stage(spark.range(cells).selectExpr("cast(id as double) x", "rand(1) v"))
    a.flush()
    written, new, write = [], [], archive.Archive._write

    def counted(self, sums, name):
        write(self, sums, name)
        (written if name.startswith("merged") else new).append(self._run(name).join("").uri)

    monkeypatch.setattr(archive.Archive, "_write", counted)
    for i in range(10):
        a.stage(spark.range(cells // 100).selectExpr(f"cast({i} * 397 + id as double) x", f"rand({i}) v"))
        a.flush()
    of = lambda uris: sum(_bytes(u) for u in uris)
    assert of([*new, *written]) < 2 * of(new)
    assert a.sums().count() == cells and sum(r.v__count for r in a.sums().collect()) == cells + 10 * (cells // 100)
    runs = a._version()["runs"]
    assert max(sum(z in zones for zones in runs.values()) for z in map(str, range(archive.ZONES))) < 2 * archive.FAN


def test_compaction_keeps_sums_and_old_versions(spark, tmp_path):
    rng = random.Random(3)
    a = archive.Archive(spark, str(tmp_path / "archive"), {"x": axis(spark, 64)}, ["v"], keep=4)
    rows = []
    for i in range(9):
        some = [(float(rng.randrange(64)), float(rng.randrange(9))) for _ in range(25)]
        rows += some
        a.stage(spark.createDataFrame(some, "x double, v double"))
        a.flush()
        assert held(a) == plain(rows)
    assert any(n.startswith("merged~") for n in a._version()["runs"])
    early = a._numbers()[0]
    assert a.sums(version=early).count() > 0 and len(a._numbers()) <= 5
    again = archive.Archive(spark, a.path, a.axes, ["v"], existing="append")
    assert held(again) == plain(rows)


def test_a_range_opens_only_its_zones(spark, tmp_path):
    a = archive.Archive(spark, str(tmp_path / "archive"), {"x": axis(spark, 320)}, ["v"])
    for i in range(3):
        a.stage(spark.range(320).selectExpr("cast(id as double) x", f"cast(id + {i} as double) v"))
        a.flush()
    some = a.sums((20, 39))
    assert len({f.split("zone=")[1].split("/")[0] for f in some.inputFiles()}) == 2
    assert {r.i_x: r.v__sum for r in some.collect()} == {i: 3.0 * i + 3 for i in range(20, 40)}
    assert [r.x for r in a.read((5, 6)).orderBy("x").collect()] == [5.0, 6.0]


def test_writers_that_meet(spark, tmp_path):
    """A version that another writer took first is read and built upon; a compaction whose runs are gone is dropped."""
    path, axes = str(tmp_path / "archive"), {"x": axis(spark, 8)}
    a = archive.Archive(spark, path, axes, ["v"])
    b = archive.Archive(spark, path, axes, ["v"], existing="append")
    df = spark.createDataFrame([(1.0, 1.0), (3.0, None)], "x double, v double")
    a.stage(df, "e", "a")
    b.stage(df, "e", "b")
    version = a._version
    calls = []

    def late(number=None):
        found = version(number)
        if len(calls) == 1:
            calls.append(1)
            b.flush(0, "b")
        calls.append(1)
        return found

    a._version = late
    a.flush(0, "a")
    a._version = version
    assert {i: n for i, (_, n) in held(a).items() if n} == {1: 2} and a._version()["marks"] == {"a": 0, "b": 0}


def test_unfilled_version_is_passed_over(spark, tmp_path):
    a = archive.Archive(spark, str(tmp_path / "archive"), {"x": axis(spark, 8)}, ["v"])
    df = spark.createDataFrame([(1.0, 1.0)], "x double, v double")
    a.stage(df)
    a.flush()
    a._home.join("log", f"v{a.generation() + 1}").write_new("{")
    assert held(a) == {1: (1.0, 1)}
    a.stage(df)
    a.flush()
    assert held(a) == {1: (2.0, 2)}


def test_nothing_staged(spark, tmp_path):
    a = archive.Archive(spark, str(tmp_path / "archive"), {"x": axis(spark, 8)}, ["v"])
    a.flush(3, "s")
    assert a.generation() == -1 and a.sums().count() == 0
    a.stage(spark.createDataFrame([], "x double, v double"), "e0", "s")
    a.flush(0, "s")
    assert a.mark("s") == 0 and a.sums().count() == 0
    with pytest.raises(ValueError):
        archive.Archive(spark, a.path, a.axes, ["w"], existing="append")
