"""Batch files: ranks read their own files, and one that dies goes on where it was."""

import os

import pytest
from pyspark.sql import functions as F

from meshframe.operators import batchfiles, batching


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("batches") / "b")
    df = spark.range(1003).select(F.col("id"), (F.col("id") * 0.5).alias("x"), F.concat(F.lit("s"), F.col("id")).alias("s"))
    batched = batching.batches(df, "id", 20, seed=3)
    manifest = batchfiles.write_batches(batched, path, 4).collect()
    return path, {(r.id, r.batch) for r in batched.collect()}, manifest


def test_ranks_resume_and_see_each_row_once(written, monkeypatch):
    path, want, _ = written
    opened = []
    files_at = batchfiles.files_at

    class Watched:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def open_input_file(self, p):
            if batchfiles.MANIFEST not in p:
                opened.append(os.path.basename(p))
            return self.fs.open_input_file(p)

    got, of_rank = [], {}
    for rank in range(4):
        monkeypatch.setattr(batchfiles, "files_at", lambda p: (Watched(files_at(p)[0]), files_at(p)[1]))
        reader = batchfiles.BatchReader(path, rank, 4)
        mine = [f for f, _, _ in reader.files()]
        position = 0
        for position, batch, table in reader:
            assert table.num_rows == (20 if batch < 50 else 3) and table["row"].to_pylist() == list(range(batch * 20, batch * 20 + table.num_rows))
            got += zip(table["id"].to_pylist(), table["batch"].to_pylist())
            if rank == 1 and position == 6:
                break  # it dies
        if rank == 1:
            before = len(opened)
            for position, _, table in batchfiles.BatchReader(path, 1, 4, position):
                got += zip(table["id"].to_pylist(), table["batch"].to_pylist())
            assert mine[0] not in opened[before:]  # read to its end before
        of_rank[rank] = set(opened)
        assert set(opened) <= set(mine) and position == len(reader)
        opened.clear()
    assert sorted(got) == sorted(want) and len(got) == 1003
    assert sum(map(len, of_rank.values())) == 13


def test_more_ranks_than_files_and_nothing(spark, written, tmp_path):
    path, want, manifest = written
    assert sum(r.rows for r in manifest) == 1003 and sorted(r.first for r in manifest) == list(range(0, 51, 4))
    assert sum(len(batchfiles.BatchReader(path, r, 30)) for r in range(30)) == 51 and not list(batchfiles.BatchReader(path, 29, 30))
    assert not list(batchfiles.BatchReader(path, 0, 1, 51))
    none = batching.batches(spark.range(0), "id", 20)
    assert batchfiles.write_batches(none, str(tmp_path / "none")).count() == 0 and not list(batchfiles.BatchReader(str(tmp_path / "none")))
    with pytest.raises(ValueError):
        batchfiles.BatchReader(path, 4, 4)


def test_read_by_tasks(spark, written):
    path, want, _ = written
    rows = batchfiles.read_ranks(spark, path, 3, "id long, x double, s string, row long, batch long").collect()
    assert {(r.id, r.batch) for r in rows} == want and len(rows) == 1003 and all(r["rank"] == r.batch // 4 % 3 for r in rows)
