"""Batches under a commit log: failures between any two steps neither repeat nor lose rows."""

import pytest
from pyspark.sql import types as T

from tests.conftest import collected
from wattsift.sources import batches

SCHEMA = "id long, folder string"  # a column named like one of the log
KIND = T.StructType([T.StructField("id", T.LongType()), T.StructField("folder", T.StringType())])


@pytest.fixture
def log(spark, rows, tmp_path):
    class Log:
        path = f"{tmp_path}/b"

        def write(self, batch, *ids):
            return batches.append_batch(rows(SCHEMA, *[(i, f"f{i}") for i in ids]), self.path, batch)

        def ids(self):
            return [i for (i,) in collected(batches.read_batches(spark, self.path, KIND), "id")]

        def compact(self, small_rows=100):
            return batches.compact(spark, self.path, KIND, ["id"], small_rows)

        def folders(self):
            return [n for _, n in batches.folders(spark, self.path)]

    return Log()


def failing(*_):
    raise OSError("lost before the commit")


def test_nothing_written_yet(log):
    assert log.ids() == [] and log.folders() == [] and log.compact() == 0


def test_a_batch_counts_once(log):
    assert log.write("a", 1, 2, 2) and not log.write("a", 1, 2, 2) and log.write("b", 3)
    assert log.ids() == [1, 2, 2, 3]


def test_a_write_that_dies_before_its_commit_is_tried_again(log, monkeypatch):
    log.write("a", 1)
    with monkeypatch.context() as m:
        m.setattr(batches, "_commit", failing)
        with pytest.raises(OSError):
            log.write("b", 2, 3)
    assert log.ids() == [1]
    assert log.write("b", 2, 3) and log.ids() == [1, 2, 3]


def test_two_tries_at_once_count_as_one(spark, log, monkeypatch):
    """Both looked at the log before either had entered its row."""
    log.write("a", 1)
    empty = batches.log_of(spark, f"{log.path}/none")
    with monkeypatch.context() as m:
        m.setattr(batches, "log_of", lambda *_: empty)
        assert log.write("a", 1) and log.write("b", 2) and log.write("b", 2)
    assert log.ids() == [1, 2]
    assert log.compact() == 2 and log.ids() == [1, 2]


def test_compaction_joins_small_folders_only(log, monkeypatch):
    for k in range(4):
        log.write(f"s{k}", k)
    log.write("large", *range(100, 150))
    log.write("empty")
    before = log.ids()
    with monkeypatch.context() as m:
        m.setattr(batches, "_commit", failing)
        with pytest.raises(OSError):
            log.compact(10)
    assert log.ids() == before and len(log.folders()) == 6
    assert log.compact(10) == 5 and log.ids() == before and sorted(log.folders()) == [4, 50]
    assert not log.write("s1", 1) and not log.write("empty")
    assert log.compact(10) == 0
    log.write("later", 900)
    assert log.compact(10) == 2 and log.ids() == sorted([*before, 900], key=lambda i: repr((i,))) and sorted(log.folders()) == [5, 50]
