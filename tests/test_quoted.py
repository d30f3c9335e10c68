"""Quoted CSV in many stretches against Spark's own reader, which reads a file in one task."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import collected
from wattsift.sources import files
from wattsift.sources.quoted import read_quoted, read_records

COLUMNS = "ID BIGINT, CATEGORY STRING, PROMPT STRING"


@pytest.fixture
def small_stretches(spark):
    """Files are dealt in stretches of about a hundred bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for name in names:
        spark.conf.set(name, "100")
    yield
    for name in names:
        spark.conf.unset(name)


def quoted(cell: str) -> str:
    return '"' + cell.replace('"', '""') + '"'


def invented(seed: int, n: int) -> list[tuple]:
    rnd = random.Random(seed)
    bits = ["a", "b c", '"', '""', ",", "\n", "\r\n", "\n\n", " ", "é日", "x" * 30, "line\n" * 60, '",\n"']
    return [(k, rnd.choice(["Math", "", "a,b", 'say "x"']), "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 9)))) for k in range(n)]


def write(path, records, end="\n", bom=False, last=True, header="ID,CATEGORY,PROMPT"):
    lines = [header, *(f"{k},{quoted(c)},{quoted(p)}" for k, c, p in records)]
    text = ("﻿" if bom else "") + end.join(lines) + (end if last else "")
    path.write_bytes(text.encode())


@pytest.mark.parametrize("seed", range(3))
def test_rows_are_those_of_one_task(spark, tmp_path, small_stretches, seed):
    records = invented(seed, 150)
    for k in range(2):
        write(tmp_path / f"{k}.csv", records[75 * k : 75 * k + 75], end=["\n", "\r\n"][(seed + k) % 2], bom=seed % 3 == 0, last=seed % 2 == 0)
    lines = spark.read.option("lineSep", "\n").text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 20  # many tasks read the files
    got = collected(read_quoted(spark, str(tmp_path), COLUMNS))
    assert got == sorted([(k, c or None, p or None) for k, c, p in records], key=repr)
    breaks = F.regexp_replace("PROMPT", "\r\n", "\n").alias("PROMPT")  # Spark's reader turns these inside of fields
    theirs = files.read_csv(spark, str(tmp_path), COLUMNS).select("ID", "CATEGORY", breaks)
    assert collected(read_quoted(spark, str(tmp_path), COLUMNS).select("ID", "CATEGORY", breaks)) == collected(theirs)


def test_a_record_over_many_stretches(spark, tmp_path, small_stretches):
    records = [(1, "a", "x\n" * 2000), (2, "b", 'y"\n' * 500), (3, "c", "z")]
    write(tmp_path / "p.csv", records)
    assert collected(read_quoted(spark, str(tmp_path), COLUMNS)) == records


def test_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('PROMPT,Extra,ID,CATEGORY\n"p, q",zz,1,Math\n')
    (tmp_path / "b.csv").write_text("ID,CATEGORY,PROMPT\n2,Art,r\n")
    assert collected(read_quoted(spark, str(tmp_path), COLUMNS)) == [(1, "Math", "p, q"), (2, "Art", "r")]
    (tmp_path / "c.csv").write_text("ID,PROMPT\n2,r\n")
    with pytest.raises(ValueError, match="CATEGORY"):
        read_quoted(spark, str(tmp_path), COLUMNS)
    (tmp_path / "c.csv").write_text("ID,CATEGORY,PROMPT,ID\n2,a,r,3\n")
    with pytest.raises(ValueError, match="repeats"):
        read_quoted(spark, str(tmp_path), COLUMNS)


def test_unreadable_cells_leave_their_record(spark, tmp_path):
    (tmp_path / "p.csv").write_text('ID,CATEGORY,PROMPT\n1,Math,a\nx,Art,b\n,Art,c\n" ",,""\n5,Art\n6,Art,"d",e\n7,"q\nr",f\n')
    got = collected(read_quoted(spark, str(tmp_path), COLUMNS, corrupt="bad"))
    assert {r[2]: r for r in got if r[2] in ("a", "b", "c", None, "f") and r[0] != 5} == {
        "a": (1, "Math", "a", None), "b": (None, "Art", "b", "x,Art,b"), "c": (None, "Art", "c", None), None: (None, None, None, None),
        "f": (7, "q\nr", "f", None),
    }
    assert {r[3] for r in got if r[3]} == {"x,Art,b", "5,Art", '6,Art,"d",e'}


def test_empty_and_blank_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("ID,CATEGORY,PROMPT")
    assert collected(read_quoted(spark, str(tmp_path / "p.csv"), COLUMNS)) == []
    (tmp_path / "p.csv").write_text("ID,CATEGORY,PROMPT\n\n  \n1,a,b\n\n")
    assert collected(read_quoted(spark, str(tmp_path / "p.csv"), COLUMNS)) == [(1, "a", "b")]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "p.csv").write_text("")
    assert read_quoted(spark, str(tmp_path / "empty"), COLUMNS).count() == 0


def test_an_unclosed_field_reaches_to_the_end_of_its_file(spark, tmp_path, small_stretches):
    (tmp_path / "a.csv").write_text('ID,CATEGORY,PROMPT\n1,a,b\n2,c,"open\n' + "more\n" * 100)
    (tmp_path / "b.csv").write_text("ID,CATEGORY,PROMPT\n" + "3,d,e\n" * 50)
    records, headers = read_records(spark, str(tmp_path))
    assert headers == ["ID,CATEGORY,PROMPT"] and records.count() == 52
    assert records.filter(F.col("record").startswith("2,c")).first().record.count("more") == 100


def test_other_stretches_than_before_are_noticed(spark, tmp_path, monkeypatch):
    """If the second pass sees the file dealt otherwise, both are run again; it is never read wrong."""
    from wattsift.sources import quoted as Q

    write(tmp_path / "p.csv", invented(1, 100))
    tries, real = [], Q._stretches

    def surveyed(lines):
        tries.append(1)
        return real(lines).filter("begin < 0" if len(tries) == 1 else "true")

    monkeypatch.setattr(Q, "_stretches", surveyed)
    assert read_quoted(spark, str(tmp_path), COLUMNS).count() == 100 and len(tries) == 2
