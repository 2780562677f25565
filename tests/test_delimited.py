"""Delimited files read in splits against the reading of whole files."""

import csv
import io
import os
import random

import pytest

import sparkprofile as sp
from sparkprofile.functions.session import made_folders
from sparkprofile.sources.delimited import TASKS_PER_CORE, LineReader
from sparkprofile.sources.loader import scan_text


def text_of(rows, ending="\n", sep=",", quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO()
    csv.writer(out, delimiter=sep, lineterminator=ending, quoting=quoting).writerows(rows)
    return out.getvalue()


def nasty(seed, n=400):
    draw = random.Random(seed)
    cells = ["", "x", "1", 'say "hi"', "a,b", "two\nlines", "\n\n", '"', '""', ',"', '"\n"', "tab\there", "é日", "long " * 30, " pad ", "\n" * 5, "NA", "it's", 'q"q,\n"']
    return [["a", "b", "c"], *([draw.choice(cells) for _ in range(2)] + [f"r{i}"] for i in range(n))]


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*[f"`{c}`" for c in df.columns]).na.fill("\x00").collect())


@pytest.mark.parametrize("seed", range(6))
def test_equals_whole_files(spark, tmp_path, seed):
    folder = tmp_path / "data"
    folder.mkdir()
    ending, sep = ("\n", "\r\n")[seed % 2], ",\t;"[seed % 3]
    quoting = (csv.QUOTE_MINIMAL, csv.QUOTE_ALL)[seed // 3]
    for k in range(3):
        (folder / f"part{k}.csv").write_bytes(text_of(nasty(10 * seed + k, (400, 30, 0)[k]), ending, sep, quoting).encode())
    whole = scan_text(spark, str(folder), sep, multiLine=True)
    parts = scan_text(spark, str(folder), sep, split=(700, 97)[seed % 2])
    assert parts.columns == whole.columns == ["a", "b", "c"]
    assert rows_of(parts) == rows_of(whole) and parts.count() == 430


def test_cells_longer_than_splits(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(text_of([["a", "b"], ["1", "line\n" * 500], ["2", "x" * 3000], ["3", "y"], ["4", '"\n",' * 200], ["5", "last\n"]]))
    parts = scan_text(spark, str(path), split=200)
    assert rows_of(parts) == rows_of(scan_text(spark, str(path), multiLine=True)) and parts.count() == 5


def test_header_over_splits_and_no_header(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(text_of([["name\n" * 40 + "x", "b"], ["1", "p\nq"], ["2", "z"]]))
    parts = scan_text(spark, str(path), split=60)
    assert parts.columns == ["name\n" * 40 + "x", "b"] and rows_of(parts) == [("1", "p\nq"), ("2", "z")]
    path.write_text('1,"a\nb"\n2,c\n' * 30)
    plain = scan_text(spark, str(path), split=50, header=False)
    assert plain.columns == ["_c0", "_c1"] and plain.count() == 60 and rows_of(plain) == rows_of(scan_text(spark, str(path), header=False, multiLine=True))


def test_literal_quotes_blank_lines_and_marks(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("﻿size,n\n" + '5" pipe,1\n\nx "y" z,2\n"closed" tail,3\n"a ""b""\n\nc",4\n' * 40)
    parts = scan_text(spark, str(path), split=77)
    assert parts.columns == ["size", "n"]
    assert rows_of(parts) == rows_of(scan_text(spark, str(path), multiLine=True)) and parts.count() == 160


def test_types_and_malformed_rows(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("i,s\n" + '1,"a\nb"\n' * 200)
    assert sp.scan_csv(spark, str(path), split=100).dtypes == [("i", "bigint"), ("s", "string")]
    path.write_text("i,s\n" + '1,"a\nb"\n' * 200 + "1,2,3\n")
    with pytest.raises(Exception, match="MALFORMED"):
        scan_text(spark, str(path), split=100).collect()


def test_many_tasks_read_one_file(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("i,s\n" + '1,"a\nb"\n' * 2000)
    seen = scan_text(spark, str(path), split=2000)
    assert seen.count() == 2000
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") != "2000"


def test_lines_as_a_state_machine():
    reader = LineReader(",", '"')

    def by_hand(line, inside):
        state = "in" if inside else "start"
        i = 0
        while i < len(line):
            c = line[i]
            if state == "in":
                if c == '"':
                    if line[i + 1 : i + 2] == '"':
                        i += 1
                    else:
                        state = "rest"
            elif c == ",":
                state = "start"
            elif state == "start" and c == '"':
                state = "in"
            else:
                state = "rest"
            i += 1
        return state == "in"

    draw = random.Random(0)
    for _ in range(20_000):
        line = "".join(draw.choice('a",') for _ in range(draw.randrange(9)))
        for inside in (False, True):
            assert reader.inside_after(line, inside) == by_hand(line, inside), (line, inside)


def test_a_task_takes_many_small_splits(spark, tmp_path):
    """Splits far smaller than Spark's own are dealt to a few tasks, and records are written parsed."""
    path = tmp_path / "a.csv"
    path.write_bytes(text_of(nasty(77, 1500), "\r\n").encode())
    assert path.stat().st_size > 200 * 150
    parts = scan_text(spark, str(path), split=200)
    folder = made_folders(spark)[-1]
    files = [f for f in os.listdir(folder) if f.endswith(".parquet")]
    assert len(files) <= TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert "r" in spark.read.parquet(folder).columns
    assert rows_of(parts) == rows_of(scan_text(spark, str(path), multiLine=True)) and parts.count() == 1500
