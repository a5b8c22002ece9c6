"""CSV files cut at every byte give the rows of an uncut read."""

import random

import pytest

from siftgraph.sources import tables as T
from siftgraph.sources.csv_split import read_csv_split, split_records


@pytest.fixture
def cut_at(spark):
    keys = {"spark.sql.files.maxPartitionBytes": None, "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in keys}

    def cut(size):
        for k, v in keys.items():
            spark.conf.set(k, v or str(size))

    yield cut
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def quoted(cell):
    return '"' + cell.replace('"', '""') + '"' if any(c in cell for c in ',"\n\r') else cell


def write(path, rows, end="\n", bom=""):
    path.write_bytes((bom + "".join(",".join(quoted(c) for c in r) + end for r in rows)).encode())


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_cut_at_every_byte(spark, tmp_path, cut_at):
    rows = [("id", "text", "x"), ("1", 'a "q", b\nline two\n\n"', "z"), ("2", "", "plain"), ("id", "text", "x"), ("3", "é\n中\r\nend", '"')]
    file = tmp_path / "a.csv"
    write(file, rows)
    want = rows_of(T.read_csv(spark, str(file)))
    assert want == sorted(rows[1:])
    for size in [*range(1, 24), 31, 47, 1000]:
        cut_at(size)
        assert rows_of(read_csv_split(spark, str(file))) == want, size


def test_many_files_long_cells_and_line_ends(spark, tmp_path, cut_at):
    rng = random.Random(2)
    alphabet = ["a", "b", ",", '"', "\n", "é", " ", '""', "\n\n"]
    everything = []
    for k, end in enumerate(["\n", "\r\n", "\n"]):
        rows = [(f"{k}-{i}", "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))), "t" * rng.randint(0, 4)) for i in range(40)]
        rows.append((f"{k}-long", "x\n" * 300 + '"', "end"))  # spans many ranges
        write(tmp_path / f"f{k}.csv", [("key", "text", "x y"), *rows], end, "﻿" if k == 0 else "")
        everything += rows
    for size in (50, 333, 10_000):
        cut_at(size)
        got = rows_of(read_csv_split(spark, str(tmp_path)))
        assert got == sorted(everything), size
    cut_at(64)
    assert read_csv_split(spark, str(tmp_path), ["x y", "key"]).columns == ["x y", "key"]
    assert split_records(spark, str(tmp_path)).select("start").distinct().count() > 3


def test_header_alone_and_no_end_of_line(spark, tmp_path, cut_at):
    cut_at(5)
    write(tmp_path / "h.csv", [("a", "b")])
    assert rows_of(read_csv_split(spark, str(tmp_path / "h.csv"))) == []
    (tmp_path / "n.csv").write_bytes(b'a,b\n1,"x\ny"')
    assert rows_of(read_csv_split(spark, str(tmp_path / "n.csv"))) == [("1", "x\ny")]
