"""Quoted line breaks, at any split."""

import csv
import random

import pytest

from weftline.sources import readers
from weftline.sources.quoted import ends_inside
from weftline.sources.readers import read
from weftline.sources.writers import export


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)

    yield cut
    for k, v in old.items():
        spark.conf.set(k, v)


def made(n, seed):
    rng = random.Random(seed)
    bits = ["a", "b c", '"', '""', ",", "\n", "\n\n", " ", "\t", "é", "x,y", '",\n"', "\r\n"]
    return [(i, f"t{i}" + "".join(rng.choice(bits) for _ in range(rng.randrange(0, 9))) + "z") for i in range(n)]


@pytest.mark.parametrize("sep", [",", "\t"])
@pytest.mark.parametrize("size", ["150", "1m"])
def test_python_csv_is_read_as_it_was_written(spark, tmp_path, small_splits, size, sep):
    small_splits(size)
    rows = made(60, 1)
    for part in range(2):
        with open(tmp_path / f"p{part}.csv", "w", newline="") as f:
            out = csv.writer(f, delimiter=sep, lineterminator="\r\n" if part else "\n")
            out.writerow(["id", "text"])
            out.writerows(rows[part * 30 : part * 30 + 30])
    got = read(spark, str(tmp_path), "csv" if sep == "," else "tsv")
    assert got.columns == ["id", "text"]
    assert sorted((int(r.id), r.text) for r in got.collect()) == rows


def test_export_is_read_back(spark, tmp_path, small_splits):
    small_splits("5k")
    rows = [(i, t, t[::-1]) for i, t in made(150, 2)] + [(1000, "  kept blanks \n ", None)]
    path = export(spark.createDataFrame(rows, "id long, text string, other string").repartition(3), str(tmp_path / "out"))
    got = read(spark, path, "csv")
    assert sorted((int(r.id), r.text, r.other) for r in got.collect()) == sorted(rows)


def test_one_record_over_many_splits(spark, tmp_path, small_splits):
    small_splits("40k")
    huge = "\n".join(f'line {i} with a "word" in quotes' for i in range(6_000))
    with open(tmp_path / "huge.csv", "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([["id", "text"], [1, "short"], [2, huge], [3, "a\nb"], [4, huge + "!"]])
    got = {int(r.id): r.text for r in read(spark, str(tmp_path / "huge.csv")).collect()}
    assert got == {1: "short", 2: huge, 3: "a\nb", 4: huge + "!"}


def test_names_and_schema(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('1,"a\nb"\n2,c\n')
    assert [tuple(r) for r in read(spark, str(path), header=["k", "v"]).orderBy("k").collect()] == [(1, "a\nb"), (2, "c")]
    assert read(spark, str(path), header=False).columns == ["column0", "column1"]
    typed = read(spark, str(path), header=False, schema="k long, v string")
    assert typed.dtypes == [("k", "bigint"), ("v", "string")] and typed.count() == 2
    with pytest.raises(ValueError):
        read(spark, str(path), header=["k"])


def test_quotes_within_plain_fields_open_nothing(spark, tmp_path):
    path = tmp_path / "inch.csv"
    path.write_text('name,size\npipe,5"\nrod,"7\n8"\nbar,9"\n')
    assert sorted((r.name, r.size) for r in read(spark, str(path)).collect()) == [("bar", '9"'), ("pipe", '5"'), ("rod", "7\n8")]


@pytest.mark.parametrize(
    ("line", "outside", "inside"),
    [("a,b", False, True), ('a,"b', True, False), ('"a""', True, False), ('"', True, False), ('5",x', False, False), ('""', False, True), ('a","b', True, True)],
)
def test_states(line, outside, inside):
    assert (ends_inside(line, False, ","), ends_inside(line, True, ",")) == (outside, inside)


def test_types_of_the_body_are_found_out_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = [(i, f'line "{i}"\nand, more', i / 2) for i in range(50)]
    spark.createDataFrame(rows, "k long, t string, x double").coalesce(1).write.option("header", "true").option("escape", '"').csv(path)
    inferred, infer = [], readers._infer
    monkeypatch.setattr(readers, "_infer", lambda reader, spark, lines: inferred.append(lines.count()) or infer(reader, spark, lines))
    out = readers.read(spark, path, "csv")
    assert [k for _, k in out.dtypes] == ["int", "string", "double"]
    assert sorted(map(tuple, out.collect())) == rows
    # the first line alone; the others' types are those of the result
    assert inferred == [1]
