"""Decisions on a file are made on all of its lines."""

import pytest

from weftline.sources.readers import read
from weftline.streaming.ingest import into_incremental


@pytest.mark.parametrize("place", [0, 250])
def test_header_does_not_depend_on_where_a_value_stands(spark, tmp_path, place):
    rows = [f"a{i},b{i}" for i in range(300)]
    rows[place] = "x,kind"  # a value equal to a name: the first line is data too
    path = tmp_path / "t.csv"
    path.write_text("\n".join(["name,kind", *rows]))
    got = read(spark, str(path))
    assert got.columns == ["column0", "column1"] and got.count() == 301


def test_longer_blank_separated_line_is_not_cut(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("a b\n1 2\n3 4 5\n")
    with pytest.raises(ValueError, match="3 fields"):
        read(spark, str(path), sep=" ")


def test_rows_of_more_batches_than_are_kept(spark, tmp_path):
    kept = "spark.sql.streaming.numRecentProgressUpdates"
    spark.range(8).repartition(6).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get(kept)
    spark.conf.set(kept, "3")
    try:
        got = into_incremental(spark, "many_batches", str(tmp_path / "in"), "id long", checkpoint=str(tmp_path / "c"), files_per_batch=1)
        assert spark.conf.get(kept) == "3"
    finally:
        spark.conf.set(kept, before)
    assert got.rows == 8
