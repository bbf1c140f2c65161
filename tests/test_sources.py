import gzip

import pytest

from weftline import Workspace
from weftline.sources.readers import detect_format, group_count, parse_regex, read, read_regex
from weftline.sources.writers import export


def put(path, text):
    path.write_text(text)
    return str(path)


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_csv_import_reports_rows(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path / "t"))
    path = put(tmp_path / "test.csv", "name,value\nalpha,10\nbeta,20\ngamma,30\n")
    assert ws.into("test_data_t", path) == 3
    assert values(ws.table("test_data_t")) == [("alpha", 10), ("beta", 20), ("gamma", 30)]
    assert ws["test_data_t"].kind == "table"


@pytest.mark.parametrize(
    "text, columns",
    [
        ("1,2\n3,4\n", ["column0", "column1"]),
        ("x,y\n1,2\n3,4\n", ["x", "y"]),
        ("name,city\nann,rome\nbob,oslo\n", ["name", "city"]),
        ("ann,rome\nbob,oslo\nann,oslo\n", ["column0", "column1"]),
        ("512,1700000000.5,/home,a b.txt\n9,1700000001.0,/tmp,c\n", ["column0", "column1", "column2", "column3"]),
    ],
)
def test_header_is_found_out(spark, tmp_path, text, columns):
    assert read(spark, put(tmp_path / "f.csv", text)).columns == columns


def test_malformed_cell_and_explicit_schema(spark, tmp_path):
    path = put(tmp_path / "f.csv", "a,b\n1,x\noops,y\n")
    assert values(read(spark, path, schema="a INT, b STRING").na.fill(-1)) == [(-1, "y"), (1, "x")]


def test_blank_separated(spark, tmp_path):
    path = put(tmp_path / "vmstat.txt", " 1  0   0 81234  12 99\n 0  2 0 7 1   5\n")
    out = read(spark, path, sep=" ", header=["r", "b", "swpd", "free", "buff", "cache"])
    assert values(out) == [(0, 2, 0, 7, 1, 5), (1, 0, 0, 81234, 12, 99)]
    assert dict(out.dtypes)["free"] == "bigint"
    with pytest.raises(ValueError):
        read(spark, path, sep=" ", header=["too", "few"])


def test_tsv_json_gz_glob(spark, tmp_path):
    assert values(read(spark, put(tmp_path / "a.tsv", "x\ty\n1\tq\n"))) == [(1, "q")]
    out = read(spark, put(tmp_path / "a.jsonl", '{"a": 1}\n{"b": {"c": [1, 2]}}\n'))
    assert out.columns == ["a", "b"] and out.count() == 2
    with gzip.open(tmp_path / "z.csv.gz", "wt") as f:
        f.write("x,y\n1,2\n")
    assert values(read(spark, str(tmp_path / "z.csv.gz"))) == [(1, 2)]
    for i in range(2):
        spark.range(i * 5, i * 5 + 5).write.parquet(str(tmp_path / f"p{i}.parquet"))
    assert read(spark, str(tmp_path / "p*.parquet")).count() == 10


def test_formats():
    assert [detect_format(p) for p in ("a.csv", "b.TSV", "c.jsonl.gz", "d/*.parquet", "e.json.bz2", "f.log")] == [
        "csv", "tsv", "json", "parquet", "json", "csv",
    ]
    with pytest.raises(ValueError):
        detect_format("x.csv.zst")


def test_regex_import(spark, tmp_path):
    path = put(tmp_path / "ufw.log", "SRC=1.2.3.4 DPT=22 PROTO=TCP\nnoise\nSRC=5.6.7.8 DPT=53 PROTO=UDP\n")
    table, rejects = read_regex(spark, path, r"SRC=([0-9.]+).*DPT=([0-9]+).*PROTO=(\w+)", ["src_ip", "dst_port", "proto"])
    assert values(table) == [("1.2.3.4", "22", "TCP"), ("5.6.7.8", "53", "UDP")]
    assert tuple(rejects.head()) == (2, 1)
    assert tuple(parse_regex(spark.createDataFrame([(None,)], "v string"), "v", "(x)", ["a"])[1].head()) == (0, 1)
    with pytest.raises(ValueError):
        read_regex(spark, path, r"(\w+) (\w+)", ["one"])


def test_group_count():
    assert [group_count(p) for p in (r"(a)(b)", r"\((a)", r"(?:a)(?<n>b)(?=c)", r"[(](x)", r"\\(a)")] == [2, 1, 1, 1, 1]


def test_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", ok'), (2, None)], "id bigint, s string")
    for fmt, kind in (("csv", "csv"), ("jsonl", "json"), ("parquet", "parquet")):
        path = export(df, str(tmp_path / f"out_{fmt}"), fmt)
        back = read(spark, path, kind, schema="id bigint, s string")
        assert {r["id"]: r["s"] for r in back.collect()} == {1: 'say "hi", ok', 2: None}
    with pytest.raises(ValueError):
        export(df, str(tmp_path / "x"), "png")
