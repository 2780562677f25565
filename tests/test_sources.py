"""Readers: null tokens, inference, encodings, formats."""

import json

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException

import sparkprofile as sp


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_tokens_and_types(spark, tmp_path):
    path = write(
        tmp_path / "a.csv",
        "i,f,b,d,t,s,z,mixed\n1,1.5,true,2020-01-02,2020-01-02 03:04:05,x,007,1\nNA,N/A,null,NULL,,NA,008,2.5\n"
        "-3,2e3,False,2021-12-31,2021-01-01T00:00:00,y,,x\n",
    )
    df = sp.load_dataset(spark, path)
    assert dict(df.dtypes) == {
        "i": "bigint", "f": "double", "b": "boolean", "d": "date", "t": "timestamp_ntz", "s": "string", "z": "bigint",
        "mixed": "string",
    }
    gaps = {r["column"]: r.missing_count for r in sp.missing_columns(df).collect()}
    assert gaps == {"i": 1, "f": 1, "b": 1, "d": 1, "t": 1, "s": 1, "z": 1, "mixed": 0}


def test_tsv_and_unknown_suffix(spark, tmp_path):
    df = sp.load_dataset(spark, write(tmp_path / "a.tsv", "a\tb\n1\tx, y\n"))
    assert df.first().asDict() == {"a": 1, "b": "x, y"}
    assert sp.detect_format("data.unknown") == "csv" and sp.detect_format("x/part.PQ") == "parquet"
    with pytest.raises(ValueError):
        sp.load_dataset(spark, "x", "excel")


def test_bad_value_after_the_sample_raises(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a\n" + "1\n" * 50 + "oops\n")
    df = sp.scan_csv(spark, path, infer_rows=10)
    assert df.dtypes == [("a", "bigint")]
    with pytest.raises(PySparkException):
        df.collect()


def test_invalid_utf8(spark, tmp_path):
    path = write(tmp_path / "a.csv", "name,n\ncafé,1\nplain,2\n", "latin-1")
    df = sp.load_dataset(spark, path)
    assert [tuple(r) for r in sp.invalid_utf8_rows(df).collect()] == [("name", 1)]
    right = sp.load_dataset(spark, path, encoding="ISO-8859-1")
    assert right.first()["name"] == "café"
    info = sp.dataset_info(spark, path).first()
    assert info.rows == 2 and info.warnings == ["invalid_utf8: 1 cells"]


def test_duplicate_header_is_reported(spark, tmp_path):
    info = sp.dataset_info(spark, write(tmp_path / "a.csv", "a,a,column_1\n1,2,3\n")).first()
    assert info.column_names == ["a", "a", "column_1"]
    assert info.warnings == ["duplicate_columns: a", "unnamed_columns: 1"]


def test_json_variants(spark, tmp_path):
    rows = [{"a": 1, "b": "x"}, {"a": None, "b": "y"}]
    lines = write(tmp_path / "a.jsonl", "\n".join(json.dumps(r) for r in rows))
    array = write(tmp_path / "a.json", json.dumps(rows, indent=1))
    for path in (lines, array):
        found = sorted((r.asDict() for r in sp.load_dataset(spark, path).collect()), key=lambda r: r["b"])
        assert found == rows


@pytest.mark.parametrize("stream", [False, True])
def test_arrow_batches_are_partitions(spark, tmp_path, stream):
    path = tmp_path / "a.arrow"
    schema = pa.schema([("a", pa.int64()), ("s", pa.dictionary(pa.int32(), pa.string())), ("t", pa.timestamp("us"))])
    with (pa.ipc.new_stream if stream else pa.ipc.new_file)(str(path), schema) as sink:
        for k in range(3):
            arrays = [pa.array([3 * k, 3 * k + 1, None]), pa.array(["x", "y", "x"]).dictionary_encode(), pa.array([0, 1, 2], pa.timestamp("us"))]
            sink.write_batch(pa.record_batch(arrays, schema=schema))
    df = sp.load_dataset(spark, str(path))
    assert df.dtypes == [("a", "bigint"), ("s", "string"), ("t", "timestamp_ntz")]
    assert df.count() == 9 and df.where("a is null").count() == 3
    assert df.rdd.getNumPartitions() == (1 if stream else 3)
    assert sp.load_dataset(spark, str(tmp_path / "*.arrow")).select("s").distinct().count() == 2


def test_preview(spark, tmp_path):
    parts = sp.preview_dataset(spark, write(tmp_path / "a.csv", "a,b\n1,x\n2,y\n3,z\n"), n_rows=2)
    assert parts["info"].first().format == "csv" and parts["info"].first().file_size_mb > 0
    assert parts["rows"].count() == 2
    assert [(r.column, r.dtype) for r in parts["columns"].orderBy("position").collect()] == [("a", "bigint"), ("b", "string")]


def test_quoted_cells(spark, tmp_path):
    path = write(tmp_path / "q.csv", 'a,b\n1,"say ""hi"", ok"\n2,"x, ""y"""\n3,"two\nlines"\n4,"say ""hi"" ok"\n')
    assert [tuple(r) for r in sp.scan_csv(spark, path).orderBy("a").collect()] == [
        (1, 'say "hi", ok'), (2, 'x, "y"'), (3, "two\nlines"), (4, 'say "hi" ok'),
    ]


def test_types_come_from_all_rows(spark, tmp_path):
    path = write(tmp_path / "n.csv", "a\n" + "1\n" * 12_000 + "1.5\n")
    assert sp.scan_csv(spark, path).dtypes == [("a", "double")]


def arrow_file(path, first, rows, batches=4):
    schema = pa.schema([("a", pa.int64()), ("x", pa.float64()), ("s", pa.string())])
    with pa.ipc.new_file(str(path), schema) as sink:
        for k in range(batches):
            a = list(range(first + k * rows, first + (k + 1) * rows))
            x = [None if i % 5 == 0 else float("nan") if i % 7 == 0 else i / 2 for i in a]
            sink.write_batch(pa.record_batch([pa.array(a, pa.int64()), pa.array(x, pa.float64()), pa.array([f"s{i % 3}" for i in a])], schema=schema))
    return str(path)


def test_arrow_filters_read_fewer_batches(tmp_path):
    from pyspark.sql import types as T
    from sparkprofile.sources.arrow import ArrowReader

    path = arrow_file(tmp_path / "a.arrow", 0, 10)
    schema = T.StructType().add("a", "long").add("x", "double").add("s", "string")

    def read(*filters):
        reader = ArrowReader([[path, 1000, 4]], schema, 1, filters)
        found = [[r for b in reader.read(p) for r in b.to_pylist()] for p in reader.partitions()]
        return [len(f) for f in found], [r["a"] for f in found for r in f]

    assert read()[0] == [10, 10, 10, 10]
    assert read(("a", ">", 35)) == ([0, 0, 0, 4], [36, 37, 38, 39])
    assert read(("a", "in", [3, 12, None])) == ([1, 1, 0, 0], [3, 12])
    assert read(("s", "=", "none"))[0] == read(("a", "=", None))[0] == [0, 0, 0, 0]
    assert read(("x", "is null")) == read(("x", "is null"), ("a", ">=", 0)) == ([2, 2, 2, 2], list(range(0, 40, 5)))
    assert read(("x", ">", 19.0))[1] == [7, 14, 21, 28, 39]  # NaN is larger than any number
    assert len(read(("x", "<=", float("nan")))[1]) == len(read(("a", "<", 0.5))[1]) == 40  # left to Spark
    assert len(ArrowReader([[path, 1000, 4]], schema, 500).partitions()) == 2


def test_arrow_filters_compare_as_spark(spark, tmp_path):
    """Single precision is compared in double precision; a text is not a number."""
    batch = pa.record_batch([pa.array([0.1, 0.2, None], pa.float32()), pa.array(["05", "5", "x"])], names=["f", "s"])
    with pa.ipc.new_file(str(tmp_path / "f.arrow"), batch.schema) as sink:
        sink.write_batch(batch)
    for filters, rows in [([("f", ">", 0.1)], 2), ([("f", "=", 0.1)], 0), ([("f", "<=", 1)], 2), ([("s", "in", ["05", "5"])], 2)]:
        assert sp.scan_arrow(spark, str(tmp_path), filters=filters).count() == rows, filters


def test_arrow_filters_give_what_spark_gives(spark, tmp_path):
    arrow_file(tmp_path / "a.arrow", 0, 10)
    arrow_file(tmp_path / "b.arrow", 40, 10)
    (tmp_path / "notes.txt").write_text("not read")
    df = sp.scan_arrow(spark, str(tmp_path))
    rows = df.collect()
    assert len(rows) == 80 and df.rdd.getNumPartitions() == 8
    plain = spark.createDataFrame(rows, df.schema)
    nan = float("nan")
    for filters, test in [
        ([("a", ">", 70), ("x", "is not null")], "a > 70 AND x IS NOT NULL"), ([("x", ">", 30.0)], "x > 30"), ([("x", "=", nan)], "isnan(x)"),
        ([("x", "<=", nan)], "x IS NOT NULL"), ([("s", "=", "s1"), ("a", "<=", 12)], "s = 's1' AND a <= 12"), ([("a", "in", [1, 41, 99])], "a IN (1, 41, 99)"),
        ([("a", "<", 1.5)], "a < 1.5"), ([("x", "in", [0.5, nan])], "x = 0.5 OR isnan(x)"),
    ]:
        found = sp.scan_arrow(spark, str(tmp_path), filters=filters)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, plain.where(test).collect())), test
        assert df.where("a = 3 OR s = 's1'").count() == plain.where("a = 3 OR s = 's1'").count()
    assert sp.scan_arrow(spark, str(tmp_path), columns=["s"], filters=[("a", "=", 4)]).collect() == [("s1",)]
    assert sp.load_dataset(spark, str(tmp_path / "a.arrow"), columns=["s", "missing"]).dtypes == [("s", "string")]
    with pytest.raises(ValueError, match="unknown test"):
        sp.scan_arrow(spark, str(tmp_path), filters=[("a", "like", 1)])


def test_arrow_paths_are_sparks_own(spark, tmp_path):
    path = arrow_file(tmp_path / "a b%1.arrow", 0, 2)
    assert sp.scan_arrow(spark, path).count() == sp.scan_arrow(spark, f"file://{path}").count() == 8
    with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
        sp.scan_arrow(spark, str(tmp_path / "none.arrow"))
    from sparkprofile.sources.arrow import file_system

    assert file_system("file:/a/b c")[1] == file_system("file:///a/b c")[1] == "/a/b c"


def test_arrow_files_of_several_schemas(spark, tmp_path):
    arrow_file(tmp_path / "a.arrow", 0, 2, 1)
    with pa.ipc.new_file(str(tmp_path / "b.arrow"), pa.schema([("a", pa.int64())])) as sink:
        sink.write_batch(pa.record_batch([pa.array([7])], names=["a"]))
    with pa.ipc.new_file(str(tmp_path / "c.arrow"), pa.schema([("a", pa.int64())])):
        pass  # no batch
    rows = sorted(tuple(r) for r in sp.scan_arrow(spark, str(tmp_path)).select("a", "s").collect())
    assert rows == [(0, "s0"), (1, "s1"), (7, None)]


def test_type_of_single_cells_and_pairs(spark):
    kinds = {
        "5": "bigint", "+5": "bigint", "9" * 20: "double", "5.": "double", ".5": "double", "1e400": "double", "inf": "double", "TRUE": "boolean",
        "2020-02-29": "date", "2021-02-29": "string", "2020-01-01 10:00": "timestamp_ntz", "2020-01-01T25:00:00": "string", "-": "string", "1 2": "string",
    }
    pairs = {
        ("5", "1.5"): "double", ("5", "9" * 20): "double", ("2020-01-01", "2020-01-01 10:00"): "timestamp_ntz", ("5", "true"): "string",
        ("2020-01-01", "5"): "string", ("5", None): "bigint", (None, None): "string", ("2020-01-01", "2021-02-29"): "string",
    }
    wanted = [*((v, v, t) for v, t in kinds.items()), *((*p, t) for p, t in pairs.items())]
    schema = ", ".join(f"c{i} string" for i in range(len(wanted)))
    df = spark.createDataFrame([[w[0] for w in wanted], [w[1] for w in wanted]], schema)
    assert [t for _, t in sp.infer_types(df).dtypes] == [w[2] for w in wanted]
