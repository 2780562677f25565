"""Hand-made edge cases."""

import datetime as dt
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import sparkprofile as sp
from sparkprofile.functions.normal import normal_quantile, with_normal_quantile


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def numbers(spark, values, type_="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {type_}")


def test_no_rows(spark):
    df = spark.createDataFrame([], "x double, s string, t timestamp_ntz")
    r = by_column(sp.numeric_stats(df))["x"]
    assert (r["count"], r["mean"], r["mode"], r["q50"]) == (0, 0.0, None, 0.0)
    assert one(sp.missing_totals(df))["overall_missing_percentage"] == 0.0
    assert by_column(sp.detect_outliers(df))["x"]["any_outlier_count"] == 0
    assert sp.pearson(df).count() == 0
    assert sp.histogram(df).count() == 0
    assert sp.kde(df).count() == 0
    assert {r.cardinality for r in sp.detect_schema(df).collect()} == {"constant"}
    assert by_column(sp.null_profile(df))["s"]["null_percentage"] == 0.0
    assert one(sp.duplicate_rows(df))["duplicate_rows"] == 0
    assert [r.check for r in sp.validate_dataset(df).collect()] == ["empty"]
    assert by_column(sp.analyze_distributions(df))["x"]["distribution_type"] == "unknown"
    assert by_column(sp.normality_vote(df))["x"]["reason"] == "insufficient_data"
    assert by_column(sp.text_stats(df, ["s"]))["s"]["max_length"] == 0
    assert by_column(sp.missing_type(df))["x"]["missing_type"] == "no_missing"


def test_all_null(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "x double, s string")
    r = by_column(sp.numeric_stats(df))["x"]
    assert (r["count"], r["null_count"], r["std"], r["mode"]) == (0, 2, 0.0, None)
    schema = by_column(sp.detect_schema(df))
    assert schema["s"]["data_type"] == "text" and schema["s"]["cardinality"] == "constant"
    assert schema["s"]["sample_values"] == [] and schema["s"]["semantic_type"] == "none"
    assert by_column(sp.missing_type(df))["x"]["missing_type"] == "all_missing"


def test_constant_column(spark):
    df = spark.createDataFrame([(4.0, float(i)) for i in range(20)], "x double, y double")
    r = by_column(sp.numeric_stats(df))["x"]
    assert (r["std"], r["skewness"], r["kurtosis"]) == (0.0, 0.0, 0.0)
    o = by_column(sp.detect_outliers(df))["x"]
    assert (o["zscore_outlier_count"], o["mad_outlier_count"], o["iqr_outlier_count"]) == (0, 0, 0)
    assert sp.pearson(df).count() == 0 and sp.spearman(df).count() == 0
    matrix = {(r.row, r.col): r.correlation for r in sp.correlation_matrix(df).collect()}
    assert matrix["x", "y"] == 0.0 and matrix["x", "x"] == 1.0
    bins = sp.histogram(df, ["x"]).where("count > 0").collect()
    assert len(bins) == 1 and bins[0]["count"] == 20
    edges = sp.histogram(df, ["x"]).agg(F.min("lower"), F.max("upper")).first()
    assert tuple(edges) == (3.5, 4.5)
    assert sp.kde(df, ["x"]).count() == 0
    assert by_column(sp.detect_schema(df))["x"]["cardinality"] == "constant"
    assert by_column(sp.normality_vote(df))["x"]["is_normal"] is False
    assert one(sp.linear_fit(df, "x", "y"))["slope"] is None


def test_one_and_two_rows(spark):
    r = by_column(sp.numeric_stats(numbers(spark, [5.0])))["x"]
    assert r["std"] is None and r["variance"] is None and r["mean"] == 5.0
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0)], "x double, y double")
    pair = one(sp.pearson(df))
    assert (pair["correlation"], pair["p_value"]) == (-1.0, 1.0)
    assert one(sp.spearman(df))["p_value"] is None


def test_small_known_sample(spark):
    df = numbers(spark, [1.0, 2.0, 2.0, 7.0, 9.0])
    r = by_column(sp.numeric_stats(df))["x"]
    assert (r["q25"], r["median"], r["q75"], r["mode"]) == (2.0, 2.0, 7.0, 2.0)
    m = by_column(sp.moments_pop(df))["x"]
    assert m["skewness"] == pytest.approx(0.484673, abs=1e-6)
    assert m["kurtosis"] == pytest.approx(-1.558466, abs=1e-6)
    assert by_column(sp.mad_outliers(df))["x"]["mad"] == 1.0
    assert by_column(sp.entropy(df))["x"]["entropy"] == pytest.approx(1.921928, abs=1e-6)


@pytest.mark.parametrize("n", [3, 4, 7, 8, 9, 10, 11])
def test_size_thresholds(spark, n):
    df = numbers(spark, [float(i * i) for i in range(n)])
    moments = by_column(sp.moments_pop(df))["x"]
    assert (moments["kurtosis"] == 0.0) == (n < 4)
    assert sp.dagostino_pearson(df).count() == (1 if n >= 8 else 0)
    d = by_column(sp.analyze_distributions(df))["x"]
    assert (d["dp_statistic"] is not None) == (n >= 8)
    assert d["kde_available"] == (n > 10)
    assert n >= 10 or d["distribution_type"] == "unknown"
    assert (sp.kde(df).count() > 0) == (n >= 10)
    assert sp.fit_distribution(df).count() == (1 if n >= 10 else 0)


def test_ties_prefer_the_smallest_value(spark):
    df = spark.createDataFrame([(v, w) for v, w in zip([3, 1, 3, 1, 2], "babab")], "n long, s string")
    found = by_column(sp.mode_value(df))
    assert (found["n"]["mode"], found["n"]["mode_count"]) == ("1.0", 2)
    assert found["s"]["mode"] == "b"
    ranks = [(r.rank, r.value) for r in sp.top_values(df, ["n"]).orderBy("rank").collect()]
    assert ranks == [(1, "1"), (2, "3"), (3, "2")]


def test_non_finite_values(spark):
    df = numbers(spark, [1.0, 2.0, 3.0, float("nan"), float("inf"), float("-inf"), None])
    assert by_column(sp.missing_columns(df))["x"]["missing_count"] == 1
    assert sp.histogram(df).agg(F.sum("count")).first()[0] == 3
    marks = by_column(sp.histogram_markers(df))["x"]
    assert (marks["total_count"], marks["non_finite_count"], marks["median"]) == (3, 3, 2.0)


def test_type_classes(spark):
    df = spark.createDataFrame(
        [(True, Decimal("1.50"), dt.date(2020, 1, 1), [1.0], {"a": 1}, b"x"), (False, Decimal("2.50"), dt.date(2020, 3, 1), [2.0], None, None)],
        "b boolean, d decimal(12,2), day date, a array<double>, m map<string,int>, raw binary",
    )
    kinds = {c: r["data_type"] for c, r in by_column(sp.detect_schema(df)).items()}
    assert kinds == {"b": "boolean", "d": "numeric", "day": "datetime", "a": "unknown", "m": "unknown", "raw": "unknown"}
    assert {r.column: r.kind for r in sp.analyze_statistics(df)["summary"].collect()} == {
        "b": "categorical", "d": "numeric", "day": "datetime"
    }
    assert by_column(sp.numeric_stats(df))["d"]["mean"] == 2.0
    day = by_column(sp.datetime_stats(df))["day"]
    assert (day["range_days"], day["min"]) == (60.0, "2020-01-01")
    assert by_column(sp.distinct_count(df))["m"]["unique_count"] is None
    assert one(sp.duplicate_rows(df))["duplicate_rows"] == 0


def test_time_has_no_range(spark):
    spark.conf.set("spark.sql.timeType.enabled", "true")
    df = spark.createDataFrame([("10:00:00",), ("12:30:00",)], "s string").select(F.expr("cast(s as time(0))").alias("t"))
    r = by_column(sp.datetime_stats(df))["t"]
    assert r["range_days"] is None and r["min"] == "10:00:00"


def test_range_in_whole_days(spark):
    times = [dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 3, 11)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    assert by_column(sp.datetime_stats(df))["t"]["range_days"] == 1.0


def test_large_integers_stay_apart(spark):
    big = 2**53
    df = numbers(spark, [big, big + 1, big + 1, big + 2], "long")
    assert by_column(sp.distinct_count(df))["x"]["unique_count"] == 3
    assert by_column(sp.numeric_stats(df))["x"]["mode"] == float(big + 1)


def test_binary_coding(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (8.0, "b"), (9.0, "b"), (5.0, None)] * 10, "x double, c string")
    r = one(sp.point_biserial(df, categorical=["c"]))
    assert r["correlation"] > 0.9 and r["n"] == 40
    with pytest.raises(ValueError):
        sp.column_pair_correlation(df.withColumn("c", F.col("x").cast("string")), "x", "c")


def test_chi_square_with_empty_cells(spark):
    cells = [("a", "u")] * 10 + [("a", "v")] * 5 + [("b", "v")] * 8 + [("b", "w")] * 7
    df = spark.createDataFrame(cells, "p string, q string")
    observed = [[10, 5, 0], [0, 8, 7]]
    total = 30
    chi = sum(
        (observed[i][j] - sum(observed[i]) * sum(r[j] for r in observed) / total) ** 2
        / (sum(observed[i]) * sum(r[j] for r in observed) / total)
        for i in range(2) for j in range(3)
    )
    assert one(sp.chi_square(df, "p", "q"))["chi2"] == pytest.approx(chi)
    assert one(sp.column_pair_correlation(df, "p", "q"))["correlation"] == pytest.approx(math.sqrt(chi / 30))
    wide = {r.p: (r.u, r.v, r.w) for r in sp.contingency_table(df, "p", "q", wide=True).collect()}
    assert wide == {"a": (10, 5, 0), "b": (0, 8, 7)}


def test_length_counts_code_points(spark):
    df = spark.createDataFrame([("a😀é",), ("",)], "s string")
    r = by_column(sp.text_stats(df, ["s"]))["s"]
    assert (r["max_length"], r["min_length"], r["empty_count"]) == (3, 0, 1)


def test_column_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a", "a", "column_1"])
    profile = sp.Profile(df)
    assert profile.df.columns == ["a", "a__2", "column_1"]
    q = one(profile.quality)
    assert (q["duplicate_columns"], q["unnamed_columns"], q["schema_score"]) == (1, 1, 80.0)
    checks = {r.check for r in sp.validate_dataset(df).collect()}
    assert checks == {"duplicate_columns", "unnamed_columns"}
    odd = spark.createDataFrame([(1.0, 2.0)], ["a.b", "c`d"])
    assert set(by_column(sp.numeric_stats(odd))) == {"a.b", "c`d"}
    assert sp.flag_outliers(odd).count() == 1


def test_duplicates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "x"), (None, "x"), (None, "x")], "a int, b string")
    r = one(sp.duplicate_rows(df))
    assert (r["total_rows"], r["distinct_rows"], r["duplicate_rows"]) == (5, 3, 2)
    maps = spark.createDataFrame([({"k": 1},), ({"k": 1},)], "m map<string,int>")
    assert one(sp.duplicate_rows(maps))["duplicate_rows"] == 1


def test_alerts_of_a_clean_table(spark):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(50)], "v long, s string")
    assert sp.alerts(df).count() == 0


def test_outlier_methods(spark):
    df = numbers(spark, [float(i % 10) for i in range(200)] + [1000.0, None])
    only = sp.flag_outliers(df, method="mad")
    assert only.columns == ["x", "x_is_mad"] and only.where("x_is_mad").count() == 1
    with pytest.raises(ValueError):
        sp.detect_outliers(df, method="other")
    with pytest.raises(ValueError):
        sp.outliers_for_column(df, "y")
    row = by_column(sp.detect_outliers(df))["x"]
    assert row["any_outlier_count"] == 1 and row["outlier_percentage"] == pytest.approx(100 / 201)


def test_selection_of_columns(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "a int, b double, c string")
    assert set(by_column(sp.numeric_stats(df, ["b", "nope"]))) == {"b"}
    assert set(by_column(sp.missing_columns(df, ["nope"]))) == {"a", "b", "c"}
    assert sp.row_search(df, "").count() == 1 and sp.row_search(df, "X").count() == 1 and sp.row_search(df, "q").count() == 0


def test_uniform_sample_is_repeatable(spark):
    df = spark.range(5000).withColumn("v", F.col("id") % 3)
    a = {r.id for r in sp.uniform_sample(df, 100, keys=["id"]).collect()}
    b = {r.id for r in sp.uniform_sample(df.repartition(13), 100, keys=["id"]).collect()}
    assert a == b and len(a) == 100
    copies = spark.range(1000).select(F.lit(1).alias("v"))
    assert sp.uniform_sample(copies, 10).count() == 10


def test_write_and_read_back_a_profile(spark, tmp_path):
    rows = [(i, float(i % 17), "ab"[i % 2], None if i % 5 else 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v double, c string, gaps double")
    profile = sp.analyze_dataset(df, "demo")
    places = profile.write(str(tmp_path / "out"))
    back = sp.load_dataset(spark, places["missing_columns"], "jsonl")
    assert by_column(back)["gaps"]["missing_count"] == 160
    assert "multivariate_outliers" in places and "overview" in places
    profile.release()
    parts = sp.column_analysis(df, "v")
    assert {"schema", "missing", "statistics_numeric", "outliers", "distribution", "histogram"} <= set(parts)
    with pytest.raises(ValueError):
        sp.column_analysis(df, "nope")


def test_rolling_window_beyond_a_chunk(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(100)], "t int, v double")
    out = {r.t: r.rolling for r in sp.rolling_average(df, "t", "v", window=30, chunk_rows=10).collect()}
    assert out == {i: (None if i < 29 else i - 14.5) for i in range(100)}


def test_negative_zero_is_zero(spark):
    df = numbers(spark, [0.0, -0.0, 0.0])
    assert [(r.value, r["count"]) for r in sp.frequency_table(df, ["x"]).collect()] == [("0.0", 3)]


def test_intermediate_tables_are_dropped(spark):
    import os

    from sparkprofile.functions.session import shared_folder

    place = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(place))
    with sp.intermediate_tables(spark):
        df = spark.createDataFrame([(i, float(i)) for i in range(50)], "t int, v double")
        assert sp.rolling_average(df, "t", "v", window=3).count() == 50
        assert set(os.listdir(place)) > before
    assert set(os.listdir(place)) == before


def test_normal_quantile_takes_one_logarithm(spark):
    levels = [1e-12, 1e-4, 0.05, 0.3, 0.5, 0.7, 0.95, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in levels], "p double").repartition(1)
    out = with_normal_quantile(df, "p", "z").withColumn("old", normal_quantile("p"))
    assert all(r.z == r.old for r in out.collect())
    plan = with_normal_quantile(df, "p", "z")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LOG(") + plan.count("ln(") + plan.count("LN(") == 1
