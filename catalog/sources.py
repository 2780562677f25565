"""Sources, sinks and row selection."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

import sparkprofile as sp
from sparkprofile.sources.arrow import file_system

from .base import SPARSE_COLUMNS, SPARSE_SQL, long_sql, query, rounded

ORDERS_BY_STATUS = """
SELECT o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS customers
FROM orders GROUP BY o_orderstatus"""


def by_status(df):
    out = df.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("o_totalprice").alias("total"),
        F.countDistinct("o_custkey").alias("customers"),
    )
    return rounded(out, 2)


@query("load_dataset", ORDERS_BY_STATUS)
def load_dataset(t):
    return by_status(sp.load_dataset(t.spark, t.path("orders")))


@query("scan_parquet", ORDERS_BY_STATUS)
def scan_parquet(t):
    return by_status(sp.scan_parquet(t.spark, t.path("orders")))


SPARSE_BY_TYPE = f"""
WITH s AS ({SPARSE_SQL})
SELECT event_type, count(*) AS n, count(user_id) AS users, round(sum(value), 4) AS total,
       CAST(min(ts) AS VARCHAR) AS first_ts, CAST(max(ts) AS VARCHAR) AS last_ts, count(empty_col) AS empty_values
FROM s GROUP BY event_type"""


def by_type(df):
    out = df.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("user_id").alias("users"),
        F.sum("value").alias("total"),
        F.min("ts").cast("string").alias("first_ts"),
        F.max("ts").cast("string").alias("last_ts"),
        F.count("empty_col").alias("empty_values"),
    )
    return rounded(out, 4)


def write_text(t, df, sep, **options):
    folder = t.scratch() + "/data"
    plain = df.withColumn("ts", F.col("ts").cast("string"))
    plain.write.options(header=True, sep=sep, **options).csv(folder)
    return folder


@query("scan_csv", SPARSE_BY_TYPE)
def scan_csv(t):
    return by_type(sp.scan_csv(t.spark, write_text(t, t.sparse, ",", nullValue="NA", escape='"')))


TEXT_BY_LANGUAGE = """
SELECT lang, source, count(*) AS n, sum(length(text)) AS characters, sum(n_chars) AS declared, min(md5(text)) AS least, max(md5(text)) AS most,
       sum(len(text) - len(replace(text, chr(10), ''))) AS line_breaks
FROM documents GROUP BY lang, source"""


def by_language(df):
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return df.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("characters"), F.sum("n_chars").alias("declared"),
        F.min(F.md5("text")).alias("least"), F.max(F.md5("text")).alias("most"), F.sum(breaks).alias("line_breaks"),
    )


def written_documents(t, sep):
    folder = t.scratch() + "/data"
    options = {"header": True, "sep": sep, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    t.documents.select("doc_id", "lang", "source", "text", "n_chars").write.options(**options).csv(folder)
    return folder


@query("scan_csv_splits", TEXT_BY_LANGUAGE)
def scan_csv_splits(t):
    """Cells with line breaks, read by many tasks a file."""
    return by_language(sp.scan_csv(t.spark, written_documents(t, ","), split=1 << 18))


@query("scan_tsv_splits", TEXT_BY_LANGUAGE)
def scan_tsv_splits(t):
    return by_language(sp.scan_tsv(t.spark, written_documents(t, "\t"), split=1 << 18))


@query("scan_tsv", SPARSE_BY_TYPE)
def scan_tsv(t):
    return by_type(sp.load_dataset(t.spark, write_text(t, t.sparse, "\t", nullValue="N/A", escape='"'), "tsv"))


@query(
    "infer_types",
    f"""
WITH s AS ({SPARSE_SQL}), long AS ({long_sql("s", SPARSE_COLUMNS, "VARCHAR", "v")})
SELECT "column",
       CASE "column" WHEN 'event_id' THEN 'bigint' WHEN 'ts' THEN 'timestamp_ntz' WHEN 'user_id' THEN 'bigint'
                     WHEN 'value' THEN 'double' ELSE 'string' END AS dtype,
       count(v) AS present
FROM long GROUP BY "column" """,
)
def infer_types(t):
    from sparkprofile.sources.loader import inferred_types

    df = sp.scan_csv(t.spark, write_text(t, t.sparse, ",", nullValue="null", escape='"'))
    present = sp.missing_columns(df).select("column", F.col("present_count").alias("present"))
    return inferred_types(df).join(present, "column")


@query("scan_ndjson", ORDERS_BY_STATUS)
def scan_ndjson(t):
    folder = t.scratch() + "/orders.jsonl"
    t.orders.write.json(folder)
    return by_status(sp.load_dataset(t.spark, folder))


def as_array(batches):
    """Lines of one JSON array per partition."""
    first = True
    yield pd.DataFrame({"value": ["["]})
    for batch in batches:
        lines = batch["value"].where(batch.index < 0, "," + batch["value"])
        if first and len(lines):
            lines = lines.copy()
            lines.iloc[0] = lines.iloc[0][1:]
            first = False
        yield pd.DataFrame({"value": lines})
    yield pd.DataFrame({"value": ["]"]})


@query("scan_json", ORDERS_BY_STATUS)
def scan_json(t):
    folder = t.scratch() + "/orders.json"
    lines = t.orders.select(F.to_json(F.struct("*")).alias("value"))
    lines.mapInPandas(as_array, "value string").write.text(folder)
    return by_status(sp.load_dataset(t.spark, folder))


def arrow_writer(folder):
    """Task that writes its batches to one IPC file and reports its row count."""

    def write(batches):
        context = TaskContext.get()
        fs, place = file_system(folder)
        fs.create_dir(place, recursive=True)
        target = f"{place}/part-{context.partitionId():05d}.arrow"
        attempt = f"{target}.{context.taskAttemptId()}"  # a retried task replaces its file whole
        rows, sink, out = 0, None, None
        for batch in batches:
            if sink is None:
                out = fs.open_output_stream(attempt)
                sink = pa.ipc.new_file(out, batch.schema)
            sink.write_batch(batch)
            rows += batch.num_rows
        if sink is not None:
            sink.close()
            out.close()
            fs.move(attempt, target)
        yield pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64())})

    return write


@query("scan_arrow", ORDERS_BY_STATUS)
def scan_arrow(t):
    folder = t.scratch()
    t.orders.mapInArrow(arrow_writer(folder), "rows bigint").agg(F.sum("rows")).collect()
    return by_status(sp.load_dataset(t.spark, folder, "arrow"))


@query("scan_arrow_filters", ORDERS_BY_STATUS.replace("FROM orders", "FROM orders WHERE o_totalprice >= 250000 AND o_orderstatus IN ('F', 'O')"))
def scan_arrow_filters(t):
    folder = t.scratch()
    t.orders.mapInArrow(arrow_writer(folder), "rows bigint").agg(F.sum("rows")).collect()
    columns = ["o_orderstatus", "o_totalprice", "o_custkey"]
    return by_status(sp.scan_arrow(t.spark, folder, columns, filters=[("o_totalprice", ">=", 250000), ("o_orderstatus", "in", ["F", "O"])]))


@query(
    "invalid_utf8_rows",
    """
SELECT 'label' AS "column", count_if(doc_id % 3 = 0) AS invalid_rows FROM documents
UNION ALL SELECT 'lang', 0 FROM documents WHERE doc_id < 0 UNION ALL SELECT 'lang', 0""",
)
def invalid_utf8_rows(t):
    folder = t.scratch() + "/data"
    label = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("café "), "doc_id")).otherwise(F.col("doc_id").cast("string"))
    t.documents.select("lang", label.alias("label")).write.options(header=True, encoding="ISO-8859-1").csv(folder)
    return sp.invalid_utf8_rows(sp.load_dataset(t.spark, folder, "csv"))


@query(
    "preview",
    """
SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS position, column_name AS "column",
       CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double'
                        WHEN 'INTEGER' THEN 'int' ELSE 'timestamp_ntz' END AS dtype,
       5 AS shown
FROM (DESCRIBE SELECT * FROM orders)""",
)
def preview(t):
    parts = sp.preview_dataset(t.spark, t.path("orders"))
    shown = parts["rows"].agg(F.count(F.lit(1)).cast("int").alias("shown"))
    return parts["columns"].join(F.broadcast(shown))


@query(
    "dataset_info",
    "SELECT 'parquet' AS format, count(*) AS \"rows\", 11 AS columns, 11 AS names, 0 AS warnings FROM lineitem",
)
def dataset_info(t):
    info = sp.dataset_info(t.spark, t.path("lineitem"))
    return info.select(
        "format", "rows", "columns", F.size("column_names").alias("names"), F.size("warnings").alias("warnings")
    )


# --- sinks -------------------------------------------------------------------------------------


@query(
    "write_json",
    f"""
WITH s AS ({SPARSE_SQL}), long AS ({long_sql("s", SPARSE_COLUMNS, "VARCHAR", "v")})
SELECT "column", count(*) - count(v) AS missing_count, count(v) AS present_count FROM long GROUP BY "column" """,
)
def write_json(t):
    places = sp.write_json({"missing": sp.missing_columns(t.sparse), "numeric": sp.numeric_stats(t.sparse)}, t.scratch())
    back = sp.load_dataset(t.spark, places["missing"], "jsonl")
    return back.select("column", "missing_count", "present_count")


@query(
    "report_tables",
    f"""
WITH s AS ({SPARSE_SQL}), long AS ({long_sql("s", SPARSE_COLUMNS, "VARCHAR", "v")}),
c AS (SELECT "column", count(*) AS total, count(v) AS present, count(DISTINCT v) AS unique_count FROM long GROUP BY "column")
SELECT "column",
       CASE WHEN "column" IN ('event_id', 'user_id', 'value', 'empty_col') THEN 'numeric'
            WHEN "column" = 'ts' THEN 'datetime'
            WHEN present > 0 AND unique_count <= 0.05 * present THEN 'categorical' ELSE 'text' END AS data_type,
       unique_count, total - present AS missing_count, round(100.0 * (total - present) / total, 6) AS missing_percentage
FROM c""",
)
def report_tables(t):
    tables = sp.report_tables(sp.Profile(t.sparse, "events", order_by=["event_id"]))
    rows = tables["missing_rows"].select("column", "missing_count", "missing_percentage")
    return rounded(tables["schema_rows"].select("column", "data_type", "unique_count").join(rows, "column"))


@query(
    "plot_tables",
    """
SELECT * FROM (VALUES
  ('hist_l_orderkey', 30), ('hist_l_partkey', 30), ('hist_l_suppkey', 30), ('hist_l_linenumber', 30),
  ('hist_l_quantity', 30), ('hist_l_extendedprice', 30), ('hist_l_discount', 30), ('hist_l_tax', 30), ('box_comparison', 8), ('correlation_heatmap', 64), ('cat_l_returnflag', 3),
  ('cat_l_linestatus', 2), ('missing_pattern', 500)) v(path, "rows")""",
)
def plot_tables(t):
    tables = sp.plot_tables(t.lineitem)
    tables.pop("index")
    parts = [d.agg(F.lit(name).alias("path"), F.count(F.lit(1)).cast("int").alias("rows")) for name, d in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- row selection -----------------------------------------------------------------------------


@query(
    "row_search",
    """
SELECT doc_id, lang, source FROM documents
WHERE contains(lower(text), 'data') OR contains(lower(lang), 'data') OR contains(lower(source), 'data')
   OR contains(CAST(doc_id AS VARCHAR), 'data') OR contains(CAST(n_chars AS VARCHAR), 'data')""",
)
def row_search(t):
    return sp.row_search(t.documents, "Data").select("doc_id", "lang", "source")


@query(
    "sample_rows",
    "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
)
def sample_rows(t):
    ordered = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", (-F.col("o_totalprice")).alias("down"))
    return sp.sample_rows(ordered, 100, ["down", "o_orderkey"]).drop("down")


@query(
    "uniform_sample",
    """
SELECT * FROM lineitem
ORDER BY md5('42|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey), l_orderkey, l_linenumber, l_partkey LIMIT 1000""",
)
def uniform_sample(t):
    return sp.uniform_sample(t.lineitem, 1000, keys=["l_orderkey", "l_linenumber", "l_partkey"])


@query(
    "drop_nulls",
    f"""
WITH s AS ({SPARSE_SQL})
SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT user_id) AS users
FROM s WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL GROUP BY event_type""",
)
def drop_nulls(t):
    kept = sp.drop_nulls(t.sparse, ["user_id", "event_type", "value"])
    out = kept.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.countDistinct("user_id").alias("users")
    )
    return rounded(out, 4)
