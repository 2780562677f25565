"""Delimited text with line breaks inside quoted cells, read in splits.

Spark reads such files whole, one task a file, since a line break in the middle of a file may or may not end a record.
Here the file is read as lines, in Spark's own splits.  A line that holds a quote moves the reader between two states, outside and
inside a quoted cell; a split is a map from the state at its start to the state at its end.  One pass finds these maps, a
scan over the splits of each file (one row each) finds the state every split starts in, and a second pass
cuts the lines into records.  A record that crosses splits comes out as fragments, which one small shuffle puts together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.session import materialize

SPLIT_KEY = "spark.sql.files.maxPartitionBytes"
ATTEMPTS = 3
TASKS_PER_CORE = 4


class LineReader:
    """Whether a line leaves the reader inside a quoted cell; a quote within a cell is written twice."""

    def __init__(self, sep: str, quote: str):
        q = re.escape(quote)
        self.quote, self.sep, self.opening = quote, sep, sep + quote
        self.close = re.compile(f"(?:[^{q}]++|{q}{q})*+{q}")

    def inside_after(self, line: str, inside: bool) -> bool:
        at = 0
        if not inside:
            if not line.startswith(self.quote):
                at = line.find(self.opening)
                if at < 0:
                    return False
                at += len(self.sep)
            at += 1
        while True:
            closed = self.close.match(line, at)
            if closed is None:
                return True
            # what follows a closing quote belongs to the cell until the next separator
            at = line.find(self.sep, closed.end())
            if at >= 0 and not line.startswith(self.opening, at):
                at = line.find(self.opening, at)
            if at < 0:
                return False
            at += len(self.opening)


def _runs(batches) -> Iterator[tuple[tuple[int, int], pa.Array]]:
    """Consecutive lines of one split; a split may come in several pieces."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(((file[1:] != file[:-1]) | (start[1:] != start[:-1])).nonzero()[0] + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield (int(file[lo]), int(start[lo])), batch.column(2).slice(lo, hi - lo)


def _states(lines: DataFrame, reader: LineReader) -> DataFrame:
    """One row per split: the state it ends in from either state, whether a record that is open at its start is still open at its
    end, and whether its first line ends in a carriage return."""
    def run(batches):
        now, found = None, None

        def row():
            names = ["from_outside", "from_inside", "through", "returns"]
            return pa.RecordBatch.from_pydict({"file": [now[0]], "start": [now[1]]} | {n: [v] for n, v in zip(names, found, strict=True)})

        for key, text in _runs(batches):
            if key != now:
                if now is not None:
                    yield row()
                now, found = key, [False, True, True, text[0].as_py().endswith("\r")]
            for line in text.filter(pc.match_substring(text, reader.quote)).to_pylist():
                found[0], found[1] = reader.inside_after(line, found[0]), reader.inside_after(line, found[1])
                found[2] &= found[1]
        if now is not None:
            yield row()

    return lines.mapInArrow(run, "file bigint, start bigint, from_outside boolean, from_inside boolean, through boolean, returns boolean")


def _starts(states: list) -> dict[tuple[int, int], tuple[bool, int, bool]]:
    """``(file, start) -> (inside, start of the split where the open record began, lines end in two characters)``."""
    out, file = {}, None
    for r in sorted(states, key=lambda r: (r.file, r.start)):
        if r.file != file:
            file, inside, began, returns = r.file, False, r.start, r.returns
        out[r.file, r.start] = (inside, began, returns)
        if not (inside and r.through):
            began = r.start
        inside = r.from_inside if inside else r.from_outside
    return out


def _pieces(lines: DataFrame, reader: LineReader, starts: dict) -> DataFrame:
    """``(file, began, part, first, record)``: whole records have no ``part``; fragments have the split they lie in and the one their record began in.

    ``first`` marks the first record of a file.
    """
    shared = lines.sparkSession.sparkContext.broadcast(starts)  # one entry per split
    schema = "file bigint, began bigint, part bigint, first boolean, record string"

    def rows(key, began, records, fragment, first):
        n = len(records)
        return pa.RecordBatch.from_arrays([
            pa.array([key[0]] * n, pa.int64()), pa.array([began] * n, pa.int64()), pa.array([key[1] if fragment else None] * n, pa.int64()),
            pa.array([first] + [False] * (n - 1)), records if isinstance(records, pa.Array) else pa.array(records, pa.string()),
        ], names=["file", "began", "part", "first", "record"])

    def run(batches):
        known = shared.value
        now, inside, held, began, two, first = None, False, [], 0, False, False
        for key, text in _runs(batches):
            if key != now:
                if held:
                    yield rows(now, began, ["\n".join(held)], True, first)
                if key not in known:
                    raise RuntimeError("the splits have changed since their states were read")
                now, held, (inside, began, two) = key, [], known[key]
                first = key[1] == 0
            if two:
                text = pc.replace_substring_regex(text, r"\r$", "")
            quoted = pc.match_substring(text, reader.quote).to_numpy(zero_copy_only=False).nonzero()[0].tolist()
            done: list[pa.Array] = []
            at = 0
            for i in [*quoted, len(text)]:
                if i > at:  # lines without quotes: records of their own, or all of them inside a cell
                    between = text.slice(at, i - at)
                    if inside:
                        held += between.to_pylist()
                    else:
                        done.append(between.filter(pc.not_equal(between, "")))
                at = i + 1
                if i == len(text):
                    break
                line, after = text[i].as_py(), False
                after = reader.inside_after(line, inside)
                if not inside and after:
                    began = key[1]
                held.append(line)
                if not after:
                    record, held = "\n".join(held), []
                    if inside and began != key[1]:
                        if done:
                            raise RuntimeError("a record that came from before cannot follow another")
                        yield rows(key, began, [record], True, False)
                    else:
                        done.append(pa.array([record], pa.string()))
                inside = after
            whole = pa.concat_arrays(done) if done else pa.array([], pa.string())
            if len(whole):
                yield rows(key, None, whole, False, first)
                first = False
        if held:
            yield rows(now, began, ["\n".join(held)], True, first)

    return lines.mapInArrow(run, schema)


@contextmanager
def _split_size(spark: SparkSession, size: int | None):
    before = spark.conf.get(SPLIT_KEY)
    if size is not None:
        spark.conf.set(SPLIT_KEY, str(size))
    try:
        yield
    finally:
        spark.conf.set(SPLIT_KEY, before)


def largest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file behind ``path``, from the file listing."""
    return _file_bytes(spark, path, F.max)


def _file_bytes(spark: SparkSession, path: str, of) -> int:
    return spark.read.format("binaryFile").load(path).agg(of("length")).first()[0] or 0  # contents are not read


def split_bytes(spark: SparkSession) -> int:
    """How much of a file one task reads."""
    return int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())


def read_in_splits(
    spark: SparkSession, path: str, names: list[str], sep: str, quote: str, header: bool, options: dict, split: int | None = None
) -> DataFrame:
    """The records of delimited files as string columns ``names``, each file read by as many tasks as it has splits.

    Equal to Spark's own reading of whole files; lines end in ``\\n`` or, if a file's first line does, in ``\\r\\n`` (then line
    breaks in cells become ``\\n``, too).  The records are parsed once and written; only those that cross splits are parsed
    when they are read.  A task takes as many splits in a row as make up Spark's own split size, if there are enough of them
    for all cores.
    """
    reader = LineReader(sep, quote)
    run = max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, -(-_file_bytes(spark, path, F.sum) // split_bytes(spark)))
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    settings = {"sep": sep, "quote": quote, "escape": quote, "mode": "FAILFAST", **{k: str(v) for k, v in options.items()}}
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.make_valid_utf8("value").alias("value")
    )
    with _split_size(spark, split):
        for attempt in range(ATTEMPTS):
            runs = lines.coalesce(run)
            # the states need no line without a quote, but for the end of a split's first one
            marked = F.when(F.contains("value", F.lit(quote)), F.col("value")).when(F.endswith("value", F.lit("\r")), "\r").otherwise("")
            starts = _starts(_states(runs.withColumn("value", marked), reader).collect())
            cut = _pieces(runs, reader, starts)
            fragment = F.col("part").isNotNull()
            try:
                pieces = materialize(cut.select(
                    "file", "began", "part", "first", F.when(fragment, F.col("record")).alias("record"),
                    F.when(~fragment, F.from_csv("record", schema, settings)).alias("r"),
                ))
                break
            except Exception:
                if attempt + 1 == ATTEMPTS:
                    raise
    whole = pieces.where("part IS NULL").select("first", "r")
    parts = F.array_sort(F.collect_list(F.struct("part", "record")))
    joined = pieces.where("part IS NOT NULL").groupBy("file", "began").agg(F.max("first").alias("first"), parts.alias("parts"))
    record = F.array_join(F.transform("parts", lambda p: p["record"]), "\n")
    records = whole.union(joined.select("first", F.from_csv(record, schema, settings).alias("r")))
    if header:
        records = records.where("NOT first")
    return records.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])
