"""Line deduplication by winnowing: later copies of runs of lines are deleted.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize, settled

WINDOW = 3
LONG_WORDS = 50
_LEAST = -(1 << 63)
_KEY = ["_line_id", "_line_print"]


def _lines(df: DataFrame, id_column: str, text: str, separator: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.select(
        F.coalesce(F.col(f"`{id_column}`").cast("bigint"), F.lit(_LEAST)).alias("_line_id"), F.xxhash64(body).alias("_line_print"),
        F.split(body, f"\\Q{separator}\\E", -1).alias("_line_list"),
    )


def fingerprints(
    df: DataFrame, id_column: str, text: str, window: int = WINDOW, separator: str = "\n", long_words: int | None = None
) -> DataFrame:
    """``(_line_id, _line_print, place, mark, lo, short, h, g, n)``: the winnowed lines, each with the lines around it.

    Of every window of ``window`` lines the line with the smallest hash is selected, ``mark``, so equal windows select the same
    line of theirs; neighbouring windows mostly select the same line, which is one row.  With ``long_words`` the windows of fewer
    lines that have so many words, and a text of fewer lines with a word in it, select a line as well.  ``h`` and ``g`` are two
    independent hashes of the up to ``window - 1`` lines on either side, from line ``lo`` on, and ``n`` their words; ``short`` says that
    the text has fewer lines than a window, all of which are around.
    """
    size = F.size("h")
    hashed = _lines(df, id_column, text, separator).select(
        *_KEY, F.transform("_line_list", lambda x: F.xxhash64(x)).alias("h"), F.transform("_line_list", lambda x: F.xxhash64(F.lit(7), x)).alias("g"),
        *([] if long_words is None else [F.transform("_line_list", lambda x: F.regexp_count(x, F.lit(r"\S+"))).alias("n")]),
    )

    def least(i, width):
        part = F.slice("h", i + 1, width)
        return (i + F.array_position(part, F.array_min(part)).cast("int") - 1).cast("int")

    def starts(width):
        return F.filter(F.sequence(F.lit(0), F.greatest(size - width, F.lit(0))), lambda i: i + width <= size)

    def long(width):
        return F.transform(F.filter(starts(width), lambda i: _total(F.slice("n", i + 1, width)) >= long_words), lambda i: least(i, F.lit(width)))

    places = [F.transform(starts(window), lambda i: least(i, F.lit(window)))]
    if long_words is not None:
        places += [long(width) for width in range(1, window)]
        whole = F.filter(F.array(F.lit(0)), lambda i: (size < window) & (_total(F.col("n")) > 0))
        places.append(F.transform(whole, lambda i: least(i, size)))
    lo = F.greatest(F.col("place") - (window - 1), F.lit(0))
    around = [F.slice(c, lo + 1, F.col("place") - lo + window).alias(c) for c in hashed.columns[2:]]
    selected = hashed.select("*", F.explode(F.array_distinct(F.concat(*places))).alias("place"))
    return selected.select(
        *_KEY, "place", F.element_at("h", F.col("place") + 1).alias("mark"), lo.alias("lo"), (size < window).alias("short"), *around
    )


def _total(numbers):
    return F.aggregate(numbers, F.lit(0), lambda x, y: x + y)


def _extended(positions: DataFrame, window: int, long_words: int | None) -> DataFrame:
    """``(_line_id, _line_print, start, width, a, b)``: the windows around each position, as far as they reach to the left and right."""
    size = F.size("h")

    def window_of(at, width, *salt):
        h, g = F.slice("h", at + 1, width), F.slice("g", at + 1, width)
        return F.struct((F.col("lo") + at).alias("start"), width.alias("width"), F.xxhash64(h, *salt).alias("a"), F.xxhash64(g, *salt).alias("b"))

    found = []
    for width in range(window if long_words is None else 1, window + 1):
        for left in range(width):
            at = F.col("place") - F.col("lo") - left
            inside = (at >= 0) & (at + width <= size)
            if width < window:
                inside &= _total(F.slice("n", F.greatest(at, F.lit(0)) + 1, width)) >= long_words
            found.append(F.when(inside, window_of(F.greatest(at, F.lit(0)), F.lit(width))))
    if long_words is not None:
        # a text of fewer lines is seen as a whole from each of its lines
        found.append(F.when(F.col("short") & (_total(F.col("n")) > 0), window_of(F.lit(0), size, F.lit("whole"))))
    return positions.select(*_KEY, F.inline(F.array_compact(F.array(*found))))


def repeated_runs(
    df: DataFrame, id_column: str, text: str, window: int = WINDOW, separator: str = "\n", long_words: int | None = None
) -> DataFrame:
    """``(_line_id, _line_print, first, past)``: the maximal runs of lines to delete, as line numbers from 0, ``past`` excluded.

    A window is repeated if the same lines stand earlier: under a smaller id, or further up in the same document.  First the
    positions of the winnowed lines are matched: a line selected at one position only goes no further.  The others are
    extended to the left and right, and what they extend to is compared with its earliest occurrence.  Extensions that touch
    or overlap are one run: it reaches both ways as far as the lines agree with something earlier.
    """
    positions = materialize(fingerprints(df, id_column, text, window, separator, long_words))
    seen = positions.groupBy("mark").agg(
        F.min("_line_id").alias("i0"), F.max("_line_id").alias("i1"), F.min("_line_print").alias("p0"),
        F.max("_line_print").alias("p1"), F.min("place").alias("s0"), F.max("place").alias("s1"),
    )
    marks = materialize(seen.where("i0 < i1 OR p0 < p1 OR s0 < s1").select("mark"))
    windows = _extended(positions.join(marks.hint("merge"), "mark", "left_semi"), window, long_words)
    at = F.struct(*_KEY, "start")
    first = materialize(windows.groupBy("a", "b").agg(F.min(at).alias("at"), F.max(at).alias("last")).where("at < last").select("a", "b", "at"))
    later = windows.join(first.hint("merge"), ["a", "b"]).where(at > F.col("at")).select(*_KEY, "start", (F.col("start") + F.col("width")).alias("past"))
    order = Window.partitionBy(*_KEY).orderBy("start")
    runs = later.withColumn("new", F.coalesce((F.col("start") > F.max("past").over(order.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(order))
    return runs.groupBy(*_KEY, "run").agg(F.min("start").alias("first"), F.max("past").alias("past")).drop("run")


def line_dedup(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW, separator: str = "\n", runs: str = "removed_runs",
    long_words: int | None = None,
) -> DataFrame:
    """``df`` without the later copies of runs of at least ``window`` lines; ``runs`` lists what was deleted.

    A line goes if it lies in a window of ``window`` lines that stands earlier as well, by (id, line).  With ``long_words`` it goes
    too if it lies in a shorter run of at least so many words that stands earlier, or if its text has fewer lines, has a word and
    is a whole earlier text.  The input decides, not what is left of it.  ``runs`` is an array of ``(first, past)``, empty where nothing was deleted; an existing column of that
    name is replaced.  Null texts stay null; without ``long_words`` texts of fewer lines stay as they are; empty lines count like others.  A null id is the
    smallest id; rows of equal id and text are one document and are changed alike; rows of equal id and different text are
    ordered by a hash of the text.
    """
    found = settled(df.sparkSession, lambda: repeated_runs(df, id_column, text, window, separator, long_words))
    lists = found.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("first", "past"))).alias("_line_runs"))
    kept = [c for c in df.columns if c != runs]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keyed = df.select(
        *[F.col(f"`{c}`") for c in kept],
        F.coalesce(F.col(f"`{id_column}`").cast("bigint"), F.lit(_LEAST)).alias("_line_id"), F.xxhash64(body).alias("_line_print"),
    )
    # the lists grow with the texts, so this is a shuffle at every size and never a broadcast, like the joins above
    joined = keyed.join(lists.hint("merge"), _KEY, "left")
    lines = F.split(F.col(f"`{text}`"), f"\\Q{separator}\\E", -1)
    gaps = F.arrays_zip(
        F.concat(F.array(F.lit(0)), F.col("_line_runs.past")).alias("lo"), F.concat(F.col("_line_runs.first"), F.array(F.size("_line_list"))).alias("hi")
    )
    text_left = F.array_join(F.flatten(F.transform(gaps, lambda g: F.slice("_line_list", g["lo"] + 1, g["hi"] - g["lo"]))), separator)
    changed = joined.withColumn("_line_list", F.when(F.col("_line_runs").isNotNull(), lines)).withColumn(
        "_line_left", F.when(F.col("_line_runs").isNull(), F.col(f"`{text}`")).otherwise(text_left)
    )
    none = F.array().cast("array<struct<first:int,past:int>>")
    return changed.select(
        *[F.col("_line_left").alias(c) if c == text else F.col(f"`{c}`") for c in kept], F.coalesce("_line_runs", none).alias(runs)
    )


def oracle(window: int = WINDOW, long_words: int | None = None) -> str:
    """DuckDB SQL of the digest query: every window against all earlier ones."""
    long = "false" if long_words is None else f"words >= {long_words}"
    whole = "false" if long_words is None else "words > 0"
    return f"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
p AS (SELECT doc_id, lines, width, unnest(range(0, len(lines) - width + 1)) AS i FROM l, range(1, {window + 1}) t(width) WHERE len(lines) >= width),
b AS (SELECT doc_id, len(lines) AS size, width, i, array_to_string(lines[i + 1 : i + width], chr(10)) AS body FROM p),
w AS (SELECT *, len(regexp_extract_all(body, '[^ \\t\\n\\x0B\\f\\r]+')) AS words FROM b),
k AS (SELECT doc_id, i, width, md5(body) AS d FROM w WHERE width = {window} OR {long}
      UNION ALL SELECT doc_id, i, width, 'whole ' || md5(body) FROM w WHERE size < {window} AND width = size AND {whole}),
f AS (SELECT doc_id, i, width, row_number() OVER (PARTITION BY d ORDER BY doc_id, i) AS n FROM k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + width)) AS line FROM f WHERE n > 1),
lines AS (SELECT doc_id, unnest(range(0, len(lines))) AS line, unnest(lines) AS body FROM l),
flag AS (SELECT a.doc_id, a.line, a.body, g.line IS NOT NULL AS gone FROM lines a LEFT JOIN gone g USING (doc_id, line)),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY line), false) AS opens FROM flag)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_runs,
       md5(coalesce(string_agg(body, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '')) AS kept_md5
FROM runs GROUP BY doc_id"""
