"""Removal of repeated long byte strings by distributed rank doubling over sampled suffixes.

Two positions have the same rank at length h when the next h bytes are equal.  As in prefix doubling, Spark brings equal
ranks together at growing lengths and keeps only positions whose rank is not unique yet, until the threshold length is
passed.  Two things keep the first rounds, which would otherwise hold every byte position, small.  Ranks are named by 128 bits
of hashes of the bytes, which each task derives by itself; and positions stand for ranges: a sampled anchor (the
least hash in a window, so equal strings have equal anchors) for all string starts that see it, then blocks of 25, 5 and 1 starts.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import U64, drop_tables, made_tables, materialize, mix64, new_folder, settled, tasks, text_slices

LENGTH = 400
PASSAGE, PASSAGE_WORDS, PASSAGE_WINDOW = 250, 50, 200
STEPS = (25, 5, 1)
SEGMENT = 1 << 20
_LEAST = -(1 << 63)


class Hasher:
    """Hashes of any slice of a byte string by prefix sums, with two independent bases."""

    BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)

    def __init__(self):
        self.tables = [mix64(np.arange(256, dtype=U64) + U64(1 + 1000 * i)) for i in range(2)]
        self.powers = [np.ones(1, U64), np.ones(1, U64)]
        self.inverses = [np.ones(1, U64), np.ones(1, U64)]

    def _grow(self, n: int) -> None:
        if len(self.powers[0]) >= n:
            return
        for i, base in enumerate(self.BASES):
            for store, factor in ((self.powers, base), (self.inverses, pow(base, -1, 1 << 64))):
                row = np.full(n, factor, U64)
                row[0] = 1
                store[i] = np.cumprod(row, dtype=U64)

    def sums(self, data: np.ndarray, i: int) -> np.ndarray:
        """Prefix sums of the bytes under base ``i``."""
        self._grow(1 << int(len(data) + 1).bit_length())
        out = np.zeros(len(data) + 1, U64)
        np.cumsum(self.tables[i][data] * self.powers[i][: len(data)], dtype=U64, out=out[1:])
        return out

    def slices(self, sums: np.ndarray, i: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the slices; equal bytes give equal hashes wherever they stand."""
        return mix64((sums[stop] - sums[start]) * self.inverses[i][start])


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of the leftmost least one."""
    v, at, size = values, np.arange(len(values), dtype=np.int32), 1
    while 2 * size <= width:
        left = v[:-size] <= v[size:]
        at = np.where(left, at[:-size], at[size:])
        v = np.where(left, v[:-size], v[size:])
        size *= 2
    rest = width - size
    if rest:
        left = v[:-rest] <= v[rest:]
        at = np.where(left, at[:-rest], at[rest:])
    return at


def anchors(data: np.ndarray, hasher: Hasher, length: int, window: int | None = None) -> tuple[np.ndarray, ...]:
    """``(place, low, high, rank, wide)`` of the anchors of a byte string.

    The strings of ``length`` bytes that start ``low`` to ``high`` bytes before ``place`` have their least hash of ``length - window + 1`` bytes
    there; ``window`` is half the length if not given.  ``rank`` is that hash; ``wide`` covers all these strings together.
    """
    window = window or length // 2
    gram = length - window + 1
    starts = len(data) - length + 1
    one, two = hasher.sums(data, 0), hasher.sums(data, 1)
    grams = mix64((one[gram:] - one[:-gram]) * hasher.inverses[0][: len(one) - gram])
    seen = window_minima(grams, window)[:starts]
    first = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]]))
    last = np.concatenate([first[1:], [starts]]) - 1
    place = seen[first].astype(np.int64)
    low, high = place - last, place - first
    wide = hasher.slices(two, 1, first, last + length)
    wide = mix64(wide ^ (low * 65_537 + high).astype(U64))
    return place, low, high, grams[place], wide


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


_ROWS = "rep bigint, place bigint, low int, high int, weight int, core bigint, wide bigint"


def _anchor_rows(texts: DataFrame, length: int, window: int | None) -> DataFrame:
    """A row per anchor of each text; long texts go by segments."""
    def run(batches):
        hasher = Hasher()
        for batch in batches:
            data, at = text_slices(batch.column(2))
            reps, weights = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts = []
            for i in range(len(reps)):
                for s in range(at[i], max(at[i] + 1, at[i + 1] - length + 1), SEGMENT):
                    piece = data[s : min(at[i + 1], s + SEGMENT + length - 1)]
                    if len(piece) >= length:
                        place, low, high, rank, wide = anchors(piece, hasher, length, window)
                        parts.append((np.full(len(place), reps[i]), place + (s - at[i]), low, high, np.full(len(place), weights[i]), rank, wide))
                if parts and (len(parts) >= 2_000 or i == len(reps) - 1):
                    yield _batch(parts)
                    parts = []
            if parts:
                yield _batch(parts)

    return texts.select("rep", "weight", "text").mapInArrow(run, _ROWS)


def _batch(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    rep, place, low, high, weight, core, wide = (np.concatenate(c) for c in zip(*parts, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(rep, pa.int64()), pa.array(place, pa.int64()), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)),
         pa.array(weight.astype(np.int32)), pa.array(_signed(core)), pa.array(_signed(wide))],
        names=["rep", "place", "low", "high", "weight", "core", "wide"],
    )


def _block_rows(texts: DataFrame, asked: DataFrame, length: int, step: int) -> DataFrame:
    """The asked ranges in blocks of ``step`` starts: ``core`` is what all strings of a block share, ``wide`` covers them all."""
    lists = asked.groupBy("rep").agg(F.collect_list(F.struct("place", "low", "high", "weight")).alias("asked"))
    joined = texts.join(lists, "rep").select("rep", "text", "asked")

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            data, at = text_slices(batch.column(1))
            reps, lists = batch.column(0).to_numpy(), batch.column(2)
            flat, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            place, low, high, weight = (flat.field(j).to_numpy().astype(np.int64) for j in range(4))
            parts = []
            for i in range(len(reps)):
                own = slice(ends[i], ends[i + 1])
                n = int(at[i + 1] - at[i])
                blocks = high[own] // step - low[own] // step + 1
                p = np.repeat(place[own], blocks)
                u = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks) + np.repeat(low[own] // step, blocks)
                lo, hi = u * step, u * step + step - 1
                # settled are only blocks that lie within the settled range
                whole = (lo >= np.repeat(low[own], blocks)) & (hi <= np.repeat(high[own], blocks))
                w = np.where(whole, np.repeat(weight[own], blocks), 1)
                # two anchors may ask for the same strings: one row for each place, a settled one first
                order = np.lexsort((-w, p - lo))
                keep = order[np.concatenate([[True], np.diff((p - lo)[order]) > 0])] if len(order) else order
                p, lo, hi, w = p[keep], lo[keep], hi[keep], w[keep]
                for s in range(0, n, SEGMENT):
                    mine = (p >= s) & (p < s + SEGMENT)
                    if not mine.any():
                        continue
                    q, l, h, k = p[mine], lo[mine], hi[mine], w[mine]
                    base = max(0, s - length)
                    piece = data[at[i] + base : at[i] + min(n, s + SEGMENT + length)]
                    one, two = hasher.sums(piece, 0), hasher.sums(piece, 1)
                    # a block at an end of the text holds strings that would stand out of it; they are no strings
                    a, b = q - h, q - l + length
                    inside = (a >= 0) & (b <= n)
                    core_a, core_b = np.maximum(q - l, 0), np.minimum(q - h + length, n)
                    some = (q - l >= 0) & (q - h + length <= n)
                    core = hasher.slices(one, 0, np.maximum(core_a - base, 0), np.maximum(core_b - base, 0))
                    wide = hasher.slices(two, 1, np.maximum(a, 0) - base, np.minimum(b, n) - base)
                    alone = mix64(mix64((q * 1_024 + l).astype(U64)) ^ U64(int(reps[i]) & 0xFFFFFFFFFFFFFFFF))
                    wide = np.where(inside, wide, alone)
                    parts.append((np.full(some.sum(), reps[i]), q[some], l[some], h[some], k[some], core[some], wide[some]))
                if parts and (len(parts) >= 2_000 or i == len(reps) - 1):
                    yield _batch(parts)
                    parts = []
            if parts:
                yield _batch(parts)

    return joined.mapInArrow(run, _ROWS)


def _rerank(spark: SparkSession, make: Callable[[], DataFrame], last: bool) -> tuple[DataFrame, DataFrame | None]:
    """``(repeated, open)``: the rows whose strings all stand elsewhere too, and those to be cut finer.

    Equal ``wide`` at two places settles a row; a unique ``core`` drops it.  Where a core has an unsettled row, that row goes
    on, and with it one row for each settled ``wide``, of weight 2: its strings are what the other may be equal to.
    """
    before = made_tables(spark)
    rows = materialize(make())
    pairs = materialize(rows.groupBy("core", "wide").agg(F.sum("weight").alias("m"), F.min(F.struct("rep", "place", "low", "high")).alias("one")))
    alike = pairs.where("m > 1").select("core", "wide")
    repeated = materialize(rows.where("weight = 1").join(alike, ["core", "wide"], "left_semi").select("rep", "place", "low", "high"))
    if last:
        drop_tables(spark, before, made_tables(spark) - 1)
        return repeated, None
    drop_tables(spark, before, before + 1)  # the rows, by far the largest
    cores = materialize(pairs.groupBy("core").agg(F.sum("m").alias("n"), F.min("m").alias("least")).where("n > 1 AND least < 2").select("core"))
    going = materialize(pairs.join(cores, "core", "left_semi").select("one.*", F.least("m", F.lit(2)).cast("int").alias("weight")))
    drop_tables(spark, made_tables(spark) - 2, made_tables(spark) - 1)
    drop_tables(spark, before, before + 1)
    return repeated, going


def repeated_spans(texts: DataFrame, length: int = LENGTH, window: int | None = None) -> DataFrame:
    """``(rep, start, stop)``: byte ranges made of strings of ``length`` bytes that also start elsewhere; they overlap.

    ``texts`` is ``(rep, weight, text)`` with distinct reps; weight 2 marks a text that stands there twice, whose own
    ranges are left out: all of it is repeated.
    """
    spark = texts.sparkSession
    repeated, asked = _rerank(spark, lambda: _anchor_rows(texts, length, window), False)
    spans = [repeated]
    for step in STEPS:
        repeated, asked = _rerank(spark, lambda asked=asked, step=step: _block_rows(texts, asked, length, step), step == 1)
        spans.append(repeated)
    out = None
    for s in spans:
        s = s.select("rep", (F.col("place") - F.col("high")).alias("start"), (F.col("place") - F.col("low") + length).alias("stop"))
        out = s if out is None else out.unionByName(s)
    return out


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal ranges of overlapping or touching ones."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    opens = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[opens], np.append(reach[:-1][opens[1:]], reach[-1])


def whole_words(raw: bytes, start: int, stop: int) -> int:
    """Words of the range between white space; a word that goes on beyond an end is not counted."""
    inside = raw[start:stop]
    cut = [raw[at - 1 : at + 1] for at in (start, stop) if 0 < at < len(raw)]
    return max(0, len(inside.split()) - sum(len(c.split()) == 1 and len(c.strip()) == 2 for c in cut))


def _classes(df: DataFrame, id_column: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.select(
        F.coalesce(F.col(f"`{id_column}`").cast("bigint"), F.lit(_LEAST)).alias("_id"), F.xxhash64(body).alias("_text_t"),
        F.xxhash64(F.lit(7), body).alias("_text_u"), body.alias("text"),
    )


def remove_repeats(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, window: int | None = None, run_words: int = 0, run_bytes: int = 0,
) -> DataFrame:
    """``df`` without ``text``, with ``n_bytes, n_removed, n_spans, kept_sha256, spans, kept, kept_text``.

    Removed is every byte covered by a string of ``length`` bytes that also starts anywhere else in the table, the same document
    included; strings lie within one document and are judged on the input.  With ``run_words`` a maximal range of such bytes stays
    unless it holds that many whole words or ``run_bytes`` bytes.  ``spans`` are the maximal removed ranges
    ``(start, stop)``; ``kept`` is the rest of the bytes (binary: a cut may fall inside a character) and ``kept_text`` its whole
    characters.  Existing columns of these names are replaced.  Null texts are empty;
    shorter texts stay whole.  Equal texts are kept once with a count, so a large group of copies costs one text.  Rows that
    repeat an id with the same text count as copies; different texts may have one id, also null.
    """
    spark = df.sparkSession
    rows = _classes(df, id_column, text)
    classes = materialize(rows.groupBy("_text_t", "_text_u").agg(F.min("_id").alias("_id"), F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("weight")).withColumn("rep", F.monotonically_increasing_id()))
    # by id and digests: different texts may have one id, and the copies of a text are spread by their ids
    chosen = rows.join(classes, ["_id", "_text_t", "_text_u"]).select("rep", "weight", "text")
    # one copy of each text, stored by rep once, so that no later round moves texts
    name = f"repeats_{uuid.uuid4().hex}"
    (chosen.dropDuplicates(["rep"]).write.bucketBy(tasks(spark), "rep").sortBy("rep").option("path", new_folder(spark, name, table=True)).format("parquet").saveAsTable(name))
    texts = spark.table(name)
    spans = settled(spark, lambda: repeated_spans(texts, length, window))
    lists = spans.groupBy("rep").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))

    def cut(batches):
        for batch in batches:
            out = []
            for rep, weight, body, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = body.encode("utf-8", "surrogatepass")
                n = len(raw)
                if weight > 1 and n >= length:
                    found = [(0, n)]
                elif ranges:
                    a, b = merged(np.array([r["start"] for r in ranges]), np.array([r["stop"] for r in ranges]))
                    found = list(zip(a.tolist(), b.tolist(), strict=True))
                else:
                    found = []
                if run_words:
                    found = [(a, b) for a, b in found if b - a >= run_bytes or whole_words(raw, a, b) >= run_words]
                kept, at = [], 0
                for a, b in found:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                out.append((rep, n, n - len(kept), len(found), hashlib.sha256(kept).hexdigest(), [{"start": a, "stop": b} for a, b in found], kept, kept.decode("utf-8", "ignore")))
            if out:
                arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    span_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span_type, pa.binary(), pa.string()]
    names = ["rep", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept", "kept_text"]
    schema = "rep bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,stop:bigint>>, kept binary, kept_text string"
    done = texts.join(lists, "rep", "left").select("rep", "weight", "text", "ranges").mapInArrow(cut, schema)
    of_class = classes.select("_text_t", "_text_u", "rep").join(done, "rep").drop("rep")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    carried = [c for c in df.columns if c != text and c not in names]
    keys = df.select(*[F.col(f"`{c}`") for c in carried], F.xxhash64(body).alias("_text_t"), F.xxhash64(F.lit(7), body).alias("_text_u"))
    return keys.join(of_class, ["_text_t", "_text_u"]).select(*[F.col(f"`{c}`") for c in carried], *names[1:])
