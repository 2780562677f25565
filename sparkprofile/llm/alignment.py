"""Alignment of two tokenizers' ids over the bytes of the same text, and how often each pair of ids is linked corpus-wide."""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialize

MARK = "▁"
SLICE_TOKENS = 200_000  # ids that are handled together
TASK_PAIRS = 1_000_000  # counted pairs that a task holds before it sends them
SLICE_PAIRS = 2_000_000  # id pairs whose counts are broadcast together
MARKS = (",", ";", "|", "")  # before an id of a group, the first id of a group, the first id of its second side, the first id of a row
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def byte_symbols() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: visible Latin-1 characters stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Byte:
    """A byte-level vocabulary read from a tokenizer file whose ids follow the order of its merges."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        symbols = byte_symbols()
        special = {t["content"] for t in described["added_tokens"]}
        ranks = {bytes(symbols[c] for c in t): i for t, i in described["model"]["vocab"].items() if t not in special}
        merged = [m if isinstance(m, list) else m.split(" ") for m in described["model"]["merges"]]
        order = [described["model"]["vocab"][a + b] for a, b in merged]
        if order != sorted(order) or described["normalizer"] is not None or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("not a vocabulary of all bytes whose ids follow its merges")
        self.tokens = {i: t for t, i in ranks.items()}
        self.encoder = tiktoken.Encoding("byte", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self.encoder.encode_ordinary(text)


class Piece:
    """A SentencePiece model that puts a space before a text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(len(self.model))]
        self.tokens = {
            i: bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(MARK, " ").encode("utf-8") for i, n in enumerate(names)
        }

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


def written_ids(most: int) -> pa.Array:
    """Every id below ``most`` after each of the ``MARKS``."""
    return pa.array([f"{m}{i}" for i in range(most) for m in MARKS], pa.string())


def lengths(tokens: dict[int, bytes]) -> np.ndarray:
    """The number of bytes of each id."""
    out = np.zeros(max(tokens) + 1, np.int32)
    out[list(tokens)] = [len(t) for t in tokens.values()]
    return out


def encoded(df: DataFrame, text: str, a_file: str, b_file: str, pattern: str, carry: Sequence[str] = ()) -> DataFrame:
    """``(*carry, a, b)``: little-endian unsigned 32-bit ids of space and text by both tokenizers.

    Both are empty for rows whose text is null, empty, or not spelled by the ids of either side.
    """
    def run(batches):
        left, right = Byte(a_file, pattern), Piece(b_file)
        spell = right.tokens.__getitem__
        for batch in batches:
            a, b = [], []
            for t in batch.column(0).to_pylist():
                x = y = ()
                if t:
                    body, y = " " + t, right.encode(t)
                    if b"".join(map(spell, y)) == body.encode("utf-8", "surrogatepass"):
                        x = left.encode(body)  # spells every text: each byte is a token
                    else:
                        y = ()
                a.append(array("I", x).tobytes())
                b.append(array("I", y).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=[*batch.schema.names[1:], "a", "b"])

    rows = df.select(F.col(f"`{text}`").cast("string").alias("_align_text"), *[F.col(f"`{c}`") for c in carry])
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in carry)
    return rows.mapInArrow(run, kinds + "a binary, b binary")


@dataclass
class Side:
    """The ids of consecutive rows by one tokenizer."""

    ids: np.ndarray
    bounds: np.ndarray  # of the rows among the ids
    ends: np.ndarray  # of the ids among the rows' bytes, which follow each other

    @classmethod
    def of(cls, column: pa.Array, sizes: np.ndarray) -> "Side":
        rows = column.to_pylist()
        ids = np.frombuffer(b"".join(rows), "<u4").astype(np.int64)
        return cls(ids, np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int64), np.cumsum(sizes[ids]))


class Aligned:
    """Groups and links of consecutive rows.

    ``at_a`` and ``at_b`` are the end-to-index dictionaries of both sides, addressed by byte offset: where an offset is a key of both, a
    group ends.  Between two neighbouring keys of either side lie bytes of exactly one id of each, and two overlapping
    ids share exactly one such stretch, so the stretches of a group are its links.
    """

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        size = int(a.ends[-1]) + 1 if len(a.ends) else 1
        at_a, at_b = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        at_a[a.ends], at_b[b.ends] = np.arange(len(a.ends)), np.arange(len(b.ends))
        self.common = np.flatnonzero((at_a >= 0) & (at_b >= 0))  # sorted common keys
        stretch = np.flatnonzero((at_a >= 0) | (at_b >= 0))
        self.link_a, self.link_b = (np.cumsum(at[stretch] >= 0) - (at[stretch] >= 0) for at in (at_a, at_b))
        self.group_a, self.group_b = at_a[self.common].astype(np.int64) + 1, at_b[self.common].astype(np.int64) + 1  # where groups end among the ids
        offsets = np.concatenate([[0], a.ends])[a.bounds]
        self.link_bounds, self.group_bounds = np.searchsorted(stretch, offsets, side="right"), np.searchsorted(self.common, offsets, side="right")
        self.keys = (a.ids[self.link_a] << 32) | b.ids[self.link_b]

    def spelled(self, written: pa.Array) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3`` of each row: one run of bytes that the rows' bounds cut; ``written`` as of :func:`written_ids`."""
        a, b = self.a, self.b
        size_a, size_b = np.diff(self.group_a, prepend=0), np.diff(self.group_b, prepend=0)
        group_of_a, group_of_b = np.repeat(np.arange(len(size_a)), size_a), np.repeat(np.arange(len(size_b)), size_b)
        place_a = np.arange(len(a.ids)) + (self.group_b - size_b)[group_of_a]
        place_b = np.arange(len(b.ids)) + self.group_a[group_of_b]
        total = len(a.ids) + len(b.ids)
        number, before = np.zeros(total, np.int64), np.full(total, MARKS.index(","), np.int64)
        number[place_a], number[place_b] = a.ids, b.ids
        before[place_a[(self.group_a - size_a)]] = MARKS.index(";")
        before[place_b[(self.group_b - size_b)]] = MARKS.index("|")
        bounds = a.bounds + b.bounds
        before[bounds[:-1][bounds[:-1] < bounds[1:]]] = MARKS.index("")
        parts = written.take(pa.array(number * len(MARKS) + before))
        offsets = np.frombuffer(parts.buffers()[1], np.int32)[: total + 1] if total else np.zeros(1, np.int32)
        data = parts.buffers()[2] if total else pa.py_buffer(b"")
        return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(np.ascontiguousarray(offsets[bounds])), data)


def slices(batch: pa.RecordBatch, sizes_a: np.ndarray, sizes_b: np.ndarray) -> Iterator[tuple[int, int, Aligned]]:
    """``(first row, past, alignment)`` of consecutive rows of about ``SLICE_TOKENS`` ids; ``a`` and ``b`` are the last columns."""
    a, b = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
    ends = np.cumsum(pc.binary_length(a).to_numpy().astype(np.int64)) // 4
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        past = max(at + 1, int(np.searchsorted(ends, before + SLICE_TOKENS, side="right")))
        yield at, past, Aligned(Side.of(a.slice(at, past - at), sizes_a), Side.of(b.slice(at, past - at), sizes_b))
        at = past


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])


def pair_counts(rows: DataFrame, sizes_a: np.ndarray, sizes_b: np.ndarray) -> DataFrame:
    """``(a, b, n)``: in how many rows of :func:`encoded` the ids are linked at least once.

    A task adds up its own rows and sends one row per pair, again each time it holds ``TASK_PAIRS`` of them.
    """
    def run(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

        def sent():
            keys, n = held
            return pa.RecordBatch.from_arrays([pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(n)], names=["a", "b", "n"])

        for batch in batches:
            for lo, hi, found in slices(batch, sizes_a, sizes_b):
                keys, number = np.unique(found.keys, return_inverse=True)
                row = np.repeat(np.arange(hi - lo), np.diff(found.link_bounds))
                once = np.unique(row * max(1, len(keys)) + number) % max(1, len(keys))
                both, at = np.unique(np.concatenate([held[0], keys]), return_inverse=True)
                n = np.bincount(at, np.concatenate([held[1], np.bincount(once, minlength=len(keys))]), len(both)).astype(np.int64)
                held = [both, n]
                if len(both) > TASK_PAIRS:
                    yield sent()
                    held = [both[:0], n[:0]]
        yield sent()

    return rows.select("a", "b").mapInArrow(run, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _ranges(counts: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of first ids, ``past`` excluded, that hold at most ``most`` pairs each, or one id."""
    sizes = sorted(map(tuple, counts.groupBy("a").count().collect()))  # one row per id of the first vocabulary
    out, held = [], 0
    for a, n in sizes:
        if not out or held + n > most:
            out.append([a, a + 1])
            held = 0
        out[-1][1] = a + 1
        held += n
    return [tuple(r) for r in out] or [(0, 0)]


def align(
    df: DataFrame, text: str, a_file: str, b_file: str, pattern: str, carry: Sequence[str] = (), most_pairs: int = SLICE_PAIRS
) -> DataFrame:
    """``(*carry, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)`` of every row.

    Space and text are encoded by a byte-level vocabulary (``a_file``, its ``pattern`` cuts the text before the merges) and by a
    SentencePiece model that adds the space itself (``b_file``), special tokens' strings being plain text.  Byte offsets where
    tokens of both end cut the ids into groups (``groups``: ``a1,a2|b1;a3|b2,b3``); ids whose byte ranges overlap are linked.
    The count of an id pair is the number of rows that hold it linked: ``count_sum`` adds the counts of the row's
    links, ``n_best`` counts the links whose count is the highest of their first id, ties included.  Rows whose text is
    null, empty, or not spelled by the ids of either side (a text that holds the mark character, for one) have zeros
    and an empty ``groups``, and count nowhere.  Rows are taken as they are: repeated rows and ids count each time, null
    ids stay, extra columns are dropped unless named in ``carry``.  Very long texts are held whole by their task.

    The ids are written once (four bytes each) and read twice.  Only counts are shuffled, one row per pair and
    task.  The counts of at most ``most_pairs`` pairs are broadcast at a time, cut by first id, each range to a step of its own
    over the same rows; the steps follow one another within one stage.
    """
    sizes_a, sizes_b = lengths(Byte(a_file, pattern).tokens), lengths(Piece(b_file).tokens)
    rows = materialize(encoded(df, text, a_file, b_file, pattern, carry))
    counts = materialize(pair_counts(rows, sizes_a, sizes_b))
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in carry)
    ids, measures = "a binary, b binary", ", ".join(f"{m} bigint" for m in MEASURES)
    ranges = _ranges(counts, most_pairs)
    out = rows.select(*[F.col(f"`{c}`") for c in carry], *[F.lit(0).cast("bigint").alias(f"_{m}") for m in MEASURES], "a", "b")
    for step, bounds in enumerate(ranges):
        last = step + 1 == len(ranges)
        out = out.mapInArrow(
            _step(df.sparkSession, counts, bounds, step == 0, last, len(carry), sizes_a, sizes_b),
            kinds + measures + (", groups string" if last else ", " + ids),
        )
    return out


def _step(
    spark: SparkSession, counts: DataFrame, bounds: tuple[int, int], first: bool, last: bool, width: int, sizes_a: np.ndarray, sizes_b: np.ndarray
) -> Callable:
    """The task function that adds what the counts of one range of first ids make."""
    table = counts.where((F.col("a") >= bounds[0]) & (F.col("a") < bounds[1])).toArrow()
    a, b, n = (table[c].to_numpy().astype(np.int64) for c in ("a", "b", "n"))
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    highest = np.repeat(np.maximum.reduceat(n, starts), np.diff([*starts, len(a)])) if len(a) else n
    shared = spark.sparkContext.broadcast(((a << 32) | b, n, n == highest))

    def run(batches):
        known, count, best = shared.value
        written = written_ids(max(len(sizes_a), len(sizes_b))) if last else None
        for batch in batches:
            sums, texts = [], []
            for lo, hi, found in slices(batch, sizes_a, sizes_b):
                keys, number = np.unique(found.keys, return_inverse=True)
                at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
                hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
                value, top = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
                value[hit], top[hit] = count[at[hit]], best[at[hit]]
                own = [per_row(top[number], found.link_bounds), per_row(value[number], found.link_bounds)]
                shape = [np.diff(found.a.bounds), np.diff(found.b.bounds), np.diff(found.group_bounds), np.diff(found.link_bounds)]
                sums.append(np.stack([*(shape if first else [np.zeros(hi - lo, np.int64)] * 4), *own], 1))
                if last:
                    texts.append(found.spelled(written))
            if not sums:
                continue
            total = np.concatenate(sums) + np.stack([batch.column(i).to_numpy() for i in range(width, width + len(MEASURES))], 1)
            measured = [pa.array(np.ascontiguousarray(total[:, i])) for i in range(len(MEASURES))]
            rest = [pa.concat_arrays(texts)] if last else batch.columns[-2:]
            names = [*batch.schema.names[:width], *MEASURES, *(["groups"] if last else ["a", "b"])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *measured, *rest], names=names)

    return run
