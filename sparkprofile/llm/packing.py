"""Best-fit packing of tokenised documents by linear grouping (de la Vega and Lueker)."""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import WordIds, materialize

LENGTH = 4_096
END = 1
# tried in turn: lengths above this part of a sequence are large, so fewer than this many share one; groups of large lengths
LARGE = (4, 3, 2)
GROUPS = (16, 32, 64)
CACHE_WORDS = 200_000
SLICE_ROWS = 1_000
_WORD_END = "</w>"
_MARK = "\0"


class WordTokens:
    """Ids of a byte-pair vocabulary whose pre-tokens never cross white space, as bytes per chunk between spaces.

    Chunks of plain Latin text are split by the file's own pattern and merged in one call for many distinct
    pre-tokens; every other chunk goes through the file's whole pipeline.
    """

    def __init__(self, tokenizer_file: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_file)
        self.table = WordIds(self.learn, CACHE_WORDS)
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, steps = spec["model"]["vocab"], spec["normalizer"]["normalizers"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.fast = (
            spec["model"]["end_of_word_suffix"] == _WORD_END and [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
        )
        if not self.fast:
            return
        self.cut = regex.compile(split["pattern"]["Regex"]).sub
        # letters of these ranges stay as they are under normal forms and lower-case alone, whatever stands beside them
        self.odd = re.compile("[^!-~¡-į]|<[|]").search
        # the byte alphabet of byte-level vocabularies: printable bytes are themselves, the others follow from 256
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {}
        for token, i in vocab.items():
            end = token.endswith(_WORD_END)
            plain = token.removesuffix(_WORD_END) if end else token
            if all(c in byte for c in plain):
                ranks[bytes(byte[c] for c in plain) + (b"\0" if end else b"")] = i
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(_WORD_END)]] = True
        ranks[b"\0"] = max(vocab.values()) + 10  # the mark alone; it always joins the byte before it
        self.merge = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these chunks in a row, and how many each has."""
        odd = [i for i, c in enumerate(chunks) if not self.fast or self.odd(c)]
        own = [np.array(self.whole.encode(chunks[i], add_special_tokens=False).ids, np.uint32) for i in odd]
        plain = chunks
        if odd:
            plain = chunks.copy()
            for i in odd:
                plain[i] = ""
        # one line per chunk, a mark after each pre-token
        lines = self.cut("\\g<0>\0", "\n".join(plain).lower() + "\n") if self.fast else "\n" * len(chunks)
        raw = np.frombuffer(lines.encode(), np.uint8)
        last = np.cumsum(raw == 0)[raw == 10]
        marked = lines.replace("\n", "")
        ids = np.array(self.merge.encode_ordinary(marked) if marked else [], np.uint32)
        ends = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1]) if marked else np.zeros(1, np.int64)
        bound = ends[np.concatenate([[0], last])]
        sizes = np.diff(bound)
        if odd:
            ids = np.insert(ids, np.repeat(bound[odd], [len(o) for o in own]), np.concatenate(own))
            sizes[odd] = [len(o) for o in own]
        return ids, sizes

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; nulls have none."""
        chunks = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        return self.table.rows(self.table.numbers_of(chunks.flatten()), chunks.offsets.to_numpy() - chunks.offsets[0].as_py())


def tokenized_pieces(
    df: DataFrame, id_column: str, text: str, tokenizer_file: str, length: int = LENGTH, end: int = END, with_ids: bool = False
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: whole documents cut into pieces of at most ``length`` ids.

    A document is its ids followed by the id ``end``; a null or empty text is that id alone.  Only documents above
    ``length`` are cut; their last piece may be shorter.
    """
    def run(batches):
        words = WordTokens(tokenizer_file)
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                rows = []
                for doc, raw in zip(part.column(0).to_pylist(), words.encode(part.column(1)), strict=True):
                    raw += tail
                    for piece, start in enumerate(range(0, len(raw), 4 * length)):
                        cut = raw[start : start + 4 * length]
                        rows.append((doc, piece, start // 4, len(cut) // 4, zlib.crc32(cut), cut))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                arrays = [pa.array(c, t) for c, t in zip(columns[:5], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(c, "<i4") for c in columns[5]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    return df.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


@dataclass
class Run:
    """``count`` sequences from ``first`` on with the same content so far and ``room`` left in each."""

    room: int
    first: int
    count: int


def _group_sizes(counts: dict[int, int], groups: int) -> list[int]:
    """Linear grouping: the largest length of each of about ``groups`` groups with equally many items."""
    lengths = sorted(counts, reverse=True)
    total = sum(counts.values())
    per, seen, tops = max(1, -(-total // groups)), 0, []
    for n in lengths:
        if seen // per >= len(tops):
            tops.append(n)
        seen += counts[n]
    return tops


def _configurations(sizes: Sequence[int], capacity: int, most: int) -> np.ndarray:
    """All ways to fill a sequence with at most ``most`` of these sizes, as a matrix (size, way) of counts."""
    ways = []
    for k in range(1, most + 1):
        for combo in combinations_with_replacement(range(len(sizes)), k):
            if sum(sizes[i] for i in combo) <= capacity:
                ways.append(np.bincount(combo, minlength=len(sizes)))
    return np.array(ways, float).T


def _cover(matrix: np.ndarray, need: np.ndarray) -> np.ndarray:
    """The linear programme: fewest ways (columns, fractional) that cover ``need``; revised simplex by column generation."""
    k = len(need)
    basis = [int(np.argmax(np.where((matrix > 0).sum(0) == 1, matrix[i], 0))) for i in range(k)]
    for _ in range(50 * k + 200):
        b = matrix[:, basis]
        prices = np.linalg.solve(b.T, np.ones(k))
        gains = prices @ matrix
        enter = int(gains.argmax())
        if gains[enter] <= 1 + 1e-9:
            break
        x, step = np.linalg.solve(b, need), np.linalg.solve(b, matrix[:, enter])
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        basis[int(ratio.argmin())] = enter
    out = np.zeros(matrix.shape[1])
    np.add.at(out, basis, np.maximum(0, np.linalg.solve(matrix[:, basis], need)))
    return out


def best_plan(counts: dict[int, int], capacity: int = LENGTH) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """The plan with the fewest sequences over a few numbers of groups and bounds of large lengths."""
    return min((plan(counts, capacity, groups, part) for part in LARGE for groups in GROUPS), key=lambda p: p[1])


def plan(
    counts: dict[int, int], capacity: int = LENGTH, groups: int = GROUPS[0], part: int = LARGE[0]
) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Place ``counts[length]`` items of every length; returns the slots and the number of sequences.

    A slot row ``(length, rank, count, first_sequence, copies, offset)`` places the items of that length with ranks from ``rank``
    on: ``copies`` consecutive ranks fill one sequence from ``offset`` on, the next ones the next sequence.
    Everything here is bounded by the number of different lengths, at most ``capacity``, not by the data.

    Large items are rounded up to the largest length of their group; the linear programme over these few sizes gives the
    configurations; their slots are filled with actual items, largest first, which are no longer than the slot.
    Items the rounded-down solution leaves over, and the small ones, go in by best fit, longest first, each into
    the sequence with the least room that holds it, or a new one.
    """
    slots: list[tuple[int, int, int, int, int, int]] = []
    used = dict.fromkeys(counts, 0)
    open_runs: list[tuple[int, int, int]] = []
    sequences = 0
    large = {n: c for n, c in counts.items() if n > capacity // part and c}
    if large:
        tops = _group_sizes(large, groups)
        group_of = {n: max(i for i, t in enumerate(tops) if t >= n) for n in large}
        need = np.zeros(len(tops))
        for n, c in large.items():
            need[group_of[n]] += c
        matrix = _configurations(tops, capacity, part - 1)
        times = np.floor(_cover(matrix, need) + 1e-9).astype(int)
        stock = [[[n, large[n]] for n in sorted(large, reverse=True) if group_of[n] == i] for i in range(len(tops))]
        for way in np.flatnonzero(times).tolist():
            holds = [i for i in range(len(tops)) for _ in range(int(matrix[i, way]))]
            todo = int(times[way])
            while todo:
                heads: dict[int, int] = {}
                content, take = [], todo
                # the items next in line; a group's next length when the first has too few for all its places here
                for i in holds:
                    at, need_here = heads.get(i, 0), 0
                    while at < len(stock[i]) and stock[i][at][1] - sum(1 for g, a in content if (g, a) == (i, at)) <= 0:
                        at += 1
                    heads[i] = at
                    if at < len(stock[i]):
                        content.append((i, at))
                if not content:
                    break
                for g, a in set(content):
                    take = min(take, stock[g][a][1] // content.count((g, a)))
                offset, seen = 0, set()
                for g, a in content:
                    if (g, a) in seen:
                        continue
                    seen.add((g, a))
                    n, copies = stock[g][a][0], content.count((g, a))
                    slots.append((n, used[n], take * copies, sequences, copies, offset))
                    used[n] += take * copies
                    stock[g][a][1] -= take * copies
                    offset += n * copies
                for i in set(holds):
                    stock[i] = [x for x in stock[i] if x[1]]
                insort(open_runs, (capacity - offset, sequences, take))
                sequences += take
                todo -= take
    for n in sorted(counts, reverse=True):
        left = counts[n] - used[n]
        while left:
            at = bisect_left(open_runs, (n, -1, -1))
            if at < len(open_runs):
                room, first, count = open_runs.pop(at)
            else:
                room, first, count = capacity, sequences, -(-left // (capacity // n))
                sequences += count
            copies = min(room // n, left)
            full = min(count, left // copies)
            slots.append((n, used[n], full * copies, first, copies, capacity - room))
            used[n] += full * copies
            left -= full * copies
            if room - copies * n:
                insort(open_runs, (room - copies * n, first, full))
            if full < count:
                insort(open_runs, (room, first + full, count - full))
    return slots, sequences


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: all pieces in as few sequences of ``length`` as the plan finds.

    ``pieces`` needs ``doc_id``, ``piece`` and ``length`` (1 to ``length``); it is read several times, so give a written table.
    Only the counts by length (at most ``length`` rows) reach the driver.  Pieces of a length are numbered by their
    partition's start plus their place in it, so one very common length is no bottleneck.  Equal rows are
    separate pieces; an empty table stays empty.
    """
    spark = pieces.sparkSession
    order = Window.partitionBy("_part", "length").orderBy("doc_id", "piece")
    placed = materialize(
        pieces.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.row_number().over(order) - 1)
    )
    sizes = placed.groupBy("length", "_part").count()
    starts = sizes.select(
        F.col("length").alias("_l"), F.col("_part").alias("_p"),
        (F.sum("count").over(Window.partitionBy("length").orderBy("_part")) - F.col("count")).alias("_start"),
    )
    counts = {int(r["length"]): int(r["n"]) for r in placed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(n < 1 or n > length for n in counts):
        raise ValueError(f"pieces are 1 to {length} long")
    slots, _ = best_plan(counts, length)
    table = spark.createDataFrame(
        slots, "_n bigint, _from bigint, _count bigint, _first bigint, _copies bigint, _offset bigint"
    )
    # slots of a length as a sorted array: the last one that starts at or before the rank
    by_length = table.groupBy("_n").agg(F.sort_array(F.collect_list(F.struct("_from", "_first", "_copies", "_offset"))).alias("_slots"))
    ranked = placed.join(starts, (F.col("length") == F.col("_l")) & (F.col("_part") == F.col("_p"))).withColumn(
        "_rank", F.col("_start") + F.col("_row")
    )
    found = ranked.join(F.broadcast(by_length), F.col("length") == F.col("_n")).withColumn(
        "_s", F.expr("element_at(filter(_slots, s -> s._from <= _rank), -1)")
    )
    within = F.col("_rank") - F.col("_s._from")
    return found.withColumn("sequence_id", F.col("_s._first") + F.floor(within / F.col("_s._copies"))).withColumn(
        "offset", F.col("_s._offset") + (within % F.col("_s._copies")) * F.col("length")
    ).select(*[F.col(f"`{c}`") for c in pieces.columns], "sequence_id", "offset")
