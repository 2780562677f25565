"""SentencePiece encoding and decoding: unigram Viterbi over a trie of the distinct words, shared by prefix."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import WordIds

MARK = "▁"
CACHE_WORDS = 200_000
SLICE_ROWS = 1_000
# piece types of the model file
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Pieces:
    """The vocabulary of a model file: the score of each piece and, per start, the piece lengths worth trying."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.names = [model.id_to_piece(i) for i in range(len(model))]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(len(model))]
        self.ids = {n: i for i, n in enumerate(self.names) if not special[i]}
        self.scores = {n: model.get_score(i) for n, i in self.ids.items()}
        self.bytes = {int(n[3:5], 16): i for i, n in enumerate(self.names) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = model.unk_id()
        # a character that no piece has costs more than any piece
        self.missing = min(self.scores.values(), default=0.0) - 10.0
        # every ending of a piece, with the piece's score where it is one itself: the trie of the reversed pieces
        self.endings = {n[i:]: None for n in self.ids for i in range(len(n))} | self.scores
        # a word may be cut off where no piece crosses: marks only ever start a piece
        if any(MARK in n.lstrip(MARK) for n in self.ids):
            raise ValueError("pieces of this model cross words")

    def spell(self, char: str) -> list[int]:
        """Ids of a character outside the vocabulary: its bytes, or the unknown id."""
        raw = char.encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in raw] if self.bytes else [self.unknown]


def marked_words(text: str | None) -> list[str]:
    """The text after a leading mark, spaces as marks, cut before each run of marks."""
    if not text:
        return []
    if "  " not in text and MARK not in text and text[-1] != " " and text[0] != " ":
        return [MARK + w for w in text.split(" ")]
    return re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))


def encode_words(words: Iterable[str], pieces: Pieces) -> dict[str, list[int]]:
    """The best segmentation of each distinct word.

    The words are sorted, which lists the leaves of their trie in depth-first order: a word keeps the forward scores
    of the prefix it shares with the one before and computes only the rest.  Position i holds the best score of the first
    i characters and the length of the piece that ends there; ties take the shorter last piece.
    """
    endings, ids, missing = pieces.endings, pieces.ids, pieces.missing
    best, last, before = [0.0], [0], ""
    absent = object()
    out = {}
    for word in sorted(words):
        shared, most = 0, min(len(word), len(before))
        while shared < most and word[shared] == before[shared]:
            shared += 1
        del best[shared + 1 :], last[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            top, size, start = best[end - 1] + missing, 0, end - 1
            while start >= 0:
                s = endings.get(word[start:end], absent)
                if s is not None:
                    if s is absent:
                        break
                    s += best[start]
                    if s > top:
                        top, size = s, end - start
                start -= 1
            best.append(top)
            last.append(size)
        found, end = [], len(word)
        while end:
            size = last[end]
            if size:
                found.append(ids[word[end - size : end]])
                end -= size
            else:
                found.extend(reversed(pieces.spell(word[end - 1])))
                end -= 1
        found.reverse()
        out[word] = found
        before = word
    return out


def raw_text(ids: Iterable[int], pieces: Pieces) -> str:
    """The characters behind the ids, marks as spaces; byte ids are joined."""
    raw = bytearray()
    for i in ids:
        b = pieces.byte_of.get(i)
        if b is None:
            raw += pieces.names[i].replace(MARK, " ").encode("utf-8")
        else:
            raw.append(b)
    return raw.decode("utf-8", "surrogatepass")


def decode_ids(ids: Iterable[int], pieces: Pieces) -> str:
    """The text of the ids: marks are spaces, the leading one is dropped."""
    return raw_text(ids, pieces)[1:]


def encode(df: DataFrame, text: str, model_file: str, ids: str = "ids", digest: bool = False) -> DataFrame:
    """``df`` with its texts' piece ids (``array<int>``), in one pass without a shuffle.

    The best path maximises the sum of the piece scores of the model file, whichever way that file was trained.  Each task
    encodes the distinct words of a batch together and keeps the results of at most ``CACHE_WORDS`` words.  Null
    and empty texts have no ids; white space other than the space, and characters without a piece, become bytes.
    A text that holds the mark itself decodes to a space there, as the format says.  With ``digest``, three columns
    replace ``ids``: ``n_ids``, ``ids_crc32`` (of little-endian unsigned 32-bit ids) and ``round_trip`` (decoding gives
    the text back, marks read as spaces).
    """
    kept = [c for c in df.columns if c not in ((ids,) if not digest else ("n_ids", "ids_crc32", "round_trip"))]

    def run(batches):
        pieces = Pieces(model_file)
        exact: list[bool] = []

        def learn(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
            found = encode_words(new, pieces)
            if digest:
                if table.starts.size == 0:
                    exact.clear()
                exact.extend(raw_text(found[w], pieces) == w.replace(MARK, " ") for w in new)
            sizes = np.array([len(found[w]) for w in new], np.int64)
            return np.fromiter(chain.from_iterable(found[w] for w in new), np.uint32, int(sizes.sum())), sizes

        table = WordIds(learn, CACHE_WORDS)

        def encoded(words: pa.Array, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
            numbers = table.numbers_of(words)
            wrong = np.concatenate([[0], np.cumsum(~np.array(exact, bool)[numbers])]) if digest else np.zeros(len(words) + 1)
            return table.rows(numbers, ends), wrong[ends[1:]] == wrong[ends[:-1]]

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                texts = part.column(0).fill_null("")
                # texts with lone spaces only are cut by Arrow, the others one by one
                odd = np.flatnonzero(pc.or_(pc.equal(texts, ""), pc.match_substring_regex(texts, f"  |^ | $|{MARK}")).to_numpy(zero_copy_only=False))
                cut = pc.split_pattern(texts.filter(pa.array(~np.isin(np.arange(len(texts)), odd))), " ")
                rows, fine = encoded(pc.binary_join_element_wise(MARK, cut.flatten(), ""), cut.offsets.to_numpy() - cut.offsets[0].as_py())
                if len(odd):
                    split = [marked_words(t) for t in texts.take(pa.array(odd)).to_pylist()]
                    more, good = encoded(pa.array(list(chain.from_iterable(split)), pa.string()), np.cumsum([0, *map(len, split)]))
                    for i, r, ok in zip(odd.tolist(), more, good, strict=True):
                        rows.insert(i, r)
                        fine = np.insert(fine, i, ok)
                if digest:
                    extra = [
                        pa.array([len(r) // 4 for r in rows], pa.int64()), pa.array([zlib.crc32(r) for r in rows], pa.int64()),
                        pa.array(fine, pa.bool_()),
                    ]
                    names = ["n_ids", "ids_crc32", "round_trip"]
                else:
                    ends = np.cumsum([0, *(len(r) // 4 for r in rows)])
                    extra = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), "<i4")))]
                    names = [ids]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *extra], names=[*part.schema.names[1:], *names])

    rows = df.select(F.col(f"`{text}`").alias("_spm_text"), *[F.col(f"`{c}`") for c in kept])
    schema = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in kept)
    return rows.mapInArrow(run, schema + ("n_ids bigint, ids_crc32 bigint, round_trip boolean" if digest else f"`{ids}` array<int>"))


def decode(df: DataFrame, ids: str, model_file: str, text: str = "decoded") -> DataFrame:
    """``df`` with the text of its id arrays; null arrays give empty texts."""
    kept = [c for c in df.columns if c != text]

    def run(batches):
        pieces = Pieces(model_file)
        for batch in batches:
            texts = pa.array([decode_ids(r or (), pieces) for r in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], texts], names=[*batch.schema.names[1:], text])

    rows = df.select(F.col(f"`{ids}`").alias("_spm_ids"), *[F.col(f"`{c}`") for c in kept])
    schema = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in kept)
    return rows.mapInArrow(run, schema + f"`{text}` string")
