"""Packing: the library's ids, whole documents, gapless sequences, few of them."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sparkprofile.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "I'll don't  <|endoftext|> a<|startoftext|>b", "x\x00y ﬁ İstanbul ΣΑΣ ŉ", "é́ é 1234½", "\ttab\x0b\x85 q\xa0z", "日本語 テスト 🙂🙂",
    "'s 're'VE 'LL'x", "", "   ", "µ ª º ² ß ſ K Å", "a\x1cb\x1fc ​\xadq", "Ǆ İ", None, "one\n\ntwo", "ÀÉÎ àéî-ñ_9",
]


def library_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_librarys():
    words = packing.WordTokens(PATH)
    for texts in (ODD, ODD[::-1], [None], [""]):
        for t, raw in zip(texts, words.encode(pa.array(texts, pa.string())), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == library_ids(t), t


def test_real_texts(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    for t, raw in zip(docs, packing.WordTokens(PATH).encode(pa.array(docs)), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == library_ids(t)


def filled(counts, capacity, **how):
    """Sequences of a plan, after checking that every item is placed once and nothing overlaps."""
    slots, n = packing.plan(counts, capacity, **how) if how else packing.best_plan(counts, capacity)
    ranks, content = {}, {}
    for size, rank, count, first, copies, offset in slots:
        for j in range(count):
            ranks.setdefault(size, []).append(rank + j)
            content.setdefault(first + j // copies, []).append((offset + j % copies * size, size))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in counts.items() if v}
    assert sorted(content) == list(range(n))
    for items in content.values():
        at = 0
        for offset, size in sorted(items):
            assert offset == at
            at += size
        assert at <= capacity
    return n


@pytest.mark.parametrize("seed", range(60))
def test_plan(seed):
    rng = random.Random(seed)
    capacity, counts = rng.choice([16, 64, 100, 4096]), {}
    for _ in range(rng.randint(0, 300)):
        n = min(capacity, max(1, int(rng.expovariate(1 / (capacity * rng.choice([0.1, 0.3, 0.6]))))))
        counts[n] = counts.get(n, 0) + rng.choice([1, 1, 40])
    n = filled(counts, capacity)
    assert all(filled(counts, capacity, groups=g, part=p) >= n for g, p in ((16, 4), (32, 3), (64, 2)))
    total = sum(k * v for k, v in counts.items())
    big = sum(v for k, v in counts.items() if 2 * k > capacity)
    assert n <= 1.12 * max(-(-total // capacity), big) + 2


def test_perfect_pairs():
    assert filled({60: 500, 40: 500}, 100) == 500
    assert filled({34: 1000, 33: 2000}, 100) <= 1002


def test_pack(spark):
    texts = [*ODD, "word " * 9_000, "same text", "same text", *["a b c"] * 50]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, length string").repartition(5)
    pieces = packing.tokenized_pieces(df, "doc_id", "text", PATH, 4096, with_ids=True)
    out = packing.pack(pieces).collect()
    for doc, text, _ in rows:
        ids = [*library_ids(text), 1]
        mine = sorted((r for r in out if r.doc_id == doc), key=lambda r: r.piece)
        assert [i for r in mine for i in r.ids] == ids
        assert [r.start for r in mine] == list(range(0, len(ids), 4096)) and all(r.length == 4096 for r in mine[:-1])
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in mine)
    places = sorted((r.sequence_id, r.offset, r.length) for r in out)
    at = {}
    for s, offset, n in places:
        assert at.get(s, 0) == offset
        at[s] = offset + n
        assert at[s] <= 4096
    assert packing.pack(packing.tokenized_pieces(df.limit(0), "doc_id", "text", PATH)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(pieces, 100)


def test_repeated_ids_and_nulls(spark):
    df = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a"), (None, None)], "doc_id bigint, text string")
    out = packing.pack(packing.tokenized_pieces(df, "doc_id", "text", PATH)).collect()
    assert len(out) == 4 and len({(r.sequence_id, r.offset) for r in out}) == 4
