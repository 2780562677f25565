"""Token alignment against whole texts encoded at once and intervals compared one by one."""

import hashlib
from bisect import bisect_right
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from sparkprofile.llm import alignment
from sparkprofile.llm.queries import QUERIES

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


class Both:
    """The tokenizers as their own libraries read the files, and the operator's readers."""

    def __init__(self):
        self.a = Tokenizer.from_file(A_FILE)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
        self.left, self.right = alignment.Byte(A_FILE, public_tokenizers.PATTERN), alignment.Piece(B_FILE)
        self.a_bytes, self.b_bytes = self.left.tokens, self.right.tokens


@pytest.fixture(scope="module")
def pair():
    return _PAIR


def intervals(ids, raw):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(raw[i]), i))
        at += len(raw[i])
    return out


def by_hand(texts, pair):
    """``[(n_a, ..., count_sum, groups)]`` of whole texts."""
    rows = []
    for text in texts:
        if not text:
            rows.append(None)
            continue
        body = " " + text
        a, b = intervals(pair.a.encode(body, add_special_tokens=False).ids, pair.a_bytes), intervals(pair.b.encode(text), pair.b_bytes)
        if any(b"".join(raw[i] for _, _, i in side) != body.encode() for side, raw in ((a, pair.a_bytes), (b, pair.b_bytes))):
            rows.append(None)
            continue
        ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups = {e: ([], []) for e in ends}
        for n, side in enumerate((a, b)):
            for s, _, i in side:
                groups[ends[bisect_right(ends, s)]][n].append(i)
        links, first = Counter(), 0
        for s, e, x in a:
            while b[first][1] <= s:
                first += 1
            for t, _, y in b[first:]:
                if t >= e:
                    break
                links[x, y] += 1
        rows.append((len(a), len(b), len(groups), links, ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups.values())))
    count = Counter(p for r in rows if r for p in r[3])
    most = {}
    for (x, _), n in count.items():
        most[x] = max(n, most.get(x, 0))
    return [
        (*r[:3], r[3].total(), sum(n for p, n in r[3].items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in r[3].items()), r[4]) if r else (0,) * 6 + ("",)
        for r in rows
    ]


def found(df, **kw):
    return [tuple(r[n] for n in [*NAMES, "groups"]) for r in sorted(alignment.align(df, "text", A_FILE, B_FILE, public_tokenizers.PATTERN, ["doc_id"], **kw).collect(), key=lambda r: r.doc_id)]


ODD = [
    "", None, " ", "  ", "a", " a", "a ", "a  b", "a \n b\n", "\n\nx", "one\ttwo  three", "don't we'll 12 345x", "<|endoftext|> and </s> <unk> <0x41>",
    "mark ▁ inside", "naïve café ﬁ  x　y", "日本語 の テキスト", "é \U0001f600\U0001f469‍\U0001f4bb emoji", "\x00 nul \x1c sep", "same same same", "same same same",
    "word " * 300, "unbroken" * 200, "line\n" * 200, "…—“quotes”",
]


@pytest.mark.parametrize("most_pairs", [alignment.SLICE_PAIRS, 10])
def test_odd_texts(spark, pair, most_pairs):
    texts = ODD if most_pairs > 10 else ODD[:10]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id bigint, text string, n_a string").repartition(3)
    assert found(df, most_pairs=most_pairs) == by_hand(texts, pair)


def test_query_on_whole_documents(spark, pair):
    folder = "/root/testdata/sf0.001"
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()]
    expected = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in by_hand(texts, pair)]
    rows = QUERIES["op12_token_alignment"](spark, folder).orderBy("doc_id").collect()
    assert [tuple(r[n] for n in [*NAMES, "groups_sha256"]) for r in rows] == expected
    assert sum(r.n_links > 0 for r in rows) > 150


def test_repeated_null_ids_and_empty_tables(spark, pair):
    df = spark.createDataFrame([(None, "two words"), (None, "two words"), (3, "words two")], "doc_id bigint, text string")
    rows = alignment.align(df, "text", A_FILE, B_FILE, public_tokenizers.PATTERN, ["doc_id"]).collect()
    expected = by_hand(["two words", "two words", "words two"], pair)
    assert sorted(tuple(r[n] for n in [*NAMES, "groups"]) for r in rows) == sorted(expected)
    assert sum(r.doc_id is None for r in rows) == 2
    assert alignment.align(df.limit(0), "text", A_FILE, B_FILE, public_tokenizers.PATTERN, ["doc_id"]).count() == 0
    assert alignment.align(df.selectExpr("doc_id", "cast(null AS string) AS text"), "text", A_FILE, B_FILE, public_tokenizers.PATTERN).where("n_a = 0 AND groups = ''").count() == 3


def test_slices_of_few_ids(monkeypatch, spark, pair):
    texts = [*ODD[:20], "word " * 300]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").coalesce(1)
    batch = alignment.encoded(df, "text", A_FILE, B_FILE, public_tokenizers.PATTERN).toArrow().combine_chunks().to_batches()[0]
    monkeypatch.setattr(alignment, "SLICE_TOKENS", 10)
    parts = list(alignment.slices(batch, alignment.lengths(pair.a_bytes), alignment.lengths(pair.b_bytes)))
    written = alignment.written_ids(60_000)
    assert len(parts) > 5
    assert [t for _, _, found in parts for t in found.spelled(written).to_pylist()] == [r[-1] for r in by_hand(texts, pair)]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab1.\n\t  \u00a0\u3000é's,日\U0001f600\x1c▁")))
def test_byte_vocabulary_is_read_right(text):
    ids = _PAIR.left.encode(text)
    assert ids == _PAIR.a.encode(text, add_special_tokens=False).ids
    assert b"".join(_PAIR.left.tokens[i] for i in ids) == text.encode()


_PAIR = Both()
