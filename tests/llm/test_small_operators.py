"""Sharding, token rollups, language mixtures, code search and Viterbi encoding against plain Python."""

import base64
import math
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from sparkprofile.llm import langid, maglev, mih, rollup, viterbi

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# --- sharding -----------------------------------------------------------------------------------


def by_hand(names, slots):
    from sparkprofile.llm.common import hash64

    order = {n: iter([(hash64(n.encode(), 1) + j * (hash64(n.encode(), 2) % (slots - 1) + 1)) % slots for j in range(slots)]) for n in names}
    table = {}
    while len(table) < slots:
        for n in sorted(names):
            at = next((s for s in order[n] if s not in table), None)
            if at is not None:
                table[at] = n
    return [sorted(names).index(table[i]) for i in range(slots)]


def test_table_is_filled_in_turns():
    names = [f"s{i}" for i in range(7)]
    table = maglev.fill_table(names, 251)
    assert table.tolist() == by_hand(names, 251)
    sizes = Counter(table.tolist())
    assert max(sizes.values()) - min(sizes.values()) <= 1
    weighted = Counter(maglev.fill_table({"a": 1, "b": 3}, 101).tolist())
    assert abs(weighted[1] / weighted[0] - 3) < 0.3
    assert maglev.moved_slots(names, names[:-1], 251) < 0.4
    for bad in ([], names):
        with pytest.raises(ValueError):
            maglev.fill_table(bad, 250)


def test_place(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (5, None)], "doc_id bigint, shard string")
    rows = maglev.place(df, "doc_id", ["a", "b", "c"], 101).collect()
    table = maglev.fill_table(["a", "b", "c"], 101)
    assert len(rows) == 4 and all("abc"[table[r.slot]] == r.shard for r in rows)
    assert len({r.slot for r in rows if r.doc_id == 1}) == 1
    assert maglev.place(df.limit(0), "doc_id", ["a"], 101).count() == 0
    many = maglev.place(spark.range(20_000).withColumnRenamed("id", "doc_id"), "doc_id", [f"s{i}" for i in range(10)]).groupBy("shard").count()
    counts = [r["count"] for r in many.collect()]
    assert len(counts) == 10 and max(counts) < 1.2 * min(counts)


def test_shard_files(spark, tmp_path):
    placed = maglev.place(spark.range(100).withColumnRenamed("id", "doc_id"), "doc_id", ["a", "b"], 101)
    maglev.write_shards(placed, str(tmp_path / "out"), 2)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 2


# --- token counts -------------------------------------------------------------------------------


def state(spark, rows):
    return spark.createDataFrame(rows, rollup.STATE)


def test_rollup_follows_the_state(spark):
    one = [(1, "a", "en", "t/1", 10), (2, "a", None, "t/1", 5), (3, None, "en", "t/1", None), (4, "b", "en", "t/1", 0)]
    two = [(1, "a", "en", "t/2", 12), (2, "a", None, "t/1", 5), (4, "b", "de", "t/1", 7), (5, "b", "de", "t/1", 1)]
    ledger = rollup.TokenLedger(spark)
    assert ledger.totals().count() == 0
    assert ledger.commit("1", rollup.signed_changes(None, state(spark, one)))
    assert ledger.commit("2", rollup.signed_changes(state(spark, one), state(spark, two)))
    assert not ledger.commit("1", rollup.signed_changes(None, state(spark, one)))
    want = Counter()
    tokens = Counter()
    for _, *key, n in two:
        want[tuple(key)] += 1
        tokens[tuple(key)] += n or 0
    got = {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in ledger.totals().collect()}
    assert got == {k: (want[k], tokens[k]) for k in want}
    assert ledger.batches() == ["1", "2"]
    compact = ledger.compact("0")
    assert sorted(map(tuple, compact.totals().collect()), key=repr) == sorted(map(tuple, ledger.totals().collect()), key=repr)
    ledger.commit("3", rollup.signed_changes(state(spark, two), None))
    assert ledger.totals().count() == 0
    with pytest.raises(ValueError):
        ledger.commit("a/b", ledger.totals())


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["hello world", "", None, "naïve 🙂 " * 500, "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("tokens", F.lit("x"))
    got = {r.doc_id: r.tokens for r in rollup.count_tokens(df.drop("tokens"), "doc_id", "text", path, public_tokenizers.PATTERN).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert rollup.count_tokens(df.limit(0), "doc_id", "text", path, public_tokenizers.PATTERN).count() == 0


# --- language -----------------------------------------------------------------------------------


EN = "the cat sat on the mat and then the dog went with them to the other house where they were both"
DE = "der hund und die katze gingen nicht nach hause weil es auf der strasse noch sehr schön warm war"


def test_mixture_of_two_languages(spark):
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de", "s", 1) for i in range(40)] + [(90, None, "en", "s", 1), (91, EN, None, "s", 1)]
    model = langid.fit(spark.createDataFrame(rows, DOCS), "text", "lang")
    assert model.languages == ["de", "en"]
    docs = spark.createDataFrame(
        [(1, EN, None, "s", 1), (2, DE, None, "s", 1), (3, None, "en", "s", 1), (4, "", "en", "s", 1), (5, "12 ?! 4", "en", "s", 1),
         (6, f"{EN} {DE} " * 40, None, "s", 1), (7, EN * 3_000, None, None, None), (1, EN, None, "s", 1)], DOCS,
    ).withColumn("score", F.lit("old"))
    out = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3, 4, 5, 7)] == ["en", "de", "und", "und", "und", "en"]
    assert out[1].score > 0.99 and out[3].score == 0.0 and out[3].languages == []
    shares = {p.lang: p.share for p in out[6].languages}
    assert abs(shares["en"] - len(EN) / (len(EN) + len(DE))) < 0.1 and abs(sum(shares.values()) - 1) < 1e-3
    assert langid.identify(docs, model).count() == 8 and langid.identify(docs.limit(0), model).count() == 0


def test_copies_do_not_move_the_bound(spark):
    """A language of few texts copied often keeps all of them, whatever their hashes; one of many copies of one text is in bounds."""
    few = [f"{DE} {w}" for w in ("eins", "zwei", "drei")]
    rows = [(f"{EN} {i}", "en") for i in range(30)] + [(t, "de") for t in few for _ in range(1_000)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", per_language=5)
    counts = np.zeros(langid.BUCKETS)
    for t in few:
        np.add.at(counts, langid.trigrams(t), 1_000)
    p = (counts + 0.5) / (counts.sum() + 0.5 * langid.BUCKETS)
    other = langid.fit(spark.createDataFrame([r for r in rows if r[1] == "en"], "text string, lang string"), "text", "lang", per_language=5)
    assert model.languages == ["de", "en"] and len(other.languages) == 1
    own = np.flatnonzero(counts)
    rest = np.setdiff1d(np.arange(langid.BUCKETS), np.concatenate([own, *(langid.trigrams(f"{EN} {i}") for i in range(30))]))[0]
    en_rest = model.ratio[rest, 0] / model.ratio[rest, 1]
    only = np.setdiff1d(own, np.concatenate([langid.trigrams(f"{EN} {i}") for i in range(30)]))
    got = model.ratio[only, 0] / model.ratio[only, 1] / en_rest
    assert np.allclose(got, p[only] / p[rest], rtol=1e-3)
    assert model.predict(DE)[0] == "de" and model.predict(EN)[0] == "en"


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([(1, None, "en", "s", 1)], DOCS)
    model = langid.fit(empty, "text", "lang")
    assert model.predict("hello") == ("und", 0.0, [])


def test_expectation_maximisation_climbs():
    rng = np.random.default_rng(1)
    ratio = rng.random((400, 3)).astype(np.float32) + 0.01
    levels = [np.log(ratio @ langid.expect(ratio, np.full(3, 1 / 3, np.float32), n)).sum() for n in (0, 1, 5, 30)]
    assert all(b >= a - 1e-3 for a, b in zip(levels[:-1], levels[1:], strict=True))
    grid = [np.array([a, b, 1 - a - b]) for a in np.linspace(0, 1, 41) for b in np.linspace(0, 1 - a, 41)]
    assert levels[-1] >= max(np.log(ratio @ g).sum() for g in grid) - 0.05


def test_held_out_accuracy(spark):
    from sparkprofile.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    out = QUERIES["op3_language_mixture"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97


# --- codes --------------------------------------------------------------------------------------


def nearest(codes, query, k):
    own = codes[query]
    return sorted(((own ^ c) & (2**64 - 1)).bit_count() * 10**9 + i for i, c in codes.items() if i != query and c is not None)[:k]


@pytest.mark.parametrize("kind", ["random", "copies", "clusters"])
def test_top_k_is_exact(spark, kind):
    rng = np.random.default_rng(3)
    n = 300
    if kind == "random":
        raw = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, n)]
    elif kind == "copies":
        raw = [int(x) for x in rng.integers(0, 3, n)]
    else:
        base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 5)]
        raw = [base[i % 5] ^ (1 << int(rng.integers(0, 60))) for i in range(n)]
    codes = dict(enumerate(raw))
    codes[n] = None
    df = spark.createDataFrame(list(codes.items()), "id bigint, code bigint")
    got = {}
    for r in mih.top_k(df, df.where("id % 30 = 0"), 7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance * 10**9 + r.neighbor_id))
    assert {q: [v for _, v in sorted(x)] for q, x in got.items()} == {q: nearest(codes, q, 7) for q in range(0, n, 30)}


def test_few_codes_and_none(spark):
    df = spark.createDataFrame([(1, 5), (2, -1), (3, None)], "id bigint, code bigint")
    assert sorted((r.query_id, r.neighbor_id, r.distance) for r in mih.top_k(df, df, 10).collect()) == [(1, 2, 62), (2, 1, 62)]
    assert mih.top_k(df.limit(0), df, 3).count() == 0 and mih.top_k(df, df.limit(0), 3).count() == 0


def test_sign_codes(spark):
    rows = [(1, [1.0, -1.0, None, float("nan")]), (2, None), (3, [])]
    out = {r.id: r.code for r in mih.sign_codes(spark.createDataFrame(rows, "v bigint, e array<float>"), "v", "e").collect()}
    assert out == {1: -(2**63), 2: None, 3: 0}


def test_sign_codes_do_not_cut_vectors(spark):
    whole = spark.createDataFrame([(1, [-1.0] * 63 + [1.0])], "v bigint, e array<float>")
    assert mih.sign_codes(whole, "v", "e").first().code == 1
    with pytest.raises(Exception, match="65 components"):
        mih.sign_codes(spark.createDataFrame([(1, [1.0] * 65)], "v bigint, e array<float>"), "v", "e").collect()


# --- pieces -------------------------------------------------------------------------------------


class Toy(viterbi.Pieces):
    def __init__(self, scores):
        self.scores = scores
        self.ids = {n: i for i, n in enumerate(scores)}
        self.names = list(scores)
        self.bytes, self.byte_of, self.unknown = {}, {}, 99
        self.missing = min(scores.values()) - 10
        self.endings = {n[i:]: None for n in self.ids for i in range(len(n))} | scores


def best_score(word, p):
    best = -math.inf
    for cuts in product([0, 1], repeat=len(word) - 1):
        parts, at = [], 0
        for i, c in enumerate((*cuts, 1), 1):
            if c:
                parts.append(word[at:i])
                at = i
        s = sum(p.scores[x] if x in p.scores else p.missing if len(x) == 1 else -math.inf for x in parts)
        best = max(best, s)
    return best


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(0)
    p = Toy({**{c: -5.0 - i for i, c in enumerate("abc▁")}, "ab": -3.0, "▁a": -4.0, "abc": -9.5, "ca": -2.0, "bca": -6.0, "▁abc": -12.0})
    words = ["▁" + "".join(rng.choice(list("abcx"), rng.integers(1, 9))) for _ in range(120)]
    out = viterbi.encode_words(words, p)
    for w in words:
        score = sum(p.missing if i == 99 else p.scores[p.names[i]] for i in out[w])
        assert score == pytest.approx(best_score(w, p))
        one = viterbi.encode_words([w], p)[w]
        assert one == out[w]


def test_round_trip(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["hello world", " two  spaces ", "", None, "naïve\n\ttab 🙂 日本", "x" * 5_000, "a" + " " * 40 + "b", "end ", "hello world", "\x00\x01"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("n_ids", F.lit("old"))
    coded = viterbi.encode(df, "text", path)
    back = {r.doc_id: r for r in viterbi.decode(coded, "ids", path).collect()}
    assert [back[i].decoded for i in range(len(texts))] == [t or "" for t in texts]
    digest = {r.doc_id: r for r in viterbi.encode(df, "text", path, digest=True).collect()}
    import zlib

    for i in range(len(texts)):
        ids = back[i].ids
        assert (digest[i].n_ids, digest[i].ids_crc32, digest[i].round_trip) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
    assert viterbi.encode(df.limit(0), "text", path).count() == 0
    marked = spark.createDataFrame([(1, "a▁b")], "doc_id bigint, text string")
    assert viterbi.decode(viterbi.encode(marked, "text", path), "ids", path).first().decoded == "a b"
