"""The pipeline against brute force, stage by stage, and the registry."""

import random

import duckdb
import public_tokenizers
import pytest
from test_duplicates import near_by_hand, repeats_by_hand
from tokenizers import Tokenizer

import __spark_entry__ as registry
import corpus_pipeline
from sparkprofile.llm import winnowing
from sparkprofile.llm.queries import ORACLE, QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(300)]
    line = lambda: " ".join(rng.choices(words, k=rng.randint(5, 25)))
    shared = [line() for _ in range(5)]
    passage = " ".join(rng.choices(words, k=120))
    texts = []
    for i in range(50):
        body = [line() for _ in range(rng.randint(1, 6))]
        if i % 7 == 0:
            body[1:1] = shared[: rng.randint(2, 5)]
        if i % 9 == 0:
            body.append(line() + " " + passage + " " + line())
        texts.append("\n".join(body))
    near = texts[11].split(" ")
    near[3] = "changed"
    texts += [texts[10], " ".join(near), texts[12].upper(), "", None, "12 34 !", "a"]
    return [(i, t, "en" if i % 5 else None, "s", len(t or "")) for i, t in enumerate(texts)]


def lines_by_hand(rows, window=winnowing.WINDOW):
    seen, out = set(), {}
    for i, text in sorted(rows.items()):
        lines = text.split("\n")
        gone = set()
        for at in range(len(lines) - window + 1):
            key = tuple(lines[at : at + window])
            if key in seen:
                gone.update(range(at, at + window))
            seen.add(key)
        left = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if not gone or left.strip(" "):
            out[i] = left
    return out


def test_stages(spark, tmp_path):
    rows = documents(3)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    texts = {r[0]: r[1] for r in rows if r[1] and any(c.isalpha() for c in r[1])}
    want = [texts, lines_by_hand(texts)]
    near = near_by_hand(list(want[-1].items()))
    want.append({i: t for i, t in want[-1].items() if near[i][2] == i})
    assert len(want[2]) < len(want[1])
    order = sorted(want[-1])
    cut = {}
    for i, (_, removed, _, _) in zip(order, repeats_by_hand([want[-1][i] for i in order], 400), strict=True):
        cut[i] = removed
    assert sum(cut.values()) > 0
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path)).collect()
        assert out and out[0].__fields__ == corpus_pipeline.COLUMNS and all(r.n_chars == len(r.text) and r.lang for r in out)
        if k < 3:
            assert {r.doc_id: r.text for r in out} == want[k]
        else:
            assert {r.doc_id: len(r.text.encode()) for r in out} == {i: len(want[2][i].encode()) - n for i, n in cut.items() if n == 0 or len(want[2][i].encode()) > n}
        left = {r.doc_id: r.text for r in out}
        docs = spark.createDataFrame(out, SCHEMA)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {}
    for r in packed:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes == {i: len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}


def test_long_lines_and_short_copies_go(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"a\n{passage}"), (2, f"{passage}\nb"), (3, "short one"), (4, "short one"), (5, "short\none\nc"), (6, passage)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    out = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert out == {1: (rows[0][1], len(rows[0][1])), 2: ("b", 1), 3: ("short one", 9), 5: ("short\none\nc", 11)}


def test_texts_of_one_id_stay_apart(spark):
    rng = random.Random(2)
    a, b, c = (" ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(80)) for _ in range(3))
    rows = [(None, a), (None, b), (None, f"{a} x"), (5, c), (5, f"{b} y")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    near = corpus_pipeline.near_copies(spark, docs, "").collect()
    left = [(r.doc_id, r.text) for r in near]
    assert len(left) == 3 and (None, b) in left and (5, c) in left and ((None, a) in left) != ((None, f"{a} x") in left)
    assert sorted(r.text for r in corpus_pipeline.repeats(spark, spark.createDataFrame(near, SCHEMA), "").collect()) == sorted(t for _, t in left)


def test_repeated_passages_of_fifty_words_go(spark):
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    long, short, spaceless = text(51), text(49), "".join(rng.choices("klmnop", k=400))
    assert 250 < len(short) < len(long) < 400
    rows = []
    for i, passage in enumerate((long, long, short, short, spaceless, spaceless)):
        rows.append((i, text(30), passage, text(30)))
    docs = spark.createDataFrame([(i, f"{a} {p} {b}", "en", "s", 1) for i, a, p, b in rows], SCHEMA)
    out = {r.doc_id: r.text for r in corpus_pipeline.repeats(spark, docs, "").collect()}
    for i, a, p, b in rows:
        assert (p in out[i]) == (p == short), i
        if p == short:
            assert out[i] == f"{a} {p} {b}"
        else:
            assert a[:-6] in out[i] and b[6:] in out[i]


def test_wrong_labels_are_mended(spark):
    en, de = "the cat sat on the mat and the dog went with them to the house", "der hund und die katze gingen nicht nach hause weil es warm war"
    rows = [(i, f"{en if i % 2 else de} {i}", "en" if i % 2 else "de") for i in range(40)] + [(90, f"{de} {de}", "en"), (91, en, None), (92, "12 ?", "en")]
    docs = spark.createDataFrame([(i, t, k, "s", len(t)) for i, t, k in rows], SCHEMA)
    out = {r.doc_id: (r.text, r.lang) for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert out == {i: (t, {90: "de", 91: "en"}.get(i, k)) for i, t, k in rows if i != 92}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry():
    names = registry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    assert set(QUERIES) < set(names) and "op10_winnowing" in registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_match_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    out = QUERIES[name](spark, folder)
    found = con.execute(f"SELECT {', '.join(out.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(found)
