"""Repeated and null ids, and batches that are committed again."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkprofile.llm import epsilon_grid, mih, rollup
from sparkprofile.llm.queries import QUERIES

VECTORS = "vec_id bigint, embedding array<double>, label int"


def linked_by_hand(rows):
    """``[(vec_id, n_links, component_id, kept)]`` of every row, pair by pair."""
    usable = [v if v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) else None for _, v, label in rows]
    n = len(rows)
    near = [[False] * n for _ in range(n)]
    for i in range(n):
        for j in range(n):
            a, b = usable[i], usable[j]
            if i != j and a is not None and b is not None and len(a) == len(b) and rows[i][2] == rows[j][2]:
                x, y = np.array(a) / np.linalg.norm(a), np.array(b) / np.linalg.norm(b)
                near[i][j] = x @ y >= 0.98
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]).tolist():
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], sum(near[i]), least, rows[i][0] == least))
    return sorted(out, key=repr)


@pytest.mark.parametrize("ids", [
    [1, 1, 2, 3], [1, 1, 3, 4], [None, None, 2, 3], [None, 5, None, 5], [7, 7, 7, 7], [None] * 4,
])
def test_near_vectors_by_row(spark, ids):
    a, near, b, c = [1.0, 0.0, 0.1], [1.0, 0.01, 0.1], [0.0, 1.0, 0.0], [0.0, 2.0, 0.0]
    rows = [(i, v, 0) for i, v in zip(ids, (a, near, b, c), strict=True)]
    rows += [(ids[0], b, 0), (ids[1], a, 1), (ids[2], None, 0), (ids[3], [float("nan"), 1.0, 1.0], 0), (9, [0.0, 0.0, 0.0], 0), (9, a, None)]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS id", "2 AS component", "3 AS least").repartition(3)
    found = epsilon_grid.near_duplicates(df, "vec_id", "embedding", "label").collect()
    assert sorted((tuple(r) for r in found), key=repr) == linked_by_hand(rows)


@pytest.mark.parametrize("width", [1, 2, 65, 200])
def test_near_vectors_of_any_width(spark, width):
    rng = np.random.default_rng(width)
    rows = [(i % 11 or None, (rng.integers(0, 2, width) - 0.5 + 0.02 * rng.normal(size=width)).tolist(), i % 2) for i in range(40)]
    rows += [(100 + i, rows[i][1], rows[i][2]) for i in range(10)]
    found = epsilon_grid.near_duplicates(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding", "label").collect()
    assert sorted((tuple(r) for r in found), key=repr) == linked_by_hand(rows)


def test_code_search_with_repeated_ids(spark):
    rows = [(1, 0b1), (1, 0b1), (2, 0b11), (2, 0b1111), (3, 0b111), (None, 0b1), (4, None)]
    df = spark.createDataFrame(rows, "id bigint, code bigint")
    found = mih.top_k(df, df.where("id = 2"), 2).collect()
    assert sorted(((r.query_id, r.rank, r.neighbor_id, r.distance) for r in found), key=repr) == [(2, 1, 3, 1), (2, 1, None, 1), (2, 2, 1, 1), (2, 2, 2, 2)]


def changes(spark, n):
    return rollup.signed_changes(None, spark.createDataFrame([(1, "s", "l", "t", n)], rollup.STATE))


def totals(ledger):
    return [(r.documents, r.tokens) for r in ledger.totals().collect()]


def test_compacted_ledger_keeps_its_ids(spark):
    ledger = rollup.TokenLedger(spark)
    assert ledger.commit("import", changes(spark, 10)) and ledger.commit("more", changes(spark, 5))
    compact = ledger.compact("all")
    assert compact.batches() == ["all", "import", "more"] and totals(compact) == [(2, 15)]
    assert not compact.commit("import", changes(spark, 10)) and not compact.commit("all", changes(spark, 1))
    assert totals(compact) == [(2, 15)]
    again = compact.compact("all2")
    assert again.batches() == ["all", "all2", "import", "more"] and not again.commit("more", changes(spark, 5)) and totals(again) == [(2, 15)]
    with pytest.raises(ValueError):
        again.compact("import")


def test_two_writers_of_one_batch(spark):
    folder = rollup.TokenLedger(spark).folder
    ledgers = [rollup.TokenLedger(spark, folder) for _ in range(4)]
    won = []
    waiting = threading.Barrier(4)

    def write(ledger):
        own = changes(spark, 7)
        waiting.wait()
        won.append(ledger.commit("same", own))

    threads = [threading.Thread(target=write, args=(x,)) for x in ledgers]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(won) == [False, False, False, True] and totals(ledgers[0]) == [(1, 7)]


def test_rollup_query(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.001"
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder.encode_special_tokens = True
    toxic = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 1").collect()}
    expected = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        if r.doc_id not in toxic:
            key = (r.source, r.lang, "byte_bpe_50k/1")
            n, tokens = expected.get(key, (0, 0))
            expected[key] = (n + 1, tokens + len(encoder.encode(r.text or "", add_special_tokens=False).ids))
    found = QUERIES["op2_token_rollup"](spark, folder)
    assert {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in found.collect()} == expected
    assert found.agg(F.sum("documents")).first()[0] == sum(n for n, _ in expected.values())
