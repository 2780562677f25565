"""Near copies, repeated bytes, repeated lines and near vectors against brute force."""

import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sparkprofile.llm import chosen_path, common, epsilon_grid, suffix, winnowing


def roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(5)
    n = 200
    order = rng.sample(range(n), n)
    pairs = {
        "path": list(zip(order[:-1], order[1:], strict=True)), "star": [(7, i) for i in range(n) if i != 7],
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(130)],
    }[shape]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {i: c for i, c in enumerate(roots(n, pairs)) if any(i in p and p[0] != p[1] for p in pairs)}
    assert common.components(spark.createDataFrame([(1, 1)], "a bigint, b bigint")).count() == 0


def test_grouped():
    table = pa.table({"k": [1, 1, 2, 2, 2, 3], "v": range(6)})
    out = [(k, t["v"].to_pylist()) for k, t in common.grouped(table.to_batches(max_chunksize=2), ["k"])]
    assert out == [((1,), [0, 1]), ((2,), [2, 3, 4]), ((3,), [5])]


# --- word shingles ------------------------------------------------------------------------------


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_by_hand(docs):
    sets = {i: shingles(t) for i, t in docs}
    classes = {}
    for i in sorted(sets, key=lambda i: -1 if i is None else i):
        if sets[i]:
            classes.setdefault(sets[i], i)
    names = list(classes)
    pairs = [(a, b) for a in range(len(names)) for b in range(a) if 5 * len(names[a] & names[b]) >= 4 * len(names[a] | names[b])]
    links = {a: sum(a in p for p in pairs) for a in range(len(names))}
    group = {}
    for i, r in enumerate(roots(len(names), pairs)):
        group[i] = r
    at = {s: i for i, s in enumerate(names)}
    return {i: (classes[s], links[at[s]], classes[names[group[at[s]]]]) if s else (i, 0, i) for i, s in sets.items()}


def corpus(seed, n=120, near=30, length=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, length))) for _ in range(n)]
    base = rng.choices(words, k=length)
    for i in range(near):
        own = list(base)
        for _ in range(i % 4):
            own[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    texts += [texts[0], texts[0].upper(), "", "  ", "one two three", "one  TWO three\n"]
    return texts


@pytest.mark.parametrize("seed,bucket", [(1, 64), (2, 4)])
def test_near_duplicates(spark, monkeypatch, seed, bucket):
    monkeypatch.setattr(chosen_path, "BLOCK_ROWS", 16)
    monkeypatch.setattr(chosen_path.candidate_edges, "__defaults__", (0.8, chosen_path.RECALL, bucket))
    docs = [*enumerate(corpus(seed)), (500, None), (None, "one two three"), (3, corpus(seed)[3])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, class_id string")
    out = chosen_path.near_duplicates(df).collect()
    want = near_by_hand(docs)
    least = {r.doc_id: r for r in out}
    assert len(out) == len(docs)
    fix = lambda i: chosen_path._LEAST if i is None else i
    for i, (c, n, g) in want.items():
        r = least[i]
        assert (r.class_id, r.n_links, r.group_id, r.kept) == (fix(c), n, fix(g), fix(i) == fix(g)), i


def test_near_copies_among_texts_of_one_id(spark):
    rng = random.Random(4)
    a, b, c, d = (" ".join(rng.choices([f"w{i}" for i in range(500)], k=60)) for _ in range(4))
    rows = [(None, a), (None, b), (None, b), (None, c), (7, d), (7, f"{a} x"), (8, f"{b} y"), (9, f"{c} z"), (10, d.upper()), (11, f"{d} v"), (None, None)]
    out = chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), prints="p").collect()
    assert len(out) == len(rows)
    null, seen = chosen_path._LEAST, {}
    for r in out:
        seen.setdefault((r.doc_id, r.n_links, r.group_id), []).append(r.kept)
    assert seen == {
        (None, 1, null): [True] * 4, (None, 0, null): [True], (7, 1, null): [False], (8, 1, null): [False], (9, 1, null): [False],
        (7, 1, 7): [True], (10, 1, 7): [False], (11, 1, 7): [False]}
    assert len({r.p for r in out if r.doc_id is None}) == 4
    two = spark.createDataFrame([(None, a), (None, f"{a} x"), (3, f"{a} y"), (3, b)], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.n_links, r.kept) for r in chosen_path.near_duplicates(two).collect()) in (
        [(0, 2, False), (0, 2, True), (3, 0, True), (3, 2, False)],)


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert chosen_path.near_duplicates(df).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.group_id, r.kept) for r in chosen_path.near_duplicates(blank).collect()) == [(1, 1, True), (2, 2, True)]


def test_pairs_in_deep_buckets(spark):
    """Sets that share a third of their places with all others: their buckets are split down to the fifth level and deeper."""
    rng = np.random.default_rng(11)
    n = 5_000
    first = rng.integers(0, 3, (n // 2, chosen_path.SKETCH))
    second = first.copy()
    for row in second:
        at = rng.permutation(chosen_path.SKETCH)[:25]  # 103 of 128 agree
        row[at] += 3
    sketches = np.concatenate([first, second]).astype("<u4")
    rows = [(i, bytearray(x.tobytes()), x[: chosen_path.PROBES].tolist()) for i, x in enumerate(sketches)]
    reps = spark.createDataFrame(rows, "id bigint, sketch binary, probe array<bigint>").repartition(8)
    root = roots(n, [(r.a, r.b) for r in chosen_path.candidate_edges(reps, bucket=32).collect()])
    assert len(set(root)) > n // 4
    assert sum(root[i] != root[i + n // 2] for i in range(n // 2)) == 0


def test_sets_that_share_a_common_passage_are_not_split(spark, monkeypatch):
    """A third of the places is common to all: the other picks find the pairs, so that few rows are split and none is lost."""
    rng = np.random.default_rng(12)
    n = 2_000
    first = rng.integers(1_000, 1 << 32, (n, chosen_path.SKETCH))
    for row in first:
        row[rng.permutation(chosen_path.SKETCH)[:43]] = 7
    second = first.copy()
    for row in second[: n // 2]:
        row[rng.choice(np.flatnonzero(row != 7), 25, replace=False)] += 1  # what differs is never in the passage
    rows = [(i, bytearray(x.tobytes()), x[: chosen_path.PROBES].tolist()) for i, x in enumerate(np.concatenate([first, second[: n // 2]]).astype("<u4"))]
    reps = spark.createDataFrame(rows, "id bigint, sketch binary, probe array<bigint>").repartition(8)
    split, wrapped = spark.sparkContext.accumulator(0), chosen_path.choose

    def counted(nodes, sketches, similarity):
        row, child = wrapped(nodes, sketches, similarity)
        if len(np.unique(nodes)) > 1:
            split.add(len(row))
        return row, child

    monkeypatch.setattr(chosen_path, "choose", counted)
    root = roots(n + n // 2, [(r.a, r.b) for r in chosen_path.candidate_edges(reps, bucket=64).collect()])
    assert sum(root[i] != root[i + n] for i in range(n // 2)) == 0
    assert split.value < 80 * n


def test_picks_that_settle_a_set():
    rng = np.random.default_rng(5)
    needed = [chosen_path.picks_to_settle(r, chosen_path.RECALL) for r in (19, 30, 106)]
    assert needed == sorted(needed)
    differ = rng.binomial(chosen_path.SKETCH, 0.2, 2_000_000)
    for runs, k in zip((19, 30, 106), needed, strict=True):
        assert (rng.binomial(runs * differ, 1 / (0.8 * chosen_path.SKETCH)) >= k).sum() <= 5
        assert k < 1.1 * runs * chosen_path.SKETCH / (0.8 * chosen_path.SKETCH)


def test_runs_hold_the_recall_at_their_depth():
    runs = chosen_path.step_runs(chosen_path.RECALL)
    assert runs[0] == 19 and len(runs) == chosen_path.MAX_STEPS and runs == sorted(runs)
    rng = np.random.default_rng(3)
    agree = rng.binomial(chosen_path.SKETCH, 0.8, 20_000)
    for step, target in ((2, 30), (5, 107)):
        assert abs(runs[step - 1] - target) <= 3
        alive = np.ones(len(agree))
        for _ in range(2 * step - 1):
            alive = 1 - (1 - alive / (0.8 * chosen_path.SKETCH)) ** agree
        assert ((1 - alive) ** runs[step - 1]).mean() < 1e-5


def test_set_similarity_by_blocks():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(40)]
    alike = lambda a, b: len(np.intersect1d(a, b)) >= 0.5 * len(np.union1d(a, b))
    whole = {tuple(p) for p in chosen_path._similar(sets, 0, True, 0.5).tolist()}
    assert whole == {(a, b) for a in range(40) for b in range(a + 1, 40) if alike(sets[a], sets[b])}
    across = {tuple(p) for p in chosen_path._similar(sets, 15, False, 0.5).tolist()}
    assert across == {(a, b) for a, b in whole if a < 15 <= b}


# --- bytes --------------------------------------------------------------------------------------


def repeats_by_hand(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def patched(seed, length):
    """Texts that share passages of about the threshold, at their ends, inside, and overlapping themselves."""
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [make(length + d) for d in (-3, -1, 0, 1, 2, 7, 60, 3 * length)]
    texts = []
    for _ in range(40):
        parts = [make(rng.randint(0, 2 * length))]
        for p in rng.sample(passages, rng.randint(0, 3)):
            a = rng.randint(0, 3) if rng.random() < 0.5 else 0
            parts += [p[a:], make(rng.randint(0, length))]
        texts.append("".join(parts))
    long = make(4 * length)
    texts += [long, long[: 3 * length] + "#" + long[3 * length :], "ab" * length, "a" * (3 * length), texts[0], texts[0], make(length - 1), "", None]
    return texts


@pytest.mark.parametrize("seed,segment", [(1, 1 << 20), (2, 150)])
def test_repeated_bytes(spark, monkeypatch, seed, segment):
    monkeypatch.setattr(suffix, "SEGMENT", segment)
    texts = patched(seed, 80)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, kept string")
    rows = {r.doc_id: r for r in suffix.remove_repeats(df, length=80).collect()}
    for i, want in enumerate(repeats_by_hand(texts, 80)):
        r = rows[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, i
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed and len(r.kept) == r.n_bytes - r.n_removed
    assert len(rows) == len(texts)


def test_repeats_with_a_wide_window_and_long_runs_only(spark):
    texts = patched(3, 80)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in suffix.remove_repeats(df, length=80, window=70).collect()}
    for i, want in enumerate(repeats_by_hand(texts, 80)):
        assert (rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) == want, i
    runs = {r.doc_id: r for r in suffix.remove_repeats(df, length=80, run_words=12, run_bytes=160).collect()}
    for i, r in rows.items():
        raw = (texts[i] or "").encode()
        kept = [s for s in r.spans if s.stop - s.start >= 160 or suffix.whole_words(raw, s.start, s.stop) >= 12]
        assert runs[i].spans == kept and runs[i].n_removed == sum(s.stop - s.start for s in kept), i
    assert sum(r.n_spans for r in runs.values()) < sum(r.n_spans for r in rows.values())
    assert [suffix.whole_words(b"ab cd ef", a, b) for a, b in ((0, 8), (1, 8), (2, 7), (3, 5), (4, 5), (0, 0))] == [3, 2, 1, 1, 0, 0]


def test_repeats_of_null_ids_and_empty_tables(spark):
    text = "".join(random.Random(1).choices("abcdef", k=500))
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, "short")], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in suffix.remove_repeats(df).collect()) == [(0, 500), (1, 500), (1, 500), (2, 0)]
    assert suffix.remove_repeats(df.limit(0)).count() == 0


def test_repeats_among_texts_of_one_id(spark):
    rng = random.Random(6)
    passage, own = "".join(rng.choices("abcdef", k=450)), ["".join(rng.choices("ghijkl", k=500)) for _ in range(6)]
    ids = [None, None, None, 1, 1, 2]
    texts = [own[0], own[1] + passage, own[2], own[3], own[4] + passage, own[5]]
    df = spark.createDataFrame(list(zip(ids, texts, texts, strict=True)), "doc_id bigint, text string, original string")
    got = {r.original: (r.n_bytes, r.n_removed, r.kept_text) for r in suffix.remove_repeats(df).collect()}
    assert got == {t: (len(t), 450 if passage in t else 0, t.replace(passage, "")) for t in texts}


def test_hashes_of_slices():
    h = suffix.Hasher()
    data = np.frombuffer(b"abcabcab" * 50, np.uint8)
    s = h.sums(data, 0)
    at = np.array([0, 3, 8, 1])
    a, b, c, d = h.slices(s, 0, at, at + 5).tolist()
    assert a == b == c != d or (a != b and a == c)


# --- lines --------------------------------------------------------------------------------------


def line_texts(seed):
    rng = random.Random(seed)
    lines = [f"line {i}" for i in range(12)] + ["", " "]
    texts = ["\n".join(rng.choices(lines, k=rng.randint(1, 30))) for _ in range(60)]
    return [*texts, texts[0], texts[1] + "\n" + texts[2], "", None, "\n", "\n\n\n\n", "a\n" * 300, "line 1", "line 1"]


@pytest.mark.parametrize("window", [1, 2, 3, 5])
def test_lines_match_sql(spark, window):
    texts = line_texts(window)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, first string")
    out = {r.doc_id: r for r in winnowing.line_dedup(df, window=window).collect()}
    con = duckdb.connect()
    documents = df.toPandas()  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT * FROM documents")
    for doc, n, removed, runs, kept in con.execute(winnowing.oracle(window)).fetchall():
        r = out[doc]
        assert sum(x.past - x["first"] for x in r.removed_runs) == removed and len(r.removed_runs) == runs
        assert hashlib.md5((r.text or "").encode()).hexdigest() == kept, doc
    assert out[len(line_texts(window)) - 6].text is None and len(out) == len(texts)


def test_lines_edge_cases(spark):
    rows = [(1, "a\nb\nc\nd"), (1, "a\nb\nc\nd"), (None, "b\nc\nd\ne"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = sorted(((r.doc_id, r.text) for r in winnowing.line_dedup(df).collect()), key=repr)
    assert out == sorted([(1, "a"), (1, "a"), (None, "b\nc\nd\ne"), (2, None)], key=repr)
    assert winnowing.line_dedup(df.limit(0)).count() == 0


def long_runs_by_hand(rows, words, window=3):
    """What is left: runs by window, shorter ones by words, whole texts of fewer lines by themselves."""
    seen, out = set(), {}
    for i, text in sorted(rows.items()):
        lines = text.split("\n")
        gone, new = set(), [("whole", text)] if len(lines) < window and text.split() else []
        if new and new[0] in seen:
            gone.update(range(len(lines)))
        for width in range(1, window + 1):
            for at in range(len(lines) - width + 1):
                key = tuple(lines[at : at + width])
                if width == window or sum(len(x.split()) for x in key) >= words:
                    if key in seen:
                        gone.update(range(at, at + width))
                    seen.add(key)
        seen.update(new)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_long_runs_of_few_lines(spark):
    rng = random.Random(8)
    lines = [" ".join(rng.choices("abcdefgh", k=k)) for k in (1, 2, 3, 5, 6, 9, 10, 11, 12, 25)] + ["", "  "]
    texts = ["\n".join(rng.choices(lines, k=rng.choice((1, 1, 2, 2, 3, 5, 9)))) for _ in range(80)]
    passage, pair = " ".join(f"p{i}" for i in range(60)), " ".join(f"q{i}" for i in range(25)) + "\n" + " ".join(f"r{i}" for i in range(25))
    rows = dict(enumerate([*texts, "", "", " \n", " \n", f"x\n{pair}\ny", f"z\n{passage}", f"{passage}\nw", f"v\n{pair}"]))
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    for words in (10, winnowing.LONG_WORDS):
        out = {r.doc_id: r.text for r in winnowing.line_dedup(df, long_words=words).collect()}
        assert out == long_runs_by_hand(rows, words)
        assert [out[i] for i in (86, 87)] == ["w", "v"]


# --- vectors ------------------------------------------------------------------------------------


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 8))
    vectors = [list(map(float, base[i % 12] + rng.normal(size=8) * rng.choice([0, 0.02, 0.05, 0.3]))) for i in range(400)]
    labels = [int(rng.integers(0, 3)) for _ in range(400)]
    vectors += [None, [0.0] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0], list(vectors[0]), list(vectors[0]), list(vectors[0])]
    labels += [0] * 6 + [labels[0], labels[0], None]
    n = len(vectors)
    df = spark.createDataFrame([(i, v, k, "x") for i, (v, k) in enumerate(zip(vectors, labels, strict=True))], "vec_id bigint, embedding array<double>, label int, id string")
    out = {r.vec_id: r for r in epsilon_grid.near_duplicates(df, "vec_id", "embedding", "label", block=16).collect()}
    good = [v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v) and k is not None for v, k in zip(vectors, labels, strict=True)]
    unit = [np.array(v) / np.linalg.norm(v) if g else None for v, g in zip(vectors, good, strict=True)]
    pairs = [(a, b) for a in range(n) for b in range(a) if good[a] and good[b] and labels[a] == labels[b] and unit[a] @ unit[b] >= 0.98]
    links = np.bincount(np.array(pairs).ravel(), minlength=n)
    group = roots(n, pairs)
    assert len(out) == n and len(pairs) > 300
    for i in range(n):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (links[i], group[i], group[i] == i), i


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None, 1), (2, [], 1)], "vec_id bigint, embedding array<float>, label int")
    assert sorted((r.vec_id, r.n_links, r.kept) for r in epsilon_grid.near_duplicates(df, "vec_id", "embedding", "label").collect()) == [(1, 0, True), (2, 0, True)]
    assert epsilon_grid.near_duplicates(df.limit(0), "vec_id", "embedding", "label").count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0], None)], "vec_id bigint, embedding array<float>, label int")
    assert epsilon_grid.near_duplicates(one, "vec_id", "embedding", "label").first().n_links == 0
