"""Near-duplicate texts by a chosen-path set similarity join (Christiani, Pagh and Sivertsen, 2018)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import U64, components, grouped, hash64, materialize, mix64, settled, tasks
from .epsilon_grid import forest

WORDS = 5
SIMILARITY = 0.8
SKETCH = 128
PROBES = 8
SALTS = 16
BUCKET = 256
MAX_STEPS = 5
RECALL = 0.99999
BLOCK_ROWS = 128
BLOCK_SHINGLES = 1 << 17
SLICE_ROWS = 500
_LEAST = -(1 << 63)
_FACTORS = mix64(np.arange(1, SKETCH + 1, dtype=U64)).astype(np.uint32) | np.uint32(1)
_SHIFTS = mix64(np.arange(1_001, SKETCH + 1_001, dtype=U64)).astype(np.uint32)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The set of hashed word shingles of each text, sorted.

    Words are lower-cased and stand between white space.  A text of fewer words has all of them as its one shingle; a null
    text or one without words has the empty set.
    """
    split = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(texts.fill_null(""))))
    flat = split.flatten().dictionary_encode()
    names = flat.dictionary.to_pylist()
    codes = np.array([hash64(w.encode("utf-8", "surrogatepass")) for w in names], U64)
    hashed = codes[flat.indices.to_numpy()] if len(flat) else np.zeros(0, U64)
    empty = np.array([w == "" for w in names], bool)[flat.indices.to_numpy()] if len(flat) else np.zeros(0, bool)
    ends = (split.offsets.to_numpy() - split.offsets[0].as_py()).tolist()
    factor = U64(0x9E3779B97F4A7C15)
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        own = hashed[a:b]
        if b - a <= 1 and (b == a or empty[a]):
            out.append(np.zeros(0, U64))
            continue
        width = min(words, len(own))
        mixed = np.zeros(len(own) - width + 1, U64)
        for i in range(width):
            mixed = mixed * factor + own[i : i + len(mixed)]
        out.append(np.unique(mix64(mixed)))
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The least of each of ``SKETCH`` hashes over the set; equal places agree with the probability of the Jaccard similarity."""
    least = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    low = (shingles >> U64(32)).astype(np.uint32)
    for at in range(0, len(low), 4_096):
        least = np.minimum(least, (low[at : at + 4_096, None] * _FACTORS ^ _SHIFTS).min(0))
    return least


def runs_for(recall: float, depth: int = 2, similarity: float = SIMILARITY) -> int:
    """Runs after which a pair just at the threshold has met at this depth with this probability.

    The sketches of such a pair agree in a binomial number of places, and at every level each of them is chosen with the same
    chance, so that one is on average; the chance to meet at a depth is that of the branching process to survive so long.
    """
    agree = np.arange(SKETCH + 1)
    chance = np.array([comb(SKETCH, k) * similarity**k * (1 - similarity) ** (SKETCH - k) for k in range(SKETCH + 1)])
    alive = np.ones(SKETCH + 1)
    for _ in range(depth):
        alive = 1 - (1 - alive / (similarity * SKETCH)) ** agree
    seen = agree >= _least(similarity) * SKETCH
    runs = 1
    while (chance * (1 - alive) ** runs)[seen].sum() > 1 - recall:
        runs += 1
    return runs


def _least(similarity: float) -> float:
    """Sketches that agree less are below the similarity but for five standard deviations."""
    return similarity - 5 * sqrt(similarity * (1 - similarity) / SKETCH)


def step_runs(recall: float, similarity: float = SIMILARITY) -> list[int]:
    """Runs that a set needs in all before each step; a step's buckets are up to ``2 * step - 1`` levels deep.

    A pair is missed only if it dies in all runs of the step after the last one that had both its sets in one large bucket; the first step
    has many more runs than its one level needs, and the others share what may be missed.
    """
    later = [runs_for(1 - (1 - recall) / MAX_STEPS, 2 * step - 1, similarity) for step in range(2, MAX_STEPS + 1)]
    return [runs_for(recall, 2, similarity), *later]


@cache
def picks_to_settle(runs: int, recall: float, similarity: float = SIMILARITY) -> int:
    """Picks in small buckets after so many runs that settle a set: whoever is similar to it has met it in one of them.

    A similar set stays unmet only if all these picks fell on places where the two sketches disagree.  However many of the other
    places are common ones, so many picks of disagreeing places have a chance that, for both sets of a pair and all steps, is what
    ``step_runs`` leaves of the share that may be missed.
    """
    miss = (1 - recall) / MAX_STEPS / (2 * MAX_STEPS)
    differ = np.arange(SKETCH + 1)
    weight = np.array([comb(SKETCH, k) * (1 - similarity) ** k * similarity ** (SKETCH - k) for k in range(SKETCH + 1)])
    weight[differ > (1 - _least(similarity)) * SKETCH] = 0
    tries, rate = runs * differ, 1 / (similarity * SKETCH)
    term = (1 - rate) ** tries
    below, picks = term.copy(), 1
    while (weight * (1 - below)).sum() > miss:
        term = term * np.maximum(tries - picks + 1, 0) / picks * rate / (1 - rate)
        below, picks = below + term, picks + 1
    return picks


def choose(nodes: np.ndarray, sketches: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """``(row, child)``: the tokens that each row's node picks from its sketch, on average one over the similarity."""
    tokens = mix64(sketches.astype(U64) * U64(SKETCH) + np.arange(SKETCH, dtype=U64))
    drawn = mix64(tokens ^ nodes[:, None])
    row, at = np.nonzero(drawn < U64(int(2**64 / (similarity * SKETCH))))
    return row, mix64(drawn[row, at] ^ U64(0x5851F42D4C957F2D))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _sketch_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, SKETCH)


def _documents(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """``(id, print, text)``; ``print`` is a hash of the text, as several texts may have one id."""
    body = F.col(f"`{text}`")
    return df.select(F.coalesce(F.col(f"`{id_column}`").cast("bigint"), F.lit(_LEAST)).alias("id"), text_print(body).alias("print"), body.alias("text"))


def text_print(body: Column) -> Column:
    """The hash that tells texts of one id apart."""
    return F.xxhash64(F.coalesce(body, F.lit("")))


def signatures(df: DataFrame, id_column: str, text: str, words: int = WORDS) -> DataFrame:
    """``(id, print, d1, d2, n, sketch, probe)``: a 128-bit digest of each set, its size, its sketch and a few places of it."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                sets = shingle_sets(part.column(2), words)
                sketches = [sketch(s) for s in sets]
                yield pa.RecordBatch.from_pydict({
                    "id": part.column(0), "print": part.column(1),
                    "d1": _signed(np.array([mix64(s).sum(dtype=U64) for s in sets], U64)),
                    "d2": _signed(np.array([mix64(s ^ U64(0xA0761D6478BD642F)).sum(dtype=U64) for s in sets], U64)),
                    "n": pa.array([len(s) for s in sets], pa.int64()), "sketch": pa.array([s.astype("<u4").tobytes() for s in sketches], pa.binary()),
                    "probe": pa.array([s[:PROBES].astype(np.int64) for s in sketches], pa.list_(pa.int64())),
                })

    return _documents(df, id_column, text).mapInArrow(run, "id bigint, print bigint, d1 bigint, d2 bigint, n bigint, sketch binary, probe array<bigint>")


def candidate_edges(reps: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, bucket: int = BUCKET) -> DataFrame:
    """``(a, b)``: edges that connect, with probability ``recall``, every two sets of this similarity; they may connect more.

    ``reps`` is ``(id, sketch, probe)``.  Every set starts at the root of every run of the first step and goes to the children of the
    tokens that its node chooses.  Buckets of at most ``bucket`` sets are compared all with all by their sketches.  A set that has made enough
    picks in such buckets leaves the larger ones, which hold sets that share common shingles and little else.  What is still large is
    split again, by two levels at a time, unless its sets agree so well on average with one of three of them that splitting is of no use: these, and what is
    left at the last step, are joined as a whole by a star.  Deeper buckets are met with a smaller chance, so the sets of a bucket that is split
    start in more runs, as many as hold the recall at the depth they go to.  A bucket returns a spanning forest, never its pairs.
    """
    runs = step_runs(recall, similarity)
    least = _least(similarity)
    roots = mix64(np.arange(1, runs[-1] + 1, dtype=U64))

    def start(batches, roots):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                s, ids = _sketch_rows(part.column(1)), part.column(0).to_numpy()
                for root in roots:
                    row, child = choose(np.full(len(s), root), s, similarity)
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(child)), pa.array(ids[row])], names=["node", "id"])

    def split(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                part = batch.slice(at, 1_024)
                s, ids = _sketch_rows(part.column(2)), part.column(1).to_numpy()
                row, child = choose(part.column(0).to_numpy().view(U64), s, similarity)
                again, grandchild = choose(child, s[row], similarity)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(grandchild)), pa.array(ids[row[again]])], names=["node", "id"])

    def unsettled(batches, done):
        needed = picks_to_settle(done, recall, similarity)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                s, picks = _sketch_rows(part.column(1)), -part.column(2).to_numpy()
                for root in roots[:done]:
                    picks = picks + np.bincount(choose(np.full(len(s), root), s, similarity)[0], minlength=len(s))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(picks < needed))], names=["id"])

    def compare(batches) -> Iterator[pa.RecordBatch]:
        for _, table in grouped(batches, ["leaf"]):
            ids, s = table["id"].to_numpy(), _sketch_rows(table["sketch"])
            agree = np.stack([(s == r).sum(1) for r in s]) >= least * SKETCH
            pairs = forest(np.argwhere(np.triu(agree, 1)), len(ids))
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]])], names=["a", "b"])

    sketches = reps.select("id", "sketch")
    lists, edges, common = [], [], []
    frontier_type = "node bigint, id bigint"
    still = None  # the sets that the runs so far have not settled, of those in large buckets

    def sized(frontier: DataFrame) -> DataFrame | None:
        """``(node, id)`` of the large buckets; the small ones are noted."""
        sizes = materialize(frontier.groupBy("node").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
        lists.append(
            frontier.join(sizes.where(F.col("m") <= bucket).select("node"), "node").groupBy("node")
            .agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids")
        )
        large = sizes.where(F.col("m") > bucket)
        return None if large.isEmpty() else materialize(frontier.join(large.select("node"), "node", "left_semi").select("node", "id"))

    def settle(frontier: DataFrame, step: int, done: int) -> DataFrame | None:
        """``(node, id)`` of the buckets that are to be split; the others are noted."""
        nonlocal still
        members = sized(materialize(frontier.distinct()))
        if members is None:
            return None
        if step == 1:
            common.append(members.groupBy("id").agg(F.count(F.lit(1)).alias("picks")))
            counted = common[0]
            for more in common[1:]:
                counted = counted.union(more)
            counted = sketches.join(counted.groupBy("id").agg(F.sum("picks").alias("picks")), "id").select("id", "sketch", "picks")
            still = materialize(counted.mapInArrow(lambda batches: unsettled(batches, done), "id bigint"))
        members = sized(materialize(members.join(still, "id", "left_semi").select("node", "id")))
        if members is None:
            return None
        # each set against three of its bucket; salted, so that a very large bucket is not one task
        probed = members.join(reps.select("id", "probe"), "id").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        pivots = materialize(probed.groupBy("node").agg(
            F.min("id").alias("hub"), F.min_by("probe", "id").alias("p0"), F.max_by("probe", "id").alias("p1"),
            F.min_by("probe", F.xxhash64("id")).alias("p2"),
        ))
        salted = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        shares = [F.avg(F.size(F.filter(F.zip_with("probe", p, lambda x, y: x == y), lambda x: x)) / PROBES) for p in ("p0", "p1", "p2")]
        alike = probed.join(salted, ["node", "salt"]).groupBy("node").agg(F.min("hub").alias("hub"), F.greatest(*shares).alias("share"))
        judged = materialize(alike.select("node", "hub", (F.col("share") >= least).alias("alike")))
        told = materialize(members.join(judged, "node"))
        hubbed = told if step == MAX_STEPS else told.where("alike")
        edges.append(materialize(hubbed.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()))
        rest = told.where("NOT alike").select("node", "id")
        return None if step == MAX_STEPS or rest.isEmpty() else rest

    def children(rest: DataFrame) -> DataFrame:
        return rest.join(sketches, "id").select("node", "id", "sketch").mapInArrow(split, frontier_type)

    asked, going = sketches, None
    for step in range(1, MAX_STEPS + 1):
        # the runs that this step adds, walked down from the root
        own = roots[0 if step == 1 else runs[step - 2] : runs[step - 1]]
        frontier = asked.mapInArrow(lambda batches, own=own: start(batches, own), frontier_type)
        for earlier in range(1, step):
            left = settle(frontier, earlier, runs[step - 1])
            if left is None:
                frontier = None
                break
            frontier = children(left)
        if going is not None:
            frontier = children(going) if frontier is None else frontier.union(children(going))
        going = settle(frontier, step, runs[step - 1])
        if going is None:
            break
        asked = sketches.join(materialize(going.select("id").distinct()), "id", "left_semi")
    found = lists[0]
    for more in lists[1:]:
        found = found.union(more)
    # most buckets come up in many runs with the same members: compare each set of members once
    leaves = materialize(found.distinct().select(F.xxhash64("ids").alias("leaf"), F.explode("ids").alias("id")).distinct())
    rows = leaves.join(sketches.hint("merge"), "id").select("leaf", "id", "sketch").repartition(tasks(reps.sparkSession), "leaf").sortWithinPartitions("leaf", "id")
    out = rows.mapInArrow(compare, "a bigint, b bigint")
    for e in edges:
        out = out.union(e)
    return out


def _similar(sets: list[np.ndarray], cut: int, within: bool, similarity: float) -> np.ndarray:
    """Index pairs of similar sets: all of them if ``within``, else of the first ``cut`` with the others."""
    sizes = np.array([len(s) for s in sets])
    token, number = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(number, minlength=len(token)) > 1
    place = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(sets)), sizes)
    keep = shared[number]
    number, owner = place[number[keep]], owner[keep]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    common = np.zeros((len(sets) if within else cut, len(sets) if within else len(sets) - cut), np.float32)
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, 4_096):
        a, b = np.searchsorted(number, [lo, lo + 4_096])
        grid = np.zeros((len(sets), 4_096), np.float32)
        grid[owner[a:b], number[a:b] - lo] = 1
        common += grid @ grid.T if within else grid[:cut] @ grid[cut:].T
    left, right = (sizes, sizes) if within else (sizes[:cut], sizes[cut:])
    enough = common >= similarity * (left[:, None] + right[None, :] - common) - 1e-6
    if within:
        return np.argwhere(np.triu(enough, 1))
    return np.argwhere(enough) + np.array([0, cut])


def _verified(df: DataFrame, id_column: str, text: str, members: DataFrame, similarity: float, words: int) -> DataFrame:
    """``(id, other, n)``: links of each representative with others of its candidate component, and a spanning forest.

    ``members`` is ``(id, component, n, doc, print)``, the last two the id and the hash of the representative's text.  A component is cut into blocks by a hash of the id so that a pair of blocks is bounded in
    rows and shingles; each pair of blocks is one group.
    """
    spark = df.sparkSession
    sizes = materialize(members.groupBy("component").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")))
    dealt = materialize(members.drop("n").join(sizes, "component").select(
        "id", "doc", "print", "component", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")))
    docs = _documents(df, id_column, text).withColumnRenamed("id", "doc")
    chosen = docs.join(dealt.hint("merge"), ["doc", "print"]).dropDuplicates(["id"]).select("id", "component", "blocks", "block", "text")

    def shingle(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                sets = pa.array([s.tobytes() for s in shingle_sets(part.column(4), words)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:4], sets], names=["id", "component", "blocks", "block", "shingles"])

    sets = materialize(chosen.mapInArrow(shingle, "id bigint, component bigint, blocks int, block int, shingles binary"))
    paired = sets.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "id", "shingles"
    ).repartition(tasks(spark), "component", "i", "j").sortWithinPartitions("component", "i", "j", "block", "id")

    def verify(batches) -> Iterator[pa.RecordBatch]:
        for (_, i, j), table in grouped(batches, ["component", "i", "j"]):
            if table.num_rows < 2:
                continue
            ids = table["id"].to_numpy()
            cut = int((table["block"].to_numpy() == i).sum())
            if i != j and not 0 < cut < len(ids):
                continue
            pairs = _similar([np.frombuffer(s, U64) for s in table["shingles"].to_pylist()], cut, i == j, similarity)
            if not len(pairs):
                continue
            n = np.bincount(pairs.ravel(), minlength=len(ids))
            hit, tree = np.flatnonzero(n), forest(pairs, len(ids))
            yield pa.RecordBatch.from_pydict({
                "id": np.concatenate([ids[hit], ids[tree[:, 0]]]), "other": pa.array([None] * len(hit) + ids[tree[:, 1]].tolist(), pa.int64()),
                "n": np.concatenate([n[hit], np.zeros(len(tree), np.int64)]),
            })

    return materialize(paired.mapInArrow(verify, "id bigint, other bigint, n bigint"))


def near_duplicates(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, words: int = WORDS, recall: float = RECALL,
    prints: str | None = None,
) -> DataFrame:
    """``(id_column, class_id, copies, n_links, group_id, kept)`` of every row of ``df``.

    Texts with equal sets of word shingles are a class, named by its smallest id, of ``copies`` rows.  ``n_links`` is the number
    of other classes whose Jaccard similarity is at least ``similarity``, checked exactly; ``group_id`` is the smallest id that is
    reached over such links; ``kept`` marks the row with that id.  A text without words is in no class: its class and group are its own
    id, it has no links and is kept.  Rows that repeat an id with the same text are one document; a null id is the smallest
    one.  Different texts of one id are documents of their own, ordered by a hash of the text (``text_print``), which the
    column ``prints`` gives if asked for; only the first document of a group is kept.

    Links between different classes are found with probability ``recall`` at the threshold, at every depth of the buckets, and more above it; what
    is found in one candidate component is complete.
    """
    spark = df.sparkSession

    def found_rows() -> DataFrame:
        signed = materialize(signatures(df, id_column, text, words))
        # a class is numbered: its smallest id may be that of other classes too
        classes = materialize(
            signed.where("n > 0").groupBy("d1", "d2").agg(F.min(F.struct("id", "print")).alias("first"), F.countDistinct("id", "print").alias("copies"))
            .select("d1", "d2", "first", "copies", F.monotonically_increasing_id().alias("rep"))
        )
        named = classes.select("rep", F.col("first.id").alias("id"), F.col("first.print").alias("print"), "d1", "d2")
        reps = materialize(
            signed.join(named.hint("merge"), ["id", "print", "d1", "d2"]).dropDuplicates(["rep"]).select(F.col("rep").alias("id"), "n", "sketch", "probe", F.col("id").alias("doc"), "print")
        )
        edges = settled(spark, lambda: candidate_edges(reps, similarity, recall))
        members = materialize(components(edges).join(reps.select("id", "n", "doc", "print"), "id"))
        found = _verified(df, id_column, text, members, similarity, words)
        links = found.where("other IS NULL").groupBy("id").agg(F.sum("n").alias("n_links"))
        groups = materialize(
            components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
            .join(reps.select("id", F.struct(F.col("doc").alias("id"), "print").alias("own")), "id").select("id", "component", "own")
        )
        leaders = groups.groupBy("component").agg(F.min("own").alias("leader"))
        groups = groups.join(leaders, "component").select("id", "leader")
        of_class = materialize(
            classes.join(links, classes["rep"] == links["id"], "left").drop("id").join(groups, F.col("rep") == groups["id"], "left")
            .select("d1", "d2", F.col("first.id").alias("class_id"), "copies", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
                    F.coalesce("leader", "first").alias("leader"))
        )
        rows = signed.select("id", "print", "d1", "d2", "n")
        keyed = rows.where("n > 0").join(of_class, ["d1", "d2"]).select(
            "id", "print", "class_id", "copies", "n_links", F.col("leader.id").alias("group_id"), (F.struct("id", "print") == F.col("leader")).alias("kept"))
        alone = rows.where("n = 0").select(
            "id", "print", F.col("id").alias("class_id"), F.lit(1).cast("bigint").alias("copies"), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("group_id"),
            F.lit(True).alias("kept"))
        return keyed.unionByName(alone).select(
            F.when(F.col("id") != _LEAST, F.col("id")).alias(id_column), "class_id", "copies", "n_links", "group_id", "kept",
            *([] if prints is None else [F.col("print").alias(prints)]))

    return settled(spark, found_rows)
