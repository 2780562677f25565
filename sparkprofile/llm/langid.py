"""Language identification: each document is a mixture of languages, fitted by expectation-maximisation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import U64, tasks

BUCKETS = 1 << 16
MODEL_BYTES = 256 << 20
UNDECIDED = "und"
SLICE_ROWS = 1_000
_LETTER = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def trigrams(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Hashed trigrams of the lower-cased letters; everything between letters is one space, also at both ends."""
    if not text:
        return np.zeros(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    kept = np.where(letter, points, 32)
    first = np.ones(len(kept), bool)
    first[1:] = letter[1:] | letter[:-1]
    kept = kept[first]
    kept = kept[1:] if kept[0] == 32 else kept
    kept = kept[:-1] if kept[-1] == 32 else kept
    padded = np.full(len(kept) + 2, 32, U64)
    padded[1:-1] = kept
    h = padded[:-2] * U64(0x9E3779B97F4A7C15) + padded[1:-1] * U64(0xC2B2AE3D27D4EB4F) + padded[2:] * U64(0x165667B19E3779F9)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    return (h >> U64(40)).astype(np.int64) % buckets


@dataclass(frozen=True)
class LanguageModel:
    """Per language the likelihood of each trigram bucket, relative to the best language's, and its logarithm."""

    languages: list[str]
    ratio: np.ndarray

    def mixture(self, grams: np.ndarray, rounds: int = 30, penalty: float = 0.5) -> tuple[list[int], np.ndarray]:
        """The chosen languages and their shares in a document with these trigrams.

        Starts from the likeliest single language and adds languages, most promising first, while the log-likelihood grows
        by more than ``penalty * log(n)`` per language.  Overlapping trigrams share letters, so three count as one.
        """
        r = self.ratio[grams]
        n = max(1.0, len(grams) / 3)
        alone = np.log(r).sum(0)
        chosen = [int(alone.argmax())]
        shares = np.ones(1)
        if len(self.languages) == 1:
            return chosen, shares
        level = float(alone.max())
        full = expect(r, np.full(r.shape[1], 1 / r.shape[1], np.float32), 8)
        for extra in np.argsort(-full, kind="stable").tolist():
            if extra in chosen:
                continue
            columns = np.ascontiguousarray(r[:, [*chosen, extra]])
            start = np.append(shares * 0.8, 0.2).astype(np.float32)
            fitted = expect(columns, start, rounds)
            new = float(np.log(columns @ fitted).sum())
            if (new - level) / 3 <= penalty * np.log(n + 1):
                break
            chosen, shares, level = [*chosen, extra], fitted, new
        return chosen, shares

    def predict(self, text: str | None) -> tuple[str, float, list[tuple[str, float]]]:
        """``(language, its share, all shares)``; ``und`` for a text that is null or has no letter."""
        grams = trigrams(text, len(self.ratio))
        if not len(grams) or not self.languages:
            return UNDECIDED, 0.0, []
        chosen, shares = self.mixture(grams)
        order = sorted(range(len(chosen)), key=lambda i: (-shares[i], self.languages[chosen[i]]))
        parts = [(self.languages[chosen[i]], min(1.0, float(shares[i]))) for i in order]
        return parts[0][0], parts[0][1], parts


def expect(ratio: np.ndarray, shares: np.ndarray, rounds: int) -> np.ndarray:
    """Shares after so many rounds of expectation-maximisation."""
    n = np.float32(len(ratio))
    for _ in range(rounds):
        new = shares * ((1 / (ratio @ shares)) @ ratio) / n
        if np.abs(new - shares).max() < 1e-4:
            return new / new.sum()
        shares = new
    return shares / shares.sum()


def fit(labelled: DataFrame, text: str, lang: str, per_language: int = 5_000, smoothing: float = 0.5, buckets: int = BUCKETS) -> LanguageModel:
    """Learn trigram likelihoods from about ``per_language`` different labelled texts of each language, the documented bound.

    The texts are picked by their hash, all of them where a language has fewer; each is read once and weighted by its copies.  Rows without text or
    language teach nothing; without any row the model knows no language and predicts ``und``.
    """
    rows = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.countDistinct(F.xxhash64("text")).alias("n")).collect()}
    if not sizes:
        return LanguageModel([], np.ones((buckets, 0), np.float32))
    if 8 * buckets * len(sizes) > MODEL_BYTES:
        raise ValueError(f"{len(sizes)} languages need a model beyond {MODEL_BYTES} bytes; use fewer buckets")
    scale = 1 << 30
    bound = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(int(min(1.0, per_language / n) * scale)))])
    picked = rows.where(F.pmod(F.xxhash64("text", F.lit(17)), F.lit(scale)) < bound[F.col("lang")])
    sample = picked.groupBy("lang", F.xxhash64("text").alias("print")).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")).select("text", "lang", "copies")

    def counts(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, k, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k not in sums:
                    sums[k] = np.zeros(buckets, np.int64)
                sums[k] += copies * np.bincount(trigrams(t, buckets), minlength=buckets)
        for k, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_pydict({"lang": [k] * len(at), "bucket": at.astype(np.int32), "n": v[at]})

    spread = sample.repartition(tasks(rows.sparkSession), F.xxhash64("text"))
    found = spread.mapInArrow(counts, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(sizes)
    at = {k: i for i, k in enumerate(names)}
    table = np.zeros((buckets, len(names)))
    table[found["bucket"].to_numpy(), [at[k] for k in found["lang"].to_pylist()]] = found["n"].to_numpy()
    table = (table + smoothing) / (table.sum(0) + smoothing * buckets)
    return LanguageModel(names, (table / table.max(1, keepdims=True)).astype(np.float32))


def identify(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` (share of that language, 0 to 1) and ``languages`` (all shares, largest first).

    One pass over the whole texts without a shuffle; the model, of bounded size, travels with the tasks.  Existing columns of
    these names are replaced.  Null texts and texts without a letter get ``und`` and score 0; equal texts
    get equal answers; ties go to the first name.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in ("lang_pred", "score", "languages")]
    shared = spark.sparkContext.broadcast((model.languages, model.ratio))

    def label(batches):
        known = LanguageModel(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                answers = [known.predict(t) for t in part.column(0).to_pylist()]
                shares = pa.array([[{"lang": k, "share": s} for k, s in a[2]] for a in answers], share_type)
                extra = [pa.array([a[0] for a in answers], pa.string()), pa.array([a[1] for a in answers], pa.float64()), shares]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *extra], names=[*part.schema.names[1:], "lang_pred", "score", "languages"])

    share_type = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
    rows = df.select(F.col(f"`{text}`").alias("_langid_text"), *[F.col(f"`{c}`") for c in kept])
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(label, schema + ", lang_pred string, score double, languages array<struct<lang:string,share:double>>")
