"""Token counts: additive totals kept up to date by signed changes in idempotent batches."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import new_folder

KEYS = ("source", "lang", "tokenizer")
STATE = "doc_id bigint, source string, lang string, tokenizer string, tokens bigint"
MARKER, COMPACTED = "commit-", "compacted"
TOTALS = "source string, lang string, tokenizer string, documents bigint, tokens bigint"


def count_tokens(df: DataFrame, id_column: str, text: str, ranks_file: str, pattern: str, carry: Sequence[str] = ()) -> DataFrame:
    """``(id_column, *carry, tokens)``: whole texts counted with the vocabulary in ``ranks_file``; null texts have none.

    The file is read by every Python worker; its path must exist on the executors.
    """
    def counts(batches):
        import base64

        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoder = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [0 if t is None else len(encoder.encode_ordinary(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64())], names=[*batch.schema.names[1:], "tokens"])

    columns = [id_column, *carry]
    chosen = df.select(F.col(f"`{text}`").alias("_text"), *[F.col(f"`{c}`") for c in columns])
    schema = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in columns) + ", tokens bigint"
    return chosen.mapInArrow(counts, schema)


def signed_changes(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """``(source, lang, tokenizer, documents, tokens)``: what turns the totals of one state into the other's.

    A state is one row per document, ``(doc_id, source, lang, tokenizer, tokens)``.  Rows of ``after`` count plus one and
    their tokens, rows of ``before`` minus one and minus theirs: an insert has only the first, a delete only the
    second, a revision both, under another key if source, language or tokenizer changed.  Sums are combined
    before the shuffle, so a hot source costs one row per task.  Null keys are groups of their own; null counts are 0.
    """
    parts = []
    for state, sign in ((before, -1), (after, 1)):
        if state is not None:
            parts.append(state.select(
                *KEYS, F.lit(sign).cast("bigint").alias("documents"), (F.coalesce("tokens", F.lit(0)) * sign).alias("tokens")
            ))
    if not parts:
        raise ValueError("needs a state before or after")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where(
        "documents <> 0 OR tokens <> 0"
    )


class TokenLedger:
    """The committed batches of signed changes below one shared folder.

    A batch is written to a folder of its own, whose name then goes into the marker ``commit-<id>``.  A marker is created only
    if there is none (one file system call), so of several writers of one id exactly one commits, and committing an id
    again changes nothing; a batch without a marker, or with one that is still empty, is not there yet.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = (folder or new_folder(spark, "ledger")).rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _marked(self) -> dict[str, str]:
        """The data folder of every committed id."""
        out = {}
        for f in self._fs.listStatus(self._path(".")):
            name = f.getPath().getName()
            if name.startswith(MARKER):
                stream = self._fs.open(f.getPath())
                try:
                    out[name.removeprefix(MARKER)] = bytes(stream.readAllBytes()).decode()
                finally:
                    stream.close()
        return {i: d for i, d in out.items() if d}

    def _mark(self, batch_id: str, data: str) -> bool:
        """Create the marker; False if another one is there."""
        target = self._path(MARKER + batch_id)
        try:
            stream = self._fs.create(target, False)
        except Py4JJavaError:
            if self._fs.exists(target):
                return False
            raise
        stream.write(data.encode())
        stream.close()
        return True

    def batches(self) -> list[str]:
        """The ids committed so far, those of compacted batches included."""
        return sorted(self._marked())

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch; False if it had been committed before."""
        if not batch_id or "/" in batch_id:
            raise ValueError("a batch id is a name without slashes")
        if self._fs.exists(self._path(MARKER + batch_id)):
            return False
        data = f"data-{uuid.uuid4().hex}"
        changes.select(*KEYS, "documents", "tokens").write.parquet(f"{self.folder}/{data}")
        if self._mark(batch_id, data):
            return True
        self._fs.delete(self._path(data), True)
        return False

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, documents, tokens)`` after all batches; keys without documents are left out."""
        folders = sorted({d for d in self._marked().values() if d != COMPACTED})
        if not folders:
            return self.spark.createDataFrame([], TOTALS)
        rows = self.spark.read.schema(TOTALS).parquet(*[f"{self.folder}/{d}" for d in folders])
        return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where(
            "documents <> 0 OR tokens <> 0"
        )

    def compact(self, batch_id: str) -> "TokenLedger":
        """A new ledger with the totals of this one in one batch; every id committed here counts as committed there."""
        before = self.batches()
        if batch_id in before:
            raise ValueError(f"batch {batch_id} is there already")
        out = TokenLedger(self.spark)
        out.commit(batch_id, self.totals())
        for i in before:
            out._mark(i, COMPACTED)
        return out
