"""Shared helpers of the training-data operators: shared storage, input selection, bounded batches, caches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python stage handles at once, whatever the size of Spark's Arrow batch.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the one set by SparkContext.setCheckpointDir.

    Only a local master, whose tasks all run on this machine, gets a folder of its own where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    got = context._jsc.sc().getCheckpointDir()
    if got.isDefined():
        return got.get()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="corpuslab-"))
    return context._jsc.sc().getCheckpointDir().get()


#: Shuffle files of a query are deleted as it ends: a table written by cut() is all that is read again.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/corpuslab-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table of the shared folder and read it back: lineage ends here, lost executors lose nothing.

    The shuffles that made it are gone once it is written."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by cut() that no result reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.table_path)


def clean(spark: SparkSession) -> None:
    """Delete what the operators of this application have left in the shared folder. Call it when their results are written."""
    _delete(spark, _folder(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(docs: DataFrame, **cols: str) -> DataFrame:
    """Only the wanted columns under fixed names, so that other columns of the input never clash."""
    return docs.select(*[F.col(f"`{src}`").alias(dst) for dst, src in cols.items()])


def text_md5(text: str = "text"):
    """What tells the texts of rows that share an id apart; null counts as empty."""
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs but those of `gone` (doc_id, text_md5): a row goes for its own text, never for one that shares its id."""
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("text_md5").alias("_gone_md5"))
    return docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("_gone_id")) & (text_md5(text_col) == F.col("_gone_md5")), "left_anti")


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of Arrow batches with about `most` bytes of text each (one row at least)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        start, held = 0, 0
        sizes = [len(x) if x is not None else 0 for x in col.cast(pa.large_binary()).to_pylist()] if batch.nbytes > most else []
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)


class Memo:
    """A bounded two-generation map: the older half goes when the younger is full, so hot keys stay."""

    def __init__(self, size: int):
        self.half, self.new, self.old = max(1, size // 2), {}, {}

    def missing(self, keys) -> list:
        """Those keys that neither generation has; found ones move to the younger generation."""
        out = []
        new, old = self.new, self.old
        for k in keys:
            if k not in new:
                if k in old:
                    new[k] = old[k]
                else:
                    out.append(k)
        return out

    def turn(self) -> None:
        """Call between batches."""
        if len(self.new) > self.half:
            self.old, self.new = self.new, {}


def arrow_rows(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if not isinstance(cols[f.name], pa.Array) else cols[f.name].cast(f.type) for f in schema], schema=schema)


def bounded(spark: SparkSession) -> None:
    """Batches that go to Python workers hold 8 MB at most (or one row)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def hot_keys(counts: DataFrame, key: str, n: str, least: int = 1000, most_keys: int = 10_000) -> tuple[DataFrame, int]:
    """Keys with more rows than a threshold, and the number k of salts each gets. counts must be a cut() table.

    The threshold is the larger of `least` and total / most_keys, so there are at most most_keys such keys
    however large the table is: the list may be broadcast.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    rows = max(least, total // most_keys)
    return counts.filter(F.col(n) > rows).select(key, F.ceil(F.col(n) / rows).cast("int").alias("k")), rows


def salted_join(rows: DataFrame, facts: DataFrame, counts: DataFrame, key: str, row_id: str, n: str = "n", how: str = "inner") -> DataFrame:
    """rows joined with facts (few rows a key) on key, where a key with many rows is dealt over tasks by its counted size."""
    hot, _ = hot_keys(counts, key, n)
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("k").isNull(), 0).otherwise(F.pmod(F.xxhash64(row_id), F.col("k")).cast("int"))).drop("k")
    right = facts.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1))).drop("k")
    return left.join(right, [key, "_salt"], how).drop("_salt")


_TURN: dict = {"name": None, "drop": None}


def turn(name: str, drop=None) -> None:
    """Called by an operator as it starts a task in a Python worker: what another operator kept in the worker goes.

    Workers outlive stages, and caches of one stage must not add to those of the next."""
    if _TURN["name"] not in (None, name):
        import ctypes
        import gc

        if _TURN["drop"]:
            _TURN["drop"]()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not glibc: freed memory goes back in its own time
            pass
    _TURN.update(name=name, drop=drop)
