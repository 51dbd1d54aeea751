"""De-duplication across splits, ordered slices, refills and greedy disjoint selection."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.operators.order import ordered_splits
from corpuslab.schema import CorpusError, require_columns

KEYS = ("id", "source", "target", "source_target_pair")


@dataclass(frozen=True)
class SliceSizes:
    sft_train: int = 76_000
    sft_dev: int = 2_000
    grpo_train: int = 16_000
    grpo_dev: int = 2_000

    def as_dict(self) -> dict[str, int]:
        return {"sft_train": self.sft_train, "sft_dev": self.sft_dev, "grpo_train": self.grpo_train, "grpo_dev": self.grpo_dev}


#: Which split keeps a shared row: the first of these.
PRIORITY = ("test", "sft_train", "sft_dev", "grpo_train", "grpo_dev")
CORPUS_SLICES = {"train": 96_000, "test": 2_000, "lfp_background": 70_000, "evaluation_reserve": 16}


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the folder all executors share."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise CorpusError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="corpuslab-"))
            got = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = got.get()
    path = f"{folder}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def core_columns(df: DataFrame) -> DataFrame:
    """id (from sentence_id if need be), source, target, then the rest."""
    if "id" not in df.columns and "sentence_id" in df.columns:
        df = df.withColumnRenamed("sentence_id", "id")
    require_columns(df, "id", "source", "target", label="split")
    return df.select(F.col("id").cast("string").alias("id"), "source", "target", *[c for c in df.columns if c not in ("id", "source", "target", "sentence_id")])


def dedup_pairs(df: DataFrame, order: str = "original_index") -> DataFrame:
    """The first row of each (source, target)."""
    return df.groupBy("source", "target").agg(F.min(F.struct(order, *[c for c in df.columns if c not in ("source", "target", order)])).alias("_r")).select("source", "target", "_r.*").select(*df.columns)


def training_slices(train: DataFrame, test: DataFrame, order: str, sizes: SliceSizes = SliceSizes(), strict: bool = True) -> DataFrame:
    """Consecutive slices of train by order, and test, as one table with a split column."""
    wanted = sizes.as_dict()
    if strict and (n := train.count()) < sum(wanted.values()):
        raise CorpusError(f"{n} rows, {sum(wanted.values())} wanted")
    cut = ordered_splits(train, order, wanted).filter("split is not null")
    return cut.unionByName(test.withColumn("split", F.lit("test")), allowMissingColumns=True)


def _keys(df: DataFrame) -> dict[str, Column]:
    return {"id": F.col("id").cast("string"), "source": F.col("source"), "target": F.col("target"), "source_target_pair": F.md5(F.concat_ws("\u0001", "source", "target"))}


def cascade_dedup(splits: DataFrame, priority: tuple[str, ...] = PRIORITY) -> DataFrame:
    """All rows with four flags (dup_id, dup_source, dup_target, dup_source_target_pair) and kept.

    A row is dropped if a key of it stands in a kept row of a split of higher priority; rows of one split
    don't drop each other. One pass a split: its keys against the distinct keys kept so far.
    """
    kept = done = None
    for name in priority:
        rows = splits.filter(F.col("split") == name)
        flagged = rows
        for field, expr in _keys(rows).items():
            if kept is None:
                flagged = flagged.withColumn(f"dup_{field}", F.lit(False))
            else:
                seen = kept.filter(F.col("field") == field).select(F.col("value").alias("_v"), F.lit(True).alias("_s"))
                flagged = flagged.withColumn("_k", expr).join(seen, F.col("_k") == F.col("_v"), "left").withColumn(f"dup_{field}", F.coalesce("_s", F.lit(False))).drop("_k", "_v", "_s")
        flagged = checkpoint(flagged.withColumn("kept", ~(F.col("dup_id") | F.col("dup_source") | F.col("dup_target") | F.col("dup_source_target_pair"))))
        fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), e.alias("value")) for f, e in _keys(rows).items()])).alias("x")
        new = flagged.filter("kept").select(fields).select("x.field", "x.value").distinct()
        kept = new if kept is None else checkpoint(kept.unionByName(new).distinct())
        done = flagged if done is None else done.unionByName(flagged)
    return done


def cascade_report(flagged: DataFrame) -> DataFrame:
    """By split: rows in, kept and dropped, and how often each key was the reason (a row may count for several)."""
    n = lambda c: F.count(F.when(c, 1))
    return flagged.groupBy("split").agg(
        F.count(F.lit(1)).alias("input_rows"), n(F.col("kept")).alias("retained_rows"), n(~F.col("kept")).alias("dropped_rows"),
        *[n(F.col(f"dup_{k}")).alias(f"drop_{k}") for k in KEYS],
    )


def refill(kept: DataFrame, reserve: DataFrame, sizes: dict[str, int], order: str = "original_index", priority: tuple[str, ...] = PRIORITY) -> DataFrame:
    """kept rows with reserve rows appended until each split has its size.

    A cursor walks the reserve once, in order: a candidate that shares a key with a finished earlier split is
    consumed and lost. The reserve is a list of a few rows by contract (it is read in full by the driver, up
    to 10,000 rows; more raise); the candidates' keys are looked up in the splits by one join.
    """
    have = {r["split"]: r["n"] for r in kept.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    candidates = reserve.orderBy(order).limit(10_001).collect()
    if len(candidates) > 10_000:
        raise CorpusError("a reserve of more than 10,000 rows")
    spare = reserve.sparkSession.createDataFrame(candidates, reserve.schema)
    met: dict[tuple[str, str], set[str]] = {}
    for field, expr in _keys(kept).items():
        probe = F.broadcast(spare.select(_keys(spare)[field].alias("_v")).distinct())
        for r in kept.withColumn("_k", expr).join(probe, F.col("_k") == F.col("_v")).select("_v", "split").distinct().collect():
            met.setdefault((field, r["_v"]), set()).add(r["split"])
    import hashlib

    def keys(r) -> dict[str, str]:
        pair = hashlib.md5("\u0001".join(x for x in (r["source"], r["target"]) if x is not None).encode()).hexdigest()
        return {"id": str(r["id"]), "source": r["source"], "target": r["target"], "source_target_pair": pair}

    cursor, added, earlier = 0, [], []
    for name in priority:
        lacking = sizes[name] - have.get(name, 0)
        if lacking < 0:
            raise CorpusError(f"{name} has {-lacking} rows too many")
        for _ in range(lacking):
            while cursor < len(candidates):
                r, cursor = candidates[cursor], cursor + 1
                if not any(met.get((f, v), set()) & set(earlier) for f, v in keys(r).items()):
                    added.append((r, name))
                    for f, v in keys(r).items():
                        met.setdefault((f, v), set()).add(name)
                    break
            else:
                raise CorpusError(f"the reserve ran out at {name}")
        earlier.append(name)
    if not added:
        return kept.withColumn("refilled", F.lit(False))
    rows = reserve.sparkSession.createDataFrame([(*r, s) for r, s in added], T.StructType([*reserve.schema.fields, T.StructField("split", T.StringType())]))
    return kept.withColumn("refilled", F.lit(False)).unionByName(rows.withColumn("refilled", F.lit(True)), allowMissingColumns=True)


def overlap_matrix(splits: DataFrame) -> DataFrame:
    """split_a, split_b, field, n: distinct keys that two splits share (pairs that share none have no row).

    One row a key and the few splits it stands in, so the pairs of splits are made inside a row.
    """
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), e.alias("value")) for f, e in _keys(splits).items()])).alias("x")
    by_key = splits.select("split", fields).select("split", "x.field", "x.value").groupBy("field", "value").agg(F.array_sort(F.collect_set("split")).alias("s")).filter("size(s) > 1")
    pairs = by_key.select("field", F.col("s"), F.explode("s").alias("split_a")).select("field", "split_a", F.explode("s").alias("split_b")).filter("split_a < split_b")
    return pairs.groupBy("split_a", "split_b", "field").agg(F.count(F.lit(1)).alias("n"))


def validate_disjoint(splits: DataFrame) -> DataFrame:
    if bad := overlap_matrix(splits).limit(5).collect():
        raise CorpusError(f"splits overlap: {bad}")
    return splits


def existing_records(train: DataFrame, test: DataFrame, background: DataFrame) -> DataFrame:
    return train.unionByName(test, allowMissingColumns=True).unionByName(background, allowMissingColumns=True)


def overlap_reason(df: DataFrame, existing: DataFrame) -> DataFrame:
    """df with overlap: the first of id, source, target that stands in existing."""
    out = df
    for field in ("id", "source", "target"):
        seen = existing.select(F.col(field).cast("string").alias("_v")).distinct().withColumn(f"_s_{field}", F.lit(True))
        out = out.join(seen, F.col(field).cast("string") == F.col("_v"), "left").drop("_v")
    reason = F.coalesce(*[F.when(F.col(f"_s_{f}"), F.lit(f"{f}_overlap")) for f in ("id", "source", "target")])
    return out.withColumn("overlap", reason).drop("_s_id", "_s_source", "_s_target")


def greedy_disjoint(df: DataFrame, order: str = "original_index", existing: DataFrame | None = None) -> DataFrame:
    """The rows that an ordered scan takes if it skips rows whose source or target it has taken. Rows without a source or a
    target are never taken.

    Rounds over the rows still open: a row that is first both for its source and for its target is taken, and
    rows that share a key with a taken one go. The least open row is always taken, so this ends; each round
    is two partial aggregations and two joins, and the few numbers the driver sees are counts.
    """
    rows = df.filter("source is not null and target is not null")
    if existing is not None:
        rows = overlap_reason(rows, existing).filter("overlap is null").drop("overlap")
    open_rows = checkpoint(rows.select(F.col(order).alias("_o"), F.xxhash64("source", F.lit(1)).alias("_s"), F.xxhash64("target", F.lit(2)).alias("_t")))
    taken = None
    while True:
        best_s = open_rows.groupBy("_s").agg(F.min("_o").alias("_o"))
        best_t = open_rows.groupBy("_t").agg(F.min("_o").alias("_o"))
        won = open_rows.join(best_s, ["_s", "_o"], "left_semi").join(best_t, ["_t", "_o"], "left_semi")
        won = checkpoint(won)
        taken = won.select("_o") if taken is None else taken.unionByName(won.select("_o"))
        open_rows = checkpoint(open_rows.join(won.select("_s"), "_s", "left_anti").join(won.select("_t"), "_t", "left_anti"))
        if not open_rows.limit(1).count():
            break
    return rows.join(taken, F.col(order) == F.col("_o"), "left_semi")


def classifier_pairs(df: DataFrame, sizes: dict[str, int], order: str = "original_index", existing: DataFrame | None = None) -> DataFrame:
    """Greedy disjoint rows, the first of which are cut into splits."""
    return ordered_splits(greedy_disjoint(df, order, existing), order, sizes).filter("split is not null")


def quality_pairs(df: DataFrame, score: Column, least: float, n: int | None = None, order: str = "original_index", existing: DataFrame | None = None) -> DataFrame:
    """Greedy disjoint rows with a score of at least `least`, the first n by order. A row of low score still blocks later ones."""
    out = greedy_disjoint(df, order, existing).withColumn("quality", score).filter(F.col("quality") >= least)
    return out if n is None else out.orderBy(order).limit(n)


def first_seen(df: DataFrame, column: str, order: str, limit: int = 20) -> DataFrame:
    """Distinct values by first appearance."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("first_at")).orderBy("first_at").limit(limit)


def first_non_null(df: DataFrame, column: str, order: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).agg(F.min_by(column, order).alias(column))


def check_styles(examples: DataFrame) -> DataFrame:
    """Each split has both labels and no source_id of another split, else an error."""
    bad = examples.groupBy("split").agg(F.sort_array(F.collect_set("label")).alias("labels")).filter("labels != array(0, 1)").limit(5).collect()
    twice = examples.groupBy("source_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").limit(5).collect()
    if bad or twice:
        raise CorpusError(f"labels {bad}, source ids of several splits {twice}")
    return examples
