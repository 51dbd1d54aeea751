"""Contrastive scores and binary classifier measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.operators.lexical import ratio
from corpuslab.schema import CorpusError


def annotate(df: DataFrame, human: str, machine: str, threshold: float = 0.0) -> DataFrame:
    """htmt_score = human - machine log probability, and its label; nulls stay null."""
    score = F.col(human) - F.col(machine)
    return df.withColumn("htmt_score", score).withColumn("htmt_label", F.when(score.isNotNull(), F.when(score >= threshold, "ht_like").otherwise("mt_like")))


def calibration(df: DataFrame, score: str = "htmt_score", label: str = "label") -> DataFrame:
    """One row: the means of both classes, their midpoint, and the scale 4 / margin (null if the margin isn't positive)."""
    mean = lambda v: F.avg(F.when(F.col(label) == v, F.col(score)))
    m = df.agg(mean(1).alias("human_mean"), mean(0).alias("machine_mean"))
    margin = F.col("human_mean") - F.col("machine_mean")
    return m.select("human_mean", "machine_mean", ((F.col("human_mean") + F.col("machine_mean")) / 2).alias("center"), F.when(margin > 0, F.lit(4.0) / margin).alias("scale"))


def calibration_parameters(df: DataFrame, score: str = "htmt_score", label: str = "label") -> tuple[float, float]:
    r = calibration(df, score, label).first()
    if r["scale"] is None:
        raise CorpusError("human texts don't score above machine texts")
    return r["center"], r["scale"]


def normalised(score: Column, center: Column, scale: Column) -> Column:
    """A stable sigmoid of the calibrated score; 0.5 for null."""
    z = (score - center) * scale
    e = F.exp(-F.abs(z))
    return F.coalesce(F.when(z >= 0, F.lit(1.0) / (F.lit(1.0) + e)).otherwise(e / (F.lit(1.0) + e)), F.lit(0.5))


def confusion(df: DataFrame, score: str, label: str = "label", threshold: float = 0.5, *by: str) -> DataFrame:
    """label, predicted, n for all four cells."""
    got = df.groupBy(F.col(label).cast("int").alias("label"), (F.col(score) >= threshold).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    cells = df.sparkSession.createDataFrame([(a, b) for a in (0, 1) for b in (0, 1)], "label int, predicted int")
    return F.broadcast(cells).join(got, ["label", "predicted"], "left").select("label", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def roc_auc(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    """roc_auc by Mann-Whitney with average ranks; null if a class is missing.

    Ranks are of distinct scores with their counts, so ties cost nothing; the running sum is taken over
    buckets of scores first, so no task sees all of them."""
    by = df.select(F.col(score).cast("double").alias("s"), F.col(label).cast("int").alias("y")).filter("s is not null").groupBy("s").agg(F.count(F.when(F.col("y") == 1, 1)).alias("p"), F.count(F.when(F.col("y") == 0, 1)).alias("q"))
    edges = [r for r in by.stat.approxQuantile("s", [i / 64 for i in range(1, 64)], 0.005)] if by.limit(1).count() else []
    edges = sorted(set(edges))
    bucket = F.lit(0)
    for e in edges:
        bucket = bucket + (F.col("s") >= e).cast("int")
    rows = by.withColumn("b", bucket)
    totals = rows.groupBy("b").agg(F.sum("q").alias("tq"))
    before = totals.select("b", (F.sum("tq").over(Window.orderBy("b")) - F.col("tq")).alias("q_before"))  # 64 rows at most
    w = Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = rows.withColumn("run", F.sum("q").over(w) - F.col("q")).join(F.broadcast(before), "b")
    wins = F.sum(F.col("p") * (F.col("q_before") + F.col("run") + F.col("q") / 2))
    return below.agg(wins.alias("wins"), F.sum("p").alias("P"), F.sum("q").alias("Q")).select(F.try_divide(F.col("wins"), (F.col("P") * F.col("Q")).cast("double")).alias("roc_auc"))


def binary_metrics(df: DataFrame, score: str, label: str = "label", threshold: float = 0.5) -> DataFrame:
    """accuracy, precision, recall, f1 (0 on zero division) and the cells of the confusion matrix."""
    y, p = F.col(label) == 1, F.col(score) >= threshold
    n = lambda c: F.count(F.when(c, 1))
    c = df.agg(n(y & p).alias("tp"), n(~y & p).alias("fp"), n(y & ~p).alias("fn"), n(~y & ~p).alias("tn"))
    z = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", z(tp + tn, tp + fp + fn + tn).alias("accuracy"), z(tp, tp + fp).alias("precision"), z(tp, tp + fn).alias("recall"), z(2 * tp, 2 * tp + fp + fn).alias("f1"))


def labelled_texts(df: DataFrame, label: int) -> DataFrame:
    """Stripped, non-blank texts of a class; none at all is an error."""
    out = df.filter(F.col("label") == label).withColumn("text", F.trim("text")).filter("text is not null and text != ''")
    if not out.limit(1).count():
        raise CorpusError(f"no text of label {label}")
    return out
