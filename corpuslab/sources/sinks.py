"""Sinks: one folder a table, written by all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.schema import CorpusError
from corpuslab.sources.readers import exists


def save_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with columns in order of their names; nulls are written, NaN is null."""
    kinds = dict(df.dtypes)
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in sorted(df.columns)]
    df.select(*clean).write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """A progress log: each call adds files."""
    save_jsonl(df, path, "append")


def save_table(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    """CSV (or TSV with sep a tab) with a header."""
    df.write.mode(mode).option("header", "true").option("sep", sep).csv(path)


def save_splits(df: DataFrame, folder: str, by: str = "split", force: bool = False) -> list[str]:
    """A folder for each split, written in one pass; an existing one is an error unless forced."""
    if exists(df.sparkSession, folder) and not force:
        raise CorpusError(f"{folder} exists")
    df.write.mode("overwrite" if force else "errorifexists").partitionBy(by).parquet(folder)
    return sorted(r[by] for r in df.select(by).distinct().collect())


def save_audit(audited: DataFrame, summary: DataFrame, folder: str, force: bool = False) -> None:
    """The splits, the invalid rows with reasons, and the summary."""
    save_splits(audited.filter("status = 'valid' and split is not null"), f"{folder}/splits", force=force)
    mode = "overwrite" if force else "errorifexists"
    save_jsonl(audited.filter("status = 'invalid'"), f"{folder}/invalid", mode)
    save_jsonl(summary, f"{folder}/summary", mode)


def save_analysis(per_row: DataFrame, long_summary: DataFrame, folder: str, force: bool = False) -> None:
    """Per-row measures as Parquet and TSV, the summary as JSON lines and CSV."""
    mode = "overwrite" if force else "errorifexists"
    per_row.write.mode(mode).parquet(f"{folder}/per_example.parquet")
    save_table(per_row.select(*[F.col(c) if not t.startswith(("array", "struct", "map")) else F.to_json(c).alias(c) for c, t in per_row.dtypes]), f"{folder}/per_example.tsv", "\t", mode)
    save_jsonl(long_summary, f"{folder}/summary.jsonl", mode)
    save_table(long_summary, f"{folder}/summary.csv", ",", mode)
