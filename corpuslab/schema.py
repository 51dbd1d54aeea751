"""Schemas of the engine's tables, and checks that raise before work is done on bad ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CorpusError(ValueError):
    """A table breaks a contract of the engine."""


def ddl(s: str) -> str:
    return s


RAW_PAIR = ddl("original_index bigint, source string, target string, corpus string, domain string, type string, corpus_alignment double")
AUDITED = ddl("id string, source string, target string, status string, reason string, corpus string, original_index bigint")
EXAMPLE = ddl("id string, source_id string, text string, label int, origin string, language string, split string")
PAIRED_TEST = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("reference_run", "candidate", "metric", "direction", "status")]
    + [T.StructField("n", T.LongType())]
    + [T.StructField(n, T.DoubleType()) for n in ("reference_mean", "candidate_mean", "difference", "ci_low", "ci_high", "p_value", "p_holm")]
)


def require_columns(df: DataFrame, *cols: str, label: str = "table") -> DataFrame:
    if missing := sorted(set(cols) - set(df.columns)):
        raise CorpusError(f"{label} lacks columns {missing}")
    return df


def assert_none(bad: DataFrame, what: str) -> None:
    """Raise if there is a row; up to five are shown."""
    if rows := bad.limit(5).collect():
        raise CorpusError(f"{what}: {[r.asDict() for r in rows]}")


def assert_unique(df: DataFrame, *key: str, label: str = "table") -> DataFrame:
    assert_none(df.groupBy(*key).count().filter("count > 1"), f"{label} repeats {key}")
    return df


def assert_not_blank(df: DataFrame, *cols: str, label: str = "table") -> DataFrame:
    for c in cols:
        assert_none(df.filter(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "").select(c), f"{label} has a blank {c}")
    return df


def assert_disjoint(a: DataFrame, b: DataFrame, key: str, what: str) -> None:
    assert_none(a.select(key).join(b.select(key), key, "left_semi").distinct(), f"{what} share {key}")
