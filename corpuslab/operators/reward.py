"""Rewards of translations: component scores, weights, ablations."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import text as X
from corpuslab.operators.audit import lexically_valid
from corpuslab.operators.quality import bleu_counts, bleu_score
from corpuslab.schema import CorpusError, assert_none


@dataclass(frozen=True)
class Weights:
    chrfpp: float = 0.0
    bleu: float = 0.0
    cometkiwi: float = 0.0
    comet: float = 0.0
    self_bleu: float = 0.0
    length: float = 0.0
    reference_likeness: float = 0.0

    def validate(self) -> Weights:
        values = asdict(self).values()
        if min(values) < 0 or abs(sum(values) - 1) > 1e-8:
            raise CorpusError(f"weights must be non-negative and sum to 1: {self}")
        return self


# The ablations. a3v2 to a3v5 are a3 with another scorer behind reference_likeness.
ABLATIONS = {
    "a0": Weights(chrfpp=0.45, cometkiwi=0.55),
    "a1": Weights(chrfpp=0.40, cometkiwi=0.50, length=0.10),
    "a2": Weights(chrfpp=0.30, cometkiwi=0.40, self_bleu=0.20, length=0.10),
    "a3": Weights(chrfpp=0.25, cometkiwi=0.35, reference_likeness=0.15, self_bleu=0.15, length=0.10),
    "a4": Weights(chrfpp=0.30, cometkiwi=0.40, reference_likeness=0.20, length=0.10),
    "a5": Weights(bleu=0.30, comet=0.40, self_bleu=0.20, length=0.10),
}
ABLATIONS |= {name: ABLATIONS["a3"] for name in ("a3v2", "a3v3", "a3v4", "a3v5")}


def clip_unit(c: Column) -> Column:
    """To 0..1; an undefined score raises no error but is null."""
    return F.when(~F.isnan(c), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def length_penalty(candidate: Column, reference: Column) -> Column:
    """max(-|ln(candidate tokens / reference tokens)|, -2); -2 if either has none."""
    g, r = X.n_space_tokens(candidate), X.n_space_tokens(reference)
    return F.when((g == 0) | (r == 0), F.lit(-2.0)).otherwise(F.greatest(-F.abs(F.ln(g / F.greatest(r, F.lit(1)))), F.lit(-2.0)))


def total(weights: Weights, components: dict[str, Column], candidate: Column, reference: Column) -> Column:
    """The weighted sum of the components (those without weight count as 0); -1 for a blank candidate or one without the
    letters that its reference has."""
    used = [F.lit(w) * F.coalesce(components[k], F.lit(0.0)) for k, w in asdict(weights.validate()).items() if w]
    value = used[0]
    for x in used[1:]:
        value = value + x
    blank = X.strip(F.coalesce(candidate, F.lit(""))) == ""
    return F.when(blank | ~lexically_valid(candidate, reference), F.lit(-1.0)).otherwise(value)


def ablations(df: DataFrame, components: dict[str, str], candidate: str, reference: str, table: dict[str, Weights] = ABLATIONS) -> DataFrame:
    """A row for each row and ablation: one projection with an array of totals, exploded."""
    cols = {k: F.col(v) for k, v in components.items()}
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("ablation"), total(w, cols, F.col(candidate), F.col(reference)).alias("reward")) for n, w in table.items()])).alias("x")
    return df.select("*", rows).select(*df.columns, "x.ablation", "x.reward")


def check_groups(df: DataFrame, group: str, source: str = "source", reference: str = "reference") -> DataFrame:
    """Every group shares one source and one reference, else an error."""
    assert_none(df.groupBy(group).agg(F.count_distinct(source).alias("s"), F.count_distinct(reference).alias("r")).filter("s > 1 or r > 1"), "groups mix sources or references")
    return df


def self_bleu_diversity(df: DataFrame, group: str, text: str, key: str, most: int = 1024) -> DataFrame:
    """key, diversity: 1 - the mean BLEU (0..1) of a candidate against the others of its group; equal texts count as 1.

    A group is the few candidates of one prompt; more than `most` raise, since all pairs are the measure itself."""
    assert_none(df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most), f"groups of more than {most} candidates")
    types = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [(x or "").strip() for x in pdf[text]]
        out = []
        for i, a in enumerate(texts):
            others = [1.0 if a == b else min(1.0, bleu_score([float(v) for v in bleu_counts(a, b)]) / 100) for j, b in enumerate(texts) if j != i]
            out.append(1 - sum(others) / len(others) if others else 0.0)
        return pd.DataFrame({group: pdf[group], key: pdf[key], "diversity": out})

    return df.select(group, key, text).groupBy(group).applyInPandas(run, f"{group} {types[group]}, {key} {types[key]}, diversity double")


def distributed_rewards(df: DataFrame, group: str) -> DataFrame:
    """Rows with all of a group in one partition, for scorers that look at a whole group."""
    return df.repartition(group)
