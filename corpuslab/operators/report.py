"""Summaries as long tables, and comparison matrices of models and conditions."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sections and measures that a comparison leaves out.
LEFT_OUT_SECTIONS = ("analysis_metadata", "report_context", "implemented_metrics_note")
LEFT_OUT_KEYS = ("prediction_lexical_frequency_profile.beyond_2000", "reference_lexical_frequency_profile.beyond_2000")
LEFT_OUT_LEAVES = {
    "synonym_frequency_analysis": (
        "cdu", "ptf", "dictionary_entries", "dictionary_inverted", "dictionary_resource", "sentences_with_candidates", "source_lemmas_considered", "source_lemmas_with_matches",
        "source_lemmas_with_dictionary_entries", "sfa_source_lemmas_considered", "sfa_source_lemmas_with_dictionary_entries", "sfa_valid_source_lemmas",
    ),
    "morphological_diversity": ("morph_lemmas_used_for_entropy", "morph_multi_wordform_lemmas", "morph_single_wordform_lemmas"),
}
# Sections that are compared with the reference side, and directions of the others by leaf.
PAIRED_SECTIONS = ("lexical_diversity", "lexical_frequency_profile", "morphological_diversity", "synonym_frequency_analysis")
DISTANCES = ("ted", "word_cross", "seq_cross", "sacr_cross")
LESS = ("ter", "metricx", *DISTANCES, "yules_k", "simpson_d")
MORE = ("bleu", "chrf_pp", "comet", "xcomet", "cometkiwi", "ttr", "mtld", "yules_i")


def unpivot(df: DataFrame, section: Column, values: list[str], *keys: str) -> DataFrame:
    """keys, section, metric, value: one row for each value column."""
    return df.select(*keys, section.alias("section"), *[F.col(v).cast("double").alias(v) for v in values]).unpivot([*keys, "section"], values, "metric", "value")


def flatten(tree: dict, spark: SparkSession, excluded: tuple[str, ...] = ("meta",)) -> DataFrame:
    """section, metric, value of a nested summary: finite numbers, no booleans; scalars at the top are under `meta`."""
    rows = []

    def walk(path: list[str], x) -> None:
        if isinstance(x, dict):
            for k, v in x.items():
                walk([*path, str(k)], v)
        elif isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x):
            section = path[0] if len(path) > 1 else "meta"
            if section not in excluded:
                rows.append((section, ".".join(path[1:]) or path[0], float(x)))

    walk([], tree)
    return spark.createDataFrame(rows, "section string, metric string, value double")


def flatten_json(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """The same for a column of two-level JSON summaries, in the JVM."""
    tree = F.from_json(F.col(column), "map<string,map<string,string>>")
    rows = df.select(*keys, F.explode(tree).alias("section", "m")).select(*keys, "section", F.explode("m").alias("metric", "raw"))
    value = F.expr("try_cast(raw as double)")
    return rows.select(*keys, "section", "metric", value.alias("value")).filter("value is not null and not isnan(value) and abs(value) < double('infinity')")


def _section(key: Column) -> Column:
    return F.when(F.instr(key, ".") > 0, F.regexp_extract(key, r"^(.*)\.[^.]*$", 1)).otherwise("")


def _leaf(key: Column) -> Column:
    return F.substring_index(key, ".", -1)


def metric_key(key: Column) -> Column:
    """The name under which both sides' measures meet: a section without reference_ or prediction_."""
    return F.when(F.instr(key, ".") > 0, F.regexp_replace(key, "^(reference|prediction)_", "")).otherwise(key)


def side(key: Column) -> Column:
    """Reference for sections of the reference (and of source against reference), else translation."""
    return F.when(F.startswith(_section(key), F.lit("reference_")) | (_section(key) == "astred_source_reference"), "reference").otherwise("translation")


def interpretation(key: Column) -> Column:
    """What a difference means, from the key without its side."""
    section, leaf = _section(key), _leaf(key)
    # fixed values: the wordings
    by_side = F.when(section == "astred_source_prediction", "lower means closer to source structure").when(section == "astred_source_reference", "human reference structural distance from source; comparison baseline").otherwise("lower means closer to reference structure")
    return (
        F.when(section == "adequacy", F.when(leaf.isin("ter", "metricx"), "lower is better").otherwise("higher is better"))
        .when(section.isin(*PAIRED_SECTIONS), "closer to reference is better")
        .when(section.isin("astred", "astred_source_prediction", "astred_source_reference"), F.when(leaf.isin(*DISTANCES), by_side).otherwise(""))
        .when(section == "classifier_reference_likeness", "higher means more reference-like according to the named classifier")
        .when(leaf.isin(*LESS), "lower is better").when(leaf.isin(*MORE), "higher is better").otherwise("")
    )


def compared_metric(key: Column) -> Column:
    out = ~_section(key).isin(*LEFT_OUT_SECTIONS) & ~key.isin(*LEFT_OUT_KEYS)
    base = F.regexp_replace(_section(key), "^(reference|prediction)_", "")
    for section, leaves in LEFT_OUT_LEAVES.items():
        out = out & ~((base == section) & _leaf(key).isin(*leaves))
    return out


def comparison_matrix(values: DataFrame, columns: list[str], planned: list[str] = ()) -> DataFrame:
    """metric_group, metric, direction, reference, and a column for each condition.

    values: model_condition, section, metric, value, seq. The reference score is the first seen (least seq)
    of a key; the conditions are known beforehand, so the pivot needs no pass to find them, and planned ones
    without values stay as empty columns."""
    keyed = values.withColumn("key", F.concat_ws(".", "section", "metric")).filter(compared_metric(F.col("key"))).withColumn("side", side(F.col("key"))).withColumn("key", metric_key(F.col("key")))
    reference = keyed.filter("side = 'reference'").groupBy("key").agg(F.min_by("value", "seq").alias("reference_score"))
    names = list(dict.fromkeys([*columns, *planned]))
    wide = keyed.filter("side = 'translation'").groupBy("key").pivot("model_condition", names).agg(F.min_by("value", "seq"))
    both = wide.join(reference, "key", "full_outer")
    title = lambda c: F.initcap(F.translate(c, "_", " "))
    return both.select(title(F.regexp_extract("key", r"^(.*)\.[^.]*$", 1)).alias("metric_group"), title(F.substring_index("key", ".", -1)).alias("metric"), interpretation(F.col("key")).alias("direction"), "reference_score", *[F.col(f"`{n}`") for n in names])


def boundary_summary(df: DataFrame) -> DataFrame:
    """Rows that keep the sentence-boundary contract, and the expected number of sentences if all rows have the same."""
    valid = F.count(F.when(F.col("sentence_boundary_contract_valid"), 1))
    return df.agg(valid.alias("valid"), (F.count(F.lit(1)) - valid).alias("invalid"), F.try_divide(valid.cast("double"), F.count(F.lit(1)).cast("double")).alias("valid_ratio"), F.when(F.min("sentence_boundary_count") == F.max("sentence_boundary_count"), F.min("sentence_boundary_count")).alias("expected_count"))


def save_json(path: str, value) -> None:
    """A driver-side JSON file: indented, keys sorted, a line end."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n")
