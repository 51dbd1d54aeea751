"""Whole runs: corpus to splits, predictions to metrics, prompts to answers, labelled texts to classifiers' data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import text as X
from corpuslab.operators import audit as A
from corpuslab.operators import contrast as B
from corpuslab.operators import lexical as L
from corpuslab.operators import linguistic as M
from corpuslab.operators import plugins as P
from corpuslab.operators import quality as Q
from corpuslab.operators import select as S
from corpuslab.operators import shape as C
from corpuslab.operators.order import ordered_splits
from corpuslab.schema import CorpusError, assert_unique
from corpuslab.streaming.resume import pending


def prepare_corpus(corpus: DataFrame, rules: A.Rules = A.Rules(), sizes: dict[str, int] | None = None, prefix: str = "row", languages: tuple[str, str] | None = None, identify=None, require_full: bool = True) -> tuple[DataFrame, DataFrame]:
    """(audited rows with a split, summary): audited in order until the splits are full."""
    sizes = sizes or S.CORPUS_SLICES
    wanted = sum(sizes.values())
    audited = S.checkpoint(A.audit(corpus, rules, prefix, languages, identify, stop_after=wanted))
    summary = A.summary(audited, wanted)
    if require_full and not summary.first()["complete"]:
        raise CorpusError(f"less than {wanted} valid rows")
    valid = ordered_splits(audited.filter("status = 'valid'"), "original_index", sizes)
    return valid.unionByName(audited.filter("status = 'invalid'").withColumn("split", F.lit(None).cast("string"))), summary


def prepare_training_splits(train: DataFrame, test: DataFrame, reserve: DataFrame, sizes: S.SliceSizes = S.SliceSizes(), order: str = "original_index") -> tuple[DataFrame, DataFrame]:
    """(splits, report): slices, the cascade, refills from the reserve; an overlap that is left is an error."""
    slices = S.training_slices(S.core_columns(train), S.core_columns(test), order, sizes)
    flagged = S.checkpoint(S.cascade_dedup(slices))
    kept = flagged.filter("kept").drop("kept", *[f"dup_{k}" for k in S.KEYS])
    wanted = sizes.as_dict() | {"test": test.count()}
    return S.validate_disjoint(S.checkpoint(S.refill(kept, S.core_columns(reserve), wanted, order))), S.cascade_report(flagged)


def analyse(predictions: DataFrame, background: DataFrame | None = None, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with their measures, section-metric-value summary) of predictions with references.

    Background texts default to the references: profiles of frequency are never made of predictions if there
    are references."""
    assert_unique(predictions, "sentence_id", label="predictions")
    ranks = S.checkpoint(L.frequency_ranks(background if background is not None else predictions.select(F.col("reference").alias("text")), "text"))
    rows = L.row_metrics(predictions, "prediction")
    rows = Q.row_scores(rows, "prediction", "reference", "bleu", "chrf").join(L.frequency_profile(predictions, "prediction", ranks, "sentence_id"), "sentence_id", "left")
    parts = []
    for name in ("bleu", "chrf", "ter"):
        parts.append(Q.corpus_scores(predictions, "prediction", "reference", name).select(F.lit("adequacy").alias("section"), F.lit("chrf_pp" if name == "chrf" else name).alias("metric"), F.col(name).alias("value")))
    for side in ("reference", "prediction"):
        d = L.corpus_metrics(predictions.select(side), side)
        names = ["ttr", "yules_k", "yules_i", "shannon", "simpson", "inverse_simpson"]
        parts.append(d.select(*[F.col(n).cast("double").alias(n) for n in names], F.lit(f"{side}_lexical_diversity").alias("section")).unpivot(["section"], names, "metric", "value"))
        lfp = L.frequency_profile(predictions.withColumn("_all", F.lit(0)), side, ranks, "_all").drop("_all")
        parts.append(lfp.withColumn("section", F.lit(f"{side}_lexical_frequency_profile")).unpivot(["section"], ["lfp_b1", "lfp_b2", "lfp_b3"], "metric", "value"))
        if order is not None:
            streams = predictions.select(F.lit("all").alias("g"), order, side)
            parts.append(L.mattr_by_group(streams, side, order, "g").select(F.lit(f"{side}_lexical_diversity").alias("section"), F.lit("mattr").alias("metric"), F.col("mattr").alias("value")))
            parts.append(L.mtld_by_group(streams, side, order, "g").select(F.lit(f"{side}_lexical_diversity").alias("section"), F.lit("mtld").alias("metric"), F.col("mtld").alias("value")))
    summary = parts[0]
    for p in parts[1:]:
        summary = summary.unionByName(p)
    return rows, summary


def analyse_annotations(annotations: DataFrame, dictionary: DataFrame | None = None, source: DataFrame | None = None) -> dict[str, DataFrame]:
    """Summaries of an annotation table, and of synonym choice if there are a dictionary and annotated sources."""
    out = {"density": M.density(annotations), "syn_ttr": M.upos_deprel_ttr(annotations), "diversity": M.annotation_diversity(annotations), "morphology": M.lemma_form_diversity(annotations)}
    if dictionary is not None and source is not None:
        out["synonyms"] = M.synonym_summary(M.option_counts(source, annotations, dictionary))
    return out


def evaluate_split(tasks: DataFrame, done: DataFrame | None, template: str, load: Callable[[], P.Generator], units: int | None = None) -> DataFrame:
    """New predictions for the tasks (sentence_id, source, reference) that a progress log lacks; with `units`, sources are
    tagged and answers must keep the tags."""
    assert_unique(tasks, "sentence_id", label="tasks")
    todo = pending(tasks, done, "sentence_id", ("source",)) if done is not None else tasks
    text: Column = F.col("source") if units is None else F.coalesce(X.tag_units(F.col("source"), units), F.col("source"))
    out = P.generate(todo.withColumn("prompt", X.render(template, source=text)), "prompt", "raw_prediction", load)
    if units is None:
        return out.withColumn("prediction", F.col("raw_prediction"))
    got = out.withColumn("_u", X.extract_units(units)(F.col("raw_prediction")))
    return got.withColumns({"prediction": F.col("_u.text"), "sentence_boundary_contract_valid": F.col("_u.valid"), "sentence_boundary_contract_error": F.col("_u.error"), "sentence_boundary_count": F.lit(units)}).drop("_u")


def generate_negatives(references: DataFrame, models: dict[str, Callable[[], P.Generator]], template: str, attempts: int = 2, order: str = "original_index") -> DataFrame:
    """Machine translations of reference rows (id, source, target, split), models in turn, refused ones tried again; what
    every attempt refuses is left out."""
    from corpuslab.operators.order import with_position

    names = list(models)
    tasks = with_position(references, order, "_pos").withColumn("mt_model_key", C.round_robin(F.col("_pos"), names)).withColumn("prompt", X.render(template, source=F.col("source")))
    done = None
    for name in names:
        todo = tasks.filter(F.col("mt_model_key") == name)
        for n in range(1, attempts + 1):
            tried = S.checkpoint(P.generate(todo, "prompt", "text", models[name]).withColumn("reason", A.negative_reason(F.col("text"), F.col("target"))).withColumn("generation_attempt", F.lit(n)))
            good = tried.filter("reason is null")
            done = good if done is None else done.unionByName(good)
            todo = tried.filter("reason is not null").drop("text", "reason", "generation_attempt")
    return done.select(F.concat("id", F.lit("_mt")).alias("id"), F.col("id").alias("source_id"), "text", F.lit(0).alias("label"), F.lit("mt").alias("origin"), "split", "mt_model_key", "generation_attempt")


def evaluate_contrastive(scored: DataFrame, label: str = "label") -> DataFrame:
    """By split, the measures of calibrated scores; centre and scale come from the dev split. scored: split, label, htmt_score."""
    center, scale = B.calibration_parameters(scored.filter("split = 'dev'"), "htmt_score", label)
    rows = scored.withColumn("score", B.normalised(F.col("htmt_score"), F.lit(center), F.lit(scale)))
    out = None
    for split in ("dev", "test"):
        x = rows.filter(F.col("split") == split)
        m = B.binary_metrics(x, "score", label).crossJoin(B.roc_auc(x, "score", label)).withColumn("split", F.lit(split))  # one row each
        out = m if out is None else out.unionByName(m)
    return out
