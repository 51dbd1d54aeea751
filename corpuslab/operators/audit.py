"""Ordered first-failure audits of parallel text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import text as X
from corpuslab.operators.order import take_until
from corpuslab.schema import CorpusError, require_columns


@dataclass(frozen=True)
class Rules:
    """Limits of the audit; the defaults are those of the parallel corpora."""

    min_chars: int = 1
    max_chars: int = 2000
    require_letter: bool = True
    min_tokens: int = 3
    max_tokens: int = 250
    min_ratio: float = 0.25
    max_ratio: float = 4.0
    min_confidence: float = 0.80
    domains: tuple[str, ...] | None = None
    normalise: bool = True


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that holds, else null."""
    out = F.lit(None).cast("string")
    for bad, name in reversed(rules):
        out = F.when(bad, F.lit(name)).otherwise(out)
    return out


def text_reason(c: Column, side: str, r: Rules) -> Column:
    n = F.char_length(c)
    rules = [(F.coalesce(c, F.lit("")) == "", f"{side}_empty"), (n < r.min_chars, f"{side}_too_short"), (n > r.max_chars, f"{side}_too_long")]
    return first_reason(*rules, *([(~X.has_letter(c), f"{side}_no_alphabetic")] if r.require_letter else []))


def length_reason(source: Column, target: Column, r: Rules, source_tokens: Column | None = None, target_tokens: Column | None = None) -> Column:
    """Token counts may be given as columns, so that they are made once for all rules."""
    s = F.greatest(X.n_space_tokens(source) if source_tokens is None else source_tokens, F.lit(1).cast("long"))
    t = F.greatest(X.n_space_tokens(target) if target_tokens is None else target_tokens, F.lit(1).cast("long"))
    chars = F.char_length(target) / F.greatest(F.char_length(source), F.lit(1))
    out = lambda x: (x < r.min_ratio) | (x > r.max_ratio)
    return first_reason(
        (s < r.min_tokens, "source_too_few_tokens"), (t < r.min_tokens, "target_too_few_tokens"), (s > r.max_tokens, "source_too_many_tokens"),
        (t > r.max_tokens, "target_too_many_tokens"), (out(t / s), "token_ratio_out_of_range"), (out(chars), "char_ratio_out_of_range"),
    )


def language_reason(lang: Column, score: Column, wanted: str, side: str, r: Rules) -> Column:
    """Rejects what is not confidently right."""
    return F.when((lang != wanted) | (score < r.min_confidence) | lang.isNull() | score.isNull(), F.lit(f"{side}_language_mismatch"))


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that the optimizer computes once: it neither copies them into later expressions nor moves filters on
    them below. A chain of rules on regular expressions would otherwise be copied into each rule, beyond what a generated
    method may hold, and the whole stage would be interpreted."""
    return df.withColumns({name: F.when(F.monotonically_increasing_id() >= 0, c) for name, c in columns.items()})


def audit(df: DataFrame, rules: Rules = Rules(), prefix: str = "row", languages: tuple[str, str] | None = None, identify=None, stop_after: int | None = None) -> DataFrame:
    """Every row with its status and the first rule it breaks, in the order: domain, source text, target text, language,
    length, duplicate pair.

    identify(column) (or one function for each side) gives struct(lang, score); it is asked only for rows that passed the cheap rules (others
    hand it null). A row that breaks a rule never claims its pair: of equal pairs the first that passes all
    else stays. With stop_after, rows behind the n-th valid one are not in the result at all.
    """
    require_columns(df, "original_index", "source", "target", label="corpus")
    clean = (lambda c: X.normalize_text(c)) if rules.normalise else (lambda c: F.coalesce(c, F.lit("")))
    rows = settled(df, source=clean(F.col("source")), target=clean(F.col("target")))
    cheap = [text_reason(F.col("source"), "source", rules), text_reason(F.col("target"), "target", rules)]
    if rules.domains is not None:
        require_columns(df, "domain", label="corpus")
        if not rules.domains:
            raise CorpusError("the list of domains is empty")
        cheap.insert(0, F.when(~F.coalesce(F.col("domain").isin(*rules.domains), F.lit(False)), F.lit("domain_filtered")))
    rows = settled(rows, _r=F.coalesce(*cheap))
    if identify is not None:
        ask = identify if isinstance(identify, tuple) else (identify, identify)
        for side, lang, scorer in zip(("source", "target"), languages, ask, strict=True):
            rows = rows.withColumn(f"_{side}", scorer(F.when(F.col("_r").isNull(), F.translate(F.col(side), "\n", " "))))
            rows = settled(rows, _r=F.coalesce("_r", language_reason(F.col(f"_{side}.lang"), F.col(f"_{side}.score"), lang, side, rules))).drop(f"_{side}")
    rows = settled(rows, **{f"_n_{side}": F.when(F.col("_r").isNull(), X.n_space_tokens(F.col(side))) for side in ("source", "target")})
    rows = settled(rows, _r=F.coalesce("_r", length_reason(F.col("source"), F.col("target"), rules, F.col("_n_source"), F.col("_n_target")))).drop("_n_source", "_n_target")
    # pairs that stand more than once among passing rows, by hash: partial sums, so a frequent pair is no hot task
    key = F.xxhash64("source", "target")
    first = rows.filter("_r is null").groupBy(key.alias("_k"), F.md5(F.concat_ws("\u0001", "source", "target")).alias("_m")).agg(F.min("original_index").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    rows = rows.withColumn("_k", key).withColumn("_m", F.md5(F.concat_ws("\u0001", "source", "target"))).join(first, ["_k", "_m"], "left")
    rows = rows.withColumn("reason", F.coalesce("_r", F.when(F.col("original_index") > F.col("_first"), F.lit("duplicate_pair")))).drop("_r", "_k", "_m", "_first")
    rows = rows.withColumn("status", F.when(F.col("reason").isNull(), "valid").otherwise("invalid")).withColumn("id", X.row_id(prefix, F.col("original_index")))
    if stop_after is not None:
        rows = take_until(rows, F.col("reason").isNull(), "original_index", stop_after)
    core = ["id", "source", "target", "status", "reason", *(["corpus"] if "corpus" in df.columns else []), "original_index"]
    return rows.select(*core, *[c for c in df.columns if c not in core])


def reason_histogram(audited: DataFrame) -> DataFrame:
    return audited.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def selection_summary(candidates: DataFrame, reason: Column, score: Column) -> DataFrame:
    """One row: rows scanned and selected (those without a reason), and the least, mean and greatest score of these; null
    if there are none. What the others failed first is reason_histogram()."""
    taken = F.when(reason.isNull(), score.cast("double"))
    stats = [f(taken).alias(f"accepted_score_{name}") for name, f in (("min", F.min), ("mean", F.avg), ("max", F.max))]
    return candidates.agg(F.count(F.lit(1)).alias("rows_scanned"), F.count(F.when(reason.isNull(), 1)).alias("selected"), *stats)


def summary(audited: DataFrame, wanted: int | None = None) -> DataFrame:
    """One row: rows scanned, valid, invalid, and whether as many are valid as wanted."""
    valid = F.count(F.when(F.col("status") == "valid", 1))
    return audited.agg(F.count(F.lit(1)).alias("rows_scanned"), valid.alias("rows_valid"), F.count(F.when(F.col("status") == "invalid", 1)).alias("rows_invalid"), (valid >= (wanted or 0)).alias("complete"))


# Answers of a translation model.


# Phrases of commentary (in the form of functions.text.marker_form), line starts of alternatives.
COMMENTARY = ("this translation", "polished translation", "the polished", "la traduccio correcta", "la traduccio es correcta", "traduccio millorada", "a more idiomatic", "a more natural", "here is a")
ALTERNATIVES = ("\nalternatively", "\nor, ", "\notherwise", "\nanother option")
NEGATIVE_COMMENTARY = "(?i)(?:^|\\n)\\s*(?:polished translation|translation:|note:|explanation:|this translation|here(?:'s| is)|la traduccio (?:es|correcta)|traduccio millorada)"
ANSWER = f"(?is)^[{X.SPACE}]*<translation>(.*?)</translation>"


def _any_in(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def validated_answer(answer: Column, fallback: Column, wrong: Column | None = None, fold=X.marker_form, commentary: tuple[str, ...] = COMMENTARY, alternatives: tuple[str, ...] = ALTERNATIVES) -> Column:
    """struct(text, accepted, reason): the leading <translation> block, or the fallback and why it was refused.

    In order: no tags, empty, nested tags, commentary (phrases in the folded block), alternatives (phrases in the lower-case
    one), too long (over max(24, 2 n + 12) tokens for a fallback of n), and, where a scorer says so for five tokens or
    more, confidently another language.
    """
    answer, fallback = F.coalesce(answer, F.lit("")), X.strip(F.coalesce(fallback, F.lit("")))
    body = X.strip(F.regexp_extract(answer, ANSWER, 1))
    limit = F.greatest(F.lit(24).cast("long"), 2 * X.n_space_tokens(fallback) + 12)
    checks = [
        (~answer.rlike(ANSWER), "missing_translation_tags"), (body == "", "empty_translation"), (body.rlike("(?i)</?translation>"), "nested_translation_tags"),
        (_any_in(fold(body), commentary), "commentary_marker"), (_any_in(F.lower(body), alternatives), "alternatives"), (X.n_space_tokens(body) > limit, "too_long"),
    ]
    if wrong is not None:
        checks.append((wrong & (X.n_space_tokens(body) >= 5), "wrong_language"))
    reason = first_reason(*checks)
    return F.struct(F.when(reason.isNull(), body).otherwise(fallback).alias("text"), reason.isNull().alias("accepted"), reason.alias("reason"))


def negative_reason(answer: Column, reference: Column, wrong: Column | None = None) -> Column:
    """Why a machine translation can't serve as a negative example: null if it can."""
    a = X.strip(F.coalesce(answer, F.lit("")))
    checks = [(a == "", "empty"), (a.rlike("(?i)</?translation>"), "format_markup"), (X.plain_form(a).rlike(NEGATIVE_COMMENTARY), "commentary_marker")]
    if wrong is not None:
        checks.append((wrong & (X.n_space_tokens(a) >= 5), "wrong_language"))
    return first_reason(*checks, (a == X.strip(F.coalesce(reference, F.lit(""))), "matches_reference"))


def lexically_valid(candidate: Column, reference: Column) -> Column:
    """A reference with letters wants a candidate with letters."""
    return ~X.has_letter(reference) | X.has_letter(candidate)


def answer_summary(df: DataFrame, accepted: str = "accepted", reason: str = "reason") -> DataFrame:
    """Accepted answers and refusals by reason, most frequent first."""
    return df.groupBy(F.when(F.col(accepted), F.lit("accepted")).otherwise(F.col(reason)).alias("outcome")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "outcome")
