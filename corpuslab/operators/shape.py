"""Training records: chunks, assignments, interleaved examples, chats, packs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import text as X
from corpuslab.operators.order import with_position
from corpuslab.schema import CorpusError, assert_not_blank, require_columns


def chunks(df: DataFrame, order: str = "original_index", size: int = 5, by: str = "split") -> DataFrame:
    """`size` consecutive rows of a split as one record; a remainder is left out. Records number from 1 within a split."""
    require_columns(df, order, "id", "source", "target", by, label="chunk input")
    parts = None
    for name in sorted(r[by] for r in df.select(by).distinct().collect()):  # a handful of split names
        ranked = with_position(df.filter(F.col(by) == name), order, "_pos")
        parts = ranked if parts is None else parts.unionByName(ranked)
    if parts is None:
        parts = df.withColumn("_pos", F.lit(0).cast("long"))
    rows = F.sort_array(F.collect_list(F.struct("_pos", "id", F.col(order).cast("long").alias("o"), X.strip(F.col("source")).alias("s"), X.strip(F.col("target")).alias("t"))))
    grouped = parts.groupBy(by, F.floor(F.col("_pos") / size).cast("long").alias("c")).agg(rows.alias("r")).filter(F.size("r") == size)
    take = lambda f: F.transform("r", lambda x: x[f])
    return grouped.select(
        F.format_string("%s_chunk_%06d", F.col(by), F.col("c") + 1).alias("id"), F.array_join(take("s"), "\n\n").alias("source"), F.array_join(take("t"), "\n\n").alias("target"),
        take("id").alias("source_ids"), take("o").alias("original_indices"), F.col(by), F.lit(size).alias("chunk_size_sentences"), F.col("c").alias("position"),
    )


def round_robin(position: Column, names: list[str]) -> Column:
    """names[position % n] for 0-based positions."""
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(position, F.lit(len(names))) + 1).cast("int"))


def reference_examples(df: DataFrame, language: str) -> DataFrame:
    return df.select(F.concat("id", F.lit("_ref")).alias("id"), F.col("id").alias("source_id"), F.col("target").alias("text"), F.lit(1).alias("label"), F.lit("reference").alias("origin"), F.lit(language).alias("language"), "split")


def interleave(references: DataFrame, negatives: DataFrame, key: str = "source_id") -> DataFrame:
    """Each reference (label 1) followed by its machine translation (label 0): `position` and descending label give the order.
    References without a negative go."""
    both = references.join(negatives.select(key), key, "left_semi").unionByName(negatives, allowMissingColumns=True)
    return both


def combine_outputs(prepared: DataFrame, predictions: DataFrame, language: str) -> DataFrame:
    """Balanced examples from prepared chunks and their predictions; ids must match one to one and no text may be blank."""
    ids = prepared.select("id").join(predictions.select(F.col("sentence_id").alias("id"), F.lit(1).alias("_p")), "id", "full_outer")
    missing = [r["id"] for r in prepared.select("id").join(predictions.select(F.col("sentence_id").alias("id")), "id", "left_anti").orderBy("id").limit(5).collect()]
    extra = [r["sentence_id"] for r in predictions.select("sentence_id").join(prepared.select(F.col("id").alias("sentence_id")), "sentence_id", "left_anti").orderBy("sentence_id").limit(5).collect()]
    if missing or extra or ids.count() != prepared.count():
        raise CorpusError(f"ids without prediction {missing}, unknown ids {extra}")
    assert_not_blank(predictions, "prediction", label="predictions")
    joined = prepared.join(predictions.select(F.col("sentence_id").alias("id"), "prediction", "model_key"), "id")
    label = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.lit(o).alias("origin"), t.alias("text"), F.lit(s).alias("suffix")) for n, o, t, s in ((1, "reference", F.col("target"), "_ref"), (0, "mt", F.col("prediction"), "_mt"))])).alias("x")
    return joined.select("id", "split", "position", "model_key", label).select(
        F.concat("id", "x.suffix").alias("id"), F.col("id").alias("source_id"), "x.text", "x.label", "x.origin", F.lit(language).alias("language"), "split", F.when(F.col("x.label") == 0, F.col("model_key")).alias("mt_model_key"), "position"
    )


def chat_records(df: DataFrame, template: str, source_lang: Column, target_lang: Column, system: str | None = None) -> DataFrame:
    """id, source, target, language, messages with the answer as the last turn."""
    user = X.render(template, source=F.col("source"), source_language=X.language_name(source_lang), target_language=X.language_name(target_lang))
    return df.select("id", "source", "target", target_lang.alias("language"), X.messages(user, F.lit(system) if system else None, F.col("target")).alias("messages"))


def rl_records(df: DataFrame, template: str, source_lang: Column, target_lang: Column) -> DataFrame:
    prompt = X.render(template, source=F.col("source"), source_language=X.language_name(source_lang), target_language=X.language_name(target_lang))
    return df.select(F.col("id").alias("sentence_id"), prompt.alias("prompt"), "source", F.col("target").alias("reference"))


def model_messages(chat: Column, family: str) -> Column:
    """The chat as a family of models takes it: `parts` wraps contents, `single` folds the system turn into the user's."""
    if family == "parts":
        return X.content_parts(chat)
    if family == "single":
        return F.array(X.message("user", F.array_join(F.transform(F.filter(chat, lambda m: m.role != "assistant"), lambda m: m.content), "\n\n")))
    return chat


def pack(df: DataFrame, order: str, length: str, budget: int = 512, group: str | None = None) -> DataFrame:
    """pack and offset of each row: rows in order fill a pack until the next would exceed the budget.

    An ordered fold, so it runs once a group in its order; groups (shards of a corpus) are independent and
    stream through a task without being held.
    """
    key = group or "_all"
    rows = df if group else df.withColumn("_all", F.lit(0))
    schema = f"{key} {dict(rows.dtypes)[key]}, {order} long, pack long, pack_offset long, {length} long"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, used, now = 0, 0, object()
        for b in batches:
            packs, offsets = [], []
            for g, n in zip(b[key], b[length], strict=True):
                if g != now:
                    now, at, used = g, 0, 0
                elif used + n > budget and used:
                    at, used = at + 1, 0
                packs.append(at)
                offsets.append(used)
                used += n
            yield pd.DataFrame({key: b[key], order: b[order], "pack": packs, "pack_offset": offsets, length: b[length]})

    ordered = rows.select(key, F.col(order).cast("long"), F.col(length).cast("long")).repartition(key).sortWithinPartitions(key, order)
    out = ordered.mapInPandas(fold, schema)
    return out if group else out.drop("_all")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays."""
    same = F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))), lambda i: F.coalesce(F.try_element_at(a, i) == F.try_element_at(b, i), F.lit(False)))
    first_off = F.array_position(same, F.lit(False))
    return F.when(first_off > 0, first_off - 1).otherwise(F.least(F.size(a), F.size(b)).cast("long"))


def mask_labels(prompt_ids: Column, full_ids: Column, mask: int = -100) -> Column:
    """The ids of a whole example with those of its prompt masked."""
    n = common_prefix(prompt_ids, full_ids)
    return F.transform(full_ids, lambda x, i: F.when(i < n, F.lit(mask)).otherwise(x))


def token_examples(df: DataFrame, prompt_ids: str, full_ids: str, length: int, eos: int | None = None, mask: int = -100) -> DataFrame:
    """df with input_ids, attention_mask and labels: the whole example with an end token unless it has one, cut to `length`;
    labels of the prompt are masked. A row whose labels are all masked is an error. Null arrays count as empty."""
    if length <= 0:
        raise CorpusError("the length must be positive")
    empty = F.array().cast(dict(df.dtypes)[full_ids])
    ids, prompt = F.coalesce(F.col(full_ids), empty), F.coalesce(F.col(prompt_ids), empty)
    if eos is not None:
        ended = F.coalesce(F.try_element_at(ids, F.lit(-1)) == eos, F.lit(False))
        ids = F.when(ended, ids).otherwise(F.concat(ids, F.array(F.lit(eos)).cast(dict(df.dtypes)[full_ids])))
    out = df.withColumn("input_ids", F.slice(ids, 1, length)).withColumn("_prompt", prompt)
    out = out.withColumn("labels", mask_labels(F.col("_prompt"), F.col("input_ids"), mask)).drop("_prompt")
    out = out.withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1)))
    unlearnable = F.forall("labels", lambda x: x == mask)
    return out.withColumn("labels", F.when(unlearnable, F.raise_error(F.lit(f"an example has no label within {length} tokens")).cast(dict(out.dtypes)["labels"])).otherwise(F.col("labels")))


def pad(ids: Column, size: Column, value: int = 0) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(size - F.size(ids), F.lit(0)).cast("int")))


def batch_plan(devices: int, per_device: int, group: int, wanted: int) -> dict[str, int]:
    """Accumulation steps so that a batch of `wanted` completions is whole groups on all devices."""
    step = devices * per_device
    if wanted % step or wanted % group:
        raise CorpusError(f"a batch of {wanted} is no multiple of {step} and {group}")
    return {"per_step": step, "accumulation": wanted // step, "groups": wanted // group}
