"""Derived views of the driver's tables that stand in for parallel corpora, predictions and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslab.functions import text as X

#: Pairs that are appended again with new indexes, so that exact duplicates occur.
REPEATED, SHIFT = 50, 10_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the next one of its source."""
    w = Window.partitionBy("source").orderBy("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text", "lang")
    return d.select(F.col("doc_id").alias("original_index"), F.col("source").alias("domain"), F.lit("docs").alias("corpus"), F.col("text").alias("source"), F.lead("text").over(w).alias("target"), F.col("lang").alias("source_lang"), F.lead("lang").over(w).alias("target_lang")).filter("target is not null")


def pairs_doc_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs_doc(spark, sf_dir)
    again = p.orderBy("original_index").limit(REPEATED).withColumn("original_index", F.col("original_index") + SHIFT)
    return p.unionByName(again)


def pairs_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn that follows."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    u, a = c.filter("role = 'user'"), c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    return u.join(a, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("original_index"), "conv_id", "turn", F.col("text").alias("source"), "target")


PAIRS_DOC = "pairs_doc as (select doc_id as original_index, source as domain, text as source, lead(text) over w as target, lang as source_lang, lead(lang) over w as target_lang from documents window w as (partition by source order by doc_id) qualify lead(text) over w is not null)"
PAIRS_DUP = PAIRS_DOC + f", pairs as (select * from pairs_doc union all select original_index + {SHIFT}, domain, source, target, source_lang, target_lang from (select * from pairs_doc order by original_index limit {REPEATED}))"
PAIRS_CONV = "pairs_conv as (select u.conv_id * 1000 + u.turn as original_index, u.conv_id, u.turn, u.text as source, a.text as target from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant')"

WS = r"\t-\r\x1c-\x20\x{85}\p{Z}"


def sql_norm(c: str) -> str:
    zero = "translate(replace(nfc_normalize(coalesce(" + c + r", '')), chr(160), ' '), concat(chr(8203), chr(8204), chr(8205), chr(65279)), '')"
    return rf"regexp_replace(regexp_replace({zero}, '[{WS}]+', ' ', 'g'), '^[{WS}]+|[{WS}]+$', '', 'g')"


def sql_ws(c: str) -> str:
    return rf"len(regexp_extract_all({c}, '[^{WS}]+'))"


def sql_tokens(c: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}_]+')"


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five splits with shared texts: pairs dealt by id, so that copies of whole texts fall into several."""
    names = F.array(*map(F.lit, ("test", "sft_train", "sft_dev", "grpo_train", "grpo_dev")))
    i = F.col("original_index")
    return pairs_doc(spark, sf_dir).select(F.concat(F.lit("d"), i.cast("string")).alias("id"), F.lower("source").alias("source"), "target", F.element_at(names, (i % 5 + 1).cast("int")).alias("split"), "original_index")


SPLITS = PAIRS_DOC + ", splits as (select 'd' || original_index as id, lower(source) as source, target, (['test', 'sft_train', 'sft_dev', 'grpo_train', 'grpo_dev'])[original_index % 5 + 1] as split, original_index from pairs_doc)"


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslab.operators.plugins import pseudo_annotations

    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return pseudo_annotations(d, "doc_id", "text").join(d.select(F.col("doc_id").alias("row_id"), "lang"), "row_id")


ANNOTATIONS = rf"""tok as (select doc_id as row_id, lang, unnest({sql_tokens("text")}) as text, unnest(range(0, len({sql_tokens("text")}))) as tok_idx from documents),
ann as (select row_id, lang, tok_idx, text, left(text, 4) as lemma, 'Len=' || (length(text) % 3) as feats,
  case when regexp_matches(text, '^\p{{N}}+$') then 'NUM' when length(text) <= 2 then 'DET' when length(text) = 3 then 'ADP' when length(text) % 4 = 0 then 'NOUN' when length(text) % 4 = 1 then 'VERB' when length(text) % 4 = 2 then 'ADJ' else 'ADV' end as upos,
  case when tok_idx = 0 then 'root' when length(text) <= 3 then 'det' else 'dep' end as deprel from tok)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a deterministic score."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", F.col("quality").cast("int").alias("label"), ((F.col("n_chars") * 37 + F.col("quality") * 400) % 1000 / 1000.0).alias("score"), (-(F.col("n_chars") % 97) / 10.0 + F.col("quality")).alias("ht"), (-(F.col("n_chars") % 89) / 10.0).alias("mt"))


SCORES = "scores as (select doc_id, cast(quality as integer) as label, ((n_chars * 37 + quality * 400) % 1000) / 1000.0::double as score, -(n_chars % 97) / 10.0::double + quality as ht, -(n_chars % 89) / 10.0::double as mt from labels join documents using (doc_id))"


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two prediction runs over the same rows, with row measures as the compared metric."""
    p = pairs_doc(spark, sf_dir)
    base = p.select(F.format_string("s%09d", "original_index").alias("sentence_id"), "source", F.col("target").alias("reference"), "original_index")
    ttr = lambda c: F.try_divide(F.size(F.array_distinct(X.tokens(F.col(c)))).cast("double"), F.size(X.tokens(F.col(c))).cast("double"))
    return base.withColumn("ttr", ttr("source")), base.withColumn("ttr", ttr("reference"))


RUNS = rf"""{PAIRS_DOC}, runs as (select original_index, len(list_distinct({sql_tokens("source")})) / nullif(len({sql_tokens("source")}), 0)::double as x, len(list_distinct({sql_tokens("target")})) / nullif(len({sql_tokens("target")}), 0)::double as y from pairs_doc),
paired as (select original_index, x, y, row_number() over (order by original_index) - 1 as slot from runs where x is not null and y is not null)"""
