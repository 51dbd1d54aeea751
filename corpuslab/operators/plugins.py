"""Plug points for models (language ID, quality scorers, annotators, generators, classifiers), with offline stand-ins.

No weights are bundled. A stand-in has the contract of its plug point and is deterministic, so plans can be built and
tested; its scores say nothing about translations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from corpuslab.functions import text as X
from corpuslab.operators.lexical import token_rows
from corpuslab.operators.select import checkpoint

LANGUAGE = "lang string, score double"

# Frequent words by language, for the stand-in.
STOP_WORDS = {"en": "the of and that with is are was this for", "de": "der die und das ist nicht mit ein von für", "fr": "le la les des est pas pour dans une avec", "es": "el los las que una por con para del en"}


def language_plugin(load: Callable[[], Callable[[str], tuple[str, float]]]) -> Callable[[Column], Column]:
    """text -> struct(lang, score). The model is loaded once a worker; null texts (rows that failed cheaper rules) are not asked."""

    @pandas_udf(LANGUAGE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = load()
        for s in batches:
            yield pd.DataFrame([(None, None) if x is None else predict(x) for x in s], columns=["lang", "score"])

    return run


def stop_word_language() -> Callable[[str], tuple[str, float]]:
    """The stand-in: the language most of whose frequent words are used, and their share."""
    sets = {k: frozenset(v.split()) for k, v in STOP_WORDS.items()}

    def predict(text: str) -> tuple[str, float]:
        words = text.lower().split()
        hits = {k: sum(w in v for w in words) for k, v in sets.items()}
        best = max(sorted(hits), key=hits.get)
        return best, hits[best] / max(1, sum(hits.values()))

    return predict


def scorer_plugin(load: Callable[[], Callable[..., list[float]]], columns: int) -> Callable[..., Column]:
    """texts... -> double, in batches; a scorer that returns another number of scores is an error."""

    def checked(score, cols) -> pd.Series:
        out = score(*[c.fillna("").tolist() for c in cols])
        if len(out) != len(cols[0]):
            raise ValueError("the scorer returned another number of scores")
        return pd.Series(out, dtype="float64")

    @pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        score = load()
        for cols in batches:
            yield checked(score, cols)

    @pandas_udf("double")
    def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = load()
        for c in batches:
            yield checked(score, (c,))

    return one if columns == 1 else run


def hash_scorer() -> Callable[..., list[float]]:
    """The stand-in: a number in 0..1 from the texts' hash."""
    return lambda *cols: [int(hashlib.md5("\u0001".join(x).encode()).hexdigest()[:8], 16) / 0xFFFFFFFF for x in zip(*cols, strict=True)]


def annotate(df: DataFrame, key: str, text: str, load: Callable[[], Callable[[str], list[tuple[str, str, str, str, str]]]], role: str) -> DataFrame:
    """Annotation rows of a text column, by a parser that gives (text, lemma, upos, feats, deprel) tuples."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = load()
        for b in batches:
            rows = [(k, role, i, *t) for k, x in zip(b[key], b[text], strict=True) for i, t in enumerate(parse(x or ""))]
            yield pd.DataFrame(rows, columns=["row_id", "role", "tok_idx", "text", "lemma", "upos", "feats", "deprel"])

    return df.select(key, text).mapInPandas(run, f"row_id {kind}, role string, tok_idx int, text string, lemma string, upos string, feats string, deprel string")


def pseudo_annotations(df: DataFrame, key: str, text: str, role: str = "target") -> DataFrame:
    """The stand-in in the JVM: lemma is a token's first four letters, tags come from its length."""
    t = token_rows(df, text, key, position=True)
    n = F.char_length("token")
    upos = F.when(F.col("token").rlike("^\\p{N}+$"), "NUM").when(n <= 2, "DET").when(n == 3, "ADP").when(n % 4 == 0, "NOUN").when(n % 4 == 1, "VERB").when(n % 4 == 2, "ADJ").otherwise("ADV")
    feats = F.concat(F.lit("Len="), (n % 3).cast("string"))
    deprel = F.when(F.col("tok_pos") == 0, "root").when(n <= 3, "det").otherwise("dep")
    return t.select(F.col(key).alias("row_id"), F.lit(role).alias("role"), F.col("tok_pos").alias("tok_idx"), F.col("token").alias("text"), F.left("token", F.lit(4)).alias("lemma"), upos.alias("upos"), feats.alias("feats"), deprel.alias("deprel"))


# Generation.

Generator = Callable[[list[str]], list[str]]


def echo_generator() -> Generator:
    """The stand-in: what follows the prompt's last line feed, in a translation block."""
    return lambda prompts: [f"<translation>{p.rsplit(chr(10), 1)[-1].strip()}</translation>" for p in prompts]


def generate(df: DataFrame, prompt: str, output: str, load: Callable[[], Generator]) -> DataFrame:
    """df with a stripped answer for each prompt: the model is loaded once a task and asked in batches."""

    @pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            out = model(s.fillna("").tolist())
            if len(out) != len(s):
                raise ValueError("the generator returned another number of answers")
            yield pd.Series([x.strip() for x in out])

    return df.withColumn(output, run(F.col(prompt)))


def prompt_chain(df: DataFrame, stages: list[tuple[str, str]], load: Callable[[], Generator], source: str = "source", target_lang: str = "eu", **rules) -> DataFrame:
    """Stages in order, each (name, template); templates may use {source}, {target_language} and earlier stages by name.

    The last stage's answer is validated; refused ones fall back to the stage before (to the raw answer if there is one
    stage); rules are further parameters of validated_answer(). Each stage is materialised once, since answers feed several
    later templates."""
    from corpuslab.operators.audit import validated_answer

    out, names = df, []
    for name, template in stages:
        fields = {"source": F.col(source), "target_language": X.language_name(F.lit(target_lang)), **{n: F.col(n) for n in names}}
        out = checkpoint(generate(out.withColumn("prompt", X.render(template, **fields)), "prompt", name, load))
        names.append(name)
    if len(names) == 1:
        return out.withColumn("prediction", F.col(names[0]))
    plain = X.strip(F.regexp_replace(F.col(names[-2]), "(?i)</?translation>", ""))
    v = validated_answer(F.col(names[-1]), plain, **rules)
    return out.withColumn("_v", v).withColumns({"prediction": F.col("_v.text"), "accepted": F.col("_v.accepted"), "reason": F.col("_v.reason")}).drop("_v")


# Count-based language models and a classifier, as stand-ins for neural ones.


def bigram_model(df: DataFrame, text: str) -> DataFrame:
    """left, right, logp: add-one smoothed log probabilities of observed bigrams (counts are grouped, no vocabulary is collected)."""
    t = X.tokens(F.col(text))
    pairs = df.select(F.explode(F.zip_with(t, F.slice(t, 2, F.greatest(F.size(t), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.struct(a.alias("left"), b.alias("right"))))).alias("p")).filter("p is not null").select("p.*")
    both = pairs.groupBy("left", "right").agg(F.count(F.lit(1)).alias("c"))
    left = both.groupBy("left").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"))
    return both.join(left, "left").select("left", "right", F.ln((F.col("c") + 1) / (F.col("n") + F.col("v") + 1)).alias("logp"))


def mean_logprob(df: DataFrame, key: str, text: str, model: DataFrame, unseen: float = -12.0) -> DataFrame:
    """key, logprob: the mean log probability of a text's bigrams; null without any."""
    t = X.tokens(F.col(text))
    pairs = df.select(key, F.explode_outer(F.filter(F.zip_with(t, F.slice(t, 2, F.greatest(F.size(t), F.lit(1))), lambda a, b: F.struct(a.alias("left"), b.alias("right"))), lambda p: p.right.isNotNull())).alias("p")).select(key, "p.*")
    scored = pairs.join(model, ["left", "right"], "left")
    return scored.groupBy(key).agg(F.avg(F.when(F.col("right").isNotNull(), F.coalesce("logp", F.lit(unseen)))).alias("logprob"))


def train_text_classifier(train: DataFrame, dev: DataFrame, text: str = "text", label: str = "label", epochs: tuple[int, ...] = (5, 10, 20), features: int = 1 << 14):
    """A logistic regression over hashed tokens; of models with more and more iterations the one with the best F1 on dev.

    Returns (transform, table of F1 by epoch); transform adds `score`, the probability of label 1."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    from corpuslab.operators.contrast import binary_metrics

    tf = HashingTF(inputCol="_tokens", outputCol="features", numFeatures=features)
    ready = lambda df: tf.transform(df.withColumn("_tokens", X.tokens(F.col(text))))
    fitted, table = [], []
    data, held = checkpoint(ready(train).select("features", F.col(label).cast("double").alias("label"))), checkpoint(dev)
    for n in epochs:
        model = LogisticRegression(maxIter=n, regParam=0.01).fit(data)

        def transform(df: DataFrame, model=model) -> DataFrame:
            return model.transform(ready(df.withColumnRenamed(label, "_label") if label in df.columns else df)).withColumn("score", vector_to_array("probability")[1]).drop("_tokens", "features", "rawPrediction", "probability", "prediction").withColumnRenamed("_label", label)

        f1 = binary_metrics(transform(held), "score", label).first()["f1"]
        fitted.append(transform)
        table.append((n, f1))
    best = max(range(len(table)), key=lambda i: (table[i][1], -i))
    return fitted[best], table
