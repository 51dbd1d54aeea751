"""Morphology, density, synonym choice and syntax aggregates over annotation tables.

An annotation table has a row a token: row_id, role, tok_idx, text, lemma, upos, feats, deprel.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from corpuslab.operators.lexical import diversity, ratio, uniform_distance

# Parts of speech.
CONTENT_UPOS = ("NOUN", "PROPN", "VERB", "ADJ", "ADV")
FUNCTION_UPOS = ("ADP", "AUX", "CCONJ", "DET", "PART", "PRON", "SCONJ")
SYNONYM_UPOS = ("NOUN", "VERB", "ADJ")
NOT_WORDS = ("PUNCT", "SYM", "NUM")


def density(annotations: DataFrame, *by: str) -> DataFrame:
    """Content and function words, their shares and ratios; null on a zero denominator."""
    count = lambda tags: F.count(F.when(F.col("upos").isin(*tags), 1))
    n = annotations.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), count(CONTENT_UPOS).alias("content"), count(FUNCTION_UPOS).alias("function"))
    return n.select(*by, "n", "content", "function", ratio(F.col("content"), F.col("n")).alias("lexical_density"), ratio(F.col("function"), F.col("content")).alias("function_to_content"), ratio(F.col("content"), F.col("function")).alias("content_to_function"), ratio(F.col("function"), F.col("n")).alias("function_proportion"))


def upos_deprel_ttr(annotations: DataFrame, *by: str) -> DataFrame:
    c = annotations.groupBy(*by, F.concat_ws(":", "upos", "deprel").alias("pair")).agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy(*by).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).select(*by, ratio(F.col("v"), F.col("n")).alias("syn_ttr"))


def annotation_diversity(annotations: DataFrame, *by: str) -> DataFrame:
    """by, layer (form, lemma, feats), types and diversity: the layers in one pass, as one more grouping key."""
    layers = F.explode(F.array(*[F.struct(F.lit(n).alias("layer"), F.col(c).alias("value")) for n, c in (("form", "text"), ("lemma", "lemma"), ("feats", "feats"))])).alias("x")
    counts = annotations.select(*by, layers).select(*by, "x.layer", "x.value").filter("value is not null and value != ''").groupBy(*by, "layer", "value").agg(F.count(F.lit(1)).alias("c"))
    return diversity(counts, *by, "layer").select(*by, "layer", F.col("v").alias("types"), "shannon", "simpson", "inverse_simpson")


def lemma_form_diversity(annotations: DataFrame, *by: str) -> DataFrame:
    """Unweighted means over lemmas with two forms or more of the diversity of their forms; numbers of such and other lemmas."""
    clean = lambda c: F.lower(F.trim(c))
    lemma = F.coalesce(F.nullif(F.trim("lemma"), F.lit("")), F.col("text"))
    words = annotations.filter(~F.coalesce(F.col("upos"), F.lit("")).isin(*NOT_WORDS)).select(*by, clean(lemma).alias("l"), clean(F.col("text")).alias("f")).filter("l != '' and f != ''")
    counts = words.groupBy(*by, "l", "f").agg(F.count(F.lit(1)).alias("c"))
    per = diversity(counts, *by, "l")
    several = F.col("v") >= 2
    mean = lambda c: F.avg(F.when(several, F.col(c)))
    return per.groupBy(*by).agg(F.count(F.when(several, 1)).alias("multi_form_lemmas"), F.count(F.when(~several, 1)).alias("single_form_lemmas"), mean("shannon").alias("shannon"), mean("simpson").alias("simpson"), mean("inverse_simpson").alias("inverse_simpson"))


# Synonym frequency analysis.


def eligible_lemmas(source: DataFrame, dictionary: DataFrame, key: str = "row_id") -> DataFrame:
    """Distinct (row, lemma) of nouns, verbs and adjectives that the dictionary has."""
    return source.filter(F.col("upos").isin(*SYNONYM_UPOS)).select(key, F.col("lemma")).distinct().join(dictionary.select("lemma").distinct(), "lemma", "left_semi")


def option_counts(source: DataFrame, target: DataFrame, dictionary: DataFrame, key: str = "row_id") -> DataFrame:
    """lemma, option, count: how often an option stands in the targets of the rows whose source has the lemma; zeros stay."""
    wanted = eligible_lemmas(source, dictionary, key).join(dictionary, "lemma")
    used = target.groupBy(key, F.col("lemma").alias("option")).agg(F.count(F.lit(1)).alias("c"))
    return wanted.join(used, [key, "option"], "left").groupBy("lemma", "option").agg(F.sum(F.coalesce("c", F.lit(0))).cast("long").alias("count"))


def synonym_summary(counts: DataFrame) -> DataFrame:
    """Over lemmas with two options or more and any use: mean share of the top option, mean distance from uniform use, and
    observed options / uses."""
    by = counts.groupBy("lemma").agg(F.count(F.lit(1)).alias("options"), F.sum("count").alias("total"), F.max("count").alias("top"), F.sum(F.col("count") * F.col("count")).alias("sq")).filter("options >= 2 and total > 0")
    means = by.agg(F.count(F.lit(1)).alias("lemmas"), F.avg(ratio(F.col("top"), F.col("total"))).alias("ptf"), F.avg(uniform_distance(F.col("total"), F.col("sq"), F.col("options"))).alias("cdu"), F.sum("total").alias("uses"))
    seen = counts.filter("count > 0").join(by.select("lemma"), "lemma", "left_semi").agg(F.count_distinct("option").alias("seen"))
    return means.crossJoin(F.broadcast(seen)).select("lemmas", "ptf", "cdu", ratio(F.col("seen"), F.col("uses")).alias("syn_ttr"))  # one row each


# Syntactic structure.


def weighted_mean(value: Column, weight: Column) -> Column:
    """Null-skipping weighted mean."""
    there = value.isNotNull() & weight.isNotNull()
    return F.try_divide(F.sum(F.when(there, value * weight)), F.sum(F.when(there, weight)).cast("double"))


def aligned_ratio(pairs: Column, n: Column, side: str) -> Column:
    """Share of n tokens with an alignment on a side (i or j)."""
    return ratio(F.size(F.array_distinct(F.transform(pairs, lambda p: p[side]))), n)


def structure_summary(rows: DataFrame, *metrics: str) -> DataFrame:
    """Means over rows that have a value, numbers of rows by status (failed rows were eligible), and the commonest error."""
    is_ = lambda s: F.count(F.when(F.col("status") == s, 1))
    agg = rows.agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("rows_total"), is_("ok").alias("rows_scored"), is_("failed").alias("rows_failed"), is_("excluded_sentence_count_mismatch").alias("rows_excluded"), F.count(F.when(F.col("status") != "excluded_sentence_count_mismatch", 1)).alias("rows_eligible"))
    top = rows.filter("error is not null").groupBy("error").agg(F.count(F.lit(1)).alias("n")).agg(F.min_by("error", F.struct(-F.col("n"), "error")).alias("top_error"), F.max("n").alias("top_error_rows"))
    return agg.crossJoin(F.broadcast(top))  # one row each


def with_prefix(df: DataFrame, old: str, new: str) -> DataFrame:
    """Columns that start with a prefix under another one: the measures of a second comparison beside those of the first."""
    return df.withColumnsRenamed({c: new + c.removeprefix(old) for c in df.columns if c.startswith(old)})


def sentence_pairs(parsed: DataFrame) -> DataFrame:
    """Rows of (source_trees, target_trees) arrays to one row a pair of sentences, or a status if their numbers differ."""
    status = F.when(F.size("source_trees") != F.size("target_trees"), "excluded_sentence_count_mismatch").otherwise("ok")
    return parsed.withColumn("status", status).select("*", F.posexplode_outer(F.when(F.col("status") == "ok", F.arrays_zip("source_trees", "target_trees"))).alias("sentence", "pair"))


def tree_distance(source: list[int], target: list[int]) -> int:
    """Edit distance of two ordered trees given as heads (0 is the root): inserts, deletes, by Zhang and Shasha's recurrence."""

    def order(heads: list[int]) -> tuple[list[int], list[int]]:
        children: dict[int, list[int]] = {}
        for i, h in enumerate(heads, 1):
            children.setdefault(h, []).append(i)
        post, left, stack = [], {}, [(0, False)]
        while stack:
            node, done = stack.pop()
            if done:
                kids = children.get(node, [])
                post.append(node)
                left[node] = left[kids[0]] if kids else len(post) - 1
            else:
                stack.append((node, True))
                stack.extend((k, False) for k in reversed(children.get(node, [])))
        return post, [left[n] for n in post]

    (a, la), (b, lb) = order(source), order(target)
    keys = lambda left: [max(i for i, x in enumerate(left) if x == v) for v in sorted(set(left))]
    dist = [[0] * len(b) for _ in a]
    for i in sorted(keys(la)):
        for j in sorted(keys(lb)):
            m, n = i - la[i] + 2, j - lb[j] + 2
            f = [[0] * n for _ in range(m)]
            for x in range(1, m):
                f[x][0] = f[x - 1][0] + 1
            for y in range(1, n):
                f[0][y] = f[0][y - 1] + 1
            for x in range(1, m):
                for y in range(1, n):
                    p, q = la[i] + x - 1, lb[j] + y - 1
                    if la[p] == la[i] and lb[q] == lb[j]:
                        f[x][y] = dist[p][q] = min(f[x - 1][y] + 1, f[x][y - 1] + 1, f[x - 1][y - 1])
                    else:
                        f[x][y] = min(f[x - 1][y] + 1, f[x][y - 1] + 1, f[la[p] - la[i]][lb[q] - lb[j]] + dist[p][q])
    return dist[-1][-1]


def crossings(pairs: list[tuple[int, int]]) -> int:
    """Pairs of alignment links that cross."""
    links = sorted(pairs)
    return sum(1 for i, (a, b) in enumerate(links) for c, d in links[i + 1 :] if a < c and b > d)


_SCORED = "ted double, word_cross double, aligned_word_pairs double, aligned_source_ratio double, aligned_target_ratio double, sentence_pairs int, status string, error string"


def _structure(source: list, target: list, links: list) -> tuple:
    """Means over the sentence pairs of a row, each with the words of its longer side as weight."""
    parts = []
    for a, b, pairs in zip(source, target, links, strict=True):
        for heads in (a, b):
            if any(not 0 <= h <= len(heads) for h in heads):
                raise ValueError(f"a head lies outside the sentence: {list(heads)}")
        pairs = [(p["i"], p["j"]) for p in pairs]
        ratios = [len({p[k] for p in pairs}) / len(x) if len(x) else None for k, x in enumerate((a, b))]
        parts.append((max(len(a), len(b)), tree_distance(list(a), list(b)), crossings(pairs), len(pairs), *ratios))

    def mean(k: int) -> float | None:
        some = [(p[k], p[0]) for p in parts if p[k] is not None and p[0]]
        return sum(v * w for v, w in some) / sum(w for _, w in some) if some else None

    return *map(mean, range(1, 6)), len(parts), "scored_multisentence" if len(parts) > 1 else "scored", None


def structure_scores(df: DataFrame, source_trees: str, target_trees: str, links: str) -> DataFrame:
    """df with the structural comparison of each row: tree edit distance, crossing links, linked words and their shares, the
    number of sentence pairs, status and error.

    Trees are arrays of heads by sentence (0 is the root), links arrays of (i, j) by sentence. Sentences are
    paired by position; rows with unequal numbers of sentences are excluded, rows whose trees cannot be
    compared are failed, and neither hides the others. Null trees are no sentences.
    """

    @pandas_udf(_SCORED)
    def scores(rows: pd.Series) -> pd.DataFrame:
        out = []
        for row in rows:
            try:
                out.append(_structure(*(json.loads(row).get(k) or [] for k in "stl")))
            except Exception as e:  # a row that cannot be compared is reported, whatever its fault
                out.append((None, None, None, None, None, 0, "failed", str(e)))
        return pd.DataFrame(out, columns=[x.split()[0] for x in _SCORED.split(", ")])

    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    n, m = F.greatest(size(source_trees), F.lit(0)), F.greatest(size(target_trees), F.lit(0))
    mismatch = F.concat(F.lit("sentence counts differ: "), n.cast("string"), F.lit(" and "), m.cast("string"))
    nested = F.to_json(F.struct(F.col(source_trees).alias("s"), F.col(target_trees).alias("t"), F.col(links).alias("l")))  # lists of lists
    out = df.withColumn("_s", scores(F.when(n == m, nested).otherwise("{}")))
    picked = [F.when(n == m, F.col(f"_s.{c.split()[0]}")).alias(c.split()[0]) for c in _SCORED.split(", ")[:5]]
    return out.select("*", *picked, F.col("_s.sentence_pairs").alias("sentence_pairs"), F.when(n != m, F.lit("excluded_sentence_count_mismatch")).otherwise(F.col("_s.status")).alias("status"), F.when(n != m, mismatch).otherwise(F.col("_s.error")).alias("error")).drop("_s")
