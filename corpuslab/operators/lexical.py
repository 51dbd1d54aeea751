"""Lexical diversity of rows and of corpora, from one token column."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import text as X
from corpuslab.operators.order import with_position

CONTENT = "^\\p{L}{4,}$"


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null if b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def _run_starts(s: Column) -> Column:
    """Where runs of equal items start in a sorted array column (a column, not an expression: lambdas evaluate it for each item)."""
    return F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.element_at(s, F.greatest(i, F.lit(1)))), i)), lambda i: i.isNotNull())


def _run_lengths(s: Column, starts: Column) -> Column:
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(s)))
    return F.zip_with(starts, ends, lambda a, b: (b - a).cast("long"))


def ngrams(tokens: Column, n: int) -> Column:
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), "\u0001")))


def repeated_ngram_rate(tokens: Column, n: int) -> Column:
    g = ngrams(tokens, n)
    return F.lit(1.0) - ratio(F.size(F.array_distinct(g)), F.size(g))


def row_metrics(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """df with token-based metrics of a text column, each null where it is undefined.

    Tokens are made once, in a projection of their own, and dropped at the end."""
    t, n, v = F.col("_tokens"), F.col("_n"), F.col("_v")
    rows = df.withColumn("_tokens", X.tokens(F.col(text))).withColumn("_n", F.size(t).cast("long")).withColumn("_v", F.size(F.array_distinct(t)).cast("long"))
    # occurrences of each type are the runs of the sorted tokens, each step in a projection of its own
    rows = rows.withColumn("_s", F.array_sort(t)).withColumn("_starts", _run_starts(F.col("_s"))).withColumn("_c", _run_lengths(F.col("_s"), F.col("_starts")))
    rows = rows.withColumn("_content", F.size(F.filter(t, lambda x: x.rlike(CONTENT))).cast("long"))
    squares = F.aggregate("_c", F.lit(0).cast("long"), lambda a, c: a + c * c)
    content_words = F.filter(t, lambda x: x.rlike(CONTENT))
    rows = rows.withColumn("_sq", squares).withColumn("_content_v", F.size(F.array_distinct(content_words)).cast("long"))
    k = F.lit(10_000.0) * ratio(F.col("_sq") - n, n * n)
    simpson = ratio(F.col("_sq"), n * n)
    plogp = F.aggregate("_c", F.lit(0.0), lambda a, c: a - (c / n) * F.ln(c / n))
    adjacent = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)).cast("int")), lambda i: F.coalesce(F.try_element_at(t, i) == F.try_element_at(t, i + 1), F.lit(False))), lambda x: x)).cast("long")
    function = n - F.col("_content")
    f2c = ratio(function, F.nullif(F.col("_content"), F.lit(0).cast("long")))
    out = {
        "tokens": n, "types": v, "ttr": ratio(v, n), "yules_k": k, "yules_i": F.when(k != 0, F.lit(10_000.0) / k), "shannon": F.when(n > 0, plogp), "simpson": simpson,
        "inverse_simpson": F.try_divide(F.lit(1.0), simpson), "unique_forms": v, "repeated_token_rate": F.lit(1.0) - ratio(v, n), "repeated_3gram_rate": repeated_ngram_rate(t, 3), "repeated_4gram_rate": repeated_ngram_rate(t, 4),
        "consecutive_repetition_rate": F.when(n >= 2, ratio(adjacent, n - 1)), "content_repetition_rate": F.lit(1.0) - ratio(F.col("_content_v"), F.col("_content")), "lexical_density": ratio(F.col("_content"), n),
        "function_to_content": f2c, "content_to_function": F.when(f2c != 0, F.lit(1.0) / f2c), "function_proportion": ratio(function, n),
    }
    rows = rows.withColumns({f"{prefix}{name}": expr for name, expr in out.items()})
    return rows.drop("_tokens", "_n", "_v", "_s", "_starts", "_c", "_content", "_sq", "_content_v")


ROW_METRICS = "tokens types ttr yules_k yules_i shannon simpson inverse_simpson unique_forms repeated_token_rate repeated_3gram_rate repeated_4gram_rate consecutive_repetition_rate content_repetition_rate lexical_density function_to_content content_to_function function_proportion".split()


def token_rows(df: DataFrame, text: str, *keep: str, position: bool = False) -> DataFrame:
    """One row a token, with the columns to keep, and its position in the row if asked for."""
    t = X.tokens(F.col(text))
    return df.select(*keep, F.posexplode(t).alias("tok_pos", "token")) if position else df.select(*keep, F.explode(t).alias("token"))


def diversity(counts: DataFrame, *by: str, count: str = "c") -> DataFrame:
    """n, v and the diversity measures of a table of counts (one row a type), grouped by columns."""
    n, v, sq = F.sum(count), F.count(F.lit(1)), F.sum(F.col(count).cast("long") * F.col(count))
    clogc = F.sum(F.col(count) * F.ln(F.col(count).cast("double")))
    agg = counts.groupBy(*by).agg(n.alias("n"), v.alias("v"), sq.alias("sq"), clogc.alias("clogc"))
    k = F.lit(10_000.0) * ratio(F.col("sq") - F.col("n"), F.col("n") * F.col("n"))
    simpson = ratio(F.col("sq"), F.col("n") * F.col("n"))
    return agg.select(
        *by, "n", "v", ratio(F.col("v"), F.col("n")).alias("ttr"), k.alias("yules_k"), F.when(k != 0, F.lit(10_000.0) / k).alias("yules_i"),
        (F.ln(F.col("n").cast("double")) - F.col("clogc") / F.col("n")).alias("shannon"), simpson.alias("simpson"), F.try_divide(F.lit(1.0), simpson).alias("inverse_simpson"),
    )


def corpus_metrics(df: DataFrame, text: str, *by: str) -> DataFrame:
    """Diversity of all tokens of a group: counted with partial sums, no token stream in one place."""
    return diversity(token_rows(df, text, *by).groupBy(*by, "token").agg(F.count(F.lit(1)).alias("c")), *by)


# Frequency profiles.


def frequency_ranks(df: DataFrame, text: str, bands: int = 2000) -> DataFrame:
    """token, count, rank of the most frequent tokens by (-count, token): those that a profile tells apart, `bands` of them.

    Ranks beyond the second band all mean "other", so the ordered limit is the feature and bounds the table."""
    counts = token_rows(df, text).groupBy("token").agg(F.count(F.lit(1)).alias("count"))
    top = counts.orderBy(F.desc("count"), "token").limit(bands)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "token")))


def all_ranks(df: DataFrame, text: str) -> DataFrame:
    """Ranks of all tokens: positions in the order of (-count, token) from counts of tokens that are more frequent."""
    counts = token_rows(df, text).groupBy("token").agg(F.count(F.lit(1)).alias("count"))
    by_count = counts.groupBy("count").agg(F.count(F.lit(1)).alias("n"))
    more = by_count.select("count", (F.sum("n").over(Window.orderBy(F.desc("count"))) - F.col("n")).alias("more"))  # one row for each distinct count
    inside = F.row_number().over(Window.partitionBy("count").orderBy("token"))
    return counts.withColumn("i", inside).join(F.broadcast(more), "count").select("token", "count", (F.col("more") + F.col("i")).alias("rank"))


def frequency_profile(df: DataFrame, text: str, ranks: DataFrame, *by: str, b1: int = 1000, b2: int = 2000) -> DataFrame:
    """Shares of tokens of rank 1 to b1, to b2, and others (unknown ones too); null without tokens or ranks."""
    known = ranks.filter(F.col("rank") <= b2).select("token", "rank")  # b2 rows at most
    n = token_rows(df, text, *by).join(F.broadcast(known), "token", "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("rank") <= b1, 1)).alias("n1"), F.count(F.when((F.col("rank") > b1) & (F.col("rank") <= b2), 1)).alias("n2")
    )
    any_rank = ranks.limit(1).count() > 0
    share = lambda c: ratio(c, F.col("n")) if any_rank else F.lit(None).cast("double")
    return n.select(*by, share(F.col("n1")).alias("lfp_b1"), share(F.col("n2")).alias("lfp_b2"), share(F.col("n") - F.col("n1") - F.col("n2")).alias("lfp_b3"))


# Measures of the token stream in order.


def _mattr(rows: DataFrame, window: int, *by: str) -> DataFrame:
    """rows: by columns, q (0-based position), token. The mean over all windows of distinct tokens / window.

    Closed form: a token counts in those windows that hold it but not its previous occurrence. Positions are
    compared with lag over (group, token), so no window of the stream is ever built.
    """
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("N"))
    prev = F.coalesce(F.lag("q").over(Window.partitionBy(*by, "token").orderBy("q")), F.lit(-1).cast("long"))
    seen = rows.withColumn("prev", prev)
    if by:  # a null group is a group
        other = sizes.withColumnsRenamed({c: f"_{c}" for c in by})
        joined = seen.join(other, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])).drop(*[f"_{c}" for c in by])
    else:
        joined = seen.crossJoin(F.broadcast(sizes))  # one row
    w = F.lit(window).cast("long")
    windows = F.greatest(F.lit(0).cast("long"), F.least(F.col("q"), F.col("N") - w) - F.greatest(F.col("q") - w + 1, F.col("prev") + 1, F.lit(0).cast("long")) + 1)
    agg = joined.groupBy(*by).agg(F.sum(F.when(F.col("N") >= window, windows)).alias("d"), F.max("N").alias("N"))
    return agg.select(*by, F.when(F.col("N") >= window, ratio(F.col("d"), w * (F.col("N") - w + 1))).alias("mattr"))


def mattr_by_row(df: DataFrame, text: str, key: str, window: int = 50) -> DataFrame:
    return _mattr(token_rows(df, text, key, position=True).withColumn("q", F.col("tok_pos").cast("long")), window, key)


def token_stream(df: DataFrame, text: str, order: str, by: str) -> DataFrame:
    """by, q, token: positions in the stream of all of a group's rows in order, from sums of token counts before a row.

    All groups are one plan, however many there are."""
    sized = df.select(by, order, text).withColumn("_len", F.size(X.tokens(F.col(text))).cast("long"))
    placed = with_position(sized, order, "_start", F.col("_len"), by)
    return placed.select(by, "_start", F.posexplode(X.tokens(F.col(text))).alias("p", "token")).select(by, (F.col("_start") + F.col("p")).alias("q"), "token")


def mattr_by_group(df: DataFrame, text: str, order: str, by: str, window: int = 50) -> DataFrame:
    return _mattr(token_stream(df, text, order, by), window, by)


MTLD_THRESHOLD, MTLD_SEGMENT, MTLD_LEAST = 0.72, 10, 100


class MtldPass:
    """A forward pass over a token stream: the state is the open segment, so a stream of any length fits."""

    def __init__(self):
        self.factors, self.n, self.types, self.last_full = 0.0, 0, set(), False
        self.total = 0

    def add(self, token: str) -> None:
        # a segment is closed when the next token comes: the last one always stays partial
        if self.n >= MTLD_SEGMENT and len(self.types) / self.n < MTLD_THRESHOLD:
            self.factors, self.n, self.types = self.factors + 1, 0, set()
        self.n += 1
        self.total += 1
        self.types.add(token)

    def score(self) -> float:
        factors = self.factors
        if self.n:
            factors += (1 - len(self.types) / self.n) / (1 - MTLD_THRESHOLD)
        return self.total / factors if factors else 0.0


def mtld(tokens: list[str]) -> float | None:
    """The mean of a pass over the tokens and one over the reversed tokens; null below 100 tokens."""
    if len(tokens) < MTLD_LEAST:
        return None
    scores = []
    for stream in (tokens, tokens[::-1]):
        p = MtldPass()
        for t in stream:
            p.add(t)
        scores.append(p.score())
    return sum(scores) / 2


def mtld_by_group(df: DataFrame, text: str, order: str, by: str) -> DataFrame:
    """by, n, mtld. A sequential fold by definition: each group and direction is one ordered stream through a task, whose
    state is the open segment; texts stream, they are not gathered."""
    rows = df.select(F.col(by).cast("string").alias("g"), F.col(order).cast("long").alias("o"), X.tokens(F.col(text)).alias("toks"))
    back = F.explode(F.array(F.lit(False), F.lit(True))).alias("back")
    both = rows.select("g", "o", "toks", back).select("g", "back", F.when(F.col("back"), -F.col("o")).otherwise(F.col("o")).alias("o"), F.when(F.col("back"), F.reverse("toks")).otherwise(F.col("toks")).alias("toks"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, out = None, MtldPass(), []
        for b in batches:
            for g, back, toks in zip(b["g"], b["back"], b["toks"], strict=True):
                if (g, back) != now:
                    if now is not None:
                        out.append((now[0], state.total, state.score()))
                    now, state = (g, back), MtldPass()
                for t in toks:
                    state.add(t)
        if now is not None:
            out.append((now[0], state.total, state.score()))
        yield pd.DataFrame(out, columns=["g", "n", "score"])

    scored = both.repartition("g", "back").sortWithinPartitions("g", "back", "o").mapInPandas(fold, "g string, n long, score double")
    return scored.groupBy(F.col("g").alias(by)).agg(F.max("n").alias("n"), F.when(F.max("n") >= MTLD_LEAST, F.avg("score")).alias("mtld"))


def target_bundle(df: DataFrame, text: str, order: str, by: str, ranks: DataFrame) -> DataFrame:
    """The corpus measures of each group in one row: tokens, types, TTR, Yule's K and I, MATTR, MTLD and whether there were
    tokens enough for it, and the shares of the frequency bands. A group without tokens has no row."""
    base = corpus_metrics(df, text, by).select(by, F.col("n").alias("token_count"), F.col("v").alias("type_count"), "ttr", "yules_k", "yules_i")
    status = F.when(F.col("mtld").isNull(), "insufficient_tokens").otherwise("ok").alias("mtld_status")
    out = base
    for part in (mattr_by_group(df, text, order, by).withColumnRenamed("mattr", "mattr_50"), mtld_by_group(df, text, order, by).select(by, "mtld", status), frequency_profile(df, text, ranks, by)):
        key = F.col(by).cast("string").eqNullSafe(F.col("_by"))
        out = out.join(part.withColumn("_by", F.col(by).cast("string")).drop(by), key, "left").drop("_by")
    return out


# Concentration of translation choices.


def uniform_distance(total: Column, squares: Column, support: Column) -> Column:
    """Cosine distance of counts from the uniform vector on their support: 1 - sum / sqrt(n * sum of squares)."""
    return F.when(support <= 1, F.when(total > 0, F.lit(0.0))).otherwise(F.lit(1.0) - F.try_divide(total.cast("double"), F.sqrt(support.cast("double") * squares.cast("double"))))


def choice_concentration(df: DataFrame, source: str, choice: str, reference: str) -> DataFrame:
    """Over sources that stand more than once: the mean share of the most frequent choice, and the mean distance from
    uniform use of all choices that predictions or references make."""
    repeated = df.groupBy(source).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(source)
    rows = df.join(repeated, source, "left_semi")
    both = rows.select(source, F.col(choice).alias("x"), F.lit(1).alias("c")).unionByName(rows.select(source, F.col(reference).alias("x"), F.lit(0).alias("c")))
    counts = both.groupBy(source, "x").agg(F.sum("c").cast("long").alias("c"))
    by = counts.groupBy(source).agg(F.max("c").alias("top"), F.sum("c").alias("total"), F.sum(F.col("c") * F.col("c")).alias("sq"), F.count(F.lit(1)).alias("support"))
    return by.agg(F.count(F.lit(1)).alias("groups_analyzed"), F.avg(ratio(F.col("top"), F.col("total"))).alias("ptf"), F.avg(uniform_distance(F.col("total"), F.col("sq"), F.col("support"))).alias("cdu"))


def length_summary(df: DataFrame, length: Column, *by: str) -> DataFrame:
    """min, mean, median, p95, p99 (linear interpolation) and max of a length; zeros for an empty table."""
    x = df.select(*by, length.cast("double").alias("x"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return x.groupBy(*by).agg(F.count("x").alias("n"), z(F.min("x")).alias("min"), z(F.avg("x")).alias("mean"), z(F.percentile("x", F.lit(0.5))).alias("median"), z(F.percentile("x", F.lit(0.95))).alias("p95"), z(F.percentile("x", F.lit(0.99))).alias("p99"), z(F.max("x")).alias("max"))
