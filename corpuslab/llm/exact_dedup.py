"""Exact dedup by a 128-bit content hash, with a byte comparison inside groups. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm.common import cut, pick

#: Rows of one group that may meet in one task before the group is salted.
GROUP_ROWS = 1000
#: At most so many groups are salted: the threshold rises with the table, so the broadcast list of hot groups is bounded.
HOT_GROUPS = 10_000


def normalised(text: Column) -> Column:
    """Every run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=normalised) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by the MD5 of the normalised text. Inside a group of several rows each text is
    compared byte by byte with the group's first text; a row that differs (a hash collision) is grouped by
    its whole text instead, so the result never depends on the hash.

    Groups with more rows than `GROUP_ROWS` are salted by their known size. Null texts count as empty; a
    null id is never chosen to stay while a group has another id; rows that repeat an id in a group share
    its fate; an empty table gives an empty result. Only the id and text columns are read.
    """
    base = pick(docs, doc_id=id_col, text=text_col).select("doc_id", normalise(F.col("text")).alias("t")).select("doc_id", "t", F.unhex(F.md5("t")).alias("h"))
    # the only pass that hashes every text twice: what follows reads this table, and texts only to compare them in groups
    hashed = cut(base.select("doc_id", "h", F.unhex(F.sha2("t", 256)).alias("sha")), "exact-hashes")
    groups = cut(hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "exact-groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    most = max(GROUP_ROWS, total // HOT_GROUPS)
    hot = groups.filter(F.col("n") > most).select("h", F.ceil(F.col("n") / most).cast("int").alias("k"))
    salt = F.when(F.col("k").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int")).alias("salt")
    spread = F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1)).alias("salt")

    def dealt(df: DataFrame, *cols: str) -> DataFrame:
        """Each row of df with one salt of its group."""
        return df.join(F.broadcast(hot), "h", "left").select("doc_id", "h", *cols, salt)

    def salted(df: DataFrame, *cols: str) -> DataFrame:
        """Each row of df once for each salt of its group."""
        return df.join(F.broadcast(hot), "h", "left").select("h", *cols, spread)

    sha = F.lower(F.hex("sha")).alias("text_sha256")
    alone = dealt(hashed, "sha").join(salted(groups), ["h", "salt"], "left_anti")
    single = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)

    several = dealt(base, "t").join(salted(groups), ["h", "salt"], "left_semi")
    first = several.groupBy("h").agg(F.min("t").alias("first_t"))
    compared = several.join(salted(first, "first_t"), ["h", "salt"])
    compared = cut(compared.select("doc_id", "h", "salt", F.unhex(F.sha2("t", 256)).alias("sha"), F.when(F.col("t") != F.col("first_t"), F.col("t")).alias("own")), "exact-compared")
    sizes = compared.groupBy("h", "own").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    sizes = salted(sizes, "own", "keep_id", "group_size").withColumnsRenamed({"own": "own2", "h": "h2", "salt": "salt2"})
    both = compared.join(sizes, (F.col("h") == F.col("h2")) & (F.col("salt") == F.col("salt2")) & F.col("own").eqNullSafe(F.col("own2")))
    both = both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), sha)
    return single.unionByName(both)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat an id and a text one stays, rows without an id all do.

    A row goes for its own text: rows that share an id and differ in text stand for themselves."""
    gone = cut(exact_dedup(docs).filter("not kept and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct(), "exact-gone")
    left = docs.join(gone, (F.col("doc_id") == F.col("_id")) & (F.sha2(normalised(F.col("text")), 256) == F.col("_sha")), "left_anti")
    again = cut(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("_id")), "exact-repeats")
    if not again.limit(1).count():
        return left
    same_id = F.col("doc_id").eqNullSafe(F.col("_id"))
    number = F.row_number().over(Window.partitionBy("doc_id", normalised(F.col("text"))).orderBy("text"))
    once = left.join(again, same_id, "left_semi").withColumn("_number", number).filter("_number = 1").drop("_number")
    return left.join(again, same_id, "left_anti").unionByName(once)


ORACLE = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from n
"""
