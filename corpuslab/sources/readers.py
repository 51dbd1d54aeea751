"""Readers. All go through Spark's file sources, so any store that Spark reads will do."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import text as X
from corpuslab.operators.order import with_position
from corpuslab.schema import CorpusError, require_columns


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that there is: the order is the precedence."""
    for p in paths:
        if exists(spark, p):
            return p
    raise CorpusError(f"none of {paths} exists")


def by_suffix(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet by its suffix, else one JSON object a line (schema spares a pass and keeps ids strings)."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def indexed_lines(spark: SparkSession, path: str) -> DataFrame:
    """original_index (0-based line number), line. A file's splits are numbered in order of their place in it.

    Line numbers need each split's line count first: one narrow pass, then the numbers are local to a split."""
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("_id"))
    split = F.shiftrightunsigned("_id", 33)
    counts = rows.groupBy(split.alias("_p")).agg(F.count(F.lit(1)).alias("_n")).collect()  # a number for each split of the file
    start, offsets = 0, []
    for r in sorted(counts, key=lambda r: r["_p"]):
        offsets.append((r["_p"], start))
        start += r["_n"]
    if not offsets:
        return rows.select(F.lit(0).cast("long").alias("original_index"), "line")
    at = spark.createDataFrame(offsets, "_p long, _start long")
    return rows.withColumn("_p", split).join(F.broadcast(at), "_p").select((F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)).alias("original_index"), "line")


def aligned_text(spark: SparkSession, source_path: str, target_path: str, corpus: str, limit: int | None = None) -> DataFrame:
    """Two text files, a sentence a line, paired by line number; different numbers of lines are an error."""
    s, t = (indexed_lines(spark, p) for p in (source_path, target_path))
    n, m = s.count(), t.count()
    if n != m:
        raise CorpusError(f"{n} and {m} lines")
    out = s.withColumnRenamed("line", "source").join(t.withColumnRenamed("line", "target"), "original_index").withColumn("corpus", F.lit(corpus))
    return out if limit is None else out.filter(F.col("original_index") < limit)


def jsonl_pairs(spark: SparkSession, path: str, corpus: str, limit: int | None = None) -> DataFrame:
    """JSON lines with source and target; original_index is the line number."""
    lines = indexed_lines(spark, path).filter("trim(line) != ''")
    sample = spark.read.json(path).schema
    rows = lines.select("original_index", F.from_json("line", sample).alias("r")).select("original_index", "r.*")
    require_columns(rows, "source", "target", label=path)
    rows = with_position(rows.withColumnRenamed("original_index", "_line"), "_line", "original_index").drop("_line").withColumn("corpus", F.lit(corpus))
    return rows if limit is None else rows.filter(F.col("original_index") < limit)


def table_pairs(spark: SparkSession, path: str, corpus: str, renames: dict[str, str], order: str, limit: int | None = None) -> DataFrame:
    """A parallel table: only the renamed columns are read."""
    rows = spark.read.parquet(path)
    out = with_position(rows.select(F.col(order).alias("_o"), *[F.col(f"`{a}`").alias(b) for a, b in renames.items()]), "_o", "original_index").drop("_o").withColumn("corpus", F.lit(corpus))
    require_columns(out, "source", "target", label=path)
    return out if limit is None else out.filter(F.col("original_index") < limit)


#: Loaders by name: a corpus names one and its options.
LOADERS: dict[str, Callable[..., DataFrame]] = {"aligned_text": aligned_text, "jsonl": jsonl_pairs, "table": table_pairs}


def load_dataset(spark: SparkSession, entry: dict) -> DataFrame:
    """entry: loader, and its options."""
    options = dict(entry)
    try:
        loader = LOADERS[options.pop("loader")]
    except KeyError as e:
        raise CorpusError(f"no loader {e}") from None
    return loader(spark, **options)


def processed_split(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """A split by name, JSON lines before Parquet; sentence_id is the id as text unless there is one."""
    rows = by_suffix(spark, first_existing(spark, f"{folder}/{name}.jsonl", f"{folder}/{name}.parquet"), schema)
    return rows if "sentence_id" in rows.columns else rows.withColumn("sentence_id", F.col("id").cast("string"))


def evaluation_file(spark: SparkSession, path: str, key: str, order: str | None = None) -> DataFrame:
    """JSON lines of source and target, with made-up ids key_000001 and on."""
    rows = jsonl_pairs(spark, path, key)
    return rows.select(X.row_id(key, F.col("original_index")).alias("sentence_id"), "source", F.col("target").alias("reference"))


def records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON records; blank lines are skipped, none at all is an error."""
    rows = by_suffix(spark, path, schema)
    if not rows.limit(1).count():
        raise CorpusError(f"{path} has no record")
    return rows


def background_texts(spark: SparkSession, path: str, column: str = "target") -> DataFrame:
    rows = require_columns(by_suffix(spark, path), column, label=path)
    return rows.select(F.coalesce(F.col(column), F.lit("")).alias("text"))


def bilingual_dictionary(spark: SparkSession, path: str, invert: bool = False) -> DataFrame:
    """Distinct (lemma, option) of an XML dictionary <e><p><l>..</l><r>..</r></p></e>: all left forms of an entry with all
    right ones. <b/>, <j/> and <a/> inside a form are spaces, other tags are dropped."""
    entries = spark.read.text(path, lineSep="</e>").select(F.regexp_extract("value", "(?s)<e\\b[^>]*>(.*)$", 1).alias("e"))

    def forms(tag: str):
        found = F.regexp_extract_all("e", F.lit(f"(?s)<{tag}\\b[^>/]*>(.*?)</{tag}>"), F.lit(1))

        def plain(x):
            x = F.regexp_replace(F.regexp_replace(x, "<(?:b|j|a)\\s*/>", " "), "<[^>]+>", "")
            for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
                x = F.replace(x, F.lit(a), F.lit(b))
            return X.lexical_item(x)

        return F.filter(F.transform(found, plain), lambda x: x.isNotNull())

    left, right = ("r", "l") if invert else ("l", "r")
    return entries.select(F.explode(forms(left)).alias("lemma"), forms(right).alias("o")).select("lemma", F.explode("o").alias("option")).distinct()


def summaries(spark: SparkSession, root: str, *files: str) -> DataFrame:
    """model, condition, summary (JSON text) for every root/model/condition/.../file; of several files in a folder the one
    named first counts (the older name comes last), and one that is no JSON has the summary {}."""
    files = files or ("analysis_summary.json", "automatic_metrics.json")
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(files) + "}").text(root, wholetext=True).withColumn("path", F.input_file_name())
    rank = F.array_position(F.array(*map(F.lit, files)), F.regexp_extract("path", "([^/]+)$", 1))
    tail = re.escape(root.rstrip("/").split("://")[-1].split("/")[-1])
    model, condition = F.regexp_extract("path", f"/{tail}/([^/]+)/", 1).alias("model"), F.regexp_extract("path", f"/{tail}/[^/]+/(.*)/[^/]+$", 1).alias("condition")
    read = F.when(F.get_json_object("value", "$").isNotNull(), F.col("value")).otherwise("{}")
    return rows.groupBy(model, condition).agg(F.min_by(read, rank).alias("summary"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
