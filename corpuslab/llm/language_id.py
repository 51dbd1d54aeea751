"""Language identification with hyperdimensional letter n-gram profiles."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import arrow_rows, bounded, cut, pick, slices, text_md5, turn, without

#: Dimensions of the hypervectors, letters of an n-gram, folds of the hold-out, languages that may be learned.
DIM, GRAM, FOLDS, MOST_LANGUAGES = 1024, 3, 5, 10_000
#: Characters of a text that are handled at once (whole texts are, piece by piece), cells of a count matrix.
PIECE, CELLS = 1 << 20, 24_000_000


@lru_cache(maxsize=20_000)
def letter(code: int) -> np.ndarray:
    """The random vector of +1 and -1 that stands for a character."""
    return np.random.default_rng([7, code]).integers(0, 2, DIM, np.int8) * np.int8(2) - np.int8(1)


@lru_cache(maxsize=1)
def _alpha() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _forget() -> None:
    letter.cache_clear()


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    """Bound vectors of n-grams (a row of character codes each): the product of each letter's vector, permuted by its place."""
    used, at = np.unique(codes, return_inverse=True)
    base = np.stack([letter(int(c)) for c in used])
    at = at.reshape(codes.shape)
    out = np.ones((len(codes), DIM), np.int8)
    for k in range(GRAM):
        out *= np.roll(base, GRAM - 1 - k, axis=1)[at[:, k]]
    return out.astype(np.float32)


def _stream(text: str) -> np.ndarray:
    """Lower-case letters, with one space for everything between words and at both ends."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.where(_alpha()[codes], codes, 32)
    return codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]


def bundles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the n-gram vectors of each text (texts x DIM), and whether it has a letter."""
    out, known = np.zeros((len(texts), DIM), np.float32), np.zeros(len(texts), bool)
    owners, streams, held = [], [], 0

    def flush() -> None:
        nonlocal held
        if not streams:
            return
        codes = np.concatenate(streams)
        size = np.array([len(s) for s in streams])
        owner = np.repeat(np.arange(len(streams)), size)
        table = np.zeros(0x110000, np.int64)
        table[codes] = 1
        used = np.flatnonzero(table)
        table[used] = np.arange(len(used))
        i, k = table[codes], len(used)
        gram = (i[:-2] * k + i[1:-1]) * k + i[2:]
        inside = owner[2:] == owner[:-2]
        gram, owner = gram[inside], owner[2:][inside]
        if k**GRAM <= 8_000_000:
            there = np.flatnonzero(np.bincount(gram, minlength=k**GRAM))
            place = np.zeros(k**GRAM, np.int64)
            place[there] = np.arange(len(there))
            gram = place[gram]
        else:
            there, gram = np.unique(gram, return_inverse=True)
        vectors_of = np.stack([used[there // (k * k)], used[there // k % k], used[there % k]], 1)
        step = max(1, CELLS // max(1, len(streams)))
        for g in range(0, len(there), step):
            width = min(step, len(there) - g)
            some = (gram >= g) & (gram < g + width) if len(there) > step else slice(None)
            counts = np.bincount(owner[some] * width + gram[some] - g, minlength=len(streams) * width).reshape(len(streams), width).astype(np.float32)
            for v in range(0, width, 8192):
                np.add.at(out, owners, counts[:, v : v + 8192] @ gram_vectors(vectors_of[g + v : g + min(v + 8192, width)]))
        owners.clear()
        streams.clear()
        held = 0

    for d, text in enumerate(texts):
        for start in range(0, len(text or ""), PIECE):
            s = _stream(text[start : start + PIECE + (GRAM - 1 if start + PIECE < len(text) else 0)])
            if len(s) > 1:
                known[d] = True
                owners.append(d)
                streams.append(s)
                held += len(s)
                if held >= PIECE or len(streams) >= 3000:
                    flush()
    flush()
    return out, known


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Rows whose crc32 of the id as text is divisible by folds; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def learn(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> dict[str, list[float]]:
    """A prototype of each language: the bundle of the unit vectors of all its documents outside the held-out fold.

    Every labelled document counts. The driver gets a vector for each language, of which there may be
    MOST_LANGUAGES. Rows without language, id, text or letters teach nothing.
    """
    bounded(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).filter("lang is not null and text is not null and doc_id is not null").filter(~held_out(F.col("doc_id"))).select("text", F.col("lang").cast("string").alias("lang"))
    schema = pa.schema([("lang", pa.string()), ("v", pa.list_(pa.float64()))])

    def sums(batches):
        turn("language ID", _forget)
        by: dict[str, np.ndarray] = {}
        for b in slices(batches, "text", PIECE * 4):
            vectors, known = bundles(b.column(0).to_pylist())
            vectors, langs = _unit(vectors), np.array(b.column(1).to_pylist(), object)
            for lang in set(langs[known]):
                by[lang] = by.get(lang, 0) + vectors[known & (langs == lang)].sum(0, np.float64)
        yield arrow_rows(schema, lang=list(by), v=[v.tolist() for v in by.values()])

    parts = rows.mapInArrow(sums, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    found = parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return {r["lang"]: [p["x"] for p in r["v"]] for r in sorted(found, key=lambda r: r["lang"])}


def predict(docs: DataFrame, prototypes: dict[str, list[float]], id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """One row per row: doc_id, held_out, lang_pred, score: the language whose prototype has the largest cosine, and that
    cosine (0 at least). Vectors are compared less the mean prototype, which holds what all languages share.

    `und` and 0 for a null text, a text without letters, and if no language was learned. Ties go to the
    first language in order. Only the id and the text are read; repeated rows repeat results. `carry` names
    a string column that is passed on.
    """
    spark = docs.sparkSession
    bounded(spark)
    sent = spark.sparkContext.broadcast(prototypes)  # MOST_LANGUAGES vectors of DIM numbers at most
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), *([(carry, pa.string())] if carry else [])])

    def run(batches):
        turn("language ID", _forget)
        names = list(sent.value)
        protos = _unit(np.array([sent.value[x] for x in names], np.float32).reshape(-1, DIM))
        mean = protos.mean(0) if len(names) > 1 else np.zeros(DIM, np.float32)
        centred = _unit(protos - mean)
        for b in slices(batches, "text"):
            vectors, known = bundles(b.column(1).to_pylist())
            if names:
                cos = _unit(_unit(vectors) - mean) @ centred.T
                best = cos.argmax(1)
                lang, score = [names[i] if k else "und" for i, k in zip(best, known, strict=True)], np.where(known, np.clip(cos.max(1), 0, 1), 0)
            else:
                lang, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
            yield arrow_rows(schema, doc_id=b.column(0), lang_pred=lang, score=score.astype(np.float64).tolist(), **({carry: b.column(2)} if carry else {}))

    more = {carry: carry} if carry else {}
    out = pick(docs, doc_id=id_col, text=text_col, **more).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, lang_pred string, score double" + f", `{carry}` string" * bool(carry))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", *more)


def identify(docs: DataFrame) -> DataFrame:
    """learn() and predict() on the same table."""
    return predict(docs, learn(docs))


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """Documents in which a language was found, with all their columns.

    A row goes for its own text: rows that share its id stay if a language is found in theirs, and so do rows without an id."""
    found = predict(docs.withColumn("_md5", text_md5()), learn(docs), carry="_md5")
    return without(docs, cut(found.filter("lang_pred = 'und'").select("doc_id", F.col("_md5").alias("text_md5")).distinct(), "und"))
