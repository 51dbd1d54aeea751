"""Benchmark decontamination: a broadcast hash set of test n-grams against all windows of the training texts."""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import arrow_rows, bounded, cut, pick, slices, turn, without

#: Item words in one broadcast; larger sets are searched in blocks of items, one pass each.
BLOCK_WORDS = 2_000_000

#: Bytes of words stay (letters lower-cased), all others become spaces.
_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of digits, letters and non-ASCII characters, A-Z in lower case, as UTF-8; none for null."""
    return text.encode().translate(_TABLE).split() if text else []


class NgramSet:
    """Windows of items as sorted arrays: their hashes, their words to verify hits with, and the items of each.

    Items without an id (null) have windows like others, but no name to report."""

    _MUL = 0x9E3779B97F4A7C15

    def __init__(self, items: Iterable[tuple[str | None, str | None]], n: int):
        self.ids: dict[bytes, int] = {}
        self.names: list[str] = []
        by_size: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        number: dict[str | None, int] = {None: -1}
        for item, text in items:
            w = np.array([self.ids.setdefault(x, len(self.ids) + 1) for x in words_of(text)], np.uint32)
            if len(w):
                if item not in number:
                    number[item] = len(self.names)
                    self.names.append(item)
                by_size[min(n, len(w))].append((number[item], w))
        #: by size of window: (sorted hashes, words of the windows, where each window's items start in a list, that list)
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, found in by_size.items():
            rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(w, size) for _, w in found])
            owner = np.repeat(np.array([i for i, _ in found]), [len(w) - size + 1 for _, w in found])
            words, which = np.unique(rows, axis=0, return_inverse=True)
            h = self._hash(words)
            order = np.argsort(h, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            pairs = np.unique(np.stack([rank[which.ravel()], owner], 1), axis=0)
            pairs = pairs[pairs[:, 1] >= 0]
            self.sizes[size] = (h[order], words[order], np.searchsorted(pairs[:, 0], np.arange(len(order) + 1)), pairs[:, 1])

    def _hash(self, rows: np.ndarray) -> np.ndarray:
        """A hash of each row of word ids, modulo 2**64."""
        out = rows[:, 0].astype(np.uint64)
        with np.errstate(over="ignore"):
            for j in range(1, rows.shape[1]):
                out *= np.uint64(self._MUL)
                out += rows[:, j]
                out ^= out >> np.uint64(29)
        return out

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, list[str]]]:
        """For each text: its number of words, which of them are hit, and the items hit (sorted)."""
        get = self.ids.get
        all_words = [words_of(t) for t in texts]
        ends = np.cumsum([len(w) for w in all_words], dtype=np.int64)
        ids = np.fromiter((get(x, 0) for w in all_words for x in w), np.uint32, int(ends[-1]) if len(ends) else 0)
        edge = np.zeros(len(ids) + 1, np.int64)
        items: dict[int, set[str]] = defaultdict(set)
        # a window can't hold an unknown word: only runs of known words are hashed
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        for size, (hashes, words, first, owner) in self.sizes.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            doc = np.searchsorted(ends, at, "right")
            at = at[doc == np.searchsorted(ends, at + size - 1, "right")]
            seen = np.lib.stride_tricks.sliding_window_view(ids, size)
            h = self._hash(seen[at])
            place = np.searchsorted(hashes, h)
            while len(at):  # windows of equal hash stand side by side: each is verified word by word
                stay = place < len(hashes)
                stay[stay] = hashes[place[stay]] == h[stay]
                at, h, place = at[stay], h[stay], place[stay]
                same = (seen[at] == words[place]).all(1)
                np.add.at(edge, at[same], 1)
                np.add.at(edge, at[same] + size, -1)
                for d, p in np.unique(np.stack([np.searchsorted(ends, at[same], "right"), place[same]], 1), axis=0).tolist():
                    items[d].update(self.names[i] for i in owner[first[p] : first[p + 1]].tolist())
                at, h, place = at[~same], h[~same], place[~same] + 1
        hit = np.cumsum(edge)[:-1] > 0
        for d, (w, end) in enumerate(zip(all_words, ends.tolist(), strict=True)):
            yield len(w), hit[end - len(w) : end], sorted(items.get(d, ()))


def spans(hit: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of hit words as (first, last + 1)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


_FIELDS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), ("items", pa.list_(pa.string())), ("text_md5", pa.string())])
_DDL = "row long, doc_id long, n_words long, spans array<struct<s:long,e:long>>, items array<string>, text_md5 string"

#: The set a worker process has, and the block it was made of.
_SETS: dict[str, NgramSet] = {}


def _forget() -> None:
    _SETS.clear()


def _set_of(block: str, items, n: int) -> NgramSet:
    """One set for each worker process and block, made when it first meets the block."""
    if block not in _SETS:
        _SETS.clear()
        _SETS[block] = NgramSet(items.value, n)
    return _SETS[block]


def _blocks(items: DataFrame) -> int:
    """Blocks of items that are small enough to broadcast; the size is measured, not assumed."""
    words = items.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    return max(1, int(-(-words // BLOCK_WORDS)))


def _hits(base: DataFrame, items: list[tuple[str | None, str | None]], n: int, every_row: bool) -> DataFrame:
    """Rows of base (row, doc_id, text) with their hits by one block of items: all of them, or those with any hit.

    A row that is hit also tells its text, by its MD5."""
    sent, block = base.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def scan(batches):
        turn("decontamination", _forget)
        grams = _set_of(block, sent, n)
        for b in slices(batches, "text"):
            texts = b.column(2).to_pylist()
            got = list(grams.scan(texts))
            hit = [bool(x[1].any()) for x in got]
            md5 = [hashlib.md5(t.encode(), usedforsecurity=False).hexdigest() if h else None for t, h in zip(texts, hit, strict=True)]
            out = arrow_rows(_FIELDS, row=b.column(0), doc_id=b.column(1), n_words=[x[0] for x in got], spans=[[{"s": s, "e": e} for s, e in spans(x[1])] for x in got], items=[x[2] for x in got], text_md5=md5)
            yield out if every_row else out.filter(pa.array(hit))

    return base.mapInArrow(scan, _DDL)


def benchmark_hits(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row: doc_id, n_words, spans (hit runs of words, from and to), items (ids, sorted as strings), text_md5
    (of the whole text; null if nothing is hit).

    A window is n consecutive words of an item, or the whole of a shorter item with any word. Every word of
    a document inside an occurrence of a window is hit. The items are broadcast, and each worker makes its
    hash set of them once; if they are many, in blocks of a measured size, one pass each, whose hits of a row
    are put together by the row's number (an item is never cut, so the longest bounds a block from below).
    Hits by hash are verified word by word.

    Null and empty texts have no words; items without words match nothing. Windows of an item without an id
    hit words like others, but the item has no name and is not listed. Items that repeat an id are listed
    once. Rows that repeat an id, or have none, are rows of their own, however many blocks there are. Empty
    tables give empty or unhit results.
    """
    spark = docs.sparkSession
    bounded(spark)
    base = pick(docs, doc_id=id_col, text=text_col).select(F.lit(0).cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    tests = pick(items, item=item_col, text=item_text).withColumn("item", F.col("item").cast("string")).filter("text is not null")
    parts = _blocks(tests)
    if parts > 1:  # a row's number is fixed by writing it
        base = cut(base.withColumn("row", F.monotonically_increasing_id()), "decontamination-rows")
    found = None
    for k in range(parts):
        block = [(r["item"], r["text"]) for r in tests.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k).collect()]
        some = _hits(base, block, n, k == 0)
        found = some if found is None else found.unionByName(some)
    if parts == 1:
        return found.drop("row")
    merged = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.max("text_md5").alias("text_md5"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    start = F.struct(F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)").alias("done"), F.lit(-1).cast("long").alias("s"), F.lit(-1).cast("long").alias("e"))
    push = lambda a: F.when(a.e < 0, a.done).otherwise(F.concat(a.done, F.array(F.struct(a.s.alias("s"), a.e.alias("e")))))
    joined = F.aggregate("spans", start, lambda a, x: F.when(x.s <= a.e, F.struct(a.done.alias("done"), a.s.alias("s"), F.greatest(a.e, x.e).alias("e"))).otherwise(F.struct(push(a).alias("done"), x.s.alias("s"), x.e.alias("e"))), push)
    return merged.select("doc_id", "n_words", joined.alias("spans"), "items", "text_md5")


def digest(hits: DataFrame) -> DataFrame:
    """The columns of the contract, from benchmark_hits()."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x.e - x.s)
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """Documents without any benchmark window, with all their columns.

    A row goes for its own text: rows that share its id stay if their texts are clean, and so do rows without an id."""
    bad = cut(benchmark_hits(docs, items, n).filter("text_md5 is not null").select("doc_id", "text_md5").distinct(), "contaminated")
    return without(docs, bad)


def remove_spans(text: str | None, hit_spans: list[tuple[int, int]]) -> str | None:
    """text without the words of the spans (and what stands between them); the rest is untouched."""
    if not text or not hit_spans:
        return text
    import re

    raw = text.encode()
    at = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
    out, last = [], 0
    for s, e in hit_spans:
        out.append(raw[last : at[s][0]])
        last = at[e - 1][1]
    return b"".join([*out, raw[last:]]).decode()


ORACLE = r"""
with lowered as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
d as (select doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from lowered),
b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
b2 as (select item, w, least(10, len(w)) as k from b where len(w) > 0),
bw as (select distinct item, k, array_to_string(w[i : i + k - 1], ' ') as g from (select item, w, k, unnest(range(1, len(w) - k + 2)) as i from b2)),
sizes as (select distinct k from bw),
dw as (select doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') as g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, sizes where len(w) >= k)),
m as (select doc_id, i, dw.k, item from dw join bw on dw.g = bw.g and dw.k = bw.k),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from m) group by doc_id),
its as (select doc_id, count(distinct item) as n_items, string_agg(item, ',' order by item) as s from (select distinct doc_id, item from m) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (doc_id) left join its using (doc_id)
"""
