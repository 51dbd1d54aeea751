"""Repeated byte strings of a corpus by a distributed difference-cover sort of suffixes, limited to the depth that matters.

For strings of LENGTH bytes, suffixes need not be ordered beyond their first LENGTH bytes. Positions of a document
are sampled by a difference cover of period PERIOD: for any two positions there is a shift below PERIOD that takes
both to sampled ones. So

1. sampled suffixes are named by a triple of the names of three consecutive parts and sorted by name, in ranges of
   names. A suffix whose triple stands in one document only is told apart from all others, and ends here;
2. two documents that share a string of LENGTH bytes share LENGTH - PERIOD + 1 or more bytes at a shift that is sampled
   in both, so a remaining suffix can be in a match only if one of the sampled suffixes that start in its first
   PERIOD bytes is still tied. These suffixes, sampled or not, are named to the full depth by recursion on the names
   of their parts (ties need one more level, not a sort of the whole corpus), merged and sorted;
3. neighbours in that order are compared on their LENGTH-byte prefixes: those equal to one of a smaller id are hit.

A name of the last sort has about 62 bits (56 and the range), so two given strings are taken for equal by mistake with a
chance of 2**-62. Rows of the shuffles are packed arrays of many suffixes. The last sort is done in ROUNDS parts of the
names, so that no more than a part of it is on disk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import arrow_rows, bounded, cut, drop, pick, salted_join, slices

#: A perfect difference set, and its period.
COVER, PERIOD = (0, 1, 4, 14, 16), 21
LENGTH = 50
#: Bytes of text hashed at once; suffixes a packed row group holds before it is sent; suffixes of a range of names.
PIECE, SENT, RANGE = 1 << 20, 1_500_000, 1_200_000
LEAST_RANGES, ROUNDS = 64, 2
#: Text bytes of a bucket of documents, which a task has at once.
BUCKET_BYTES = 8 << 20
#: Bytes of a name that are sent in the first and the last sort, besides its range.
SHORT, LONG = 4, 7

_MIX = np.uint64(0xBF58476D1CE4E5B9)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _step(names: np.ndarray, size: int, more: np.ndarray) -> np.ndarray:
    """Names of strings made of a string of names and what follows it after `size` bytes."""
    n = len(more) - size
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = names[:n] * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(32)
    out += more[size:]
    return out


def names_of(raw: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit name of the string of `size` bytes at each place, built from names of shorter strings."""
    with np.errstate(over="ignore"):
        whole, have, power, width = None, 0, (raw.astype(np.uint64) + np.uint64(1)) * _MIX, 1
        while size:
            if size & 1:
                whole, have = (power, width) if whole is None else (_step(whole, have, power), have + width)
            size >>= 1
            if size:
                power, width = _step(power, width, power), 2 * width
        if whole is None or not len(whole):
            return np.zeros(0, np.uint64)
        whole = (whole ^ (whole >> np.uint64(29))) * _MIX
        return whole ^ (whole >> np.uint64(32))


def triples_of(raw: np.ndarray, part: int) -> np.ndarray:
    """Names of triples: of three consecutive parts at each place."""
    one = names_of(raw, part)
    with np.errstate(over="ignore"):
        out = _step(_step(one, part, one), 2 * part, one)
        out = (out ^ (out >> np.uint64(29))) * _MIX
        return out ^ (out >> np.uint64(32))


def _pieces(raw: np.ndarray, depth: int):
    """(place, bytes) of parts of a text that overlap by depth - 1 bytes; their places are multiples of PERIOD."""
    step = PIECE // PERIOD * PERIOD
    for s in range(0, max(1, len(raw) - depth + 1), step):
        yield s, raw[s : s + step + depth - 1]


class Packer:
    """Collects (document, place, name) and sends them as packed rows, one for each range of names."""

    SCHEMA = pa.schema([("range", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("gaps", pa.binary()), ("names", pa.binary())])
    DDL = "range int, docs binary, counts binary, gaps binary, names binary"

    def __init__(self, ranges: int, width: int):
        self.ranges, self.width = ranges, width
        self.docs: list[int] = []
        self.parts: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, doc: int, places: np.ndarray, names: np.ndarray):
        if not self.parts or self.docs[-1] != doc:
            self.docs.append(doc)
        self.parts.append((len(self.docs) - 1, places.astype(np.uint32), names))
        self.held += len(places)
        if self.held >= SENT:
            yield from self.flush()

    def flush(self):
        if self.held:
            names = np.concatenate([p[2] for p in self.parts])
            owner = np.repeat(np.array([p[0] for p in self.parts], np.int32), [len(p[1]) for p in self.parts])
            places = np.concatenate([p[1] for p in self.parts])
            docs = np.array(self.docs, np.int64)
            part = _range(names, self.ranges)
            order = np.argsort(part, kind="stable")
            edge = np.searchsorted(part[order], np.arange(self.ranges + 1))
            out = {f.name: [] for f in self.SCHEMA}
            for r in range(self.ranges):
                at = order[edge[r] : edge[r + 1]]
                if len(at):
                    o, p = owner[at], places[at]
                    first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
                    gaps = np.diff(p, prepend=np.uint32(0))
                    gaps[first] = p[first]
                    gaps = gaps.astype(np.int64)
                    out["range"].append(r)
                    out["docs"].append(_planes(np.diff(docs[o[first]], prepend=np.int64(0)), 8))
                    out["counts"].append(_planes(np.diff(np.append(first, len(o))), 4))
                    out["gaps"].append(_planes(gaps, 4))
                    out["names"].append(np.ascontiguousarray(names[at].view(np.uint8).reshape(-1, 8)[:, : self.width]).tobytes())
            self.docs, self.parts, self.held = [], [], 0
            yield arrow_rows(self.SCHEMA, **out)


def _range(names: np.ndarray, ranges: int) -> np.ndarray:
    """The range of a name, from its upper half; what is sent are its lower bytes."""
    return ((names >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32 if ranges > 65535 else np.uint16)


def _planes(x: np.ndarray, width: int) -> bytes:
    """Numbers as planes of bytes, which compress well if the numbers are small."""
    return x.astype(f"<i{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _numbers(x: bytes, width: int = 4) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(width, -1).T).view(f"<i{width}").ravel()


def _decoded(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    docs, places = [], []
    for d, c, g in zip(t["docs"], t["counts"], t["gaps"], strict=True):
        counts, gaps = _numbers(c.as_py()).astype(np.int64), _numbers(g.as_py()).astype(np.int64)
        run = np.cumsum(gaps)
        first = np.cumsum(counts) - counts
        places.append((run - np.repeat(run[first] - gaps[first], counts)).astype(np.uint32))
        docs.append(np.repeat(np.cumsum(_numbers(d.as_py(), 8)), counts))
    return np.concatenate(docs), np.concatenate(places)


def _unpack(t: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, place and name of each suffix of a range."""
    flat = np.concatenate([np.frombuffer(x.as_py(), np.uint8).reshape(-1, width) for x in t["names"]])
    names = np.zeros((len(flat), 8), np.uint8)
    names[:, :width] = flat
    return *_decoded(t), names.view(np.uint64).ravel()


_FOUND = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("gaps", pa.binary())])
_FOUND_DDL = "bucket int, docs binary, counts binary, gaps binary"
_PRIME, _FACTOR = 1_000_003, 7919


def _bucket_column(doc: Column, buckets: int) -> Column:
    return F.pmod(F.pmod(doc.bitwiseXOR(F.shiftrightunsigned(doc, 17)), F.lit(_PRIME)) * _FACTOR, F.lit(buckets)).cast("int")


def _buckets(docs: np.ndarray, buckets: int) -> np.ndarray:
    """The same for numpy: which bucket of documents a document is in."""
    return (docs ^ (docs.view(np.uint64) >> np.uint64(17)).view(np.int64)) % _PRIME * _FACTOR % buckets


def _by_bucket(docs: np.ndarray, places: np.ndarray, buckets: int) -> pa.Table:
    """What a range found, as a row for each bucket of documents."""
    bucket = _buckets(docs, buckets)
    order = np.lexsort((places, docs, bucket))
    docs, places, bucket = docs[order], places[order].astype(np.int64), bucket[order]
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(docs) else np.zeros(0, np.int64)
    out = {f.name: [] for f in _FOUND}
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(docs)], strict=False):
        d, p = docs[a:b], places[a:b]
        first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        gaps = np.diff(p, prepend=0)
        gaps[first] = p[first]
        out["bucket"].append(int(bucket[a]))
        out["docs"].append(_planes(np.diff(d[first], prepend=0), 8))
        out["counts"].append(_planes(np.diff(np.append(first, len(d))), 4))
        out["gaps"].append(_planes(gaps, 4))
    return pa.table(out, schema=_FOUND)


def _found(t: pa.Table) -> tuple[dict[int, np.ndarray], set[int]]:
    """The sorted places in each document of a bucket, from what all ranges found; and documents that are copies."""
    if not t.num_rows:  # the empty side of a cogroup has no columns
        return {}, set()
    copies = {x for c in t["copies"].to_pylist() if c for x in c}
    t = t.filter(pa.compute.is_valid(t["docs"]))
    if not t.num_rows:
        return {}, copies
    docs, places = _decoded(t)
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order].astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    return dict(zip(docs[starts].tolist(), np.split(places, starts[1:]), strict=True)), copies


def _classes(docs: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by name, and for each place in it the smallest and the largest document that has the name."""
    order = np.argsort(names)
    n, docs = names[order], docs[order]
    first = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]]))
    size = np.diff(np.append(first, len(n)))
    return order, np.repeat(np.minimum.reduceat(docs, first), size), np.repeat(np.maximum.reduceat(docs, first), size)


def _tied(t: pa.Table, buckets: int) -> pa.Table:
    """Sampled suffixes whose name stands in several documents."""
    docs, places, names = _unpack(t, SHORT)
    order, low, high = _classes(docs, names)
    at = order[low != high]
    return _by_bucket(docs[at], places[at], buckets)


def _hit(t: pa.Table, buckets: int) -> pa.Table:
    """Suffixes whose prefix equals that of a suffix of a smaller document."""
    docs, places, names = _unpack(t, LONG)
    order, low, _ = _classes(docs, names)
    at = order[low < docs[order]]
    return _by_bucket(docs[at], places[at], buckets)


def sampled(batches, ranges: int):
    """Packed rows of the sampled suffixes of (doc_id, text)."""
    depth = LENGTH - PERIOD + 1
    pack = Packer(ranges, SHORT)
    for b in slices(batches, "text"):
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            if len(raw) >= LENGTH:
                for s, piece in _pieces(raw, depth):
                    names = triples_of(piece, depth // 3)
                    at = np.flatnonzero(np.resize(_IN_COVER, len(names)))
                    yield from pack.add(doc, at + s, names[at])
    yield from pack.flush()


def remaining(docs: pa.Table, found: pa.Table, ranges: int, turn: int = 0, rounds: int = 1) -> pa.Table:
    """Packed rows of the suffixes that sampled ties leave in a bucket of documents; those whose range is of this turn."""
    tied, copies = _found(found)
    pack, out = Packer(ranges, LONG), []
    for doc, text in zip(docs["doc_id"].to_pylist(), docs["text"], strict=True) if docs.num_rows else ():
        if doc not in tied or doc in copies:
            continue
        raw = np.frombuffer(text.as_py().encode(), np.uint8)
        last = len(raw) - LENGTH
        if last < 0:
            continue
        places = tied[doc]
        # ties among the sampled places of each window of PERIOD places
        ties = np.zeros(len(raw) + 1, np.int32)
        ties[places[places <= len(raw) - (LENGTH - PERIOD + 1)] + 1] = 1
        np.cumsum(ties, out=ties)
        starts = np.flatnonzero(ties[PERIOD : PERIOD + last + 1] > ties[: last + 1])
        for s, piece in _pieces(raw, LENGTH):
            at = starts[np.searchsorted(starts, s) : np.searchsorted(starts, s + len(piece) - LENGTH + 1)]
            if len(at):
                names = names_of(piece, LENGTH)[at - s]
                if rounds > 1:
                    now = _range(names, ranges) % rounds == turn
                    at, names = at[now], names[now]
                out += pack.add(doc, at, names)
    out += pack.flush()
    return pa.Table.from_batches(out, Packer.SCHEMA)


def removed_spans(starts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes that strings of LENGTH bytes at the sorted starts cover."""
    starts = np.unique(starts)
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > LENGTH)
    return list(zip(starts[np.concatenate([[0], gap + 1])].tolist(), (starts[np.append(gap, len(starts) - 1)] + LENGTH).tolist(), strict=True))


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """One row per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and if asked for spans and kept (binary).

    A byte is removed if a string of LENGTH bytes that covers it also starts in a document with a smaller
    id. Matches lie inside documents and are judged on the input. A document whose whole text is that of
    one with a smaller id (by MD5) loses all its bytes if there are LENGTH, and needs no search.

    Null and empty texts have no bytes and lose none. Rows without an id neither lose bytes nor take any.
    Rows that repeat an id are one document: no smaller than itself, searched with each of its texts and
    cut at the places found for any of them. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded(spark)
    base = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = base.filter(f"doc_id is not null and octet_length(text) >= {LENGTH}")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(LEAST_RANGES, int(size * len(COVER) / PERIOD / RANGE) + 1)

    marked = known.select("doc_id", F.unhex(F.md5("text")).alias("h"))
    groups = cut(marked.groupBy("h").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "suffix-copies")
    copies = cut(salted_join(marked, groups, groups, "h", "doc_id").filter("doc_id > first").select("doc_id").distinct(), "suffix-copies")

    buckets = max(LEAST_RANGES, -(-size // BUCKET_BYTES))
    in_bucket = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(buckets)).cast("int")).otherwise(_bucket_column(F.col("doc_id"), buckets)).alias("bucket")
    dealt = base.select("doc_id", "text", in_bucket)
    copied = copies.groupBy(_bucket_column(F.col("doc_id"), buckets).alias("bucket")).agg(F.collect_list("doc_id").alias("copies"))

    def beside(found: DataFrame) -> DataFrame:
        """What was found and the copies, by bucket."""
        return found.unionByName(copied, allowMissingColumns=True).groupBy("bucket")

    packed = known.mapInArrow(lambda it: sampled(it, ranges), Packer.DDL)
    tied = cut(packed.groupBy("range").applyInArrow(lambda t: _tied(t, buckets), _FOUND_DDL), "suffix-tied")
    del packed
    hit = None

    def leaving(turn: int):
        return lambda a, b: remaining(a, b, ranges, turn, ROUNDS)

    for turn in range(ROUNDS):
        rest = dealt.groupBy("bucket").cogroup(beside(tied)).applyInArrow(leaving(turn), Packer.DDL)
        part = cut(rest.groupBy("range").applyInArrow(lambda t: _hit(t, buckets), _FOUND_DDL), "suffix-hit")
        hit = part if hit is None else hit.unionByName(part)
        del rest
    drop(tied)

    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    if with_kept:
        fields += [("spans", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), ("kept", pa.binary())]

    def removed(docs: pa.Table, found: pa.Table) -> pa.Table:
        hits, copies = _found(found)
        out = {name: [] for name, _ in fields}
        for doc, text in zip(docs["doc_id"].to_pylist(), docs["text"], strict=True) if docs.num_rows else ():
            raw = text.as_py().encode()
            if doc in copies and len(raw) >= LENGTH:
                spans = [(0, len(raw))]
            else:
                at = hits.get(doc, np.zeros(0, np.int64))
                spans = removed_spans(at[at <= len(raw) - LENGTH])
            kept, last = [], 0
            for s, e in spans:
                kept.append(raw[last:s])
                last = e
            left = b"".join([*kept, raw[last:]])
            row = (doc, len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), [{"s": s, "e": e} for s, e in spans], left)
            for name, value in zip(out, row, strict=False):
                out[name].append(value)
        return pa.table(out, schema=pa.schema(fields))

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<s:long,e:long>>, kept binary" * with_kept
    return dealt.groupBy("bucket").cogroup(beside(hit)).applyInArrow(removed, ddl)


def _oracle() -> str:
    return r"""
with d as (select doc_id, encode(coalesce(text, '')) as b, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, i, substr(h, 2 * i + 1, 100) as g from (select doc_id, h, unnest(range(0, octet_length(b) - 49)) as i from d where octet_length(b) >= 50)),
lows as (select g, min(doc_id) as low from w group by g),
starts as (select doc_id, i, lag(i) over (partition by doc_id order by i) as prev from w join lows using (g) where doc_id > low),
runs as (select doc_id, i, sum(case when prev is null or i - prev > 50 then 1 else 0 end) over (partition by doc_id order by i) as run from starts),
spans as (select doc_id, run, min(i) as s, max(i) + 50 as e from runs group by doc_id, run),
gaps as (select doc_id, s, e, lag(e, 1, 0) over (partition by doc_id order by s) as kept_from from spans),
kept as (
    select d.doc_id, sum(e - s) as n_removed, count(*) as n_spans,
           string_agg(substr(h, cast(2 * kept_from + 1 as bigint), cast(2 * (s - kept_from) as bigint)), '' order by s) || substr(any_value(h), cast(2 * max(e) + 1 as bigint)) as k
    from gaps join d using (doc_id) group by d.doc_id
)
select d.doc_id, cast(octet_length(b) as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256
from d left join kept using (doc_id)
"""


ORACLE = _oracle()
