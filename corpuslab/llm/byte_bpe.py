"""Byte-level BPE encoding and decoding with DuckDB recursive queries in each partition."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import Memo, arrow_rows, bounded, pick, slices, turn

#: Pieces whose tokens a worker keeps, and the bytes of the longest that it keeps; pieces and bytes in one recursive query
#: (one piece at least).
CACHE_PIECES, KEPT_BYTES, QUERY_PIECES, QUERY_BYTES = 650_000, 400, 40_000, 1 << 20

#: Texts of these characters are split by Python's re, which knows their classes from the ranges below.
_FAST = re.compile(r"[\x00-\x1b \x21-\x7f\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-ſ‐-‧‰-⁞₠-₿]*")
_LETTERS = "a-zA-ZÀ-ÖØ-öø-ſ"

#: The splitting pattern of the 50k vocabularies, and the same for the characters above.
_KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_QUICK = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+"

#: Each step contracts, in every word that the last step changed, the places of its least rank, leftmost first. What a step
#: leaves is the next token of the place and a mark (-1) where the right part was, by key: rows of earlier steps are gone.
#: Places that follow the leftmost one are contracted in the same step up to one that makes a pair of a lesser rank, which is
#: what the sequential rule would contract next; of places that overlap, every second one is left.
RECURSION = """
with recursive t(w, pos, tok) using key (w, pos) as (
    select w, pos, tok from start
    union
    (with live as (
        select w, pos, tok, lag(tok) over win as before, lag(pos) over win as before_pos, lead(tok) over win as nxt, lead(pos) over win as nxt_pos, lead(tok, 2) over win as after
        from (select r.w, r.pos, r.tok from recurring.t r where r.tok >= 0 and r.w in (select w from t)) window win as (partition by w order by pos)
    ),
    pair as materialized (select w, pos, nxt_pos, before, before_pos, after, merged from live join merges on lt = tok and rt = nxt),
    least as (select w, min((merged << 32) | pos) as best from pair group by w),
    place as materialized (select pair.*, best & 4294967295 as spot from pair join least on least.w = pair.w and best >> 32 = merged),
    run as (
        select *, sum(fresh) over (partition by w order by pos) as run
        from (select *, case when lag(nxt_pos) over (partition by w order by pos) is distinct from pos then 1 else 0 end as fresh
              from place where w in (select w from place where pos != spot))
    ),
    turn as (select *, row_number() over (partition by w, run order by pos) as nth from run),
    alternate as (select *, case when lag(nxt_pos) over (partition by w order by pos) = before_pos then merged else before end as beside from turn where nth % 2 = 1),
    taken as (
        select *, case when exists (select 1 from lesser l where l.made = merged and l.lt = beside)
                         or exists (select 1 from lesser r where r.made = merged and r.rt = after) then 1 else 0 end as opens
        from alternate
    ),
    upto as (select *, sum(opens) over (partition by w order by pos) - opens as opened from taken)
    select w, unnest([pos, nxt_pos]) as pos, unnest([merged, -1]) as tok
    from (select w, pos, nxt_pos, merged from place where pos = spot union select w, pos, nxt_pos, merged from upto where opened = 0))
),
fixed as (select w, pos, tok from t where tok >= 0 union all select w, 0, tok from whole)
select w, count(*) as n, list(tok order by pos) as ids, string_agg(v.hex, '' order by pos) as bytes
from fixed join vocab v on v.id = tok group by w order by w
"""


def _white_space(pattern: str) -> str:
    """The pattern with \\s and \\S as the Unicode property, which is what they mean to the tokenizer library."""
    return re.sub(r"\\(.)", lambda m: {"s": r"\p{White_Space}", "S": r"\P{White_Space}"}.get(m[1], m[0]), pattern, flags=re.S)


class ByteBpe:
    """Encoder and decoder for a rank file (base64 token, rank; all single bytes are tokens) and a splitting pattern."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(_white_space(pattern))
        #: Python's re splits texts of common characters faster; only the pattern it was written for has such a form.
        self.quick = re.compile(_QUICK) if pattern == _KNOWN else None
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.memo, self.passing = Memo(CACHE_PIECES), []
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self.db.execute("set preserve_insertion_order = false")
        merges = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        # pairs with a token that are contracted before the token itself is made: (token, left part, right part)
        lesser = [(r, a, None) for a, r, m in merges if m < r] + [(a, None, r) for a, r, m in merges if m < a]
        column = lambda rows, i: pa.array([x[i] for x in rows], pa.int64())
        tables = {
            "merges": pa.table({c: column(merges, i) for i, c in enumerate(("lt", "rt", "merged"))}),
            "lesser": pa.table({c: column(lesser, i) for i, c in enumerate(("made", "lt", "rt"))}),
            "vocab": pa.table({"id": pa.array(list(self.tokens)), "hex": pa.array([t.hex() for t in self.tokens.values()])}),
        }
        for name, rows in tables.items():
            self.db.register("given", rows)
            self.db.execute(f"create table {name} as select * from given")
            self.db.unregister("given")
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)

    def pieces(self, text: str) -> list[str]:
        if self.quick and _FAST.fullmatch(text):
            return self.quick.findall(text)
        return [m.group() for m in self.split.finditer(text)] if self.split.groups else self.split.findall(text)

    def _query(self, pieces: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids (little-endian, 32 bits) and decoded bytes of each piece: one recursive query."""
        whole = [(i, r) for i, p in enumerate(pieces) if (r := self.ranks.get(p)) is not None]
        taken = {i for i, _ in whole}
        rest = [i for i in range(len(pieces)) if i not in taken]
        size = np.array([len(pieces[i]) for i in rest], np.int64)
        first = np.cumsum(size) - size
        start = {"w": np.repeat(np.array(rest, np.int64), size), "pos": np.arange(size.sum()) - np.repeat(first, size), "tok": self.single[np.frombuffer(b"".join(pieces[i] for i in rest), np.uint8)]}
        self.db.register("start", pa.table(start))
        self.db.register("whole", pa.table({"w": pa.array([i for i, _ in whole], pa.int64()), "tok": pa.array([r for _, r in whole], pa.int64())}))
        got = self.db.sql(RECURSION).to_arrow_table().combine_chunks()
        ids = got["ids"].combine_chunks()
        flat = np.asarray(ids.flatten()).astype("<u4").tobytes()
        at = np.concatenate([[0], np.cumsum(np.asarray(got["n"]))]) * 4
        return [(flat[a:b], bytes.fromhex(h)) for a, b, h in zip(at[:-1].tolist(), at[1:].tolist(), got["bytes"].to_pylist(), strict=True)]

    def learn(self, pieces: Iterable[str]) -> None:
        """Tokens of pieces that the memo lacks."""
        some: list[str] = []
        raw: list[bytes] = []
        held = 0

        def ask() -> None:
            for p, out in zip(some, self._query(raw), strict=True):
                self.memo.new[p] = out
            some.clear()
            raw.clear()

        for p in pieces:
            b = p.encode()
            if some and (len(some) == QUERY_PIECES or held + len(b) > QUERY_BYTES):
                ask()
                held = 0
            some.append(p)
            raw.append(b)
            held += len(b)
            if len(b) > KEPT_BYTES:
                self.passing.append(p)
        if some:
            ask()

    def encode_batch(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """For each text its ids (little-endian, 32 bits) and the bytes decoded from them."""
        cut = [self.pieces(t) if t else [] for t in texts]
        if missing := self.memo.missing(set(chain.from_iterable(cut))):
            self.learn(missing)
        find = self.memo.new.__getitem__
        out = []
        for x in cut:
            got = list(map(find, x))
            out.append((b"".join([i for i, _ in got]), b"".join([d for _, d in got])))
        for p in self.passing:  # long pieces are not kept
            del self.memo.new[p]
        self.passing.clear()
        self.memo.turn()
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids by one ordered aggregation."""
        self.db.register("given", pa.table({"pos": pa.array(range(len(ids)), pa.int64()), "tok": pa.array(ids, pa.int64())}))
        got = self.db.execute("select string_agg(v.hex, '' order by pos) from given join vocab v on v.id = tok").fetchone()[0]
        return bytes.fromhex(got or "")


_CACHED: dict[tuple[str, str], ByteBpe] = {}


def _forget() -> None:
    _CACHED.clear()


def coder(path: str, pattern: str) -> ByteBpe:
    """One coder for each worker process."""
    if (path, pattern) not in _CACHED:
        _CACHED[path, pattern] = ByteBpe(path, pattern)
    return _CACHED[path, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and if asked for ids (array) and decoded (binary).

    A text is split into pieces, each contracted by the recursive query, whose ordered aggregation gives its
    ids and decodes them; a text's are those of its pieces in order.

    Null and empty texts have no tokens (hashes of no bytes). Special strings are ordinary text. Rows are
    independent: repeated rows repeat results, an empty table gives none. ranks is a path that every executor has.
    """
    bounded(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *([("ids", pa.list_(pa.int32())), ("decoded", pa.binary())] if with_ids else [])]

    def run(batches):
        turn("byte BPE", _forget)
        bpe = coder(ranks, pattern)
        for b in slices(batches, "text"):
            got = bpe.encode_batch(b.column(1).to_pylist())
            cols = {"doc_id": b.column(0), "n_tokens": [len(a) // 4 for a, _ in got], "ids_sha256": [hashlib.sha256(a).hexdigest() for a, _ in got], "decoded_sha256": [hashlib.sha256(d).hexdigest() for _, d in got]}
            if with_ids:
                cols |= {"ids": [np.frombuffer(a, "<u4").astype(np.int32).tolist() for a, _ in got], "decoded": [d for _, d in got]}
            yield arrow_rows(pa.schema(fields), **cols)

    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids
    return pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, out)
