"""Exact token counts of every prefix by dynamic programming over a text's words, without encoding a prefix anew."""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import Memo, arrow_rows, bounded, pick, slices, turn

#: Words whose counts a worker keeps.
CACHE_WORDS = 600_000

#: Characters up to here split by the fast pattern below; texts with others are split by the tokenizer library's own parts.
_FAST = re.compile(r"[\x00-\x1b \x21-\x7f\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\u017f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]*")
_LETTERS = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
#: The splitting pattern of the vocabulary file, for the characters above.
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+")


class WordBpe:
    """Prefix counts for a BPE vocabulary with word ends (a tokenizers JSON file)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.end = spec["model"]["end_of_word_suffix"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        vocab = set(spec["model"]["vocab"])
        self.closed = {x[: -len(self.end)] for x in vocab if x.endswith(self.end)}
        self.open = {x for x in vocab if not x.endswith(self.end)}
        self.most = max(map(len, self.open | self.closed))
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.special_at = re.compile("|".join(map(re.escape, self.special)))
        self.fits: dict[tuple[str, str, bool], bool] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        #: A byte's character in the vocabulary: itself if it can be shown, else one from U+0100 on.
        self.byte = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.memo = Memo(CACHE_WORDS)

    def _merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE of a short sequence; the pair check below needs it."""
        while len(symbols) > 1:
            rank, i = min((self.ranks.get(p, 1 << 30), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 30:
                break
            symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]
        return symbols

    def _fit(self, a: str, b: str, closed: bool) -> bool:
        """Whether b can follow a: the two together encode as these two tokens. a may be empty."""
        if (known := self.fits.get((a, b, closed))) is None:
            end = self.end if closed else ""
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[a, b, closed] = self._merged([*a, *b[:-1], b[-1] + end]) == ([a] if a else []) + [b + end]
        return known

    def _step(self, word: str, i: int, last: list[str], count: list[int], closed: bool) -> tuple[str, int]:
        """The last token of word[:i] and the number of its tokens, from those of shorter prefixes."""
        vocab = self.closed if closed else self.open
        for j in range(max(0, i - self.most), i):
            if (t := word[j:i]) in vocab and self._fit(last[j], t, closed):
                return t, count[j] + 1
        raise ValueError(f"no token ends {word[:i]!r}")

    def word_prefixes(self, word: str) -> list[int]:
        """For a word in vocabulary characters: the tokens of each of its prefixes, each ended as a word; the last is the word's."""
        last, count, out = [""], [0], [0]
        for i in range(1, len(word) + 1):
            out.append(self._step(word, i, last, count, True)[1])
            t, n = self._step(word, i, last, count, False)
            last.append(t)
            count.append(n)
        return out

    def word_count(self, word: str) -> int:
        """Tokens of a whole word (raw characters)."""
        word = word if word.isascii() and word.isprintable() else "".join(map(self.byte.__getitem__, word.encode()))
        if word in self.closed and self._fit("", word, True):
            return 1
        last, count = [""], [0]
        for i in range(1, len(word)):
            t, n = self._step(word, i, last, count, False)
            last.append(t)
            count.append(n)
        return self._step(word, len(word), last, count, True)[1]

    def words(self, text: str) -> list[str]:
        """Words of a text without special strings, normalised and split as the library does."""
        if _FAST.fullmatch(text):
            return _SPLIT.findall(unicodedata.normalize("NFC", text).lower())
        out = []
        lib = self.library
        for w, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text)):
            out.append(w)
        return [self._raw(w) for w in out]

    def _raw(self, w: str) -> str:
        back = self.__dict__.setdefault("_back", {c: b for b, c in self.byte.items()})
        return bytes(back[c] for c in w).decode("utf-8", "surrogateescape")

    def counts(self, words: list[str]) -> list[int]:
        memo = self.memo
        try:
            return [memo.new[w] for w in words]
        except KeyError:
            for w in memo.missing(set(words)):
                memo.new[w] = self.word_count(w)
            out = [memo.new[w] for w in words]
            memo.turn()
            return out

    def total(self, text: str | None) -> int:
        """Tokens of the whole text: the last of its prefix counts."""
        if not text:
            return 0
        if "<|" not in text:
            return sum(self.counts(self.words(text)))
        at = self.special_at.findall(text)
        return len(at) + sum(sum(self.counts(self.words(x))) for x in self.special_at.split(text) if x)

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """out[i]: tokens of the words that end within the first i words (out[0] = 0); special strings count as words of one token."""
        if not text:
            return np.zeros(1, np.int64)
        parts: list[int] = []
        last = 0
        for m in self.special_at.finditer(text):
            parts += self.counts(self.words(text[last : m.start()])) if m.start() > last else []
            parts.append(1)
            last = m.end()
        parts += self.counts(self.words(text[last:]))
        return np.concatenate([[0], np.cumsum(parts, dtype=np.int64)])

    def char_prefix_counts(self, text: str) -> list[int]:
        """out[k]: tokens of text[:k], for texts that the fast pattern splits and that hold no special string.

        A prefix ends inside a word or other unit; the count is that of the whole words before plus the count
        of the unit's prefix, which the dynamic program has for all its prefixes at once.
        """
        low = text.lower()
        if not _FAST.fullmatch(text) or self.special_at.search(text) or unicodedata.normalize("NFC", text) != text or len(low) != len(text):
            return [self.total(text[:k]) for k in range(len(text) + 1)]
        out, done, at = [0] * (len(low) + 1), 0, 0
        for m in _SPLIT.finditer(low):
            out[at : m.start() + 1] = [done] * (m.start() + 1 - at)
            w = m.group()
            if w[0] == "'" and len(w) > 1 and w[1].isalpha():  # a contraction's prefix is split differently
                for k in range(1, len(w) + 1):
                    out[m.start() + k] = done + sum(self.counts(_SPLIT.findall(w[:k])))
            else:
                by_byte = self.word_prefixes("".join(map(self.byte.__getitem__, w.encode())))
                b = 0
                for k, c in enumerate(w, 1):
                    b += len(c.encode())
                    out[m.start() + k] = done + by_byte[b]
            done, at = out[m.end()], m.end()
        out[at:] = [done] * (len(low) + 1 - at)
        return out

    def words_within(self, text: str | None, budget: int) -> int:
        """The most words whose tokens fit the budget: a truncation point, read from the prefix counts."""
        return bisect_right(self.prefix_counts(text), budget) - 1


_CACHED: dict[str, WordBpe] = {}


def _forget() -> None:
    _CACHED.clear()


def counter(path: str) -> WordBpe:
    """One counter for each worker process."""
    if path not in _CACHED:
        _CACHED[path] = WordBpe(path)
    return _CACHED[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, with_prefixes: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_bytes, n_tokens, over_limit, words_in_limit (whole words that fit the limit), and
    prefix_tokens (tokens up to the end of each word) if asked for.

    vocabulary is a path that every executor has. Null and empty texts have 0 bytes and tokens. Special
    strings in a text are one token each, as the library takes them. Nothing is truncated. Rows are
    independent, so repeated rows repeat results and an empty table gives none.
    """
    bounded(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("words_in_limit", pa.int64()), *([("prefix_tokens", pa.list_(pa.int64()))] if with_prefixes else [])])

    def count(batches):
        turn("token counts", _forget)
        bpe = counter(vocabulary)
        for b in slices(batches, "text"):
            texts = b.column(1).to_pylist()
            sums = [bpe.prefix_counts(t) for t in texts]
            n = [int(s[-1]) for s in sums]
            cols = {"doc_id": b.column(0), "n_bytes": [len(t.encode()) if t else 0 for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n], "words_in_limit": [int(np.searchsorted(s, limit, "right")) - 1 for s in sums]}
            yield arrow_rows(schema, **cols, **({"prefix_tokens": [s[1:].tolist() for s in sums]} if with_prefixes else {}))

    out = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, words_in_limit long" + ", prefix_tokens array<long>" * with_prefixes
    return pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(count, out)
