"""Rows with the odd cases, and brute-force versions that more than one test file needs."""

from __future__ import annotations

import random
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, key int, n double, comp string, t string, rep int"


def texts_with_odd_cases() -> list[tuple[int | None, str | None, str | None]]:
    rng = random.Random(4)
    en = "the and of that with this from have were their which would about other into than".split()
    de = "der und die nicht eine auch werden über zwischen wieder können straße für mit von".split()
    word = lambda pool: rng.choice(pool) + rng.choice(["", "", "ing", "keit"]) + rng.choice("abcdefghij")
    prose = lambda pool, n: " ".join(rng.choice(pool) if rng.random() < 0.5 else word(pool) for _ in range(n))
    out: list[tuple[int | None, str | None, str | None]] = []
    base = [prose(en, 120) for _ in range(12)] + [prose(de, 120) for _ in range(12)]
    for i, t in enumerate(base):
        out.append((i, t, "en" if i < 12 else "de"))
    for i in range(12):  # copies, near copies, shared passages
        w = base[i].split(" ")
        out.append((100 + i, base[i], "en"))
        w[5] = "changed"
        out.append((200 + i, " ".join(w), "en"))
        out.append((300 + i, prose(en, 30) + " " + base[0][40:400] + " " + prose(de, 30), None))
    chain = base[1].split(" ")
    for i in range(14):  # neighbours are near copies, the ends are not
        chain = [*chain]
        for j in range(4):
            chain[(i * 8 + j * 2) % len(chain)] = f"new{i}{j}"
        out.append((400 + i, " ".join(chain), "en"))
    out += [(500, None, None), (501, "", "en"), (502, " \t\n ", "de"), (503, "x", "en"), (504, "X", "en"), (505, "12 !! 34", None), (506, "a  b\tc", "en"), (507, "a b c", "en"), (508, "Ünïcode ΣΑΣ 日本語 😀 İ", "en"), (509, None, None), (None, base[3], "en"), (None, None, None)]
    out += [(510, prose(en, 4000), "en"), (511, "ab" * 3000, "en"), (512, "<|endoftext|> don't <|startoftext|>x", "en"), (513, "é" * 60 + " é́ ﬁ ½", "de"), (-7, base[4], "en"), (514, "z" * 49, None), (515, "z" * 50, None), (516, "z" * 51, None)]
    out += [(0, base[0], "en"), (503, "x", "en")]  # repeated rows
    return out


def brute_hits(text, items, n):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = cut(text), set(), set()
    for item, t in items:
        x = cut(t)
        k = min(n, len(x))
        for i in range(len(x) - k + 1 if x else 0):
            for j in range(len(w) - k + 1):
                if w[j : j + k] == x[i : i + k]:
                    hit |= set(range(j, j + k))
                    found.add(item)
    return len(w), len(hit), found


def brute_components(rows, size, percent=80):
    sets = {}
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(size, len(w))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = [i for i in sets if i is not None and sets[i]]
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return Counter((i, len(sets[i]), find(i) if i is not None else None, i == find(i) if i is not None else True) for i, _, _ in rows)
