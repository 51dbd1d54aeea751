"""Every operator against a brute-force version, on a fixture with the odd cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from llm_fixtures import SCHEMA, brute_components, brute_hits, texts_with_odd_cases

from corpuslab.llm import byte_bpe, decontaminate, exact_dedup, hmm_lm, html_extract, language_id, minhash, sharding, suffix_dedup, token_counts


@pytest.fixture(scope="module")
def rows():
    return texts_with_odd_cases()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", None, "clash", 1, 0.5, "clash", "clash", 3) for i, t, g in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def multiset(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def test_token_counts(docs, none, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    want = Counter((i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, _ in rows)
    assert multiset(token_counts.token_counts(docs, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.token_counts(none, path).count() == 0
    bpe = token_counts.WordBpe(path)
    for text in ("we'll go to 12 étés, thertion!!!", " 'lla it's", "a😀b", "don't <|endoftext|> x"):
        assert bpe.char_prefix_counts(text) == [len(lib.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
    got = token_counts.token_counts(docs.filter("doc_id = 3"), path, limit=50, with_prefixes=True).first()
    words = bpe.words(rows[3][1])
    assert got.prefix_tokens == [len(lib.encode(" ".join(words[:k]), add_special_tokens=False).ids) for k in range(1, len(words) + 1)]
    assert got.words_in_limit == sum(n <= 50 for n in got.prefix_tokens)


@pytest.mark.parametrize("block", [2_000_000, 40])
def test_decontamination(spark, docs, none, rows, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    w = rows[2][1].split(" ")
    items = [("b", " ".join(w[5:30])), ("a", " ".join(w[10:20]).upper()), ("c", "x"), ("d", None), ("e", ""), ("f", "nowhere to be seen in any of these texts at all"), ("g", "straße"), (None, "the and")]
    tests = spark.createDataFrame(items, "item_id string, text string")
    want, clean = Counter(), Counter()
    for i, t, _ in rows:
        n, hit, found = brute_hits(t, items, 10)
        found -= {None}  # an item without an id hits words, but is not listed
        want[(i, n, hit, len(found), sha(",".join(sorted(found)).encode()), hit > 0)] += 1
        clean[i, t] += hit == 0
    got = multiset(decontaminate.digest(decontaminate.benchmark_hits(docs, tests)), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == want
    assert decontaminate.benchmark_hits(none, tests).count() == 0
    assert decontaminate.benchmark_hits(docs, tests.limit(0)).filter("size(spans) > 0").count() == 0
    assert Counter((r.doc_id, r.text) for r in decontaminate.drop_contaminated(docs, tests).collect()) == +clean


def test_decontamination_collisions(monkeypatch, rows):
    """Hashes that all collide change nothing: windows are verified word by word."""
    w = rows[2][1].split(" ")
    items = [("b", " ".join(w[5:30])), ("g", "straße"), ("h", "the and")]
    texts = [t for _, t, _ in rows]
    plain = [(n, hit.tolist(), found) for n, hit, found in decontaminate.NgramSet(items, 10).scan(texts)]
    monkeypatch.setattr(decontaminate.NgramSet, "_hash", lambda self, rows: np.zeros(len(rows), np.uint64))
    assert [(n, hit.tolist(), found) for n, hit, found in decontaminate.NgramSet(items, 10).scan(texts)] == plain


def test_rows_that_share_an_id_go_for_their_own_text(spark):
    """Stages of the pipeline drop rows by their text: one that shares its id with a dropped row stays."""
    docs = spark.createDataFrame([(1, "alpha beta gamma", "en"), (1, "secret words here", "en"), (1, "12 34", "en"), (2, "alpha  beta gamma", "en"), (3, None, "en"), (None, "clean text", "en")], "doc_id long, text string, lang string")
    tests = spark.createDataFrame([("t", "secret words")], "item_id string, text string")
    of = lambda df: sorted((r.doc_id or 0, r.text or "") for r in df.collect())
    every = of(docs)
    assert of(decontaminate.drop_contaminated(docs, tests)) == [x for x in every if x[1] != "secret words here"]
    assert of(language_id.drop_unidentified(docs)) == [x for x in every if x[1] not in ("12 34", "")]
    assert of(exact_dedup.drop_copies(docs)) == [x for x in every if x[1] != "alpha  beta gamma"]


def test_remove_spans():
    assert decontaminate.remove_spans("One, two THREE four!", [(1, 3)]) == "One, four!".replace("One, four", "One,  four")


def brute_minimax(sizes, shards):
    low, high = max([1, *sizes]), max(1, sum(sizes))

    def fits(c):
        n, at = 1, 0
        for s in sizes:
            n, at = (n + 1, s) if at + s > c else (n, at + s)
        return n <= shards

    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def test_minimax(spark):
    rng = random.Random(2)
    for n, shards in ((400, 7), (60, 24), (5, 24), (3000, 24)):
        groups = sorted((rng.getrandbits(60), rng.randint(1, 900) ** 2) for _ in range(n))
        cuts, capacity = sharding.minimax_cuts(spark.createDataFrame(groups, "key long, weight long"), shards)
        assert capacity == brute_minimax([w for _, w in groups], shards)
        load = Counter()
        for key, w in groups:
            load[sum(key >= c for c in cuts)] += w
        assert max(load.values()) == capacity and max(load) < shards


def test_sharding(docs, none, rows):
    got = sharding.shard_documents(docs, shards=6).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    by = defaultdict(list)
    where = defaultdict(set)
    text = {zlib.crc32((t or "").encode()): t or "" for _, t, _ in rows}
    for r in got:
        by[r.shard].append(r)
        where[text[r.text_crc32]].add(r.shard)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values()) and all(len(v) == 1 for v in where.values())
    assert set(by) <= set(range(6)) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert sharding.shard_documents(none).count() == 0


def brute_repeats(rows):
    grams = defaultdict(lambda: 1 << 62)
    raw = [(i, (t or "").encode()) for i, t, _ in rows]
    for i, b in raw:
        if i is not None:
            for k in range(len(b) - 49):
                grams[b[k : k + 50]] = min(grams[b[k : k + 50]], i)
    for i, b in raw:
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - 49 if i is not None else 0):
            if grams[b[k : k + 50]] < i:
                gone[k + 1 : k + 51] = True
        kept = bytes(x for x, g in zip(b, gone[1:], strict=False) if not g)
        yield i, len(b), len(b) - len(kept), int((gone[1:] & ~gone[:-1]).sum()), sha(kept)


@pytest.mark.parametrize("piece", [2 << 20, 210])
def test_suffix_dedup(docs, none, rows, monkeypatch, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    # chunks are made by Python workers, so the piece is also tried here directly
    text = np.frombuffer((rows[0][1] * 3).encode(), np.uint8)
    whole = suffix_dedup.names_of(text, 50)
    assert all((suffix_dedup.names_of(p, 50) == whole[s : s + len(p) - 49]).all() for s, p in suffix_dedup._pieces(text, 50))
    if piece == 210:
        return
    assert multiset(suffix_dedup.repeated_bytes(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter(brute_repeats(rows))
    assert suffix_dedup.repeated_bytes(none).count() == 0
    r = suffix_dedup.repeated_bytes(docs.filter("doc_id in (0, 300)"), with_kept=True).filter("doc_id = 300").first()
    raw = rows[[x[0] for x in rows].index(300)][1].encode()
    assert r.kept == b"".join(raw[a:b] for a, b in zip([0, *[s.e for s in r.spans]], [*[s.s for s in r.spans], len(raw)], strict=True))


def test_difference_cover():
    for d in range(suffix_dedup.PERIOD):
        assert any((c + d) % suffix_dedup.PERIOD in suffix_dedup.COVER for c in suffix_dedup.COVER)


PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header>Site {0}</header><nav><a href="/a>b">Menu</a></nav><div class="ad">Buy</div><div id="cookie-notice">Cookies</div><article><h1>Head {0}</h1><p>One &amp; <b>two</b>&nbsp;three {0}<br>four<p>Unclosed <i>five</i>{0}<script>var x="</p>";</script></p><!-- gone --><ul><li>six</li></ul><form><input>Send</form></article><section class="comments"><p>Reader says</p></section><aside>Side</aside><footer>&copy; x</footer></body></html>'
PLAIN = "<html><body><div class='menu'>Menu</div><div class='main-text'><p>Body text number {0} is long enough to win.</p><p>Always the same line.</p></div><div class='box'>Small</div></body></html>"


def test_html(spark):
    pages = [(i, f"https://u@Host.example/{i}?q", PAGE.format(i)) for i in range(8)] + [(20 + i, "http://plain.example/x", PLAIN.format(i)) for i in range(8)]
    pages += [(40, None, None), (41, "", ""), (42, "x", "just text &lt;b&gt;  here"), (None, "http://a.b", "<p>no id</p>"), (43, "http://one.example", PLAIN.format(7)), (44, "http://bad", "<div <p>a < b</div>"), (42, "x", "just text &lt;b&gt;  here")]
    df = spark.createDataFrame([(*p, "clash", 1, "clash", 2) for p in pages], "page_id long, url string, html string, host string, k int, token string, row int")
    rows = html_extract.extract_text(df).collect()
    got = {r.page_id: r for r in rows}
    for i in range(8):
        # what all pages of a host have inside the article stays: nothing else is dropped
        assert got[i].text == f"Head {i} One & two three {i} four Unclosed five{i} six"
        assert got[20 + i].text == f"Body text number {i} is long enough to win."
    assert got[40].text == got[41].text == "" and got[40].n_chars == 0
    assert got[42].text == "just text <b> here" and got[None].text == "no id"
    assert got[43].text == "Body text number 7 is long enough to win. Always the same line. Small"
    assert Counter(r.page_id for r in rows) == Counter(p[0] for p in pages) and all(r.n_chars == len(r.text) for r in rows)
    assert html_extract.extract_text(df.limit(0)).count() == 0


def main_text(page):
    return " ".join(b.text for b in html_extract.candidates(html_extract.parse(page))[0])


@pytest.mark.parametrize(
    "page, want",
    [
        ("<div class='page has-sidebar'><article><header><h1>T</h1></header><p>Text</p></article><div class='sidebar'>no</div><section id='reader-comments'><article class='comment'>no</article></section></div>", "T Text"),
        ("<p>a<br>b <b>c</b>d</p>&#xe9;<nav>no<p>no</nav>", "a b cd \u00e9"),
        ("<html><head><title>x</title><body><article><p>No end of head</p></article>", "No end of head"),
        ("<html><head><title>x<body><article><p>No end of title</p></article>", "No end of title"),
        ("<body><div class=sidebar>no</div><article class='post comments-open'><p>Text</p></article>", "Text"),
        ("<form id='aspnetForm'><div><article><p>In a form</p></article><button>no</button></div></form>", "In a form"),
        ("<form id='aspnetForm'><div><p>In a form, without an article</p></div></form>", "In a form, without an article"),
        ("<article><p>a</p><div class='share-price'><p>b</p></div><div class='ad'>no</div><form>no</form></article>", "a b"),
        ("<article><p>a</p><svg><path><p>b</p></article><object data=x><textarea>", "a b"),
        ("<main><div class='content with-sidebar'><article><p>x</p></article></div><section id=reader-comments><article class=comment>no</article></section></main>", "x"),
        ("<div>The text of a page without an article, longer than what is said</div><section class=comments><article class=comment>no</article></section>", "The text of a page without an article, longer than what is said"),
        ("<body class='comments-open'><ul><li><a href=x>no</a><li><a>no</a></ul><div hidden>no</div><p>x", "x"),
    ],
)
def test_html_marks(page, want):
    assert main_text(page) == want


def brute_templates(pages, support):
    """Texts of pages (row, url, html): tokens are grouped by their full occurrence vectors, as sets of rows."""
    where, is_frame, parts = defaultdict(set), {}, {}
    for row, url, page in pages:
        own, outside = html_extract.candidates(html_extract.parse(page))
        elements = {x.number: x for b in outside for x in (*b.element.around, b.element)}
        seen, host = Counter(), html_extract.host_of(url)
        names = {}
        for number in sorted(elements):
            seen[elements[number].path] += 1
            where[host, "frame", elements[number].path, seen[elements[number].path]].add(row)
        if elements:
            where[host, "frame", tuple(sorted({x.path for x in elements.values()}))].add(row)
        for b in outside:
            seen[b.element.path, b.text] += 1
            names[id(b)] = (host, "text", b.element.path, b.text, seen[b.element.path, b.text])
            where[names[id(b)]].add(row)
        parts[row] = [(b.text, names.get(id(b))) for b in own]
    classes = defaultdict(list)
    for token, rows in where.items():
        classes[frozenset(rows)].append(token)
    shared = {t: len(rows) for rows, held in classes.items() if len(rows) >= support and any(x[1] == "frame" for x in held) for t in held if t[1] == "text"}
    out = {}
    for row, blocks in parts.items():
        low = min((shared.get(t, 0) for _, t in blocks), default=0)
        out[row] = " ".join(x for x, t in blocks if shared.get(t, 0) == low)
    return out


def made_pages(rng):
    """Pages without article elements: layouts, boxes that some pages have, notices twice a page, copies; and their main text."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    out = []
    for host in range(4):
        fixed = [line(rng.randint(3, 20)) for _ in range(8)]
        for k in range(rng.randint(9, 14)):
            paras = [line(rng.randint(5, 60)) for _ in range(rng.randint(1, 5))]
            body = f"<h1>{line(4)}</h1>" + "".join(f"<p>{p}</p>" for p in paras)
            text = " ".join([body[4 : body.index("</h1>")], *paras])
            if host % 2 and k % 2:  # another layout
                page = f"<body><table><tr><td><div class=l>{fixed[0]}</div><td><div class=text{k}>{body}</div><div>{fixed[1]}</div></table>"
            else:
                box = f"<section><p>{fixed[2]}</p></section>" if k != 3 else ""  # all pages but one
                page = f"<body><div class=top><p>{fixed[3]}<p>{fixed[4]}</div>{box}<div class=text{k}>{body}</div><p>{fixed[5]}<p>{fixed[5]}</p></body>"  # the last twice
            out.append((len(out), f"http://h{host}.org/{k}", page, text))
    return out


def test_html_classes(spark):
    pages = made_pages(random.Random(8))
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string").repartition(3)).collect()}
    assert got == brute_templates([p[:3] for p in pages], html_extract.SUPPORT)
    shares = []
    for i, _, _, text in pages:
        a, b = Counter(got[i].split()), Counter(text.split())
        shares.append(2 * (a & b).total() / (a.total() + b.total()))
    assert sum(shares) / len(shares) >= 0.95 and min(shares) > 0.8


def test_html_slots_are_judged_by_the_host(spark):
    """A box that holds most of one page's text, and a text of links only: the host's pages say what the slots are."""
    long, page = "word " * 30, "<body><div class=text><p>Text {0} {1}</p></div><div class=promo><p>Promo {0} {2}</p></div></body>"
    pages = [(i, "http://a.org", page.format(i, long, "x")) for i in range(6)]
    pages += [(6, "http://a.org", page.format(6, "short", long)), (7, "http://a.org", "<body><div class=text><p><a href=x>Only linked text</a></p></div><div class=more><p>More</p></div></body>")]
    pages += [(8, "http://one.org", page.format(8, "short", long))]  # too few pages to judge by
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()}
    text = lambda i: f"Text {i} {long.strip()}"
    assert got == {**{i: text(i) for i in range(6)}, 6: "Text 6 short", 7: "Only linked text More", 8: f"Text 8 short Promo 8 {long.strip()}"}


def test_html_blocks_that_nothing_can_make_main_ask_for_nothing(spark, monkeypatch):
    """Where the pages of a host agree, text beside the article is neither joined nor in the result."""
    asked, join = [], html_extract.salted_join
    monkeypatch.setattr(html_extract, "salted_join", lambda rows, *a, **k: (asked.append(rows.count()), join(rows, *a, **k))[1])
    pages = [(i, "http://a.org", f"<body><article><p>Article {i}</p></article><div><p>Beside it {i}</p><p>The same line</p></div>") for i in range(8)]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Article {i}" for i in range(8)} and asked == [0]


def test_html_hot_host_and_copies(spark):
    copy = "<body><div><p>Copied text</p><p>and more of it</p></div>"
    pages = [(i, "http://a.org", PLAIN.format(i)) for i in range(1500)] + [(i, "http://b.org", copy) for i in range(7)] + [(i, "http://b.org", f"<body><table><tr><td><p>Other {i}</table>") for i in range(7)]
    got = Counter(r.text for r in html_extract.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(6)).collect())
    assert got == Counter([f"Body text number {i} is long enough to win." for i in range(1500)] + ["Copied text and more of it"] * 7 + [f"Other {i}" for i in range(7)])


def test_language(docs, none, rows):
    got = language_id.identify(docs).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    assert Counter((r.doc_id, r.held_out) for r in got) == Counter((i, held(i)) for i, _, _ in rows)
    by = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 for r in got)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (500, 501, 502, 505, 509))
    assert all(by[i].lang_pred == g for i, t, g in rows if i is not None and i < 300 and g and t and len(t) > 300)
    assert language_id.identify(none).count() == 0
    kept = Counter(r.doc_id for r in language_id.drop_unidentified(docs).collect())
    assert kept == Counter(r.doc_id for r in got if r.lang_pred != "und")


def test_language_pieces(monkeypatch):
    text = "the quick brown fox über die straße " * 50
    whole, _ = language_id.bundles([text, None, "!!", "日本語のテキスト"])
    assert whole[1].any() == whole[2].any() == False  # noqa: E712
    monkeypatch.setattr(language_id, "CELLS", 40)
    some, known = language_id.bundles([text, None, "!!", "日本語のテキスト"])
    assert np.allclose(whole, some) and known.tolist() == [True, False, False, True]


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language_id.identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


@pytest.mark.parametrize("size, tile", [(2, 1024), (5, 4)])
def test_near_duplicates(docs, none, rows, monkeypatch, size, tile):
    monkeypatch.setattr(minhash, "TILE", tile)  # with few rows, buckets are cut into tiles
    got = multiset(minhash.near_duplicates(docs.filter("doc_id is not null"), size), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute_components([r for r in rows if r[0] is not None], size)
    nulls = minhash.near_duplicates(docs, size).filter("doc_id is null").collect()
    assert len(nulls) == 2 and all(r.component_id is None and r.kept for r in nulls)
    assert minhash.near_duplicates(none, size).count() == 0


def test_near_rows_that_share_an_id(spark):
    base = [f"w{i}" for i in range(60)]
    near, far = " ".join(["x", *base[1:]]), " ".join(f"v{i}" for i in range(40))
    docs = spark.createDataFrame([(7, " ".join(base)), (7, far), (9, near), (8, far + " end"), (7, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == [(7, 0, 7, True), (7, 39, 7, True), (7, 59, 7, True), (8, 40, 7, False), (9, 59, 7, False)]
    assert sorted((r.doc_id, r.text or "") for r in minhash.drop_near_duplicates(docs, 2).collect()) == sorted((7, t) for t in ("", far, " ".join(base)))


def test_near_recall_around_the_threshold(spark):
    """Pairs of texts with a similarity of 0.8 and just above: links that are lost would show here."""
    rng = random.Random(6)
    rows, linked, below = [], 0, 0
    for k in range(400):
        n = rng.choice([45, 90, 180, 360])
        # each changed word takes two of the n shingles away: similarity (n - 2c) / (n + 2c)
        c = max(1, int(n / 18)) + (k % 4 == 3)
        w = [f"{k}a{i}" for i in range(n + 1)]
        v = list(w)
        for i in range(c):
            v[3 * i + 1] = f"{k}b{i}"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
        near = 100 * (n - 2 * c) >= 80 * (n + 2 * c)
        linked, below = linked + near, below + (not near)
    got = Counter(r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert linked > 200 and below > 50 and sum(x == 2 for x in got.values()) == linked


def test_pigeonhole():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, minhash.SYMBOLS).astype("<u2")
        b = a.copy()
        b[rng.choice(minhash.SYMBOLS, minhash.DISTANCE, replace=False)] ^= 1
        x, y = minhash.chunk_keys(a[None]), minhash.chunk_keys(b[None])
        assert np.isin(x, y).any()


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + rng.randint(1, 50)) for _ in range(30)] + [(a, b) for a, b in ((rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)) if a != b]
    got = {r.v: r.comp for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        root.setdefault(a, a)
        root.setdefault(b, b)
    for _ in range(500):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_exact(docs, none, rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[norm(t)].append(i)
    low = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    want = Counter((i, low[norm(t)], len(groups[norm(t)]), i == low[norm(t)], sha(norm(t).encode())) for i, t, _ in rows)
    assert multiset(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = Counter(r.doc_id for r in exact_dedup.drop_copies(docs).collect())
    assert kept == Counter({i for i in low.values() if i is not None}) + Counter({None: 2})


def test_exact_hot_and_collisions(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "GROUP_ROWS", 10)
    df = spark.range(300).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('t', id % 7)) as text")
    got = multiset(exact_dedup.exact_dedup(df), "doc_id", "keep_id", "group_size", "kept")
    groups = defaultdict(list)
    for i in range(300):
        groups["hot" if i % 3 == 0 else f"t{i % 7}"].append(i)
    assert got == Counter((i, v[0], len(v), i == v[0]) for v in groups.values() for i in v)
    # a hash that collides: everything lands in one group, and bytes tell the texts apart
    real = exact_dedup.F.md5
    try:
        exact_dedup.F.md5 = lambda c: F.lit("00" * 16)
        assert multiset(exact_dedup.exact_dedup(df), "doc_id", "keep_id", "group_size", "kept") == got
    finally:
        exact_dedup.F.md5 = real


def test_byte_bpe(docs, none, rows):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t, _ in rows:
        ids = lib.encode_ordinary(t or "")
        want[(i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode()))] += 1
    assert multiset(byte_bpe.encode(docs, path, public_tokenizers.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    r = byte_bpe.encode(docs.filter("doc_id = 508"), path, public_tokenizers.PATTERN, with_ids=True).first()
    text = rows[[x[0] for x in rows].index(508)][1]
    assert r.ids == lib.encode_ordinary(text) and r.decoded == text.encode()
    assert byte_bpe.encode(none, path, public_tokenizers.PATTERN).count() == 0
    bpe = byte_bpe.ByteBpe(path, public_tokenizers.PATTERN)
    assert bpe.decode(lib.encode_ordinary(text)) == text.encode()


#: A public pattern with groups of flags, possessive parts and classes that hold white space beside other members.
OTHER_PATTERN = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"


@pytest.mark.parametrize("pattern", [public_tokenizers.PATTERN, OTHER_PATTERN, r"(\s+|\w+|.)"])
def test_byte_bpe_patterns_and_long_pieces(pattern):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = ["a" * 700 + " " + "=" * 900 + "the" * 200, " Hello, world! it's \x1c \x85 x  y\r\n\n z 12345", some("abcdefgh", 6000), some("ethaoins", 3000), some("=-*#_", 2000), "z" * 100_000, "ab" * 3000, "日本語テキスト" * 50 + "é́ 😀😀"]
    texts += [" ".join(some("etaoinshrdlu", rng.randint(1, 40)) for _ in range(30)) for _ in range(40)]
    bpe = byte_bpe.ByteBpe(path, pattern)
    for text, (ids, decoded) in zip(texts, bpe.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(text) and decoded == text.encode()
    assert not bpe.passing and max(map(len, bpe.memo.new)) <= byte_bpe.KEPT_BYTES


def brute_forward(hmm, obs):
    a = hmm.start * hmm.emit[:, obs[0]]
    total = math.log(a.sum())
    a /= a.sum()
    for o in obs[1:]:
        a = (a @ hmm.move) * hmm.emit[:, o]
        total += math.log(a.sum())
        a /= a.sum()
    return total


def test_hmm_recursion():
    rng = np.random.default_rng(3)
    size = np.array([1, 5, 128, 129, 700, 256, 2])
    obs = rng.integers(0, hmm_lm.CLASSES, size.sum()).astype(np.int32)
    hmm = hmm_lm.Hmm.rough(np.full(hmm_lm.CLASSES, 1 / hmm_lm.CLASSES))
    got, counts = hmm.run(obs, size, True)
    at = np.cumsum(size) - size
    assert np.allclose(got, [brute_forward(hmm, obs[a : a + n]) for a, n in zip(at, size, strict=True)])
    assert np.isclose(counts[0].sum(), len(size)) and np.isclose(counts[1].sum(), (size - 1).sum()) and np.isclose(counts[2].sum(), size.sum())
    # the expected moves of a short sequence, path by path
    o, want, total = obs[1:6], np.zeros((hmm_lm.STATES,) * 2), 0
    import itertools

    for path in itertools.product(range(hmm_lm.STATES), repeat=5):
        p = hmm.start[path[0]] * hmm.emit[path[0], o[0]]
        for x, y, z in zip(path, path[1:], o[1:], strict=False):
            p *= hmm.move[x, y] * hmm.emit[y, z]
        total += p
        for x, y in zip(path, path[1:], strict=False):
            want[x, y] += p
    assert np.allclose(hmm.run(o, np.array([5]), True)[1][1], want / total)
    # a pass of Baum-Welch does not lower the likelihood
    better = hmm_lm.Hmm.of(counts)
    assert better.run(obs, size, False)[0].sum() > got.sum()


def test_lm(docs, none, rows):
    got = hmm_lm.score_texts(docs).collect()
    words = lambda t: [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(w for i, t, _ in rows if not held(i) for w in [*words(t), None])
    total, kinds = sum(counts.values()), len(counts)
    want = Counter()
    for i, t, _ in rows:
        tokens = [*words(t), None]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in tokens)
        want[(i, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), total, round(base, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert hmm_lm.score_texts(none).count() == 0


def test_lm_beats_unigrams(spark, sf):
    got = hmm_lm.score_texts(spark.read.parquet(f"{sf}/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_lm_keeps_its_states_and_double_precision():
    assert hmm_lm.STATES >= 5
    rng = np.random.default_rng(4)
    size = np.array([700, 129, 3])
    obs = rng.integers(0, hmm_lm.CLASSES, size.sum()).astype(np.int32)
    hmm = hmm_lm.Hmm.rough(np.full(hmm_lm.CLASSES, 1 / hmm_lm.CLASSES))
    got, _ = hmm.run(obs, size, False)
    at = np.cumsum(size) - size
    want = [brute_forward(hmm, obs[a : a + n]) for a, n in zip(at, size, strict=True)]
    assert np.allclose(got, want, rtol=1e-12, atol=0)


def test_empty_pages_leave_a_template_whole(spark):
    page = "<html><body><p>Welcome to our site</p><p>Text number {0} of its own</p></body></html>"
    pages = [(i, "https://a.org/x", page.format(i)) for i in range(6)] + [(6, "https://a.org/x", None), (7, "https://a.org/x", ""), (8, "https://a.org/x", "<html></html>")]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"Text number {i} of its own" for i in range(6)}, 6: "", 7: "", 8: ""}


def brute_class(word):
    """The class of a word, from its last four bytes."""
    code = 0
    for k in range(4):
        code |= (word[-1 - k] if k < len(word) else 94 if k == len(word) else 0) << (8 * k)
    return (code * 0x9E3779B97F4A7C15 % (1 << 64) >> 40) % (hmm_lm.CLASSES - 1) + 1


def brute_expected(hmm, obs):
    """Expected counts of one sequence by plain forward and backward recursions."""
    s = hmm_lm.STATES
    forward, scale = [], []
    a = hmm.start * hmm.emit[:, obs[0]]
    for o in [*obs[1:], None]:
        scale.append(a.sum())
        forward.append(a / a.sum())
        if o is not None:
            a = (forward[-1] @ hmm.move) * hmm.emit[:, o]
    back = [np.ones(s)]
    for t in range(len(obs) - 1, 0, -1):
        back.insert(0, hmm.move @ (hmm.emit[:, obs[t]] * back[0]) / scale[t])
    emit, move = np.zeros((s, hmm_lm.CLASSES)), np.zeros((s, s))
    for t, o in enumerate(obs):
        emit[:, o] += forward[t] * back[t]
        if t:
            move += np.outer(forward[t - 1], hmm.emit[:, o] * back[t]) * hmm.move / scale[t]
    return [forward[0] * back[0], move, emit]


def test_lm_score_by_brute_force(docs, rows, monkeypatch):
    """The whole column `score`: classes, Baum-Welch over partitions, forward recursion and words in their classes."""
    monkeypatch.setattr(hmm_lm, "SEED_ROUNDS", 2)
    monkeypatch.setattr(hmm_lm, "SEED_DOCS", 10**9)  # the sample is all training texts: passes over it are like the others
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    texts = [[w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for _, t, _ in rows]
    counts = Counter(w for (i, _, _), t in zip(rows, texts, strict=True) if not held(i) for w in t)
    n, v = Counter(), Counter()
    for w, c in counts.items():
        n[brute_class(w)] += c
        v[brute_class(w)] += 1
    background = np.zeros(hmm_lm.CLASSES)
    for k, c in n.items():
        background[k] = c
    background[0] = sum(not held(i) for i, _, _ in rows)
    hmm = hmm_lm.Hmm.rough(background / background.sum())
    obs = [[*map(brute_class, t), 0] for t in texts]
    for _ in range(2 + hmm_lm.ROUNDS):
        parts = [brute_expected(hmm, o) for (i, _, _), o in zip(rows, obs, strict=True) if not held(i)]
        hmm = hmm_lm.Hmm.of([sum(p[k] for p in parts) for k in range(3)])
    want = Counter()
    for (i, _, _), t, o in zip(rows, texts, obs, strict=True):
        inside = sum(math.log10((counts[w] + 0.1) / (n[brute_class(w)] + 0.1 * (v[brute_class(w)] + 1))) for w in t)
        want[i, f"{brute_forward(hmm, o) / math.log(10) + inside:.6g}"] += 1
    got = Counter((r.doc_id, f"{r.score:.6g}") for r in hmm_lm.score_texts(docs).collect())
    assert got == want


def test_lm_words_are_taken_without_a_list_of_them():
    """class_sequences gives the words themselves, as Arrow has them: runs between white space, A-Z in lower case."""
    texts = ["  A \t b\x0b\x0c A  ", None, "", " \u017b\u00c0 \u00c9\u00a0x", "\n", "one"]
    obs, size, words = hmm_lm.class_sequences(texts)
    want = [(t or "").encode().lower().split() for t in texts]
    assert words.to_pylist() == [w for x in want for w in x] and size.tolist() == [len(x) + 1 for x in want]
    assert obs.tolist() == [c for x in want for c in [*map(brute_class, x), 0]]


def test_lm_learns_from_all_training_texts_in_every_pass(spark, monkeypatch):
    """No pass of Baum-Welch reads a sample: each one's expected counts are of all training tokens."""
    monkeypatch.setattr(hmm_lm, "SEED_ROUNDS", 2)
    learned, of = [], hmm_lm.Hmm.of
    monkeypatch.setattr(hmm_lm.Hmm, "of", staticmethod(lambda counts: (learned.append((counts[0].sum(), counts[2].sum())), of(counts))[1]))
    docs = spark.range(6000).selectExpr("id as doc_id", "if(id % 7 = 0, null, concat_ws(' ', sequence(1, 1 + id % 5))) as text").repartition(3)
    total = hmm_lm.score_texts(docs).first().train_tokens
    rows = sum(zlib.crc32(str(i).encode()) % 10 != 0 for i in range(6000))
    assert len(learned) == 2 + hmm_lm.ROUNDS and np.allclose(learned, [(rows, total)] * len(learned))


@pytest.mark.parametrize("tokens", [1e7, 1e13])
def test_lm_of_unseen_classes_is_a_number(tokens):
    """Many tokens of a class without training counts, in a model of a large corpus."""
    emit = np.zeros((hmm_lm.STATES, hmm_lm.CLASSES))
    emit[:, :50] = tokens / 250
    hmm = hmm_lm.Hmm.of([np.ones(hmm_lm.STATES), np.eye(hmm_lm.STATES) * tokens, emit])
    size = np.array([20, 300, 1])
    obs = np.full(size.sum(), 4000, np.int32)
    got, counts = hmm.run(obs, size, True)
    at = np.cumsum(size) - size
    assert np.allclose(got, [brute_forward(hmm, obs[a : a + k]) for a, k in zip(at, size, strict=True)], rtol=1e-9)
    assert all(np.isfinite(c).all() for c in counts)
