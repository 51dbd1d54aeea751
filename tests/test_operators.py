"""Operators that SQL cannot state, against row-at-a-time versions, and odd rows."""

from __future__ import annotations

import json
import math
import random
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslab.functions import text as X
from corpuslab.operators import audit as A
from corpuslab.operators import contrast as B
from corpuslab.operators import lexical as L
from corpuslab.operators import linguistic as M
from corpuslab.operators import plugins as P
from corpuslab.operators import quality as Q
from corpuslab.operators import report as R
from corpuslab.operators import reward as W
from corpuslab.operators import select as S
from corpuslab.operators import shape as C
from corpuslab.operators import stats as T
from corpuslab.operators.order import ordered_splits, take_until, with_position
from corpuslab.schema import CorpusError
from corpuslab.sources import readers, sinks
from corpuslab.streaming import resume

ODD = [None, "", "   ", "12 !!", "x", "a b", "a b c", "é à", " a ​b \t c ", "İ ΣΑΣ", "﻿z", "a " * 251, "y" * 2000, "y" * 2001, "l‿m"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(list(enumerate(ODD)), "i long, t string")


def test_text(odd):
    import re
    import unicodedata

    def clean(x):
        x = unicodedata.normalize("NFC", x or "").replace(" ", " ")
        return re.sub(r"\s+", " ", re.sub("[​‌‍﻿]", "", x)).strip()

    for r in odd.select("t", X.normalize_text(F.col("t")).alias("n"), X.tokens(F.col("t")).alias("tok"), X.n_space_tokens(F.col("t")).alias("ws"), X.has_letter(F.col("t")).alias("l"), X.marker_form(F.col("t")).alias("m"), X.lexical_item(F.col("t")).alias("item")).collect():
        t = r.t or ""
        assert r.n == clean(r.t)
        assert r.tok == re.findall(r"\b\w+\b", t.lower()) and r.ws == len(t.split()) and r.l == any(c.isalpha() for c in t)
        assert r.item == (" ".join(t.split()).lower() or None)
        if r.t is not None:
            folded = unicodedata.normalize("NFKD", " ".join(t.lower().split())).encode("ascii", "ignore").decode()
            assert r.m == folded.translate(str.maketrans("", "", "'.,:;!?"))


def test_audit_odd_rows(spark):
    rows = [(i, s, t, "c") for i, (s, t) in enumerate([(None, "a b c"), ("a b c", ""), ("a b c", "a b c"), ("a b c", "a b c"), ("a b", "a b c"), ("a b c", "1 2 3"), ("y" * 2001, "a b c"), ("a b c", "a " * 12), ("a b c", "a " * 13), ("a  b c", "a b c")])]
    got = A.audit(spark.createDataFrame(rows, "original_index long, source string, target string, corpus string")).orderBy("original_index")
    assert [r.reason for r in got.collect()] == ["source_empty", "target_empty", None, "duplicate_pair", "source_too_few_tokens", "target_no_alphabetic", "source_too_long", "char_ratio_out_of_range", "token_ratio_out_of_range", "duplicate_pair"]
    asked = A.audit(spark.createDataFrame(rows, "original_index long, source string, target string, corpus string"), languages=("en", "en"), identify=P.language_plugin(P.stop_word_language))
    assert asked.filter("reason is null").count() == 0
    with pytest.raises(CorpusError):
        A.audit(spark.createDataFrame([(1,)], "x int"))


def test_positions(spark, monkeypatch):
    from corpuslab.operators import order

    monkeypatch.setattr(order, "BUCKET_ROWS", 7)
    ids = random.Random(1).sample(range(-500, 10_000), 100)
    df = spark.createDataFrame([(i, i % 5) for i in ids], "o long, w long")
    assert [(r.o, r.position) for r in with_position(df, "o").orderBy("o").collect()] == [(o, k) for k, o in enumerate(sorted(ids))]
    run, want = 0, []
    for o in sorted(ids):
        want.append((o, run))
        run += o % 5
    assert [(r.o, r.s) for r in with_position(df, "o", "s", F.col("w")).orderBy("o").collect()] == want
    assert with_position(df.limit(0), "o").count() == 0
    cut = ordered_splits(df, "o", {"a": 10, "b": 5})
    assert [r.o for r in cut.filter("split = 'b'").orderBy("o").collect()] == sorted(ids)[10:15]
    assert take_until(df, F.col("w") == 0, "o", 3).count() == [k for k, o in enumerate(sorted(ids), 1) if o % 5 == 0][2]
    assert take_until(df, F.col("w") == 9, "o", 3).count() == 100


def scan_greedy(rows):
    s, t, out = set(), set(), []
    for i, a, b in sorted(rows):
        if a not in s and b not in t:
            out.append(i)
            s.add(a)
            t.add(b)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"s{rng.randint(0, 25)}", f"t{rng.randint(0, 25)}") for i in range(120)]
    df = spark.createDataFrame([(i, str(i), a, b) for i, a, b in rows], "original_index long, id string, source string, target string").repartition(4)
    assert [r.original_index for r in S.greedy_disjoint(df).orderBy("original_index").collect()] == scan_greedy(rows)
    have = df.filter("original_index < 10")
    gone_s, gone_t = {a for i, a, _ in rows if i < 10}, {b for i, _, b in rows if i < 10}
    left = [(i, a, b) for i, a, b in rows if i >= 10 and a not in gone_s and b not in gone_t]
    assert [r.original_index for r in S.greedy_disjoint(df, existing=have).orderBy("original_index").collect()] == scan_greedy(left)
    q = S.quality_pairs(df, (F.col("original_index") % 10) / 10.0, 0.5, 4)
    assert [r.original_index for r in q.orderBy("original_index").collect()] == [i for i in scan_greedy(rows) if i % 10 >= 5][:4]


def test_refill(spark):
    kept = spark.createDataFrame([("a", "s1", "t1", "test"), ("b", "s2", "t2", "sft_train"), ("c", "s3", "t3", "sft_dev"), ("d", "s4", "t4", "grpo_train"), ("e", "s5", "t5", "grpo_dev")], "id string, source string, target string, split string")
    spare = spark.createDataFrame([(i, f"r{i}", s, f"rt{i}") for i, s in enumerate(["s1", "n1", "s2", "n2", "n3"])], "original_index long, id string, source string, target string")
    sizes = {"test": 1, "sft_train": 2, "sft_dev": 2, "grpo_train": 1, "grpo_dev": 1}
    got = S.refill(kept, spare, sizes).filter("refilled").orderBy("original_index").collect()
    assert [(r.id, r.split) for r in got] == [("r1", "sft_train"), ("r3", "sft_dev")]  # r0 and r2 are consumed
    with pytest.raises(CorpusError):
        S.refill(kept, spare, sizes | {"grpo_dev": 4})
    with pytest.raises(CorpusError):
        S.validate_disjoint(kept.unionByName(kept.limit(1).withColumn("split", F.lit("zz"))))


def test_measures_of_streams():
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(700)]
    brute = sum(len(set(words[i : i + 50])) / 50 for i in range(len(words) - 49)) / (len(words) - 49)
    assert math.isclose(T.mattr(words), brute) and T.mattr(words[:49]) is None and T.mattr(words[:50]) == len(set(words[:50])) / 50

    def one(tokens):
        factors, start, n = 0.0, 0, len(tokens)
        for i in range(n):
            seg = tokens[start : i + 1]
            if i < n - 1 and len(seg) >= 10 and len(set(seg)) / len(seg) < 0.72:
                factors, start = factors + 1, i + 1
        seg = tokens[start:]
        factors += (1 - len(set(seg)) / len(seg)) / (1 - 0.72) if seg else 0
        return n / factors if factors else 0.0

    assert math.isclose(L.mtld(words), (one(words) + one(words[::-1])) / 2)
    assert L.mtld(words[:99]) is None and L.mtld([str(i) for i in range(100)]) == 0.0


def test_mtld_by_group(spark):
    rng = random.Random(6)
    texts = [(i, "ab"[i % 2], " ".join(f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 60)))) for i in range(20)]
    df = spark.createDataFrame(texts, "o long, g string, t string").repartition(3)
    want = {g: L.mtld([w for o, h, t in sorted(texts) if h == g for w in t.split()]) for g in "ab"}
    assert {r.g: pytest.approx(r.mtld) for r in L.mtld_by_group(df, "t", "o", "g").collect()} == want


def test_row_metrics_odd(odd):
    got = {r.i: r for r in L.row_metrics(odd, "t").collect()}
    assert got[0].ttr is None and got[1].shannon is None and got[2].yules_k is None
    assert got[6].ttr == 1.0 and got[6].yules_k == 0.0 and got[6].yules_i is None and got[6].repeated_3gram_rate == 0.0 and got[5].repeated_3gram_rate is None
    assert got[11].types == 1 and got[11].consecutive_repetition_rate == 1.0 and got[4].consecutive_repetition_rate is None


def test_bleu_chrf_ter():
    assert Q.bleu_score(Q.bleu_counts("the cat is on the mat", "the cat is on the mat")) == pytest.approx(100)
    assert Q.bleu_score(Q.bleu_counts("", "the cat")) == 0 and Q.bleu_score(Q.bleu_counts("dog", "cat")) == 0
    # matches 5/6, 3/5, 1/4 and none of 3, smoothed to 1/2
    want = 100 * math.exp((math.log(5 / 6) + math.log(3 / 5) + math.log(1 / 4) + math.log(1 / (2 * 3))) / 4)
    assert Q.bleu_score(Q.bleu_counts("the cat sat on the mat", "the cat is on the mat")) == pytest.approx(want)
    assert Q.bleu_score(Q.bleu_counts("a b c d", "a b c d e")) == pytest.approx(100 * math.exp(1 - 5 / 4))
    assert Q.tokens_13a("It's 3.5, (ok)-no.") == ["It's", "3.5", ",", "(", "ok", ")", "-no", "."] or Q.tokens_13a("a,b") == ["a", ",", "b"]
    assert Q.chrf_score(Q.chrf_counts("abc def", "abc def")) == pytest.approx(100) and Q.chrf_score(Q.chrf_counts("xyz", "abc")) == 0
    # one character of two: precision 1, recall 1/2 of unigrams; words differ
    p, r = (1 + 0) / 2, (0.5 + 0) / 2
    assert Q.chrf_score(Q.chrf_counts("a", "ab")) == pytest.approx(100 * 5 * p * r / (4 * p + r))
    assert Q.ter_counts("a b c d", "a b c d") == [0, 4] and Q.ter_counts("c d a b", "a b c d") == [1, 4] and Q.ter_counts("a x c", "a b c") == [1, 3] and Q.ter_counts("", "a b") == [2, 2] and Q.ter_counts("a", "") == [1, 0]


def test_corpus_scores_sum(spark):
    pairs = [("the cat sat on the mat", "the cat is on the mat"), (None, "x y"), ("good day to you all", "good day to all of you")]
    df = spark.createDataFrame(pairs, "h string, r string").repartition(3)
    for name, (count, _, score) in Q.METRICS.items():
        total = [sum(x) for x in zip(*[count(h, r) for h, r in pairs], strict=True)]
        assert Q.corpus_scores(df, "h", "r", name).first()[name] == pytest.approx(score(total))
    assert Q.corpus_scores(df.limit(0), "h", "r", "bleu").first()["bleu"] == 0


def test_holm_published(spark):
    p = [9.999e-05] * 11
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)] + [(99, None)], "t int, p_value double")
    got = {r.t: r.p_holm for r in T.holm(df, "p_value", "t").collect()}
    assert all(v == pytest.approx(0.00109989) for k, v in got.items() if k != 99) and got[99] is None


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(0.0001, 1), min_size=1, max_size=12))
def test_holm_definition(ps):
    order, best, out = sorted(range(len(ps)), key=lambda i: ps[i]), 0.0, {}
    for rank, i in enumerate(order):
        best = max(best, min(1.0, ps[i] * (len(ps) - rank)))
        out[i] = best
    assert all(out[a] <= out[b] for a in out for b in out if ps[a] <= ps[b])


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(60)], "o long, x double, y double")
    runs = {tuple(map(tuple, T.bootstrap_means(df.repartition(n), "o", 15).orderBy("iter").collect())) for n in (1, 4, 16)}
    assert len({tuple(round(m, 9) for _, m in r) for r in runs}) == 1
    r = T.randomization(df, "o", 30).first()
    assert r.observed == pytest.approx(sum((i % 5) - (i % 7) for i in range(60)) / 60) and 1 / 31 <= r.p_value <= 1


def test_align_errors(spark):
    a = spark.createDataFrame([("1", "s", "r", 1.0), ("2", "s", "r", float("nan"))], "sentence_id string, source string, reference string, m double")
    assert T.align(a, a, "m").count() == 1
    for bad in (a.withColumn("source", F.lit("z")), a.limit(1), a.union(a)):
        with pytest.raises(CorpusError):
            T.align(a, bad, "m")
    assert T.compare(a, a.limit(1), "m").first().status.startswith("skipped")


def test_pack(spark):
    rng = random.Random(8)
    rows = [(i, "gh"[i % 2], rng.choice([5, 100, 300, 600])) for i in range(50)]
    want = {}
    for g in "gh":
        at = used = 0
        for i, h, n in rows:
            if h == g:
                if used and used + n > 512:
                    at, used = at + 1, 0
                want[i] = (at, used)
                used += n
    got = C.pack(spark.createDataFrame(rows, "o long, g string, n long").repartition(4), "o", "n", 512, "g").collect()
    assert {r.o: (r.pack, r.pack_offset) for r in got} == want


def test_shapes(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 4, 5]), ([], [1]), ([1], [1])], "a array<int>, b array<int>")
    assert [r.p for r in df.select(C.common_prefix(F.col("a"), F.col("b")).alias("p")).collect()] == [2, 0, 1]
    assert df.select(C.mask_labels(F.col("a"), F.col("b")).alias("m")).first().m == [-100, -100, 4, 5]
    assert df.select(C.pad(F.col("a"), F.lit(5), 9).alias("m")).first().m == [1, 2, 3, 9, 9]
    assert C.batch_plan(2, 4, 8, 16) == {"per_step": 8, "accumulation": 2, "groups": 2}
    with pytest.raises(CorpusError):
        C.batch_plan(2, 4, 8, 12)


def test_tags(spark):
    texts = ["<s1>a</s1><s2>b</s2>", "<s1>a</s1>", "<Sentence_1 >a</sententzia1> <s2 b</s2>", "<s2>b</s2><s1>a</s1>", "<s1> </s1><s2>b</s2>", None, "<s1>a</s2><s2>b</s2>"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.extract_units(2)(F.col("t")).alias("u")).orderBy("i").collect()
    assert [r.u.valid for r in got] == [True, False, True, False, False, False, False]
    assert got[0].u.text == "a\n\nb" and got[2].u.text == "a\n\nb" and "empty" in got[4].u.error


def test_rewards(spark):
    with pytest.raises(CorpusError):
        W.Weights(bleu=0.5).validate()
    for w in W.ABLATIONS.values():
        w.validate()
    df = spark.createDataFrame([("a b c", "a b"), ("", "a"), ("12", "a"), ("12", "3"), (None, "a")], "c string, r string")
    cols = {k: F.lit(0.5) for k in ("chrfpp", "cometkiwi", "bleu", "comet", "self_bleu", "length", "reference_likeness")}
    assert [r.t for r in df.select(W.total(W.ABLATIONS["a0"], cols, F.col("c"), F.col("r")).alias("t")).collect()] == [0.5, -1.0, -1.0, 0.5, -1.0]
    pens = [r.p for r in df.select(W.length_penalty(F.col("c"), F.col("r")).alias("p")).collect()]
    assert pens[0] == pytest.approx(-math.log(1.5)) and pens[1] == -2.0 and pens[3] == 0
    groups = spark.createDataFrame([("g", "1", "a b c d"), ("g", "2", "a b c d "), ("g", "3", "z y x w")], "g string, k string, t string")
    assert {r.k: r.diversity for r in W.self_bleu_diversity(groups, "g", "t", "k").collect()} == {"1": 0.5, "2": 0.5, "3": 1.0}


def test_auc_and_calibration(spark):
    rng = random.Random(9)
    rows = [(rng.randint(0, 1), rng.randint(0, 12) / 12) for _ in range(200)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "label int, s double")
    assert B.roc_auc(df, "s").first().roc_auc == pytest.approx(want)
    assert B.roc_auc(df.filter("label = 1"), "s").first().roc_auc is None and B.roc_auc(df.limit(0), "s").first().roc_auc is None
    assert B.binary_metrics(df.limit(0), "s").first().f1 == 0.0
    with pytest.raises(CorpusError):
        B.calibration_parameters(df.withColumn("label", 1 - F.col("label")).withColumn("htmt_score", F.col("label") * -1.0))
    assert spark.range(1).select(B.normalised(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0)).alias("p")).first().p == 0.5


def test_trees():
    chain, star = [0, 1, 2, 3], [0, 1, 1, 1]
    assert M.tree_distance(chain, chain) == 0 and M.tree_distance([0], [0, 1]) == 1 and M.tree_distance(chain, star) == 4
    assert M.crossings([(0, 1), (1, 0), (2, 2)]) == 1


def test_reports(spark, tmp_path):
    tree = {"adequacy": {"bleu": 3, "ok": True, "bad": float("nan")}, "deep": {"a": {"b": 1.5}}, "n": 4, "meta": {"x": 1}}
    assert sorted(map(tuple, R.flatten(tree, spark, excluded=()).collect())) == [("adequacy", "bleu", 3.0), ("deep", "a.b", 1.5), ("meta", "n", 4.0), ("meta", "x", 1.0)]
    df = spark.createDataFrame([(json.dumps({"s": {"m": 1, "t": "x", "u": None}}),)], "j string")
    assert [tuple(r) for r in R.flatten_json(df, "j").collect()] == [("s", "m", 1.0)]
    R.save_json(str(tmp_path / "x.json"), {"b": 1, "a": "é"})
    assert (tmp_path / "x.json").read_text() == '{\n  "a": "é",\n  "b": 1\n}\n'


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\nthree\n")
    (tmp_path / "b.txt").write_text("eins\nzwei\ndrei\n")
    (tmp_path / "c.txt").write_text("eins\n")
    got = readers.load_dataset(spark, {"loader": "aligned_text", "source_path": str(tmp_path / "a.txt"), "target_path": str(tmp_path / "b.txt"), "corpus": "x"}).orderBy("original_index").collect()
    assert [(r.original_index, r.source, r.target) for r in got] == [(0, "one", "eins"), (1, "two", "zwei"), (2, "three", "drei")]
    with pytest.raises(CorpusError):
        readers.aligned_text(spark, str(tmp_path / "a.txt"), str(tmp_path / "c.txt"), "x")
    (tmp_path / "p.jsonl").write_text('{"source": "a", "target": "b", "id": "0001"}\n\n{"source": "c", "target": null, "id": "0002"}\n')
    rows = readers.evaluation_file(spark, str(tmp_path / "p.jsonl"), "k").orderBy("sentence_id").collect()
    assert [(r.sentence_id, r.source, r.reference) for r in rows] == [("k_000001", "a", "b"), ("k_000002", "c", None)]
    (tmp_path / "train.jsonl").write_text('{"id": "0001", "source": "a", "target": "b"}\n')
    assert readers.processed_split(spark, str(tmp_path), "train").first().sentence_id == "0001"
    (tmp_path / "d.xml").write_text("<d><section>\n<e><p><l>Big<b/>house<s n='n'/></l><r>etxe</r></p></e>\n<e><p><l>run</l><r>korrika</r><r>lasterka &amp; co</r></p></e></section></d>")
    assert {tuple(r) for r in readers.bilingual_dictionary(spark, str(tmp_path / "d.xml")).collect()} == {("big house", "etxe"), ("run", "korrika"), ("run", "lasterka & co")}
    assert ("etxe", "big house") in {tuple(r) for r in readers.bilingual_dictionary(spark, str(tmp_path / "d.xml"), invert=True).collect()}
    df = spark.createDataFrame([("b", float("nan"), None), ("a", 1.0, "x")], "z string, a double, m string")
    sinks.save_jsonl(df, str(tmp_path / "out"))
    lines = {x for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()}
    assert lines == {'{"a":null,"m":null,"z":"b"}', '{"a":1.0,"m":"x","z":"a"}'}
    assert sinks.save_splits(df.withColumn("split", F.col("z")), str(tmp_path / "s")) == ["a", "b"]
    with pytest.raises(CorpusError):
        sinks.save_splits(df.withColumn("split", F.col("z")), str(tmp_path / "s"))
    assert readers.file_digests(spark, str(tmp_path / "c.txt")).first().sha256 == __import__("hashlib").sha256(b"eins\n").hexdigest()
    (tmp_path / "m" / "model" / "p0").mkdir(parents=True)
    (tmp_path / "m" / "model" / "p0" / "analysis_summary.json").write_text('{"a": {"b": 1}}')
    assert [(r.model, r.condition) for r in readers.summaries(spark, str(tmp_path / "m")).collect()] == [("model", "p0")]


def test_resume(spark, tmp_path):
    tasks = spark.createDataFrame([("a", "x"), ("b", "y")], "sentence_id string, source string")
    assert [r.sentence_id for r in resume.pending(tasks, tasks.limit(1), same=("source",)).collect()] == ["b"]
    with pytest.raises(CorpusError):
        resume.pending(tasks, tasks.withColumn("source", F.lit("z")), same=("source",))
    src, sink, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    src.mkdir()
    step = lambda df: df.withColumn("n", F.length("source"))
    for name, rows in (("1", '{"sentence_id": "a", "source": "xx"}\n'), ("2", '{"sentence_id": "a", "source": "xx"}\n{"sentence_id": "b", "source": "yyy"}\n')):
        (src / f"{name}.json").write_text(rows)
        resume.process_new_files(spark, str(src), "sentence_id string, source string", step, sink, mark, key="sentence_id").awaitTermination(60)
    assert sorted((r.sentence_id, r.n) for r in spark.read.parquet(sink).collect()) == [("a", 2), ("b", 3)]


def test_plugins(spark):
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate([("good fine nice", 1), ("bad awful", 0)] * 20)], "i long, text string, label int")
    score, table = P.train_text_classifier(df, df, epochs=(1, 5))
    assert B.binary_metrics(score(df), "score").first().accuracy == 1.0 and len(table) == 2
    ann = P.annotate(df.limit(1), "i", "text", lambda: lambda t: [(w, w, "NOUN", "", "dep") for w in t.split()], "target")
    assert [r.text for r in ann.orderBy("tok_idx").collect()] == ["good", "fine", "nice"]
    bad = P.scorer_plugin(lambda: lambda *c: [1.0], 1)
    with pytest.raises(Exception, match="another number"):
        df.coalesce(1).select(bad(F.col("text"))).collect()


def test_whole_runs(spark):
    from corpuslab.plans import pipelines as W2

    rng = random.Random(3)
    words = "the of and a to in is that for it".split()
    say = lambda n: " ".join(rng.choice(words) + rng.choice("xyz") for _ in range(n))
    corpus = spark.createDataFrame([(i, say(8), say(9), "c") for i in range(60)] + [(60, "", "x", "c")], "original_index long, source string, target string, corpus string")
    rows, summary = W2.prepare_corpus(corpus, sizes={"train": 40, "test": 6, "evaluation_reserve": 8})
    assert {r["split"]: r["count"] for r in rows.filter("status = 'valid'").groupBy("split").count().collect()} == {"train": 40, "test": 6, "evaluation_reserve": 8}
    with pytest.raises(CorpusError):
        W2.prepare_corpus(corpus, sizes={"train": 61})
    part = lambda name: rows.filter(F.col("split") == name).select("id", "source", "target", "original_index")
    splits, report = W2.prepare_training_splits(part("train"), part("test"), part("evaluation_reserve"), S.SliceSizes(20, 5, 10, 5))
    assert splits.count() == 46 and report.agg(F.sum("dropped_rows")).first()[0] == 0
    preds = part("train").select(F.col("id").alias("sentence_id"), "source", F.col("target").alias("reference"), F.col("source").alias("prediction"), "original_index")
    per, long = W2.analyse(preds, order="original_index")
    assert per.count() == 40 and {"bleu", "chrf_pp", "ter", "mattr", "mtld", "ttr", "lfp_b3"} <= {r.metric for r in long.collect()}
    answers = W2.evaluate_split(preds, preds.limit(10), "{source}", lambda: lambda ps: ps)
    assert answers.count() == 30 and answers.filter("prediction != source").count() == 0
    tagged = W2.evaluate_split(spark.createDataFrame([("a", "x\n\ny", "r")], "sentence_id string, source string, reference string"), None, "{source}", lambda: lambda ps: ps, units=2).first()
    assert tagged.prediction == "x\n\ny" and tagged.sentence_boundary_contract_valid
    refs = rows.filter("split = 'train'")
    negatives = W2.generate_negatives(refs, {"m": lambda: lambda ps: ps, "bad": lambda: lambda ps: ["<translation>" for _ in ps]}, "{source}")
    assert negatives.count() == 20 and {r.mt_model_key for r in negatives.collect()} == {"m"}
    scored = spark.createDataFrame([(s, y, y * 2.0 - 1 + rng.random()) for s in ("dev", "test") for y in (0, 1) for _ in range(20)], "split string, label int, htmt_score double")
    assert all(r.accuracy == 1.0 and r.roc_auc == 1.0 for r in W2.evaluate_contrastive(scored).collect())


def test_config(spark, tmp_path):
    from corpuslab import config as G

    registry = {"defaults": {"gen": {"t": 0, "n": 5}, "x": 1}, "models": {"m": {"gen": {"n": 7}}}, "ablations": {"a": {"weights": {"bleu": 0.5, "comet": 0.5}}, "b": {"weights": {"bleu": 0.6}}, "c": {"weights": {"zzz": 1}}}}
    (tmp_path / "r.json").write_text(json.dumps(registry))
    got = G.parse(G.read_text(spark, str(tmp_path / "r.json")))
    assert G.entry(got, "models", "m") == {"gen": {"t": 0, "n": 7}, "x": 1, "key": "m"}
    assert G.reward_weights(got, "a").comet == 0.5
    for bad in ("b", "c", "d"):
        with pytest.raises(CorpusError):
            G.reward_weights(got, bad)
    assert "error" in G.sidecar(spark, str(tmp_path / "none.json")) and G.sidecar(spark, str(tmp_path / "r.json"))["models"]
    assert G.parse("a:\n  b: 1\n") == {"a": {"b": 1}}
    p = spark.createDataFrame([(2, "b"), (1, "a"), (3, "a"), (4, None)], "o long, model_key string")
    assert G.provenance(p, "o")["model_key"] == ["a", "b"] and G.provenance(p, "o")["rows"] == 4


def _slot(*parts):
    import hashlib

    return int(hashlib.md5("|".join(map(str, (42, *parts))).encode()).hexdigest()[:8], 16)


def test_paired_queries_take_all_rows_and_iterations(spark, sf):
    import numpy as np

    from corpuslab.plans import catalogue
    from corpuslab.plans import views as V

    n = V.pairs_doc(spark, sf).count()
    assert [x.count() for x in V.runs(spark, sf)] == [n, n]
    assert catalogue.ITERATIONS == 10_000
    d = [0.5, -1.0, 2.0, 0.25, 1.5, -0.75]
    df = spark.createDataFrame([(i, 0.0, x) for i, x in enumerate(d)], "o long, x double, y double")
    means = [sum(d[_slot(i, k) % 6] for k in range(6)) / 6 for i in range(10_000)]
    got = T.bootstrap_interval(df, "o").first()
    assert np.allclose([got.ci_low, got.ci_high], np.percentile(means, [2.5, 97.5]))
    sums = [sum(x if _slot(i, k) % 2 == 0 else -x for k, x in enumerate(d)) for i in range(10_000)]
    hits = sum(abs(s / 6) >= abs(sum(d) / 6) - 1e-12 for s in sums)
    assert math.isclose(T.randomization(df, "o").first().p_value, (hits + 1) / 10_001)


def test_bootstrap_mattr_is_that_of_the_whole_stream(spark, monkeypatch):
    rng = random.Random(8)
    side = lambda: [rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(rng.choice([0, 1, 30, 49, 50, 120]))]
    df = spark.createDataFrame([(i, side(), side()) for i in range(12)], "o long, l array<string>, r array<string>")
    monkeypatch.setattr(T, "BLOCK_DRAWS", 5)
    want = T.corpus_bootstrap(df, "o", "l", "r", T.mattr, 6).orderBy("iter").collect()
    got = T.bootstrap_mattr(df, "o", "l", "r", 6).orderBy("iter").collect()
    assert len(got) == 6 and [r.iter for r in got] == [r.iter for r in want]
    assert all(math.isclose(x, y, abs_tol=1e-12) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


def test_bootstrap_mattr_query_has_all_iterations(spark, sf):
    from corpuslab.plans import catalogue

    assert catalogue.queries()["corpus_bootstrap_mattr"](spark, sf).count() == 1000


def test_boundary_tag_and_prompt_masks_take_whole_texts(spark, sf):
    from corpuslab.plans import catalogue

    docs = {r.doc_id: r for r in catalogue.documents(spark, sf).select("doc_id", "text", X.tokens(F.col("text")).alias("tok")).collect()}
    assert any(len(r.text or "") > 400 for r in docs.values()) and any(len(r.tok) > 60 for r in docs.values())
    for r in catalogue.queries()["boundary_tag"](spark, sf).collect():
        if docs[r.doc_id].text is not None:
            assert r.n_units == sum(bool(x.strip()) for x in docs[r.doc_id].text.split("\n"))
    for r in catalogue.queries()["prompt_masks"](spark, sf).collect():
        a = docs[r.doc_id].tok
        b = a[:30] + ["x"] + a[31:]
        prefix = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert (r.prefix, r.n) == (prefix, len(b))


def test_sfa_dictionary_has_lemmas_of_all_rows(spark, sf):
    from corpuslab.plans import catalogue
    from corpuslab.plans import views as V

    ann = V.annotations(spark, sf)
    want = {r.lemma for r in ann.filter(F.col("upos").isin(*M.SYNONYM_UPOS)).select("lemma").distinct().collect()}
    assert {r.lemma for r in catalogue.queries()["sfa_option_counts"](spark, sf).select("lemma").distinct().collect()} == want


def test_many_groups_are_one_plan(spark, monkeypatch):
    from corpuslab.operators import order

    monkeypatch.setattr(order, "BUCKET_ROWS", 300)
    rows = [(i, f"g{i % 1200}" if i % 7 else None, "a b " + "c" * (i % 3)) for i in range(2600)]
    got = {r.g: r.mattr for r in L.mattr_by_group(spark.createDataFrame(rows, "o long, g string, t string"), "t", "o", "g", 2).collect()}
    streams: dict = {}
    for _, g, t in rows:
        streams.setdefault(g, []).extend(t.split())
    want = {g: sum(len(set(w[k : k + 2])) for k in range(len(w) - 1)) / 2 / (len(w) - 1) for g, w in streams.items()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)


def test_positions_of_skewed_values(spark, monkeypatch):
    """Values far from the others do not push these into one bucket."""
    from corpuslab.operators import order

    monkeypatch.setattr(order, "BUCKET_ROWS", 100)
    values = [*range(2000), *range(10_000_000_000, 10_000_000_050), *[77] * 5]
    df = spark.createDataFrame([(v,) for v in values], "o long")
    cuts = sorted(set(df.approxQuantile("o", [i / 21 for i in range(1, 21)], 0.2 / 21)))
    sizes = df.groupBy(order._bucket("o", cuts).alias("b")).count().collect()
    assert len(sizes) > 10 and max(r["count"] for r in sizes) < 300
    assert [(r.o, r.position) for r in with_position(df, "o").orderBy("position").collect()] == [(v, k) for k, v in enumerate(sorted(values))]


def test_greedy_rows_without_a_side(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, "x", None), (4, "x", "a"), (5, "y", "a"), (6, "y", "c")], "original_index long, source string, target string")
    assert sorted(r.original_index for r in S.greedy_disjoint(df).collect()) == [4, 6]


def test_ter_words():
    assert Q.ter_counts("a b.", "A b!") == [1, 2] and Q.ter_counts("The cat sat.", "the cat sat.") == [0, 3]


def test_audit_is_compiled(spark, sf):
    """No stage of the flagship query grows beyond what a generated method may hold."""
    from corpuslab.plans import catalogue

    before = spark.conf.get("spark.sql.codegen.fallback")
    spark.conf.set("spark.sql.codegen.fallback", "false")  # a stage that cannot be compiled is an error
    try:
        assert catalogue.queries()["preprocess_audit"](spark, sf).collect()
    finally:
        spark.conf.set("spark.sql.codegen.fallback", before)


def test_structure_scores(spark):
    one = ([0, 1, 2, 3], [0, 1, 1, 1], [(0, 0), (1, 2), (2, 1)])
    two = ([0, 1], [0, 1], [(0, 0)])
    rows = [(1, [one[0]], [one[1]], [one[2]]), (2, [one[0], two[0]], [one[1], two[1]], [one[2], two[2]]), (3, [one[0]], [one[1], two[1]], [one[2]]), (4, [[9]], [[0]], [[(0, 0)]]), (5, None, None, None), (6, [], [], [])]
    df = spark.createDataFrame(rows, "k int, st array<array<int>>, tt array<array<int>>, al array<array<struct<i:int,j:int>>>")
    got = {r.k: r for r in M.structure_scores(df, "st", "tt", "al").collect()}
    assert (got[1].status, got[1].ted, got[1].word_cross, got[1].sentence_pairs, got[1].aligned_word_pairs) == ("scored", 4.0, 1.0, 1, 3.0)
    assert got[2].status == "scored_multisentence" and got[2].ted == pytest.approx((4 * 4 + 0 * 2) / 6) and got[2].aligned_source_ratio == pytest.approx((0.75 * 4 + 0.5 * 2) / 6)
    assert got[3].status == "excluded_sentence_count_mismatch" and got[3].ted is None and "1" in got[3].error and "2" in got[3].error
    assert got[4].status == "failed" and got[4].error and got[5].status == got[6].status == "scored" and got[5].sentence_pairs == 0 and got[5].ted is None
    assert M.structure_scores(df.limit(0), "st", "tt", "al").count() == 0


def test_target_bundle(spark):
    texts = {"en": ["a b c d e f g h i j " * 12, "x y"], "de": ["u v w"], None: ["n " * 60]}
    rows = [(i, k, t) for i, (k, t) in enumerate((k, t) for k, v in texts.items() for t in v)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {r.lang: r for r in L.target_bundle(df, "text", "doc_id", "lang", L.frequency_ranks(df, "text")).collect()}
    assert {k: (r.token_count, r.type_count, r.mtld_status) for k, r in got.items()} == {"en": (122, 12, "ok"), "de": (3, 3, "insufficient_tokens"), None: (60, 1, "insufficient_tokens")}
    assert got["en"].mtld == pytest.approx(L.mtld(" ".join(texts["en"]).split()))
    assert got["de"].mattr_50 is None and got[None].mattr_50 == pytest.approx(0.02) and got["en"].lfp_b1 == 1.0


def test_selection_summary(spark):
    df = spark.createDataFrame([("a", 0.5), (None, 0.25), (None, 0.75), ("b", None)], "why string, score double")
    got = A.selection_summary(df, F.col("why"), F.col("score")).first()
    assert tuple(got) == (4, 2, 0.25, 0.5, 0.75)
    assert tuple(A.selection_summary(df.filter("score is null"), F.col("why"), F.col("score")).first()) == (1, 0, None, None, None)


def test_token_examples(spark):
    df = spark.createDataFrame([(1, [5, 6], [5, 6, 7, 8]), (2, [5, 6], [5, 9, 2]), (3, None, [4])], "id long, p array<int>, f array<int>")
    got = {r.id: (r.input_ids, r.labels, r.attention_mask) for r in C.token_examples(df, "p", "f", 4, 2).collect()}
    assert got == {1: ([5, 6, 7, 8], [-100, -100, 7, 8], [1] * 4), 2: ([5, 9, 2], [-100, 9, 2], [1] * 3), 3: ([4, 2], [4, 2], [1] * 2)}
    with pytest.raises(Exception, match="no label within 2 tokens"):
        C.token_examples(df, "p", "f", 2).select("labels").collect()
    with pytest.raises(CorpusError):
        C.token_examples(df, "p", "f", 0)


def test_align_tokens(spark):
    a = spark.createDataFrame([("1", "s", "r", "Ein Satz"), ("2", "s", None, None)], "sentence_id string, source string, reference string, prediction string")
    b = a.withColumn("prediction", F.lit("x y"))
    assert {(r.sentence_id, tuple(r.l), tuple(r.r)) for r in T.align_tokens(a, b).collect()} == {("1", ("ein", "satz"), ("x", "y")), ("2", (), ("x", "y"))}
    for bad in (b.filter("sentence_id = '1'"), b.withColumn("source", F.lit("t")), b.unionByName(b)):
        with pytest.raises(CorpusError):
            T.align_tokens(a, bad)


def test_summaries_fall_back(spark, tmp_path):
    for folder, files in {"m/p0": {"analysis_summary.json": '{"a": 1}', "automatic_metrics.json": '{"a": 2}'}, "m/p1": {"automatic_metrics.json": '{"a": 3}'}, "n/p0": {"analysis_summary.json": "{no"}}.items():
        (tmp_path / folder).mkdir(parents=True)
        for name, text in files.items():
            (tmp_path / folder / name).write_text(text)
    got = {(r.model, r.condition): json.loads(r.summary) for r in readers.summaries(spark, str(tmp_path)).collect()}
    assert got == {("m", "p0"): {"a": 1}, ("m", "p1"): {"a": 3}, ("n", "p0"): {}}


def test_prefix_and_empty_synonyms(spark):
    assert M.with_prefix(spark.range(1).selectExpr("id", "1 as astred_ted"), "astred_", "other_").columns == ["id", "other_ted"]
    none = spark.createDataFrame([], "lemma string, option string, count long")
    assert tuple(M.synonym_summary(none).first()) == (0, None, None, None)


def test_validated_answer_knows_all_phrases_unless_told_others(spark):
    said = [(1, "Well, here is. A thing"), (2, "one\nOr, two"), (3, "La traducció és correcta"), (4, "plain words")]
    df = spark.createDataFrame(said, "k int, t string")
    ans = F.concat(F.lit("<translation>"), "t", F.lit("</translation>"))
    reasons = lambda **kw: {r.k: r.reason for r in df.select("k", A.validated_answer(ans, F.col("t"), **kw).reason.alias("reason")).collect()}
    assert reasons() == {1: "commentary_marker", 2: "alternatives", 3: "commentary_marker", 4: None}
    assert reasons(fold=F.lower, commentary=("one",), alternatives=("\nplain",)) == {1: None, 2: "commentary_marker", 3: None, 4: None}


def test_hashes_of_many_numbers_are_those_of_one():
    for lo, hi in [*T._spans(1200), (99_990, 100_000), (2_000_000_000, 2_000_000_050)]:
        for i in (0, 7, 77, 777, 9999):
            assert T._hashes(f"42|{i}|", T._digits(lo, hi)).tolist() == [_slot(i, k) for k in range(lo, hi)]
    assert T._spans(20_000)[-1] == (10_000, 20_000) and sum(b - a for a, b in T._spans(1_234_567)) == 1_234_567


def test_one_pass_of_draws_is_that_of_joined_draws(spark, monkeypatch):
    """Several tests in one pass, of as many rows and of fewer, against draws joined row by row; a pass takes a hash once."""
    rng = random.Random(5)
    rows = {"a": [rng.random() for _ in range(130)], "b": [rng.random() for _ in range(130)], "c": [rng.random() for _ in range(45)]}
    tests = {k: (spark.createDataFrame(list(enumerate(v)), "slot long, d double"), len(v)) for k, v in rows.items()}
    monkeypatch.setattr(T, "TASK_ITERATIONS", 4)
    monkeypatch.setattr(T, "BLOCK_ROWS", 16)
    got = {(r.test, r.iter): (r.mean_difference, r.s) for r in T.resampled(tests, 10).collect()}
    monkeypatch.setattr(T, "TASK_ROWS", 10)
    want = {(k, r.iter): (r.mean_difference, r.s) for k, (df, n) in tests.items() for r in T._resampled(df, n, 10, 42).collect()}
    assert got.keys() == want.keys() and len(got) == 30 and all(x == pytest.approx(want[k]) for k, x in got.items())


def test_bootstrap_mattr_shuffles_no_draws(spark):
    """Runs of short and empty rows, another window, iterations of several tasks; the tasks' input is the rows."""
    rng = random.Random(4)
    side = lambda: [rng.choice("abcdefg") for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 5, 9]))]
    df = spark.createDataFrame([(i, side(), side()) for i in range(40)], "o long, l array<string>, r array<string>")
    got = T.bootstrap_mattr(df, "o", "l", "r", 60, window=5)
    want = {r.iter: tuple(r) for r in T.corpus_bootstrap(df, "o", "l", "r", lambda t: T.mattr(t, 5), 60).collect()}
    rows = {r.iter: tuple(r) for r in got.collect()}
    assert rows.keys() == want.keys() and all(x == pytest.approx(want[k]) for k, x in rows.items())
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()


def test_bootstrap_mattr_tasks_hold_little_of_each_row():
    """1.6 kB a row were held, which was too much for an executor at 1 GB."""
    def records():
        rng = np.random.default_rng(3)
        for lo in range(0, 30_000, 500):
            n = rng.choice([20, 60], 500)
            tokens = rng.integers(-300, 300, n.sum()) * 2
            yield T._summed(np.arange(lo, lo + 500), tokens, np.concatenate([[0], np.cumsum(n)]), 50)

    want = T._Ends(records(), 30_000, np.zeros(0, np.uint64), 50, 1 << 30).drawn(T._draws(30_000, range(2), 42))
    tracemalloc.start()
    try:
        got = T._Ends(records(), 30_000, np.zeros(0, np.uint64), 50, 0).drawn(T._draws(30_000, range(2), 42))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == want and None not in got and peak < 24_000_000


def test_bootstrap_mattr_tells_tokens_apart_that_share_bits(spark, monkeypatch):
    """With ids of two bits, all tokens but a few share theirs; the rows' ends are in a mapped file."""
    rng = random.Random(9)
    side = lambda: [rng.choice("abcdefghijklm") for _ in range(rng.choice([0, 3, 11, 40]))]
    df = spark.createDataFrame([(i * 7 % 30, side(), None if i == 4 else side()) for i in range(30)], "o long, l array<string>, r array<string>")
    monkeypatch.setattr(T, "ID_BITS", 2)
    monkeypatch.setattr(T, "TABLE_BYTES", 0)
    got = {r.iter: tuple(r) for r in T.bootstrap_mattr(df, "o", "l", "r", 5, window=12).collect()}
    want = {r.iter: tuple(r) for r in T.corpus_bootstrap(df.withColumn("r", F.coalesce("r", F.array().cast("array<string>"))), "o", "l", "r", lambda t: T.mattr(t, 12), 5).collect()}
    assert got.keys() == want.keys() and len(got) == 5 and all(x == pytest.approx(want[k]) for k, x in got.items())
