"""The pipeline, stage by stage, against brute force on what the stage before kept."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from llm_fixtures import SCHEMA, brute_components, brute_hits, texts_with_odd_cases

import corpus_pipeline


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("pipeline")
    rows = texts_with_odd_cases()
    spark.createDataFrame([(i, t, g, "s", None, "clash", 1, 0.5, "clash", "clash", 3) for i, t, g in rows], SCHEMA).write.parquet(f"{d}/documents.parquet")
    words = rows[5][1].split(" ")
    spark.createDataFrame([("p", " ".join(words[20:40])), ("q", None)], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), [("p", " ".join(words[20:40]))]


def test_stages(spark, sf_dir):
    path, items = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = texts_with_odd_cases()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, path)
        assert docs.columns == columns, name
        got = sorted(((r.doc_id, r.text) for r in docs.collect()), key=key)
        if k == 0:
            kept = [r for r in kept if r[1] and any(c.isalpha() for c in r[1])]
        elif k == 1:
            low: dict = {}
            for r in sorted((r for r in kept if r[0] is not None), key=key):
                low.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
            kept = [*low.values(), *(r for r in kept if r[0] is None)]
        elif k == 2:
            stay = {k[0] for k in brute_components(kept, 5) if k[3]}
            kept = [r for r in kept if r[0] is None or r[0] in stay]
        else:
            kept = [r for r in kept if not brute_hits(r[1], items, 10)[1]]
        assert got == sorted(((i, t) for i, t, _ in kept), key=key), name
    assert len(kept) < len(texts_with_odd_cases()) / 2 and 0 in {r[0] for r in kept} and 5 not in {r[0] for r in kept}


def test_run(spark, sf_dir):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {i: t for i, t, _ in texts_with_odd_cases() if t is not None}
    got = corpus_pipeline.run(spark, sf_dir[0]).collect()
    assert got and len({r.doc_id for r in got}) == len(got)
    for r in got:
        ids = lib.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
