"""Toxicity and quality classifiers: learning, held-out accuracy, odd inputs."""

import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from assayline.llm import linear, quality, toxicity, wordhash

DATA = "/root/testdata/sf0.01"


def test_word_hashes_match_a_plain_loop():
    texts = ["Foo bar, foo!", "", None, "bar foo " * 400, "é x"]
    for _, data, offsets in wordhash.slices(pa.array(texts), 64):
        h, owner = wordhash.words(data, offsets, wordhash.WORD_CLASSES, True)
        assert len(h) == len(owner)
    whole = {}
    for t in texts:
        for _, data, offsets in wordhash.slices(pa.array([t])):
            h, _ = wordhash.words(data, offsets, wordhash.WORD_CLASSES, True)
            for word, x in zip("".join(c if c.isalnum() else " " for c in (t or "").lower()).split(), h.tolist(), strict=True):
                assert whole.setdefault(word, x) == x
    assert len(set(whole.values())) == len(whole)


def test_runs_of_words():
    _, data, offsets = next(wordhash.slices(pa.array(["a b c", "a", "", "b c", "a b"])))
    h, owner = wordhash.runs(*wordhash.words(data, offsets, wordhash.SPACE_CLASSES, True), 5, 2)
    assert owner.tolist() == [0, 0, 1, 3, 4] and h[0] == h[4] and h[1] == h[3] and len(set(h.tolist())) == 3


def test_ftrl_learns_and_is_sparse():
    rng = np.random.default_rng(0)
    cfg = linear.LinearConfig(bits=12, alpha=1.0, l1=1.0, l2=0.0, min_rows=2)
    rows = [np.unique(np.append(rng.integers(0, 4000, 30), [4001] if k % 3 == 0 else [])).astype(np.int64) for k in range(600)]
    b, index, w = linear.ftrl(rows, np.array([k % 3 == 0 for k in range(600)], float), cfg)
    assert index[np.argmax(w)] == 4001 and b < 0 and len(index) < 2500


def test_empty_tables_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "some words here", "x"), (2, None, "y"), (2, None, "y"), (None, "", "z"), (5, "w " * 300_000, "long")], "doc_id long, text string, quality_score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, none)
    assert model.intercept == 0.0 and [r["quality_score"] for r in quality.score(docs, model).collect()] == [0.5] * 5
    assert quality.keep(docs, model).columns == docs.columns and quality.keep(docs, model).count() == 5
    assert quality.score(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (9, 1)], "doc_id long, quality int")
    scored = quality.score(docs, linear.fit(docs, labels, "quality", linear.LinearConfig(min_rows=1))).collect()
    assert all(0 <= r["quality_score"] <= 1 for r in scored)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize(("op", "label", "modulus", "rest", "least", "size"), [(quality.op10_quality_classifier, "quality", 3, 1, 0.99, "sf0.01"), (toxicity.op5_toxicity, "toxic", 5, 0, 0.95, "sf0.1")])
def test_held_out_rows(spark, op, label, modulus, rest, least, size):
    folder = f"{os.path.dirname(DATA)}/{size}"  # toxic rows are too few at the smaller size
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = op(spark, folder).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest) and r["predicted"] == int(r["score"] >= 0.5)
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = [r for r in got if r["held_out"] and truth.get(r["doc_id"]) is not None]
    ones, others = ([r for r in kept if truth[r["doc_id"]] == k] for k in (1, 0))
    # Area under the curve: the share of pairs of a one and another in the right order, ties by half.
    area = sum((a["score"] > b["score"]) + (a["score"] == b["score"]) / 2 for a in ones for b in others) / (len(ones) * len(others))
    recall, wrong = sum(r["predicted"] for r in ones) / len(ones), sum(r["predicted"] for r in others) / len(others)
    hits = [truth[r["doc_id"]] == r["predicted"] for r in kept]
    always_one_answer = max(len(ones), len(others)) / len(kept)
    assert area >= least and recall >= 0.7 and wrong <= 0.1 and sum(hits) / len(hits) > always_one_answer


@pytest.mark.parametrize("cfg", [quality.CONFIG, toxicity.CONFIG])
def test_scores_against_a_plain_loop(cfg):
    """Words by a regular expression, n-grams, skip-grams and the sum over the set of features in plain Python."""
    import re

    rng = np.random.default_rng(4)
    vocabulary = ["Foo", "bar", "BAZ", "é", "x1", "!!", "?", "..", "und"]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 40))) for _ in range(60)] + ["", None, "a a a a", "x" * 5000]
    hashes = {}

    def word(w):
        if w not in hashes:
            _, data, offsets = next(wordhash.slices(pa.array([w])))
            hashes[w] = wordhash.words(data, offsets, wordhash.SIGN_CLASSES if cfg.signs else wordhash.WORD_CLASSES, cfg.lower)[0][0]
        return hashes[w]

    def feature_set(text):
        found = re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+" + (r"|[^A-Za-z0-9\s\u0080-\U0010ffff]+" if cfg.signs else ""), text or "")
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in found] if cfg.lower else found
        shift, out = np.uint64(64 - cfg.bits), {int(word(w) >> np.uint64(64 - cfg.bits)) for w in found}
        for gap in cfg.gaps:
            for a, b in zip(found, found[gap:]):
                pair, _ = wordhash.joined(np.array([word(a), word(b)]), np.zeros(2, int), 1, gap)
                out.add(int(pair[0] >> shift))
        if cfg.repeats and any(a == b == c for a, b, c in zip(found, found[1:], found[2:])):
            out.add(1)
        return out

    index = np.unique(np.concatenate([np.array(sorted(feature_set(t)), np.int64) for t in texts]))
    model = linear.LinearModel(cfg, -0.3, index, rng.standard_normal(len(index)).astype(np.float32))
    dense = np.zeros(1 << cfg.bits, np.float32)
    dense[model.index] = model.weight
    weight = dict(zip(index.tolist(), model.weight.tolist(), strict=True))
    want = [1 / (1 + np.exp(-(sum(weight[f] for f in feature_set(t)) - 0.3))) for t in texts]
    assert np.allclose(linear.scores(pa.array(texts), model, dense), want, atol=1e-5)
