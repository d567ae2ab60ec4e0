"""Fuzzy matches and alignments against plain loops over all pairs."""

import random
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayline.operators import alignment, fuzzy


def texts(rnd, n, alphabet="abc d", longest=14):
    out = []
    for _ in range(n):
        if out and rnd.random() < 0.6:
            t = list(rnd.choice(out))
            for _ in range(rnd.randint(0, 3)):
                at = rnd.randint(0, len(t))
                t[at : at + rnd.randint(0, 1)] = rnd.choice(["", "x", "é", "ab"])
            out.append("".join(t))
        else:
            out.append("".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, longest))))
    return out


@pytest.mark.parametrize(("least", "strict", "alphabet"), [(0.8, True, "abc d"), (0.8, True, "abcdefghijklm "), (0.75, False, "abcd"), (0.4, False, "abcdefghij"), (0.9, True, "ab")])
def test_similar_texts_equal_all_pairs(spark, least, strict, alphabet):
    rnd = random.Random(len(alphabet))
    pool = texts(rnd, 160, alphabet)
    left, right = ([(k, t) for k in (1, 2) for t in pool[side::2]] + [(1, ""), (1, None), (None, "abc"), (1, alphabet * 60)] for side in (0, 1))
    right += [(k, t) for k, t in left[:10]]
    want = {(k, a, b) for k, a in left for q, b in right if k is not None and k == q and a is not None and b is not None and a and b and (r := SequenceMatcher(None, a, b).ratio(), r > least if strict else r >= least)[1]}
    got = fuzzy.similar_texts(spark.createDataFrame(left, "k int, a string"), spark.createDataFrame(right, "k int, b string"), ["k"], least, strict).collect()
    assert len(got) == len({(r.k, r.a, r.b) for r in got})
    assert {(r.k, r.a, r.b) for r in got if r.a and r.b} == want and len(want) > 60
    assert all(r.ratio == SequenceMatcher(None, r.a, r.b).ratio() for r in got)


def test_best_match_takes_roles_order_and_disabled_into_account(spark):
    rnd = random.Random(5)
    names = [t for t in texts(rnd, 120, "abcdefg ", 20)]
    kinds = ["button", "a", "input", "option", "tooltip", "div"]
    elements = [(rnd.randint(1, 3), i, rnd.choice(kinds), rnd.choice([True, False, False, None]), rnd.choice([*names, None, ""])) for i in range(300)]
    targets = [(i, rnd.randint(1, 4), rnd.choice(["click", "FILL", "select", "hover", "press"]), rnd.choice([*names, None, "", "a"])) for i in range(150)]
    want = {}
    for i, page, action, target in targets:
        if target is None or len(target) <= 1:
            continue
        roles = fuzzy.ROLES.get(action.lower(), fuzzy.ROLES[""])
        best = 0.8
        for p, ordinal, role, disabled, text in elements:  # in page order
            if p == page and role in roles and not disabled and text and (r := SequenceMatcher(None, target, text).ratio()) > best:
                best, want[i] = r, (ordinal, text, r)
    got = fuzzy.best_fuzzy_match(spark.createDataFrame(targets, "id int, page int, action string, target string"), spark.createDataFrame(elements, "page int, ordinal int, role string, disabled boolean, text string"))
    assert {r.id: (r.ordinal, r.text, r.ratio) for r in got.collect()} == want and len(want) > 40


def counting(met):
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        met.add(len(a))
        return fuzzy._ratios(a, b)

    return counted


def test_candidates_grow_with_the_rows(spark):
    """Four times the names of one page make about four times the candidates, not sixteen times."""
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(400)]
    real = fuzzy._ratio
    counts = []
    for n in (400, 1600):
        names = [(1, " ".join(rnd.choice(words) for _ in range(3))) for _ in range(n)]
        df = spark.createDataFrame(names, "k int, a string")
        met = spark.sparkContext.accumulator(0)

        fuzzy._ratio = F.pandas_udf(counting(met), "double").asNondeterministic()
        try:
            fuzzy.similar_texts(df, df.withColumnRenamed("a", "b"), ["k"], 0.8).collect()
        finally:
            fuzzy._ratio = real
        counts.append(met.value)
    assert counts[1] < 8 * counts[0] and counts[1] < 0.002 * 1600**2, counts


def plain_alignment(x, y, least=0.7):
    """(left, right) of matched places, and the sum, by one table of all sums."""

    def score(a, b):
        if a[0] != b[0]:
            return 0.0
        if a == b:
            return 1.0
        return 0.3 + 0.5 * SequenceMatcher(None, a[1], b[1]).ratio() + 0.2 * (1.0 if a[2] == b[2] else 0.0)

    best = [[0.0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            s = score(a, b)
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + s if s >= least else 0.0)
    return best[-1][-1]


def step_lists(rnd, kinds, lengths):
    def step():
        return rnd.choice(["click", "fill", "verify"][: rnd.randint(2, 3)]), rnd.choice([f"{w} {n}" for w in ("save", "open", "send it") for n in range(kinds)] + [""]), rnd.choice(["", "x", "y"])

    x = [step() for _ in range(rnd.choice(lengths))]
    y = [s for s in x if rnd.random() < 0.8]
    for _ in range(rnd.randint(0, 6)):
        y.insert(rnd.randint(0, len(y)), step())
    for _ in range(rnd.randint(0, 2)):
        if len(y) > 3:
            y.append(y.pop(rnd.randrange(len(y))))
    return x, [(a, t.upper() if rnd.random() < 0.2 else t, v) for a, t, v in y]


def test_alignments_reach_the_greatest_sum(spark):
    rnd = random.Random(7)
    pairs = {p: step_lists(rnd, rnd.choice([1, 3, 12]), [0, 1, 5, 30, 60]) for p in range(60)}
    frames = [spark.createDataFrame([(p, 10 * k, *s) for p, both in pairs.items() for k, s in enumerate(both[side])], "pair long, ordinal int, action string, target string, value string") for side in (0, 1)]
    got = alignment.align(*frames).collect()
    for p, (x, y) in pairs.items():
        rows = [r for r in got if r.pair == p]
        assert sorted(r.left_step for r in rows if r.left_step) == list(range(1, len(x) + 1))
        assert sorted(r.right_step for r in rows if r.right_step) == [k + 1 for k, s in enumerate(y) if s[0] != "verify"]
        matched = sorted((r.left_step, r.right_step) for r in rows if r.left_step and r.right_step)
        assert [b for _, b in matched] == sorted(b for _, b in matched)
        kept = [[(a, t.lower(), v) for a, t, v in s if a != "verify"] for s in (x, y)]
        assert sum(r.score for r in rows) == pytest.approx(plain_alignment(*kept), abs=1e-9)
        assert all((r.kind == "intent_only") == (x[r.left_step - 1][0] == "verify") for r in rows if r.left_step)
        assert {r.kind for r in rows if r.right_step is None} <= {"missing", "intent_only"}


def test_a_long_pair_is_cut_at_its_anchors(spark):
    """20,000 steps that fill one field with a value each, pages turned in between; a tenth is left out."""
    n = 20_000
    new = F.col("id") % 50 > 0
    left = spark.range(n).select(F.lit(1).alias("pair"), F.col("id").alias("ordinal"), F.when(new, "fill").otherwise("click").alias("action"), F.when(new, F.concat(F.lit("field "), F.col("id") % 7, F.lit(" of the long form"))).otherwise("next").alias("target"), F.when(new, F.col("id").cast("string")).alias("value"))
    links = alignment.target_links(*(alignment._steps(left) for _ in range(2)), 0.7)
    assert links.count() <= 64
    left = left.where("ordinal < 2000")
    right = left.where("ordinal % 10 <> 3")
    got = alignment.align(left, right).groupBy("kind").agg(F.count("*").alias("n"), F.sum("score").alias("s")).collect()
    assert {r.kind: r.n for r in got} == {"exact": 1800, "missing": 200}


def test_anchors_cut_a_long_pair(spark):
    """Of each hundred steps one that no other resembles: no piece is longer than the steps between two of those."""
    n = 20_000
    names = F.concat(F.translate(F.md5(F.floor(F.col("id") / 100).cast("string")), "0123456789", "ghijklmnop"), F.lit(""))
    lone = F.col("id") % 100 == 0
    left = spark.range(n).select(F.lit(1).alias("pair"), F.col("id").alias("ordinal"), F.when(lone, F.concat(F.lit("a"), F.col("id"))).otherwise("click").alias("action"), F.when(lone, names).otherwise("next").alias("target"), F.lit(None).cast("string").alias("value"))
    right = left.where("ordinal % 50 <> 7")
    got = alignment.align(left, right).groupBy("kind").agg(F.count("*").alias("n")).collect()
    assert {r.kind: r.n for r in got} == {"exact": n * 49 // 50, "missing": n // 50}


def test_best_path_in_one_large_piece():
    import numpy as np

    rnd = np.random.default_rng(1)
    x, y = np.stack([rnd.integers(0, 3, 3000), rnd.integers(0, 2, 3000)], axis=1), np.stack([rnd.integers(0, 3, 2500), rnd.integers(0, 2, 2500)], axis=1)
    links = {0: {0: 0.8, 1: 0.55}, 1: {1: 0.8}, 2: {2: 0.8}}
    scores = alignment.StepScores(x, y, links, 0.7)
    path = list(alignment.best_path(scores.score, scores.matches, len(x), len(y)))
    row = np.zeros(len(y) + 1)
    for t, v in x.tolist():
        gain = np.array([s if (s := (links[t].get(u, -9.0) + 0.2 * (v == w))) >= 0.7 else -9.0 for u, w in y.tolist()])
        row = np.maximum.accumulate(np.maximum(row, np.concatenate([[0], row[:-1] + gain])))
    assert sum(s for _, _, s in path) == pytest.approx(row[-1])
    assert [i for i, _, _ in path if i is not None] == list(range(2999, -1, -1)) and [j for _, j, _ in path if j is not None] == list(range(2499, -1, -1))


def test_alignments_broadcast_no_steps(spark):
    steps = spark.range(40).select((F.col("id") % 4).alias("pair"), F.col("id").alias("ordinal"), F.lit("click").alias("action"), F.concat(F.lit("target"), F.col("id") % 5).alias("target"), F.lit("v").alias("value"))
    plan = alignment.align(steps, steps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
