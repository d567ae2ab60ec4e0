"""Two step sequences aligned by a weighted longest common subsequence, in pieces.

Steps match by action, target and value. What can match is worked out between distinct targets, as a table of links;
its size is at most the product of a pair's distinct targets, not of its steps. A step that can match one step only,
which in turn can match no other, is an anchor if no other match of its pair can cross it; every best alignment takes
it, so that both sequences can be cut there. Pieces are aligned apart from each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayline.operators.fuzzy import similar_texts
from assayline.sources.workdir import stored

#: Actions that state an intent and are not recorded.
INTENT_ONLY = ("verify", "mock_status", "mock_data")
#: What an equal action, the ratio of the targets and an equal value count.
ACTION, TARGET, VALUE = 0.3, 0.5, 0.2


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df stored. Its few distinct values take so little room in files that Spark would take it for small and send all its
    rows through the driver; joins of it are by shuffling and sorting."""
    return stored(df, name).hint("merge")


def _steps(df: DataFrame) -> DataFrame:
    order = Window.partitionBy("pair").orderBy("ordinal")
    tidy = df.select("pair", "ordinal", F.coalesce("action", F.lit("")).alias("action"), F.lower(F.trim(F.coalesce("target", F.lit("")))).alias("target"), F.trim(F.coalesce("value", F.lit(""))).alias("value"))
    numbered = tidy.withColumn("step", F.row_number().over(order))
    return numbered.select("pair", "step", "action", "target", F.xxhash64("action", "target").alias("t"), F.xxhash64("value").alias("value"))


def target_links(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(pair, t, u, score, free) of distinct targets t of left and u of right that steps of one action may match by:
    score without what equal values add; free where it is enough without it.

    Values are left to the steps, so that many values of one target are one link."""
    x, y = (df.select("pair", "action", "target", "t").distinct() for df in (left, right))
    need = max((least - ACTION - VALUE) / TARGET, 0.02) - 1e-9
    near = similar_texts(x.select("pair", "action", F.col("target").alias("a")), y.select("pair", "action", F.col("target").alias("b")), ["pair", "action"], need, strict=False)
    score = F.lit(ACTION) + F.lit(TARGET) * F.col("ratio")
    told = near.select("pair", F.xxhash64("action", "a").alias("t"), F.xxhash64("action", "b").alias("u"), score.alias("score"))
    return told.where(F.col("score") + VALUE >= least - 1e-9).withColumn("free", F.col("score") >= least)


def _reach(own: DataFrame, other: DataFrame, links: DataFrame, t: str, u: str) -> DataFrame:
    """(pair, step, n, low, high): how many steps of other a step of own can match, the first and the last."""
    ends = (F.count(F.lit(1)).alias("n"), F.min("step").alias("low"), F.max("step").alias("high"))
    at = own.select("pair", "step", F.col("t").alias(t), "value")
    by_target = other.select("pair", F.col("t").alias(u), "step").groupBy("pair", u).agg(*ends)
    by_value = other.select("pair", F.col("t").alias(u), "value", "step").groupBy("pair", u, "value").agg(*ends)
    kinds = at.select("pair", t, "value").distinct()
    free = links.where("free").join(by_target, ["pair", u]).groupBy("pair", t).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    bound = links.where("not free").join(by_value, ["pair", u]).join(kinds, ["pair", t, "value"]).groupBy("pair", t, "value").agg(F.sum("n").alias("m"), F.min("low").alias("low2"), F.max("high").alias("high2"))
    both = at.join(free, ["pair", t], "left").join(bound.hint("merge"), ["pair", t, "value"], "left")
    n = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
    return both.select("pair", "step", n.alias("n"), F.least("low", "low2").alias("low"), F.greatest("high", "high2").alias("high"))


def _anchors(left: DataFrame, right: DataFrame, links: DataFrame) -> DataFrame:
    """(pair, step, other): anchors, by step of left and of right."""
    at = _reach(left, right, links, "t", "u")
    so_far, ahead = (Window.partitionBy("pair").orderBy("step").rowsBetween(*r) for r in ((Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)))
    at = at.withColumn("before", F.max("high").over(so_far)).withColumn("after", F.min("low").over(ahead))
    alone = at.where((F.col("n") == 1) & (F.coalesce("before", F.lit(0)) < F.col("low")) & F.coalesce(F.col("after") > F.col("low"), F.lit(True)))
    lone = _reach(right, left, links, "u", "t").where("n = 1").select("pair", F.col("step").alias("other"))
    return alone.select("pair", "step", F.col("low").alias("other")).join(lone.hint("merge"), ["pair", "other"])


def best_path(score_of: Callable[[int, int], float | None], matches: Callable[[int], tuple[np.ndarray, np.ndarray]], n: int, m: int) -> Iterator[tuple[int | None, int | None, float]]:
    """Pairs of places of an alignment of n and m steps with the greatest sum, last first; None where a step stays alone.

    matches(i): places of the other side that step i can match, with their scores. A match goes before leaving out a
    step, and leaving out one of the first side before one of the second. Rows of sums are kept at every so many steps
    only and worked out again on the way back, so that memory grows with m times the root of n.
    """

    def following(row: np.ndarray, i: int) -> np.ndarray:
        at, s = matches(i)
        inside = at < len(row) - 1
        at, s = at[inside], s[inside]
        out = row.copy()
        out[at + 1] = np.maximum(out[at + 1], row[at] + s)
        return np.maximum.accumulate(out)

    stride = max(int(n**0.5), 1)
    kept = {0: np.zeros(m + 1)}
    row = kept[0]
    for i in range(n):
        row = following(row, i)
        if (i + 1) % stride == 0:
            kept[i + 1] = row
    i, j = n, m
    while i:
        base = (i - 1) // stride * stride
        rows = [kept[base][: j + 1]]
        for k in range(base, i):
            rows.append(following(rows[-1], k))
        while i > base:
            if not j:
                i -= 1
                yield i, None, 0.0
                continue
            above, own = rows[i - 1 - base], rows[i - base]
            s = score_of(i - 1, j - 1)
            if s is not None and above[j - 1] + s >= max(above[j], own[j - 1]):
                i, j = i - 1, j - 1
                yield i, j, s
            elif above[j] >= own[j - 1]:
                i -= 1
                yield i, None, 0.0
            else:
                j -= 1
                yield None, j, 0.0
        kept.pop(base + stride, None)
    while j:
        j -= 1
        yield None, j, 0.0


class StepScores:
    """Scores between the steps of one piece: by the link of their targets, and whether their values are equal."""

    def __init__(self, x: np.ndarray, y: np.ndarray, links: dict[int, dict[int, float]], least: float):
        self.x, self.y, self.links, self.least = x, y, links, least  # rows (t, value)
        self.by_target = {u: np.flatnonzero(y[:, 0] == u) for u in np.unique(y[:, 0]).tolist()}
        self.known: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def total(score: float, equal_target: bool, equal_value: bool) -> float:
        return 1.0 if equal_target and equal_value else score + VALUE * (1.0 if equal_value else 0.0)

    def score(self, i: int, j: int) -> float | None:
        (t, v), (u, w) = self.x[i].tolist(), self.y[j].tolist()
        link = self.links.get(t, {}).get(u)
        s = None if link is None else self.total(link, t == u, v == w)
        return s if s is not None and s >= self.least else None

    def matches(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        t, v = key = tuple(self.x[i].tolist())
        if key not in self.known:
            at: list[np.ndarray] = [np.zeros(0, np.int64)]
            scores: list[np.ndarray] = [np.zeros(0)]
            for u, link in self.links.get(t, {}).items():
                places = self.by_target.get(u)
                if places is not None:
                    s = np.where(self.y[places, 1] == v, self.total(link, t == u, True), self.total(link, t == u, False))
                    at.append(places[s >= self.least])
                    scores.append(s[s >= self.least])
            if len(self.known) >= 64:  # each may be as long as the other side
                self.known.clear()
            self.known[key] = np.concatenate(at), np.concatenate(scores)
        return self.known[key]


def align(left: DataFrame, right: DataFrame, least: float = 0.7, exact: float = 0.999) -> DataFrame:
    """left, right (pair, ordinal, action, target, value) → (pair, left_step, right_step, kind, score).

    kind: exact, value_diff (a match that is not exact), missing (left only), extra (right only) or intent_only (left
    steps that state an intent; those of right are left out). Steps are numbered from 1 in their order, all of them. The
    sum of the scores is the greatest there is. Case and outer blanks of targets and outer blanks of values count for
    nothing; null is empty.
    """
    x, y = _kept(_steps(left), "left-steps"), _kept(_steps(right), "right-steps")
    no_step, no_score = F.lit(None).cast("int"), F.lit(0.0).alias("score")
    intents = x.where(F.col("action").isin(*INTENT_ONLY)).select("pair", F.col("step").alias("left_step"), no_step.alias("right_step"), F.lit("intent_only").alias("kind"), no_score)
    x, y = (df.where(~F.col("action").isin(*INTENT_ONLY)) for df in (x, y))
    links = _kept(target_links(x, y, least), "links")
    anchors = _kept(_anchors(x, y, links), "anchors")
    a, b = x.select("pair", "step", "t", F.col("value").alias("v")), y.select("pair", F.col("step").alias("other"), F.col("t").alias("u"), F.col("value").alias("w"))
    equal = F.col("v") == F.col("w")
    score = F.when(equal & (F.col("t") == F.col("u")), F.lit(1.0)).otherwise(F.col("score") + F.when(equal, F.lit(VALUE)).otherwise(F.lit(0.0)))
    anchored = anchors.join(a, ["pair", "step"]).join(b, ["pair", "other"]).join(links, ["pair", "t", "u"]).withColumn("score", score)
    anchored = anchored.select("pair", F.col("step").alias("left_step"), F.col("other").alias("right_step"), F.when(F.col("score") >= exact, "exact").otherwise("value_diff").alias("kind"), "score")

    def pieces(df: DataFrame, own: DataFrame) -> DataFrame:
        marked = df.select("pair", "step", "t", "value").join(own.withColumn("anchor", F.lit(1)), ["pair", "step"], "left")
        before = F.sum(F.coalesce("anchor", F.lit(0))).over(Window.partitionBy("pair").orderBy("step"))
        return marked.withColumn("piece", before).where("anchor is null").drop("anchor")

    px = _kept(pieces(x, anchors.select("pair", "step")), "left-pieces")
    py = _kept(pieces(y, anchors.select("pair", F.col("other").alias("step"))), "right-pieces")
    held = links.join(px.select("pair", "piece", "t").distinct(), ["pair", "t"]).join(py.select("pair", "piece", F.col("t").alias("u")).distinct(), ["pair", "piece", "u"])
    linked = held.select("pair", "piece").distinct().hint("merge")
    alone = px.join(linked, ["pair", "piece"], "left_anti").select("pair", F.col("step").alias("left_step"), no_step.alias("right_step"), F.lit("missing").alias("kind"), no_score)
    alone = alone.unionByName(py.join(linked, ["pair", "piece"], "left_anti").select("pair", no_step.alias("left_step"), F.col("step").alias("right_step"), F.lit("extra").alias("kind"), no_score))

    # One group a piece: its steps of both sides, and the links between their targets.
    def rows(df: DataFrame, side: int) -> DataFrame:
        return df.select("pair", "piece", F.lit(side).alias("side"), "step", "t", F.col("value").alias("other"), no_score)

    piece_rows = rows(px, 0).unionByName(rows(py, 1)).join(linked, ["pair", "piece"], "left_semi")
    piece_rows = piece_rows.unionByName(held.select("pair", "piece", F.lit(2).alias("side"), F.lit(0).alias("step"), "t", F.col("u").alias("other"), "score"))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p, q, e = (pdf[pdf["side"] == k].sort_values("step") for k in (0, 1, 2))
        known: dict[int, dict[int, float]] = {}
        for t, u, s in zip(e["t"].tolist(), e["other"].tolist(), e["score"].tolist(), strict=True):
            known.setdefault(t, {})[u] = s
        scores = StepScores(p[["t", "other"]].to_numpy(np.int64), q[["t", "other"]].to_numpy(np.int64), known, least)
        path = list(best_path(scores.score, scores.matches, len(p), len(q)))
        at, other = p["step"].tolist(), q["step"].tolist()
        out = pd.DataFrame({"pair": [key[0]] * len(path)})
        out["left_step"] = pd.array([None if i is None else at[i] for i, _, _ in path], "Int32")
        out["right_step"] = pd.array([None if j is None else other[j] for _, j, _ in path], "Int32")
        out["kind"] = ["missing" if j is None else "extra" if i is None else "exact" if s >= exact else "value_diff" for i, j, s in path]
        out["score"] = [s for _, _, s in path]
        return out

    pair_type = x.schema["pair"].dataType.simpleString()
    aligned = piece_rows.groupBy("pair", "piece").applyInPandas(one, f"pair {pair_type}, left_step int, right_step int, kind string, score double")
    return aligned.unionByName(anchored).unionByName(alone).unionByName(intents)
