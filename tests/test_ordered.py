"""Running values over cut groups, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from assayline.operators import issues, retrieval, sessions
from assayline.operators.ordered import Ordered

STEP = "session string, ordinal int, page string, action string, name string, target string, popup boolean"


def fold_clicks(rows):
    """The rule as it reads: each step against the last one kept."""
    kept = []
    for r in rows:
        _, _, page, action, name, target, popup = r
        last = kept[-1] if kept else None
        alike = last and action == last[3] == "click" and name and target and last[5] and (page, name) == (last[2], last[4])
        if alike and target != last[5]:
            if popup or not last[6]:
                kept[-1] = r
            continue
        kept.append(r)
    return [(r[0], r[1], i) for i, r in enumerate(kept, 1)]


@pytest.mark.parametrize("parts", [1, 7])
def test_clicks_against_a_plain_fold(spark, parts):
    rnd = random.Random(4)
    data = []
    for s, n in (("one", 400), ("two", 3), (None, 60), ("solo", 1), ("three", 90)):
        names = ["n"] if s == "one" else ["n", "m", "", None]
        for i in range(n):
            data.append((s, i, rnd.choice(["p", "p", "p", None]) if s != "one" else "p", rnd.choice(["click"] * 9 + ["fill", None]) if s != "one" else "click", rnd.choice(names), rnd.choice(["a", "b", "c"] + ([None, ""] if s != "one" else [])), rnd.choice([False, False, True, None])))
    want = sorted((x for s in {r[0] for r in data} for x in fold_clicks([r for r in data if r[0] == s])), key=str)
    df = spark.createDataFrame(rnd.sample(data, len(data)), STEP)
    got = sessions.dedupe_clicks(df, parts)
    assert got.columns == [*df.columns, "step"]
    assert sorted(((r.session, r.ordinal, r.step) for r in got.collect()), key=str) == want
    assert sessions.dedupe_clicks(df.limit(0), parts).count() == 0


def test_one_group_is_many_pieces(spark):
    df = spark.range(1000).select(F.lit("g").alias("g"), F.col("id").alias("o"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("v")).union(spark.createDataFrame([(None, 1, 5), ("a", 1, 7), (None, 2, None)], "g string, o long, v long"))
    o = Ordered(df, "g", [F.col("o")], 8)
    assert o.rows.where("g = 'g'").select("_part").distinct().count() > 4 and o.cut.count() <= 7
    got = {(r.g, r.o): (r.s, r.l) for r in o.last_before(o.sum_before(o.rows, "s", F.col("v")), "l", F.col("v"), F.col("v").isNotNull()).collect()}
    assert got[None, 2] == (5, 5) and got["a", 1] == (0, None) and len(got) == 1003
    assert all(got["g", i] == (sum(range(0, i, 3)), (i - 1) // 3 * 3 if i else None) for i in range(1000))


def fit(items, budget, frame, note, per_role):
    cost = lambda rows, extra: max(1, (sum(r[5] or 0 for r in rows) + frame + extra) // 4) if rows else 1
    if cost(items, 0) <= budget:
        return 0, items
    rules = (lambda r: r[2] not in retrieval.CONTEXT_ROLES, lambda r: r[3] is not False and r[4] is not False, lambda r: r[2] not in retrieval.LOW_ROLES)
    for stage, rule in enumerate(rules, 1):
        items = [r for r in items if rule(r)]
        if cost(items, note) <= budget:
            return stage, items
    seen, first = {}, []
    for r in items:
        seen[r[2] or ""] = seen.get(r[2] or "", 0) + 1
        if seen[r[2] or ""] <= per_role:
            first.append(r)
    if cost(first, note) <= budget:
        return 4, first
    head = []
    for r in first:
        if cost([*head, r], note) > budget:
            break
        head.append(r)
    return 5, head


@pytest.mark.parametrize("parts", [1, 6])
def test_budget_against_a_plain_loop(spark, parts):
    rnd = random.Random(9)
    roles = ["button", "link", "heading", "option", "menuitem", "main", "own", None]
    sizes = {f"g{i}": rnd.choice([1, 3, 10, 25, 60]) for i in range(60)} | {None: 40, "big": 400}
    data = [(g, i, rnd.choice(roles), rnd.choice([True, True, None, False]), rnd.choice([True, True, None, False]), rnd.choice([None, 0, 7, 20, 60])) for g, n in sizes.items() for i in range(n)]
    data += [("heads", i, "heading", True, True, 400) for i in range(3)] + [("wide", 0, "button", True, True, 9000)]
    want, stages = set(), set()
    for g in {r[0] for r in data}:
        stage, kept = fit([r for r in data if r[0] == g], 90, 40, 20, 2)
        stages.add(stage)
        want |= {(g, r[1], stage, stage > 0) for r in kept}
    df = spark.createDataFrame(rnd.sample(data, len(data)), "page string, ordinal int, role string, visible boolean, enabled boolean, chars int")
    got = retrieval.fit_budget(df, "page", "ordinal", 90, 40, 20, 2, parts=parts)
    assert stages == set(range(6)) and got.columns == [*df.columns, "stage", "truncated"]
    rows = [(r.page, r.ordinal, r.stage, r.truncated) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert retrieval.fit_budget(df.limit(0), "page", "ordinal").count() == 0


def test_prefix_of_one_group_in_pieces(spark):
    df = spark.range(500).select(F.lit(1).alias("g"), "id", (F.col("id") % 5).alias("cost"))
    got = retrieval.budget_prefix(df, "g", "id", "cost", 333, parts=6).orderBy("id").collect()
    running, want = 0, []
    for i in range(500):
        running += i % 5
        want += [(i, running)] if running <= 333 else []
    assert [(r.id, r.running) for r in got] == want


def test_prune(spark):
    e = [("p", 1, "button", "a", None, True, True), ("p", 2, "button", "", "a", True, True), ("p", 3, "button", " ", " ", True, True), ("p", 4, "heading", None, None, None, None), ("p", 5, "button", "b", "", False, True), ("p", 6, "link", "b", "", True, False), ("p", 7, "button", "c", "", True, True), ("p", 8, "button", "d", "", True, True), (None, 9, None, "x", "", True, True), ("q", 10, "button", "a", "", True, True)]
    df = spark.createDataFrame(e, "page string, o int, role string, name string, text string, visible boolean, enabled boolean")
    run = lambda **k: {r.o: r["rank"] for r in retrieval.prune(df, "page", "o", **k).collect()}
    assert run(limits={"button": 2}) == {1: 1, 4: None, 6: 1, 7: 2, 9: None, 10: 1}
    assert set(run(keep_context=False, drop_disabled=True, drop_invisible=False)) == {1, 5, 7, 8, 9, 10}
    assert set(retrieval.prune(df, "page", "o").columns) == {*df.columns, "rank"}


@pytest.mark.parametrize("parts", [1, 5])
def test_latest_change_of_a_busy_file(spark, parts):
    rnd = random.Random(2)
    commits = [("busy", f"s{i}", rnd.randrange(300)) for i in range(200)] + [("calm", "c", 5), (None, "n", 1)]
    asked = [(i, rnd.choice(["busy", "busy", "calm", "none", None]), rnd.randrange(-5, 310)) for i in range(200)]
    want = {k: max(((t, s) for p, s, t in commits if p == path and t <= ts), default=(None, None)) if path else (None, None) for k, path, ts in asked}
    got = issues.latest_change(spark.createDataFrame(asked, "key int, path string, ts int"), spark.createDataFrame(commits, "path string, sha string, committed int"), parts)
    assert {r.key: (r.committed, r.sha) for r in got.collect()} == want
