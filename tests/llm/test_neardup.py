"""Chosen-path join and components against brute force."""

import random
import re

from assayline.llm import graph, neardup


def brute(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    comp = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    return {i: (len(sets[i]), comp[i]) for i in sets}


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.choice((1, 1, 2, 5))):
            copy = [rng.choice(words) if rng.random() < rng.choice((0.0, 0.02, 0.06)) else w for w in base]
            rows.append(" ".join(copy))
    rows += ["", None, "One", "one", "two words", "TWO\twords", "x " * 50_000, "x " * 49_999]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(10 * i, rows[k]) for i, k in enumerate(order)]


def test_against_brute_force(spark):
    rows = corpus()
    for k in (2, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.link(df, neardup.PathConfig(shingle=k)).collect()}
        assert got == brute(rows, k)


def test_variants_of_one_text_and_small_leaves(spark):
    rng = random.Random(5)
    base = [f"t{i}" for i in range(80)]
    rows = [(i, " ".join(rng.choice(base) if rng.random() < 0.03 else w for w in base)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.link(df, neardup.PathConfig(shingle=2, leaf=8, depth=4)).collect()}
    assert got == brute(rows, 2)


def test_drop_keeps_one_of_each_group(spark):
    text = " ".join(f"a{i}" for i in range(40))
    df = spark.createDataFrame([(3, text, 1), (1, text, 2), (1, text, 2), (7, "other words entirely, and more of them", 3), (None, "z", 4), (8, None, 5)], "doc_id long, text string, node int")
    left = neardup.drop_near_duplicates(df)
    assert left.columns == df.columns and sorted((r["doc_id"] or -1, r["node"]) for r in left.collect()) == [(-1, 4), (1, 2), (7, 3), (8, 5)]
    assert neardup.link(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (5, 5), (None, 3), (200, 100)]
    got = {r["u"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 200: 100}
