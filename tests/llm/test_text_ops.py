"""Line de-duplication, decontamination, mixing, HTML extraction and nearest neighbours on small fixtures."""

import random
import re

import numpy as np
import pytest

from assayline.llm import ann, decontaminate, extract, linededup, mixing
from assayline.llm.htmlblocks import blocks
from pyspark.sql import functions as F

from tests.llm.shapes import SHAPES


def removed_by_brute_force(rows, percent=80):
    lines = []
    for i, t in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        for j, x in enumerate(t.split("\n")):
            w = {y for y in re.split(r"[ \t\x0b\f\r]+", x.lower()) if y}
            if w:
                lines.append((i, j, w))
    out = {}
    for k, (i, j, w) in enumerate(lines):
        if any(100 * len(w & v) >= percent * len(w | v) for _, _, v in lines[:k]):
            out.setdefault(i, []).append(j)
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{min(int(rng.paretovariate(0.7)), 400)}" for _ in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 25))] for _ in range(40)]
    rows = []
    for i in range(40):
        said = [" ".join(rng.choice(words) if rng.random() < 0.05 else w for w in rng.choice(base)) for _ in range(rng.randint(0, 8))]
        rows.append((i, "\n".join(said)))
    rows += [(50, None), (51, ""), (52, "\n\n"), (None, rows[0][1]), (53, "One  TWO\r\ntwo one"), (54, "q " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = removed_by_brute_force(rows)
    got = {r["doc_id"]: r for r in linededup.mark_lines(df).collect()}
    assert {i: r["removed_lines"] for i, r in got.items() if r["n_removed"]} == want
    assert got[50]["n_lines"] == 0 and got[52]["n_lines"] == 3 and len(got) == len(rows)
    clean = linededup.drop_lines(df.selectExpr("doc_id", "text", "'x' as gone"))
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    for i, t in rows:
        if t is not None:
            assert texts[i] == "\n".join(x for j, x in enumerate(t.split("\n")) if j not in want.get(i, []))
    assert linededup.mark_lines(df.limit(0)).count() == 0


def test_lines_of_rows_with_one_id(spark):
    rows = [(1, "a b c\nx y z"), (1, "a b c\nx y z"), (1, "new line\nx y z"), (0, "x y z"), (None, "a b c"), (None, "a b c")]
    got = sorted((r["doc_id"] or -1, r["n_lines"], r["removed_lines"]) for r in linededup.mark_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 1, []), (-1, 1, []), (-1, 1, []), (1, 2, [0, 1]), (1, 2, [1]), (1, 2, [1])]
    wide = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, d string")
    assert sorted((r["text"] for r in linededup.drop_lines(wide).where("doc_id = 1").collect())) == ["", "a b c", "new line"]


def test_long_lines_and_one_split(spark, monkeypatch):
    """Variants of lines on both sides of the size from which sets have 128 parities; all words are split once, those of found pairs again."""
    rng, calls, split = random.Random(4), [], linededup._split
    monkeypatch.setattr(linededup, "_split", lambda *a: calls.append(a) or split(*a))
    rows = []
    for i in range(12):
        base = [f"v{rng.randrange(4000)}" for _ in range(rng.choice([80, 96, 97, 115, 300]))]
        for k in range(5):
            n = len(base) * rng.randrange(14) // 100
            said = [f"x{i}{k}{j}" if j < n else w for j, w in enumerate(base)] if k % 2 else base[: len(base) - 2 * n]
            rng.shuffle(said)
            rows.append((10 * i + k, rng.choice(" \t\x0b\f\r").join(said)))
    want = removed_by_brute_force(rows)
    got = linededup.mark_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").collect()
    assert {r["doc_id"]: r["removed_lines"] for r in got} == want and 15 < len(want) < 48
    assert len(calls) == 3


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_candidates_from_short_prefixes(spark, monkeypatch, percent):
    """One side of the join has the prefixes that sets of no smaller others need; every similar pair of which the later asks is found."""
    rng, posted, explode = random.Random(percent), [], F.posexplode
    sets = [set(rng.sample(range(60), rng.randint(1, 40))) for _ in range(60)]
    sets += [set(list(s)[: len(s) - rng.randint(0, 3)]) | set(rng.sample(range(60, 90), rng.randint(0, 2))) for s in sets]
    sets = [s for s in sets if s]
    rows = []
    for i, s in enumerate(sets):
        parity = sum(1 << w % 64 for w in s if w % 64 < 63 and (w + 64 not in s) and (w < 64 or w - 64 not in s))
        if 63 in s:
            parity -= 1 << 63
        rows.append((i // 4, i % 4, len(s), parity, None, sorted(s)[: len(s) - -(-len(s) * percent // 100) + 1], i % 5 and 1))
    classes = spark.createDataFrame(rows, "d long, l long, n int, p long, q long, prefix array<int>, asks int")
    monkeypatch.setattr(linededup.F, "posexplode", lambda c: posted.append(c) or explode(c))
    got = {(r["d"] * 4 + r["l"], r["ed"] * 4 + r["el"]) for r in linededup._candidates(classes, linededup.LineConfig(percent)).collect()}
    like = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
    want = {(i, j) for i in range(len(sets)) if i % 5 for j in range(i) if like(sets[i], sets[j])}
    assert len(want) > 5 and want <= got and all(i > j and i % 5 for i, j in got)
    probing, indexed = classes.select(*(F.sum(F.size(c)) for c in posted)).first()
    assert indexed < 0.8 * probing


def test_rarity_and_kept_hashes(spark, monkeypatch):
    """Eight counts a row, so that an eighth of the rows is grouped and collected; hashes are not written out, and not kept for longer."""
    words = [h for h in range(256) for _ in range(h % 7)] + [(5 << 40) + 3]
    collected, collect, names, stored = [], type(spark.range(1)).collect, [], linededup.stored
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda df: collected.extend(out := collect(df)) or out)
    levels = linededup.rarity(spark.createDataFrame([(words[:100],), (words[100:],), ([],)], "w array<long>"))
    monkeypatch.undo()
    counts = [sum(w % linededup.BUCKETS == b for w in words) for b in range(256)]
    assert levels == [min(int(np.log2(n) * 4), 127) if n else 0 for n in counts] + [0] * (linededup.BUCKETS - 256)
    assert len(collected) == 32
    monkeypatch.setattr(linededup, "stored", lambda df, name, **kw: names.append(name) or stored(df, name, **kw))
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert linededup.mark_lines(spark.createDataFrame([(1, "a b c\nc b a")], "doc_id long, text string")).first()["removed_lines"] == [1]
    assert "lines" in names and "line-hashes" not in names and spark.sparkContext._jsc.getPersistentRDDs().size() == before


ITEM = "A train leaves Paris at 60 km per hour and meets Paul after 3 hours near Paris said the driver."


def test_templates(spark):
    docs = [
        (1, "Intro. " + ITEM + " More text."), (2, "x\nA train leaves Rome at 45 km per hour and meets Anna after 9 hours near Rome said the driver."),
        (3, "A train leaves Rome at 45 km per hour and meets Anna after 9 hours near Milan said the driver."), (4, None), (5, ""), (None, ITEM), (6, "the driver of a train said nothing " * 3000), (1, "Intro. " + ITEM + " More text."),
    ]
    items = spark.createDataFrame([(7, ITEM, "z"), (7, ITEM, "z"), (8, None, "z"), (9, "too short", "z"), (10, "five words are just enough", "z")], "item_id long, text string, h string")
    df = spark.createDataFrame([(*d, "extra") for d in docs], "doc_id long, text string, item_key string")
    got = sorted((r["doc_id"], r["item_id"], r["kind"], r["changed"] > 0) for r in decontaminate.contaminated(df, items).collect())
    assert got == [(1, 7, "exact", False), (2, 7, "reparameterised", True)]
    left = decontaminate.drop_contaminated(df, items)
    assert left.columns == df.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 3, 4, 5, 6]
    assert decontaminate.contaminated(df, items.limit(0)).count() == 0 and decontaminate.contaminated(df.limit(0), items).count() == 0


@pytest.mark.parametrize(
    ("item", "text", "kind"),
    [
        ("A car drives 60 km in 3 hours on the road to town", "A car drives 5 km in 5 hours on the road to town", "reparameterised"),
        ("Add 2 and then 4 to the number of red apples here", "Add 4 and then 4 to the number of red apples here", "reparameterised"),
        ("Add 2 and then 2 to the number of red apples here", "Add 3 and then 4 to the number of red apples here", None),
        ("What is the capital of France", "Question: What is the capital of France", "exact"),
        ("What is the capital of France", "Question: What is the capital of Spain", "reparameterised"),
        (", What is the capital of France", "What is the capital of France", "exact"),
        ("What is the capital of France", "Question: Where is the capital of France", None),
        ("Name the largest planet", "He said: Name the largest planet. And again: name the largest planet", "exact"),
        ("Name the largest planet", "Name the smallest planet", None),
        ("Add 2 and 3", "Add 2 and 4", None),
        ("?!", "?!", None),
        ("the cats ate", "Then the cats ate.", "exact"),
        ("Anna Maria", "He met Anna Maria there", "exact"),
        ("At noon the friends of Anna Maria left for the old town by train", "At noon the friends of Paul left for the old town by train", "reparameterised"),
        ("At noon the friends of Paul left for the old town by train", "We know: At noon the friends of Anna Maria Berg left for the old town by train", "reparameterised"),
        ("Anna Maria went to the old town by train", "They say Anna Maria went to the old town by train", "exact"),
        ("Anna Maria went to the old town by train", "They say Paul went to the old town by train", "reparameterised"),
        ("12 34 56 78 90", "Numbers: 1 2 3 4 5", "reparameterised"),
    ],
)
def test_template_slots_and_short_items(spark, item, text, kind):
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, text), (2, "nothing of it")], "doc_id long, text string")
    assert [(r["doc_id"], r["kind"]) for r in decontaminate.contaminated(docs, items).collect()] == ([(1, kind)] if kind else [])


def test_windows_without_a_plain_word_choose_few_texts(spark):
    """An item of numbers adds only texts with as many numbers in a row; one of units alone, texts with a unit."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["worda wordb wordc 5", "1 2 3, 4; 5", "1 2 km 3 4 5", "plain words", "50 % off", "none of it"])], "doc_id long, text string")
    rows = docs.select("*", F.xxhash64("text").alias("text_key"))

    def chosen(*texts):
        words = spark.createDataFrame([(t,) for t in texts], "text string").select(decontaminate.tokens(F.col("text")).alias("it"))
        words = words.withColumn("short", F.size("it") < 5).withColumn("tt", decontaminate.template(F.col("it")))
        return sorted(r["doc_id"] for r in decontaminate._candidates(rows, words, decontaminate.TemplateConfig()).collect())

    plain = chosen("worda wordb wordc wordd worda wordb")
    assert plain == [] and chosen("worda wordb wordc") == [0]
    assert chosen("12 34 56 78 90") == [1] and chosen("12 34 56 78 90", "worda wordb wordc") == [0, 1]
    assert chosen("12 34 56 % 78 90") == [1, 2] and chosen("%") == [2, 4]


def contaminated_by_brute_force(docs, items, window=8, min_tokens=5, cover=0.6):
    """Every alignment of every item with every document, token by token."""
    import regex

    units = set(decontaminate.UNITS)

    def tokens(text):
        text = regex.sub(r"(?<=[\p{L}\p{N},;:)'\"’] {1,3})(?=\p{Lu}\p{Ll})", "\1", regex.sub("[\1\2]", " ", text or "")).lower()
        return [regex.sub(" +", " ", t) for t in regex.findall(r"\x01\p{L}++(?: {1,3}\x01\p{L}++)*+|\p{L}++|\p{N}++(?:[.,]\p{N}++)*+|[%$€£°]", text)]

    bare = lambda t: t.replace("\1", "")
    kind = lambda t: "@" if t[0] == "\1" else "#" if regex.match(r"\p{N}", t) else "u" if t in units else t
    out = {}
    for item_id, item in items:
        if item_id is None or item is None:
            continue
        forms = [tokens(item)]
        if len(forms[0]) > 1 and forms[0][1][0] == "\1":
            forms.append(tokens(", " + item))
        for it in forms:
            short = len(it) < min_tokens
            words = " ".join(map(bare, it)).split()
            for doc_id, text in docs:
                if doc_id is None or text is None or not it:
                    continue
                dt = tokens(text)
                dw = " ".join(map(bare, dt)).split()
                if short:
                    n = len(words)
                    if any(dw[i : i + n] == words for i in range(len(dw) - n + 1)):
                        slots = sum(kind(t) in ("#", "u") for t in words)
                        out.setdefault((doc_id, item_id), []).append((n, 0, slots, n))
                    continue
                n, k = len(it), min(len(it), window)
                for shift in range(-n, len(dt)):
                    seen = [dt[shift + i] if 0 <= shift + i < len(dt) else None for i in range(n)]
                    same = [s is not None and (kind(s) == kind(t) or i == 0 and bare(s) == bare(t)) for i, (s, t) in enumerate(zip(seen, it, strict=True))]
                    loose = [same[i] or j > 0 and i == j and seen[i] is not None and seen[i][0] == "\1" and bare(seen[i]) == it[i] for j in (0,) for i in range(n)]
                    if not any(all(loose[i : i + k]) for i in range(n - k + 1)):
                        continue
                    fills = {(kind(t), t, t if i == 0 and bare(s) == bare(t) else s) for i, (s, t, ok) in enumerate(zip(seen, it, same, strict=True)) if ok and kind(t) in ("@", "#", "u")}
                    slots = [(t, t if i == 0 and bare(s) == bare(t) else s) for i, (s, t, ok) in enumerate(zip(seen, it, same, strict=True)) if ok and kind(t) in ("@", "#", "u")]
                    if len({f[:2] for f in fills}) == len(fills) and sum(same) >= cover * n:
                        out.setdefault((doc_id, item_id), []).append((sum(same), -sum(a != b for a, b in slots), len(slots), n))
    return {key: max(v) for key, v in out.items()}


def test_templates_against_brute_force(spark):
    rng = random.Random(11)
    plain, names, units = [f"word{chr(97 + i)}" for i in range(14)], ["Anna", "Bob", "Carla", "Anna Maria"], ["km", "hours", "%"]

    def said(n):
        return " ".join(rng.choice(plain) if rng.random() < 0.6 else rng.choice(names) if rng.random() < 0.5 else rng.choice([str(rng.randint(1, 4)), rng.choice(units)]) for _ in range(n))

    items = [(i, said(rng.randint(1, 14)) + rng.choice(["", ".", "?"])) for i in range(27)] + [(27, "1 2 3 4 5"), (28, "7 % 8"), (29, "Anna km Bob % Carla")] + [(30, None), (31, ""), (None, "worda wordb"), (3, "x y z")]
    docs = []
    for i in range(60):
        parts = [said(rng.randint(0, 6))]
        for _ in range(rng.randint(0, 2)):
            other = rng.choice(items[:30])[1]
            swap = {n: rng.choice(names) for n in names[:3]} | {str(k): str(rng.randint(1, 9)) for k in range(1, 5)}
            parts += [" ".join(swap.get(w, w) if rng.random() < 0.9 else w for w in other.split(" ")), said(rng.randint(0, 5))]
        docs.append((i, rng.choice([" ", ". ", "\n", ", "]).join(parts)))
    docs += [(60, None), (61, ""), (None, items[0][1]), (5, docs[5][1]), (5, docs[6][1])]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): (r["matched"], -r["changed"], r["slots"], r["item_tokens"]) for r in got} == contaminated_by_brute_force(docs, items)
    assert len(got) > 60


def test_mixing_reaches_the_targets(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 900), "big" if rng.random() < 0.6 else f"s{i % 3}", rng.choice(["en", "en", "de", None])) for i in range(900)]
    rows += [(1000, None, None, None), (1000, None, None, None), (None, "x", "big", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "1 as tokens", "2 as weight")
    got = mixing.weigh(df).toPandas()
    assert len(got) == len(rows) and got.mix_probability.between(0, 1).all()
    kept = got.mix_tokens * got.mix_probability
    assert abs(kept.sum() / got.mix_tokens.sum() - 0.6) < 0.01
    share = kept.groupby(got.lang.fillna("-")).sum() / kept.sum()
    want = (got.mix_tokens.groupby(got.lang.fillna("-")).sum() / got.mix_tokens.sum()) ** 0.8
    assert np.abs(share - want / want.sum()).max() < 0.01
    sampled = mixing.sample(df)
    assert sampled.columns == df.columns and 0 < sampled.count() < len(rows)
    assert mixing.weigh(df.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a href=/>Home</a></nav><!-- ad -->
<div class="ad">Buy now</div><article><h1>A title &amp; more</h1><p><b>First   part<br>of it.<p>Second&nbsp;part, longer than the first.</article>
<div class=comments><p>Nice post</p></div><footer>&copy; us</footer>"""


@pytest.mark.parametrize(
    ("html", "texts"),
    [
        ("<p>We went <script>var a = '<p>';</script>out at dawn</p>", ["We went out at dawn"]),
        ("<p>x <style>p{}</style>y<noscript><p>no</p></noscript> z</p><p>b</p>", ["x y z", "b"]),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>", ["so x=2 holds"]),
        ("<p>see <svg><title>icon</title><path d='x'/><text>North</text><text>South</text></svg> here</p>", ["see North South here"]),
        ("<p>pick <select><option>a<option>b</select> one</p>", ["pick one"]),
        ("<p>an <object data='x'><param name='q'>fall back</object> text</p>", ["an fall back text"]),
        ("<p>an <iframe src='x'><p>no</p></iframe> end<video><source src=x>old</video></p>", ["an end"]),
        ("<div><p>a <select><option>b</div><p>c</p>", ["a", "c"]),
        ("<p>a <math><mi>x</p><p>next</p>", ["a x", "next"]),
        ("<p>a<template><p>q</p></template>b<p>c", ["ab", "c"]),
    ],
)
def test_hidden_elements_end_no_block(html, texts):
    from assayline.llm.htmlblocks import blocks

    got = list(blocks(html))
    assert [b.text for b in got] == texts and [b.path[0][0] for b in got] == [html[1 : html.index(">")]] + ["p"] * (len(texts) - 1)


def test_blocks():
    got = [(b.text, b.path[-1][0]) for b in blocks(PAGE)]
    assert got == [("Home", "nav"), ("Buy now", "div"), ("A title & more", "h1"), ("First part of it.", "b"), ("Second part, longer than the first.", "p"), ("Nice post", "p"), ("© us", "footer")]
    assert list(blocks("")) == [] and [b.text for b in blocks("a < b <x")] == ["a < b <x"]


def test_extraction(spark):
    page = lambda i: f"<html><body><nav><ul><li><a>Menu {i}</a></li></ul></nav><article><h1>Head {i}</h1><p>Text number {i} goes here, with words.</p><p>And more of it.</p></article><footer>Foot {i}</footer></body></html>"
    rows = [(i, f"u{i}", page(i)) for i in range(40)] + [(100, None, None), (101, "e", ""), (102, "c", PAGE), (5, "u5", page(5))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    cfg = extract.ExtractConfig()
    got = {r["page_id"]: r["main_text"] for r in extract.extract(df, extract.fit(df, cfg), cfg).collect()}
    assert got[7] == "Head 7\nText number 7 goes here, with words.\nAnd more of it." and got[100] == got[101] == ""
    assert got[102] == "A title & more\nFirst part of it.\nSecond part, longer than the first."


def test_extraction_of_many_shapes(spark):
    import os

    data = "/root/testdata/sf0.01"
    if not os.path.isdir(data):
        pytest.skip("no test tables here")
    pages = spark.read.parquet(f"{data}/pages.parquet")
    weights = extract.fit(pages)
    shapes = spark.createDataFrame([(name, html) for name, (html, _) in SHAPES.items()], "page_id string, html string")
    got = {r["page_id"]: r["main_text"] for r in extract.extract(shapes, weights).collect()}
    wrong = [name for name, (_, text) in SHAPES.items() if got[name] != text]
    assert len(wrong) <= 2, wrong  # 33 shapes, none of them in the sample
    for r in extract.extract(pages, weights).collect():
        assert r["main_text"] == "\n".join(b.text for b in blocks(r["html"] or "") if any(n[0] == "article" for n in b.path))


def neighbours(spark, rows, cfg, dim="double"):
    usable = ann.usable_rows(spark.createDataFrame(rows, f"vec_id long, embedding array<{dim}>").repartition(3))
    queries = usable.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in sorted(ann.search(usable, ann.index(usable, cfg), queries, cfg).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return got


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((500, 24))
    v[100:260] = v[7]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (920, [0.0] * 24), (940, [float("nan")] * 24), (960, [1.0, None] + [0.0] * 22), (980, [float("inf")] * 24)]
    got = neighbours(spark, rows, ann.CodeConfig(k=10, block=100, query_block=10))
    assert set(got) == set(range(0, 500, 20))
    hits = 0
    for q, found in got.items():
        score = v @ v[q]
        want = [i for i in np.lexsort((np.arange(500), -np.round(score, 9))) if i != q][:10]
        hits += len(set(want) & {i for _, i, _ in found})
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [(-round(s, 9), i) for _, i, s in found] == sorted((-round(s, 9), i) for _, i, s in found)  # nearest first, ties by id
        assert np.allclose([s for _, _, s in found], score[[i for _, i, _ in found]])
        if 100 <= q < 260:
            assert [i for _, i, _ in found][:10] == want  # all ties
    assert hits >= 0.95 * 250
    empty = ann.usable_rows(spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert ann.search(empty, ann.index(empty), empty.withColumnRenamed("vec_id", "query_id")).count() == 0


def test_neighbours_of_huge_and_tiny_vectors(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((60, 16)) * np.where(np.arange(60) % 2, 1e39, 1e-39)[:, None]
    got = neighbours(spark, [(i, x.tolist()) for i, x in enumerate(v)] + [(400, [1.0, 2.0]), (401, [2.0, 1.0])], ann.CodeConfig(k=5))
    for q in (0, 20, 40):
        want = [i for i in np.lexsort((np.arange(60), -(v @ v[q]))) if i != q][:5]
        assert [i for _, i, _ in got[q]] == want
    assert got[400] == [(1, 401, 4.0)]


def test_repeated_rows_take_one_place(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((60, 16))
    v[1] = 3 * v[0]
    more = {0: rng.standard_normal(16), 2: 2 * v[0], 3: -v[3]}  # second vectors under an id
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1, v[1].tolist())] * 30 + [(0, v[0].tolist())] * 5 + [(i, x.tolist()) for i, x in more.items()] * 15
    rows += [(2, (v[0] * (1 + j / 50)).tolist()) for j in range(30)]  # more than k vectors under one id
    got = neighbours(spark, rows, ann.CodeConfig(k=10))[0]
    score = np.full(60, -np.inf)
    for i, x in rows:
        score[i] = max(score[i], *(float(np.dot(x, q)) for q in (v[0], more[0])))
    want = [i for i in np.lexsort((np.arange(60), -score)) if i != 0][:10]
    assert [i for _, i, _ in got] == want and [k for k, _, _ in got] == list(range(1, 11))
    assert np.allclose([s for _, _, s in got], score[want])


def test_recall_on_the_table(spark):
    import os

    data = "/root/testdata/sf0.01"
    if not os.path.isdir(data):
        pytest.skip("no test tables here")
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect() if r["embedding"] is not None]
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], float)
    got = {}
    for r in ann.op3_rotated_codes(spark, data).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        want = [i for i in ids[np.lexsort((ids, -(v @ v[ids == q][0])))] if i != q][:20]
        hits += len(set(want) & {i for _, i in got[q]})
        total += len(want)
    assert hits >= 0.98 * total, hits / total


def test_mixing_to_given_weights(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(100, 900) + ("x = 1; " * 90 if i % 3 else ""), f"s{i % 4}", rng.choice(["en", "de", "fr"])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    cfg = mixing.MixConfig(targets={"lang": {"en": 0.5, "de": 0.3}, "topic": {"code": 0.8}}, keep=0.3, strict=True)
    got = mixing.weigh(df, cfg).toPandas()
    kept = got.mix_tokens * got.mix_probability
    for column, want in (("lang", {"en": 0.5, "de": 0.3, "fr": 0.2}), ("mix_topic", {"code": 0.8, "prose": 0.2})):
        share = kept.groupby(got[column]).sum() / kept.sum()
        assert all(abs(share[k] - x) < 0.001 for k, x in want.items()), share
    assert abs(kept.sum() / got.mix_tokens.sum() - 0.3) < 0.001
    apart = spark.createDataFrame([(1, "w", "a", "en"), (2, "w", "b", "de")], "doc_id long, text string, source string, lang string")
    cfg = mixing.MixConfig(targets={"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "de": 0.9}}, strict=True)
    with pytest.raises(ValueError):
        mixing.weigh(apart, cfg)


def test_mixing_sql_matches(spark):
    import os

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables here")
    import duckdb

    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{data}/documents.parquet'")
    want = sorted(c.sql("select doc_id, topic, n_tokens, probability, kept from (" + mixing.sql() + ")").fetchall())
    assert sorted(map(tuple, mixing.op1_mix_sources(spark, data).collect())) == want
