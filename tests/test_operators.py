"""Operators on tiny frames with the cases that the survey lists."""

import pytest
from pyspark.sql import functions as F

from assayline.functions.stats import rounded_rank
from assayline.operators import alignment, codegraph, crawl, evals, issues, knowledge, retrieval, runs, sessions


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_llm_sla(spark):
    calls = spark.createDataFrame([("chat", 100.0, False, None, 0), ("chat", 200.0, True, "x", 2), (None, 300.0, None, "", None)], "kind string, elapsed_ms double, timeout boolean, error string, retry_count int")
    got = {r["kind"]: r for r in runs.llm_sla(calls).collect()}
    assert got["(all)"]["p50"] == 200.0 and got["(all)"]["total_calls"] == 3 and got["(all)"]["timeout_rate"] == 0.3333
    assert got["unknown"]["error_count"] == 0 and got["chat"]["retry_total"] == 2


def test_rounded_rank_is_half_even(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 6)], "v double")
    assert rounded_rank(df, [], "v", {"p50": 50, "p0": 0, "p100": 100}).first()[:] == (2.0, 1.0, 5.0)


def test_flake(spark):
    data = [("2024-01-0%d" % (1 + i % 7), "s", "c", "PASS" if i < 7 else "FAIL") for i in range(10)] + [("2023-12-01", "s", "c", "FAIL"), ("2024-01-02", None, "c", None)]
    df = spark.createDataFrame(data, "date string, site string, scenario string, status string").withColumn("date", F.col("date").cast("date"))
    m = runs.flake_matrix(df, F.lit("2024-01-07").cast("date"))
    got = {r["site"]: r for r in runs.flake_flags(m).collect()}
    assert got["s"]["total"] == 10 and got["s"]["unsupported"] is False and got["?"]["passed"] == 0
    worse = runs.flake_flags(runs.flake_matrix(df.withColumn("status", F.when(F.col("status") == "PASS", "PASS").otherwise("FAIL")).where("site = 's'").unionAll(df.where("site = 's' and status = 'FAIL' and date >= '2024-01-01'")), F.lit("2024-01-07").cast("date")))
    assert worse.first()["unsupported"] is True


def test_healer_ratio_null_fails(spark):
    one = spark.createDataFrame([("p", 1.0, 0, 10.0, False)], "page string, accuracy double, healer_calls int, elapsed_ms double, truncated boolean")
    g = runs.ab_gate(one, one).first()
    assert g["healer_ratio"] is None and g["healer_ok"] is False and g["accuracy_ok"] is True


def test_cluster_leader_and_ties(spark):
    data = [("a", "r", "f", "d/x.py", 5, "MINOR", 0), ("b", "r", "f", "d/y.py", 9, "BLOCKER", 1), ("c", "r", "f", "d/z.py", 9, "BLOCKER", 2), ("e", "r", "g", "d/x.py", 0, "odd", 3)]
    df = spark.createDataFrame(data, "key string, rule string, function string, component string, line int, severity string, ordinal int")
    got = {r["key"]: [x["key"] for x in r["affected"] or []] for r in issues.cluster_issues(df).collect()}
    assert got == {"b": ["c", "a"], "e": []}


def test_enclosing_chunk_prefers_functions(spark):
    chunks = spark.createDataFrame([("p", "C", "class", 1, 100, 0), ("p", "f", "function", 10, 50, 1), ("p", "blk", "block", 20, 22, 2)], "path string, symbol string, kind string, start_line int, end_line int, ordinal int")
    points = spark.createDataFrame([("k1", "p", 21), ("k2", "p", 99), ("k3", "q", 1)], "key string, path string, line int")
    assert rows(issues.enclosing_chunk(points, chunks), "key") == [("k1", "f", 40), ("k2", "C", 99), ("k3", None, None)]


def test_prefix_links(spark):
    c = spark.createDataFrame([("Login",), ("Log",), ("login",)], "candidate string")
    s = spark.createDataFrame([(1, "LoginHandler"), (2, "LogEvent"), (3, "loginx"), (4, "login_page")], "id int, symbol string")
    assert rows(codegraph.prefix_links(c, s), "id") == [("Login", 1, "LoginHandler"), ("login", 4, "login_page")]


def test_callers_index_imports(spark):
    chunks = spark.createDataFrame([("a.py", "caller", ["target"]), ("b.py", "target", []), ("c.py", "other", ["target"]), ("d.py", "third", ["target", "get"])], "path string, symbol string, callees array<string>")
    imports = spark.createDataFrame([("a.py", ["target"]), ("c.py", ["nope"])], "path string, imports array<string>")
    assert rows(codegraph.callers_index(chunks, imports), "caller_ref") == [("b.py", "target", "a.py#caller"), ("b.py", "target", "d.py#third")]


def test_group_conversations_order(spark):
    data = [("c1", "x", 2, 0), ("c2", "", None, 1), ("c3", "x", 1, 2), ("c4", None, 1, 3), ("c5", "y", None, 4)]
    got = evals.group_conversations(spark.createDataFrame(data, "case_id string, conversation_id string, turn int, ordinal int"))
    assert [r["case_ids"] for r in got.orderBy("single", "first_ordinal").collect()] == ["c3,c1", "c5", "c2", "c4"]


def test_fail_fast_and_rescore(spark):
    t = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, False), (2, 1, False)], "conversation_id int, turn int, failed boolean")
    assert rows(evals.until_first_failure(t), "conversation_id", "turn") == [(1, 1, False), (1, 2, True), (2, 1, False)]
    s = spark.createDataFrame([("a", 0.7, 1, 0.68), ("a", 0.7, 2, 0.9), ("a", 0.7, 3, 0.8), ("b", 0.7, 1, 0.1), ("b", 0.7, 2, 0.9)], "case_id string, threshold double, sample_no int, score double")
    assert rows(evals.rescored(s), "case_id") == [("a", True, 0.8), ("b", False, 0.1)]


def test_fingerprint_ignores_order_not_copies(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, t string")
    f = lambda df: tuple(evals.fingerprint(df, ["i", "t"]).first())
    assert f(a) == f(a.repartition(3).orderBy(F.desc("i"))) and f(a) != f(a.union(a.limit(1)))


def test_frame_at_falls_back_to_last(spark):
    a = spark.createDataFrame([("s", 5, 1), ("s", 50, 2), ("t", 1, 3)], "session string, ts int, event_id int")
    f = spark.createDataFrame([("s", 5, "f5"), ("s", 9, "f9")], "session string, ts int, frame string")
    assert rows(sessions.frame_at(a, f).select("event_id", "frame"), "event_id") == [(1, "f5"), (2, "f9"), (3, None)]


def test_clicks_collapse_in_chain(spark):
    data = [("s", 1, "p", "click", "n", "a", False), ("s", 2, "p", "click", "n", "b", True), ("s", 3, "p", "click", "n", "c", False), ("s", 4, "p", "click", "n", "b", False), ("s", 5, "p", "click", "m", "b", False)]
    df = spark.createDataFrame(data, "session string, ordinal int, page string, action string, name string, target string, popup boolean")
    assert [(r["ordinal"], r["step"]) for r in sessions.dedupe_clicks(df).orderBy("step").collect()] == [(2, 1), (4, 2), (5, 3)]


def test_align(spark):
    schema = "pair long, ordinal int, action string, target string, value string"
    a = spark.createDataFrame([(1, 1, "click", "x", ""), (1, 2, "fill", "name", "a"), (1, 3, "press", "k", "")], schema)
    b = spark.createDataFrame([(1, 1, "click", "x", ""), (1, 2, "fill", "name", "b"), (2, 1, "click", "y", "")], schema)
    got = [(r["pair"], r["kind"]) for r in alignment.align(a, b).orderBy("pair", F.coalesce("left_step", "right_step")).collect()]
    assert got == [(1, "exact"), (1, "value_diff"), (1, "missing"), (2, "extra")]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("HTTP://Ex.com:80/a?b=2&a=1#f", "http://ex.com/a?a=1&b=2"), ("https://e.com:443", "https://e.com/"), ("https://e.com/x/?utm_source=q&_t=1", "https://e.com/x/"), ("https://u:p@E.com:8443/x", "https://u:p@e.com:8443/x")],
)
def test_normalize_url(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "u string").select(crawl.normalize_url(F.col("u"))).first()[0] == want


def test_parents(spark):
    u = spark.createDataFrame([("a", None), ("b", "a"), ("c", "zz")], "url string, parent_url string")
    assert {r["url"]: r["state"] for r in crawl.with_parent(u).collect()} == {"a": "root", "b": "child", "c": "orphan"}


def test_citation_tiers(spark):
    data = [("see src/auth/login.py", "src/auth/login.py", "f"), ("calls do_login", "x/y.py", "do_login"), ("in login.py", "src/login.py", "zz"), ("in a.py", "q/a.py", "zz"), ("?", "?", "?")]
    df = spark.createDataFrame(data, "t string, p string, s string")
    assert [r[0] for r in df.select(retrieval.citation_tier(F.col("t"), F.col("p"), F.col("s"))).collect()] == ["path", "symbol", "basename", None, None]


def test_rule_history_finds_keys_inside_words(spark):
    rules = spark.createDataFrame([("eslint:no-unused-vars",), ("java:S12",), ("S12",), ("x:ab",), ("py:a.b",), (None,)], "rule string")
    subjects = ["fix no-unused-vars in x", "fix S123", "fix s12", "a.b and S12", "axb", None, "", "S12 again", "and S12"]
    commits = spark.createDataFrame([(f"c{i}", t, i) for i, t in enumerate(subjects)], "sha string, subject string, committed int")
    got = sorted((r.rule, r.sha, r["rank"]) for r in knowledge.rule_history(rules, commits).collect())
    assert got == sorted([("eslint:no-unused-vars", "c0", 1), ("py:a.b", "c3", 1), *((rule, sha, k + 1) for rule in ("java:S12", "S12") for k, sha in enumerate(("c8", "c7", "c3")))])


def test_many_patterns_at_once(spark):
    import random

    rnd = random.Random(8)
    some = lambda n: "".join(rnd.choice("abcdé-.") for _ in range(n))
    patterns = sorted({some(rnd.randint(2, 7)) for _ in range(3000)})
    texts = [some(rnd.randint(0, 40)) for _ in range(300)] + [None, "", "ab"]
    got = knowledge.containing(spark.createDataFrame(enumerate(texts), "id int, text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string")).select("id", "pattern").collect()
    assert sorted(map(tuple, got)) == sorted((i, p) for i, t in enumerate(texts) if t for p in patterns if len(p) >= 3 and p in t)


def test_ranges_around_points(spark):
    import random

    rnd = random.Random(9)
    spans = [(p, a := rnd.choice([0, 1, 7, rnd.randint(0, 3000)]), a + rnd.choice([0, 1, 2, 63, rnd.randint(0, 3000)]), i) for i in range(150) for p in ("f", "g")] + [("f", 5, 4, 999), ("f", None, 9, 998), (None, 0, 9, 997), ("f", 0, 2**31 - 3, 996)]
    points = [(f"{p}{k}", p, k) for p in ("f", "g", "h") for k in [0, 1, 2, 63, 64, *range(5, 6200, 37)]] + [("n", None, 3), ("m", "f", None), ("neg", "f", -1)]
    df = spark.createDataFrame(spans, "chunk_path string, start_line int, end_line int, ordinal int")
    got = issues.containing_ranges(spark.createDataFrame(points, "key string, path string, line int"), df).select("key", "ordinal").collect()
    want = sorted((k, o) for k, p, line in points for q, a, b, o in spans if p is not None and p == q and line is not None and a is not None and a <= line <= b)
    assert sorted(map(tuple, got)) == want


def test_callers_are_counted_as_their_links(spark):
    """Counts by file and caller equal those of the links, self calls, closed calls and files without imports included."""
    import random

    deal = random.Random(5)
    names = [f"name{k}" for k in range(6)]
    for _ in range(6):
        chunks = [(f"f{deal.randrange(5)}", deal.choice(names), deal.sample(names, deal.randrange(3))) for _ in range(14)] + [("x", "alone", ["alone"]), ("y", "shut", ["shut", "name1"])]
        imports = [(f"f{k}", deal.sample(names, deal.randrange(4))) for k in range(3)] + [("y", ["none"])]
        c, i = spark.createDataFrame(chunks, "path string, symbol string, callees array<string>"), spark.createDataFrame(imports, "path string, imports array<string>")
        known, own = dict(imports), {(p, s) for p, s, _ in chunks}
        links = {(q, t, f"{p}#{s}") for p, s, cs in chunks for t in cs for q, u in own if t == u and (p == q or t in known.get(p, []) or not known.get(p)) and (p, s) != (q, u)}
        assert set(map(tuple, codegraph.callers_index(c, i).select("callee_path", "callee", "caller_ref").collect())) == links
        want = sorted((t, len({r for _, u, r in links if u == t}), len({q for q, u, _ in links if u == t})) for t in {t for _, t, _ in links})
        assert sorted(map(tuple, codegraph.callers_counts(c, i).select("callee", "callers", "paths").collect())) == want


def test_calls_keep_no_lists_of_imports(spark):
    chunks = spark.createDataFrame([("a.py", "caller", ["target"])], "path string, symbol string, callees array<string>")
    imports = spark.createDataFrame([("a.py", ["target"])], "path string, imports array<string>")
    for got in (codegraph.callers_index(chunks, imports), codegraph.callers_counts(chunks, imports)):
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "array_contains" not in plan


def test_tasks_of_dealt_rows_do_not_grow(spark):
    from assayline.sources.tables import dealt

    few, many = (dealt(spark.range(n).withColumn("k", F.col("id") % 977), "k", rows=1000) for n in (2_000, 40_000))
    assert few.rdd.getNumPartitions() == 4 and many.rdd.getNumPartitions() == 40
    assert max(many.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < 4_000 and many.count() == 40_000


def test_snippets_are_trimmed_again(spark):
    lines = spark.createDataFrame([("f", k, f"code {k}") for k in range(1, 200)], "component string, line_no int, code string")
    wide = issues.snippet_window(spark.createDataFrame([("a", "f", 100), ("b", "f", 3)], "key string, component string, line int"), lines, 50)
    got = {r.key: (r.snippet.split("\n"), r.s.split("\n")) for r in wide.select("key", "snippet", issues.retrimmed(F.col("snippet"), 10).alias("s")).collect()}
    assert len(got["a"][0]) == 101 and len(got["a"][1]) == 21 and got["a"][1][10] == ">> 100: code 100"
    assert len(got["b"][0]) == 53 and got["b"][1][2] == ">> 3: code 3" and len(got["b"][1]) == 13


def test_snippets_at_the_edges_of_blocks(spark):
    """All lines as points, with gaps, against slices; lines of a few blocks are laid out, not one for each line asked for."""
    numbers = [n for n in range(-7, 140) if n % 11 != 4]
    lines = spark.createDataFrame([("f", n, None if n == 50 else f"c{n}") for n in numbers] + [("g", 3, "x" * 9)], "component string, line_no int, code string")
    points = lines.select(F.concat_ws(":", "component", "line_no").alias("key"), "component", F.col("line_no").alias("line")).unionByName(spark.createDataFrame([("none", "f", 900), ("null", "f", None)], "key string, component string, line int"))
    df = issues.snippet_window(points, lines, 3, 5)
    want = {f"f:{n}": "\n".join(f"{'>> ' if m == n else '   '}{m}: c{m}" for m in numbers if abs(m - n) <= 3 and m != 50) for n in numbers}
    assert {r.key: r.snippet for r in df.collect()} == want | {"g:3": ">> 3: xxxxx"}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence((line" not in plan and "block" in plan


def test_a_document_of_many_lines(spark):
    """100,000 lines, all of them points, with spans of three depths around each."""
    points = spark.range(100_000).select(F.col("id").cast("string").alias("key"), F.lit("f").alias("path"), F.col("id").cast("int").alias("line"))
    spans = points.select("path", F.col("line"), F.explode(F.array(F.lit(10), F.lit(100), F.lit(1000))).alias("w")).where("line % w = 0")
    chunks = spans.select("path", F.concat_ws("_", "w", "line").alias("symbol"), F.when(F.col("w") == 100, "function").otherwise("class").alias("kind"), F.col("line").alias("start_line"), (F.col("line") + F.col("w") - 1).alias("end_line"), F.col("line").alias("ordinal"))
    got = issues.enclosing_chunk(points, chunks).groupBy("span").agg(F.count("*").alias("n")).collect()
    assert [(r.span, r.n) for r in got] == [(99, 100_000)]


def test_citation_depth(spark):
    rows = [("`a1` `ok` and `ok`, `x`, `two words`, `12`, `[MAJOR]`, `" + "n" * 81 + "`, `Foo.bar()`",), ("no ticks",), ("",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(retrieval.citation_depth(F.col("t"))).collect()] == [3, 0, 0, 0]


def test_compat_verdicts(spark):
    signals = "captcha boolean, closed_shadows int, sockets int, event_sources int, canvas_ratio double, dialogs int, frames int"
    rows = [(True, 1, 1, 1, 0.9, 1, 9), (False, 2, 1, 0, None, 0, 0), (False, 0, 1, 2, 0.31, 3, 3), (False, 0, 0, 0, 0.3, 0, 2), (None, None, None, None, None, None, None)]
    got = [(r.v.verdict, r.v.reasons) for r in spark.createDataFrame(rows, signals).select(crawl.compat_verdict(F.struct("*")).alias("v")).collect()]
    assert got == [
        ("incompatible:captcha", ["captcha"]), ("incompatible:closed-shadow", ["closed_shadows: 2"]),
        ("limited", ["sockets: 1", "event_sources: 2", "canvas_ratio", "dialogs: 3", "frames: 3"]), ("compatible", []), ("compatible", []),
    ]
    page = "<script src='https://x/turnstile/api.js'></script><iframe src=a></iframe><IFRAME></IFRAME><script>new WebSocket('u'); confirm(1); el.attachShadow({mode: 'closed'})</script>"
    told = spark.createDataFrame([(page,), (None,)], "h string").select(crawl.static_signals(F.col("h")).alias("s")).collect()
    assert tuple(told[0].s) == (True, 1, 1, 0, None, 1, 2) and tuple(told[1].s) == (False, 0, 0, 0, None, 0, 0)
