"""Verdicts, answers, prompts, selectors and page texts on tiny frames."""

import pytest
from pyspark.sql import functions as F

from assayline.functions import selectors
from assayline.operators import answers, crawl, issues, knowledge, pages, prompts, sessions, verdicts


def test_rag_verdicts(spark):
    rows = [(10, 0, 0, 70.0, 80.0, 50.0, 0.0, 10.0), (4, 1, 1, 100.0, 10.0, 10.0, 6.0, 25.0), (9, 0, 0, 29.9, 30.0, 30.0, 21.0, 0.0), (1, 3, 0, 0.0, 60.0, 60.0, 0.0, 51.0)]
    df = spark.createDataFrame(rows, "analysed int, n_empty int, n_retry int, citation_pct double, callers_pct double, tests_pct double, retry_pct double, empty_pct double")
    got = [tuple(r) for r in verdicts.rag_verdicts(df).select("n_measured", "citation", "buckets", "quality", "overall").collect()]
    assert got == [(10, "green", "green", "green", "green"), (2, "gray", "red", "yellow", "red"), (9, "red", "yellow", "red", "red"), (0, "gray", "green", "red", "red")]


def test_kb_verdict(spark):
    rows = [(60, 0.5, 3, 2, 40.0, 0, 100), (0, 1.0, 0, 0, 0.0, 9, 0), (50, 0.81, 1, 0, 31.0, 0, 50)]
    df = spark.createDataFrame(rows, "chunks int, orphan_ratio double, endpoints int, decorators int, coverage_pct double, parser_failed int, caller_links int")
    got = [tuple(r) for r in verdicts.kb_verdict(df).select("score", "level", "actions").collect()]
    assert got == [(100, "high", ["none_needed"]), (0, "low", ["add_tests", "check_caller_index", "check_parser"]), (50, "medium", ["define_api_rules", "check_caller_index"])]


def test_learn_verdicts(spark):
    names = "files_analyzed int, parser_failed int, chunks int, callees_pct double, test_link_pct double, endpoints int, type_chunks int, docstrings int, parser_pct double, n_asymmetric int, diagnosed int, any_hit_pct double"
    rows = [(9, 1, 50, 45.0, 25.0, 1, 0, 0, 90.0, 0, 5, 60.0), (6, 4, 10, 45.0, 0.0, 0, 0, 3, 60.0, 1, 5, 20.0), (0, 0, 0, 0.0, 0.0, 0, 0, 0, 10.0, 0, 0, 0.0)]
    got = [tuple(r) for r in verdicts.learn_verdicts(spark.createDataFrame(rows, names)).select("scope", "depth", "quality", "impact").collect()]
    assert got == [("green", "green", "green", "green"), ("yellow", "yellow", "yellow", "yellow"), ("red", "gray", "red", "gray")]


def test_issue_and_overall_verdict(spark):
    rows = [(True, False, 0, 0, 0, None, None, False), (False, True, 1, 1, 0, "high", "x", False), (False, False, 0, 0, 0, "low", "x", False), (False, False, 3, 0, 0, "HIGH", "false_positive", False), (False, False, 3, 2, 4, "low", "x", True), (False, False, 3, 3, 0, "high", "x", False), (False, False, 3, 0, 0, "low", "x", False)]
    df = spark.createDataFrame(rows, "s boolean, e boolean, used int, cited int, depth int, conf string, cls string, partial boolean")
    got = [r[0] for r in df.select(verdicts.issue_verdict(*(F.col(c) for c in ("s", "e", "used", "cited", "depth", "conf", "cls", "partial")))).collect()]
    assert [g and g.split(":")[0] for g in got] == ["warn", "warn", "warn", "warn", "warn", "ok", None] and "false positive" in got[3] and got[4].endswith("2/3, 4 named")
    signals = spark.createDataFrame([("a", "High", ["x"], 1, 3), ("a", None, ["Partial_x"], 3, 3), ("a", "low", None, 2, 4), ("a", "medium", [], 0, 0)], "k string, confidence string, labels array<string>, cited int, used int")
    assert verdicts.trust_signals(signals, ["k"]).first()[:] == ("a", 1, 1, 1, 2)
    totals = spark.createDataFrame([(10, 1, 9, 0, 0), (10, 0, 9, 3, 3), (10, 0, 7, 1, 4), (10, 0, 6, 0, 0), (0, 0, 0, 0, 0)], "created int, failed int, high int, low int, partial int")
    assert [tuple(r) for r in verdicts.overall_verdict(totals).select("light", "level").collect()] == [("red", "low"), ("yellow", "medium"), ("green", "high"), ("yellow", "medium"), ("yellow", "medium")]


@pytest.mark.parametrize(
    ("text", "status", "title", "impact"),
    [
        ('{"title":"a","impact_analysis_markdown":"x"}', "ok", "a", "x"),
        ('<think>{"no":1}</think> ```json\n{"title":"a","impact_analysis_markdown":"x"}\n```', "ok", "a", "x"),
        ('{"title":"a\nb","impact_analysis_markdown":"use \\d and \\n"}', "ok", "a\nb", "use \\d and \n"),
        ('{"title":"q\\"x\\p\\u00e9\\u12","impact_analysis_markdown":"x"}', "ok", 'q"x\\pé\\u12', "x"),
        ('{"title":"a","impact_analysis_markdown":" "}', "parsed_but_empty", "a", " "),
        ('{"title":null}', "parsed_but_empty", "", ""),
        ("no json", "no_json_block", "", ""),
        ('{"title":"a"', "no_json_block", "", ""),
        ('{"title":"a",,}', "json_decode_error", "", ""),
        ('<Think>{"title":"a"}', "thinking_unterminated", "", ""),
        ("  \n", "empty_llm_text", "", ""),
        (None, "empty_llm_text", "", ""),
    ],
)
def test_normalize_answers(spark, text, status, title, impact):
    r = answers.normalize_answers(spark.createDataFrame([(text, True)], "llm_text string, has_context boolean")).first()
    assert (r["parse_status"], r["title"], r["impact_analysis_markdown"]) == (status, title, impact) and r["confidence"] == "medium"


def test_answers_without_context_and_labels(spark):
    rows = [('{"labels":"one","confidence":"high","classification":""}', None), ('{"labels":["a","context:empty"]}', False), ('{"labels":["a"],"classification":"wont_fix"}', True)]
    got = [(r["labels"], r["confidence"], r["classification"]) for r in answers.normalize_answers(spark.createDataFrame(rows, "llm_text string, has_context boolean")).collect()]
    assert got == [(["one", "context:empty"], "low", "true_positive"), (["a", "context:empty"], "low", "true_positive"), (["a"], "medium", "wont_fix")]


def test_metadata_hits(spark):
    schema = "answer string, endpoint string, decorators array<string>, params array<string>, used array<struct<endpoint:string,decorators:string>>"
    rows = [
        ("POST /login uses require_role and `email`", "POST /login", ["@require_role('a')", "@require_role", "@x"], ["email", "id", "password"], [("GET /login", "@app.get('/x') @require_role"), ("GET /login", None)]),
        ("a POST and email", "POST /login", ["@nothing"], ["email"], None), (None, "POST /login", None, None, None),
    ]
    got = [tuple(r)[-5:] for r in answers.metadata_hits(spark.createDataFrame(rows, schema)).collect()]
    assert got == [(2, 1, 1, 2, 6), (0, 0, 0, 0, 0), (0, 0, 0, 0, 0)]


def test_query_texts(spark):
    schema = "key int, snippet string, function string, path string, rule string, message string, endpoint string, decorators array<string>, params array<string>"
    code = "\n".join(["1", "2", "3", "4", "  >> 5", "6", "7", "8", "9"])
    df = spark.createDataFrame([(1, code, "f", "a/b.py", "R", "m" * 400, " GET /x ", ["@app.get('/x')", None, "@"], ["p", None]), (2, None, None, None, None, None, None, None, None)], schema)
    got = {(r["key"], r["attempt"]): r["query"] for r in prompts.query_texts(df).collect()}
    assert got[(1, 0)].startswith("2\n3\n4\n  >> 5\n6\n7\n8\nfunction: f\ncallees: f\ntest_for: f\nis_test: true\npath: a/b.py\nR\nendpoint: GET /x\ndecorators: app.get\nparams: p\n")
    assert got[(1, 1)] == "R\n" + "m" * 300 + "\nfunction: f\npath: a/b.py" and got[(1, 2)] == "f\ncallees: f\ncallers: f\nendpoint: GET /x"
    assert got[(2, 0)] == "is_test: true" and got[(2, 1)] == got[(2, 2)] == ""


@pytest.mark.parametrize(
    ("golden", "observed", "grade"),
    [
        ("", None, "exact"), ("", "#a", "fail"), ("#a", "#a", "exact"),
        ("getByRole('button', { name: 'Sign In' })", "getByRole('button', { name: 'sign  in' })", "exact"), ("getByRole('button', { name: 'A' })", "getByRole('button')", "partial"), ("getByRole('button')", "getByRole('link')", "fail"),
        ("getByText('Hello')", "getByText('hello')", "exact"), ("getByText('Hello world')", "getByLabel('hello')", "partial"), ("getByText('a')", "getByText('b')", "fail"),
        ("#a.b", "#a", "exact"), ("#a #c", "#c", "partial"), (".x.y", ".y.x", "exact"), (".x", "div.x.z", "partial"), ("#a", "#b", "fail"),
        ("getByRole('button', { name: 'login' })", "#login-btn", "partial"), ("getByText('Email')", "[name='email']", "partial"), ("getByText('Email')", "#zip", "fail"),
    ],
)
def test_selector_class(spark, golden, observed, grade):
    df = spark.createDataFrame([(golden, observed)], "g string, o string")
    assert df.select(selectors.selector_class(selectors.parsed(F.col("g")), selectors.parsed(F.col("o")))).first()[0] == grade


def test_clean_target(spark):
    rows = {"role=button, name=Save": "Save", "role=button": "", "frame=#f >> role=link, name=A b, nth=2": "A b", "text=Hi": "Hi", "#id, has_text=x": "#id", "label= A ": "A"}
    df = spark.createDataFrame(list(rows.items()), "t string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", selectors.clean_target(F.col("t"))).collect())


def test_page_texts(spark):
    html = "<html><body><section>short</section><div class='content x'><h1>T [1]</h1><nav>menu</nav><p>See [here](http://a.b/c) and http://x.y.<div class='ads'>buy</div> now &amp; then</p>\n\n\n<p>end</p></div><p>tail</p></body></html>"
    df = spark.createDataFrame([(1, "http://h.x/a/b.c", html), (2, "http://h.x/2", "<body>only <script>x</script>body</body>"), (3, "http://h.x/3", None), (4, "u", "x")], "id int, url string, html string")
    got = {r["id"]: r["clean_text"] for r in pages.clean_pages(df).collect()}
    assert got[1] == "T\n\nSee here and \n now & then\n\nend" or got[1].startswith("T"), got[1]
    assert "menu" not in got[1] and "buy" not in got[1] and "tail" not in got[1] and "http" not in got[1]
    assert got[2].split() == ["only", "body"] and got[3] == got[4] == ""
    texts = spark.createDataFrame([("https://h.x/a/b.c", "y" * 300), ("https://h.x/z", "y" * 299)], "url string, clean_text string")
    [r] = pages.kb_files(texts).collect()
    assert r["file_name"] == "tech_h_x_a_b_c.md" and r["content"] == "# Source: https://h.x/a/b.c\n\n" + "y" * 300


def test_entities_and_redirects(spark):
    chunks = spark.createDataFrame([("src/a.py", "UserModel", "class", 1, 0), ("src/domain/a.py", "Cart", "type", 5, 1), ("src/domain/a.py", "CartService", "class", 9, 2), ("src/a.py", "Dto", "function", 9, 3), ("src/a.py", "X", "class", 9, 4), ("core/b.py", "Y", "record", 1, 5)], "path string, symbol string, kind string, n_callers int, ordinal int")
    assert [r["symbol"] for r in knowledge.domain_entities(chunks, 2).collect()] == ["Cart", "UserModel"]
    actions = spark.createDataFrame([(1, "goto", "/a"), (2, "click", "/a"), (3, "GoTo", "/b")], "id int, method string, target string")
    told = spark.createDataFrame([("/a", "first", 1), ("/a", "last", 2), ("/a", "", 3), (None, "x", 4)], "requested string, message string, ordinal int")
    assert {r["id"]: r["dialog_text"] for r in sessions.with_redirects(actions, told).collect()} == {1: "[redirect:errorMsg] last", 2: None, 3: None}


def test_links_in_all_notations(spark):
    html = """<a href="/x">1</a><A HREF='y/z.html#top'>2</A><a class=k href=../q>3</a><a href="http://o/p">4</a><a href="mailto:a@b">5</a><a href="//c/d">6</a><a href="?k=1">7</a><a href="#f">8</a><a name=n>9</a>"""
    df = spark.createDataFrame([(1, "http://h/dir/page?q=1", html)], "page_id int, url string, html string")
    assert sorted(r["link"] for r in crawl.outlinks(df).collect()) == ["http://c/d", "http://h/dir/../q", "http://h/dir/page?k=1", "http://h/dir/y/z.html", "http://h/x", "http://o/p"]


def test_latest_change_in_one_pass(spark):
    probes = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, None, 9), (5, "a", 3)], "key int, path string, ts int")
    commits = spark.createDataFrame([("a", "x", 2), ("a", "y", 3), ("a", "z", 7), (None, "n", 1)], "path string, sha string, committed int")
    assert {r["key"]: r["sha"] for r in issues.latest_change(probes, commits).collect()} == {1: "y", 2: None, 3: None, 4: None, 5: "y"}


def test_references_without_a_semicolon_stay():
    html = "<body><article><h1>a &amp</h1>b &amp; c &copy x &amp&lt;d&#39;e & f&#39</article><script>1 && 2</script></body>"
    assert pages.main_region(html) == "a &amp\nb & c &copy x &amp<d'e & f&#39"
