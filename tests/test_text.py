"""Predicates on text, on hand-made rows."""

from pyspark.sql import functions as F

from assayline.functions import text as T


def values(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr.alias("x")).collect()]


def test_policy_rules_in_order(spark):
    rows = [("id 900101-1234567 and a@b.co",), ("call 010-1234-5678",), ("mail x.y@site.org",), ("card 4111111111111111",), ("api_key = abcdefghij0123456789",), ("nothing here",), (None,)]
    got = values(spark, rows, "t string", T.first_policy_hit(F.col("t"))["reason"])
    want = [n for n, _ in T.POLICY_RULES]
    assert got == [want[0], want[1], want[2], want[3], want[4], None, None]


def test_policy_of_json_looks_at_values_only(spark):
    mail = ("Email address exposure", "a@b.co")
    deep = '{"x":' * 40 + '["a@b.co"]' + "}" * 40
    cases = [
        ('{"a@b.co":"fine"}', None), ('{"x":{"y":[1,{"z":"to a@b.co"}]}}', mail), ('["fine", "a@b.co"]', mail), ('"a@b.co"', mail), (deep, mail),
        ('{"prompt_tokens": 4111111111111111}', ("Credit card number exposure", "4111111111111111")), ("4111111111111111", ("Credit card number exposure", "4111111111111111")),
        ('{"a@b.co":"fine"', mail), ('{"api_key": "abcdefghij0123456789"}', None), ('{"t": "api_key=\\"abcdefghij0123456789\\""}', ("Secret-like token exposure", 'api_key="abcdefghij0123456789"')),
        ('{"m": "a\\u0040b.co"}', mail), ("null", None), ("{}", None), ("", None), (None, None), ('{"x":"' + "y " * 100_000 + 'a@b.co"}', mail),
        ('{"first":"a@b.co","then":"900101-1234567"}', ("Resident registration number exposure", "900101-1234567")),
    ]
    got = values(spark, [(t,) for t, _ in cases], "t string", T.first_policy_hit(F.col("t")))
    assert [None if g is None else tuple(g) for g in got] == [w for _, w in cases]


def test_truthy_and_outcome(spark):
    assert values(spark, [(" Yes",), ("0",), (None,), ("CALIB",)], "t string", T.truthy(F.col("t"))) == [True, False, False, True]
    assert values(spark, [("Fail",), ("negative",), ("ok",), (None,)], "t string", T.outcome(F.col("t"))) == ["fail", "fail", "pass", "pass"]


def test_criteria(spark):
    assert values(spark, [("status_code=200",), ("json.answer == 'ok'",), ("be polite",), ("",), (None,)], "t string", T.criteria_mode(F.col("t"))) == ["dsl", "dsl", "geval", "none", "none"]
    rows = [("Response must include 'Seoul City'", "the SEOUL\ncity"), ("response must include x", "y"), ("be nice", "x"), (None, "x")]
    assert values(spark, rows, "c string, a string", T.criteria_contains(F.col("c"), F.col("a"))) == [True, False, None, None]


def test_severity_and_verdict(spark):
    assert values(spark, [("blocker",), ("INFO",), ("odd",), (None,)], "s string", T.severity_rank(F.col("s"))) == [0, 4, 9, 9]
    rows = [("BLOCKER", "true_positive", "high", 1, 2), ("BLOCKER", "true_positive", "low", 0, 2), ("MAJOR", "", "high", 0, 0), ("MINOR", None, "low", 1, 1), ("INFO", "false_positive", "high", 0, 0), (None, "", "high", 1, 1), ("MAJOR", "wont_fix", "high", 1, 1)]
    verdict = T.action_verdict(*(F.col(c) for c in "scnij"))
    assert values(spark, rows, "s string, c string, n string, i int, j int", verdict) == ["fix_now", "fix_now_weak_basis", "review_weak_basis", "later", "false_positive_sure", "triage", "ignore"]


def test_trivial_and_tests(spark):
    assert values(spark, [("x = 1",), ("a long enough line of code\nand one more",), ("one long enough line of code only",)], "t string", T.is_trivial(F.col("t"))) == [True, False, True]
    assert values(spark, [("src/tests/a.py",), ("src/test_a.py",), ("src/a.spec.ts",), ("src/latest.py",)], "t string", T.is_test_location(F.col("t"))) == [True, True, True, False]


def test_head_tail_keeps_both_ends(spark):
    got = values(spark, [("a" * 50 + "z" * 50,), ("short",), (None,)], "t string", T.head_tail(F.col("t"), 40))
    assert len(got[0]) == 40 and got[0].startswith("aaa") and got[0].endswith("zzz") and got[1] == "short" and got[2] is None


def test_first_paragraph(spark):
    rows = [("**Core**\n\n  one\ttwo  \nthree \n\nfour",), ("a **b**",), ("** x",), ("**only**\n\n \n\n**heads**",), ("",), (None,), ("y" * 300,), ("\n\n\n\nz",)]
    assert values(spark, rows, "t string", T.first_paragraph(F.col("t"))) == ["one two three", "a **b**", "** x", "", "", "", "y" * 200, "z"]


def test_policy_of_text_that_begins_with_a_json_value(spark):
    mail, card = ("Email address exposure", "a@b.co"), ("Credit card number exposure", "4708096362725454")
    cases = [
        ("8294846167456848 Inly onhe. 4708096362725454 of", card), ("4763047826333361 Of thnd a@b.co anwhed", mail), ("4708096362725454 Anth +1 (984) 555-5227", card), ('{"x": 1} a@b.co', mail), ('{"a@b.co": 1}, 2', mail),
        ('{"a@b.co": 1}, 1], 2', mail), ('{"a@b.co": 1}]', mail), ('{"a@b.co": 1}, 1', mail), (' {"a@b.co": 1}\n', None), ('[{"a@b.co": [1, 2]}]', None), ("true a@b.co", mail), ("", None),
    ]
    got = values(spark, [(t,) for t, _ in cases], "t string", T.first_policy_hit(F.col("t")))
    assert [None if g is None else tuple(g) for g in got] == [w for _, w in cases]
