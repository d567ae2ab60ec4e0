"""Selectors of page elements as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How a role, a text and the parts of a CSS selector are written.
ROLE = r"""(?i)getByRole\(\s*['"]([\w-]+)['"]\s*(?:,\s*\{\s*name:\s*['"]([^'"]*)['"]\s*\})?\s*\)"""
BY_TEXT = r"""(?i)getBy(Text|Label|Placeholder|TestId)\(\s*['"]([^'"]*)['"]\s*\)"""
CSS_ID, CSS_CLASS, CSS_VALUE = r"#([\w-]+)", r"\.([\w-]+)", r"""\[[\w-]+\s*=\s*['"]?([^'"\]]*)['"]?\]"""
#: Steps whose selector is not judged.
SKIPPED_ACTIONS = ("wait", "navigate")


def clean_target(target: Column) -> Column:
    """The words of a target: its last segment without modifiers and prefix, a role's name only; '' for a bare role."""
    leaf = F.trim(F.regexp_replace(F.element_at(F.split(target, " >> "), -1), r",\s*(?:nth|has_text)=.*$", ""))
    name = F.regexp_extract(leaf, r"^role=.+?,\s*name=(.+)$", 1)
    plain = F.regexp_replace(leaf, r"^(?:text|label|placeholder|testid|frame|shadow)=", "")
    return F.trim(F.when(name != "", name).when(leaf.startswith("role="), "").otherwise(plain))


def _squeezed(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parsed(selector: Column) -> Column:
    """struct(raw, kind, role, text, ids, classes, words): kind is empty, role, text, label, placeholder, testid or css."""
    none = F.array().cast("array<string>")

    def heads(raw: Column) -> Column:
        role, verb = F.lower(F.regexp_extract(raw, ROLE, 1)), F.lower(F.regexp_extract(raw, BY_TEXT, 1))
        return F.struct(raw.alias("raw"), role.alias("role"), F.when(raw == "", "empty").when(role != "", "role").when(verb != "", verb).otherwise("css").alias("kind"))

    def parts(h: Column) -> Column:
        raw, css = h["raw"], h["kind"] == "css"
        every = lambda pattern: F.when(css, F.array_distinct(F.regexp_extract_all(raw, F.lit(pattern), F.lit(1)))).otherwise(none)
        text = _squeezed(F.when(h["kind"] == "role", F.regexp_extract(raw, ROLE, 2)).when(css, "").otherwise(F.regexp_extract(raw, BY_TEXT, 2)))
        return F.struct(raw.alias("raw"), h["kind"].alias("kind"), h["role"].alias("role"), text.alias("text"), every(CSS_ID).alias("ids"), every(CSS_CLASS).alias("classes"), every(CSS_VALUE).alias("values"))

    def whole(p: Column) -> Column:
        words = F.transform(F.concat(F.array(p["role"], p["text"]), p["ids"], p["classes"], p["values"]), _squeezed)
        return F.struct(*(p[n].alias(n) for n in ("raw", "kind", "role", "text", "ids", "classes")), F.array_distinct(F.filter(words, lambda w: w != "")).alias("words"))

    return _bound(F.trim(F.coalesce(selector, F.lit(""))), lambda raw: _bound(heads(raw), lambda h: _bound(parts(h), whole)))


def _same(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.array_sort(a) == F.array_sort(b))


def _within(a: Column, b: Column) -> Column:
    """Whether one of two texts, neither empty, holds the other."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def selector_class(golden: Column, observed: Column) -> Column:
    """exact, partial or fail: how well two parsed() selectors agree."""
    g, o = golden, observed
    both = lambda kind: (g["kind"] == kind) & (o["kind"] == kind)
    textual = lambda s: s["kind"].isin("text", "label", "placeholder", "testid")
    no_ids = (F.size(g["ids"]) == 0) & (F.size(o["ids"]) == 0)
    shared = F.exists(g["words"], lambda a: F.exists(o["words"], lambda b: _within(a, b)))
    graded = lambda exact, partial: F.when(exact, "exact").when(partial, "partial").otherwise("fail")
    return (
        F.when((g["kind"] == "empty") | (o["kind"] == "empty"), graded(both("empty"), F.lit(False)))
        .when(g["raw"] == o["raw"], "exact")
        .when(both("role"), graded((g["role"] == o["role"]) & (g["text"] == o["text"]), g["role"] == o["role"]))
        .when(textual(g) & textual(o), graded((g["kind"] == o["kind"]) & (g["text"] == o["text"]), _within(g["text"], o["text"])))
        .when(both("css"), graded(_same(g["ids"], o["ids"]) | (no_ids & _same(g["classes"], o["classes"])), F.arrays_overlap(g["ids"], o["ids"]) | F.arrays_overlap(g["classes"], o["classes"])))
        .otherwise(graded(F.lit(False), shared))
    )


def step_class(action: Column, mocked: Column, seen_action: Column, golden: Column, observed: Column) -> Column:
    """selector_class() of a step, skipped where its selector is not judged, fail where the step or its action differs."""
    judged = _bound(F.struct(parsed(golden).alias("g"), parsed(observed).alias("o")), lambda b: selector_class(b["g"], b["o"]))
    return F.when(F.coalesce(mocked, F.lit(False)) | action.isin(*SKIPPED_ACTIONS), "skipped").when(seen_action.isNull() | (seen_action != action), "fail").otherwise(judged)
