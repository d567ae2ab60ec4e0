"""Texts that go into searches and prompts, put together from an issue's columns; empty parts leave no line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _line(label: str, value: Column) -> Column:
    """'label: value', null where value is null or blank."""
    return F.when(F.trim(value) != "", F.concat(F.lit(f"{label}: "), value))


def _bullets(items: Column, most: int) -> Column:
    return F.nullif(F.array_join(F.transform(F.slice(items, 1, most), lambda x: F.concat(F.lit("  - "), x)), "\n"), F.lit(""))


def _section(title: str, *parts: Column) -> Column:
    """Parts below a title, '' where all are null."""
    body = F.concat_ws("\n", *parts)
    return F.when(body == "", "").otherwise(F.concat(F.lit(f"## {title}\n"), body))


def code_window(snippet: Column, before: int = 3, after: int = 3) -> Column:
    """The lines around the one that a '>>' marks, the first lines where none is marked."""
    lines = F.split(snippet, r"\r\n|\n|\r")
    marked = F.filter(F.transform(lines, lambda x, i: F.when(F.ltrim(x).startswith(">>"), i)), lambda i: i.isNotNull())
    at = F.coalesce(F.get(marked, F.lit(0)), F.lit(0))
    start = F.greatest(at - before, F.lit(0))
    return F.array_join(F.slice(lines, start + 1, at + after + 1 - start), "\n")


def query_texts(issues: DataFrame) -> DataFrame:
    """issues with attempt (0 to 2) and query: three shapes of one search, by structure, in words and by name.

    issues: snippet, function, path, rule, message, endpoint, decorators array<string>, params array<string>.
    """
    function, rule = F.nullif(F.trim("function"), F.lit("")), F.nullif(F.trim("rule"), F.lit(""))
    none = F.array().cast("array<string>")
    names = F.filter(F.transform(F.slice(F.coalesce("decorators", none), 1, 5), lambda x: F.trim(F.regexp_extract(F.ltrim(x, F.lit("@")), r"^([^(]*)", 1))), lambda x: x != "")
    params = F.filter(F.transform(F.slice(F.coalesce("params", none), 1, 8), lambda x: F.trim(x)), lambda x: x != "")
    path, endpoint = _line("path", F.col("path")), _line("endpoint", F.trim("endpoint"))
    full = (
        F.nullif(code_window(F.coalesce("snippet", F.lit(""))), F.lit("")), _line("function", function), _line("callees", function), _line("test_for", function), F.lit("is_test: true"), path, rule, endpoint,
        _line("decorators", F.array_join(names, " ")), _line("params", F.array_join(params, " ")), F.when(function.isNotNull(), F.concat(F.lit("callers, routes, handlers and tests of "), function)),
    )
    words = (rule, F.nullif(F.substring("message", 1, 300), F.lit("")), _line("function", function), path)
    by_name = (F.coalesce(function, rule), _line("callees", function), _line("callers", function), endpoint)
    shapes = [F.struct(F.lit(i).alias("attempt"), F.concat_ws("\n", *parts).alias("query")) for i, parts in enumerate((full, words, by_name))]
    return issues.withColumn("shape", F.explode(F.array(*shapes))).select(*issues.columns, "shape.attempt", "shape.query")


def prompt_context(issues: DataFrame) -> DataFrame:
    """issues with dependency_tree, git_history, similar_places, overview_text and static_facts: '' where there is nothing.

    issues: direct_callers, depth2_callers, past_fixes array<string>, git_context, similar array<struct<path, line>>,
    overview, endpoint, decorators, params, callees array<string>, doc.
    """
    direct, second = _bullets(F.col("direct_callers"), 8), _bullets(F.col("depth2_callers"), 5)
    under = lambda title, body: F.when(body.isNotNull(), F.concat(F.lit(f"{title}:\n"), body))
    places = F.transform(F.slice("similar", 1, 5), lambda x: F.concat(F.coalesce(x["path"], F.lit("?")), F.lit(":"), F.coalesce(x["line"].cast("string"), F.lit("?"))))
    joined = lambda name, most: F.nullif(F.array_join(F.slice(name, 1, most), ", "), F.lit(""))
    facts = (_line("- decorators", joined("decorators", 5)), _line("- HTTP route", F.trim("endpoint")), _line("- parameters", joined("params", 10)), _line("- internal callees", joined("callees", 8)), _line("- leading doc", F.trim("doc")))
    return issues.withColumns({
        "dependency_tree": _section("Dependency graph (depth 2)", under("callers", direct), under("their callers", second)),
        "git_history": _section("Git history", F.nullif(F.trim("git_context"), F.lit("")), under("earlier fixes of the rule", _bullets(F.col("past_fixes"), 3))),
        "similar_places": F.when(F.coalesce(F.size("similar"), F.lit(0)) > 0, F.concat(F.lit("## Same rule elsewhere ("), F.size("similar").cast("string"), F.lit(")\n"), _bullets(places, 5))).otherwise(""),
        "overview_text": _section("Project overview", F.nullif(F.trim("overview"), F.lit(""))),
        "static_facts": F.concat_ws("\n", *facts),
    })
