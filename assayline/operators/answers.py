"""Answers of language models: from raw text to fields, and how far they use what they were given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of an answer with their defaults.
DEFAULTS = {"title": "", "impact_analysis_markdown": "", "suggested_fix_markdown": "", "classification": "true_positive", "fp_reason": "", "confidence": "medium", "suggested_diff": ""}
#: Methods of a route.
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE")


def json_block(text: Column) -> Column:
    """What stands between the first and last brace, after reasoning and code fences are taken out; null without braces."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""), r"(?is)<think>.*$", "")
    bare = F.regexp_replace(F.regexp_replace(F.trim(plain), r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def repaired(json: Column) -> Column:
    """JSON text with raw line ends and tabs in its strings escaped, and backslashes that escape nothing doubled."""
    parts = F.regexp_extract_all(json, F.lit(r'(?s)"(?:[^"\\]|\\.)*+"?|[^"]++'), F.lit(0))

    def mend(part: Column) -> Column:
        doubled = F.regexp_replace(part, r'\G((?:[^\\]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*+)\\(?!["\\/bfnrt]|u[0-9a-fA-F]{4})', r"$1\\\\")
        for raw, escaped in (("\n", r"\n"), ("\r", r"\r"), ("\t", r"\t")):
            doubled = F.replace(doubled, F.lit(raw), F.lit(escaped))
        return F.when(part.startswith('"'), doubled).otherwise(part)

    return F.array_join(F.transform(parts, mend), "")


def normalize_answers(rows: DataFrame) -> DataFrame:
    """rows (llm_text, has_context) with the fields of DEFAULTS, labels and parse_status.

    parse_status: ok, empty_llm_text, thinking_unterminated, no_json_block, json_decode_error or parsed_but_empty; the
    first that applies. Answers without context are of low confidence and carry the label context:empty.
    """
    text = F.coalesce("llm_text", F.lit(""))
    cut_short = text.rlike("(?i)<think>") & ~text.rlike("(?i)</think>")
    out = rows.withColumn("block", json_block(text))
    direct, mended = F.try_parse_json("block"), F.try_parse_json(repaired(F.col("block")))
    out = out.withColumn("parsed", F.coalesce(direct, mended))
    is_object = F.coalesce(F.schema_of_variant("parsed").startswith("OBJECT"), F.lit(False))
    got = {name: F.coalesce(F.when(F.col("is_object"), F.try_variant_get("parsed", f"$.{name}", "string")), F.lit(default)) for name, default in DEFAULTS.items()}
    out = out.withColumn("is_object", is_object).withColumns(got)
    out = out.withColumn("classification", F.when(F.col("classification") == "", DEFAULTS["classification"]).otherwise(F.col("classification")))
    many = F.when(F.col("is_object"), F.try_variant_get("parsed", "$.labels", "array<string>"))
    one = F.when(F.col("is_object"), F.nullif(F.try_variant_get("parsed", "$.labels", "string"), F.lit("")))
    labels = F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))
    told = F.coalesce("has_context", F.lit(False))
    labels = F.when(told | F.array_contains(labels, "context:empty"), labels).otherwise(F.array_append(labels, F.lit("context:empty")))
    status = (
        F.when(~text.rlike(r"\S"), "empty_llm_text")
        .when(cut_short, "thinking_unterminated")
        .when(F.col("block").isNull(), "no_json_block")
        .when(~F.col("is_object"), "json_decode_error")
        .when(~F.col("impact_analysis_markdown").rlike(r"\S"), "parsed_but_empty")
        .otherwise("ok")
    )
    out = out.withColumn("labels", labels).withColumn("parse_status", status).withColumn("confidence", F.when(told, F.col("confidence")).otherwise("low"))
    return out.drop("block", "parsed", "is_object")


def _route(endpoint: Column) -> tuple[Column, Column]:
    """(method, path) of an endpoint such as 'POST /login'."""
    return F.regexp_extract(F.trim(endpoint), r"^(\S+)", 1), F.regexp_extract(F.trim(endpoint), r"(?s)^\S+\s+(.+)$", 1)


def _name(decorator: Column) -> Column:
    return F.trim(F.regexp_extract(F.ltrim(decorator, F.lit("@")), r"^([^(]*)", 1))


def _found(names: Column, answer: Column, around: str = "") -> Column:
    kept = F.filter(F.array_distinct(names), lambda x: F.length(x) >= 3)
    return F.size(F.filter(kept, lambda x: F.contains(answer, F.concat(F.lit(around), x, F.lit(around)))))


def metadata_hits(rows: DataFrame, decorators: int = 5, params: int = 10) -> DataFrame:
    """rows with endpoint_hits, decorator_hits, param_hits, rag_meta_hits and total_hits: what of it the answer names.

    rows: answer, endpoint, decorators array<string>, params array<string>, used array<struct<endpoint, decorators>>. A
    method counts only beside its path; a parameter in back quotes. Of the retrieved, each new path counts, and the first
    decorator that is named. Names of less than three characters don't count; nulls are empty.
    """
    answer = F.coalesce("answer", F.lit(""))
    method, path = _route(F.coalesce("endpoint", F.lit("")))
    with_path = (path != "") & F.contains(answer, path)
    endpoint = F.when(with_path, 1 + (method.isin(*METHODS) & F.contains(answer, method)).cast("int")).otherwise(0)
    none = F.array().cast("array<string>")
    own = F.transform(F.slice(F.coalesce("decorators", none), 1, decorators), _name)
    named = F.transform(F.slice(F.coalesce("params", none), 1, params), lambda x: F.trim(x))
    used = F.filter(F.col("used"), lambda u: u.isNotNull())
    paths = F.array_distinct(F.filter(F.transform(used, lambda u: _route(F.coalesce(u["endpoint"], F.lit("")))[1]), lambda p: (p != "") & F.contains(answer, p)))

    def first_named(u: Column) -> Column:
        names = F.transform(F.split(F.trim(F.coalesce(u["decorators"], F.lit(""))), r"\s+"), _name)
        return F.get(F.filter(names, lambda x: (F.length(x) >= 3) & F.contains(answer, x)), F.lit(0))

    firsts = F.array_distinct(F.filter(F.transform(used, first_named), lambda x: x.isNotNull()))
    out = rows.withColumn("endpoint_hits", endpoint).withColumn("decorator_hits", _found(own, answer)).withColumn("param_hits", _found(named, answer, "`"))
    out = out.withColumn("rag_meta_hits", F.coalesce(F.when(F.col("used").isNotNull(), F.size(F.array_union(paths, firsts))), F.lit(0)))
    return out.withColumn("total_hits", F.col("endpoint_hits") + F.col("decorator_hits") + F.col("param_hits") + F.col("rag_meta_hits"))
