"""Conclusions of a report: lights and labels from aggregate rows, as rules with thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lights from worst to best, in the order in which the worst of several is taken.
LIGHTS = ("red", "gray", "yellow", "green")


def stepped(value: Column, green: float, yellow: float) -> Column:
    """green from one threshold on, yellow from another, else red."""
    return F.when(value >= green, "green").when(value >= yellow, "yellow").otherwise("red")


def worst(*lights: Column) -> Column:
    order = F.array(*map(F.lit, LIGHTS))
    return F.element_at(order, F.array_min(F.array(*(F.array_position(order, x) for x in lights))).cast("int"))


def rag_verdicts(rows: DataFrame, least_sample: int = 3) -> DataFrame:
    """rows with n_measured, citation, buckets, quality and overall lights.

    rows: analysed, n_empty, n_retry, citation_pct, callers_pct, tests_pct, retry_pct, empty_pct. Rates of fewer than
    least_sample measured issues are gray.
    """
    measured = F.greatest(F.lit(0), F.col("analysed") - F.col("n_empty") - F.col("n_retry"))
    bad = (F.col("retry_pct") > 20) | (F.col("empty_pct") > 50)
    weak = (F.col("retry_pct") > 5) | (F.col("empty_pct") > 25)
    out = rows.withColumn("n_measured", measured)
    out = out.withColumn("citation", F.when(F.col("n_measured") < least_sample, "gray").otherwise(stepped(F.col("citation_pct"), 60, 30)))
    out = out.withColumn("buckets", stepped((F.col("callers_pct") + F.col("tests_pct")) / 2, 60, 30))
    out = out.withColumn("quality", F.when(bad, "red").when(weak, "yellow").otherwise("green"))
    return out.withColumn("overall", worst(F.col("citation"), F.col("buckets"), F.col("quality")))


#: Points of a knowledge base's score, by the signal that earns them.
KB_POINTS = {"many_chunks": 30, "some_chunks": 10, "few_orphans": 20, "endpoints": 15, "covered": 15, "parsed": 10, "linked": 10}


def kb_verdict(stats: DataFrame) -> DataFrame:
    """stats with score (0 to 100), level and at most three actions.

    stats: chunks, orphan_ratio, endpoints, decorators, coverage_pct, parser_failed, caller_links.
    """
    c = F.col
    signals = {
        "many_chunks": c("chunks") > 50,
        "some_chunks": (c("chunks") > 0) & (c("chunks") <= 50),
        "few_orphans": c("orphan_ratio") < 0.7,
        "endpoints": c("endpoints") > 0,
        "covered": c("coverage_pct") > 30,
        "parsed": c("parser_failed") == 0,
        "linked": c("caller_links") > c("chunks"),
    }
    score = sum((F.when(signals[k], p).otherwise(0) for k, p in KB_POINTS.items()), F.lit(0))
    advice = {
        "add_tests": c("coverage_pct") < 30,
        "define_api_rules": (c("endpoints") > 0) & (c("decorators") == 0),
        "check_caller_index": c("orphan_ratio") > 0.8,
        "check_parser": c("parser_failed") > 5,
    }
    given = F.filter(F.array(*(F.when(when, F.lit(what)) for what, when in advice.items())), lambda x: x.isNotNull())
    actions = F.when(F.size(given) == 0, F.array(F.lit("none_needed"))).otherwise(F.slice(given, 1, 3))
    level = F.when(c("score") >= 80, "high").when(c("score") >= 50, "medium").otherwise("low")
    return stats.withColumn("score", score).withColumn("level", level).withColumn("actions", actions)


def learn_verdicts(rows: DataFrame) -> DataFrame:
    """rows with scope, depth, quality and impact lights.

    rows: files_analyzed, parser_failed, chunks, callees_pct, test_link_pct, endpoints, type_chunks, docstrings,
    parser_pct, n_asymmetric, diagnosed, any_hit_pct.
    """
    c = F.col
    files = c("files_analyzed") + c("parser_failed")
    parsed = F.coalesce(F.try_divide(c("files_analyzed") * 100.0, files), F.lit(0.0))
    none = c("chunks") == 0
    documented = F.coalesce(F.try_divide(c("docstrings") * 100.0, c("chunks")), F.lit(0.0)) >= 30
    healthy = sum((x.cast("int") for x in (c("test_link_pct") >= 20, c("endpoints") > 0, (c("type_chunks") > 0) | documented)), (c("callees_pct") >= 40).cast("int"))
    return (
        rows.withColumn("scope", F.when(none, "red").when(parsed < 70, "yellow").otherwise("green"))
        .withColumn("depth", F.when(none, "gray").otherwise(stepped(healthy, 3, 2)))
        .withColumn("quality", F.when(c("parser_pct") < 50, "red").when(c("n_asymmetric") > 0, "yellow").otherwise("green"))
        .withColumn("impact", F.when(c("diagnosed") == 0, "gray").otherwise(stepped(c("any_hit_pct"), 50, 20)))
    )


def issue_verdict(skipped: Column, exhausted: Column, used: Column, cited: Column, depth: Column, confidence: Column, classification: Column, partial: Column) -> Column:
    """One line on how well an issue's answer is grounded; null where nothing is to be said."""
    false_alarm = F.lower(F.coalesce(classification, F.lit(""))) == "false_positive"
    share = F.concat(cited.cast("string"), F.lit("/"), used.cast("string"))
    deep = F.when(depth > 0, F.concat(F.lit(", "), depth.cast("string"), F.lit(" named"))).otherwise("")
    return (
        F.when(skipped, "warn: template, not analysed")
        .when(exhausted, "warn: no valid answer after all retries")
        .when(used == 0, "warn: no code context was found")
        .when((cited == 0) & (F.lower(F.coalesce(confidence, F.lit(""))) == "high"), F.concat(F.lit("warn: sure but cites "), share, F.when(false_alarm, ", review the false positive").otherwise(", review")))
        .when((cited > 0) & partial, F.concat(F.lit("warn: partly cited "), share, deep))
        .when(cited > 0, F.concat(F.lit("ok: cited "), share, deep))
    )


def trust_signals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """high, medium, low and partial counts per keys; rows: confidence, labels, cited, used.

    An answer is partial by its label or, without one, where less than half of what it was given is cited.
    """
    sure = F.lower(F.coalesce("confidence", F.lit("")))
    labelled = F.exists(F.coalesce("labels", F.array().cast("array<string>")), lambda x: F.lower(x).contains("partial"))
    partial = labelled | F.coalesce((F.col("used") > 0) & (F.col("cited") * 2 < F.col("used")), F.lit(False))
    return rows.groupBy(*keys).agg(*(F.count_if(sure == x).alias(x) for x in ("high", "medium", "low")), F.count_if(partial).alias("partial"))


def overall_verdict(rows: DataFrame) -> DataFrame:
    """rows (created, failed, high, low, partial) with light and level."""
    c = F.col
    doubtful = c("low") + c("partial") > F.floor(c("created") / 2)
    sure = c("high") / F.greatest(c("created"), F.lit(1)) >= 0.7
    light = F.when(c("failed") > 0, "red").when(doubtful, "yellow").when(sure, "green").otherwise("yellow")
    level = F.when(c("failed") > 0, "low").when(~doubtful & sure, "high").otherwise("medium")
    return rows.withColumn("light", light).withColumn("level", level)
