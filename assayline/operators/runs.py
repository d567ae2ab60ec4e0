"""Roll-ups of call logs, test runs and A/B runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.functions.stats import ratio, rounded_rank

POINTS = {"p50": 50.0, "p95": 95.0, "p99": 99.0}


def llm_sla(calls: DataFrame) -> DataFrame:
    """calls (kind, elapsed_ms, timeout, error, retry_count) → one row a kind and one for all (kind '(all)').

    Null kinds are 'unknown', null times count as 0. Percentiles are of rounded rank.
    """
    rows = calls.select(
        F.coalesce("kind", F.lit("unknown")).alias("kind"), F.coalesce("elapsed_ms", F.lit(0.0)).alias("ms"), F.coalesce("timeout", F.lit(False)).alias("timeout"),
        (F.coalesce("error", F.lit("")) != "").alias("failed"), F.coalesce("retry_count", F.lit(0)).alias("retries"),
    )
    both = rows.withColumn("kind", F.explode(F.array("kind", F.lit("(all)"))))
    sums = both.groupBy("kind").agg(
        F.count(F.lit(1)).alias("total_calls"), F.count_if("timeout").alias("timeout_count"), F.count_if("failed").alias("error_count"), F.sum("retries").alias("retry_total")
    )
    sums = sums.withColumn("timeout_rate", F.round(ratio(F.col("timeout_count"), F.col("total_calls")), 4))
    return sums.join(rounded_rank(both, ["kind"], "ms", POINTS), "kind")


def flake_matrix(runs: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """runs (date, site, scenario, status) → (site, scenario, date, total, passed) of the last days up to as_of."""
    recent = runs.where((F.col("date") > F.date_sub(as_of, days)) & (F.col("date") <= as_of))
    named = recent.select("date", F.coalesce("site", F.lit("?")).alias("site"), F.coalesce("scenario", F.lit("?")).alias("scenario"), F.coalesce("status", F.lit("ERROR")).alias("status"))
    return named.groupBy("site", "scenario", "date").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "PASS").alias("passed"))


def flake_flags(matrix: DataFrame, least_runs: int = 10, unsupported: float = 0.70) -> DataFrame:
    """(site, scenario, total, passed, rate, band, unsupported): too flaky with enough runs below the rate."""
    sums = matrix.groupBy("site", "scenario").agg(F.sum("total").alias("total"), F.sum("passed").alias("passed"))
    rate = ratio(F.col("passed"), F.col("total"))
    band = F.when(rate >= 0.95, "good").when(rate >= 0.50, "fair").otherwise("poor")
    return sums.select("site", "scenario", "total", "passed", F.round(rate, 6).alias("rate"), band.alias("band"), ((F.col("total") >= least_runs) & (rate < unsupported)).alias("unsupported"))


def run_status(steps: DataFrame, failures: int = 3) -> DataFrame:
    """steps (run_id, step, status) → (run_id, steps, passed, ok_steps, pass_rate, failed_steps): a run passes if all steps do."""
    ok = F.coalesce(F.col("status").isin("PASS", "HEALED"), F.lit(False))
    per = steps.groupBy("run_id").agg(F.count(F.lit(1)).alias("steps"), F.bool_and(ok).alias("passed"), F.count_if(ok).alias("ok_steps"))
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy("step"))
    first = steps.where(~ok).withColumn("r", rank).where(F.col("r") <= failures).groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list("step")), ",").alias("failed_steps"))
    return per.join(first, "run_id", "left").select("run_id", "steps", "passed", "ok_steps", F.round(100.0 * F.col("ok_steps") / F.col("steps"), 2).alias("pass_rate"), F.coalesce("failed_steps", F.lit("")).alias("failed_steps"))


def ab_gate(a: DataFrame, b: DataFrame, accuracy: float = 0.75, healer_ratio: float = 1 / 3, slower_ms: float = 10_000.0, over_budget: float = 0.1) -> DataFrame:
    """a, b (page, accuracy, healer_calls, elapsed_ms, truncated) → one row with the four checks on pages in both runs.

    The healer ratio is null, and its check false, where run A has no healer call.
    """
    both = a.alias("a").join(b.alias("b"), "page")
    s = both.agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("b.accuracy") >= accuracy).alias("accurate_pages"), F.sum("a.healer_calls").alias("healer_a"), F.sum("b.healer_calls").alias("healer_b"),
        F.avg("a.elapsed_ms").alias("ms_a"), F.avg("b.elapsed_ms").alias("ms_b"), F.count_if("b.truncated").alias("truncated"),
    )
    quotient = F.when(F.col("healer_a") > 0, F.col("healer_b") / F.col("healer_a"))
    return s.select(
        "pages", "accurate_pages", F.round(quotient, 6).alias("healer_ratio"), F.round(F.col("ms_b") - F.col("ms_a"), 3).alias("elapsed_delta"),
        (ratio(F.col("accurate_pages"), F.col("pages")) >= accuracy).alias("accuracy_ok"), F.coalesce(quotient <= healer_ratio, F.lit(False)).alias("healer_ok"),
        (F.col("ms_b") - F.col("ms_a") <= slower_ms).alias("elapsed_ok"), (ratio(F.col("truncated"), F.col("pages")) <= over_budget).alias("budget_ok"),
    )
