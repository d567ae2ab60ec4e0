"""Evaluation of AI answers: conversations, checks, roll-ups, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.functions.stats import nearest_rank, ratio

#: Metric, direction and value of the default thresholds.
THRESHOLDS = [("relevancy", ">=", 0.7), ("toxicity", "<=", 0.5), ("faithfulness", ">=", 0.9), ("recall", ">=", 0.8), ("precision", ">=", 0.8), ("task", ">=", 0.5), ("multi_turn", ">=", 0.5)]


def group_conversations(cases: DataFrame) -> DataFrame:
    """cases (case_id, conversation_id, turn, ordinal) → (position, conversation_id, n_turns, case_ids, multi_turn).

    Rows with a conversation id come first, in first-seen order, their turns in order of number (null last); blank ids
    are conversations of one row, after them.
    """
    blank = F.coalesce(F.trim("conversation_id"), F.lit("")) == ""
    keyed = cases.withColumn("single", blank).withColumn("g", F.when(blank, F.concat(F.lit("#"), F.col("ordinal").cast("string"))).otherwise(F.trim("conversation_id")))
    turn = F.struct(F.col("turn").isNull().alias("n"), F.col("turn").alias("t"), F.col("ordinal").alias("o"), F.col("case_id").alias("c"))
    out = keyed.groupBy("g", "single").agg(F.min("ordinal").alias("first"), F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list(turn)).alias("turns"))
    named = out.select(F.when(~F.col("single"), F.col("g")).alias("conversation_id"), "n_turns", F.array_join(F.transform("turns", lambda x: x["c"]), ",").alias("case_ids"), (F.col("n_turns") > 1).alias("multi_turn"), "single", "first")
    return named.select("conversation_id", "n_turns", "case_ids", "multi_turn", F.col("first").alias("first_ordinal"), "single")


def transcript(turns: DataFrame) -> DataFrame:
    """turns (conversation_id, turn, role, text) → (conversation_id, transcript) of conversations of two turns or more."""
    said = F.struct("turn", F.concat(F.initcap("role"), F.lit(": "), F.coalesce("text", F.lit(""))).alias("s"))
    out = turns.groupBy("conversation_id").agg(F.array_sort(F.collect_list(said)).alias("s"))
    return out.where(F.size("s") > 1).select("conversation_id", F.array_join(F.transform("s", lambda x: x["s"]), "\n").alias("transcript"))


def until_first_failure(turns: DataFrame) -> DataFrame:
    """turns (conversation_id, turn, failed, …) up to and with the first failure of each conversation."""
    before = Window.partitionBy("conversation_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("_stop", F.coalesce(F.max(F.col("failed").cast("int")).over(before), F.lit(0))).where("_stop = 0").drop("_stop")


def totals(turns: DataFrame) -> DataFrame:
    """turns (conversation_id, turn, failed, latency_ms, prompt_tokens, completion_tokens) → one row of totals."""
    per = turns.groupBy("conversation_id").agg(F.bool_or("failed").alias("failed"), F.count(F.lit(1)).alias("turns"))
    conversations = per.agg(F.count(F.lit(1)).alias("conversations"), F.count_if(~F.col("failed")).alias("conversations_passed"), F.count_if(F.col("turns") > 1).alias("multi_turn"))
    every = turns.agg(
        F.count(F.lit(1)).alias("turns"), F.count_if(~F.col("failed")).alias("turns_passed"), F.min("latency_ms").alias("latency_min"), F.max("latency_ms").alias("latency_max"),
        *(nearest_rank("latency_ms", p).alias(f"latency_p{p}") for p in (50, 95, 99)), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
    )
    one = conversations.join(every, F.lit(True))
    return one.withColumn("turn_pass_rate", F.round(ratio(F.col("turns_passed"), F.col("turns")), 6)).withColumn("conversation_pass_rate", F.round(ratio(F.col("conversations_passed"), F.col("conversations")), 6))


def thresholds(spark, rows: list[tuple[str, str, float]] = THRESHOLDS) -> DataFrame:
    return spark.createDataFrame(rows, "metric string, op string, threshold double")


def threshold_flags(scores: DataFrame, limits: DataFrame) -> DataFrame:
    """scores (case_id, metric, score) with threshold and passed; metrics without a threshold are left out."""
    joined = scores.join(limits, "metric")
    return joined.withColumn("passed", F.when(F.col("op") == "<=", F.col("score") <= F.col("threshold")).otherwise(F.col("score") >= F.col("threshold"))).drop("op")


def indicator_rollup(flags: DataFrame, most: int = 10) -> DataFrame:
    """flags (case_id, metric, score, threshold, passed) → passed, failed, skipped, mean and the first failed cases."""
    sums = flags.groupBy("metric", "threshold").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count_if(F.col("passed").isNull()).alias("skipped"), F.round(F.avg("score"), 6).alias("mean_score"))
    order = F.row_number().over(Window.partitionBy("metric").orderBy("case_id"))
    first = flags.where(~F.col("passed")).withColumn("r", order).where(F.col("r") <= most).groupBy("metric").agg(F.array_join(F.array_sort(F.collect_list("case_id")), ",").alias("failed_cases"))
    return sums.join(first, "metric", "left").withColumn("failed_cases", F.coalesce("failed_cases", F.lit("")))


def calibration(scores: DataFrame) -> DataFrame:
    """scores (metric, score) → n, mean, sample deviation (0 for one row), min and max a metric, and overall ('(all)')."""
    g = scores.where("score is not null").groupingSets([[F.col("metric")], []], F.col("metric")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("score"), F.lit(0.0)), 6).alias("std"), F.min("score").alias("min"), F.max("score").alias("max"), F.grouping_id().alias("gid")
    )
    return g.withColumn("metric", F.when(F.col("gid") > 0, "(all)").otherwise(F.col("metric"))).drop("gid")


def rescored(samples: DataFrame, margin: float = 0.05) -> DataFrame:
    """samples (case_id, threshold, sample_no, score) → final score: the median of all where the first is borderline."""
    out = samples.groupBy("case_id", "threshold").agg(F.min_by("score", "sample_no").alias("first_score"), F.median("score").alias("median_score"))
    near = F.abs(F.col("first_score") - F.col("threshold")) <= margin
    return out.select("case_id", near.alias("borderline"), F.when(near, F.col("median_score")).otherwise(F.col("first_score")).alias("score"))


def scorecard(golden: DataFrame, analysis: DataFrame) -> DataFrame:
    """golden (key, classification, keywords, paths) × analysis (key, classification, text, cited, ordinal): one row.

    The last analysis of a key counts; means are over the rows they can be worked out for, null without any.
    """
    last = analysis.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ordinal")))).where("r = 1").drop("r")
    both = golden.alias("g").join(last.alias("a"), "key", "left")
    n_words = F.size("g.keywords")
    hits = F.size(F.filter("g.keywords", lambda w: F.contains(F.lower(F.col("a.text")), F.lower(w))))
    found = F.when(F.col("a.text").isNotNull(), hits / F.nullif(n_words, F.lit(0)))
    paths = F.when(F.col("a.cited").isNotNull(), F.size(F.array_intersect("g.paths", "a.cited")) / F.nullif(F.size("g.paths"), F.lit(0)))
    return both.agg(
        F.count(F.lit(1)).alias("golden"), F.count("a.text").alias("matched"), F.round(F.avg((F.col("g.classification") == F.col("a.classification")).cast("double")), 6).alias("accuracy"),
        F.round(F.avg(found), 6).alias("keyword_coverage"), F.round(F.avg(paths), 6).alias("cited_precision"),
    )


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, digest): a digest that neither order nor partitions change, and that repeated rows do."""
    h = F.conv(F.substring(F.md5(F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns))), 1, 14), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h).cast("string").alias("digest"))


def failed_cases(turns: DataFrame, n: int = 10, width: int = 200) -> DataFrame:
    return turns.where("failed").orderBy("ordinal").limit(n).select("ordinal", "case_id", F.substring("message", 1, width).alias("message"))


def first_of(raw: Column, paths: tuple[str, ...] = ("$.answer", "$.response", "$.text", "$.output", "$.message.content", "$.message", "$.choices[0].message.content", "$.choices[0].text")) -> Column:
    """The first non-null of some JSON paths of an answer."""
    return F.coalesce(*(F.get_json_object(raw, p) for p in paths))


def criteria_dsl(rows: DataFrame) -> DataFrame:
    """rows (case_id, criteria, status int, raw) → (case_id, passed): all conditions of ' AND '-joined criteria hold.

    status_code=N, raw~r/pattern/ and json.path~r/pattern/ are known; any other condition fails. Blank criteria ask for
    status 200. Patterns stand in a column, so each row is matched with its own.
    """
    one = rows.select("case_id", "status", "raw", F.coalesce("criteria", F.lit("")).alias("criteria"))
    each = one.select("case_id", "status", "raw", F.col("criteria"), F.explode(F.split("criteria", " AND ")).alias("c")).withColumn("c", F.trim("c"))
    pattern = F.regexp_replace(F.regexp_extract("c", r"~r/([\s\S]*)$", 1), "/$", "")
    each = each.withColumn("p", pattern).withColumn("v", F.expr("get_json_object(raw, concat('$.', regexp_extract(c, '^json[.](.*?)~r/', 1)))"))
    held = (
        F.when(F.col("criteria") == "", F.col("status") == 200)
        .when(F.col("c").startswith("status_code="), F.col("status").cast("string") == F.trim(F.substr(F.col("c"), F.lit(13))))
        .when(F.col("c").startswith("raw~r/"), F.expr("coalesce(raw, '') rlike p"))
        .when(F.col("c").startswith("json.") & F.col("c").contains("~r/"), F.expr("coalesce(v rlike p, false)"))
        .otherwise(False)
    )
    return each.groupBy("case_id").agg(F.bool_and(F.coalesce(held, F.lit(False))).alias("passed"))


def task_score(dsl: Column, mode: Column, contains: Column, judged: Column, status: Column) -> Column:
    """1 or 0 from rules where there are any, else the judge's score, else whether the status is below 400."""
    return F.when(mode == "dsl", dsl.cast("double")).when(contains.isNotNull(), contains.cast("double")).otherwise(F.coalesce(judged, (status < 400).cast("double")))


def valid_answer() -> Column:
    """Of the column raw: an object with a text answer that is not empty and, if there are docs, a list of texts."""
    kind = lambda path: F.expr(f"schema_of_variant(variant_get(try_parse_json(raw), '{path}', 'variant'))")
    answer = F.expr("try_variant_get(try_parse_json(raw), '$.answer', 'string')")
    docs = kind("$.docs")
    return F.coalesce((kind("$.answer") == "STRING") & (F.length(answer) > 0) & (docs.isNull() | docs.isin("ARRAY<STRING>", "ARRAY<VOID>")), F.lit(False))
