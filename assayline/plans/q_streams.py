"""Stream and file queries, each over the whole event log or page table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.sources import files
from assayline.sources.tables import table
from assayline.sources.workdir import work_path
from assayline.streaming import logs


def _events(spark: SparkSession, d: str) -> DataFrame:
    # A glob, as the table may be one file or a folder of files. These are in no order of ts, so a stored table is
    # replayed as one batch, in which no row is late and a crawl's pages are all there, at any number of files.
    return logs.source(spark, f"{d}/events.parque[t]", table(spark, d, "events").schema, files_per_batch=None)


def stream_llm_sla(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("ts", F.col("event_type").alias("kind"), F.col("value").alias("elapsed_ms"), (F.col("value") > 100).alias("timeout"))
    return logs.sla_rollup(logs.run(logs.llm_sla(e), "stream-sla", "complete"))


def stream_late_rows(spark: SparkSession, d: str) -> DataFrame:
    """Events of odd users come after those of even users: how many of each type are then more than a day behind."""
    e = table(spark, d, "events").select("ts", "event_type", "user_id")
    path, folder = work_path(spark, "late-log"), work_path(spark, "stream-late")
    got = None
    for odd in (0, 1):
        e.where(F.col("user_id") % 2 == odd).write.mode("append").parquet(path)
        got = logs.run(logs.late_rows(logs.source(spark, path, e.schema, files_per_batch=None), "event_type"), "late", folder=folder)
    return got.groupBy(F.col("key").alias("kind")).agg(F.sum("n").alias("n"))


def stream_flake(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("ts", F.concat(F.lit("site"), F.col("user_id") % 10).alias("site"), F.col("event_type").alias("scenario"), F.when(F.col("value") < 60, "PASS").otherwise("FAIL").alias("status"))
    return logs.run(logs.flake(e), "stream-flake", "complete")


def stream_dedup_new(spark: SparkSession, d: str) -> DataFrame:
    return logs.run(logs.new_keys(_events(spark, d), "user_id"), "stream-new")


def stream_session_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("ts", "user_id", (F.col("event_type") == "error").alias("failed"))
    return logs.run(logs.sessions(e), "stream-sessions", "complete")


def stream_click_nav(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return logs.run(logs.followed(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'").select("user_id", "ts"), "user_id", 3600), "stream-nav").distinct()


def stream_drift(spark: SparkSession, d: str) -> DataFrame:
    """Crawls whose first streak lies before the watermark, an hour behind the last event."""
    e = _events(spark, d)
    pages = e.select("ts", F.col("user_id").alias("crawl"), F.col("event_id").alias("position"), F.when(F.col("event_type").isin("view", "click"), "home").otherwise(F.col("event_type")).alias("host"), F.lit("home").alias("own_host"))
    return logs.run(logs.drift(pages, 2), "stream-drift")


def stream_issue_router(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    outcome = F.when(F.col("event_type") == "error", "false_positive").when(F.col("value") > 100, "failed").when(F.col("event_id") % 10 == 0, "skipped").otherwise("created")
    return logs.routed(e, "stream-router", lambda x: x.select(F.col("event_id").alias("key"), outcome.alias("outcome")))


def src_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """The event properties as JSON lines, every 10th cut short: rows read and quarantined."""
    path = work_path(spark, "jsonl")
    e = table(spark, d, "events")
    e.select(F.when(F.col("event_id") % 10 == 0, F.left("props", F.lit(4))).otherwise(F.col("props")).alias("value")).write.text(path)
    got = files.read_jsonl(spark, path, "k long")
    return got.select(F.when(F.col("_corrupt").isNull(), "read").otherwise("quarantined").alias("state"), "k").groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


def src_dated_partitions(spark: SparkSession, d: str) -> DataFrame:
    path = work_path(spark, "dated")
    e = table(spark, d, "events").select(F.col("ts").cast("date").alias("date"), "user_id", "event_type")
    e.repartition("date").write.partitionBy("date").json(path)
    got = files.read_dated(spark, path, "user_id long, event_type string", "2024-01-20")
    return got.groupBy(F.col("date").cast("string").alias("date"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def src_csv_golden(spark: SparkSession, d: str) -> DataFrame:
    """Customers through CSV and back, one segment blanked: blank cells are null."""
    path = work_path(spark, "csv")
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_mktsegment") == "BUILDING", "  ").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    c.write.option("header", True).csv(path)
    return files.read_golden_csv(spark, path).groupBy("c_mktsegment").agg(F.count("c_name").alias("n"))


def src_scenario(spark: SparkSession, d: str) -> DataFrame:
    """Turns of each conversation as a scenario document, listed or under steps, and their numbers."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("action")))).alias("t"))
    listed = F.to_json(F.transform("t", lambda x: F.struct(x["action"].alias("action"))))
    doc = F.when(F.col("conv_id") % 2 == 0, listed).otherwise(F.concat(F.lit('{"steps":'), listed, F.lit("}")))
    return c.select("conv_id", F.explode(files.scenario_steps(doc)).alias("s")).select("conv_id", "s.step", "s.action")


def snk_chunks_by_path(spark: SparkSession, d: str) -> DataFrame:
    """Documents written by source and read back: rows and characters of each."""
    path = work_path(spark, "by-path")
    docs = table(spark, d, "documents").select(F.col("source").alias("path"), "doc_id", "text", "n_chars")
    files.write_by_path(docs, path, ("n_chars",))
    got = spark.read.schema("path string, doc_id long, text string").json(path)
    return got.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def snk_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Keys of one run kept, and those of the next that are new."""
    folder = work_path(spark, "snapshots")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderdate")
    path = files.write_snapshot(o.where("o_orderdate < '1995-03-01'"), folder, "1")
    return o.select("key").distinct().join(spark.read.schema("key long").parquet(path), "key", "left_anti")


QUERIES = {f.__name__: f for f in (stream_llm_sla, stream_late_rows, stream_flake, stream_dedup_new, stream_session_rollup, stream_click_nav, stream_drift, stream_issue_router, src_jsonl, src_dated_partitions, src_csv_golden, src_scenario, snk_chunks_by_path, snk_snapshot)}

SQL = {
    "stream_llm_sla": "with r as (select epoch(date_trunc('hour', ts))::bigint as start, event_type as kind, value, row_number() over (partition by date_trunc('hour', ts), event_type order by value) as r, count(*) over (partition by date_trunc('hour', ts), event_type) as n from events)"
    " select start, kind, any_value(n) as calls, count(*) filter (value > 100) as timeouts, round(count(*) filter (value > 100) / any_value(n), 4) as timeout_rate, max(value) as longest, "
    + ", ".join(f"max(value) filter (r = least(greatest(round_even({p} / 100.0 * n, 0)::bigint, 1), n)) as p{p}" for p in (50, 95, 99))
    + " from r group by start, kind",
    "stream_late_rows": "with m as (select epoch_ms(max(ts)) - 86400000 as mark from events where user_id % 2 = 0) select event_type as kind, count(*) as n from events, m where user_id % 2 = 1 and epoch_ms(ts) < mark group by 1",
    "stream_flake": "with w as (select unnest(range(7)) as k, ts, user_id, event_type, value from events) select epoch(date_trunc('day', ts))::bigint - k * 86400 as start, 'site' || (user_id % 10) as site, event_type as scenario, count(*) as total, count(*) filter (value < 60) as passed from w group by all",
    "stream_dedup_new": "select distinct user_id from events",
    "stream_session_rollup": "with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts) as sid from g) select user_id, epoch_us(min(ts)) as start_us, count(*) as n, bool_or(event_type = 'error') as failed from s group by user_id, sid",
    "stream_click_nav": "select event_id, user_id from events c where event_type = 'click' and exists (select 1 from events n where n.event_type = 'purchase' and n.user_id = c.user_id and n.ts between c.ts and c.ts + interval 1 hour)",
    "stream_drift": "with p as (select user_id as crawl, event_id as position, case when event_type in ('view', 'click') then 'home' else event_type end as host from events where epoch_ms(ts) < (select epoch_ms(max(ts)) - 3600000 from events)), q as (select *, lag(host) over (partition by crawl order by position) as before from p)"
    " select crawl, min(position) as position from q where host <> 'home' and host = before group by crawl",
    "stream_issue_router": "select event_id as key, case when event_type = 'error' then 'false_positive' when value > 100 then 'failed' when event_id % 10 = 0 then 'skipped' else 'created' end as outcome from events",
    "src_jsonl": "select case when event_id % 10 = 0 then 'quarantined' else 'read' end as state, count(*) as n, sum(case when event_id % 10 > 0 then json_extract(props, '$.k')::bigint end)::bigint as total from events group by 1",
    "src_dated_partitions": "select ts::date::varchar as date, event_type, count(*) as n from events where ts >= timestamp '2024-01-20' group by all",
    "src_csv_golden": "select nullif(c_mktsegment, 'BUILDING') as c_mktsegment, count(c_name) as n from customer group by 1",
    "src_scenario": "select conv_id, row_number() over (partition by conv_id order by turn)::int as step, role as action from conversations",
    "snk_chunks_by_path": "select source as path, count(*) as n, sum(length(text))::bigint as chars from documents group by 1",
    "snk_snapshot": "select distinct o_custkey as key from orders where o_custkey not in (select o_custkey from orders where o_orderdate < timestamp '1995-03-01')",
}
