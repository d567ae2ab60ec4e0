"""Queries on the event log, seen as a log of calls, test runs and sessions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.operators import runs
from assayline.sources.tables import table


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """kind = event type, elapsed = value, error and timeout from the type and value."""
    return table(spark, d, "events").select(
        F.col("event_type").alias("kind"), F.col("value").alias("elapsed_ms"), (F.col("value") > 100).alias("timeout"), F.when(F.col("event_type") == "error", "failed").alias("error"), (F.col("event_id") % 3).alias("retry_count")
    )


def llm_sla(spark: SparkSession, d: str) -> DataFrame:
    return runs.llm_sla(_calls(spark, d)).select("kind", "total_calls", "timeout_count", "timeout_rate", "error_count", "retry_total", "p50", "p95", "p99")


def nearest_rank_percentile(spark: SparkSession, d: str) -> DataFrame:
    from assayline.functions.stats import nearest_rank

    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(*(nearest_rank("value", p).alias(f"p{p}") for p in (50, 95, 99)))


def rounded_rank_percentile(spark: SparkSession, d: str) -> DataFrame:
    from assayline.functions.stats import rounded_rank

    return rounded_rank(table(spark, d, "events"), ["user_id"], "value", runs.POINTS)


def _tests(spark: SparkSession, d: str) -> DataFrame:
    """site = user mod 10, scenario = event type, passed unless the value is high."""
    return table(spark, d, "events").select(
        F.col("ts").cast("date").alias("date"), F.concat(F.lit("site"), F.col("user_id") % 10).alias("site"), F.col("event_type").alias("scenario"), F.when(F.col("value") < 60, "PASS").otherwise("FAIL").alias("status")
    )


AS_OF = "2024-01-30"


def flake_matrix(spark: SparkSession, d: str) -> DataFrame:
    return runs.flake_matrix(_tests(spark, d), F.lit(AS_OF).cast("date")).withColumn("date", F.col("date").cast("string"))


def flake_flags(spark: SparkSession, d: str) -> DataFrame:
    return runs.flake_flags(runs.flake_matrix(_tests(spark, d), F.lit(AS_OF).cast("date")))


def run_status_rollup(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_discount").alias("disc"))
    steps = li.select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("step"), F.when(F.col("disc") < 0.05, "PASS").when(F.col("disc") < 0.08, "HEALED").otherwise("FAIL").alias("status"))
    return runs.run_status(steps)


def ab_gate(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    half = lambda keep: e.where(keep).groupBy(F.col("user_id").alias("page")).agg((F.count_if(F.col("value") < 60) / F.count(F.lit(1))).alias("accuracy"), F.count_if(F.col("event_type") == "error").alias("healer_calls"), F.sum("value").alias("elapsed_ms"), (F.max("value") > 250).alias("truncated"))
    return runs.ab_gate(half(F.col("event_id") % 2 == 0), half(F.col("event_id") % 2 == 1))


def session_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Sessions end after 30 idle minutes; start, end, events and whether an error occurred."""
    e = table(spark, d, "events")
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"), F.bool_or(F.col("event_type") == "error").alias("failed"))
    return s.select("user_id", F.unix_micros(F.col("w.start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("last_ts").cast("timestamp")).alias("last_us"), "n", "failed")


def click_nav_flag(spark: SparkSession, d: str) -> DataFrame:
    from assayline.operators import sessions

    e = table(spark, d, "events")
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    navs = e.where("event_type = 'purchase'").select("user_id", "ts")
    return sessions.followed_within(clicks, navs, "user_id", 3600).select("event_id", "user_id")


def frame_asof(spark: SparkSession, d: str) -> DataFrame:
    from assayline.operators import sessions

    e = table(spark, d, "events")
    actions = e.where("event_type = 'click'").select("event_id", F.col("user_id").alias("session"), "ts")
    frames = e.where("event_type = 'view'").select(F.col("user_id").alias("session"), "ts", F.col("event_id").alias("frame"))
    return sessions.frame_at(actions, frames).select("event_id", "frame")


def trace_pairing(spark: SparkSession, d: str) -> DataFrame:
    from assayline.operators import sessions

    e = table(spark, d, "events").where("event_type in ('view', 'purchase')")
    events = e.select(F.col("user_id").alias("session"), F.lit("x").alias("call_id"), F.when(F.col("event_type") == "view", "before").otherwise("after").alias("type"), "ts", F.col("event_id").alias("ordinal"))
    return sessions.pair_calls(events).select("session", "before_id", "after_id")


def settled_time(spark: SparkSession, d: str) -> DataFrame:
    from assayline.operators import sessions

    e = table(spark, d, "events")
    acts = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("ordinal"), (F.col("event_type") == "view").alias("is_wait"), F.unix_micros(F.col("ts").cast("timestamp")).alias("end_time"))
    return sessions.settled(acts).select("session", "ordinal", "settled")


def strip_noise_steps(spark: SparkSession, d: str) -> DataFrame:
    from assayline.operators import sessions

    e = table(spark, d, "events")
    steps = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("ordinal"), F.when(F.col("event_type") == "error", "press").when(F.col("event_type") == "click", "fill").otherwise(F.col("event_type")).alias("action"), F.lit("t").alias("target"), F.when(F.col("value") > 20, F.col("event_type")).otherwise("").alias("value"))
    return sessions.strip_noise(steps).select("session", "ordinal", "step")


def drift_streak(spark: SparkSession, d: str) -> DataFrame:
    from assayline.operators import sessions

    e = table(spark, d, "events")
    pages = e.select(F.col("user_id").alias("crawl"), F.col("event_id").alias("position"), F.when(F.col("event_type").isin("view", "click"), "home").otherwise("other").alias("host"), F.lit("home").alias("own_host"))
    return sessions.drift(pages, window=3).select("crawl", "position")


def dedupe_adjacent_clicks(spark: SparkSession, d: str) -> DataFrame:
    from assayline.operators import sessions

    e = table(spark, d, "events")
    steps = e.select(
        F.col("user_id").alias("session"), F.col("event_id").alias("ordinal"), F.lit("p").alias("page"), F.when(F.col("event_type") == "error", "goto").otherwise("click").alias("action"),
        (F.col("value") % 2).cast("int").cast("string").alias("name"), F.col("event_type").alias("target"), (F.col("value") > 100).alias("popup"),
    )
    return sessions.dedupe_clicks(steps).select("session", "ordinal", "step")


def align_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Event sequences of neighbouring users, one as the document, one as the recording."""
    from assayline.operators import alignment

    e = table(spark, d, "events")
    target = F.concat(F.col("event_type"), (F.col("event_id") % 3).cast("string"))
    value = F.col("value").cast("int").cast("string")

    def side(odd: int) -> DataFrame:
        pair = F.floor(F.col("user_id") / 2)
        return e.where(F.col("user_id") % 2 == odd).select(pair.alias("pair"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("action"), target.alias("target"), value.alias("value"))

    return alignment.align(side(0), side(1))


QUERIES = {f.__name__: f for f in (llm_sla, nearest_rank_percentile, rounded_rank_percentile, flake_matrix, flake_flags, run_status_rollup, ab_gate, session_rollup, click_nav_flag, frame_asof, trace_pairing, settled_time, strip_noise_steps, drift_streak, dedupe_adjacent_clicks, align_sequences)}

_RANK = "least(greatest(round_even({p} / 100.0 * n, 0)::bigint, 1), n)"
_TESTS = "t as (select cast(ts as date) as date, 'site' || (user_id % 10) as site, event_type as scenario, case when value < 60 then 'PASS' else 'FAIL' end as status from events)"
_MATRIX = f"{_TESTS}, m as (select site, scenario, date, count(*) as total, count(*) filter (status = 'PASS') as passed from t where date > date '{AS_OF}' - 7 and date <= date '{AS_OF}' group by all)"
_ORDERED = "row_number() over (partition by {k} order by value) as r, count(*) over (partition by {k}) as n"


def _points(name: str) -> str:
    return ", ".join(f"max(value) filter (r = {_RANK.format(p=p)}) as p{p}" for p in (50, 95, 99)) + f" from {name}"


SQL = {
    "llm_sla": "with c as (select unnest([event_type, '(all)']) as kind, value, value > 100 as timeout, event_type = 'error' as failed, event_id % 3 as retries from events),"
    f" r as (select *, {_ORDERED.format(k='kind')} from c) select kind, count(*) as total_calls, count(*) filter (timeout) as timeout_count, round(count(*) filter (timeout) / count(*), 4) as timeout_rate,"
    f" count(*) filter (failed) as error_count, sum(retries)::bigint as retry_total, {_points('r')} group by kind",
    "nearest_rank_percentile": "select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99 from events group by 1",
    "rounded_rank_percentile": f"with r as (select user_id, value, {_ORDERED.format(k='user_id')} from events) select user_id, {_points('r')} group by user_id",
    "flake_matrix": f"with {_MATRIX} select site, scenario, date::varchar as date, total, passed from m",
    "flake_flags": f"with {_MATRIX}, s as (select site, scenario, sum(total)::bigint as total, sum(passed)::bigint as passed from m group by all) select site, scenario, total, passed, round(passed / total, 6) as rate,"
    " case when passed / total >= 0.95 then 'good' when passed / total >= 0.5 then 'fair' else 'poor' end as band, total >= 10 and passed / total < 0.7 as unsupported from s",
    "run_status_rollup": "with li as (select l_orderkey as run_id, l_partkey as step, max(l_discount) as disc from lineitem group by all), s as (select *, disc < 0.08 as ok from li), f as (select run_id, step, row_number() over (partition by run_id order by step) as r from s where not ok),"
    " g as (select run_id, string_agg(step::varchar, ',' order by step) as failed_steps from f where r <= 3 group by 1)"
    " select run_id, count(*) as steps, bool_and(ok) as passed, count(*) filter (ok) as ok_steps, round(100.0::double * count(*) filter (ok) / count(*), 2) as pass_rate, coalesce(any_value(failed_steps), '') as failed_steps from s left join g using (run_id) group by run_id",
    "ab_gate": "with h as (select event_id % 2 as side, user_id as page, count(*) filter (value < 60) / count(*) as accuracy, count(*) filter (event_type = 'error') as healer_calls, sum(value) as elapsed_ms, max(value) > 250 as truncated from events group by all),"
    " s as (select count(*) as pages, count(*) filter (b.accuracy >= 0.75) as accurate_pages, sum(a.healer_calls) as ha, sum(b.healer_calls) as hb, avg(a.elapsed_ms) as ma, avg(b.elapsed_ms) as mb, count(*) filter (b.truncated) as tr from h a join h b on a.page = b.page and a.side = 0 and b.side = 1)"
    " select pages, accurate_pages, round(case when ha > 0 then hb::double / ha end, 6) as healer_ratio, round(mb - ma, 3) as elapsed_delta, accurate_pages / pages >= 0.75 as accuracy_ok, coalesce(case when ha > 0 then hb::double / ha end <= 1.0 / 3, false) as healer_ok, mb - ma <= 10000 as elapsed_ok, tr / pages <= 0.1 as budget_ok from s",
    "session_rollup": "with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts) as sid from g)"
    " select user_id, epoch_us(min(ts)) as start_us, epoch_us(max(ts)) as last_us, count(*) as n, bool_or(event_type = 'error') as failed from s group by user_id, sid",
    "click_nav_flag": "select event_id, user_id from events c where event_type = 'click' and exists (select 1 from events n where n.event_type = 'purchase' and n.user_id = c.user_id and n.ts between c.ts and c.ts + interval 1 hour)",
    "frame_asof": "with f as (select user_id, ts, event_id from events where event_type = 'view'), a as (select event_id, user_id, ts from events where event_type = 'click')"
    " select a.event_id, coalesce((select arg_min(f.event_id, f.ts) from f where f.user_id = a.user_id and f.ts >= a.ts), (select arg_max(f.event_id, f.ts) from f where f.user_id = a.user_id)) as frame from a",
    "trace_pairing": "with e as (select user_id, event_id, ts, event_type from events where event_type in ('view', 'purchase')), p as (select *, max(case when event_type = 'view' then event_id end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as b from e)"
    " select user_id as session, b as before_id, event_id as after_id from p where event_type = 'purchase' and b is not null",
    "settled_time": "with a as (select user_id as session, event_id as ordinal, event_type = 'view' as w, epoch_us(ts) as t from events), i as (select *, sum(case when w then 0 else 1 end) over (partition by session order by ordinal) as g from a),"
    " m as (select session, g, max(t) as settled from i group by all) select i.session, i.ordinal, m.settled from i join m using (session, g) where not i.w",
    "strip_noise_steps": "with s as (select user_id as session, event_id as ordinal, case when event_type = 'error' then 'press' when event_type = 'click' then 'fill' else event_type end as action, case when value > 20 then event_type else '' end as v from events),"
    " k as (select *, lead(action) over w as na, lead(v) over w as nv from s where action <> 'press' window w as (partition by session order by ordinal))"
    " select session, ordinal, row_number() over (partition by session order by ordinal)::int as step from k where not (action = 'fill' and v = '' and coalesce(na, '') = 'fill' and coalesce(nv, '') <> '')",
    "drift_streak": "with p as (select user_id as crawl, event_id as position, case when event_type in ('view', 'click') then 'home' else 'other' end as host from events), w as (select *, count(*) filter (host <> 'home') over l as n, min(host) over l as a, max(host) over l as b from p window l as (partition by crawl order by position rows between 2 preceding and current row))"
    " select crawl, min(position) as position from w where n = 3 and a = b group by crawl",
    "dedupe_adjacent_clicks": "with recursive s as (select user_id as session, event_id as ordinal, case when event_type = 'error' then 'goto' else 'click' end as action, trunc(value % 2)::int as name, event_type as target, value > 100 as popup, row_number() over (partition by user_id order by event_id) as rn from events),"
    " k as (select session, rn, 1 as step, ordinal, action, name, target, popup from s where rn = 1 union all select session, rn, case when same then step else step + 1 end, case when same and stays then o else n.ordinal end, case when same and stays then a else n.action end, case when same and stays then m else n.name end,"
    " case when same and stays then t else n.target end, case when same and stays then u else n.popup end from (select s.session, s.rn, k.step, s.ordinal, s.action, s.name, s.target, s.popup, k.ordinal as o, k.action as a, k.name as m, k.target as t, k.popup as u,"
    " s.action = 'click' and k.action = 'click' and s.name = k.name and s.target <> k.target as same, not (s.popup or not k.popup) as stays from s join k on s.session = k.session and s.rn = k.rn + 1) n)"
    " select session, arg_max(ordinal, rn) as ordinal, step from k group by session, step",
}
