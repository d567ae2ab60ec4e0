"""Queries on criteria, schemas and remaining joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions import text as T
from assayline.operators import codegraph, evals
from assayline.plans.q_web import _LINKS, _TRASH
from assayline.sources.tables import table
from assayline.streaming import logs


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Events as answers: status from the type, the properties as raw text, criteria of six kinds."""
    e = table(spark, d, "events")
    kinds = F.array(*map(F.lit, ("status_code=200", "raw~r/\\d{2}/ AND status_code=200", "json.k~r/^1/", "json.k == '1'", "", "json.none~r/x/")))
    return e.select(F.col("event_id").alias("case_id"), F.element_at(kinds, (F.col("event_id") % 6 + 1).cast("int")).alias("criteria"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.col("props").alias("raw"))


def criteria_dsl(spark: SparkSession, d: str) -> DataFrame:
    return evals.criteria_dsl(_answers(spark, d))


def task_completion(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d)
    both = a.join(evals.criteria_dsl(a), "case_id").join(table(spark, d, "labels").select(F.col("doc_id").alias("case_id"), (F.col("quality") * 0.8).alias("judged")), "case_id", "left")
    score = evals.task_score(F.col("passed"), T.criteria_mode(F.col("criteria")), T.criteria_contains(F.col("criteria"), F.col("raw")), F.col("judged"), F.col("status"))
    return both.select("case_id", score.alias("score"), (score >= 0.5).alias("passed"))


def schema_check(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as answers: an object, plain text, a number for an answer, an object with documents."""
    c, kind = table(spark, d, "conversations"), F.col("turn") % 4
    raw = (
        F.when(kind == 0, F.to_json(F.struct(F.col("text").alias("answer")))).when(kind == 1, F.col("text"))
        .when(kind == 2, F.to_json(F.struct(F.length("text").alias("answer")))).otherwise(F.to_json(F.struct(F.col("text").alias("answer"), F.array("role").alias("docs"))))
    )
    return c.select("conv_id", "turn", raw.alias("raw")).select("conv_id", "turn", evals.valid_answer().alias("valid"))


def callers_index(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as files, their parts as symbols that call the next part; some files import what they call."""
    li = table(spark, d, "lineitem").select(F.concat(F.lit("f"), F.col("l_suppkey")).alias("path"), F.concat(F.lit("part"), F.col("l_partkey")).alias("symbol"), F.array(F.concat(F.lit("part"), F.col("l_partkey") + 1)).alias("callees")).distinct()
    imports = table(spark, d, "lineitem").where("l_suppkey % 2 = 0").select(F.concat(F.lit("f"), F.col("l_suppkey")).alias("path"), F.concat(F.lit("part"), F.col("l_partkey")).alias("name")).groupBy("path").agg(F.collect_set("name").alias("imports"))
    return codegraph.callers_counts(li, imports)


def join_golden_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Each customer with the last of its orders."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"), F.max("o_orderkey").alias("last"))
    return table(spark, d, "customer").join(o, "c_custkey", "left").select("c_custkey", "status", "last")


def crawl_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Link targets that are pages of the table, and whether a cap of 200 pages is reached."""
    from assayline.operators import crawl

    p = table(spark, d, "pages")
    found = crawl.outlinks(p).select(crawl.normalize_url(F.col("link")).alias("u")).distinct()
    known = p.select(crawl.normalize_url(F.col("url")).alias("u")).distinct()
    return known.agg(F.count(F.lit(1)).alias("pages"), (F.count(F.lit(1)) >= 200).alias("cap_reached")).join(found.join(known, "u", "left_semi").agg(F.count(F.lit(1)).alias("linked")), F.lit(True))


def stream_trace_pair(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the views of its user in the ten minutes before, as rows arrive."""
    e = logs.source(spark, f"{d}/events.parque[t]", table(spark, d, "events").schema, files_per_batch=None)  # as in q_streams
    first = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    after = e.where("event_type = 'purchase'").select("user_id", "ts")
    return logs.run(logs.followed(first, after, "user_id", 600), "stream-pair").groupBy("user_id").agg(F.count(F.lit(1)).alias("pairs"))


QUERIES = {f.__name__: f for f in (criteria_dsl, task_completion, schema_check, callers_index, join_golden_analysis, crawl_coverage, stream_trace_pair)}

_DSL = "a as (select event_id as case_id, event_id % 6 as m, case when event_type = 'error' then 500 else 200 end as status, props as raw, json_extract_string(props, '$.k') as k from events), p as (select *, case m when 0 then status = 200 when 1 then regexp_matches(raw, '\\d{2}') and status = 200 when 2 then regexp_matches(k, '^1') when 4 then status = 200 else false end as passed from a)"



def _normal(url: str) -> str:
    """normalize_url() of an address in SQL."""
    scheme, host = f"lower(regexp_extract({url}, '^([A-Za-z]+)://', 1))", f"lower(regexp_extract({url}, '^[A-Za-z]+://([^/?#]*)', 1))"
    path, query = f"regexp_extract({url}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)", f"regexp_extract({url}, '\\?([^#]*)', 1)"
    kept = f"list_sort(list_filter(string_split({query}, '&'), lambda x: x <> '' and lower(string_split(x, '=')[1]) not in ({_TRASH})))"
    bare = f"case when {scheme} = 'http' then regexp_replace({host}, ':80$', '') when {scheme} = 'https' then regexp_replace({host}, ':443$', '') else {host} end"
    return f"{scheme} || '://' || {bare} || case when {path} = '' then '/' else {path} end || case when len({kept}) > 0 then '?' || array_to_string({kept}, '&') else '' end"


SQL = {
    "criteria_dsl": f"with {_DSL} select case_id, passed from p",
    "task_completion": f"with {_DSL}, s as (select case_id, case when m <> 4 then passed::int::double else coalesce(quality * 0.8::double, (status < 400)::int::double) end as score from p left join labels on doc_id = case_id) select case_id, score, score >= 0.5 as passed from s",
    "schema_check": "select conv_id, turn, turn % 4 in (0, 3) and coalesce(text, '') <> '' as valid from conversations",
    "callers_index": "with c as (select distinct 'f' || l_suppkey as path, 'part' || l_partkey as symbol, 'part' || (l_partkey + 1) as callee from lineitem), i as (select distinct 'f' || l_suppkey as path, 'part' || l_partkey as name from lineitem where l_suppkey % 2 = 0),"
    " j as (select c.callee, o.path as cp, c.path || '#' || c.symbol as ref from c join (select distinct path, symbol from c) o on o.symbol = c.callee where (c.path = o.path or exists (select 1 from i where i.path = c.path and i.name = c.callee) or c.path not in (select path from i)) and not (c.path = o.path and c.symbol = o.symbol)) select callee, count(distinct ref) as callers, count(distinct cp) as paths from j group by 1",
    "join_golden_analysis": "select c_custkey, arg_max(o_orderstatus, o_orderkey) as status, max(o_orderkey) as last from customer left join orders on o_custkey = c_custkey group by 1",
    "stream_trace_pair": "select user_id, count(*) as pairs from events v join events p using (user_id) where v.event_type = 'view' and p.event_type = 'purchase' and p.ts between v.ts and v.ts + interval 10 minute group by 1",
    "crawl_coverage": f"with {_LINKS}, f as (select distinct {_normal('link')} as u from links), own as (select distinct {_normal('url')} as u from pages) select (select count(*) from own) as pages, (select count(*) from own) >= 200 as cap_reached, (select count(*) from f where u in (select u from own)) as linked",
}
