"""Further queries: locations, summaries, step comparison, fuzzy matching, issue documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions import text as T
from assayline.operators import fuzzy
from assayline.plans.q_issues import _ISSUES, _issues
from assayline.sources import files
from assayline.sources.tables import table
from assayline.sources.workdir import work_path


def location_text(spark: SparkSession, d: str) -> DataFrame:
    """Links to the line of each issue in the tree of a commit."""
    i = _issues(spark, d)
    return i.select("key", F.concat(F.lit("https://code.example/p/-/blob/main/"), F.regexp_replace("component", "^[^:]*:", ""), F.when(F.col("line") > 0, F.concat(F.lit("#L"), "line")).otherwise("")).alias("link"))


def risk_summary_line(spark: SparkSession, d: str) -> DataFrame:
    """The first paragraph of each document under a heading; lines of every other document are paragraphs."""
    body = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\n\n"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", T.first_paragraph(F.concat(F.lit("**What it is**\n\n \n\n"), body)).alias("line"))


def advisory_timeout(spark: SparkSession, d: str) -> DataFrame:
    """Waits that ran into their time limit count as passed, other errors as failed."""
    e = table(spark, d, "events")
    message = F.when(F.col("value") > 80, F.concat(F.lit("Timeout "), (F.col("event_id") % 9 * 1000).cast("string"), F.lit("ms exceeded"))).when(F.col("event_type") == "error", "boom")
    status = F.when(message.isNull(), "PASS").when((F.col("event_type") == "view") & message.rlike("Timeout .* exceeded"), "PASS").otherwise("FAIL")
    return e.groupBy("event_type", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def golden_vs_observed_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps of even days as golden, of all days as observed; on a repeated step the last one seen counts."""
    e = table(spark, d, "events")
    golden = e.where(F.dayofmonth("ts") % 2 == 0).select(F.col("user_id").alias("page"), (F.col("event_id") % 50).alias("step"), F.col("event_type").alias("action")).distinct()
    golden = golden.groupBy("page", "step").agg(F.min("action").alias("action"))
    seen = e.where(F.dayofmonth("ts") % 2 == 1).groupBy(F.col("user_id").alias("page"), (F.col("event_id") % 50).alias("step")).agg(F.max_by("event_type", "event_id").alias("seen"))
    verdict = F.when(F.col("seen").isNull(), "missing").when(F.col("seen") == F.col("action"), "match").otherwise("differs")
    return golden.join(seen, ["page", "step"], "left").groupBy("page", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def best_fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    """Part names with their first two words swapped as targets among the names on their brand's page, a tenth disabled."""
    p = table(spark, d, "part")
    name = F.concat_ws(" ", "p_name", "p_type")
    words = F.split(name, " ")
    swapped = F.array_join(F.concat(F.array(F.get(words, F.lit(1)), F.get(words, F.lit(0))), F.slice(words, 3, 100)), " ")
    role = F.element_at(F.array(*map(F.lit, ("button", "link", "textbox", "option", "tooltip"))), F.col("p_size") % 5 + 1)
    action = F.element_at(F.array(*map(F.lit, ("click", "fill", "select", "hover"))), F.col("p_size") % 4 + 1)
    elements = p.select(F.col("p_brand").alias("page"), F.col("p_partkey").alias("ordinal"), role.alias("role"), (F.col("p_partkey") % 10 == 0).alias("disabled"), name.alias("text"))
    targets = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("page"), action.alias("action"), swapped.alias("target"))
    return fuzzy.best_fuzzy_match(targets, elements).select("id", F.col("ordinal").alias("other"), F.round("ratio", 6).alias("score"))


def src_json_issues(spark: SparkSession, d: str) -> DataFrame:
    """Issues of each rule and severity as one document, some bare lists, written and read back."""
    path = work_path(spark, "issue-documents")
    i = _issues(spark, d).groupBy("rule", "severity", (F.col("key") % 50).alias("part")).agg(F.to_json(F.collect_list(F.struct("key", "line"))).alias("list"))
    i.select(F.when(F.col("severity") == "INFO", F.col("list")).otherwise(F.concat(F.lit('{"metadata":{"n":1},"issues":'), F.col("list"), F.lit("}"))).alias("value")).repartition("value").write.option("maxRecordsPerFile", 1).text(path)
    got = files.read_issue_document(spark, path, "struct<key:bigint,line:bigint>")
    return got.groupBy((F.col("line") % 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("keys"))


def snk_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers appended twice to a log of JSON lines and read back."""
    path = work_path(spark, "log")
    s = table(spark, d, "supplier")
    for _ in range(2):
        files.write_jsonl(s, path)
    got = files.read_jsonl(spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    return got.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.min("s_name").alias("first_name"))


QUERIES = {f.__name__: f for f in (location_text, risk_summary_line, advisory_timeout, golden_vs_observed_steps, best_fuzzy_match, src_json_issues, snk_jsonl)}

SQL = {
    "location_text": f"with {_ISSUES} select key, 'https://code.example/p/-/blob/main/' || component[6:] || case when line > 0 then '#L' || line else '' end as link from i",
    "risk_summary_line": "with p as (select doc_id, list_transform(string_split(case when doc_id % 2 = 0 then replace(text, chr(10), chr(10) || chr(10)) else text end, chr(10) || chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) as ps from documents) select doc_id, substr(coalesce(list_filter(ps, lambda x: x <> '' and not (starts_with(x, '**') and ends_with(x, '**')))[1], ''), 1, 200) as line from p",
    "advisory_timeout": "select event_type, case when value > 80 then case when event_type = 'view' then 'PASS' else 'FAIL' end when event_type = 'error' then 'FAIL' else 'PASS' end as status, count(*) as n from events group by all",
    "golden_vs_observed_steps": "with g as (select user_id as page, event_id % 50 as step, min(event_type) as action from events where day(ts) % 2 = 0 group by all), s as (select user_id as page, event_id % 50 as step, arg_max(event_type, event_id) as seen from events where day(ts) % 2 = 1 group by all)"
    " select page, case when seen is null then 'missing' when seen = action then 'match' else 'differs' end as verdict, count(*) as n from g left join s using (page, step) group by all",
    "src_json_issues": f"with {_ISSUES} select line % 10 as bucket, count(*) as n, sum(key)::bigint as keys from i group by 1",
    "snk_jsonl": "select s_nationkey, 2 * count(*) as n, min(s_name) as first_name from supplier group by 1",
}
