"""Queries on the knowledge base operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayline.functions import text as T
from assayline.operators import knowledge as K
from assayline.plans.q_issues import _ANALYSIS, _CALLS, _ISSUES, _analysis, _calls, _issues
from assayline.sources.tables import table


def filter_source_files(spark: SparkSession, d: str) -> DataFrame:
    """Page paths made into file names of four kinds; how many are left out and why."""
    p = table(spark, d, "pages").select(F.concat(F.when(F.col("page_id") % 5 == 0, "src/node_modules/").otherwise("src/"), F.col("page_id"), F.when(F.col("page_id") % 3 == 0, ".min.js").when(F.col("page_id") % 3 == 1, ".py").otherwise(".txt")).alias("path"))
    return p.groupBy(F.coalesce(K.skip_reason(F.col("path")), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def test_target_candidates(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("test_"), F.translate("p_name", " ", "_"))).otherwise(F.concat(F.lit("test"), F.translate(F.initcap("p_name"), " ", ""))).alias("symbol"))
    return p.select("p_partkey", F.array_join(K.test_targets(F.col("symbol")), ",").alias("candidates"))


def norm_truthy(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    flag = F.element_at(F.array(*map(F.lit, (" TRUE", "no", "1", "calib", "", "off", "Y"))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return o.groupBy(T.truthy(flag).alias("flag"), T.outcome(F.col("o_orderstatus")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def norm_blank(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(T.blank_to_null(F.col("text")).alias("t"))
    return docs.agg(F.count(F.lit(1)).alias("n"), F.count("t").alias("filled"))


def normalize_usage(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    usage = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("promptTokens"), k, F.lit("completionTokens"), k % 7)).when(F.col("event_id") % 3 == 1, F.create_map(F.lit("prompt_tokens"), k, F.lit("total_tokens"), k * 2)).otherwise(F.create_map(F.lit("total_tokens"), k % 2))
    u = e.select(K.normalized_usage(usage).alias("u"))
    return u.agg(F.count(F.lit(1)).alias("n"), F.count("u").alias("known"), F.sum("u.prompt").alias("prompt"), F.sum("u.completion").alias("completion"), F.sum("u.total").alias("total"))


def compact_first_line(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", K.first_line(F.col("text")).alias("line"))


def relative_path(spark: SparkSession, d: str) -> DataFrame:
    return _issues(spark, d).groupBy(F.regexp_replace("component", "^[^:]*:", "").alias("path")).agg(F.count(F.lit(1)).alias("n"))


def classify_step_kind(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    target = F.when(F.col("event_id") % 4 == 0, "frame=x >> role=alert, nth=1").when(F.col("event_id") % 4 == 1, "role=button, name=Next slide").when(F.col("event_id") % 4 == 2, "text=Previous  slide, exact=true").otherwise("text=Pay")
    return e.groupBy("event_type", K.step_kind(F.col("event_type"), target).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def render_kb_document(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("source").alias("path"), F.col("doc_id").cast("string").alias("symbol"), F.lit("doc").alias("kind"), "lang", F.col("text").alias("code"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("callers"))
    return K.render_document(docs).select("title", F.md5("body").alias("body_md5"))


def parse_footer(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("source").alias("path"), F.col("doc_id").cast("string").alias("symbol"), F.lit("doc").alias("kind"), "lang", F.col("text").alias("code"), F.array().cast("array<string>").alias("callers"))
    m = K.render_document(docs).select(K.parse_footer(F.col("body")).alias("m"))
    return m.groupBy(F.col("m")["path"].alias("path"), F.col("m")["lang"].alias("lang")).agg(F.count(F.lit(1)).alias("n"))


def chunk_header(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("symbol"), F.col("lang").alias("role"), F.col("text").alias("code"))
    s = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").select(F.col("source").alias("path"), F.col("doc_id").alias("symbol"), F.concat(F.lit("q"), "quality").alias("summary"))
    return K.with_header(docs, s).select("symbol", F.md5("code").alias("code_md5"))


def output_defaults(spark: SparkSession, d: str) -> DataFrame:
    a = _analysis(spark, d)
    return a.groupBy(F.coalesce(F.nullif(F.when(F.col("classification") != "wont_fix", F.col("classification")), F.lit("")), F.lit("true_positive")).alias("classification")).agg(F.count(F.lit(1)).alias("n"))


def merge_labels(spark: SparkSession, d: str) -> DataFrame:
    a = _analysis(spark, d)
    labels = K.merged_labels(F.array(F.lit("bug"), F.concat(F.lit("severity:"), "severity"), F.lit("bug")), F.col("severity"), F.col("classification"), F.col("confidence"), F.col("callers") > 9)
    return a.groupBy(labels.alias("labels")).agg(F.count(F.lit(1)).alias("n"))


#: Stand-ins for dependency categories over the words of part names.
_CATEGORIES = [(1, "framework", "ring"), (2, "db", "bolt"), (3, "auth", "red"), (4, "test", "small"), (5, "util", "widget")]


def classify_dependency(spark: SparkSession, d: str) -> DataFrame:
    deps = table(spark, d, "part").select(F.col("p_name").alias("name"))
    return K.dependency_category(deps, spark.createDataFrame(_CATEGORIES, "priority int, category string, pattern string"))


def dependency_counts(spark: SparkSession, d: str) -> DataFrame:
    return classify_dependency(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def test_links_exact(spark: SparkSession, d: str) -> DataFrame:
    """Tests named after parts, joined to parts of that name."""
    p = table(spark, d, "part")
    tests = p.select(F.col("p_partkey").alias("test_id"), F.explode(K.test_targets(F.concat(F.lit("test_"), F.translate("p_name", " ", "_")))).alias("symbol"))
    names = p.select(F.translate("p_name", " ", "_").alias("symbol"), F.col("p_partkey").alias("id"))
    found = tests.groupBy("symbol").agg(F.countDistinct("test_id").alias("tests"))
    return found.join(names.groupBy("symbol").agg(F.countDistinct("id").alias("symbols")), "symbol")


def route_to_handler(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    pairs = li.select(F.col("l_suppkey").alias("handler"), F.concat(F.lit("/p"), "l_partkey").alias("endpoint"), F.struct("l_orderkey", "l_partkey").alias("ordinal"))
    chunks = table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), F.when(F.col("s_suppkey") % 4 == 0, "/own").otherwise("").alias("endpoint"))
    return K.routes_to_handlers(chunks, pairs).select("symbol", "endpoint")


def rule_fix_history(spark: SparkSession, d: str) -> DataFrame:
    """Second words of part names, their inner parts and two words with the blank between as rules; parts as commits."""
    p = table(spark, d, "part")
    words = F.split("p_name", " ")
    keys = F.array(F.get(words, F.lit(1)), F.substring(F.get(words, F.lit(1)), 2, 4), F.array_join(F.slice(words, 1, 2), " "))
    rules = p.select(F.explode(F.transform(keys, lambda k: F.concat(F.lit("lint:"), k))).alias("rule")).distinct()
    return K.rule_history(rules, p.select(F.col("p_partkey").alias("sha"), F.col("p_name").alias("subject"), F.col("p_size").alias("committed")))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("issue"), (F.col("l_orderkey") % 5).alias("issue_path"), (F.col("l_orderkey") % 3 * 10).cast("int").alias("issue_line"), F.when(F.col("l_orderkey") % 2 == 0, "f").alias("issue_symbol"),
        (F.col("l_partkey") % 5).alias("path"), F.lit(5).alias("start_line"), F.lit(15).alias("end_line"), F.when(F.col("l_suppkey") % 2 == 0, "f").otherwise("g").alias("symbol"),
        (F.col("l_returnflag") == "R").alias("is_test"), (F.col("l_linestatus") == "O").alias("is_caller"), (F.col("l_extendedprice") * 1000 + F.col("l_partkey") % 1000).cast("long").alias("score"),
    )


def self_exclude_hits(spark: SparkSession, d: str) -> DataFrame:
    return K.self_excluded(_hits(spark, d)).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def context_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = K.buckets(K.self_excluded(_hits(spark, d)).select("issue", "is_test", "is_caller", "score", "path").distinct())
    return kept.groupBy("issue", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))


def context_stats(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d).select("issue", "issue_path", "issue_line", "issue_symbol", "path", "start_line", "end_line", "symbol", "is_test", "is_caller", "score").distinct()
    left = K.self_excluded(hits)
    used = K.buckets(left.select("issue", "is_test", "is_caller", "score", "path").distinct())
    return hits.agg(F.count(F.lit(1)).alias("retrieved")).join(left.agg(F.count(F.lit(1)).alias("kept")), F.lit(True)).join(used.agg(F.count(F.lit(1)).alias("used"), F.count_if(F.col("bucket") == "tests").alias("tests"), F.count_if(F.col("bucket") == "callers").alias("callers")), F.lit(True))


def partial_downgrade(spark: SparkSession, d: str) -> DataFrame:
    a = _analysis(spark, d)
    return a.groupBy("confidence", K.downgraded(F.col("confidence"), F.col("cited"), F.col("total_used")).alias("after")).agg(F.count(F.lit(1)).alias("n"))


def cited_path_precision(spark: SparkSession, d: str) -> DataFrame:
    """Expected parts of each order (its returned ones) that its open items cite."""
    li = table(spark, d, "lineitem")
    g = li.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_partkey") % 7)).alias("want"), F.collect_set(F.when(F.col("l_linestatus") == "O", F.col("l_partkey") % 7)).alias("got"))
    return g.select("l_orderkey", F.round(F.size(F.array_intersect("want", "got")) / F.nullif(F.size("want"), F.lit(0)), 6).alias("precision"))


def paired_runs(spark: SparkSession, d: str) -> DataFrame:
    """Each user's days, each beside the day before."""
    e = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    before = e.select("user_id", F.date_add("day", 1).alias("day"), F.col("v").alias("v0"))
    return e.join(before, ["user_id", "day"]).select("user_id", F.col("day").cast("string").alias("day"), F.round(F.col("v") - F.col("v0"), 4).alias("delta"))


def outcome_join(spark: SparkSession, d: str) -> DataFrame:
    i = _issues(spark, d)
    out = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.max("l_returnflag").alias("outcome"))
    return i.join(out, "key", "left").groupBy("severity", F.coalesce("outcome", F.lit("none")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    called = _calls(spark, d).groupBy("callee").agg(F.countDistinct("caller").cast("int").alias("callers"))
    p = table(spark, d, "part").join(called, F.col("p_partkey") == F.col("callee"), "left")
    return p.select(F.col("p_brand").alias("lang"), F.col("p_type").alias("kind"), F.when(F.col("p_brand") != "Brand#1", F.coalesce("callers", F.lit(0))).otherwise(0).alias("callers"), (F.col("p_size") % 3).alias("tests"), F.when(F.col("p_size") > 20, F.col("p_name")).alias("doc"))


def kb_intelligence(spark: SparkSession, d: str) -> DataFrame:
    return K.intelligence(_chunks(spark, d))


def lang_asymmetry(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("chunks"), F.sum("callers").alias("links")).where("chunks >= 5 and links = 0").select("lang", "chunks")


def callee_top(spark: SparkSession, d: str) -> DataFrame:
    return _calls(spark, d).groupBy("callee").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "callee").limit(10)


def failure_buckets(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.bool_or(F.length("text") % 5 == 0).alias("failed"))
    return c.groupBy((F.col("turns") > 1).alias("multi")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((~F.col("failed")).cast("double")), 6).alias("pass_rate"))


def kb_status_counts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "indexing").alias("status"))
    return o.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("status", F.lit("unknown")) == "indexing").alias("pending"))


def planner_stats(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.round(F.avg(F.when(F.col("event_type") == "view", F.col("value"))), 6).alias("mean_ms"), F.min_by("event_type", "event_id").alias("first_kind"), F.count_if(F.col("event_type") == "error").alias("healer_calls"))


def insert_waits(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    steps = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("action"))
    clicks = e.where("event_type = 'click'").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("value > 60").select(F.col("user_id").alias("session"), "k")
    return K.insert_waits(steps, clicks).select("session", "step", "action")


def limit_max_issues(spark: SparkSession, d: str) -> DataFrame:
    return _issues(spark, d).orderBy("ordinal").limit(200).select("key", "severity")


def sort_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turn ids as text, some not numbers: numbers first by value, then text, null last."""
    e = table(spark, d, "events")
    turn = F.when(F.col("event_id") % 9 == 0, None).when(F.col("event_id") % 9 == 1, F.concat(F.lit("t"), "event_id")).otherwise(F.col("event_id").cast("string"))
    w = Window.partitionBy("user_id").orderBy(F.col("t").isNull(), F.expr("try_cast(t as int)").isNull(), F.expr("try_cast(t as int)"), "t", "event_id")
    return e.withColumn("t", turn).select("user_id", "event_id", F.row_number().over(w).alias("position"))


def step_markers(spark: SparkSession, d: str) -> DataFrame:
    """Marker lines planted after each turn, read back as rows."""
    c = table(spark, d, "conversations").select("conv_id", F.concat("text", F.lit("\nSTEP_MARK|"), "turn", F.lit("|click|role="), "role", F.lit("|v|d\n")).alias("t"))
    m = c.select("conv_id", F.explode(F.regexp_extract_all("t", F.lit(r"(?m)^(STEP_MARK\|[^\n]*)$"), F.lit(1))).alias("m")).select("conv_id", F.split("m", r"\|").alias("p"))
    return m.select("conv_id", F.col("p")[1].cast("int").alias("step"), F.col("p")[2].alias("action"), F.col("p")[3].alias("target"))


QUERIES = {
    f.__name__: f
    for f in (
        filter_source_files, test_target_candidates, norm_truthy, norm_blank, normalize_usage, compact_first_line, relative_path, classify_step_kind, render_kb_document, parse_footer, chunk_header, output_defaults, merge_labels, classify_dependency,
        dependency_counts, test_links_exact, route_to_handler, rule_fix_history, self_exclude_hits, context_filter, context_stats, partial_downgrade, cited_path_precision, paired_runs, outcome_join, kb_intelligence, lang_asymmetry, callee_top,
        failure_buckets, kb_status_counts, planner_stats, insert_waits, limit_max_issues, sort_turns, step_markers,
    )
}

_CUT = "case when length(text) <= 2200 then text else substr(text, 1, 1536) || chr(10) || '...' || chr(10) || right(text, 659) end"
_WHEN = "case " + " ".join(f"when contains(lower(p_name), '{p}') then '{c}'" for _, c, p in _CATEGORIES) + " else 'other' end"
_HITS = "h as (select distinct l_orderkey as issue, l_orderkey % 5 as ip, (l_orderkey % 3 * 10)::int as il, l_orderkey % 2 = 0 as named, l_partkey % 5 as path, case when l_suppkey % 2 = 0 then 'f' else 'g' end as symbol, l_returnflag = 'R' as is_test, l_linestatus = 'O' as is_caller, trunc(l_extendedprice * 1000 + l_partkey % 1000)::bigint as score from lineitem)"
_OWN = "case when path = ip and il > 0 then il between 5 and 15 when path = ip and named then symbol = 'f' else path = ip end"
_LEFT = f"{_HITS}, x as (select * from h where not ({_OWN})), y as (select distinct issue, is_test, is_caller, score, path from x), b as (select *, case when is_test then 'tests' when is_caller then 'callers' else 'others' end as bucket from y), u as (select *, row_number() over (partition by issue, bucket order by score desc, path) as r from b), used as (select * from u where r <= 3)"
_CHUNKS = f"{_CALLS}, u as (select callee, count(distinct caller)::int as callers from c group by 1), k as (select p_brand as lang, p_type as kind, case when p_brand <> 'Brand#1' then coalesce(callers, 0) else 0 end as callers, p_size % 3 as tests, case when p_size > 20 then p_name end as doc from part left join u on callee = p_partkey)"
_COUNTS = "count(*) as chunks, count(*) filter (callers > 0) as with_callers, count(*) filter (tests > 0) as with_tests, count(*) filter (length(doc) > 0) as with_doc from k"

SQL = {
    "filter_source_files": "select case when page_id % 5 = 0 then 'dir' when page_id % 3 = 0 then 'minified' when page_id % 3 = 1 then 'kept' else 'extension' end as reason, count(*) as n from pages group by 1",
    "test_target_candidates": "with p as (select p_partkey, replace(p_name, ' ', '_') as u, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '') as pas from part), q as (select *, lower(pas[1]) || pas[2:] as cam from p)"
    " select p_partkey, case when p_partkey % 2 = 1 then cam || ',' || pas when u = cam then u || ',' || pas else u || ',' || cam || ',' || pas end as candidates from q",
    "norm_truthy": "select o_orderkey % 7 in (0, 2, 3, 6) as flag, case when o_orderstatus = 'F' then 'fail' else 'pass' end as outcome, count(*) as n from orders group by all",
    "norm_blank": "select count(*) as n, count(*) filter (trim(text, ' ') <> '') as filled from documents",
    "normalize_usage": "with k as (select event_id % 3 as m, json_extract_string(props, '$.k')::int as k from events), u as (select case when m < 2 then k else 0 end as p, case when m = 0 then k % 7 else 0 end as c, case when m = 0 then k + k % 7 when m = 1 then k * 2 else k % 2 end as t from k), v as (select *, p <> 0 or c <> 0 or t <> 0 as known from u)"
    " select count(*) as n, count(*) filter (known) as known, sum(p)::bigint as prompt, sum(c)::bigint as completion, sum(t)::bigint as total from v",
    "compact_first_line": "select conv_id, turn, substr(trim(regexp_replace(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '\\s+', ' ', 'g')), 1, 300) as line from conversations",
    "relative_path": f"with {_ISSUES} select component[6:] as path, count(*) as n from i group by 1",
    "classify_step_kind": "select event_type, case when event_type = 'click' and event_id % 4 < 3 then 'auxiliary' else 'terminal' end as kind, count(*) as n from events group by all",
    "render_kb_document": f"select source || '::' || doc_id as title, md5({_CUT} || chr(10) || '---' || chr(10) || 'path: ' || source || chr(10) || 'symbol: ' || doc_id || chr(10) || 'kind: doc' || chr(10) || 'lang: ' || lang || case when doc_id % 2 = 0 then chr(10) || 'callers: a, b' else '' end) as body_md5 from documents",
    "parse_footer": "select source as path, lang, count(*) as n from documents group by all",
    "chunk_header": "select doc_id as symbol, md5(coalesce('[' || source || '] ' || lang || ': q' || quality || chr(10), '') || text) as code_md5 from documents left join labels using (doc_id)",
    "output_defaults": f"with {_ANALYSIS} select case when classification = 'wont_fix' then 'true_positive' else classification end as classification, count(*) as n from a group by 1",
    "merge_labels": f"with {_ANALYSIS} select 'bug,severity:' || severity || ',classification:' || classification || ',confidence:' || confidence || case when callers > 9 then ',auto_template:true' else '' end as labels, count(*) as n from a group by 1",
    "classify_dependency": f"select distinct p_name as name, {_WHEN} as category from part",
    "dependency_counts": f"select {_WHEN} as category, count(distinct p_name) as n from part group by 1",
    "test_links_exact": "select replace(p_name, ' ', '_') as symbol, count(distinct p_partkey) as tests, count(distinct p_partkey) as symbols from part group by 1",
    "route_to_handler": "with f as (select l_suppkey, '/p' || arg_min(l_partkey, l_orderkey * 100000000 + l_partkey) as route from lineitem group by 1) select s_suppkey as symbol, case when s_suppkey % 4 = 0 then '/own' else route end as endpoint from supplier left join f on l_suppkey = s_suppkey",
    "rule_fix_history": "with w as (select string_split(p_name, ' ') as ws from part), k as (select ws[2] as w from w union select substr(ws[2], 2, 4) from w union select ws[1] || ' ' || ws[2] from w),"
    " m as (select 'lint:' || w as rule, p_partkey as sha, row_number() over (partition by w order by p_size desc, p_partkey)::int as rank from k join part on contains(p_name, w) where length(w) >= 3) select rule, sha, rank from m where rank <= 3",
    "self_exclude_hits": f"with h as (select l_orderkey as issue, l_orderkey % 5 as ip, (l_orderkey % 3 * 10)::int as il, l_orderkey % 2 = 0 as named, l_partkey % 5 as path, case when l_suppkey % 2 = 0 then 'f' else 'g' end as symbol from lineitem) select issue, count(*) as n from h where not ({_OWN}) group by 1",
    "context_filter": f"with {_LEFT} select issue, bucket, count(*) as n, max(score) as best from used group by all",
    "context_stats": f"with {_LEFT} select (select count(*) from h) as retrieved, (select count(*) from x) as kept, (select count(*) from used) as used, (select count(*) from used where bucket = 'tests') as tests, (select count(*) from used where bucket = 'callers') as callers",
    "partial_downgrade": f"with {_ANALYSIS} select confidence, case when total_used = 0 then 'low' when total_used >= 2 and cited / total_used < 0.5 and confidence = 'high' then 'medium' else confidence end as after, count(*) as n from a group by all",
    "cited_path_precision": "with g as (select l_orderkey, coalesce(list(distinct l_partkey % 7) filter (l_returnflag = 'R'), []) as want, coalesce(list(distinct l_partkey % 7) filter (l_linestatus = 'O'), []) as got from lineitem group by 1) select l_orderkey, round(case when len(want) > 0 then len(list_intersect(want, got)) / len(want) end, 6) as precision from g",
    "paired_runs": "with a as (select user_id, ts::date as day, sum(value) as v from events group by all) select b.user_id, b.day::varchar as day, round(b.v - a.v, 4) as delta from a join a b on a.user_id = b.user_id and b.day = a.day + 1",
    "outcome_join": f"with {_ISSUES}, o as (select l_orderkey as key, max(l_returnflag) as outcome from lineitem group by 1) select severity, coalesce(outcome, 'none') as outcome, count(*) as n from i left join o using (key) group by all",
    "kb_intelligence": f"with {_CHUNKS} select 'all' as scope, '' as value, {_COUNTS} union all select 'lang', lang, {_COUNTS} group by lang union all select 'kind', kind, {_COUNTS} group by kind",
    "lang_asymmetry": f"with {_CHUNKS} select lang, count(*) as chunks from k group by 1 having count(*) >= 5 and sum(callers) = 0",
    "callee_top": f"with {_CALLS} select callee, count(*) as n from c group by 1 order by n desc, callee limit 10",
    "failure_buckets": "with c as (select conv_id, count(*) as turns, bool_or(length(text) % 5 = 0) as failed from conversations group by 1) select turns > 1 as multi, count(*) as n, round(avg((not failed)::int), 6) as pass_rate from c group by 1",
    "kb_status_counts": "select case o_orderstatus when 'F' then 'completed' when 'O' then 'indexing' else 'unknown' end as status, count(*) as n, o_orderstatus = 'O' as pending from orders group by all",
    "planner_stats": "select user_id, round(avg(value) filter (event_type = 'view'), 6) as mean_ms, arg_min(event_type, event_id) as first_kind, count(*) filter (event_type = 'error') as healer_calls from events group by 1",
    "insert_waits": "with s as (select user_id as session, event_id as o, 0 as f, event_type as action from events union all select user_id, event_id, 1, 'wait' from events where event_type = 'click' and value > 60) select session, row_number() over (partition by session order by o, f)::int as step, action from s",
    "limit_max_issues": f"with {_ISSUES} select key, severity from i order by key limit 200",
    "sort_turns": "with t as (select user_id, event_id, case when event_id % 9 = 0 then null when event_id % 9 = 1 then 't' || event_id else event_id::varchar end as t from events) select user_id, event_id, row_number() over (partition by user_id order by t is null, try_cast(t as int) is null, try_cast(t as int), t, event_id)::int as position from t",
    "step_markers": "select conv_id, turn::int as step, 'click' as action, 'role=' || role as target from conversations",
}
