"""Queries on orders and line items, seen as issues, commits, code chunks and calls, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayline.functions import text as T
from assayline.operators import codegraph, issues
from assayline.sources.tables import dealt, table

#: The severity that each order priority stands for in these queries.
_SEVERITY = {"1-URGENT": "BLOCKER", "2-HIGH": "CRITICAL", "3-MEDIUM": "MAJOR", "4-NOT SPECIFIED": "MINOR", "5-LOW": "INFO"}
SNAPSHOT = "1998-01-01"


def _issues(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    sev = F.element_at(F.create_map(*(F.lit(x) for kv in _SEVERITY.items() for x in kv)), F.col("o_orderpriority"))
    path = F.concat(F.lit("proj:src/m"), (F.col("o_custkey") % 20).cast("string"), F.lit("/f"), (F.col("o_custkey") % 7).cast("string"), F.lit(".py"))
    return o.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("rule"), (F.col("o_custkey") % 50).cast("string").alias("function"), path.alias("component"), (F.col("o_totalprice").cast("long") % 400).alias("line"), sev.alias("severity"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("cust"))


def cluster_issues(spark: SparkSession, d: str) -> DataFrame:
    return issues.cluster_issues(_issues(spark, d)).select("cluster_key", F.col("key").alias("leader"), "n_affected", F.array_join(F.transform(F.coalesce("affected", F.array().cast("array<struct<r:int,key:bigint,component:string,line:bigint>>")), lambda x: x["key"]), ",").alias("followers"))


def similar_locations(spark: SparkSession, d: str) -> DataFrame:
    i = _issues(spark, d).withColumn("rule", F.concat_ws("|", "rule", "function"))
    return issues.similar_locations(i).select("key", "similar_key", "similar_rank")


def diff_new_keys(spark: SparkSession, d: str) -> DataFrame:
    i = _issues(spark, d)
    return issues.new_keys(i, i.where(F.col("ts") < SNAPSHOT)).select("key", "severity")


def dedup_existing(spark: SparkSession, d: str) -> DataFrame:
    i = _issues(spark, d)
    filed = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key"))
    return issues.split_existing(i, filed).groupBy("outcome", "severity").agg(F.count(F.lit(1)).alias("n"))


def latest_change(spark: SparkSession, d: str) -> DataFrame:
    i = _issues(spark, d)
    commits = i.where("rule = 'F'").select(F.col("component").alias("path"), F.col("key").alias("sha"), (F.unix_seconds(F.col("ts").cast("timestamp")) * 100_000 + F.col("key")).alias("committed"))
    probe = i.where("rule <> 'F'").select("key", F.col("component").alias("path"), (F.unix_seconds(F.col("ts").cast("timestamp")) * 100_000 + F.col("key")).alias("ts"))
    return issues.latest_change(probe, commits).select("key", "sha")


def sort_severity(spark: SparkSession, d: str) -> DataFrame:
    i = _issues(spark, d)
    return i.orderBy(T.severity_rank(F.col("severity")), "key").limit(100).select("key", "severity")


def severity_distribution(spark: SparkSession, d: str) -> DataFrame:
    i = _issues(spark, d)
    g = i.groupingSets([[F.col("severity")], [F.col("rule")]], F.col("severity"), F.col("rule")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.coalesce("severity", "rule").alias("label"), F.when(F.col("severity").isNotNull(), "severity").otherwise("type").alias("kind"), "n")


def module_groups(spark: SparkSession, d: str) -> DataFrame:
    i = _issues(spark, d)
    g = i.groupBy(issues.module_of(F.substring_index("component", ":", -1)).alias("module")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(T.severity_rank(F.col("severity")).alias("r"), F.col("key").alias("k"))).alias("w"))
    return g.select("module", "n", F.col("w.k").alias("worst"))


def _analysis(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("callers"), F.count_if(F.col("l_returnflag") == "R").alias("tests"), F.count_if(F.col("l_linestatus") == "O").alias("total_used"), F.count_if((F.col("l_linestatus") == "O") & (F.col("l_quantity") < 25)).alias("cited"))
    i = _issues(spark, d).join(li, "key")
    return i.withColumn("classification", F.when(F.col("cust") % 5 == 0, "false_positive").when(F.col("cust") % 5 == 1, "wont_fix").otherwise("true_positive")).withColumn("confidence", F.when(F.col("cust") % 3 == 0, "high").when(F.col("cust") % 3 == 1, "medium").otherwise("low"))


def high_risk(spark: SparkSession, d: str) -> DataFrame:
    return issues.high_risk(_analysis(spark, d)).select("key", "severity", "callers")


def action_verdict(spark: SparkSession, d: str) -> DataFrame:
    a = _analysis(spark, d)
    verdict = T.action_verdict(F.col("severity"), F.col("classification"), F.col("confidence"), F.col("cited"), F.col("total_used"))
    return a.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def failure_patterns(spark: SparkSession, d: str) -> DataFrame:
    return issues.failure_patterns(_analysis(spark, d))


def rag_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Three denominators: rows with context for the citation ratio, all analysed for the empty and partial shares."""
    a = _analysis(spark, d)
    some = F.col("total_used") > 0
    return a.agg(
        F.count(F.lit(1)).alias("analysed"), F.round(F.avg(F.when(some, F.col("cited") / F.col("total_used"))), 6).alias("citation_ratio"), F.round(100.0 * F.count_if(~some) / F.count(F.lit(1)), 4).alias("empty_pct"),
        F.round(100.0 * F.count_if((F.col("cited") > 0) & (F.col("cited") < F.col("total_used"))) / F.count(F.lit(1)), 4).alias("partial_pct"), F.count_if(F.col("confidence") == "high").alias("high"), F.count_if(F.col("confidence") == "low").alias("low"),
    )


def issue_funnel(spark: SparkSession, d: str) -> DataFrame:
    i, a = _issues(spark, d), _analysis(spark, d)
    return issues.funnel([("found", i), ("analysed", a), ("false_positive", a.where("classification = 'false_positive'")), ("filed", a.where("classification = 'true_positive' and confidence <> 'low'"))])


def enclosing_chunk(spark: SparkSession, d: str) -> DataFrame:
    """Spans of lines of each document, three levels deep, around every line."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "code"))
    points = lines.select(F.concat_ws(":", "doc_id", "line").alias("key"), F.col("doc_id").alias("path"), "line")
    spans = lines.select(F.col("doc_id").alias("path"), "line", F.explode(F.array(F.lit(2), F.lit(5), F.lit(11))).alias("w")).where("line % w = 0")
    chunks = spans.select("path", F.concat_ws("_", "w", "line").alias("symbol"), F.when(F.col("w") == 11, "class").when(F.col("w") == 5, "function").otherwise("block").alias("kind"), F.col("line").alias("start_line"), (F.col("line") + F.col("w")).alias("end_line"), (F.col("line") * 100 + F.col("w")).alias("ordinal"))
    return issues.enclosing_chunk(points, chunks)


def snippet_window(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("component"), F.posexplode(F.split("text", "\n")).alias("line_no", "code"))
    points = lines.select(F.concat_ws(":", "component", "line_no").alias("key"), "component", F.col("line_no").alias("line"))
    wide = issues.snippet_window(points, lines, 50)  # as an issue keeps it; a prompt takes ten lines of that
    return wide.select("key", F.md5(issues.retrimmed(F.col("snippet"), 10)).alias("snippet_md5"))


# --- call graph: parts bought one after the other in an order call each other -------------------


def _calls(spark: SparkSession, d: str) -> DataFrame:
    li = dealt(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return li.withColumn("callee", F.lead("l_partkey").over(order)).where("callee is not null").select(F.col("l_partkey").alias("caller"), "callee", F.col("l_orderkey").alias("ordinal")).distinct()


def callers_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Sorted distinct callers of each part, at most 20."""
    return codegraph.callers_rollup(_calls(spark, d)).select("callee", "n_callers", F.array_join(F.transform("callers", lambda x: x.cast("string")), ",").alias("callers"))


def direct_callers(spark: SparkSession, d: str) -> DataFrame:
    return codegraph.direct_callers(_calls(spark, d)).select("callee", "caller", "caller_rank")


def depth2_callers(spark: SparkSession, d: str) -> DataFrame:
    return codegraph.depth2_callers(_calls(spark, d), 5, 5).select("symbol", "caller2", "caller_rank")


def caller_hubs(spark: SparkSession, d: str) -> DataFrame:
    return codegraph.callers_rollup(_calls(spark, d)).orderBy(F.desc("n_callers"), "callee").limit(10).select("callee", "n_callers")


def orphan_rate(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("symbol"))
    called = _calls(spark, d).select(F.col("callee").alias("symbol")).distinct().withColumn("called", F.lit(True))
    return parts.join(called, "symbol", "left").agg(F.count(F.lit(1)).alias("symbols"), F.count_if(F.col("called").isNull()).alias("orphans"), F.round(F.avg(F.col("called").isNull().cast("double")), 6).alias("orphan_rate"))


def test_links_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Words of part names as test candidates of symbols made of name and type."""
    p = table(spark, d, "part")
    cand = p.select(F.explode(F.split("p_name", " ")).alias("candidate")).distinct()
    syms = p.select(F.col("p_partkey").alias("id"), F.concat(F.translate("p_name", " ", "_"), F.initcap(F.lower("p_type"))).alias("symbol"))
    return codegraph.prefix_links(cand, syms).select("candidate", "id")


def useful_callee(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select(F.explode(F.split("text", "[^A-Za-z_]+")).alias("name"))
    return codegraph.useful(w).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def dedup_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("lang").alias("symbol"), F.col("text").alias("code"), F.lit("p").alias("path"), F.col("doc_id").alias("ordinal"))
    return codegraph.dedup_chunks(docs).select("symbol", "ordinal", "copies")


def test_coverage_map(spark: SparkSession, d: str) -> DataFrame:
    rolled = codegraph.callers_rollup(_calls(spark, d)).select(F.col("callee").alias("p_partkey"), "n_callers")
    p = table(spark, d, "part").join(rolled, "p_partkey", "left")
    return p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("symbols"), F.count_if(F.coalesce("n_callers", F.lit(0)) >= 20).alias("covered"), F.round(100.0 * F.count_if(F.coalesce("n_callers", F.lit(0)) >= 20) / F.count(F.lit(1)), 4).alias("covered_pct"))


def flag_test_location(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "pages").select("page_id", F.concat(F.parse_url("url", F.lit("PATH")), F.when(F.col("page_id") % 3 == 0, "/unit/x.py").when(F.col("page_id") % 3 == 1, "/test_a.py").otherwise("/a.py")).alias("path"))
    return u.select("page_id", T.is_test_location(F.col("path")).alias("is_test"))


QUERIES = {
    f.__name__: f
    for f in (
        cluster_issues, similar_locations, diff_new_keys, dedup_existing, latest_change, sort_severity, severity_distribution, module_groups, high_risk, action_verdict, failure_patterns, rag_diagnostics, issue_funnel, enclosing_chunk, snippet_window,
        callers_rollup, direct_callers, depth2_callers, caller_hubs, orphan_rate, test_links_prefix, useful_callee, dedup_chunks, test_coverage_map, flag_test_location,
    )
}

_CASE = "case o_orderpriority " + " ".join(f"when '{k}' then '{v}'" for k, v in _SEVERITY.items()) + " end"
_RANK = "case severity when 'BLOCKER' then 0 when 'CRITICAL' then 1 when 'MAJOR' then 2 when 'MINOR' then 3 else 4 end"
_ISSUES = f"i as (select o_orderkey as key, o_orderstatus as rule, (o_custkey % 50)::varchar as function, 'proj:src/m' || (o_custkey % 20) || '/f' || (o_custkey % 7) || '.py' as component, 'proj:src/m' || (o_custkey % 20) as dir, trunc(o_totalprice)::bigint % 400 as line, {_CASE} as severity, o_orderdate as ts, o_custkey as cust from orders)"
_ANALYSIS = (
    f"{_ISSUES}, li as (select l_orderkey as key, count(*) as callers, count(*) filter (l_returnflag = 'R') as tests, count(*) filter (l_linestatus = 'O') as total_used, count(*) filter (l_linestatus = 'O' and l_quantity < 25) as cited from lineitem group by 1),"
    " a as (select *, case when cust % 5 = 0 then 'false_positive' when cust % 5 = 1 then 'wont_fix' else 'true_positive' end as classification, case when cust % 3 = 0 then 'high' when cust % 3 = 1 then 'medium' else 'low' end as confidence from i join li using (key))"
)
_CALLS = "e as (select l_partkey as caller, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as callee, l_orderkey as ordinal from lineitem), c as (select distinct caller, callee, ordinal from e where callee is not null)"
_HUBS = f"{_CALLS}, u as (select distinct callee, caller from c), h as (select callee, count(*) as n_callers from u group by 1)"
_NAMES = ", ".join(f"'{n}'" for n in T.GENERIC_NAMES)

SQL = {
    "cluster_issues": f"with {_ISSUES}, k as (select *, substr(sha1(rule || '|' || function || '|' || dir), 1, 16) as cluster_key from i), r as (select *, row_number() over (partition by cluster_key order by {_RANK}, line, key) as r from k)"
    " select cluster_key, max(key) filter (r = 1) as leader, (count(*) - 1)::int as n_affected, coalesce(string_agg(key::varchar, ',' order by r) filter (r between 2 and 51), '') as followers from r group by 1",
    "similar_locations": f"with {_ISSUES}, r as (select key, rule || '|' || function as k, row_number() over (partition by rule, function order by key) as r from i), p as (select a.key, b.key as similar_key, row_number() over (partition by a.key order by b.key)::int as similar_rank from r a join r b on a.k = b.k and b.r <= 6 and a.key <> b.key) select * from p where similar_rank <= 5",
    "diff_new_keys": f"with {_ISSUES} select key, severity from i where not (ts < timestamp '{SNAPSHOT}')",
    "dedup_existing": f"with {_ISSUES} select case when key in (select l_orderkey from lineitem where l_returnflag = 'R') then 'skipped' else 'created' end as outcome, severity, count(*) as n from i group by all",
    "latest_change": f"with {_ISSUES}, x as (select key, rule, component, epoch_us(ts) // 1000000 * 100000 + key as t from i), c as (select * from x where rule = 'F'), p as (select * from x where rule <> 'F') select p.key, arg_max(c.key, c.t) as sha from p left join c on c.component = p.component and c.t <= p.t group by p.key",
    "sort_severity": f"with {_ISSUES} select key, severity from i order by {_RANK}, key limit 100",
    "severity_distribution": f"with {_ISSUES} select coalesce(severity, rule) as label, case when severity is not null then 'severity' else 'type' end as kind, count(*) as n from i group by grouping sets ((severity), (rule))",
    "module_groups": f"with {_ISSUES} select dir[6:] as module, count(*) as n, arg_min(key, {_RANK} * 10000000 + key) as worst from i group by 1",
    "high_risk": f"with {_ANALYSIS} select key, severity, callers from a where severity in ('BLOCKER', 'CRITICAL', 'MAJOR') and callers >= 5 and classification = 'true_positive' and confidence in ('high', 'medium')",
    "action_verdict": f"with {_ANALYSIS}, w as (select *, (total_used = 0 or (cited = 0 and confidence = 'low')) as weak from a) select case when classification = 'false_positive' then case when confidence = 'high' then 'false_positive_sure' else 'false_positive' end when classification = 'wont_fix' then 'ignore'"
    " when severity in ('BLOCKER', 'CRITICAL') then case when weak then 'fix_now_weak_basis' else 'fix_now' end when severity = 'MAJOR' then case when weak then 'review_weak_basis' else 'review' end else 'later' end as verdict, count(*) as n from w group by 1",
    "failure_patterns": f"with {_ANALYSIS}, p as (select 'A' as pattern from a where total_used = 0 union all select 'B' from a where callers = 0 union all select 'C' from a where tests = 0 union all select 'D' from a where cited > 0 and cited < total_used) select pattern, count(*) as n from p group by 1",
    "rag_diagnostics": f"with {_ANALYSIS} select count(*) as analysed, round(avg(case when total_used > 0 then cited / total_used end), 6) as citation_ratio, round(100.0::double * count(*) filter (total_used = 0) / count(*), 4) as empty_pct, round(100.0::double * count(*) filter (cited > 0 and cited < total_used) / count(*), 4) as partial_pct, count(*) filter (confidence = 'high') as high, count(*) filter (confidence = 'low') as low from a",
    "issue_funnel": f"with {_ANALYSIS} select 0 as position, 'found' as stage, count(*) as n from i union all select 1, 'analysed', count(*) from a union all select 2, 'false_positive', count(*) from a where classification = 'false_positive' union all select 3, 'filed', count(*) from a where classification = 'true_positive' and confidence <> 'low'",
    "enclosing_chunk": "with l as (select doc_id, unnest(string_split(text, chr(10))) as code, unnest(range(len(string_split(text, chr(10)))))::int as line from documents), s as (select doc_id, line, w from l, (values (2), (5), (11)) v(w) where line % w = 0),"
    " m as (select p.doc_id || ':' || p.line as key, w || '_' || s.line as symbol, w as span, row_number() over (partition by p.doc_id, p.line order by case when w = 5 then 0 else 1 end, w, s.line) as r from l p join s on s.doc_id = p.doc_id and p.line between s.line and s.line + w)"
    " select key, symbol, span from m where r = 1",
    "snippet_window": "with l as (select doc_id, unnest(string_split(text, chr(10))) as code, unnest(range(len(string_split(text, chr(10)))))::int as n from documents)"
    " select p.doc_id || ':' || p.n as key, md5(string_agg(case when q.n = p.n then '>> ' else '   ' end || q.n || ': ' || substr(q.code, 1, 400), chr(10) order by q.n)) as snippet_md5 from l p join l q on p.doc_id = q.doc_id and q.n between p.n - 10 and p.n + 10 group by p.doc_id, p.n",
    "callers_rollup": f"with {_HUBS}, r as (select *, row_number() over (partition by callee order by caller) as r from u) select callee, any_value(n_callers) as n_callers, string_agg(caller::varchar, ',' order by caller) filter (r <= 20) as callers from r join h using (callee) group by 1",
    "direct_callers": f"with {_CALLS}, f as (select callee, caller, min(ordinal) as o from c group by all), r as (select *, row_number() over (partition by callee order by o, caller)::int as caller_rank from f) select callee, caller, caller_rank from r where caller_rank <= 10",
    "depth2_callers": f"with {_CALLS}, f as (select callee, caller, min(ordinal) as o from c group by all), d1 as (select *, row_number() over (partition by callee order by o, caller) as r from f qualify r <= 5), x as (select a.callee as symbol, b.caller as caller2, min(a.r * 10 + b.r) as o from d1 a join d1 b on b.callee = a.caller group by all),"
    " y as (select x.* from x where caller2 <> symbol and not exists (select 1 from d1 where d1.callee = x.symbol and d1.caller = x.caller2)), z as (select *, row_number() over (partition by symbol order by o, caller2)::int as caller_rank from y) select symbol, caller2, caller_rank from z where caller_rank <= 5",
    "caller_hubs": f"with {_HUBS} select callee, n_callers from h order by n_callers desc, callee limit 10",
    "orphan_rate": f"with {_CALLS} select count(*) as symbols, count(*) filter (p_partkey not in (select callee from c)) as orphans, round(avg((p_partkey not in (select callee from c))::int), 6) as orphan_rate from part",
    "test_links_prefix": "with w as (select distinct unnest(string_split(p_name, ' ')) as candidate from part), s as (select p_partkey as id, replace(p_name, ' ', '_') || upper(p_type[1]) || lower(p_type[2:]) as symbol from part)"
    " select candidate, id from w join s on length(candidate) >= 4 and starts_with(symbol, candidate) and length(symbol) > length(candidate) and regexp_matches(symbol[length(candidate) + 1], '[A-Z_]')",
    "useful_callee": f"with w as (select unnest(regexp_split_to_array(text, '[^A-Za-z_]+')) as name from documents) select name, count(*) as n from w where length(name) >= 4 and name not in ({_NAMES}) group by 1",
    "dedup_chunks": "select lang as symbol, min(doc_id) as ordinal, count(*) as copies from documents group by lang, text",
    "test_coverage_map": f"with {_HUBS} select p_brand, count(*) as symbols, count(*) filter (n_callers >= 20) as covered, round(100.0::double * count(*) filter (n_callers >= 20) / count(*), 4) as covered_pct from part left join h on callee = p_partkey group by 1",
    "flag_test_location": "select page_id, page_id % 3 < 2 as is_test from pages",
}
