"""Queries on verdicts, answers, prompts, selectors and page texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions import selectors
from assayline.functions import text as T
from assayline.operators import answers, knowledge, pages, prompts, retrieval, sessions, verdicts
from assayline.plans.q_issues import _ANALYSIS, _analysis
from assayline.plans.q_web import _TOKENS
from assayline.sources.tables import table
from assayline.sources.workdir import work_path


def _share(what, of=None):
    """Percent of rows, of all or of some."""
    return 100.0 * F.count_if(what) / (F.count(F.lit(1)) if of is None else F.count_if(of))


def rag_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Lights of each severity's analyses."""
    a, some = _analysis(spark, d), F.col("total_used") > 0
    rows = a.groupBy("severity").agg(
        F.count(F.lit(1)).alias("analysed"), F.count_if(~some).alias("n_empty"), F.count_if(F.col("confidence") == "low").alias("n_retry"),
        (100.0 * F.avg(F.when(some, F.col("cited") / F.col("total_used")))).alias("citation_pct"), _share(F.col("callers") > 3).alias("callers_pct"),
        _share(F.col("tests") > 0).alias("tests_pct"), _share(F.col("callers") > 6).alias("retry_pct"), _share(~some).alias("empty_pct"),
    )
    return verdicts.rag_verdicts(rows).select("severity", "n_measured", "citation", "buckets", "quality", "overall")


def kb_verdict(spark: SparkSession, d: str) -> DataFrame:
    """The score of each brand's parts as a knowledge base."""
    p = table(spark, d, "part")
    stats = p.groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("chunks"), (F.count_if(F.col("p_size") > 20) / F.count(F.lit(1))).alias("orphan_ratio"), F.count_if(F.col("p_size") == 7).alias("endpoints"),
        F.count_if(F.col("p_size") == 8).alias("decorators"), _share(F.col("p_retailprice") > 1000).alias("coverage_pct"), F.count_if(F.col("p_size") == 50).alias("parser_failed"), F.sum("p_size").alias("caller_links"),
    )
    return verdicts.kb_verdict(stats).select("p_brand", "score", "level", F.array_join("actions", ",").alias("actions"))


def learn_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Lights of each ship date's line items as a learning run."""
    li = table(spark, d, "lineitem")
    rows = li.groupBy("l_shipdate").agg(
        F.count_if(F.col("l_quantity") > 15).alias("files_analyzed"), F.count_if(F.col("l_quantity") <= 15).alias("parser_failed"), F.count_if(F.col("l_linenumber") > 1).alias("chunks"),
        _share(F.col("l_discount") > 0.05).alias("callees_pct"), _share(F.col("l_returnflag") == "R").alias("test_link_pct"), F.count_if(F.col("l_tax") == 0).alias("endpoints"),
        F.count_if(F.col("l_quantity") == 50).alias("type_chunks"), F.count_if(F.col("l_discount") < 0.03).alias("docstrings"), _share(F.col("l_quantity") > 20).alias("parser_pct"),
        F.count_if(F.col("l_tax") == 0.08).alias("n_asymmetric"), F.count_if(F.col("l_linestatus") == "O").alias("diagnosed"), _share(F.col("l_returnflag") == "A").alias("any_hit_pct"),
    )
    return verdicts.learn_verdicts(rows).groupBy("scope", "depth", "quality", "impact").agg(F.count(F.lit(1)).alias("n"))


def issue_verdict_text(spark: SparkSession, d: str) -> DataFrame:
    a = _analysis(spark, d)
    line = verdicts.issue_verdict(F.col("severity") == "INFO", F.col("callers") > 6, F.col("total_used"), F.col("cited"), F.col("tests"), F.col("confidence"), F.col("classification"), F.col("cited") < F.col("total_used"))
    return a.select("key", line.alias("verdict"))


def _trust(spark: SparkSession, d: str) -> DataFrame:
    a = _analysis(spark, d)
    labels = F.when(F.col("tests") == 2, F.array(F.lit("partial_citation"))).when(F.col("tests") == 3, F.array(F.lit("other")))
    return verdicts.trust_signals(a.select("component", "confidence", labels.alias("labels"), "cited", F.col("total_used").alias("used")), ["component"])


def trust_signals(spark: SparkSession, d: str) -> DataFrame:
    return _trust(spark, d)


def overall_verdict(spark: SparkSession, d: str) -> DataFrame:
    counts = _analysis(spark, d).groupBy("component").agg((2 * F.count(F.lit(1))).alias("created"), F.count_if((F.col("severity") == "BLOCKER") & (F.col("callers") > 6)).alias("failed"))
    return verdicts.overall_verdict(_trust(spark, d).join(counts, "component")).select("component", "light", "level")


def normalize_llm_json(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as answers: well formed, fenced, after reasoning, with raw line ends, broken or without JSON."""
    c = table(spark, d, "conversations").withColumn("kind", (F.col("conv_id") * 3 + F.col("turn")) % 9)
    body = F.to_json(F.struct(F.concat(F.lit("T"), F.col("turn").cast("string")).alias("title"), F.when(F.col("kind") == 7, "").otherwise(F.col("text")).alias("impact_analysis_markdown"), F.array("role").alias("labels"), F.lit("high").alias("confidence")))
    text = (
        F.when(F.col("kind") == 0, "  ")
        .when(F.col("kind") == 1, F.concat(F.lit("<think>{no}</think>\n```json\n"), body, F.lit("\n```")))
        .when(F.col("kind") == 2, F.concat(F.lit("<THINK>never ends "), body))
        .when(F.col("kind") == 3, "plain words only")
        .when(F.col("kind") == 4, F.concat(F.lit("Here: "), F.replace(body, F.lit('"title":"'), F.lit('"title":"a\\d\n')), F.lit(" done")))
        .when(F.col("kind") == 5, F.concat(F.lit("{"), body, F.lit("}")))
        .otherwise(body)
    )
    got = answers.normalize_answers(c.select("conv_id", "turn", text.alias("llm_text"), (F.col("turn") > 1).alias("has_context")))
    return got.select("conv_id", "turn", "parse_status", "title", "confidence", F.array_join("labels", ",").alias("labels"), F.md5("impact_analysis_markdown").alias("impact_md5"))


def metadata_hits(spark: SparkSession, d: str) -> DataFrame:
    """Each document as an answer, its words as the metadata that it may name."""
    words = F.split("text", " ")
    at = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit(""))
    used = F.array(F.struct(F.concat(F.lit("GET "), at(3)).alias("endpoint"), F.concat(F.lit("@"), at(4), F.lit("(x) @nowhere")).alias("decorators")), F.struct(F.lit(None).cast("string").alias("endpoint"), F.concat(F.lit("@nowhere @"), at(5)).alias("decorators")))
    rows = table(spark, d, "documents").where("text is not null").select(
        "doc_id", F.concat("text", F.lit(" POST `"), at(1), F.lit("`")).alias("answer"), F.concat(F.lit("POST "), at(0)).alias("endpoint"),
        F.array(F.concat(F.lit("@"), at(1), F.lit("(a)")), F.concat(F.lit("@"), at(1)), F.lit("@zz.nowhere")).alias("decorators"), F.array(at(1), at(2)).alias("params"), used.alias("used"),
    )
    return answers.metadata_hits(rows).select("doc_id", "endpoint_hits", "decorator_hits", "param_hits", "rag_meta_hits", "total_hits")


def build_query_text(spark: SparkSession, d: str) -> DataFrame:
    """Three search texts of each part, whose type is code of one line a word."""
    p = table(spark, d, "part")
    code = F.concat(F.lit("a\nb\nc\nd\n  >> "), F.regexp_replace("p_type", " ", "\n"), F.lit("\nx\ny\nz"))
    issues = p.select(
        "p_partkey", F.when(F.col("p_size") > 5, code).alias("snippet"), F.when(F.col("p_size") > 10, F.col("p_name")).alias("function"), F.concat(F.lit("src/"), "p_brand").alias("path"), F.col("p_type").alias("rule"),
        F.col("p_name").alias("message"), F.when(F.col("p_size") > 30, F.concat(F.lit("GET /"), "p_brand")).alias("endpoint"), F.array(F.concat(F.lit("@app.route('"), "p_name", F.lit("')")), F.lit("@ ")).alias("decorators"), F.array("p_brand", F.lit("")).alias("params"),
    )
    return prompts.query_texts(issues).select("p_partkey", "attempt", "query")


def render_prompt_context(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of each supplier, whose nation gives callers and places."""
    s = table(spark, d, "supplier")
    none = F.array().cast("array<string>")
    near = F.transform(F.sequence(F.lit(1), F.col("s_nationkey") + 1), lambda i: F.concat(F.lit("f"), i.cast("string")))
    issues = s.select(
        "s_suppkey", F.when(F.col("s_nationkey") > 2, near).otherwise(none).alias("direct_callers"), F.when(F.col("s_nationkey") > 12, near).otherwise(none).alias("depth2_callers"), F.when(F.col("s_acctbal") > 5000, near).otherwise(none).alias("past_fixes"),
        F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("git_context"), F.transform(F.when(F.col("s_nationkey") < 20, near).otherwise(none), lambda x: F.struct(x.alias("path"), F.col("s_nationkey").alias("line"))).alias("similar"),
        F.when(F.col("s_acctbal") < 1000, F.concat(F.lit("  "), "s_name")).alias("overview"), F.lit("POST /x").alias("endpoint"), near.alias("decorators"), none.alias("params"), near.alias("callees"), F.lit(" ").alias("doc"),
    )
    return prompts.prompt_context(issues).select("s_suppkey", "dependency_tree", "git_history", "similar_places", "overview_text", "static_facts")


def clean_target(spark: SparkSession, d: str) -> DataFrame:
    """Part names as targets in several notations."""
    kind, name = F.col("p_size") % 7, F.col("p_name")
    target = (
        F.when(kind == 0, F.concat(F.lit("role=button, name="), name)).when(kind == 1, F.concat(F.lit("frame=#a >> text="), name, F.lit(", nth=2"))).when(kind == 2, "role=button")
        .when(kind == 3, F.concat(F.lit("label= "), name, F.lit(" "))).when(kind == 4, F.concat(name, F.lit(", has_text=x"))).when(kind == 5, F.concat(F.lit("role=link, name="), name, F.lit(", nth=1"))).otherwise(name)
    )
    return table(spark, d, "part").select("p_partkey", selectors.clean_target(target).alias("target"))


def page_selector_score(spark: SparkSession, d: str) -> DataFrame:
    """Steps of each brand's parts: golden and observed selectors in several notations."""
    p = table(spark, d, "part")
    size, name, word = F.col("p_size"), F.col("p_name"), F.element_at(F.split("p_name", " "), 1)
    golden = F.when(size % 5 == 0, F.concat(F.lit("getByRole('button', { name: '"), name, F.lit("' })"))).when(size % 5 == 1, F.concat(F.lit("getByText('"), name, F.lit("')"))).when(size % 5 == 2, F.concat(F.lit("#"), word, F.lit(".row"))).when(size % 5 == 3, "").otherwise(F.concat(F.lit("#"), word))
    seen = F.when(size % 3 == 0, F.concat(F.lit("getByRole('button', { name: '"), word, F.lit("' })"))).when(size % 3 == 1, F.concat(F.lit("getByText('"), F.upper(name), F.lit("')"))).otherwise(F.concat(F.lit("#"), word))
    action = F.when(size == 9, "wait").otherwise("click")
    graded = p.select("p_brand", selectors.step_class(action, size == 11, F.when(size != 13, F.when(size == 14, "fill").otherwise(action)), golden, seen).alias("grade"))
    scored = F.count_if(F.col("grade") != "skipped")
    rate = lambda grade: F.round(F.coalesce(F.try_divide(F.count_if(F.col("grade") == grade), scored), F.lit(0.0)), 6)
    return graded.groupBy("p_brand").agg(scored.alias("scored"), rate("exact").alias("accuracy"), rate("partial").alias("partial_rate"))


def clean_page_text(spark: SparkSession, d: str) -> DataFrame:
    return pages.clean_pages(table(spark, d, "pages")).select("page_id", F.md5("clean_text").alias("text_md5"))


def filter_short_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as page texts, named by their place."""
    p = table(spark, d, "documents").select("doc_id", F.concat(F.lit("https://h."), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("clean_text"))
    return pages.kb_files(p).select("doc_id", "file_name", F.md5("content").alias("content_md5"))


def domain_entities(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as classes, by the number of their line items."""
    used = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n_callers"))
    kinds = F.element_at(F.array(*map(F.lit, ("class", "function", "type", "interface"))), (F.col("s_nationkey") % 4 + 1).cast("int"))
    names = F.element_at(F.array(*map(F.lit, ("UserModel", "OrderService", "Cart", "DataHandler", "PriceDTO"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    place = F.when(F.col("s_nationkey") > 12, "src/domain/x.py").otherwise("src/x.py")
    chunks = table(spark, d, "supplier").join(used, "s_suppkey", "left").select(place.alias("path"), names.alias("symbol"), kinds.alias("kind"), F.coalesce("n_callers", F.lit(0)).alias("n_callers"), F.col("s_suppkey").alias("ordinal"))
    return knowledge.domain_entities(chunks).select("ordinal", "symbol", "kind", "n_callers")


def redirect_merge(spark: SparkSession, d: str) -> DataFrame:
    """Views are goto actions; errors of the same user tell where an address leads."""
    e = table(spark, d, "events")
    actions = e.where("event_type <> 'error'").select("event_id", F.when(F.col("event_type") == "view", "Goto").otherwise("click").alias("method"), F.col("user_id").cast("string").alias("target"))
    told = e.where("event_type = 'error'").select(F.col("user_id").cast("string").alias("requested"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("message"), F.col("event_id").alias("ordinal"))
    return sessions.with_redirects(actions, told).select("event_id", "dialog_text")


def snk_url_exports(spark: SparkSession, d: str) -> DataFrame:
    """Pages as CSV and as JSON lines, both read back and compared."""
    p = table(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", "^([a-z]+)://", 1).alias("source"))
    path = work_path(spark, "url-exports")
    p.write.option("header", True).option("escape", '"').csv(f"{path}/csv")
    p.write.json(f"{path}/json")
    schema = "page_id long, url string, source string"
    both = spark.read.schema(schema).option("header", True).option("escape", '"').csv(f"{path}/csv").withColumn("form", F.lit("csv"))
    both = both.unionByName(spark.read.schema(schema).json(f"{path}/json").withColumn("form", F.lit("json")))
    return both.groupBy("form", "source").agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("first_url"), F.max("url").alias("last_url"))


def norm_outcome(spark: SparkSession, d: str) -> DataFrame:
    words = F.element_at(F.array(*map(F.lit, ("fail", " Failed ", "NEGATIVE", "f", "ok", "pass", ""))), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", T.outcome(F.when(F.col("value") < 90, words)).alias("outcome"))


def criteria_mode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", T.criteria_mode(F.when(F.col("event_type") == "view", F.concat(F.lit("json."), "event_type")).when(F.col("event_type") == "click", F.col("props")).when(F.col("event_type") == "error", "")).alias("mode"))


def failure_reason_class(spark: SparkSession, d: str) -> DataFrame:
    marks = F.element_at(F.array(*map(F.lit, ("Promptfoo policy checks reported 1", "Format Compliance Failed", "Adapter Error: x", "TaskCompletion failed", "AnswerRelevancyMetric 0.2", "Metrics failed", "else"))), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", T.failure_reason(marks, F.col("value") > 1).alias("reason"))


def hybrid_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items ask by vector and by words: cosine with their own vector, and BM25 as a share of the item's best.

    Each way gives its 50 best, which are then weighed together; the items, whose number is fixed, are broadcast, and the
    vectors dealt into tasks by the number of pairs, as each task sorts those that it scores.
    """
    items, vectors = table(spark, d, "benchmark"), table(spark, d, "embeddings")
    asked = items.join(vectors, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("own"))
    parts = retrieval.task_count(spark, vectors.count() * asked.count())
    cosines = vectors.select("vec_id", "embedding").repartition(parts).join(F.broadcast(asked), F.col("vec_id") != F.col("query_id")).select("query_id", F.col("vec_id").alias("doc_id"), F.round(retrieval.cosine(F.col("own"), F.col("embedding")), 4).alias("score"))
    dense = retrieval.top_n(cosines, "query_id", [F.desc("score"), F.col("doc_id")], 50).drop("rank")
    found = retrieval.bm25(table(spark, d, "documents").select("doc_id", "text"), items.select(F.col("item_id").alias("query_id"), "text"), 50)
    best = found.groupBy("query_id").agg(F.max("score").alias("best"))
    sparse = found.join(best, "query_id").select("query_id", "doc_id", F.round(F.col("score") / F.col("best"), 4).alias("score"))
    return retrieval.hybrid_topk(dense, sparse)



QUERIES = {
    f.__name__: f
    for f in (
        rag_verdicts, kb_verdict, learn_verdicts, issue_verdict_text, trust_signals, overall_verdict, normalize_llm_json, metadata_hits, build_query_text, render_prompt_context,
        clean_target, page_selector_score, clean_page_text, filter_short_pages, domain_entities, redirect_merge, snk_url_exports, norm_outcome, criteria_mode, failure_reason_class, hybrid_retrieve,
    )
}



def _light(value: str, green: float, yellow: float) -> str:
    return f"case when {value} >= {green} then 'green' when {value} >= {yellow} then 'yellow' else 'red' end"


_WORST = "case when 'red' in ({0}) then 'red' when 'gray' in ({0}) then 'gray' when 'yellow' in ({0}) then 'yellow' else 'green' end"
_TRUST = (
    f"{_ANALYSIS}, t as (select component, count(*) filter (confidence = 'high') as high, count(*) filter (confidence = 'medium') as medium, count(*) filter (confidence = 'low') as low,"
    " count(*) filter (tests = 2 or (total_used > 0 and cited * 2 < total_used)) as partial from a group by 1)"
)


def _bulleted(items: str, most: int) -> str:
    return f"array_to_string(list_transform({items}[1:{most}], lambda x: '  - ' || x), chr(10))"


_SELECTORS = r"""s as (select p_brand, p_name, string_split(p_name, ' ')[1] as word, p_size % 5 as g, p_size % 3 as o, case when p_size = 11 or p_size = 9 then 'skipped' when p_size in (13, 14) then 'fail' else 'judge' end as state from part),
 r as (select p_brand, case when state <> 'judge' then state
 when g = 3 then 'fail'
 when g = 0 and o = 0 then case when p_name = word then 'exact' else 'partial' end
 when g = 1 and o = 1 then 'exact'
 when g = 4 and o = 2 then 'exact'
 when g = 2 and o = 2 then 'exact'
 else 'partial' end as grade from s)"""

SQL: dict[str, str] = {
    "rag_verdicts": f"with {_ANALYSIS}, g as (select severity, count(*) as n, count(*) filter (total_used = 0) as e, count(*) filter (confidence = 'low') as r, 100.0::double * avg(cited / total_used) filter (total_used > 0) as cite,"
    " (100.0::double * count(*) filter (callers > 3) / count(*) + 100.0::double * count(*) filter (tests > 0) / count(*)) / 2 as full_pct, 100.0::double * count(*) filter (callers > 6) / count(*) as rp, 100.0::double * count(*) filter (total_used = 0) / count(*) as ep from a group by 1),"
    f" v as (select severity, greatest(0, n - e - r)::bigint as n_measured, case when n - e - r < 3 then 'gray' else {_light('cite', 60, 30)} end as citation, {_light('full_pct', 60, 30)} as buckets,"
    " case when rp > 20 or ep > 50 then 'red' when rp > 5 or ep > 25 then 'yellow' else 'green' end as quality from g)"
    f" select *, {_WORST.format('citation, buckets, quality')} as overall from v",
    "kb_verdict": "with s as (select p_brand, count(*) as chunks, count(*) filter (p_size > 20) / count(*) as orphan, count(*) filter (p_size = 7) as endpoints, count(*) filter (p_size = 8) as decorators, 100.0 * count(*) filter (p_retailprice > 1000) / count(*) as cov,"
    " count(*) filter (p_size = 50) as failed, sum(p_size) as links from part group by 1), k as (select *, ((case when chunks > 50 then 30 when chunks > 0 then 10 else 0 end) + (case when orphan < 0.7 then 20 else 0 end) + (case when endpoints > 0 then 15 else 0 end)"
    " + (case when cov > 30 then 15 else 0 end) + (case when failed = 0 then 10 else 0 end) + (case when links > chunks then 10 else 0 end))::int as score, list_filter([case when cov < 30 then 'add_tests' end, case when endpoints > 0 and decorators = 0 then 'define_api_rules' end,"
    " case when orphan > 0.8 then 'check_caller_index' end, case when failed > 5 then 'check_parser' end], lambda x: x is not null) as acts from s)"
    " select p_brand, score, case when score >= 80 then 'high' when score >= 50 then 'medium' else 'low' end as level, case when len(acts) = 0 then 'none_needed' else array_to_string(acts[1:3], ',') end as actions from k",
    "learn_verdicts": "with g as (select l_shipdate, count(*) as n, count(*) filter (l_quantity > 15) as good, count(*) filter (l_linenumber > 1) as chunks, 100.0 * count(*) filter (l_discount > 0.05) / count(*) as callees, 100.0 * count(*) filter (l_returnflag = 'R') / count(*) as tests,"
    " count(*) filter (l_tax = 0) as endpoints, count(*) filter (l_quantity = 50) as types, count(*) filter (l_discount < 0.03) as docs, 100.0 * count(*) filter (l_quantity > 20) / count(*) as parser, count(*) filter (l_tax = 0.08) as asym,"
    " count(*) filter (l_linestatus = 'O') as diagnosed, 100.0 * count(*) filter (l_returnflag = 'A') / count(*) as hit from lineitem group by 1),"
    " h as (select *, (callees >= 40)::int + (tests >= 20)::int + (endpoints > 0)::int + (types > 0 or (chunks > 0 and docs * 100.0 / chunks >= 30))::int as healthy from g)"
    f" select case when chunks = 0 then 'red' when good * 100.0 / n < 70 then 'yellow' else 'green' end as scope, case when chunks = 0 then 'gray' else {_light('healthy', 3, 2)} end as depth,"
    f" case when parser < 50 then 'red' when asym > 0 then 'yellow' else 'green' end as quality, case when diagnosed = 0 then 'gray' else {_light('hit', 50, 20)} end as impact, count(*) as n from h group by all",
    "issue_verdict_text": f"with {_ANALYSIS}, v as (select *, cited || '/' || total_used as share, case when tests > 0 then ', ' || tests || ' named' else '' end as deep from a)"
    " select key, case when severity = 'INFO' then 'warn: template, not analysed' when callers > 6 then 'warn: no valid answer after all retries' when total_used = 0 then 'warn: no code context was found'"
    " when cited = 0 and confidence = 'high' then 'warn: sure but cites ' || share || case when classification = 'false_positive' then ', review the false positive' else ', review' end"
    " when cited > 0 and cited < total_used then 'warn: partly cited ' || share || deep when cited > 0 then 'ok: cited ' || share || deep end as verdict from v",
    "trust_signals": f"with {_TRUST} select * from t",
    "overall_verdict": f"with {_TRUST}, c as (select component, 2 * count(*) as created, count(*) filter (severity = 'BLOCKER' and callers > 6) as failed from a group by 1)"
    " select component, case when failed > 0 then 'red' when low + partial > created // 2 then 'yellow' when high / greatest(created, 1) >= 0.7 then 'green' else 'yellow' end as light,"
    " case when failed > 0 then 'low' when low + partial <= created // 2 and high / greatest(created, 1) >= 0.7 then 'high' else 'medium' end as level from t join c using (component)",
    "normalize_llm_json": r"""with c as (select *, (conv_id * 3 + turn) % 9 as kind from conversations)
 select conv_id, turn, case kind when 0 then 'empty_llm_text' when 2 then 'thinking_unterminated' when 3 then 'no_json_block' when 5 then 'json_decode_error' when 7 then 'parsed_but_empty' else case when trim(coalesce(text, '')) = '' then 'parsed_but_empty' else 'ok' end end as parse_status,
 case when kind in (0, 2, 3, 5) then '' when kind = 4 then 'a\d' || chr(10) || 'T' || turn else 'T' || turn end as title, case when turn > 1 then case when kind in (0, 2, 3, 5) then 'medium' else 'high' end else 'low' end as confidence,
 case when kind in (0, 2, 3, 5) then case when turn > 1 then '' else 'context:empty' end else role || case when turn > 1 then '' else ',context:empty' end end as labels, md5(case when kind in (0, 2, 3, 5, 7) then '' else coalesce(text, '') end) as impact_md5 from c""",
    "metadata_hits": r"""with w as (select doc_id, text, string_split(text, ' ') as w from documents where text is not null), x as (select doc_id, coalesce(w[1], '') as w0, coalesce(w[2], '') as w1, coalesce(w[3], '') as w2, coalesce(w[4], '') as w3, coalesce(w[5], '') as w4, coalesce(w[6], '') as w5, text || ' POST `' || coalesce(w[2], '') || '`' as t from w),
 n as (select doc_id, t, regexp_extract('POST ' || w0, '^\S+\s+((?s:.+))$', 1) as p0, regexp_extract('GET ' || w3, '^\S+\s+((?s:.+))$', 1) as p3, w1, w2, trim(regexp_extract(ltrim('@' || w1 || '(a)', '@'), '^([^(]*)', 1)) as d1, trim(regexp_extract(ltrim('@' || w1, '@'), '^([^(]*)', 1)) as d2,
 list_filter(list_transform(regexp_split_to_array(regexp_replace('@' || w4 || '(x) @nowhere', '^ +| +$', '', 'g'), '\s+'), lambda y: trim(regexp_extract(ltrim(y, '@'), '^([^(]*)', 1))), lambda y: length(y) >= 3 and contains(t, y))[1] as r4,
 list_filter(list_transform(regexp_split_to_array(regexp_replace('@nowhere @' || w5, '^ +| +$', '', 'g'), '\s+'), lambda y: trim(regexp_extract(ltrim(y, '@'), '^([^(]*)', 1))), lambda y: length(y) >= 3 and contains(t, y))[1] as r5 from x),
 h as (select doc_id, case when p0 <> '' and contains(t, p0) then 2 else 0 end as endpoint_hits, len(list_filter(list_distinct([d1, d2, 'zz.nowhere']), lambda y: length(y) >= 3 and contains(t, y)))::int as decorator_hits,
 len(list_filter(list_distinct([trim(w1), trim(w2)]), lambda y: length(y) >= 3 and contains(t, '`' || y || '`')))::int as param_hits, len(list_distinct(list_filter([case when p3 <> '' and contains(t, p3) then p3 end, r4, r5], lambda y: y is not null)))::int as rag_meta_hits from n)
 select *, endpoint_hits + decorator_hits + param_hits + rag_meta_hits as total_hits from h""",
    "build_query_text": r"""with x as (select p_partkey, p_size, case when p_size > 5 then string_split('a' || chr(10) || 'b' || chr(10) || 'c' || chr(10) || 'd' || chr(10) || '  >> ' || replace(p_type, ' ', chr(10)) || chr(10) || 'x' || chr(10) || 'y' || chr(10) || 'z', chr(10)) end as l,
 case when p_size > 10 then p_name end as f, 'path: src/' || p_brand as path, p_type as rule, p_name as msg, case when p_size > 30 then 'endpoint: GET /' || p_brand end as ep, p_brand from part)
 select p_partkey, 0 as attempt, concat_ws(chr(10), array_to_string(l[2:8], chr(10)), 'function: ' || f, 'callees: ' || f, 'test_for: ' || f, 'is_test: true', path, rule, ep, 'decorators: app.route', 'params: ' || p_brand, 'callers, routes, handlers and tests of ' || f) as query from x
 union all select p_partkey, 1, concat_ws(chr(10), rule, msg, 'function: ' || f, path) from x union all select p_partkey, 2, concat_ws(chr(10), coalesce(f, rule), 'callees: ' || f, 'callers: ' || f, ep) from x""",
    "render_prompt_context": "with x as (select *, list_transform(range(1, s_nationkey + 2), lambda i: 'f' || i) as near from supplier)"
    f" select s_suppkey, case when s_nationkey > 2 then '## Dependency graph (depth 2)' || chr(10) || 'callers:' || chr(10) || {_bulleted('near', 8)} || case when s_nationkey > 12 then chr(10) || 'their callers:' || chr(10) || {_bulleted('near', 5)} else '' end else '' end as dependency_tree,"
    f" case when s_acctbal > 0 then '## Git history' || chr(10) || s_name || case when s_acctbal > 5000 then chr(10) || 'earlier fixes of the rule:' || chr(10) || {_bulleted('near', 3)} else '' end else '' end as git_history,"
    f" case when s_nationkey < 20 then '## Same rule elsewhere (' || len(near) || ')' || chr(10) || {_bulleted('list_transform(near, lambda y: y || chr(58) || s_nationkey)', 5)} else '' end as similar_places,"
    " case when s_acctbal < 1000 then '## Project overview' || chr(10) || s_name else '' end as overview_text,"
    " '- decorators: ' || array_to_string(near[1:5], ', ') || chr(10) || '- HTTP route: POST /x' || chr(10) || '- internal callees: ' || array_to_string(near[1:8], ', ') as static_facts from x",
    "clean_target": "select p_partkey, case when p_size % 7 = 2 then '' else p_name end as target from part",
    "page_selector_score": f"with {_SELECTORS} select p_brand, count(*) filter (grade <> 'skipped') as scored, round(coalesce(count(*) filter (grade = 'exact') / nullif(count(*) filter (grade <> 'skipped'), 0), 0), 6) as accuracy,"
    " round(coalesce(count(*) filter (grade = 'partial') / nullif(count(*) filter (grade <> 'skipped'), 0), 0), 6) as partial_rate from r group by 1",
    "clean_page_text": r"""with a as (select page_id, regexp_replace(regexp_extract(html, '<article>((?s:.*))</article>', 1), '(<[^>]+>)+', chr(10), 'g') as t from pages),
 u as (select page_id, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') as t from a),
 b as (select page_id, regexp_replace(regexp_replace(regexp_replace(t, '\[([^\]]+)\]\(https?://\S+\)', '\1', 'g'), 'https?://\S+', '', 'g'), '\[\d+\]|\[편집\]', '', 'g') as t from u)
 select page_id, md5(regexp_replace(regexp_replace(t, '\n\s*\n', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) as text_md5 from b""",
    "filter_short_pages": "select doc_id, substr('tech_' || translate('h.' || source || '/' || lang || '/' || doc_id, '/.', '__'), 1, 105) || '.md' as file_name, md5('# Source: https://h.' || source || '/' || lang || '/' || doc_id || chr(10) || chr(10) || text) as content_md5 from documents where length(text) >= 300",
    "domain_entities": "with u as (select l_suppkey as s_suppkey, count(*) as n from lineitem group by 1), k as (select s_suppkey as ordinal, ['UserModel', 'OrderService', 'Cart', 'DataHandler', 'PriceDTO'][s_suppkey % 5 + 1] as symbol, ['class', 'function', 'type', 'interface'][s_nationkey % 4 + 1] as kind, coalesce(n, 0) as n_callers, s_nationkey from supplier left join u using (s_suppkey))"
    " select ordinal, symbol, kind, n_callers from k where kind <> 'function' and (symbol in ('UserModel', 'PriceDTO') or (s_nationkey > 12 and symbol = 'Cart')) order by n_callers desc, ordinal limit 10",
    "redirect_merge": "with r as (select user_id, arg_max(event_id, event_id) as last from events where event_type = 'error' group by 1) select event_id, case when event_type = 'view' and last is not null then '[redirect:errorMsg] e' || last end as dialog_text from events left join r using (user_id) where event_type <> 'error'",
    "snk_url_exports": "with p as (select url, regexp_extract(url, '^([a-z]+)://', 1) as source from pages) select form, source, count(*) as n, min(url) as first_url, max(url) as last_url from p, (values ('csv'), ('json')) f(form) group by all",
    "norm_outcome": "select event_id, case when value < 90 and event_id % 7 < 4 then 'fail' else 'pass' end as outcome from events",
    "criteria_mode": "select event_id, case when event_type = 'view' then 'dsl' when event_type = 'click' and coalesce(props, '') <> '' then case when contains(props, 'json.') or contains(props, 'status_code=') or contains(props, 'raw~r/') then 'dsl' else 'geval' end else 'none' end as mode from events",
    "failure_reason_class": "select event_id, case event_id % 7 when 0 then 'policy' when 1 then 'format' when 2 then 'connection' when 3 then 'task' else case when not value > 1 then 'task' when event_id % 7 = 4 then 'relevancy' when event_id % 7 = 5 then 'metric' else 'other' end end as reason from events",
    "hybrid_retrieve": f"with d as (select doc_id, {_TOKENS} as ws from documents), q as (select item_id as query_id, unnest(list_distinct({_TOKENS})) as w from benchmark), st as (select count(*) as n, avg(len(ws)) as mean from d),"
    " t as (select doc_id, dl, w, count(*) as tf from (select doc_id, len(ws) as dl, unnest(ws) as w from d) where w in (select w from q) group by all), f as (select w, count(*) as df from t group by 1),"
    " s as (select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / mean))), 6) as score from t join f using (w) join q using (w), st group by all),"
    " k as (select query_id, doc_id, round(score / max(score) over (partition by query_id), 4) as w from s qualify row_number() over (partition by query_id order by score desc, doc_id) <= 50),"
    " e as (select vec_id, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from embeddings), c as (select a.vec_id as query_id, b.vec_id as doc_id, round(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 4) as v from e a join e b on a.i = b.i and a.vec_id <> b.vec_id where a.vec_id in (select item_id from benchmark) group by all),"
    " g as (select * from c qualify row_number() over (partition by query_id order by v desc, doc_id) <= 50), m as (select coalesce(g.query_id, k.query_id) as query_id, coalesce(g.doc_id, k.doc_id) as doc_id, round(0.7::double * coalesce(v, 0) + (1 - 0.7::double) * coalesce(w, 0), 6) as score from g full join k on g.query_id = k.query_id and g.doc_id = k.doc_id),"
    " r as (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from m where score >= 0.25) select query_id, doc_id, rank, score from r where rank <= 15",
}
