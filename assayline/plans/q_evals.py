"""Queries on documents, labels and conversations, seen as answers under evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions import text as T
from assayline.operators import evals
from assayline.sources.tables import table


def policy_check(spark: SparkSession, d: str) -> DataFrame:
    """Documents that break a policy rule, by the first rule in order."""
    docs = table(spark, d, "documents")
    hit = docs.select("doc_id", T.first_policy_hit(F.col("text")).alias("h")).where("h is not null")
    return hit.select("doc_id", "h.reason", "h.matched")


def policy_values(spark: SparkSession, d: str) -> DataFrame:
    """Policy of answers in JSON: each document's text as a value deep inside, or, for every other one, as a key."""
    docs = table(spark, d, "documents")
    inside = F.to_json(F.struct(F.lit(1).alias("n"), F.array(F.struct(F.array(F.lit("x"), F.col("text")).alias("parts"))).alias("answer")))
    as_key = F.to_json(F.create_map(F.col("text"), F.lit(True)))
    hit = docs.select("doc_id", T.first_policy_hit(F.when(F.col("doc_id") % 2 == 0, inside).otherwise(as_key)).alias("h")).where("h is not null")
    return hit.select("doc_id", "h.reason", "h.matched")


def policy_counts(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "conversations").select(F.col("text")).unionAll(table(spark, d, "documents").select("text"))
    return hits.select(F.coalesce(T.first_policy_hit(F.col("text"))["reason"], F.lit("(none)")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def filter_trivial_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.groupBy("lang", T.is_trivial(F.col("text"), min_chars=400, min_lines=3).alias("trivial")).agg(F.count(F.lit(1)).alias("n"))


def needs_translation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("role", T.needs_translation(F.col("text")).alias("needed")).agg(F.count(F.lit(1)).alias("n"))


def head_tail_cut(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.head_tail(F.col("text"), 2200)).alias("cut_md5"))


def group_conversations(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    cases = c.select(F.concat_ws("-", "conv_id", "turn").alias("case_id"), F.when(F.col("conv_id") % 7 > 0, F.col("conv_id").cast("string")).alias("conversation_id"), "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"))
    return evals.group_conversations(cases)


def transcript(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumnRenamed("conv_id", "conversation_id")
    return evals.transcript(c).select("conversation_id", F.md5("transcript").alias("transcript_md5"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("conversation_id"), "turn", (F.length("text") % 5 == 0).alias("failed"), F.length("text").alias("latency_ms"), (F.length("text") / 4).cast("int").alias("prompt_tokens"), (F.length("text") % 7).alias("completion_tokens"))


def conversation_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return evals.until_first_failure(_turns(spark, d)).select("conversation_id", "turn", "failed")


def eval_totals(spark: SparkSession, d: str) -> DataFrame:
    return evals.totals(_turns(spark, d))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    pairs = F.array(
        F.struct(F.lit("relevancy").alias("metric"), (F.col("quality") * 0.5 + F.col("n_chars") % 50 / 100.0).alias("score")), F.struct(F.lit("toxicity").alias("metric"), (F.col("toxic") * 0.6 + F.col("n_chars") % 30 / 100.0).alias("score")),
        F.struct(F.lit("recall").alias("metric"), (F.col("n_chars") % 100 / 100.0).alias("score")),
    )
    return l.select(F.col("doc_id").alias("case_id"), F.explode(pairs).alias("p")).select("case_id", "p.*")


def threshold_flags(spark: SparkSession, d: str) -> DataFrame:
    return evals.threshold_flags(_scores(spark, d), evals.thresholds(spark)).select("case_id", "metric", F.round("score", 6).alias("score"), "threshold", "passed")


def indicator_rollup(spark: SparkSession, d: str) -> DataFrame:
    return evals.indicator_rollup(evals.threshold_flags(_scores(spark, d), evals.thresholds(spark)))


def calibration(spark: SparkSession, d: str) -> DataFrame:
    return evals.calibration(_scores(spark, d).withColumn("score", F.round("score", 6)))


def borderline_rescore(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    s = e.select(F.col("user_id").alias("case_id"), F.lit(50.0).alias("threshold"), F.col("event_id").alias("sample_no"), F.col("value").alias("score"))
    return evals.rescored(s, margin=25.0)


def golden_scorecard(spark: SparkSession, d: str) -> DataFrame:
    b, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    golden = b.select(F.col("item_id").alias("key"), F.when(F.col("item_id") % 3 == 0, "false_positive").otherwise("true_positive").alias("classification"), F.split("text", " ").alias("keywords"), F.array(F.lit("src1"), F.lit("src2")).alias("paths"))
    analysis = docs.select(F.col("doc_id").alias("key"), F.when(F.col("doc_id") % 4 == 0, "false_positive").otherwise("true_positive").alias("classification"), "text", F.array("source", F.lit("src2")).alias("cited"), F.col("doc_id").alias("ordinal"))
    return evals.scorecard(golden, analysis)


def dataset_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return evals.fingerprint(table(spark, d, "documents"), ["doc_id", "text", "lang", "source"])


def failed_case_topn(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return evals.failed_cases(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"), F.concat_ws("-", "conv_id", "turn").alias("case_id"), F.col("text").alias("message"), (F.length("text") % 5 == 0).alias("failed")))


def criteria_contains(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark item as a 'must include' rule on the document of the same number."""
    b = table(spark, d, "benchmark").select("item_id", F.concat(F.lit("response must include "), F.element_at(F.split("text", "[ \n]"), 2)).alias("criteria"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return b.join(docs, "item_id").select("item_id", T.criteria_mode(F.col("criteria")).alias("mode"), T.criteria_contains(F.col("criteria"), F.col("text")).alias("passed"))


def error_class(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "error", "failed").otherwise("passed")
    message = F.when(F.col("value") > 60, F.concat(F.lit("HTTP 5"), (F.col("event_id") % 10).cast("string"))).otherwise("Metrics failed: x")
    rows = e.select(T.error_class(status, F.when(F.col("event_id") % 11 == 0, "SYSTEM"), message).alias("class"), T.failure_reason(message, F.col("value") > 20).alias("reason"))
    return rows.groupBy("class", "reason").agg(F.count(F.lit(1)).alias("n"))


def extract_answer(spark: SparkSession, d: str) -> DataFrame:
    """The key of an event's JSON text, found as the first of several paths."""
    e = table(spark, d, "events")
    return e.select(evals.first_of(F.col("props"), ("$.answer", "$.k")).cast("int").alias("answer")).groupBy("answer").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (policy_check, policy_values, policy_counts, filter_trivial_chunks, needs_translation, head_tail_cut, group_conversations, transcript, conversation_cutoff, eval_totals, threshold_flags, indicator_rollup, calibration, borderline_rescore, golden_scorecard, dataset_fingerprint, failed_case_topn, criteria_contains, error_class, extract_answer)}

_RULES = [(n, p.replace("'", "''")) for n, p in T.POLICY_RULES]
_EXTRACT = ", ".join(f"nullif(regexp_extract(text, '{p}', 0), '') as h{i}" for i, (_, p) in enumerate(_RULES))
_REASON = "case " + " ".join(f"when h{i} is not null then '{n}'" for i, (n, _) in enumerate(_RULES)) + " end"
_MATCHED = "coalesce(" + ", ".join(f"h{i}" for i in range(len(_RULES))) + ")"
_TRIM = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
_TURNS = "t as (select conv_id as conversation_id, turn, length(text) % 5 = 0 as failed, length(text) as latency_ms, length(text) // 4 as prompt_tokens, length(text) % 7 as completion_tokens from conversations)"
_LIMITS = "lim(metric, op, threshold) as (values " + ", ".join(f"('{m}', '{o}', {v}::double)" for m, o, v in evals.THRESHOLDS) + ")"
_SCORES = (
    "j as (select doc_id as case_id, quality, toxic, n_chars from labels join documents using (doc_id)), s as (select case_id, 'relevancy' as metric, quality * 0.5::double + (n_chars % 50) / 100.0::double as score from j"
    " union all select case_id, 'toxicity', toxic * 0.6::double + (n_chars % 30) / 100.0::double from j union all select case_id, 'recall', (n_chars % 100) / 100.0::double from j)"
)
_FLAGS = f"{_SCORES}, {_LIMITS}, f as (select case_id, metric, score, threshold, case when op = '<=' then score <= threshold else score >= threshold end as passed from s join lim using (metric))"

SQL = {
    "policy_check": f"with x as (select doc_id, {_EXTRACT} from documents) select doc_id, {_REASON} as reason, {_MATCHED} as matched from x where {_MATCHED} is not null",
    "policy_values": f"with j as (select doc_id, case when doc_id % 2 = 0 then json_object('n', 1, 'answer', [{{'parts': ['x', text]}}]) else json_object(text, true) end as js from documents),"
    f" v as (select doc_id, string_agg(t.atom ->> '$', chr(10) order by t.id) as text from j, json_tree(j.js) t where t.atom is not null group by doc_id), x as (select doc_id, {_EXTRACT} from v) select doc_id, {_REASON} as reason, {_MATCHED} as matched from x where {_MATCHED} is not null",
    "policy_counts": f"with x as (select {_EXTRACT} from (select text from conversations union all select text from documents)) select coalesce({_REASON}, '(none)') as reason, count(*) as n from x group by 1",
    "filter_trivial_chunks": f"select lang, length({_TRIM}) < 400 or len(list_filter(string_split({_TRIM}, chr(10)), lambda x: trim(x) <> '')) < 3 as trivial, count(*) as n from documents group by all",
    "needs_translation": "select role, regexp_matches(text, '[一-鿿]') or regexp_matches(text, '[A-Za-z]{4,}') as needed, count(*) as n from conversations group by all",
    "head_tail_cut": "select doc_id, md5(case when length(text) <= 2200 then text else substr(text, 1, 1536) || chr(10) || '...' || chr(10) || right(text, 659) end) as cut_md5 from documents",
    "group_conversations": "with c as (select conv_id || '-' || turn as case_id, case when conv_id % 7 > 0 then conv_id::varchar end as conversation_id, turn, conv_id * 1000 + turn as ordinal from conversations)"
    " select any_value(conversation_id) as conversation_id, count(*) as n_turns, string_agg(case_id, ',' order by turn nulls last, ordinal) as case_ids, count(*) > 1 as multi_turn, min(ordinal) as first_ordinal, conversation_id is null as single from c group by coalesce(conversation_id, '#' || ordinal), conversation_id is null",
    "transcript": "select conv_id as conversation_id, md5(string_agg(upper(role[1]) || role[2:] || ': ' || text, chr(10) order by turn)) as transcript_md5 from conversations group by 1 having count(*) > 1",
    "conversation_cutoff": f"with {_TURNS} select conversation_id, turn, failed from t where not exists (select 1 from t p where p.conversation_id = t.conversation_id and p.turn < t.turn and p.failed)",
    "eval_totals": f"with {_TURNS}, p as (select conversation_id, bool_or(failed) as failed, count(*) as k from t group by 1), c as (select count(*) as conversations, count(*) filter (not failed) as conversations_passed, count(*) filter (k > 1) as multi_turn from p),"
    " e as (select count(*) as turns, count(*) filter (not failed) as turns_passed, min(latency_ms) as latency_min, max(latency_ms) as latency_max, quantile_disc(latency_ms, 0.5) as latency_p50, quantile_disc(latency_ms, 0.95) as latency_p95, quantile_disc(latency_ms, 0.99) as latency_p99, sum(prompt_tokens)::bigint as prompt_tokens, sum(completion_tokens)::bigint as completion_tokens from t)"
    " select *, round(turns_passed / turns, 6) as turn_pass_rate, round(conversations_passed / conversations, 6) as conversation_pass_rate from c, e",
    "threshold_flags": f"with {_FLAGS} select case_id, metric, round(score, 6) as score, threshold, passed from f",
    "indicator_rollup": f"with {_FLAGS}, o as (select metric, case_id, row_number() over (partition by metric order by case_id) as r from f where not passed), g as (select metric, string_agg(case_id::varchar, ',' order by case_id) as failed_cases from o where r <= 10 group by 1)"
    " select metric, threshold, count(*) filter (passed) as passed, count(*) filter (not passed) as failed, count(*) filter (passed is null) as skipped, round(avg(score), 6) as mean_score, coalesce(any_value(failed_cases), '') as failed_cases from f left join g using (metric) group by all",
    "calibration": f"with {_SCORES}, q as (select metric, round(score, 6) as score from s) select coalesce(metric, '(all)') as metric, count(*) as n, round(avg(score), 6) as mean, round(coalesce(stddev_samp(score), 0), 6) as std, min(score) as min, max(score) as max from q group by grouping sets ((metric), ())",
    "borderline_rescore": "with g as (select user_id as case_id, arg_min(value, event_id) as f, median(value) as m from events group by 1) select case_id, abs(f - 50) <= 25 as borderline, case when abs(f - 50) <= 25 then m else f end as score from g",
    "golden_scorecard": "with g as (select item_id as key, case when item_id % 3 = 0 then 'false_positive' else 'true_positive' end as cls, string_split(text, ' ') as kw from benchmark), a as (select doc_id as key, doc_id as id from documents),"
    " r as (select g.*, case when d.doc_id % 4 = 0 then 'false_positive' when d.doc_id is not null then 'true_positive' end as acls, d.text, list_distinct([d.source, 'src2']) as cited from g left join a using (key) left join documents d on d.doc_id = a.id)"
    " select count(*) as golden, count(text) as matched, round(avg((cls = acls)::int), 6) as accuracy, round(avg(len(list_filter(kw, lambda w: contains(lower(text), lower(w)))) / len(kw)), 6) as keyword_coverage, round(avg(case when text is not null then len(list_intersect(['src1', 'src2'], cited)) / 2 end), 6) as cited_precision from r",
    "dataset_fingerprint": "select count(*) as rows, sum(('0x' || substr(md5(concat_ws(chr(31), doc_id::varchar, text, lang, source)), 1, 14))::hugeint)::varchar as digest from documents",
    "failed_case_topn": "select conv_id * 1000 + turn as ordinal, conv_id || '-' || turn as case_id, substr(text, 1, 200) as message from conversations where length(text) % 5 = 0 order by ordinal limit 10",
    "criteria_contains": "with b as (select item_id, regexp_split_to_array(text, '[ \\n]')[2] as w from benchmark) select item_id, 'geval' as mode, contains(lower(regexp_replace(d.text, '\\s+', '', 'g')), lower(w)) as passed from b join documents d on d.doc_id = b.item_id",
    "error_class": "with m as (select event_type, event_id, value, case when value > 60 then 'HTTP 5' || (event_id % 10) else 'Metrics failed: x' end as msg from events)"
    " select case when event_type <> 'error' then '' when event_id % 11 = 0 then 'system' when contains(msg, 'HTTP 5') then 'system' else 'quality' end as class, case when not (value > 20) then 'task' when contains(msg, 'Metrics failed') then 'metric' else 'other' end as reason, count(*) as n from m group by all",
    "extract_answer": "select json_extract_string(props, '$.k')::int as answer, count(*) as n from events group by 1",
}
