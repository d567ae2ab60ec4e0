"""Queries on pages, documents and embeddings: crawl, retrieval and set operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions import text as T
from assayline.operators import crawl, retrieval
from assayline.sources.tables import table


def normalize_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", crawl.normalize_url(F.col("url")).alias("url"))


def url_scope_filter(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return p.where(crawl.in_scope(F.col("url"), "https", "example.com", True)).select("page_id")


def page_outlinks(spark: SparkSession, d: str) -> DataFrame:
    return crawl.outlinks(table(spark, d, "pages"))


def internal_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of each page that stay on its host, at most 50 by name."""
    p = table(spark, d, "pages")
    own = p.select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"))
    hits = crawl.outlinks(p).join(own, "page_id").where(F.contains("link", "host") & ~F.contains(F.col("link"), F.lit("action=")))
    return retrieval.top_n(hits, "page_id", ["link"], 50).select("page_id", "link")


def path_tree(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"))
    return crawl.path_tree(p)


def crawl_parent(spark: SparkSession, d: str) -> DataFrame:
    """Pages of one language in order, each the parent of the page twice its number."""
    p = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("url"), F.when(F.col("page_id") > 0, F.floor(F.col("page_id") * F.lit(2)).cast("string")).alias("parent_url"))
    return crawl.with_parent(p).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def crawl_distribution(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select(F.size(F.filter(F.split(F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1), "/"), lambda x: x != "")).alias("depth"), F.regexp_extract("url", "^([a-z]+)://", 1).alias("source"))
    g = p.groupingSets([[F.col("depth")], [F.col("source")]], F.col("depth"), F.col("source")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.coalesce(F.col("depth").cast("string"), F.col("source")).alias("label"), "n")


def strip_html_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(T.strip_html(F.col("html"))).alias("text_md5"))


def strip_text_urls(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").select("doc_id", F.md5(crawl.strip_text_urls(F.col("text"))).alias("text_md5"))
    return c


#: Put before pages by their id, so that all verdicts occur.
_SIGNS = (
    "", "<script src=hCaptcha.js></script>", "<template shadowrootmode='closed'></template>", "<script>new WebSocket(u); alert(1); confirm(2)</script>", "<iframe></iframe><iframe></iframe>",
    "<iframe></iframe><iframe></iframe><iframe></iframe>", "<script>x.attachShadow({mode: 'closed'}); new EventSource(u)</script>", "<script>new EventSource(u)</script>",
)


def compat_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Verdict and reasons of each page behind what one in eight of them has put before it."""
    marked = F.concat(F.element_at(F.array(*map(F.lit, _SIGNS)), (F.col("page_id") % 8 + 1).cast("int")), F.coalesce("html", F.lit("")))
    told = table(spark, d, "pages").select(crawl.compat_verdict(crawl.static_signals(marked)).alias("v"))
    return told.groupBy(F.col("v.verdict").alias("verdict"), F.array_join("v.reasons", "; ").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def keyword_score(spark: SparkSession, d: str) -> DataFrame:
    """The 15 best documents of each benchmark item's words."""
    return retrieval.bm25(table(spark, d, "documents").select("doc_id", "text"), _queries(spark, d), 15).select("query_id", "doc_id", "score")


def vector_score(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of every vector with the centroid of its label."""
    e = table(spark, d, "embeddings")
    return e.join(retrieval.centroids(e), "label").select("vec_id", "label", F.round(retrieval.cosine(F.col("embedding"), F.col("centroid")), 6).alias("score"))


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """Each label asks for its centroid (vectors) and, as keyword score, for the share of the longest document."""
    e = table(spark, d, "embeddings")
    v = e.join(retrieval.centroids(e), "label").select(F.col("label").alias("query_id"), F.col("vec_id").alias("doc_id"), retrieval.cosine(F.col("embedding"), F.col("centroid")).alias("score"))
    longest = table(spark, d, "documents").agg(F.max("n_chars").alias("m"))
    w = table(spark, d, "documents").join(longest, F.lit(True)).select((F.col("doc_id") % 10).cast("int").alias("query_id"), "doc_id", (F.col("n_chars") / F.col("m")).alias("score"))
    return retrieval.hybrid_topk(v, w)


def topn_per_group(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.top_n(table(spark, d, "documents"), "source", [F.desc("n_chars"), F.col("doc_id")], 3).select("source", "doc_id", "rank")


def token_budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long").alias("tokens"))
    return retrieval.budget_prefix(docs, "source", "doc_id", "tokens", 4000).select("source", "doc_id", "running")


def fit_token_budget(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as the elements of a page, the longer the higher the user's number."""
    e = table(spark, d, "events")
    role = F.expr("case event_type when 'view' then 'heading' when 'click' then 'button' when 'purchase' then 'link' when 'error' then 'option' else 'textbox' end")
    width = ((F.floor("value") + 20) * (1 + F.col("user_id") % 40)).cast("long")
    items = e.select(F.col("user_id").alias("page"), F.col("event_id").alias("ordinal"), role.alias("role"), (F.col("value") <= 60).alias("visible"), (F.col("event_id") % 9 != 0).alias("enabled"), width.alias("chars"))
    return retrieval.fit_budget(items, "page", "ordinal", 4000, frame=300, note=80).select("page", "ordinal", "stage", "truncated")


ROLES = ("button", "heading", "link", "option", "region", "searchbox", "custom")


def prune_inventory(spark: SparkSession, d: str) -> DataFrame:
    """A source's documents as the elements of a page."""
    docs = table(spark, d, "documents")
    role = F.element_at(F.array(*(F.lit(r) for r in ROLES)), (F.col("doc_id") % 7 + 1).cast("int"))
    items = docs.select(F.col("source").alias("page"), "doc_id", role.alias("role"), F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("name"), "text", (F.col("n_chars") > 400).alias("visible"), (F.col("n_chars") < 20000).alias("enabled"))
    return retrieval.prune(items, "page", "doc_id", {"button": 3, "region": 2}, drop_disabled=True).select("page", "doc_id", "role", "rank")


def citation_match(spark: SparkSession, d: str) -> DataFrame:
    """How each page's source cites its own path, host or last path segment."""
    p = table(spark, d, "pages")
    tier = retrieval.citation_tier(F.col("html"), F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1), F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1))
    return p.groupBy(F.coalesce(tier, F.lit("none")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def keyword_coverage(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.split("text", " ").alias("words"))
    return b.join(table(spark, d, "documents"), "doc_id").select("doc_id", F.round(retrieval.keyword_coverage(F.col("words"), F.col("text")), 6).alias("coverage"))


def citation_depth(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of each document, whose words before a full stop stand between backticks here."""
    answer = F.regexp_replace("text", r"([A-Za-z]+)\.", "`$1`")
    return table(spark, d, "documents").select("doc_id", retrieval.citation_depth(answer).alias("depth"))


# --- set operations and rankings -----------------------------------------------------------


def set_union(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers of each nation, the first source of a nation and balance class kept."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.floor(F.col("c_acctbal") / 1000).alias("class"), F.lit(0).alias("source"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 1000).alias("class"), F.lit(1).alias("source"))
    return c.unionByName(s).groupBy("nation", "class").agg(F.min("source").alias("source"))


def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.where("l_returnflag = 'R'").select("l_partkey").intersect(li.where("l_returnflag = 'A' and l_quantity > 45").select("l_partkey"))


def set_except(spark: SparkSession, d: str) -> DataFrame:
    """Nations of customers, as often as they occur, without one for each that has a supplier with a high balance."""
    rich = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("key"))
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("key")).exceptAll(rich)


def set_full(spark: SparkSession, d: str) -> DataFrame:
    """Parts in either of two quantity classes, and in which."""
    li = table(spark, d, "lineitem")
    a = li.where("l_quantity > 48").select("l_partkey").distinct().withColumn("a", F.lit(True))
    b = li.where("l_quantity < 3").select("l_partkey").distinct().withColumn("b", F.lit(True))
    return a.join(b, "l_partkey", "full").select("l_partkey", F.coalesce("a", F.lit(False)).alias("in_a"), F.coalesce("b", F.lit(False)).alias("in_b"))


def run_listing(spark: SparkSession, d: str) -> DataFrame:
    """Live rows win over stored ones of the same id; newest first, at most 100."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").cast("date").cast("string").alias("day"), F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("priority"), F.col("o_orderkey").alias("run"))
    best = o.groupBy("id").agg(F.min(F.struct("priority", (-F.col("run")).alias("r"), "day")).alias("m"))
    return best.select("id", F.col("m.day").alias("day"), (-F.col("m.r")).alias("run"), F.col("m.priority").alias("priority")).orderBy(F.desc("day"), "id").limit(100)


def topk(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_partkey").limit(10)


def join_rule_dim(spark: SparkSession, d: str) -> DataFrame:
    """Line items by brand and supplier region: facts joined to their dimensions, aggregated before the wide join."""
    li = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name")
    j = li.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy("p_brand", "r_name").agg(F.sum("n").alias("items"), F.sum("qty").alias("qty"))


def rank_first(spark: SparkSession, d: str) -> DataFrame:
    """The first event of each user and type."""
    e = table(spark, d, "events")
    return e.groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_url, url_scope_filter, page_outlinks, internal_links, path_tree, crawl_parent, crawl_distribution, strip_html_text, strip_text_urls, compat_verdict, keyword_score, vector_score, hybrid_topk, topn_per_group,
        token_budget_prefix, fit_token_budget, prune_inventory, citation_match, keyword_coverage, citation_depth, set_union, set_intersect, set_except, set_full, run_listing, topk, join_rule_dim, rank_first,
    )
}

_TRASH = ", ".join(f"'{t}'" for t in crawl.TRASH)
_ENDINGS = "|".join(e.replace(".", r"\.") for e in crawl.SKIPPED_ENDINGS)
_HOST, _PATH = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)", "regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"
_LINKS = (
    "h as (select page_id, url, unnest(regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"#]+)', 1)) as href from pages),"
    " k as (select distinct page_id, case when regexp_matches(href, '^[a-z]+://') then href when starts_with(href, '/') then regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || href end as link from h), links as (select * from k where link is not null)"
)
_STRIP = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
for _ref, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _STRIP = f"replace({_STRIP}, '{_ref}', '{_char}')"
_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda x: x <> '')"
_CENTROID = "c as (select label, i, avg(x::double) as x from (select label, unnest(embedding) as x, unnest(range(len(embedding))) as i from embeddings) group by all)"
_COSINE = f"{_CENTROID}, v as (select vec_id, label, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from embeddings), cs as (select vec_id, label, sum(v.x * c.x) / (sqrt(sum(v.x * v.x)) * sqrt(sum(c.x * c.x))) as score from v join c using (label, i) group by all)"

SQL = {
    "normalize_url": "with p as (select page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) as s, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) as h, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as p, regexp_extract(url, '\\?([^#]*)', 1) as q from pages),"
    f" k as (select *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' and lower(string_split(x, '=')[1]) not in ({_TRASH}))) as ks from p)"
    " select page_id, s || '://' || case when s = 'http' then regexp_replace(h, ':80$', '') when s = 'https' then regexp_replace(h, ':443$', '') else h end || case when p = '' then '/' else p end || case when len(ks) > 0 then '?' || array_to_string(ks, '&') else '' end as url from k",
    "url_scope_filter": f"select page_id from pages where starts_with(url, 'https://') and ({_HOST} = 'example.com' or ends_with({_HOST}, '.example.com')) and not regexp_matches(lower({_PATH}), '({_ENDINGS})$')",
    "page_outlinks": f"with {_LINKS} select page_id, link from links",
    "internal_links": f"with {_LINKS}, o as (select page_id, {_HOST} as host from pages), r as (select page_id, link, row_number() over (partition by page_id order by link) as r from links join o using (page_id) where contains(link, host) and not contains(link, 'action=')) select page_id, link from r where r <= 50",
    "path_tree": f"with u as (select {_HOST} as host, list_filter(string_split({_PATH}, '/'), lambda x: x <> '') as p from pages), e as (select host, p, unnest(range(len(p) + 1))::int as depth from u) select host, '/' || array_to_string(p[1:depth], '/') as prefix, depth, count(*) filter (depth = len(p)) as own, count(*) as below from e group by all",
    "crawl_parent": "select case when page_id = 0 then 'root' when page_id * 2 in (select page_id from pages) then 'child' else 'orphan' end as state, count(*) as n from pages group by 1",
    "crawl_distribution": f"with p as (select len(list_filter(string_split({_PATH}, '/'), lambda x: x <> '')) as depth, regexp_extract(url, '^([a-z]+)://', 1) as source from pages) select coalesce(depth::varchar, source) as label, count(*) as n from p group by grouping sets ((depth), (source))",
    "strip_html_text": f"select page_id, md5(trim(regexp_replace({_STRIP}, '[ \\t\\n\\r\\f]+', ' ', 'g'))) as text_md5 from pages",
    "strip_text_urls": "select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\\[([^\\]]*)\\]\\(https?://[^)]*\\)', '\\1', 'g'), 'https?://\\S+', '', 'g'), '\\[\\d+\\]', '', 'g')) as text_md5 from documents",
    "compat_verdict": "with p as (select page_id % 8 as k, lower(html) as h from pages), r as (select k, len(regexp_extract_all(h, '<iframe')) as f, len(regexp_extract_all(h, '(?:alert|confirm|prompt)[(]')) as q, regexp_matches(h, 'recaptcha|hcaptcha|turnstile') as c from p),"
    " s as (select case when c or k = 1 then 'incompatible:captcha' when k in (2, 6) then 'incompatible:closed-shadow' end as bad, case when c or k = 1 then 'captcha' when k in (2, 6) then 'closed_shadows: 1' end as why,"
    " list_filter([case when k = 3 then 'sockets: 1' end, case when k = 7 then 'event_sources: 1' end, case when q + 2 * (k = 3)::int > 0 then 'dialogs: ' || (q + 2 * (k = 3)::int) end, case when f + 2 * (k = 4)::int + 3 * (k = 5)::int > 2 then 'frames: ' || (f + 2 * (k = 4)::int + 3 * (k = 5)::int) end], lambda x: x is not null) as l from r)"
    " select coalesce(bad, case when len(l) > 0 then 'limited' else 'compatible' end) as verdict, coalesce(why, array_to_string(l, '; ')) as reasons, count(*) as n from s group by all",
    "keyword_score": f"with d as (select doc_id, {_TOKENS} as ws from documents), q as (select item_id as query_id, unnest(list_distinct({_TOKENS})) as w from benchmark), st as (select count(*) as n, avg(len(ws)) as mean from d),"
    " t as (select doc_id, dl, w, count(*) as tf from (select doc_id, len(ws) as dl, unnest(ws) as w from d) where w in (select w from q) group by all), f as (select w, count(*) as df from t group by 1),"
    " s as (select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / mean))), 6) as score from t join f using (w) join q using (w), st group by all),"
    " r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as r from s) select query_id, doc_id, score from r where r <= 15",
    "vector_score": f"with {_COSINE} select vec_id, label, round(score, 6) as score from cs",
    "hybrid_topk": f"with {_COSINE}, m as (select max(n_chars) as m from documents), w as (select (doc_id % 10)::int as query_id, doc_id, n_chars / m as s from documents, m), b as (select coalesce(cs.label, w.query_id) as query_id, coalesce(cs.vec_id, w.doc_id) as doc_id, round(0.7::double * coalesce(cs.score, 0) + (1 - 0.7::double) * coalesce(w.s, 0), 6) as score from cs full join w on cs.vec_id = w.doc_id and cs.label = w.query_id),"
    " r as (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from b where score >= 0.25) select query_id, doc_id, rank, score from r where rank <= 15",
    "topn_per_group": "select source, doc_id, rank from (select source, doc_id, row_number() over (partition by source order by n_chars desc, doc_id)::int as rank from documents) where rank <= 3",
    "token_budget_prefix": "select source, doc_id, running from (select source, doc_id, sum(greatest(1, length(text) // 4)) over (partition by source order by doc_id)::bigint as running from documents) where running <= 4000",
    "fit_token_budget": "with e as (select user_id as page, event_id as ordinal, case event_type when 'view' then 'heading' when 'click' then 'button' when 'purchase' then 'link' when 'error' then 'option' else 'textbox' end as role,"
    " value <= 60 and event_id % 9 <> 0 as usable, (floor(value) + 20)::bigint * (1 + user_id % 40) as chars from events),"
    " a as (select *, role <> 'heading' as c1, role <> 'heading' and usable as c2, role not in ('heading', 'option') and usable as c3 from e),"
    " b as (select *, c3 and row_number() over (partition by page, role, c3 order by ordinal) <= 5 as c4 from a), r as (select *, sum(chars) filter (c4) over (partition by page order by ordinal) as running from b),"
    " t as (select page, sum(chars) as s0, coalesce(sum(chars) filter (c1), -1) as s1, coalesce(sum(chars) filter (c2), -1) as s2, coalesce(sum(chars) filter (c3), -1) as s3, coalesce(sum(chars) filter (c4), -1) as s4 from b group by page),"
    " s as (select page, case when (s0 + 300) // 4 <= 4000 then 0 when s1 < 0 or (s1 + 380) // 4 <= 4000 then 1 when s2 < 0 or (s2 + 380) // 4 <= 4000 then 2 when s3 < 0 or (s3 + 380) // 4 <= 4000 then 3 when s4 < 0 or (s4 + 380) // 4 <= 4000 then 4 else 5 end as stage from t)"
    " select page, ordinal, stage, stage > 0 as truncated from r join s using (page) where case stage when 0 then true when 1 then c1 when 2 then c2 when 3 then c3 when 4 then c4 else c4 and (running + 380) // 4 <= 4000 end",
    "prune_inventory": "with i as (select source as page, doc_id, (['button', 'heading', 'link', 'option', 'region', 'searchbox', 'custom'])[doc_id % 7 + 1] as role, case when lang = 'en' then '' else coalesce(lang, '') end as name, coalesce(text, '') as text from documents where n_chars > 400 and n_chars < 20000),"
    " k as (select * from i where role in ('heading', 'region', 'custom') or regexp_matches(name || text, '\\S')), f as (select page, role, min(doc_id) as doc_id from k group by page, role, case when name <> '' then name else text end),"
    " r as (select *, row_number() over (partition by page, role order by doc_id)::int as n from f)"
    " select page, doc_id, role, case when role not in ('heading', 'custom') then n end as rank from r where n <= case role when 'button' then 3 when 'link' then 20 when 'option' then 12 when 'region' then 2 when 'searchbox' then 5 else n end",
    "citation_match": f"with p as (select html, {_PATH} as path, {_HOST} as host from pages), t as (select case when path <> '' and contains(html, path) then 'path' when host <> '' and contains(html, host) then 'symbol' when length(string_split(path, '/')[-1]) >= 5 and contains(html, string_split(path, '/')[-1]) then 'basename' else 'none' end as tier from p) select tier, count(*) as n from t group by 1",
    "keyword_coverage": "select doc_id, round(len(list_filter(string_split(b.text, ' '), lambda w: contains(lower(d.text), lower(w)))) / len(string_split(b.text, ' ')), 6) as coverage from benchmark b join documents d on d.doc_id = b.item_id",
    "citation_depth": "with a as (select doc_id, regexp_replace(text, '([A-Za-z]+)\\.', '`\\1`', 'g') as t from documents) select doc_id, len(list_distinct(list_filter(regexp_extract_all(t, '`([^`\\s]+)`', 1), lambda x: length(x) between 2 and 80 and regexp_matches(x, '\\pL') and not regexp_matches(x, '[\\[\\]]'))))::int as depth from a",
    "set_union": "with u as (select c_nationkey as nation, floor(c_acctbal / 1000)::bigint as class, 0 as source from customer union all select s_nationkey, floor(s_acctbal / 1000)::bigint, 1 from supplier) select nation, class, min(source) as source from u group by all",
    "set_intersect": "select l_partkey from lineitem where l_returnflag = 'R' intersect select l_partkey from lineitem where l_returnflag = 'A' and l_quantity > 45",
    "set_except": "select c_nationkey as key from customer except all select s_nationkey from supplier where s_acctbal > 5000",
    "set_full": "with a as (select distinct l_partkey from lineitem where l_quantity > 48), b as (select distinct l_partkey from lineitem where l_quantity < 3) select coalesce(a.l_partkey, b.l_partkey) as l_partkey, a.l_partkey is not null as in_a, b.l_partkey is not null as in_b from a full join b on a.l_partkey = b.l_partkey",
    "run_listing": "with o as (select o_custkey as id, o_orderdate::date::varchar as day, case when o_orderstatus = 'O' then 0 else 1 end as priority, o_orderkey as run from orders), r as (select *, row_number() over (partition by id order by priority, run desc) as r from o) select id, day, run, priority from r where r = 1 order by day desc, id limit 100",
    "topk": "select l_partkey, count(*) as n from lineitem group by 1 order by n desc, l_partkey limit 10",
    "join_rule_dim": "select p_brand, r_name, count(*) as items, sum(l_quantity) as qty from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all",
    "rank_first": "select user_id, event_type, arg_min(event_id, (ts, event_id)) as event_id from events group by all",
}
