"""The knowledge base of code chunks and the rules on paths, labels and answers that go with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Directories whose files are not source.
EXCLUDED_DIRS = tuple(
    ".git .scannerwork node_modules build dist out target .idea .vscode .gradle .next .nuxt .cache .venv venv __pycache__ .pytest_cache .mypy_cache .ruff_cache"
    " vendor vendors 3rdparty third_party bower_components min minified".split()
)
#: Names of minified files.
MINIFIED = r"(?i)(?:\.min\.(?:js|css|mjs)|-min\.(?:js|css)|\.bundle\.(?:js|mjs)|chunk-[0-9a-f]{6,}\.(?:js|mjs)|\.umd\.(?:js|mjs))$"
#: Endings of source files.
SOURCE_ENDINGS = r"(?i)\.(?:py|java|js|jsx|ts|tsx|go|rs|rb|cs|kt|c|cpp|h|hpp|php|html)$"


def skip_reason(path: Column) -> Column:
    """Why a file is left out: dir, minified or extension; null if it is kept."""
    folders = F.split(path, "/")
    inside = F.slice(folders, F.lit(1), F.greatest(F.size(folders) - 1, F.lit(0)))
    return F.when(F.arrays_overlap(inside, F.array(*map(F.lit, EXCLUDED_DIRS))), "dir").when(path.rlike(MINIFIED), "minified").when(~path.rlike(SOURCE_ENDINGS), "extension")


def test_targets(symbol: Column) -> Column:
    """Names that a test of this name may test: test_x gives x, its camel and its Pascal form; testX gives x and X."""
    rest = F.regexp_extract(symbol, "^test_(.+)$", 1)
    pascal = F.array_join(F.transform(F.split(rest, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")
    camel = F.concat(F.lower(F.substring(pascal, 1, 1)), F.substr(pascal, F.lit(2)))
    other = F.regexp_extract(symbol, "^test([A-Z].*)$", 1)
    low = F.concat(F.lower(F.substring(other, 1, 1)), F.substr(other, F.lit(2)))
    return F.array_distinct(F.filter(F.array(rest, camel, pascal, low, other), lambda x: x != ""))


def render_document(chunks: DataFrame, limit: int = 2200, name_width: int = 120) -> DataFrame:
    """chunks (path, symbol, kind, lang, code, callers array) with title and body: code, then footer lines in fixed order."""
    from assayline.functions.text import head_tail

    footer = F.array_compact(F.array(F.concat(F.lit("path: "), "path"), F.concat(F.lit("symbol: "), "symbol"), F.concat(F.lit("kind: "), "kind"), F.concat(F.lit("lang: "), "lang"), F.when(F.size("callers") > 0, F.concat(F.lit("callers: "), F.array_join("callers", ", ")))))
    body = F.concat(head_tail(F.col("code"), limit), F.lit("\n---\n"), F.array_join(footer, "\n"))
    return chunks.select("path", "symbol", F.substring(F.concat_ws("::", "path", "symbol"), 1, name_width).alias("title"), body.alias("body"))


def parse_footer(body: Column) -> Column:
    """The 'key: value' lines after the last '---' line, as a map."""
    lines = F.split(F.element_at(F.split(body, "\n---\n"), -1), "\n")
    pairs = F.filter(F.transform(lines, lambda x: F.struct(F.regexp_extract(x, "^([a-z_]+): (.*)$", 1).alias("k"), F.regexp_extract(x, "^([a-z_]+): (.*)$", 2).alias("v"))), lambda p: p["k"] != "")
    return F.map_from_entries(pairs)


def with_header(chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """chunks (path, symbol, role, code) with '[path] role: summary' ahead of code where there is a summary."""
    joined = chunks.join(summaries, ["path", "symbol"], "left")
    return joined.withColumn("code", F.when(F.col("summary").isNull(), F.col("code")).otherwise(F.concat(F.lit("["), "path", F.lit("] "), "role", F.lit(": "), "summary", F.lit("\n"), "code"))).drop("summary")


def intelligence(chunks: DataFrame) -> DataFrame:
    """chunks (lang, kind, callers int, tests int, doc) → counters for all, by language and by kind, in one pass."""
    g = chunks.groupingSets([[], [F.col("lang")], [F.col("kind")]], F.col("lang"), F.col("kind")).agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("callers") > 0).alias("with_callers"), F.count_if(F.col("tests") > 0).alias("with_tests"), F.count_if(F.length(F.coalesce("doc", F.lit(""))) > 0).alias("with_doc"), F.grouping_id().alias("gid")
    )
    return g.select(F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, "lang").otherwise("kind").alias("scope"), F.coalesce("lang", "kind", F.lit("")).alias("value"), "chunks", "with_callers", "with_tests", "with_doc")


def containing(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """texts (text, …) × patterns (pattern) → each row of texts with each pattern that its text contains, case and all.

    A pattern, of three characters at least, is looked for only in texts that hold the rarest of its runs of three, so
    that thousands of patterns cost one pass over the texts' runs and not a pass each. Patterns are distinct.
    """

    def runs(c: Column) -> Column:
        n = F.char_length(c)
        return F.array_distinct(F.transform(F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(c, i, F.lit(3))))

    wanted = patterns.where(F.char_length("pattern") >= 3).select("pattern").distinct().select("pattern", F.explode(runs(F.col("pattern"))).alias("run"))
    held = texts.select("text").where("text is not null").distinct().select("text", F.explode(runs(F.col("text"))).alias("run")).join(wanted.select("run").distinct(), "run", "left_semi")
    often = held.groupBy("run").count()
    # A run that no text holds is no key of `often`: such patterns are in no text.
    rarest = wanted.join(often, "run", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "run")).alias("m")).where("m.n > 0")
    met = held.join(rarest.select("pattern", F.col("m.run").alias("run")), "run").where(F.contains("text", F.col("pattern"))).select("text", "pattern")
    return texts.join(met, "text")


def rule_history(rules: DataFrame, commits: DataFrame, most: int = 3, least: int = 3) -> DataFrame:
    """rules (rule) × commits (sha, subject, committed) → (rule, sha, rank): the latest commits whose subject contains the
    rule's short key, what follows its last colon. Keys under `least` characters (three or more) are left out."""
    if least < 3:
        raise ValueError("short keys have three characters at least")
    short = rules.select("rule", F.element_at(F.split("rule", ":"), -1).alias("pattern")).where(F.char_length("pattern") >= least).distinct()
    hits = containing(commits.select("sha", F.col("subject").alias("text"), "committed"), short.select("pattern")).join(short, "pattern")
    rank = F.row_number().over(Window.partitionBy("rule").orderBy(F.desc("committed"), "sha"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= most).select("rule", "sha", "rank")


def routes_to_handlers(chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """chunks (symbol, endpoint) with the first endpoint that pairs (handler, endpoint, ordinal) give where it is empty."""
    first = pairs.groupBy("handler").agg(F.min_by("endpoint", "ordinal").alias("route"))
    joined = chunks.join(first, F.col("symbol") == F.col("handler"), "left")
    return joined.withColumn("endpoint", F.coalesce(F.nullif("endpoint", F.lit("")), "route")).drop("handler", "route")


def self_excluded(hits: DataFrame) -> DataFrame:
    """hits (issue_path, issue_line, issue_symbol, path, start_line, end_line, symbol, …) without the chunk of the issue itself.

    By lines where the issue has one, else by symbol, else by path.
    """
    same = F.col("path") == F.col("issue_path")
    own = F.when(same & (F.col("issue_line") > 0) & F.col("start_line").isNotNull(), F.col("issue_line").between(F.col("start_line"), F.col("end_line"))).when(same & (F.coalesce("issue_symbol", F.lit("")) != ""), F.col("symbol") == F.col("issue_symbol")).otherwise(same)
    return hits.where(~F.coalesce(own, F.lit(False)))


def buckets(hits: DataFrame, limit: int = 3) -> DataFrame:
    """hits (issue, is_test, is_caller, score, path): tests, then callers, then others, at most limit of each by score."""
    named = hits.withColumn("bucket", F.when(F.col("is_test"), "tests").when(F.col("is_caller"), "callers").otherwise("others"))
    return named.withColumn("rank", F.row_number().over(Window.partitionBy("issue", "bucket").orderBy(F.desc("score"), "path"))).where(F.col("rank") <= limit)


def downgraded(confidence: Column, cited: Column, used: Column) -> Column:
    """high becomes medium where fewer than half of two items or more are cited; without any item confidence is low."""
    return F.when(used == 0, "low").when((used >= 2) & (cited / used < 0.5) & (confidence == "high"), "medium").otherwise(confidence)


def merged_labels(suggested: Column, severity: Column, classification: Column, confidence: Column, skipped: Column) -> Column:
    """Labels in order, each once, joined by commas."""
    some = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}:"), c))
    own = F.array(some("severity", severity), some("classification", classification), some("confidence", confidence), F.when(skipped, "auto_template:true"))
    return F.array_join(F.array_distinct(F.filter(F.concat(F.coalesce(suggested, F.array().cast("array<string>")), own), lambda x: x.isNotNull() & (x != ""))), ",")


def normalized_usage(usage: Column) -> Column:
    """struct(prompt, completion, total) from camel or snake keys; a missing total is the sum; all zero is null."""
    get = lambda camel, snake: F.coalesce(F.element_at(usage, camel), F.element_at(usage, snake))
    prompt, completion = F.coalesce(get("promptTokens", "prompt_tokens"), F.lit(0)), F.coalesce(get("completionTokens", "completion_tokens"), F.lit(0))
    total = F.coalesce(get("totalTokens", "total_tokens"), prompt + completion)
    return F.when((prompt != 0) | (completion != 0) | (total != 0), F.struct(prompt.alias("prompt"), completion.alias("completion"), total.alias("total")))


def first_line(text: Column, width: int = 300) -> Column:
    """The first line with text, without fenced blocks, backticks and characters beyond the basic plane."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "(?s)```.*?```", " "), "`([^`]*)`", "$1")
    lines = F.filter(F.transform(F.split(plain, "\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), "[\\x{10000}-\\x{10FFFF}]", ""), "\\s+", " "))
    return F.substring(clean, 1, width)


def step_kind(action: Column, target: Column) -> Column:
    """auxiliary for clicks on transient alerts and on next or previous slide, else terminal."""
    leaf = F.trim(F.regexp_replace(F.element_at(F.split(F.coalesce(target, F.lit("")), " >> "), -1), r",\s*(nth|has_text|exact)=.*$", ""))
    name = F.coalesce(F.nullif(F.regexp_extract(leaf, r"^role=[^,]+,\s*name=(.+)$", 1), F.lit("")), F.regexp_extract(leaf, r"^(?:text|label|placeholder|title|alt)=(.+)$", 1))
    slide = name.rlike(r"다음\s*슬라이드|이전\s*슬라이드|(?i)\bnext\s+slide\b|\b(?:prev|previous)\s+slide\b")
    aux = leaf.rlike(r"(?i)^role=alert(?:\s*,.*)?$") | slide
    return F.when((F.lower(F.coalesce(action, F.lit(""))) == "click") & aux, "auxiliary").otherwise("terminal")


def dependency_category(deps: DataFrame, categories: DataFrame) -> DataFrame:
    """deps (name) × categories (priority, category, pattern): the first category with a pattern in the name, else other."""
    hit = deps.select("name").distinct().join(F.broadcast(categories), F.contains(F.lower("name"), F.col("pattern")))
    best = hit.groupBy("name").agg(F.min_by("category", "priority").alias("category"))
    return deps.select("name").distinct().join(best, "name", "left").withColumn("category", F.coalesce("category", F.lit("other")))


def insert_waits(steps: DataFrame, flags: DataFrame) -> DataFrame:
    """steps (session, ordinal, action) with a wait after the k-th click where flags (session, k, wait_ms) has one."""
    w = Window.partitionBy("session").orderBy("ordinal")
    clicks = steps.withColumn("k", F.when(F.col("action") == "click", F.sum(F.when(F.col("action") == "click", 1).otherwise(0)).over(w)))
    waits = clicks.where("k is not null").join(flags, ["session", "k"]).select("session", "ordinal", F.lit("wait").alias("action"), F.lit(1).alias("after"))
    both = steps.select("session", "ordinal", "action", F.lit(0).alias("after")).unionByName(waits)
    return both.withColumn("step", F.row_number().over(Window.partitionBy("session").orderBy("ordinal", "after")))


#: Kinds of chunks that may be entities, endings and places that speak for one, endings against it.
ENTITY_KINDS = ("class", "type", "interface", "struct", "record")
ENTITY_ENDINGS = ("entity", "model", "domain", "dto", "data", "record", "vo")
ENTITY_PLACES = ("/entity/", "/model/", "/domain/", "/core/", "/data/")
OTHER_ENDINGS = ("controller", "service", "repository", "config", "handler", "test", "validator")


def domain_entities(chunks: DataFrame, top: int = 10) -> DataFrame:
    """The most called entities of chunks (path, symbol, kind, n_callers, ordinal); ties in source order."""
    symbol, path = F.lower("symbol"), F.lower(F.concat(F.lit("/"), "path"))
    likely = symbol.rlike(f"({'|'.join(ENTITY_ENDINGS)})$") | path.rlike("|".join(ENTITY_PLACES))
    kept = chunks.where(F.col("kind").isin(*ENTITY_KINDS) & likely & ~symbol.rlike(f"({'|'.join(OTHER_ENDINGS)})$"))
    return kept.orderBy(F.desc("n_callers"), "ordinal").limit(top)
