"""Retrieval scores, context filters and citation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayline.operators.ordered import Ordered
from assayline.sources.workdir import stored


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda x: x != "")


def task_count(spark: SparkSession, pairs: int, most: int = 500_000) -> int:
    """Tasks among which so many scored pairs are dealt: at most about so many each, no fewer than there are cores."""
    return max(spark.sparkContext.defaultParallelism, -(-pairs // most))


def word_counts(docs: DataFrame, known: DataFrame, parts: int) -> DataFrame:
    """docs (doc_id, text) × known (w, ...) → (doc_id, dl, w, tf, ...): how often each known word stands in each document.

    Texts are dealt by doc_id, by which all that follows is grouped, so that neither words nor scores are exchanged. An
    empty word for each document, where it is known, carries the lengths.
    """
    dealt = docs.select("doc_id", "text").repartition(parts, "doc_id")
    words = dealt.select("doc_id", tokens(F.col("text")).alias("ws")).select("doc_id", F.size("ws").alias("dl"), F.explode(F.concat("ws", F.array(F.lit("")))).alias("w"))
    return words.join(known, "w").groupBy("doc_id", "dl", *known.columns).agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 15, k1: float = 1.2, b: float = 0.75, broadcast_words: int = 1_000_000) -> DataFrame:
    """docs (doc_id, text) × queries (query_id, text) → (query_id, doc_id, rank, score): the k best that share a word, ties by doc_id.

    Each task scores its documents whole and passes on its k best of each query. Texts are read twice: for the counts of
    words over all documents, of which only those are kept, and for the scores. Up to broadcast_words asked words go to
    all tasks; beyond, Spark joins by shuffling.
    """
    spark = docs.sparkSession
    asked = stored(queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("w")), "asked-words")
    small = F.broadcast if asked.count() <= broadcast_words else lambda df: df
    parts = task_count(spark, docs.count() * queries.count())
    known = asked.select("w").union(spark.createDataFrame([("",)], "w string")).distinct()
    counts = word_counts(docs, small(known), parts).groupBy("w").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n"), F.sum(F.col("dl") * F.col("tf")).alias("words"))
    counts = stored(counts, "word-counts")
    every = counts.where("w = ''").select("n", F.col("words") / F.col("n")).first()
    n, mean = every or (0, 1)
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = stored(counts.where("w <> ''").select("w", idf.alias("idf")), "word-weights")
    tf = word_counts(docs, small(weighed), parts)
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / (mean or 1)))
    scores = tf.select("doc_id", "w", part.alias("part")).join(small(asked), "w").groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
    return top_n(scores, "query_id", [F.desc("score"), F.col("doc_id")], k)


def centroids(vectors: DataFrame) -> DataFrame:
    """vectors (vec_id, embedding, label) → (label, centroid) by averaging each component."""
    each = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def hybrid_topk(vector: DataFrame, keyword: DataFrame, weight: float = 0.7, least: float = 0.25, k: int = 15) -> DataFrame:
    """vector, keyword (query_id, doc_id, score) → the k best weighted sums over the threshold; a missing score is 0."""
    v, w = vector.withColumnRenamed("score", "v"), keyword.withColumnRenamed("score", "w")
    both = v.join(w, ["query_id", "doc_id"], "full").withColumn("score", F.round(weight * F.coalesce("v", F.lit(0.0)) + (1 - weight) * F.coalesce("w", F.lit(0.0)), 6)).where(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "doc_id", "rank", "score")


def top_n(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def budget_prefix(items: DataFrame, group: str, order: str, cost: str, budget: int, parts: int | None = None) -> DataFrame:
    """Items of each group, in order, before the first with which the running cost goes over the budget. Costs are not
    negative, null is 0. A group of any size is cut into several tasks."""
    o = Ordered(items, group, [F.col(order)], parts)
    own = F.coalesce(cost, F.lit(0))
    return o.sum_before(o.rows, "running", own).withColumn("running", F.col("running") + own).where(F.col("running") <= budget).drop("_pos", "_part")


# Fixed values.
INTERACTIVE_ROLES = ("button", "link", "textbox", "combobox", "checkbox", "radio", "tab", "menuitem", "option", "searchbox", "switch", "slider", "spinbutton")
CONTEXT_ROLES = ("heading", "main", "navigation", "banner", "contentinfo", "region", "form", "search", "complementary")
LOW_ROLES = ("option", "menuitem")
ROLE_LIMITS = {
    "button": 15, "link": 20, "textbox": 15, "combobox": 10, "checkbox": 10, "radio": 10, "tab": 10,
    "option": 12, "menuitem": 10, "searchbox": 5, "switch": 10, "slider": 5, "spinbutton": 5,
}


def fit_budget(items: DataFrame, group: str, order: str, budget: int = 1500, frame: int = 0, note: int = 0, per_role: int = 5, per_token: int = 4, parts: int | None = None) -> DataFrame:
    """items (group, order, role, visible, enabled, chars) cut down until each group fits the budget → those kept, with the
    stage that fitted and whether the group was cut.

    Stages, each on what the one before left: 0 all; 1 without context roles; 2 without what is hidden or disabled; 3
    without options and menu items; 4 the first per_role of each role; 5 those before the first that does not fit. A
    group's tokens are its characters, the frame and from stage 1 on the note, by per_token; at least 1, and 1 if it is
    empty. All stages' sums come from one aggregation. A null is shown and enabled, has no role, 0 characters. A group of
    which nothing is left has no row.
    """
    role, chars = F.coalesce("role", F.lit("")), F.greatest(F.coalesce("chars", F.lit(0)), F.lit(0)).cast("long")
    c1 = ~role.isin(*CONTEXT_ROLES)
    c2 = c1 & F.coalesce("visible", F.lit(True)) & F.coalesce("enabled", F.lit(True))
    c3 = c2 & ~role.isin(*LOW_ROLES)
    within = [F.lit(True), c1, c2, c3]

    def fits(n: Column, total: Column, extra: int) -> Column:
        tokens = F.when(n > 0, F.greatest(F.lit(1), F.floor((total + F.lit(frame + extra)) / per_token))).otherwise(1)
        return tokens <= budget

    sums = [f for i, c in enumerate(within) for f in (F.count_if(c).alias(f"n{i}"), F.coalesce(F.sum(F.when(c, chars)), F.lit(0)).alias(f"s{i}"))]
    totals = items.groupBy(F.col(group).alias("_g")).agg(*sums)
    # The limit on ranks is known to Spark, so that no more than per_role rows a role and input task are exchanged.
    by_role = Window.partitionBy(group, role).orderBy(order)
    first = stored(items.where(c3).withColumn("_r", F.row_number().over(by_role)).where(F.col("_r") <= per_role).drop("_r"), "first-of-role")
    top = first.groupBy(F.col(group).alias("_h")).agg(F.count(F.lit(1)).alias("n4"), F.sum(chars).alias("s4"))
    stage = F.when(fits(F.col("n0"), F.col("s0"), 0), 0)
    for i in range(1, 5):
        stage = stage.when(fits(F.coalesce(f"n{i}", F.lit(0)), F.coalesce(f"s{i}", F.lit(0)), note), i)
    stages = stored(totals.join(top, totals["_g"].eqNullSafe(top["_h"]), "left").select("_g", stage.otherwise(5).alias("stage")), "budget-stages")
    placed = lambda df, which: df.join(stages.where(which), df[group].eqNullSafe(stages["_g"])).drop("_g")
    early = placed(items, "stage < 4")
    early = early.where(F.element_at(F.array(*within), F.col("stage") + 1))
    o = Ordered(placed(first, "stage = 5"), group, [F.col(order)], parts)
    last = o.sum_before(o.rows, "_sum", chars).where(fits(F.lit(1), F.col("_sum") + chars, note)).drop("_sum", "_pos", "_part")
    return early.unionByName(placed(first, "stage = 4")).unionByName(last).withColumn("truncated", F.col("stage") > 0)


def prune(items: DataFrame, group: str, order: str, limits: dict[str, int] | None = None, keep_context: bool = True, drop_invisible: bool = True, drop_disabled: bool = False) -> DataFrame:
    """items (group, order, role, name, text, visible, enabled) → those kept, with their rank in group and role.

    Hidden ones go, disabled ones and context roles if asked; so do controls without a name or text. Of equal roles and
    labels (the name, else the text) in a group the first stays, and of each role the first so many; roles without a limit
    keep all and have no rank. A null is shown and enabled; null names, texts and roles are empty.
    """
    limits = ROLE_LIMITS | (limits or {})
    role, name, text = (F.coalesce(c, F.lit("")) for c in ("role", "name", "text"))
    keep = F.lit(True)
    keep = keep & F.coalesce("visible", F.lit(True)) if drop_invisible else keep
    keep = keep & F.coalesce("enabled", F.lit(True)) if drop_disabled else keep
    keep = keep if keep_context else keep & ~role.isin(*CONTEXT_ROLES)
    keep = keep & ~(role.isin(*INTERACTIVE_ROLES) & ~F.concat(name, text).rlike(r"(?U)\S"))
    label = F.when(name != "", name).otherwise(text)
    row = F.struct(F.col(order).alias("_o"), *items.columns)
    first = items.where(keep).groupBy(F.col(group).alias("_g"), role.alias("_role"), label.alias("_label")).agg(F.min(row).alias("m")).select("m.*", "_role").drop("_o")
    most = F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))
    ranked = first.where(F.col("_role").isin(*limits)).withColumn("rank", F.row_number().over(Window.partitionBy(group, "_role").orderBy(order)))
    ranked = ranked.where((F.col("rank") <= max(limits.values())) & (F.col("rank") <= most[F.col("_role")]))
    free = first.where(~F.col("_role").isin(*limits)).withColumn("rank", F.lit(None).cast("int"))
    return ranked.unionByName(free).drop("_role")


def citation_tier(answer: Column, path: Column, symbol: Column, least: int = 5) -> Column:
    """How an answer cites an item: its path, else its symbol, else its file name if long enough; null if not at all."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.when((path != "?") & (path != "") & F.contains(answer, path), "path").when((symbol != "?") & (symbol != "") & F.contains(answer, symbol), "symbol").when((F.length(base) >= least) & F.contains(answer, base), "basename")


def keyword_coverage(words: Column, text: Column) -> Column:
    """Share of words that the text contains, whatever the case; null without words."""
    hits = F.size(F.filter(words, lambda w: F.contains(F.lower(text), F.lower(w))))
    return hits / F.nullif(F.size(words), F.lit(0))


def citation_depth(answer: Column) -> Column:
    """How many distinct identifiers an answer names between backticks: 2 to 80 characters with a letter, without blanks
    and square brackets."""
    named = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"`([^`\s]+)`"), F.lit(1))
    return F.size(F.array_distinct(F.filter(named, lambda x: F.char_length(x).between(2, 80) & x.rlike(r"\p{L}") & ~x.rlike(r"[\[\]]"))))
