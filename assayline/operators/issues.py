"""Issues of a static analyser: enriching, clustering, diffing, ranking, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.functions.text import severity_rank
from assayline.operators.ordered import Ordered


def dirname(path: Column) -> Column:
    return F.regexp_replace(F.coalesce(path, F.lit("")), r"/?[^/]*$", "")


def cluster_key(rule: Column, function: Column, component: Column) -> Column:
    """Issues of one rule, function and directory share a key."""
    return F.substring(F.sha1(F.concat_ws("|", F.coalesce(rule, F.lit("")), F.coalesce(function, F.lit("")), dirname(component))), 1, 16)


def cluster_issues(issues: DataFrame, most: int = 50) -> DataFrame:
    """issues (key, rule, function, component, line, severity, ordinal) → leaders with n_affected and their first followers, most at most.

    The leader of a cluster is the most severe, then the first line (null: 0), then the first in input order.
    """
    keyed = issues.withColumn("cluster_key", cluster_key(F.col("rule"), F.col("function"), F.col("component")))
    order = Window.partitionBy("cluster_key").orderBy(severity_rank(F.col("severity")), F.coalesce("line", F.lit(0)), "ordinal")
    ranked = keyed.withColumn("r", F.row_number().over(order))
    near = F.when(F.col("r") <= most + 1, F.struct("r", "key", "component", "line"))  # collect_list leaves nulls out
    followers = ranked.where("r > 1").groupBy("cluster_key").agg(F.array_sort(F.collect_list(near)).alias("affected"), F.count(F.lit(1)).alias("n"))
    lead = ranked.where("r = 1").join(followers, "cluster_key", "left")
    return lead.withColumn("n_affected", F.coalesce("n", F.lit(0)).cast("int")).drop("r", "n")


def new_keys(issues: DataFrame, prior: DataFrame) -> DataFrame:
    """Issues whose key the previous snapshot (key) does not have."""
    return issues.join(prior.select("key"), "key", "left_anti")


def split_existing(issues: DataFrame, filed: DataFrame) -> DataFrame:
    """issues with outcome: skipped where already filed, else created."""
    seen = filed.select("key").distinct().withColumn("seen", F.lit(True))
    return issues.join(seen, "key", "left").withColumn("outcome", F.when(F.col("seen"), "skipped").otherwise("created")).drop("seen")


def similar_locations(issues: DataFrame, most: int = 5) -> DataFrame:
    """(key, similar_key, similar_rank): the first other issues of the same rule, in input order.

    Only the first most + 1 issues of a rule can be anyone's answer, so the other side of the join is that small.
    """
    first = issues.withColumn("r", F.row_number().over(Window.partitionBy("rule").orderBy("ordinal"))).where(F.col("r") <= most + 1)
    other = first.select("rule", F.col("key").alias("similar_key"), F.col("ordinal").alias("o"))
    pairs = issues.select("key", "rule").join(other, "rule").where("key <> similar_key")
    return pairs.withColumn("similar_rank", F.row_number().over(Window.partitionBy("key").orderBy("o"))).where(F.col("similar_rank") <= most).select("key", "similar_key", "similar_rank")


def latest_change(issues: DataFrame, commits: DataFrame, parts: int | None = None) -> DataFrame:
    """issues (key, path, ts) × commits (path, sha, committed) → the last commit of the path up to ts, null if none.

    One pass over both in time order; a file with most of the commits is cut by time into several tasks.
    """
    none = F.lit(None).cast(commits.schema["sha"].dataType)
    asked = issues.select("key", "path", F.col("ts").alias("t"), none.alias("sha"), F.lit(1).alias("side"))
    made = commits.select(F.lit(None).cast(issues.schema["key"].dataType).alias("key"), "path", F.col("committed").alias("t"), "sha", F.lit(0).alias("side"))
    o = Ordered(asked.unionByName(made), "path", [F.col("t"), F.col("side"), F.col("sha")], parts)
    got = o.last_before(o.rows, "m", F.struct(F.col("t").alias("committed"), "sha"), F.col("path").isNotNull() & (F.col("side") == 0))
    return got.where("side = 1").select("key", F.col("m.sha").alias("sha"), F.col("m.committed").alias("committed"))


def _dyadic(low: Column, high: Column) -> Column:
    """The ranges of 2^level lines from a multiple of 2^level on that make up low to high (from 0), as (level, block).

    At each level at most the block at the left edge and that at the right edge are ranges of their own: two a level.
    """

    def at(level: int) -> list[Column]:
        unit = 1 << level
        # What is left at this level once smaller blocks at both edges are cut off.
        left = F.floor((low + (unit - 1)) / unit)
        right = F.floor((high + 1) / unit)
        told = lambda block, is_: F.when(is_ & (left < right), F.struct(F.lit(level).alias("level"), block.cast("long").alias("block")))
        return [told(left, left % 2 == 1), told(right - 1, (right % 2 == 1) & ((left % 2 == 0) | (left < right - 1)))]

    return F.array_compact(F.array(*(c for level in range(31) for c in at(level))))


def containing_ranges(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """points (path, line, …) × ranges (chunk_path, start_line, end_line, …) → each point with each range around it.

    A range is cut into dyadic blocks, at most two of each size, and a point lies in one block of each size that occurs,
    so that an equi-join finds the pairs and only them: no point meets a range that does not hold it. Lines are from 0
    to 2^31 - 2; points and ranges outside, or with a null, meet nothing.
    """
    cut = ranges.where((F.col("start_line") >= 0) & (F.col("start_line") <= F.col("end_line")) & (F.col("end_line") < (1 << 31) - 1))
    cut = cut.withColumn("_b", F.explode(_dyadic(F.col("start_line").cast("long"), F.col("end_line").cast("long")))).withColumn("_level", F.col("_b.level")).withColumn("_block", F.col("_b.block")).drop("_b")
    levels = cut.select("_level").distinct()  # 31 at most
    placed = points.where((F.col("line") >= 0) & F.col("path").isNotNull()).join(F.broadcast(levels)).withColumn("_block", F.expr("shiftright(cast(line as bigint), _level)"))
    return placed.join(cut.withColumnRenamed("_level", "_l").withColumnRenamed("_block", "_k"), (F.col("path") == F.col("chunk_path")) & (F.col("_level") == F.col("_l")) & (F.col("_block") == F.col("_k"))).drop("_level", "_block", "_l", "_k")


def enclosing_chunk(points: DataFrame, chunks: DataFrame) -> DataFrame:
    """points (key, path, line) in chunks (path, symbol, kind, start_line, end_line, ordinal) → the best chunk around each.

    Functions and methods before others, then the shortest, then input order; points in no chunk have null.
    """
    preferred = F.when(F.col("kind").isin("function", "method"), 0).otherwise(1)
    inside = containing_ranges(points, chunks.withColumnRenamed("path", "chunk_path"))
    best = F.struct(preferred.alias("p"), (F.col("end_line") - F.col("start_line")).alias("span"), F.col("ordinal").alias("o"), F.col("symbol").alias("symbol"))
    found = inside.where("symbol is not null").groupBy("key").agg(F.min(best).alias("m"))
    return points.select("key").distinct().join(found, "key", "left").select("key", F.col("m.symbol").alias("symbol"), F.col("m.span").alias("span"))


def snippet_window(points: DataFrame, lines: DataFrame, around: int = 10, clip: int = 400) -> DataFrame:
    """points (key, component, line) × lines (component, line_no, code) → (key, snippet): lines around, the own marked '>>'.

    Lines are laid out once in blocks of so many that a block and its margins hold all that its points ask for: each line
    is in 1.25 blocks on average, whatever around is, and a point meets one block. Nothing else is exchanged but the points.
    """
    block = lambda n: F.floor(n.cast("long") / (8 * around + 1))
    homes = F.explode(F.sequence(block(F.col("line_no") - around), block(F.col("line_no") + around)))
    held = lines.select("component", homes.alias("block"), F.struct("line_no", F.substring("code", 1, clip).alias("code")).alias("l"))
    blocks = held.groupBy("component", "block").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    asked = points.select("key", "component", "line", block(F.col("line")).alias("block"))
    near = F.filter("ls", lambda x: x["line_no"].between(F.col("line") - around, F.col("line") + around))
    text = lambda x: F.concat(F.when(x["line_no"] == F.col("line"), ">> ").otherwise("   "), x["line_no"].cast("string"), F.lit(": "), x["code"])
    found = asked.join(blocks, ["component", "block"]).select("key", F.transform(near, text).alias("ts")).where(F.size("ts") > 0)
    return found.select("key", F.array_join("ts", "\n").alias("snippet"))


def retrimmed(snippet: Column, around: int = 10) -> Column:
    """A snippet again with only so many lines on each side of the marked one; without a mark as it is."""
    lines = F.split(snippet, "\n")
    at = F.array_position(F.transform(lines, lambda x: x.startswith(">> ")), F.lit(True)).cast("int")
    first = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.array_join(F.slice(lines, first, at + around - first + 1), "\n")).otherwise(snippet)


def high_risk(analysis: DataFrame, least_callers: int = 5) -> DataFrame:
    """analysis (key, severity, callers, classification, confidence): severe, widely called and surely real issues."""
    return analysis.where(F.upper("severity").isin("BLOCKER", "CRITICAL", "MAJOR") & (F.col("callers") >= least_callers) & (F.col("classification") == "true_positive") & F.col("confidence").isin("high", "medium"))


def module_of(path: Column, depth: int = 5) -> Column:
    """The first depth segments of a longer path, else its directory."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > depth, F.array_join(F.slice(parts, 1, depth), "/")).otherwise(dirname(path))


def failure_patterns(analysis: DataFrame) -> DataFrame:
    """(pattern, n): A no context, B no callers, C no tests, D partly cited; an issue can be in several."""
    flags = F.array_compact(
        F.array(
            F.when(F.col("total_used") == 0, "A"), F.when(F.col("callers") == 0, "B"), F.when(F.col("tests") == 0, "C"),
            F.when((F.col("cited") > 0) & (F.col("cited") < F.col("total_used")), "D"),
        )
    )
    return analysis.select(F.explode(flags).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def funnel(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """(stage, n) in the given order of stages."""
    out = None
    for i, (name, df) in enumerate(stages):
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("position"), F.lit(name).alias("stage"), "n")
        out = one if out is None else out.unionByName(one)
    return out
