"""Append-only logs as streams. Each function takes a streaming DataFrame and gives one; run() drives it to its end."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from assayline.functions.stats import ratio, rounded_rank
from assayline.sources.workdir import work_path


def source(spark: SparkSession, path: str, schema, files_per_batch: int | None = 64) -> DataFrame:
    """Files of a folder or glob as a stream, ts as an instant. files_per_batch None: all files that are there are one batch."""
    reader = spark.readStream.schema(schema)
    df = (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def run(df: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Runs a stream over what is there now and returns its result, kept in the shared folder. Given the folder of a run
    before, the stream goes on where that one stopped, and the result is that of all runs.

    In append mode each batch is a folder named by its number, overwritten if the batch is run again; in complete mode
    only the last batch's result stays.
    """
    spark = df.sparkSession
    out = folder or work_path(spark, name)
    schema = df.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/all" if mode == "complete" else f"{out}/batch-{number:09d}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out}/batch-none")
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out)


def llm_sla(calls: DataFrame, window: str = "1 hour", late: str = "1 day", step: float | None = None) -> DataFrame:
    """calls (ts, kind, elapsed_ms, timeout) → per window, kind, time and timeout flag how many calls: the state from which
    sla_rollup() reads percentiles.

    Counts of values add up in any order and over any batches, so the percentiles are exact. The state of a window has a
    row for each distinct time; with `step`, times are rounded up to multiples of it, and percentiles are at most a step
    too high.
    """
    ms = F.coalesce("elapsed_ms", F.lit(0.0))
    ms = ms if step is None else F.ceil(ms / step) * step
    g = calls.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "kind", ms.alias("ms"), F.coalesce("timeout", F.lit(False)).alias("timeout"))
    return g.agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("w.start").alias("start"), "kind", "ms", "timeout", "n")


def sla_rollup(counts: DataFrame) -> DataFrame:
    """The result of llm_sla() → (start, kind, calls, timeouts, timeout_rate, longest, p50, p95, p99) of each window and kind."""
    keys = ["start", "kind"]
    sums = counts.groupBy(*keys).agg(F.sum("n").alias("calls"), F.sum(F.when(F.col("timeout"), F.col("n")).otherwise(0)).alias("timeouts"), F.max("ms").alias("longest"))
    sums = sums.withColumn("timeout_rate", F.round(ratio(F.col("timeouts"), F.col("calls")), 4))
    ranks = rounded_rank(counts, keys, "ms", {"p50": 50.0, "p95": 95.0, "p99": 99.0}, F.col("n"))
    return sums.join(ranks, (sums["start"] == ranks["start"]) & sums["kind"].eqNullSafe(ranks["kind"])).drop(ranks["start"], ranks["kind"])


def late_rows(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """events (ts, key) → (key, watermark_ms, n): for each batch, rows that came behind the watermark, which windowed
    operators would drop. Rows without ts are never late.

    A row is late where its time, in milliseconds, is before the watermark that the batches before have set. The operator
    keeps no state; a key's rows are dealt into parts, so that one of many rows is no single task. Add up n by key.
    """

    def count(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        n = sum(int((p["ms"] < mark).sum()) for p in parts)
        if n:
            yield pd.DataFrame({"key": [k[0]], "watermark_ms": [mark], "n": [n]})

    kind = events.schema[key].dataType.simpleString()
    rows = events.withWatermark("ts", late).select(F.col(key).alias("key"), "ts", F.unix_millis("ts").alias("ms"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("ts"), F.lit(64)))
    return rows.groupBy("key", "part").applyInPandasWithState(count, f"key {kind}, watermark_ms long, n long", "none int", "append", GroupStateTimeout.NoTimeout)


def flake(runs: DataFrame, days: int = 7, late: str = "2 days") -> DataFrame:
    """runs (ts, site, scenario, status) → passes in windows of so many days that begin each day."""
    g = runs.withWatermark("ts", late).groupBy(F.window("ts", f"{days} days", "1 day").alias("w"), "site", "scenario")
    return g.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "PASS").alias("passed")).select(F.unix_seconds("w.start").alias("start"), "site", "scenario", "total", "passed")


def new_keys(events: DataFrame, key: str, late: str = "60 days") -> DataFrame:
    """The keys that the stream had not shown before, within the lateness."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]).select(key)


def sessions(steps: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """steps (ts, user_id, failed) → sessions that end after a gap: start, steps, and whether one failed."""
    g = steps.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.bool_or("failed").alias("failed")).select("user_id", F.unix_micros("w.start").alias("start_us"), "n", "failed")


def followed(first: DataFrame, then: DataFrame, key: str, seconds: int, late: str = "2 hours") -> DataFrame:
    """first (key, ts, event_id) that then (key, ts) follows within so many seconds, once a pair."""
    a = first.withWatermark("ts", late).alias("a")
    b = then.select(F.col(key).alias("k2"), F.col("ts").alias("ts2")).withWatermark("ts2", late).alias("b")
    return a.join(b, F.expr(f"a.{key} = b.k2 and b.ts2 >= a.ts and b.ts2 <= a.ts + interval {seconds} seconds")).select("a.event_id", f"a.{key}")


def drift(pages: DataFrame, window: int, late: str = "1 hour", parts: int = 2048) -> DataFrame:
    """pages (ts, crawl, position, host, own_host) → (crawl, position) where window pages in a row were on one foreign host,
    the first such place of a crawl. Positions grow with ts, to the millisecond; pages without a host do not count.

    Pages wait in the state until the watermark has passed them and are then taken in order of position, so that the result
    does not depend on how the log is cut into batches: it is that of all pages before the watermark that came before it.
    State is what waits (the pages of a crawl within the lateness), and the host and length of the running streaks. A crawl
    goes when the watermark is a day past its last page.

    Crawls are dealt into so many parts, each with one state: what Spark does for a state, some milliseconds in each batch,
    is then bounded, however many crawls there are. A run that goes on from a checkpoint needs the same number.
    """
    day = 86_400_000

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        crawls, waiting = {}, []
        if state.exists:
            ids, held, lengths, told, lasts, *pages_ = state.get
            crawls = {c: list(s) for c, *s in zip(ids, held, lengths, told, lasts)}
            waiting = list(zip(*pages_))
        for p in () if state.hasTimedOut else rows:
            fresh = list(zip(*(p[c].tolist() for c in ("crawl", "ms", "position", "host"))))
            for c, ms, _, _ in fresh:
                streak = crawls.setdefault(c, ["", 0, False, 0])
                streak[3] = max(streak[3], ms)
            waiting += fresh
        hits = []
        for c, _, place, at in sorted((w for w in waiting if w[1] < mark), key=lambda w: w[2]):
            streak = crawls[c]
            host, length, told, _ = streak
            length = 0 if at == "" else length + 1 if at == host else 1
            streak[:2] = at, length
            if length >= window and not told:
                streak[2] = True
                hits.append((c, place))
        waiting = [w for w in waiting if w[1] >= mark and not crawls[w[0]][2]]
        busy = {w[0] for w in waiting}
        crawls = {c: s for c, s in crawls.items() if c in busy or s[3] + day >= mark}
        if not crawls:
            state.remove()
        else:
            columns = [list(c) for c in zip(*((c, *s) for c, s in crawls.items()))]
            state.update((*columns, *([list(c) for c in zip(*waiting)] if waiting else [[]] * 4)))
            state.setTimeoutTimestamp(min([w[1] for w in waiting] + [max(s[3] + day, mark) for c, s in crawls.items() if c not in busy]))
        if hits:
            yield pd.DataFrame(hits, columns=["crawl", "position"])

    asked = pages.withWatermark("ts", late).where("ts is not null and crawl is not null and position is not null and coalesce(host, '') <> ''")
    # The own host is told by an empty name.
    rows = asked.select("ts", F.col("crawl").cast("long"), F.col("position").cast("long"), F.when(F.col("host").eqNullSafe(F.col("own_host")), "").otherwise(F.col("host")).alias("host"), F.unix_millis("ts").alias("ms"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("crawl"), F.lit(parts)))
    kept = "crawls array<long>, streak_hosts array<string>, lengths array<int>, told array<boolean>, lasts array<long>, ids array<long>, times array<long>, places array<long>, hosts array<string>"
    return rows.groupBy("part").applyInPandasWithState(step, "crawl long, position long", kept, "append", GroupStateTimeout.EventTimeTimeout)


def routed(issues: DataFrame, name: str, route: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """route(issues), with a key column, into the outcome table; of a key in several batches the first batch's row stays.

    A batch that runs again replaces its own rows, as each has a folder named by its number.
    """
    got = run(route(issues), name)
    rest = [c for c in got.columns if c != "key"]
    first = got.withColumn("_file", F.input_file_name()).groupBy("key").agg(F.min(F.struct("_file", *rest)).alias("m"))
    return first.select("key", *(F.col(f"m.{c}").alias(c) for c in rest)).select(*got.columns)
