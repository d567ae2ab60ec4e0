"""Recorded sessions: pairing, as-of lookups, islands, step cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayline.operators.ordered import Ordered


def followed_within(first: DataFrame, then: DataFrame, key: str, seconds: int) -> DataFrame:
    """Rows of first (key, ts) that a row of then (key, ts) follows within so many seconds, both ends included.

    Time is cut in buckets of that length, so a busy key is many keys of the join.
    """
    bucket = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds)
    a = first.withColumn("_b", F.explode(F.array(bucket, bucket + 1)))
    b = then.select(F.col(key).alias("_k"), F.col("ts").alias("_t"), bucket.alias("_c"))
    near = (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_c")) & F.col("_t").between(F.col("ts"), F.col("ts") + F.make_dt_interval(secs=F.lit(seconds)))
    return a.join(b, near, "left_semi").drop("_b").distinct()


def frame_at(actions: DataFrame, frames: DataFrame) -> DataFrame:
    """actions (session, ts, …) with frame: the first of frames (session, ts, frame) not before ts, else the session's last.

    One pass over the union of both in time order; no action meets all frames of its session.
    """
    extra = [c for c in actions.columns if c not in ("session", "ts")]
    both = actions.select("session", "ts", F.struct(*extra).alias("a"), F.lit(None).cast(frames.schema["frame"].dataType).alias("f"), F.lit(0).alias("side")).unionByName(
        frames.select("session", "ts", F.lit(None).cast(actions.select(F.struct(*extra).alias("a")).schema["a"].dataType).alias("a"), F.col("frame").alias("f"), F.lit(1).alias("side"))
    )
    order = Window.partitionBy("session").orderBy("ts", "side")
    ahead = F.first("f", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    last = F.last("f", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return both.withColumn("frame", F.coalesce(ahead, last)).where("side = 0").select("session", "ts", "a.*", "frame")


def pair_calls(events: DataFrame) -> DataFrame:
    """events (session, call_id, type before/after, ordinal, ts) → each after with the nearest before ahead of it."""
    order = Window.partitionBy("session", "call_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("type") == "before", F.struct("ordinal", "ts")), ignorenulls=True).over(order)
    paired = events.withColumn("b", before).where("type = 'after' and b is not null")
    return paired.select("session", "call_id", F.col("b.ordinal").alias("before_id"), F.col("ordinal").alias("after_id"), F.col("b.ts").alias("start_time"), F.col("ts").alias("end_time"))


def settled(actions: DataFrame) -> DataFrame:
    """actions (session, ordinal, is_wait, end_time): for each that is no wait, the end of the run of waits right after it."""
    order = Window.partitionBy("session").orderBy("ordinal")
    island = F.sum(F.when(F.col("is_wait"), 0).otherwise(1)).over(order)
    marked = actions.withColumn("island", island)
    return marked.withColumn("settled", F.max("end_time").over(Window.partitionBy("session", "island"))).where(~F.col("is_wait")).drop("island")


def strip_noise(steps: DataFrame) -> DataFrame:
    """Drops key presses, and empty fills that a fill of the same target with a value follows; numbers the rest."""
    order = Window.partitionBy("session").orderBy("ordinal")
    kept = steps.where("action <> 'press'")
    after = F.lead(F.struct("action", "target", "value")).over(order)
    refilled = (F.col("action") == "fill") & (F.col("value") == "") & F.coalesce((after["action"] == "fill") & (after["target"] == F.col("target")) & (after["value"] != ""), F.lit(False))
    return kept.withColumn("gone", refilled).where("not gone").withColumn("step", F.row_number().over(order)).drop("gone")


def drift(pages: DataFrame, window: int = 5) -> DataFrame:
    """pages (crawl, position, host, own_host): where the last window pages were first all on one host that is not the own.
    Pages without a host do not count."""
    pages = pages.where("coalesce(host, '') <> ''")
    span = Window.partitionBy("crawl").orderBy("position").rowsBetween(1 - window, 0)
    off = F.count_if(F.col("host") != F.col("own_host")).over(span)
    same = F.min("host").over(span) == F.max("host").over(span)
    return pages.withColumn("hit", (off == window) & same).where("hit").groupBy("crawl").agg(F.min("position").alias("position"))


def dedupe_clicks(steps: DataFrame, parts: int | None = None) -> DataFrame:
    """Collapses adjacent clicks on one page and name but with other targets; of two the popup one, else the later, stays.
    Adjacent means next to the last step kept. Clicks without a name or a target are never collapsed; step numbers the rest.

    Clicks in a row on one page and name make a block. In it each click takes the place of the one kept before, but for
    one case: behind a click with a popup, others go until one comes that has its target or a popup too. So whether a
    click is kept for now follows from the last popup before it in its block and from whether its target has come again;
    both are running values, and a session of any length is many tasks.
    """
    named = (F.col("action") == "click") & (F.coalesce("name", F.lit("")) != "") & (F.coalesce("target", F.lit("")) != "")
    popup = F.coalesce("popup", F.lit(False))
    o = Ordered(steps, "session", [F.col("ordinal")], parts)
    df = o.last_before(o.rows, "_prev", F.struct("page", "name", "target", F.coalesce(named, F.lit(False)).alias("named")))
    same = F.coalesce(named & F.col("_prev.named") & F.col("_prev.page").eqNullSafe(F.col("page")) & (F.col("_prev.name") == F.col("name")), F.lit(False))
    df = df.withColumn("_fresh", ~same)
    # The last start before a row: a block's first click, or one with a popup.
    start = F.col("_fresh") | popup
    df = o.last_before(df, "_head", F.struct(F.col("_pos").alias("at"), "target", popup.alias("popup")), start)
    again = ~start & F.col("_head.popup") & (F.col("_head.target") == F.col("target"))
    df = o.last_before(df, "_again", F.col("_pos"), again)
    held = F.col("_head.popup") & (F.coalesce("_again", F.lit(-1)) < F.col("_head.at"))  # the click before is gone, or is the popup itself
    df = df.withColumn("_kept", F.coalesce(start | again | ~held, F.lit(True)))
    last = F.when(held, F.col("_head.target")).otherwise(F.col("_prev.target"))
    new = F.col("_fresh") | (F.col("target") == last)
    df = o.sum_before(df.withColumn("_new", new.cast("int")), "_step", F.col("_new")).withColumn("step", (F.col("_step") + F.col("_new")).cast("int"))
    kept = df.where("_kept").groupBy("session", "step").agg(F.max(F.struct("_pos", *(c for c in steps.columns if c != "session"))).alias("m"))
    return kept.select(*(F.col(c if c == "session" else f"m.{c}") for c in steps.columns), "step")


def with_redirects(actions: DataFrame, redirects: DataFrame) -> DataFrame:
    """actions (method, target) with dialog_text; redirects: (requested, message, ordinal), the last of an address counts."""
    real = redirects.where("coalesce(requested, '') <> '' and coalesce(message, '') <> ''")
    last = real.groupBy(F.col("requested").alias("target")).agg(F.max_by("message", "ordinal").alias("message"))
    text = F.when((F.lower("method") == "goto") & F.col("message").isNotNull(), F.concat(F.lit("[redirect:errorMsg] "), "message"))
    return actions.join(last, "target", "left").withColumn("dialog_text", text).drop("message")
