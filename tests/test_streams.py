"""Replays of a stored table that lies in many files, written in no order of ts."""

import datetime as dt
import os

import pytest

from assayline.plans import q_checks, q_streams


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """212 files, the latest ts first: 105 users with a view and a click, then a purchase, in a file each, 3 days a user; one streak in the first and last file."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    d = tmp_path_factory.mktemp("many")
    os.mkdir(d / "events.parquet")
    start = dt.datetime(2024, 1, 1)
    for i in range(210):
        at = start + dt.timedelta(days=3 * (i // 2), minutes=10 * (i % 2))
        kinds = ["purchase"] if i % 2 else ["click", "view"]
        n = len(kinds)
        row = {"event_id": [2 * i + k for k in range(n)], "ts": pa.array([at] * n, pa.timestamp("us")), "user_id": [i // 2] * n, "event_type": kinds, "value": [1.0] * n, "props": ["{}"] * n}
        path = d / "events.parquet" / f"part-{i:05d}.parquet"
        pq.write_table(pa.table(row), path)
        os.utime(path, (1_700_000_000 - 60 * i, 1_700_000_000 - 60 * i))
    for i, at in ((500, 0), (501, 1)):
        row = {"event_id": [i], "ts": pa.array([start + dt.timedelta(minutes=20 + at)], pa.timestamp("us")), "user_id": [999], "event_type": ["purchase"], "value": [1.0], "props": ["{}"]}
        path = d / "events.parquet" / f"part-{i:05d}.parquet"
        pq.write_table(pa.table(row), path)
        os.utime(path, (1_600_000_000 if at else 1_800_000_000,) * 2)
    return str(d)


@pytest.mark.parametrize("name", ["stream_click_nav", "stream_dedup_new", "stream_drift", "stream_trace_pair"])
def test_many_files_out_of_order(spark, many_files, name):
    import duckdb

    c = duckdb.connect()
    c.sql(f"create view events as select * from '{many_files}/events.parquet/*.parquet'")
    want = sorted(c.sql((q_streams.SQL | q_checks.SQL)[name]).fetchall())
    assert want and sorted(map(tuple, (q_streams.QUERIES | q_checks.QUERIES)[name](spark, many_files).collect())) == want


def test_several_batches_and_repeated_keys(spark, tmp_path):
    """One file a batch: windows come out as from one batch, and a key keeps the outcome of its first batch."""
    from pyspark.sql import functions as F

    from assayline.streaming import logs

    path = str(tmp_path / "log")
    for i in range(4):
        rows = [(dt.datetime(2024, 1, 1, i, m), f"k{(i + m) % 3}", float(10 * i + m), m == 2, i) for m in range(4)]
        spark.createDataFrame(rows, "ts timestamp, kind string, elapsed_ms double, timeout boolean, file int").coalesce(1).write.mode("append").parquet(path)
    for k, f in enumerate(sorted((f for f in os.listdir(path) if f.endswith(".parquet")), key=lambda f: spark.read.parquet(f"{path}/{f}").first()["file"])):
        os.utime(f"{path}/{f}", (1_700_000_000 + 60 * k,) * 2)
    schema = spark.read.parquet(path).schema
    several, one = (sorted(map(tuple, logs.sla_rollup(logs.run(logs.llm_sla(logs.source(spark, f"{path}/*.parquet", schema, n)), "sla", "complete")).collect())) for n in (1, None))
    assert several == one and len(one) == 12
    got = logs.routed(logs.source(spark, f"{path}/*.parquet", schema, 1), "router", lambda x: x.select(F.col("kind").alias("key"), F.col("file").cast("string").alias("outcome")))
    assert {tuple(r) for r in got.collect()} == {("k0", "0"), ("k1", "0"), ("k2", "0")}


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    """A second run over the same checkpoint takes only the files that came since."""
    from assayline.streaming import logs

    path, schema = str(tmp_path / "log"), "ts timestamp, key long"
    seen = []

    def drive():
        q = logs.source(spark, f"{path}/*.parquet", spark.createDataFrame([], schema).schema, 1).writeStream.option("checkpointLocation", str(tmp_path / "mark"))
        q.foreachBatch(lambda batch, n: seen.extend((n, r["key"]) for r in batch.collect())).trigger(availableNow=True).start().awaitTermination()

    for i in range(3):
        spark.createDataFrame([(dt.datetime(2024, 1, 1, i), i)], schema).coalesce(1).write.mode("append").parquet(path)
        drive()
    assert sorted(seen) == [(0, 0), (1, 1), (2, 2)]


def test_percentiles_and_late_rows_over_a_restart(spark, tmp_path):
    """Two runs over one checkpoint: percentiles of all calls, and the rows of the second that are behind the first's watermark."""
    from assayline.streaming import logs

    schema = "ts timestamp, kind string, elapsed_ms double, timeout boolean"
    day = lambda d, m=0: dt.datetime(2024, 1, d, 5, m)
    parts = [[(day(9), "chat", 100.0, False), (day(9, 1), "chat", 300.0, True), (day(9), None, None, None), (day(1), "old", 1.0, False)], [(day(9, 2), "chat", 200.0, False), (day(7), "chat", 5.0, False), (day(8, 1), "chat", 7.0, False), (day(1), None, 5.0, False)]]
    path, folder, other = str(tmp_path / "log"), str(tmp_path / "sla"), str(tmp_path / "late")
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        read = lambda: logs.source(spark, path, spark.createDataFrame([], schema).schema, None)
        counts = logs.run(logs.llm_sla(read(), late="30 days"), "sla", "complete", folder)
        late = logs.run(logs.late_rows(read(), "kind", "1 day"), "late", folder=other)
    got = {(r.start, r.kind): (r.calls, r.timeouts, r.timeout_rate, r.p50, r.p95, r.p99, r.longest) for r in logs.sla_rollup(counts).collect()}
    start = int(dt.datetime(2024, 1, 9, 5, tzinfo=dt.timezone.utc).timestamp())
    assert got[start, "chat"] == (3, 1, 0.3333, 200.0, 300.0, 300.0, 300.0) and got[start, None] == (1, 0, 0.0, 0.0, 0.0, 0.0, 0.0)
    assert sum(r[0] for r in got.values()) == 8
    # The first run's batch has no watermark yet; the second's is a day before 9 January, 5:01.
    assert sorted((r.key or "", r.n) for r in late.collect()) == [("", 1), ("chat", 1)]
    rounded = logs.llm_sla(spark.createDataFrame(parts[0], schema), step=250.0).collect()
    assert {r.ms for r in rounded if r.kind == "chat"} == {250.0, 500.0}


@pytest.mark.parametrize("how", ["one batch", "a file a batch", "reversed", "in two runs"])
def test_drift_does_not_depend_on_batches(spark, tmp_path, how):
    """Pages in any order within the lateness, nulls, repeated hosts; a page two days on closes the log and lets state expire."""
    from assayline.operators import sessions
    from assayline.streaming import logs

    import random

    rnd = random.Random(5)
    start = dt.datetime(2024, 3, 1)
    pages = [(start + dt.timedelta(seconds=60 * i + c), c, i, rnd.choice(["home", "x", "y", "x", None, ""]), "home") for c in range(12) for i in range(25)]
    pages += [(start + dt.timedelta(seconds=i), 50, i, "x" if i > 4 else "home", "home") for i in range(9)] + [(None, 51, 1, "x", "home"), (start, None, 1, "x", "home")]
    schema = "ts timestamp, crawl long, position long, host string, own_host string"
    want = {(r.crawl, r.position) for r in sessions.drift(spark.createDataFrame([p for p in pages if p[0] and p[1] is not None], schema), 4).select("crawl", "position").collect()}
    assert (50, 8) in want and 3 < len(want) < 13, want
    path, folder = str(tmp_path / "log"), str(tmp_path / "out")
    closing = [(start + dt.timedelta(days=2), 99, 1, "home", "home")]
    n = 0

    def add(rows):
        nonlocal n
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/f{n}")
        for f in os.listdir(f"{path}/f{n}"):
            os.utime(f"{path}/f{n}/{f}", (1_700_000_000 + 60 * n,) * 2)
        n += 1

    rnd.shuffle(pages)
    fifth = [pages[i::5] for i in range(5)]
    if how == "reversed":
        fifth = [sorted(pages, key=lambda p: str(p[0]), reverse=True)[i * 63 : i * 63 + 63] for i in range(5)]
    read = lambda: logs.source(spark, f"{path}/*", spark.createDataFrame([], schema).schema, None if how == "one batch" else 1)
    for i, rows in enumerate([*fifth, closing]):
        add(rows)
        if how == "in two runs" and i == 2:
            early = logs.run(logs.drift(read(), 4, "3 hours"), "drift", folder=folder)
            assert early.count() == 0
    got = [(r.crawl, r.position) for r in logs.run(logs.drift(read(), 4, "3 hours"), "drift", folder=folder).collect()]
    assert sorted(got) == sorted(want)


def test_drift_states_are_as_many_as_parts(spark, tmp_path):
    """Crawls that share a part's state keep their own streaks and times: over batches, and after some have expired."""
    from assayline.streaming import logs

    start = dt.datetime(2024, 3, 1)
    schema = "ts timestamp, crawl long, position long, host string, own_host string"
    host = lambda c, i: "x" if c % 3 == 0 and i in (1, 2) else "home" if i % 2 else f"y{i}"
    batches = [[(start + dt.timedelta(minutes=10 * i, seconds=c), c, 10 * c + i, host(c, i), "home") for c in range(90) for i in few] for few in ((0, 2), (1, 3))]
    batches += [[(start + dt.timedelta(days=d), 500 + d, 0, "home", "home")] for d in (1, 3, 5)]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/log/f{n}")
        for f in os.listdir(tmp_path / "log" / f"f{n}"):
            os.utime(tmp_path / "log" / f"f{n}" / f, (1_700_000_000 + 60 * n,) * 2)
    pages, got = logs.source(spark, f"{tmp_path}/log/*", spark.createDataFrame([], schema).schema, 1), []
    q = logs.drift(pages, 2, "2 hours", 4).writeStream.option("checkpointLocation", str(tmp_path / "mark"))
    q = q.foreachBatch(lambda batch, n: got.extend(map(tuple, batch.collect()))).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(got) == [(c, 10 * c + 2) for c in range(0, 90, 3)]
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    assert max(states) == 4 and states[-1] < 3, states
