"""Stateful streams: late rows, repeated deliveries, replays, sessions, progress and quantile sketches."""

import datetime as dt
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringwise.session import checkpoint_dir
from ringwise.sources import adapter
from ringwise.streaming import stateful as sf_

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


def base(spark):
    return f"{checkpoint_dir(spark).rstrip('/')}/t-{uuid.uuid4().hex}"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def run(spark, rows, result, start=sf_.to_files, **kw):
    """rows: (id, card, minute, slot)"""
    b = base(spark)
    df = spark.createDataFrame([(i, c, at(m), s) for i, c, m, s in rows], "request_id long, card_id string, ts timestamp, slot long")
    df = df.withColumn("route", F.lit("r"))
    sf_.feed({f"{b}/in": df}, lambda: start(result(sf_.read_stream(spark, f"{b}/in", df)), f"{b}/out", f"{b}/ckpt"), **kw)
    return b


def test_late_rows_are_dropped_and_open_windows_wait(spark):
    rows = [(1, "a", 0, 0), (2, "a", 30, 0),      # watermark 20 after slot 0
            (3, "a", 14, 1), (4, "a", 16, 1),     # window 10-15 has passed, 15-20 as well (20 <= 20)
            (5, "a", 22, 1), (6, "a", 90, 2)]     # 20-25 is open; 90 closes everything up to 80
    b = run(spark, rows, sf_.tumbling)
    got = {(r.window_start - T0).seconds // 60: r.n for r in spark.read.parquet(f"{b}/out").collect()}
    assert got == {0: 1, 30: 1, 20: 1}            # the window of minute 90 has not closed


def test_sessions(spark):
    rows = [(1, "a", 0, 0), (2, "a", 20, 0), (3, "a", 60, 0), (4, "b", 5, 0), (5, "a", 200, 1), (6, "b", 10, 1), (7, "a", 300, 2)]
    b = run(spark, rows, sf_.sessions)
    got = sorted((r.card_id, (r.session_start - T0).seconds // 60, (r.session_end - T0).seconds // 60, r.n)
                 for r in spark.read.parquet(f"{b}/out").collect())
    # b's second request comes when its time has passed the watermark (190 - its end 40); a's last session is open
    assert got == [("a", 0, 50, 2), ("a", 60, 90, 1), ("a", 200, 230, 1), ("b", 5, 35, 1)]


def test_each_id_once_and_replays_add_nothing(spark):
    rows = [(1, "a", 0, 0), (1, "a", 0, 0), (2, "a", 8, 0), (2, "a", 8, 1), (3, "a", 9, 1), (1, "a", 0, 2), (4, "a", 60, 2)]
    b = run(spark, rows, lambda s: sf_.dedup_within(s, "request_id"))
    assert sorted(r.request_id for r in spark.read.parquet(f"{b}/out").collect()) == [1, 2, 3, 4]
    once = run(spark, rows, lambda s: s.select("request_id", "ts"), lambda r, o, c: sf_.once_to_files(r, o, c, "request_id"))
    log = spark.read.parquet(f"{once}/out")
    assert sorted(r.request_id for r in log.collect()) == [1, 2, 3, 4]
    # a batch that runs again writes the same folder; a key that came twice in it is still one row
    batch = spark.createDataFrame([(3, at(9)), (2, at(8)), (3, at(9))], "request_id long, ts timestamp")
    sf_.append_once(batch, 1, f"{once}/out", "request_id")
    assert sorted(r.request_id for r in spark.read.parquet(f"{once}/out").collect()) == [1, 2, 3, 4]


def test_alert_log_of_two_topics(spark):
    b = base(spark)
    schema = "transaction_id string, ts timestamp, slot long"
    topics = {f"{b}/f": spark.createDataFrame([("1", at(0), 0), ("2", at(5), 0), ("1", at(0), 1)], schema),
              f"{b}/b": spark.createDataFrame([("3", at(1), 0), ("3", at(1), 0), ("4", at(50), 1)], schema)}

    def start():
        a, x = (sf_.read_stream(spark, p, r) for p, r in topics.items())
        return sf_.once_to_files(sf_.alert_log(a, x), f"{b}/out", f"{b}/ckpt", "transaction_id")
    sf_.feed(topics, start)
    assert sorted((r.transaction_id, r.decision) for r in spark.read.parquet(f"{b}/out").collect()) == [
        ("1", "FLAG"), ("2", "FLAG"), ("3", "BLOCK"), ("4", "BLOCK")]


def test_policy_and_lag(spark):
    scored = spark.createDataFrame([("1", 0.95, "VIP", 0.7), ("2", 0.05, "New", None)],
                                   "transaction_id string, fraud_probability double, customer_segment string, graph_risk double")
    policy = spark.createDataFrame([(9, "VIP", True, "BLOCK")], "p_decile long, segment string, risk_high boolean, best_action string")
    messages = spark.createDataFrame([("1",), ("2",), ("unknown",)], "transaction_id string")
    got = {r.transaction_id: r.policy_action for r in sf_.policy_stream(messages, scored, policy).collect()}
    assert got == {"1": "BLOCK", "2": None}
    rows = [(i, "a", i, i // 4) for i in range(12)]
    b = run(spark, rows, lambda s: s.select("request_id"), lambda r, o, c: sf_.once_to_files(r, o, c, "request_id"), stop_after=2)
    arrived = spark.createDataFrame([(i, s) for i, _, _, s in rows], "request_id long, slot long")
    assert sf_.committed(spark, f"{b}/ckpt") >= 1 and sf_.committed(spark, f"{b}/nothing") == -1
    assert {r.slot: r.waiting for r in sf_.lag(arrived, f"{b}/out", f"{b}/ckpt", "request_id").collect()} == {2: 4}
    assert sf_.lag(arrived, f"{b}/out", f"{b}/nothing", "request_id").agg(F.sum("waiting")).first()[0] == 12


def test_sketched_quantiles_have_small_rank_error(spark):
    n = 20_000
    values = np.random.default_rng(5).lognormal(3, 1, n)
    req = spark.createDataFrame([(at(i % 7), "/p" if i % 3 else "/q", float(v)) for i, v in enumerate(values)],
                                "ts timestamp, route string, duration_ms double")
    rows = req.collect()
    got = sf_.latency_windows(sf_.latency_sketches(req)).collect()
    assert {r.route for r in got} == {"/p", "/q", sf_.ALL_ROUTES}
    for r in got:
        held = np.sort([x.duration_ms for x in rows if r.window_start <= x.ts < r.window_start + dt.timedelta(minutes=5)
                        and r.route in (x.route, sf_.ALL_ROUTES)])
        assert r.n == len(held)
        for p, q in ((0.5, r.p50), (0.95, r.p95), (0.99, r.p99)):
            assert abs(np.searchsorted(held, q) / len(held) - p) < 0.015


def test_sketch_panels_follow_the_exact_ones(spark):
    from ringwise.streaming import stream as st
    req = adapter.requests(spark, SF)
    exact = {(r.window_start, r.route) for r in st.latency_quantiles(req).select("window_start", "route").collect()}
    assert {(r.window_start, r.route) for r in sf_.latency_windows(sf_.latency_sketches(req)).collect()} == exact


@pytest.mark.parametrize("slots", [0, 1])
def test_feed_of_nothing(spark, slots):
    rows = spark.createDataFrame([(1, 0)] * slots, "request_id long, slot long")
    b = base(spark)
    rows.limit(0).drop("slot").write.parquet(f"{b}/in")
    got = sf_.feed({f"{b}/in": rows}, lambda: sf_.once_to_files(sf_.read_stream(spark, f"{b}/in", rows), f"{b}/out", f"{b}/c", "request_id"))
    assert got == list(range(slots))


@pytest.mark.parametrize("days", [3, 40])
def test_a_longer_backlog_takes_no_more_deliveries(spark, days):
    rows = [(i, "a", i * 60, i * 5 // 24) for i in range(24 * days // 5)] + [(0, "a", 0, days)]
    df = spark.createDataFrame([(i, at(m), s) for i, _, m, s in rows], "request_id long, ts timestamp, slot long")
    b = base(spark)
    got = sf_.feed({f"{b}/in": df}, lambda: sf_.once_to_files(sf_.read_stream(spark, f"{b}/in", df), f"{b}/out", f"{b}/c", "request_id"),
                   most=4)
    assert len(got) <= 4 and got == sorted(got) and got[-1] == days
    assert sf_.committed(spark, f"{b}/c") < 4
    assert sorted(r.request_id for r in spark.read.parquet(f"{b}/out").collect()) == sorted({i for i, *_ in rows})
    ranges = sf_.slot_ranges({"x": df}, 4)
    assert all(lo <= hi for lo, hi in ranges) and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_a_trigger_takes_its_share_of_the_backlog():
    from ringwise.streaming import stream as st
    assert st.files_per_trigger(1) == "4"
    assert all(files / int(st.files_per_trigger(files)) <= sf_.DELIVERIES for files in (100, 1800, 10_800))
