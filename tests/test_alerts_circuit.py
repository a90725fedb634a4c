"""Cooldown, suppression and circuit replay against step-by-step replays."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from textgauge.operators import alerts, circuit, health
from textgauge.streaming import jobs
from textgauge.streaming.state import places

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


RULES = [
    ("r_hot", "n", "d", "m", 5.0, ">", "warning", ["log"], 2, True),
    ("r_ge", "n", "d", "m", 5.0, ">=", "warning", ["log"], 7, True),
    ("r_eq", "n", "d", "m", 5.0, "==", "info", ["log"], 1, True),
    ("r_odd", "n", "d", "m", 5.0, "~", "info", ["log"], 1, True),
    ("r_off", "n", "d", "m", 0.0, ">", "info", ["log"], 1, False),
    ("r_free", "n", "d", "m", 8.0, ">", "info", ["log"], 0, True),
]


def samples(n=400, seed=7):
    rng = random.Random(seed)
    return [(i, "m", at(rng.randrange(0, 9000)), float(rng.randrange(10))) for i in range(n)] + [
        (9000, "m", at(20_000), 9.0), (9001, "m", at(20_119), 9.0), (9002, "m", at(20_120), 9.0),
        (9003, "m", at(20_120), 9.0)]


def emitted(rows):
    last, out = {}, []
    for i, _, ts, v in sorted(rows, key=lambda r: (r[2], r[0])):
        for rid, *_, t, op, _sev, _ch, cd, on in RULES:
            hit = {">": v > t, ">=": v >= t, "==": v == t}.get(op, False)
            if on and hit and (rid not in last or ts - last[rid] >= dt.timedelta(minutes=cd)):
                last[rid] = ts
                out.append((rid, i))
    return sorted(out)


SCHEMA = "event_id long, metric_name string, ts timestamp, value double"


@pytest.mark.parametrize("max_rows", [500_000, 5])
def test_cooldown(spark, max_rows):
    rows = samples()
    hits = alerts.rule_hits(spark.createDataFrame(rows, SCHEMA), alerts.rules_table(spark, RULES))
    got = alerts.cooldown(hits, "event_id", max_rows=max_rows)
    assert sorted((r["rule_id"], r["event_id"]) for r in got.collect()) == emitted(rows)


def files(spark, rows, schema, path, parts):
    """Rows in order of time as several files, one per micro-batch."""
    step = -(-len(rows) // parts)
    for p in range(parts):
        spark.createDataFrame(rows[p * step:(p + 1) * step], schema).coalesce(1).write.mode(
            "append").json(f"{path}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)


def test_streamed_cooldown_equals_batch(spark, fresh):
    rows = sorted(samples(), key=lambda r: (r[2], r[0]))
    stream = files(spark, rows, SCHEMA, f"{fresh}/in", 3)
    spots = places(spark, "t")
    jobs.rule_alerts(stream, alerts.rules_table(spark, RULES), "event_id", *spots).awaitTermination()
    got = spark.read.parquet(spots[2])
    assert got.select("batch").distinct().count() == 3
    assert sorted((r["rule_id"], r["event_id"]) for r in got.collect()) == emitted(rows)


def calls(n=500, seed=11):
    rng = random.Random(seed)
    out, t = [], {"hot": 0, "b": 0}
    for i in range(n):
        k = "hot" if rng.random() < 0.8 else "b"
        t[k] += rng.choice([0, 1, 5, 20, 59, 60, 61])
        out.append((k, at(t[k]), i, rng.random() < 0.55, rng.random()))
    return sorted(out, key=lambda r: (r[1], r[2]))


CALLS = "circuit string, ts timestamp, call_id long, success boolean, execution_time double"


def machine(rows, consecutive=False, controls=()):
    state: dict = {}
    out = {}
    marks = sorted(controls, key=lambda c: c[1])
    for k, ts, i, ok, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        s = state.setdefault(k, {"st": "closed", "fc": 0, "sc": 0, "lf": None, "seen": 0})
        mine = [c for c in marks if c[0] == k and c[1] <= ts]
        if len(mine) > s["seen"]:
            s["seen"] = len(mine)
            s.update(fc=0, sc=0)
            if mine[-1][2] == "reset":
                s["st"] = "closed"
            else:
                s.update(st="open", lf=mine[-1][1])
        if s["st"] == "open":
            if (ts - s["lf"]).total_seconds() < 60:
                out[i] = ("open", "rejected")
                continue
            s.update(st="half_open", sc=0)
        met = s["st"]
        out[i] = (met, "success" if ok else "failure")
        if ok:
            if met == "half_open":
                s["sc"] += 1
                if s["sc"] >= 3:
                    s.update(st="closed", fc=0, sc=0)
            elif consecutive:
                s["fc"] = 0
        else:
            s["lf"], s["sc"] = ts, 0
            s["fc"] += 1
            if met == "half_open" or s["fc"] >= 5:
                s["st"] = "open"
    return out


@pytest.mark.parametrize("consecutive", [False, True])
def test_circuit_replay(spark, consecutive):
    rows = calls()
    got = circuit.replay(spark.createDataFrame(rows, CALLS), consecutive=consecutive,
                         time_slice=600_000_000, rank_slice=40)
    assert {r["call_id"]: (r["state"], r["outcome"]) for r in got.collect()} == machine(
        rows, consecutive)


def test_circuit_controls(spark):
    rows = calls(300, 12)
    controls = [("hot", at(700), "force_open"), ("hot", at(1500), "reset"), ("b", at(300), "reset"),
                ("hot", at(1501), "force_open")]
    got = circuit.replay(spark.createDataFrame(rows, CALLS), controls=spark.createDataFrame(
        controls, "circuit string, ts timestamp, action string"))
    assert {r["call_id"]: (r["state"], r["outcome"]) for r in got.collect()} == machine(
        rows, controls=controls)


def test_streamed_circuit_equals_batch(spark, fresh):
    rows = calls(240, 13)
    stream = files(spark, rows, CALLS, f"{fresh}/in", 4)
    spots = places(spark, "t")
    jobs.circuits(stream, *spots).awaitTermination()
    got = spark.read.parquet(spots[2])
    assert {r["call_id"]: (r["state"], r["outcome"]) for r in got.collect()} == machine(rows)


def test_suppression_stream_equals_steps(spark, fresh):
    rng = random.Random(14)
    rows = [(rng.choice(["db", "api"]), rng.choice(["warning", "critical"]), at(i * 3),
             "resolve" if rng.random() < 0.2 else "alert", i) for i in range(200)]
    schema = "component string, severity string, ts timestamp, kind string, event_id long"
    want, open_ = [], set()
    for c, s, _, kind, i in rows:
        if kind == "resolve":
            open_.discard((c, s))
        elif (c, s) not in open_:
            open_.add((c, s))
            want.append(i)
    df = spark.createDataFrame(rows, schema)
    keys = ["component", "severity"]
    batch = health.suppress_repeats(df.where("kind = 'alert'").drop("kind"),
                                    df.where("kind = 'resolve'").select(*keys, "ts"), keys, 50_000_000)
    assert sorted(r["event_id"] for r in batch.collect()) == want
    spots = places(spark, "t")
    jobs.raised_alerts(files(spark, rows, schema, f"{fresh}/in", 3), keys,
                       *spots).awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(spots[2]).collect()) == want


def test_deliveries_and_remediation(spark):
    rows = spark.createDataFrame([("a1", "r1", ["log", "sms"])],
                                 "alert_id string, rule_id string, channels array<string>")
    channels = spark.createDataFrame([("log", True), ("email", False)],
                                     "channel string, enabled boolean")
    got = {r["channel"]: r["delivered"] for r in alerts.deliveries(rows, channels).collect()}
    assert got == {"log": True, "sms": False}
    seen = []
    ran = alerts.remediate(rows, {"r1": lambda df: seen.append(df.count()), "r2": seen.append})
    assert ran == ["r1"] and seen == [1]
    assert F is not None
