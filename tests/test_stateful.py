"""Entries of keys by bucket: answers, timers and exchanges with the state store."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from textgauge.plans import streams
from textgauge.streaming.stateful import EntryLife

TTL = 60
US = 1_000_000


class Handle:
    """Stands for a bucket's state and timers, and counts what is asked of them."""

    def __init__(self):
        self.value, self.timers, self.asked = None, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        self.asked += 1
        return self.value is not None

    def get(self):
        self.asked += 1
        return self.value

    def update(self, value):
        self.asked += 1
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):  # noqa: N802
        self.asked += 1
        return iter(sorted(self.timers))

    def registerTimer(self, at):  # noqa: N802
        self.asked += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.asked += 1
        self.timers.discard(at)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def brute_force(rows, made):
    out = {}
    for at, event, key in sorted(rows):
        since = made.get(key)
        out[event] = since is not None and at - since < TTL * US
        if not out[event]:
            made[key] = at
    return out


def frame(rows):
    return pd.DataFrame({"key_text": pd.Series([k for _, _, k in rows], dtype=object), "event_id": [e for _, e, _ in rows],
                         "at_us": [a for a, _, _ in rows]})


@pytest.fixture
def life():
    entry = EntryLife(TTL, "event_id")
    entry.init(Handle())
    return entry


def answer(life, rows):
    found = pd.concat(life.handleInputRows((0,), iter([frame(rows[:7]), frame(rows[7:])]), Watermark(0)))
    return dict(zip(found["event_id"].tolist(), found["cached"].tolist(), strict=True))


def test_a_bucket_of_keys_is_answered_at_once(life):
    """Few exchanges with the state store, however many keys."""
    rng, made = random.Random(1), {}
    for turn in range(3):
        rows = [((turn * 50 + rng.randrange(50)) * US, turn * 1000 + i, rng.choice([None, *map(str, range(300))])) for i in range(900)]
        life.handle.asked = 0
        assert answer(life, rows) == brute_force(rows, made)
        assert life.handle.asked <= 5
        assert life.handle.timers == {min(made.values()) // 1000 + TTL * 1000}


def test_a_timer_drops_what_has_expired_and_nothing_else(life):
    answer(life, [(0, 1, "a"), (30 * US, 2, "b"), (40 * US + 1, 3, None)])
    list(life.handleExpiredTimer((0,), Watermark(TTL * 1000), None))
    assert dict(zip(*life.handle.value[:2], strict=True)) == {"b": 30 * US, None: 40 * US + 1}
    assert 90_000 in life.handle.timers
    list(life.handleExpiredTimer((0,), Watermark(100_000), None))
    assert 100_001 in life.handle.timers
    list(life.handleExpiredTimer((0,), Watermark(100_001), None))
    assert life.handle.value is None


def test_a_request_without_a_time_finds_and_makes_nothing(life):
    found = answer(life, [(0, 1, "a"), (None, 2, "a"), (None, 3, "b"), (10 * US, 4, "b"), (11 * US, 5, "b")])
    assert found == {1: False, 2: False, 3: False, 4: False, 5: True}


def test_events_of_many_users_over_several_batches(spark, fresh):
    rng = random.Random(2)
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=rng.randrange(10 * 86_400)), rng.choice([None, *range(40)]), "view", 1.0, '{"k": 1}')
            for i in range(800)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").coalesce(
        1).write.parquet(f"{fresh}/events.parquet")
    got = {r["event_id"]: (r["input_hash"], r["cached"]) for r in streams.expiring(spark, fresh).collect()}
    made, want = {}, {}
    for i, ts, user, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        since = made.get(user)
        hit = since is not None and (ts - since).total_seconds() < streams.TTL
        made[user] = since if hit else ts
        want[i] = (None if user is None else str(user), hit)
    assert got == want
