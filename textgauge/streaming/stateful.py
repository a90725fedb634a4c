"""The stateful jobs as keyed state of the stream: transformWithState with event-time timers.

Each job keeps a few values per key in the state store and reads the rows of a key in order of time within a micro-batch.
Where keys are as many as users or texts, a bucket of them shares a call and a state (EntryLife).
Timers run on the watermark: they drop or advance state whose time has come, so a key that falls silent costs nothing.
All rows that a key has in one micro-batch meet in one task; where single keys hold most of a stream, the jobs on state
tables (jobs) do the same work spread over slices of time.

Rows behind the watermark are dropped. The state store must be RocksDB, see with_state_store.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import alerts, circuit, telemetry

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATE = "1 minute"
#: Buckets of keys whose entries share one state.
BUCKETS = 256


def with_state_store(spark: SparkSession) -> None:
    """Streams that this session starts from now on keep their state in RocksDB, as keyed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _in_order(rows: Iterator[pd.DataFrame], by: Sequence[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(list(by), ignore_index=True)


class _Keyed(StatefulProcessor):
    """One value per key: a struct of the fields in STATE."""

    STATE = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.STATE)

    def close(self) -> None:
        pass

    def known(self) -> tuple | None:
        return tuple(self.state.get()) if self.state.exists() else None

    def wake(self, at_us: int) -> None:
        """The key's only timer, at the given instant."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(-(-at_us // 1000))


class Cooldown(_Keyed):
    """Hits that become alerts: none within the rule's cooldown of the last one. State: when that was."""

    STATE = "last bigint"

    def __init__(self, tie: str):
        self.tie = tie

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 - the interface's names
        found = _in_order(rows, ["at_us", self.tie])
        known = self.known()
        last = known[0] if known else None
        keep = []
        for at, gap in zip(found["at_us"].tolist(), found["gap_us"].tolist(), strict=True):
            due = gap <= 0 or last is None or at - last >= gap
            keep.append(due)
            if due and gap > 0:
                last = at
        if last is not None:
            self.state.update((last,))
            self.wake(last + int(found["gap_us"].max()))
        yield found[keep]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.state.clear()
        yield pd.DataFrame()


class OpenUntilResolved(_Keyed):
    """Alerts of keys that are not open; a resolution closes a key. State: open keys only."""

    STATE = "open boolean"

    def __init__(self, order: Sequence[str]):
        self.order = list(order)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        found = _in_order(rows, ["at_us", "is_alert", *self.order])
        open_ = self.known() is not None
        keep = []
        for is_alert in found["is_alert"].tolist():
            keep.append(bool(is_alert) and not open_)
            open_ = bool(is_alert)
        if open_:
            self.state.update((True,))
        else:
            self.state.clear()
        yield found[keep]


class Breaker(_Keyed):
    """A circuit breaker, call by call. A timer lets an open circuit be probed once its timeout is over."""

    STATE = "state string, failures bigint, successes bigint, last_failure bigint"

    def __init__(self, failure_threshold: int, recovery_timeout: int, success_threshold: int):
        self.settings = failure_threshold, recovery_timeout * 1_000_000, success_threshold

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        to_open, timeout, to_close = self.settings
        found = _in_order(rows, ["at_us", "call_id"])
        state, failures, successes, last = self.known() or ("closed", 0, 0, None)
        told = []
        for at, success in zip(found["at_us"].tolist(), found["success"].tolist(), strict=True):
            if state == "open" and at - last >= timeout:
                state, successes = "half_open", 0
            met, opened = state, False
            if met == "open":
                told.append((met, "rejected", opened))
                continue
            if success:
                if met == "half_open":
                    successes += 1
                    if successes >= to_close:
                        state, failures, successes = "closed", 0, 0
            else:
                failures, successes, last = failures + 1, 0, at
                opened = met == "half_open" or failures >= to_open
                state = "open" if opened else state
            told.append((met, "success" if success else "failure", opened))
        self.state.update((state, failures, successes, last))
        if state == "open":
            self.wake(last + timeout)
        for i, name in enumerate(("state", "outcome", "opened")):
            found[name] = [t[i] for t in told]
        yield found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        state, failures, _, last = self.known() or ("closed", 0, 0, None)
        if state == "open":  # no later call can come before its timeout
            self.state.update(("half_open", failures, 0, last))
        yield pd.DataFrame()


class Degradation(_Keyed):
    """Verdicts as snapshots arrive. State: sums of the first snapshots' metrics, how many, and the latest one."""

    STATE = "seen bigint, counts array<bigint>, sums array<double>, latest array<double>"

    def __init__(self, metrics: dict[str, int], baseline: int, threshold: float):
        self.metrics, self.baseline, self.threshold = metrics, baseline, threshold

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        found = _in_order(rows, ["at_us"])
        names = list(self.metrics)
        seen, counts, sums, latest = self.known() or (0, [0] * len(names), [0.0] * len(names), None)
        counts, sums = list(counts), list(sums)
        out = []
        for row in found[names].astype(object).where(found[names].notna(), None).itertuples(index=False):
            row = list(row)
            seen += 1
            if seen <= self.baseline:
                counts = [c + (v is not None) for c, v in zip(counts, row, strict=True)]
                sums = [s + (v or 0.0) for s, v in zip(sums, row, strict=True)]
            latest = row
            # With fewer snapshots than the baseline takes, the latest is not part of it.
            held = [(c, s) if seen >= self.baseline else (c - (v is not None), s - (v or 0.0))
                    for c, s, v in zip(counts, sums, row, strict=True)]
            changes = []
            for (c, s), v, sign in zip(held, row, self.metrics.values(), strict=True):
                base = s / c if c else None
                changes.append(sign * (v - base) / base if v is not None and base is not None and base > 0 else None)
            worse = any(x is not None and x > self.threshold for x in changes)
            out.append((seen, *changes, bool(worse and seen >= 2)))
        self.state.update((seen, counts, sums, latest))
        told = pd.DataFrame(out, columns=["snapshots", *_change_names(self.metrics), "retrain"])
        yield pd.concat([found[["model_name", "ts"]], told], axis=1)


def _change_names(metrics: dict[str, int]) -> list[str]:
    return [f"{m}_drop" if sign < 0 else f"{m}_rise" for m, sign in metrics.items()]


class EntryLife(_Keyed):
    """Whether a request finds an entry of its key that has not expired, or makes one.

    Keys are dealt to buckets, and a bucket's keys are answered in one call: calls and exchanges with the state store
    grow with buckets and micro-batches, not with keys. State: the bucket's keys with the time of their entry, and when
    its timer is due. The timer removes entries when their time to live is over, whether their keys are asked for again
    or not.

    A request without a time finds no entry and makes none.
    """

    STATE = "keys array<string>, made array<bigint>, due bigint"

    def __init__(self, ttl_seconds: int, tie: str):
        self.ttl, self.tie = ttl_seconds * 1_000_000, tie

    def entries(self) -> tuple[dict[str | None, int], int | None]:
        """The time of each key's entry, and the instant of the timer in milliseconds."""
        known = self.state.get()
        return (dict(zip(known[0], known[1], strict=True)), known[2]) if known else ({}, None)

    def keep(self, made: dict[str | None, int], old: int | None) -> None:
        """Put the state back, the timer set to the first entry that expires; old: what it was set to."""
        due = -(-(min(made.values()) + self.ttl) // 1000)
        if due != old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(due)
        self.state.update((list(made), list(made.values()), due))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        found = _in_order(rows, ["at_us", self.tie])
        made, due = self.entries()
        hits, new = [], False
        for name, at in zip(found["key_text"].tolist(), found["at_us"].tolist(), strict=True):
            if at != at:  # no time
                hits.append(False)
                continue
            since = made.get(name)
            hits.append(since is not None and at - since < self.ttl)
            if not hits[-1]:
                made[name], new = int(at), True
        if new:
            self.keep(made, due)
        found["cached"] = hits
        yield found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        left = {name: at for name, at in self.entries()[0].items() if at + self.ttl > now}
        if left:
            self.keep(left, None)  # the timer that went off is removed by the stream
        else:
            self.state.clear()
        yield pd.DataFrame()


def _ddl(df: DataFrame, *more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + list(more))


def _timed(df: DataFrame, late: str) -> DataFrame:
    return df.withWatermark("ts", late).withColumn("at_us", F.unix_micros("ts"))


def _run(df: DataFrame, keys: Sequence[str], processor: StatefulProcessor, schema: str, timers: bool) -> DataFrame:
    with_state_store(df.sparkSession)
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime" if timers else "None")


def rule_alerts(samples: DataFrame, rules: DataFrame, tie: str, late: str = LATE) -> DataFrame:
    """Alerts of rules with cooldown, from a stream of samples."""
    hits = _timed(alerts.rule_hits(samples, rules), late).withColumn("gap_us", F.col("cooldown_minutes").cast("bigint") * 60_000_000)
    return alerts.make_alerts(_run(hits, ["rule_id"], Cooldown(tie), _ddl(hits), True).drop("at_us", "gap_us"))


def raised_alerts(events: DataFrame, keys: Sequence[str], tie: str) -> DataFrame:
    """Alerts (kind 'alert') of keys that are not open; kind 'resolve' closes a key."""
    rows = events.withColumn("at_us", F.unix_micros("ts")).withColumn("is_alert", (F.col("kind") == "alert").cast("int"))
    return _run(rows, keys, OpenUntilResolved([tie]), _ddl(rows), False).drop("at_us", "is_alert", "kind")


def circuits(calls: DataFrame, failure_threshold: int = circuit.FAILURES_TO_OPEN,
             recovery_timeout: int = circuit.SECONDS_TO_PROBE, success_threshold: int = circuit.SUCCESSES_TO_CLOSE,
             late: str = LATE) -> DataFrame:
    """Calls with the state in which each met its circuit, its outcome, and whether it opened the circuit."""
    rows = _timed(calls, late)
    schema = _ddl(rows, "state string", "outcome string", "opened boolean")
    return _run(rows, ["circuit"], Breaker(failure_threshold, recovery_timeout, success_threshold), schema, True).drop("at_us")


def degradations(snapshots: DataFrame, threshold: float = telemetry.DEGRADATION) -> DataFrame:
    """The verdict after each snapshot of a model, its snapshots in order of arrival and time."""
    metrics = dict(telemetry.WATCHED)
    rows = snapshots.select("model_name", "ts", *[F.col(m).cast("double").alias(m) for m in metrics]).withColumn(
        "at_us", F.unix_micros("ts"))
    changes = ", ".join(f"{n} double" for n in _change_names(metrics))
    return _run(rows, ["model_name"], Degradation(metrics, telemetry.BASELINE_SNAPSHOTS, threshold),
                f"model_name string, ts timestamp, snapshots bigint, {changes}, retrain boolean", False)


def cache_hits(requests: DataFrame, ttl_seconds: int, tie: str, key: str = "input_hash", late: str = LATE,
               buckets: int = BUCKETS) -> DataFrame:
    """Requests with `cached`: whether an entry of their key is younger than its time to live; the others make one.

    A micro-batch reads the unexpired entries of the buckets that it has requests of. Keys are told apart by their text.
    """
    rows = _timed(requests, late).withColumns({
        "key_text": F.col(key).cast("string"), "key_bucket": F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets))})
    return _run(rows, ["key_bucket"], EntryLife(ttl_seconds, tie), _ddl(rows, "cached boolean"), True).drop(
        "at_us", "key_text", "key_bucket")
