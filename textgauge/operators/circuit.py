"""Circuit-breaker replay over call tables, without folding a circuit's history in one task.

A circuit's course is a path over its failures: from a failure that opens the circuit, the first
call after the timeout probes it; a failure among the next `success_threshold` calls opens it again,
otherwise it closes and the `failure_threshold`-th failure after that opens it. So every failure has
one successor, found by look-ups on call positions and failure ranks, and the failures that really
open the circuit are the path from the first one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, small
from .ordered import (carry_last, carry_next, mark_chain, micros, next_at_or_after, rank_in_key,
                      running_count, slice_of, slice_width, top_per_key)

# Breaker settings.
FAILURES_TO_OPEN = 5
SECONDS_TO_PROBE = 60
SUCCESSES_TO_CLOSE = 3

CARRY = ("circuit string, state string, failure_count bigint, success_count bigint, "
         "last_failure timestamp")


def replay(calls: DataFrame, failure_threshold: int = FAILURES_TO_OPEN,
           recovery_timeout: int = SECONDS_TO_PROBE, success_threshold: int = SUCCESSES_TO_CLOSE,
           consecutive: bool = False, carry: DataFrame | None = None,
           controls: DataFrame | None = None, time_slice: int | None = None,
           rank_slice: int = 100_000) -> DataFrame:
    """Append to calls (circuit, ts, call_id, success, …) state, outcome and whether it opened.

    state: 'closed', 'open' or 'half_open' as the call met it; outcome: 'success', 'failure' or
    'rejected'. Failures count from the last closing, successes between them do not reset the count
    unless `consecutive`. carry (see CARRY) continues from earlier calls; controls (circuit, ts,
    action) restart a circuit: 'reset' closes it, 'force_open' opens it for one timeout from then.
    Time slices are the widest that hold a bounded number of a circuit's calls, unless given.
    """
    if controls is not None:
        return _replay_controlled(calls, controls, carry, failure_threshold=failure_threshold,
                                  recovery_timeout=recovery_timeout, consecutive=consecutive,
                                  success_threshold=success_threshold, time_slice=time_slice,
                                  rank_slice=rank_slice)
    rest = [c for c in calls.columns if c not in ("circuit", "ts", "call_id", "success")]
    base = calls.withColumn("_at", micros("ts"))
    time_slice = time_slice or slice_width(base, ["circuit"], "_at")
    base = base.withColumn("_chunk", slice_of("_at", time_slice))
    base = rank_in_key(base, ["circuit"], "_chunk", [F.col("_at"), F.col("call_id")], "_pos")
    base = base.withColumn("_chunk", slice_of("_pos", rank_slice))
    failed = ~F.col("success")
    base = running_count(base, ["circuit"], "_chunk", [F.col("_pos")], failed, "_fails")
    base = base.withColumn("_fail_pos", F.when(failed, F.col("_pos")))
    base = carry_next(base, ["circuit"], "_chunk", ["_pos"], "_fail_pos", "_next_fail")
    if consecutive:
        base = base.withColumn("_ok_pos", F.when(F.col("success"), F.col("_pos")))
        base = carry_last(base, ["circuit"], "_chunk", ["_pos"], "_ok_pos", "_last_ok")
    base = cut(base)
    sizes = base.groupBy("circuit").agg(F.max("_pos").alias("_n"))

    sizes = small(sizes)
    state = _start_states(sizes, carry)
    if consecutive:
        # A run that began before the first call here goes on from the carried count.
        run = F.col("_pos") - F.coalesce("_last_ok", F.lit(0)) + F.when(
            F.col("_last_ok").isNull(), F.col("_count")).otherwise(0)
        runs = base.join(state.select("circuit", F.when(
            F.col("_state") == "closed", F.col("failure_count")).otherwise(0).alias("_count")),
            "circuit")
        base = cut(runs.withColumn("_ripe", F.when(
            failed & (run >= failure_threshold), F.col("_pos"))).drop("_count"))
        base = cut(carry_next(base, ["circuit"], "_chunk", ["_pos"], "_ripe", "_next_ripe"))

    timeout = recovery_timeout * 1_000_000
    points = base.select("circuit", "_at", F.col("_pos").alias("_to"))
    opened = base.where(failed).select("circuit", F.col("_pos").alias("pos"),
                                       (F.col("_at") + timeout).alias("_at"))
    begun = state.where("_state = 'open'").select(
        "circuit", F.lit(0).cast("bigint").alias("pos"), F.coalesce(
            micros("last_failure") + timeout, F.lit(0)).alias("_at"))
    probes = next_at_or_after(points, opened.unionByName(begun), ["circuit"], "_at", "_to",
                              time_slice).select("circuit", "pos", F.col("_next").alias("probe"))
    halves = state.where("_state = 'half_open'").select(
        "circuit", F.lit(0).cast("bigint").alias("pos"),
        (1 - F.col("success_count")).alias("probe"))
    probes = probes.unionByName(halves)

    # What happens from the probe on: fails again within the threshold, closes, or runs out of calls.
    look = ["_next_fail", "_fails"] + (["_next_ripe"] if consecutive else [])
    at = base.select("circuit", F.col("_pos").alias("_p"), *look)
    spans = probes.withColumn("_p", F.greatest("probe", F.lit(1))).join(
        at, ["circuit", "_p"], "left").join(sizes, "circuit")
    last = F.col("probe") + success_threshold - 1
    again = F.col("_next_fail") <= last
    closes = ~F.coalesce(again, F.lit(False)) & (last <= F.col("_n"))
    spans = spans.withColumns({"close": last, "_again": F.when(again, F.col("_next_fail"))})
    if consecutive:
        ripe = at.select("circuit", (F.col("_p") - 1).alias("close"),
                         F.col("_next_ripe").alias("_later"))
        spans = spans.join(ripe, ["circuit", "close"], "left")
        later = F.col("_later")
    else:
        ranks = base.where(failed).select("circuit", F.col("_fails").alias("_rank"),
                                          F.col("_pos").alias("_later"))
        spans = spans.withColumn("_rank", F.col("_fails") + failure_threshold).join(
            ranks, ["circuit", "_rank"], "left")
        later = F.col("_later")
    spans = cut(spans.select("circuit", "pos", "probe", "close", F.col("_fails").alias("base"),
                             F.coalesce("_again", F.when(closes, later)).alias("nxt")))

    virtual = small(spans.where("pos = 0"))
    if consecutive:
        first = base.where("_ripe IS NOT NULL").groupBy("circuit").agg(F.min("_pos").alias("pos"))
        first = state.where("_state = 'closed'").select("circuit").join(first, "circuit")
    else:
        first = state.where("_state = 'closed'").select(
            "circuit", F.greatest(F.lit(failure_threshold) - F.col("failure_count"), F.lit(1))
            .alias("_fails")).join(base.where(failed).select(
                "circuit", "_fails", F.col("_pos").alias("pos")), ["circuit", "_fails"])
    starts = first.select("circuit", "pos").unionByName(
        virtual.where("nxt IS NOT NULL").select("circuit", F.col("nxt").alias("pos")))
    marked = mark_chain(spans.where("pos > 0"), starts, "circuit", rank_slice)

    episode = F.struct("pos", "probe", "close", "base")
    seen = spans.join(marked, ["circuit", "pos"], "left_semi").select(
        "circuit", F.col("pos").alias("_pos"), episode.alias("_open"))
    marked_calls = base.join(seen, ["circuit", "_pos"], "left")
    told = carry_last(marked_calls, ["circuit"], "_chunk", ["_pos"], "_open", "_since", strict=True)
    told = told.join(virtual.select("circuit", episode.alias("_begin")), "circuit", "left").join(
        state.select("circuit", F.col("failure_count").alias("_carried")), "circuit")
    e = F.coalesce("_since", "_begin")
    told = told.withColumn("_e", e)
    met = (F.when(F.col("_e").isNull(), "closed")
           .when(F.col("_e.probe").isNull() | (F.col("_pos") < F.col("_e.probe")), "open")
           .when(F.col("_pos") <= F.col("_e.close"), "half_open").otherwise("closed"))
    told = told.withColumn("state", met)
    outcome = F.when(F.col("state") == "open", "rejected").when(
        F.col("success"), "success").otherwise("failure")
    told = told.withColumns({"outcome": outcome, "opened": F.col("_open").isNotNull()})
    after = (F.when(F.col("opened") | (F.col("outcome") == "rejected"), "open")
             .when((F.col("state") == "half_open") & (F.col("_pos") == F.col("_e.close")), "closed")
             .otherwise(F.col("state")))
    counted = F.when(F.col("_e").isNull(), F.col("_fails") + F.col("_carried")).otherwise(
        F.col("_fails") - F.col("_e.base"))
    if consecutive:
        counted = F.when(F.col("success"), 0).otherwise(
            F.col("_pos") - F.coalesce("_last_ok", F.lit(0))
            + F.when(F.col("_last_ok").isNull(), F.col("_carried")).otherwise(0))
    return told.withColumn("state_after", after).select(
        "circuit", "ts", "call_id", "success", *rest, "state", "outcome", "opened", "state_after",
        F.when(F.col("state_after") == "closed", F.when(F.col("state") == "half_open", 0)
               .otherwise(counted)).otherwise(0).cast("bigint").alias("failure_count"),
        F.when(F.col("state_after") == "half_open", F.col("_pos") - F.col("_e.probe") + 1)
        .otherwise(0).cast("bigint").alias("success_count"))


def _start_states(sizes: DataFrame, carry: DataFrame | None) -> DataFrame:
    if carry is None:
        return sizes.select("circuit", F.lit("closed").alias("_state"),
                            F.lit(0).cast("bigint").alias("failure_count"),
                            F.lit(0).cast("bigint").alias("success_count"),
                            F.lit(None).cast("timestamp").alias("last_failure"))
    return small(sizes.select("circuit").join(carry, "circuit", "left").select(
        "circuit", F.coalesce("state", F.lit("closed")).alias("_state"),
        F.coalesce("failure_count", F.lit(0)).cast("bigint").alias("failure_count"),
        F.coalesce("success_count", F.lit(0)).cast("bigint").alias("success_count"),
        "last_failure"))


def _replay_controlled(calls: DataFrame, controls: DataFrame, carry: DataFrame | None,
                       time_slice: int | None, **settings) -> DataFrame:
    """Replay with restarts: every control opens a new segment of its circuit."""
    marks = controls.select("circuit", "ts", F.struct("ts", "action").alias("_c")).groupBy(
        "circuit", "ts").agg(F.max("_c").alias("_c"))
    from .ordered import asof

    cutup = asof(calls, marks, ["circuit"], "ts", "_c", time_slice)
    name = F.concat_ws("\x1f", "circuit", micros(F.col("_c.ts")).cast("string"))
    segmented = cut(cutup.withColumns({"_circuit": F.col("circuit"), "circuit": name}))
    starts = segmented.where("_c IS NOT NULL").groupBy("circuit").agg(
        F.first("_c").alias("_c")).select(
        "circuit", F.when(F.col("_c.action") == "force_open", "open").otherwise("closed")
        .alias("state"), F.lit(0).cast("bigint").alias("failure_count"),
        F.lit(0).cast("bigint").alias("success_count"), F.col("_c.ts").alias("last_failure"))
    if carry is not None:
        starts = starts.unionByName(carry.select(*starts.columns))
    out = replay(segmented.drop("_c"), carry=starts, time_slice=time_slice, **settings)
    return out.withColumn("circuit", F.col("_circuit")).drop("_circuit")


def end_states(replayed: DataFrame, carry: DataFrame | None = None,
               controls: DataFrame | None = None) -> DataFrame:
    """The CARRY rows after the given calls and controls; circuits without either keep theirs.

    A control that no call follows decides the circuit's state itself.
    """
    last = F.max_by(F.struct("state_after", "failure_count", "success_count"),
                    F.struct("ts", "call_id"))
    missed = F.max(F.when(F.col("outcome") == "failure", F.col("ts")))
    now = replayed.groupBy("circuit").agg(last.alias("_l"), missed.alias("last_failure")).select(
        "circuit", F.col("_l.state_after").alias("state"), "_l.failure_count", "_l.success_count",
        "last_failure")
    if controls is not None:
        mark = F.max(F.struct("ts", "action"))
        told = controls.groupBy("circuit").agg(mark.alias("_c"))
        called = replayed.groupBy("circuit").agg(F.max("ts").alias("_called"))
        late = told.join(called, "circuit", "left").where(
            F.col("_called").isNull() | (F.col("_called") < F.col("_c.ts"))).select(
            "circuit", F.when(F.col("_c.action") == "force_open", "open").otherwise("closed")
            .alias("state"), F.lit(0).cast("bigint").alias("failure_count"),
            F.lit(0).cast("bigint").alias("success_count"), F.col("_c.ts").alias("last_failure"))
        now = now.join(late, "circuit", "left_anti").unionByName(late)
    if carry is None:
        return now
    old = carry.withColumnsRenamed({c: f"_{c}" for c in carry.columns if c != "circuit"})
    return old.join(now, "circuit", "full").select(
        "circuit", *[F.coalesce(c, f"_{c}").alias(c) for c in
                     ("state", "failure_count", "success_count", "last_failure")])


def call_statistics(replayed: DataFrame, recent: int = 100) -> DataFrame:
    """Per circuit: totals, success and failure % of all calls, and the newest `recent` executed
    ones' success % and mean time (of those with a time), as the breaker reports them."""
    n = F.count("*")
    ok, bad = F.count_if(F.col("outcome") == "success"), F.count_if(F.col("outcome") == "failure")
    total = replayed.groupBy("circuit").agg(
        n.alias("total_calls"), ok.alias("total_successes"), bad.alias("total_failures"),
        F.count_if(F.col("outcome") == "rejected").alias("rejected_calls"),
        F.round(ok / n * 100, 2).alias("success_rate_percent"),
        F.round(bad / n * 100, 2).alias("failure_rate_percent"))
    newest = recent_calls(replayed, recent)
    timed = F.when(F.col("execution_time") > 0, F.col("execution_time"))
    late = newest.groupBy("circuit").agg(
        F.round(F.count_if("success") / F.count("*") * 100, 2).alias("recent_success_rate_percent"),
        F.round(F.coalesce(F.avg(timed), F.lit(0.0)) * 1000, 2).alias("avg_execution_time_ms"))
    return total.join(late, "circuit", "left")


def recent_calls(replayed: DataFrame, n: int = 50, keys: Sequence[str] = ("circuit",)) -> DataFrame:
    """The newest n executed calls per circuit."""
    done = replayed.where("outcome != 'rejected'").select(
        "circuit", "ts", "call_id", "success", "execution_time")
    return top_per_key(done, list(keys), [F.col("ts").desc(), F.col("call_id").desc()], n)
