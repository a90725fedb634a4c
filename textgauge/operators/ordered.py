"""Ordered work over keys of any size.

A plain window over a key puts that key's whole history in one task. The operators here cut every
key into chunks of its order (time slices, rank slices), work inside (key, chunk) groups, and carry
what crosses a chunk border through a small table with one row per (key, chunk). One busy key is
then spread over as many tasks as it has chunks, and results stay exact.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def micros(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def slice_of(pos: str, width: int) -> Column:
    """Chunk number of an integer position."""
    return F.floor(F.col(pos) / F.lit(width)).cast("bigint")


#: Time slices in µs, widest first: 90 days, a day, an hour, a minute, a second.
SLICES = (7_776_000_000_000, 86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000)
SLICE_ROWS = 500_000


def slice_width(df: DataFrame, keys: Sequence[str], pos: str, max_rows: int = SLICE_ROWS,
                widths: Sequence[int] = SLICES) -> int:
    """The widest of `widths` whose fullest (key, slice) holds at most `max_rows`, else the last.

    One job: rows are counted, combined map-side, at the finest width, and these counts are rolled
    up to all widths at once.
    """
    fine = widths[-1]
    counts = df.groupBy(*keys, slice_of(pos, fine).alias("_s")).agg(F.count("*").alias("_n"))
    at = F.explode(F.array(*[F.struct(F.lit(w).cast("bigint").alias("_w"), F.floor(F.col("_s") * fine / w).alias("_c")) for w in widths]))
    rolled = counts.select(*keys, "_n", at.alias("_a")).groupBy(*keys, "_a").agg(F.sum("_n").alias("_n"))
    fullest = {r["_w"]: r["_n"] for r in rolled.groupBy("_a._w").agg(F.max("_n").alias("_n")).collect()}  # one row a width
    return next((w for w in widths if fullest.get(w, 0) <= max_rows), fine)


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest `order` values. Combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(top.alias("_r")).select(*keys, "_r.*").select(*df.columns)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                salts: int | None = None, share_rows: int = SLICE_ROWS) -> DataFrame:
    """The first n rows per key by `order` (which must be total).

    A key is dealt to as many shares as it takes for the fullest key to have about share_rows rows
    in each; every share keeps its own first n before the key is brought together.
    """
    if salts is None:
        most = df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
        salts = max(1, -(-most // share_rows))
    plain = [f.name for f in df.schema if not any(
        t in f.dataType.simpleString() for t in ("map<", "variant"))]
    base = df.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)))
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    first = base.withColumn("_rn", F.row_number().over(inner)).where(F.col("_rn") <= n)
    return (first.drop("_salt", "_rn").withColumn("_rn", F.row_number().over(outer))
            .where(F.col("_rn") <= n).drop("_rn"))


#: Bits of an order's position that one pass of first_n tells apart.
PASS_BITS = 16


def first_n(df: DataFrame, keys: Sequence[str], pos: Column, order: Sequence[Column], n: int | Column,
            bits: int = 62, mark: str | None = None, few: int = SLICE_ROWS) -> DataFrame:
    """The first n rows per key by (pos, order), by selection instead of numbering all rows.

    pos is an integer in [0, 2^bits); order, which must be total together with it, decides among equal positions. n may
    be a column that is the same for all rows of a key. Each pass counts the rows of a key by the next PASS_BITS bits of
    pos, map-side combined, among those that share the bits found so far, until the range in which the n-th row lies has
    `few` rows of a key at most; only these are ordered. With `mark`, all rows come back, with that boolean column.
    """
    want = F.lit(n).cast("bigint") if isinstance(n, int) else n.cast("bigint")
    rows = df.withColumns({"_pos": pos.cast("bigint"), "_want": want, "_g": F.struct(F.lit(0).alias("_0"), *keys)})
    found, at = None, bits  # per key the range of its n-th row, and the rows before it
    while at > 0 and (found is None or (found.agg(F.max("_n")).first()[0] or 0) > few):
        shift = max(0, at - PASS_BITS)
        part, held = rows, ["_g"]
        if found is not None:
            part = rows.join(found.select("_g", "_range", "_before"), "_g").where(F.shiftright("_pos", at) == F.col("_range"))
            held.append("_before")
        counts = part.groupBy(*held, F.shiftright("_pos", shift).alias("_range")).agg(
            F.count("*").alias("_n"), F.max("_want").alias("_want"))
        run = Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        start = F.coalesce(F.sum("_n").over(run), F.lit(0)) + (F.lit(0) if found is None else F.col("_before"))
        placed = counts.withColumn("_start", start).where(
            (F.col("_start") < F.col("_want")) & (F.col("_start") + F.col("_n") >= F.col("_want")))
        found, at = cut(placed.select("_g", "_range", F.col("_start").alias("_before"), "_n")), shift
    # Keys with fewer rows than wanted have no such range: all of theirs are taken.
    joined = rows.join(found.drop("_n"), "_g", "left").withColumn("_mine", F.shiftright("_pos", at))
    flag = mark or "_first"
    inside = F.coalesce(F.col("_mine") == F.col("_range"), F.lit(False))
    rest = joined.where(~inside).withColumn(flag, (F.col("_want") > 0) & (F.col("_range").isNull() | (F.col("_mine") < F.col("_range"))))
    number = F.row_number().over(Window.partitionBy("_g").orderBy("_pos", *order))
    tied = joined.where(inside).withColumn(flag, F.col("_before") + number <= F.col("_want"))
    out = rest.select(*df.columns, flag).unionByName(tied.select(*df.columns, flag))
    return out if mark else out.where(flag).drop(flag)


def rank_in_key(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[Column],
                out: str = "rank", total: str | None = None) -> DataFrame:
    """Row number per key over (chunk, order); `chunk` must rise with the wanted order.

    Window and join are keyed by the same struct of keys and chunk, so the rows are shuffled once.
    """
    df, sizes, before = _grouped(df, keys, chunk, F.count("*").alias("_n"))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("_n").over(Window.partitionBy("_keys")))
    local = df.withColumn("_local", F.row_number().over(Window.partitionBy("_g").orderBy(*order)))
    joined = local.join(offsets.drop("_n", "_keys"), "_g")
    df = df.drop("_g")
    cols = [*df.columns, *([total] if total else [])]
    return joined.select(*cols, (F.col("_before") + F.col("_local")).cast("bigint").alias(out))


def _grouped(df: DataFrame, keys: Sequence[str], chunk: str, *aggregates: Column):
    """df with its (keys, chunk) as the struct _g, aggregates per _g with the struct _keys, and the
    window of a key's chunks before each chunk.

    Structs compare as equal when their fields are, NULLs included: NULL keys need no special join.
    """
    df = df.withColumn("_g", F.struct(*keys, chunk))
    per = df.groupBy("_g").agg(*aggregates).withColumn(
        "_keys", F.struct(F.lit(0).alias("_0"), *[F.col(f"_g.{k}").alias(k) for k in keys]))
    order = Window.partitionBy("_keys").orderBy(f"_g.{chunk}")
    return df, per, order.rowsBetween(Window.unboundedPreceding, -1)


def running_count(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[Column],
                  flag: Column, out: str) -> DataFrame:
    """Per key, how many rows up to and including this one have `flag`."""
    columns = df.columns
    one = F.when(flag, 1).otherwise(0).cast("bigint")
    df, sizes, before = _grouped(df, keys, chunk, F.sum(one).alias("_n"))
    offsets = sizes.select("_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.withColumn("_local", F.sum(one).over(inside)).join(offsets, "_g")
    return joined.select(*columns, (F.col("_before") + F.col("_local")).cast("bigint").alias(out))


def carry_last(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str],
               value: str, out: str, strict: bool = False) -> DataFrame:
    """Per key, the latest non-NULL `value` at or before each row (before it, if strict)."""
    columns = df.columns
    at = F.when(F.col(value).isNotNull(), F.struct(*order))  # rows without a value don't count
    df, edge, before = _grouped(df, keys, chunk, F.max_by(value, at).alias("_v"))
    edge = edge.select("_g", F.last("_v", ignorenulls=True).over(before).alias("_carry"))
    end = -1 if strict else 0
    inside = Window.partitionBy("_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    joined = df.withColumn("_here", F.last(value, ignorenulls=True).over(inside)).join(edge, "_g")
    return joined.select(*columns, F.coalesce("_here", "_carry").alias(out))


def carry_next(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str],
               value: str, out: str) -> DataFrame:
    """Per key, the first non-NULL `value` at or after each row."""
    columns = df.columns
    at = F.when(F.col(value).isNotNull(), F.struct(*order))
    df, edge, _ = _grouped(df, keys, chunk, F.min_by(value, at).alias("_v"))
    # Read backwards, so the frames stay running ones.
    after = Window.partitionBy("_keys").orderBy(F.desc(f"_g.{chunk}")).rowsBetween(
        Window.unboundedPreceding, -1)
    edge = edge.select("_g", F.last("_v", ignorenulls=True).over(after).alias("_carry"))
    inside = Window.partitionBy("_g").orderBy(*[F.col(c).desc() for c in order]).rowsBetween(
        Window.unboundedPreceding, 0)
    joined = df.withColumn("_here", F.last(value, ignorenulls=True).over(inside)).join(edge, "_g")
    return joined.select(*columns, F.coalesce("_here", "_carry").alias(out))


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, payload: str,
         width: int | None = None) -> DataFrame:
    """Attach to each left row the `payload` of the latest right row with ts at or before its own.

    The slices are the widest that hold at most SLICE_ROWS rows of a key, unless given. Both sides are laid in one time-sliced sequence per key; right rows sort first at equal times.
    """
    rest = [c for c in left.columns if c not in (*keys, ts)]
    kind = right.schema[payload].dataType
    a = left.select(*keys, ts, F.lit(1).alias("_side"), F.struct(*(rest or [ts])).alias("_row"),
                    F.lit(None).cast(kind).alias("_p"))
    b = right.select(*keys, ts, F.lit(0).alias("_side"),
                     F.lit(None).cast(a.schema["_row"].dataType).alias("_row"),
                     F.col(payload).alias("_p"))
    both = a.unionByName(b).withColumn("_pos", micros(ts))
    both = both.withColumn("_chunk", slice_of("_pos", width or slice_width(both, keys, "_pos")))
    filled = carry_last(both, keys, "_chunk", ["_pos", "_side"], "_p", payload)
    hit = filled.where(F.col("_side") == 1)
    return hit.select(*keys, ts, *[F.col(f"_row.{c}").alias(c) for c in rest], payload).select(
        *left.columns, payload)


def next_at_or_after(points: DataFrame, probes: DataFrame, keys: Sequence[str], at: str,
                     value: str, width: int) -> DataFrame:
    """For each probe, the `value` of the first point with `at` at or after the probe's `at`."""
    rest = [c for c in probes.columns if c not in (*keys, at)]
    kind = points.schema[value].dataType
    a = probes.select(*keys, at, F.lit(0).alias("_side"), F.struct(*(rest or [at])).alias("_row"),
                      F.lit(None).cast(kind).alias("_p"))
    b = points.select(*keys, F.col(at), F.lit(1).alias("_side"),
                      F.lit(None).cast(a.schema["_row"].dataType).alias("_row"),
                      F.col(value).alias("_p"))
    both = a.unionByName(b).withColumn("_chunk", slice_of(at, width))
    filled = carry_next(both, keys, "_chunk", [at, "_side", "_p"], "_p", "_next")
    return filled.where(F.col("_side") == 0).select(
        *keys, at, *[F.col(f"_row.{c}").alias(c) for c in rest], "_next")


def mark_chain(nodes: DataFrame, starts: DataFrame, key: str, width: int) -> DataFrame:
    """Rows of `nodes` reached from `starts` by following their pointers.

    nodes: (key, pos, nxt), nxt > pos or NULL; starts: (key, pos), at most one per key.
    Pointers are followed in three steps: inside each (key, chunk) to the first node outside it;
    between the chunks' entry nodes by pointer doubling, so the number of rounds is the logarithm
    of the number of chunks; inside each chunk again from its one entry node.
    """
    base = cut(nodes.select(key, "pos", "nxt", slice_of("pos", width).alias("chunk")))
    kind = base.schema[key].dataType.simpleString()
    reached = starts.select(key, "pos")
    chunks = base.groupBy(key).agg(F.count_distinct("chunk").alias("n")).agg(F.max("n")).first()[0]
    if (chunks or 1) > 1:
        reached = _entries(base, reached, key, kind, int(chunks))
    entry = reached.select(
        F.col(key).alias("_k"), F.col("pos").alias("entry"),
        slice_of("pos", width).alias("_c"))
    inside = base.join(entry, (F.col(key) == F.col("_k")) & (F.col("chunk") == F.col("_c")))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        pos = pdf["pos"].to_numpy()
        nxt = pdf["nxt"].astype("Int64").fillna(np.iinfo(np.int64).max).to_numpy(np.int64)
        hits, at = [], int(pdf["entry"].iloc[0])
        while at <= pos[-1]:
            i = int(np.searchsorted(pos, at))
            hits.append(pos[i])
            at = int(nxt[i])
        return pd.DataFrame({key: pdf[key].iloc[0], "pos": pd.Series(hits, dtype="int64")})

    return inside.groupBy(key, "chunk").applyInPandas(walk, f"{key} {kind}, pos bigint")


def _entries(base: DataFrame, starts: DataFrame, key: str, kind: str, chunks: int) -> DataFrame:
    """The node by which the path from each start enters each of its chunks."""
    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        out = _exits(pdf["pos"].to_numpy(), pdf["nxt"])
        return pd.DataFrame({key: pdf[key], "pos": pdf["pos"], "leaves": out})

    exits = cut(base.groupBy(key, "chunk").applyInPandas(
        leave, f"{key} {kind}, pos bigint, leaves bigint"))
    targets = exits.where("leaves IS NOT NULL").select(key, F.col("leaves").alias("pos"))
    nodes = targets.unionByName(starts).distinct()
    jump = cut(exits.join(nodes, [key, "pos"], "left_semi").select(
        key, "pos", F.col("leaves").alias("to")))
    reached = starts
    # After r rounds the path's first 2^r nodes are known; it enters each chunk once.
    for _ in range((chunks - 1).bit_length()):
        step = reached.join(jump, [key, "pos"]).where("to IS NOT NULL").select(
            key, F.col("to").alias("pos"))
        reached = cut(reached.unionByName(step).distinct())
        far = jump.select(key, F.col("pos").alias("to"), F.col("to").alias("far"))
        jump = cut(jump.join(far, [key, "to"], "left").select(
            key, "pos", F.col("far").alias("to")))
    return reached


def _exits(pos: np.ndarray, nxt: pd.Series) -> pd.Series:
    """For each node of a chunk, the first node outside the chunk on its path (NULL: path ends)."""
    far = np.iinfo(np.int64).max
    to = nxt.astype("Int64").fillna(far).to_numpy(np.int64)
    n = len(pos)
    inner = to <= pos[-1]
    hop = np.where(inner, np.searchsorted(pos, to), np.arange(n))
    while True:
        again = hop[hop]
        if np.array_equal(again, hop):
            break
        hop = again
    out = pd.Series(to[hop], dtype="Int64")
    return out.mask(out == far)


def value_tally(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, v, n): how often each value occurs in each column, in one pass over df."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns]))
    long = df.select(pairs.alias("p")).select("p.*").where("v IS NOT NULL")
    return long.groupBy("name", "v").agg(F.count("*").alias("n"))


def exact_quantiles(tally: DataFrame, probabilities: Sequence[float], cells: int = 256,
                    ) -> DataFrame:
    """Linear-interpolated quantiles from a value tally: (name, probability, value).

    Each column's distinct values are cut into `cells` ranges of about equal size; counts per range
    locate the ranges that hold a wanted rank, and only those are sorted. No task sees more than
    one range's distinct values.
    """
    steps = [i / cells for i in range(1, cells)]
    edges = tally.groupBy("name").agg(
        F.array_distinct(F.percentile_approx("v", steps, 10_000)).alias("edges"),
        F.sum("n").alias("total"))
    # One row per profiled column.
    edges = F.broadcast(cut(edges))
    placed = tally.join(edges.drop("total"), "name").withColumn(
        "cell", F.size(F.filter("edges", lambda e: e < F.col("v")))).drop("edges")
    before = Window.partitionBy("name").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    spans = placed.groupBy("name", "cell").agg(F.sum("n").alias("size")).withColumn(
        "below", F.coalesce(F.sum("size").over(before), F.lit(0)))
    wanted = edges.select("name", "total", F.explode(
        F.array(*[F.lit(float(p)) for p in probabilities])).alias("probability"))
    wanted = wanted.withColumn("at", F.col("probability") * (F.col("total") - 1)).withColumn(
        "rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
    found = spans.join(wanted, "name").where(
        (F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("size")))
    inner = Window.partitionBy("name", "cell").orderBy("v").rowsBetween(
        Window.unboundedPreceding, 0)
    need = found.select("name", "cell").distinct()
    # At most two ranks per column and probability.
    ladder = placed.join(F.broadcast(need), ["name", "cell"], "left_semi").withColumn(
        "upto", F.sum("n").over(inner))
    top = F.col("below") + F.col("upto")
    hit = ladder.join(F.broadcast(found), ["name", "cell"]).where(
        (F.col("rank") >= top - F.col("n")) & (F.col("rank") < top))
    ends = hit.groupBy("name", "probability", "at").agg(
        F.min_by("v", "rank").alias("lo"), F.max_by("v", "rank").alias("hi"))
    share = F.col("at") - F.floor("at")
    return ends.select("name", "probability",
                       (F.col("lo") + (F.col("hi") - F.col("lo")) * share).alias("value"))


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, quartiles and max of each column, from one pass over df."""
    tally = cut(value_tally(df, columns))
    base = tally.groupBy("name").agg(
        F.sum("n").alias("count"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    off = F.pow(F.col("v") - F.col("mean"), 2) * F.col("n")
    spread = tally.join(F.broadcast(base.select("name", "mean")), "name").groupBy("name").agg(
        F.sum(off).alias("_ss"))
    q = exact_quantiles(tally, [0.25, 0.5, 0.75]).groupBy("name").agg(*[
        F.max(F.when(F.col("probability") == p, F.col("value"))).alias(c)
        for p, c in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    return base.join(spread, "name").join(q, "name").select(
        "name", "count", "mean",
        F.sqrt(F.try_divide(F.col("_ss"), F.col("count") - 1)).alias("std"),
        "min", "q25", "q50", "q75", "max")
