"""A kernel machine that scales: random Fourier features of the Gaussian kernel, a linear machine per class on them, and
sigmoid calibration of its margins (Rahimi and Recht 2007; Platt 1999).

The kernel exp(-gamma |x - y|^2) is the mean of cos(w.(x - y)) over directions w drawn from a normal distribution. The map
takes DIMENSIONS such directions in pairs of a sine and a cosine, so the inner product of two mapped rows misses the
kernel by about 1 / sqrt(DIMENSIONS) and, unlike with random phases, a row's with itself is 1 exactly. Directions
are made from the seed in each task; nothing but the seed travels.

Mapped rows are written once, in single precision. The machines of all classes and folds are fitted together: a pass over
the rows gives the loss and gradient of each, and keeps a block of rows in memory, so memory does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, shuffles_freed
from .boosting import entries

DIMENSIONS = 2048
FOLDS = 3
#: Change of the loss in HISTORY steps, as a share of the first one, at which a solver stops: the usual one of kernel machines.
TOLERANCE = 1e-3
#: Steps whose gradients a solver remembers, and trials of one step.
HISTORY, TRIALS = 10, 20
#: Rows of a partition while machines are fitted, and rows that are worked on at once.
PART_ROWS, STEP_ROWS = 20_000, 2_048
#: Queries, and rows, that meet in a task.
PAIR_ROWS = 2_048
#: Rows times features of a dense block in a task.
BLOCK = 1 << 22
_DIRECTIONS: dict = {}


def scale_gamma(df: DataFrame, features: str, size: int) -> float:
    """One over the number of features times the variance of all their values."""
    _, val = entries(features)
    cells = df.select(F.size(val).alias("n"), F.aggregate(val, F.lit(0.0), lambda a, x: a + x).alias("s"),
                      F.aggregate(val, F.lit(0.0), lambda a, x: a + x * x).alias("q"))
    n, s, q = cells.agg(F.count("*"), F.sum("s"), F.sum("q")).first()
    if not n:
        raise ValueError("no rows")
    variance = q / (n * size) - (s / (n * size)) ** 2
    return 1.0 / (size * variance) if variance > 0 else 1.0


def directions(size: int, dimensions: int, gamma: float, seed: int) -> np.ndarray:
    """One direction for each pair of dimensions; kept by the Python worker."""
    key = (size, dimensions, gamma, seed)
    if key not in _DIRECTIONS:
        _DIRECTIONS.clear()
        _DIRECTIONS[key] = np.random.default_rng(seed).normal(0.0, np.sqrt(2 * gamma), (size, dimensions // 2))
    return _DIRECTIONS[key]


def mapped_block(x: np.ndarray, gamma: float, dimensions: int, seed: int) -> np.ndarray:
    """The mapped rows of a dense block."""
    angle = x @ directions(x.shape[1], dimensions, gamma, seed)
    return np.concatenate([np.cos(angle), np.sin(angle)], axis=1) * np.sqrt(2.0 / dimensions)


def fourier_map(idx: Column, val: Column, size: int, gamma: float, dimensions: int = DIMENSIONS, seed: int = 42) -> Column:
    """The mapped row, an array, from the places and values of its entries that are not zero."""

    @F.pandas_udf("array<double>")
    def mapped(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for i, v in batches:
            yield pd.Series([z for x in _dense(i, v, size) for z in mapped_block(x, gamma, dimensions, seed)])

    return mapped(idx, val)


def _dense(idx: pd.Series, val: pd.Series, size: int) -> Iterator[np.ndarray]:
    """Dense blocks of rows from their entries that are not zero."""
    step = max(1, BLOCK // size)
    for at in range(0, len(idx), step):
        places, values = idx.iloc[at:at + step].to_list(), val.iloc[at:at + step].to_list()
        x = np.zeros((len(places), size))
        x[np.repeat(np.arange(len(places)), [len(p) for p in places]), np.concatenate(places).astype(np.int64)] = np.concatenate(values)
        yield x


def compared(rows: DataFrame, queries: DataFrame, key: str, vector: str, size: int, gamma: float, dimensions: int = DIMENSIONS,
             seed: int = 42, block_rows: int = PAIR_ROWS) -> DataFrame:
    """Every query with every row: query_id, key, the Gaussian kernel, and made, the inner product of the mapped rows.

    A task meets a block of queries with a block of rows in two matrix products. The vectors travel, and are mapped where
    they meet: mapped rows are DIMENSIONS / size times as large. Pairs with a null vector have null kernels.
    """
    kind = rows.schema[key].dataType.simpleString()
    rows, queries = cut(rows.select(key, vector)), cut(queries.select(key, vector))
    row_blocks, query_blocks = (max(1, -(-df.count() // block_rows)) for df in (rows, queries))
    # Whatever the keys are: places in the written tables deal rows evenly.
    place = F.xxhash64(F.monotonically_increasing_id())
    left = queries.withColumn("_q", F.pmod(place, F.lit(query_blocks))).withColumn(
        "_r", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)))).toDF("_id", "_x", "_q1", "_r1")
    right = rows.withColumn("_r", F.pmod(place, F.lit(row_blocks))).withColumn(
        "_q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).toDF("_oid", "_y", "_r2", "_q2")

    def dense(values: pd.Series) -> np.ndarray:
        none = np.full(size, np.nan)
        return np.stack([none if v is None else np.asarray(v, dtype=float) for v in values])

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=["query_id", key, "kernel", "made"])
        x, y = dense(a["_x"]), dense(b["_y"])
        gap = np.maximum((x ** 2).sum(axis=1)[:, None] + (y ** 2).sum(axis=1)[None] - 2 * (x @ y.T), 0.0)
        made = mapped_block(x, gamma, dimensions, seed) @ mapped_block(y, gamma, dimensions, seed).T
        return pd.DataFrame({"query_id": np.repeat(a["_id"].to_numpy(), len(b)), key: np.tile(b["_oid"].to_numpy(), len(a)),
                             "kernel": np.exp(-gamma * gap).ravel(), "made": made.ravel()})

    return left.withColumn("_q1", F.col("_q1").cast("int")).groupBy("_q1", "_r1").cogroup(
        right.withColumn("_r2", F.col("_r2").cast("int")).groupBy("_q2", "_r2")).applyInPandas(
        meet, f"query_id {kind}, {key} {kind}, kernel double, made double")


class KernelMachine:
    """One linear machine per class on mapped rows; margins become probabilities by a sigmoid per class."""

    def __init__(self, size: int, gamma: float, dimensions: int, seed: int, machines: np.ndarray, sigmoids: Sequence[tuple[float, float]]):
        self.size, self.gamma, self.dimensions, self.seed = size, gamma, dimensions, seed
        self.machines, self.sigmoids = machines, list(sigmoids)  # a machine is a row: its weights, then its intercept

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Append probability, an array in the order of the classes, and prediction."""
        size, gamma, dimensions, seed = self.size, self.gamma, self.dimensions, self.seed
        machines = df.sparkSession.sparkContext.broadcast(self.machines)

        @F.pandas_udf("array<double>")
        def margins(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            w = machines.value
            for i, v in batches:
                yield pd.Series([m for x in _dense(i, v, size)
                                 for m in mapped_block(x, gamma, dimensions, seed) @ w[:, :-1].T + w[:, -1]])

        scored = df.withColumn("_m", margins(*entries(features)))
        ps = [1 / (1 + F.exp(-(F.lit(a) * F.col("_m")[k] + F.lit(b)))) for k, (a, b) in enumerate(self.sigmoids)]
        scored = scored.withColumn("_p", F.array(*ps))
        total = F.aggregate("_p", F.lit(0.0), lambda s, x: s + x)
        scored = scored.withColumn("probability", F.transform("_p", lambda x: x / F.greatest(total, F.lit(1e-300))))
        top = F.array_position("probability", F.array_max("probability")) - 1
        return scored.withColumn("prediction", top.cast("double")).drop("_m", "_p")


def _blocks(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Mapped rows, labels, weights and folds of some rows at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, STEP_ROWS):
            batch = whole.slice(at, STEP_ROWS)
            z = batch.column("z")
            first = z.buffers()[1]
            start = np.frombuffer(first, np.int32)[z.offset] if len(z) else 0
            flat = np.frombuffer(z.buffers()[2], np.float32, len(z) * dimensions, int(start))
            yield flat.reshape(len(z), dimensions), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "weight", "fold"))


class _Descent:
    """Descent of one machine by a limited memory of gradients; the steps keep the weak Wolfe conditions, as hinges need it."""

    def __init__(self, size: int, tolerance: float, iterations: int):
        self.tolerance, self.left = tolerance, iterations
        self.at, self.loss, self.slope = np.zeros(size), None, None
        self.asked = self.at
        self.memory: list[tuple[np.ndarray, np.ndarray]] = []
        self.losses: list[float] = []
        self.done = False

    def told(self, loss: float, slope: np.ndarray) -> None:
        """Take loss and gradient at the asked place; ask for another one or be done."""
        if self.loss is not None:
            gone = self.step * self.rate
            if loss > self.loss + 1e-4 * gone:
                self.high = self.step
            elif slope @ self.way < 0.9 * self.rate:
                self.low = self.step
            else:
                return self._taken(loss, slope)
            self.trials += 1
            if self.trials >= TRIALS:
                # A kink: what is lower is taken, else there is nothing left to gain.
                if loss < self.loss:
                    return self._taken(loss, slope)
                self.done = True
                return None
            self.step = 2 * self.low if self.high is None else (self.low + self.high) / 2
            self.asked = self.at + self.step * self.way
            return None
        return self._taken(loss, slope)

    def _taken(self, loss: float, slope: np.ndarray) -> None:
        if self.loss is not None:
            moved, turned = self.asked - self.at, slope - self.slope
            if moved @ turned > 1e-12 * (turned @ turned):
                self.memory = [*self.memory, (moved, turned)][-HISTORY:]
            self.left -= 1
        self.at, self.loss, self.slope = self.asked, loss, slope
        self.losses.append(loss)
        recent = self.losses[-HISTORY - 1:]
        size = np.linalg.norm(slope)
        if (self.left <= 0 or size <= 1e-12 or len(recent) > HISTORY and max(recent) - loss <= self.tolerance * abs(self.losses[0])):
            self.done = True
            return
        way, kept = -slope, []
        for moved, turned in reversed(self.memory):
            share = (moved @ way) / (moved @ turned)
            way = way - share * turned
            kept.append(share)
        if self.memory:
            moved, turned = self.memory[-1]
            way = way * ((moved @ turned) / (turned @ turned))
        for (moved, turned), share in zip(self.memory, reversed(kept), strict=True):
            way = way + (share - (turned @ way) / (moved @ turned)) * moved
        if way @ slope >= 0:
            way, self.memory = -slope, []
        self.way, self.rate = way, way @ slope
        self.step, self.low, self.high, self.trials = 1.0 if self.memory else 1.0 / size, 0.0, None, 0
        self.asked = self.at + self.step * way


def _losses(rows: DataFrame, places: np.ndarray, classes: np.ndarray, without: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of each machine's weighted hinges, and of their gradients. Machine i tells classes[i] from the rest and
    does not see the rows of fold without[i]."""
    sent = rows.sparkSession.sparkContext.broadcast((places, classes, without))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, kinds, left_out = sent.value
        single, loss, slope = w[:, :-1].T.astype(np.float32), np.zeros(len(w)), np.zeros(w.shape)
        for z, label, weight, fold in _blocks(batches, w.shape[1] - 1):
            sign = np.where(label[:, None] == kinds, 1.0, -1.0)
            gap = 1 - sign * (z @ single + w[:, -1])
            share = np.where((gap > 0) & (fold[:, None] != left_out), weight[:, None], 0.0)
            loss += (share * gap).sum(axis=0)
            pull = -share * sign
            slope[:, :-1] += (z.T @ pull.astype(np.float32)).T
            slope[:, -1] += pull.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([loss.tobytes()]), pa.array([slope.tobytes()])], names=["loss", "slope"])

    loss, slope = np.zeros(len(places)), np.zeros(places.shape)
    for r in rows.mapInArrow(run, "loss binary, slope binary").collect():  # one row a partition
        loss += np.frombuffer(r["loss"])
        slope += np.frombuffer(r["slope"]).reshape(slope.shape)
    return loss, slope


def fit(df: DataFrame, label: str, classes: int, weight: str | None = None, features: str = "features", c: float = 1.0,
        iterations: int = 2000, tolerance: float = TOLERANCE, dimensions: int = DIMENSIONS, gamma: float | None = None,
        folds: int = FOLDS, seed: int = 42) -> KernelMachine:
    """Fit on rows with a class index below `classes`. The sigmoids see margins of rows that their machine has not seen.

    A machine's loss is the weighted mean of its hinges and half its squared weights over c times its rows; the intercept
    is free.
    """
    size = len(df.select(vector_to_array(features).alias("x")).head(1)[0]["x"])
    gamma = scale_gamma(df, features, size) if gamma is None else gamma
    idx, val = entries(features)
    fold = F.pmod(F.xxhash64(F.lit(seed), idx, val), F.lit(folds)).cast("int")  # equal rows are in one fold

    @F.pandas_udf("binary")
    def mapped(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for i, v in batches:
            yield pd.Series([z.tobytes() for x in _dense(i, v, size) for z in mapped_block(x, gamma, dimensions, seed).astype(np.float32)])

    spark = df.sparkSession
    rows = df.select(idx.alias("i"), val.alias("x"), F.col(label).cast("double").alias("label"),
                     (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"), fold.alias("fold"))
    total = rows.count()
    parts = max(-(-total // PART_ROWS), min(spark.sparkContext.defaultParallelism, -(-total // 1_000)), 1)
    with shuffles_freed(spark):
        rows = cut(rows.repartition(parts).select(mapped("i", "x").alias("z"), "label", "weight", "fold"))
    # One row a fold and class.
    seen = [(r["fold"], r["label"], r["n"], r["w"]) for r in rows.groupBy("fold", "label").agg(
        F.count("*").alias("n"), F.sum("weight").alias("w")).collect()]
    own = sorted({r[0] for r in seen}) if folds > 1 else []
    plans = [(k, -1) for k in range(classes)] + [
        (k, i) for k in range(classes) for i in own if len({r[1] == k for r in seen if r[0] != i}) == 2]
    kinds, without = (np.array(x) for x in zip(*plans, strict=True))
    n, mass = (np.array([sum(r[j] for r in seen if r[0] != i) for _, i in plans], dtype=float) for j in (2, 3))
    descents = [_Descent(dimensions + 1, tolerance, iterations) for _ in plans]
    while at := [i for i, d in enumerate(descents) if not d.done]:
        places = np.stack([descents[i].asked for i in at])
        loss, slope = _losses(rows, places, kinds[at], without[at])
        for j, i in enumerate(at):
            penalty = np.append(places[j, :-1], 0.0) / (c * n[i])
            descents[i].told(loss[j] / mass[i] + penalty @ places[j] / 2, slope[j] / mass[i] + penalty)
    machines = {plan: d.at for plan, d in zip(plans, descents, strict=True)}

    sent = spark.sparkContext.broadcast(machines)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for z, labels, _, places in _blocks(batches, dimensions):
            for (k, i), w in sent.value.items():
                own_rows = places == i
                if own_rows.any():
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(own_rows.sum(), k, np.int32)), pa.array(z[own_rows] @ w[:-1] + w[-1]),
                        pa.array((labels[own_rows] == k).astype(float))], names=["k", "margin", "is"])

    held = cut(rows.mapInArrow(margins, "k int, margin double, is double")) if len(plans) > classes else None

    def sigmoid(k: int) -> tuple[float, float]:
        if not any(p[0] == k and p[1] >= 0 for p in plans):
            return 1.0, 0.0
        fitted = LogisticRegression(labelCol="is", regParam=1e-6).fit(
            held.where(F.col("k") == k).withColumn("features", array_to_vector(F.array("margin"))))
        return float(fitted.coefficients[0]), float(fitted.intercept)

    return KernelMachine(size, gamma, dimensions, seed, np.stack([machines[k, -1] for k in range(classes)]), [sigmoid(k) for k in range(classes)])
