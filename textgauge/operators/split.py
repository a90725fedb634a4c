"""Exact stratified split, class counts and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import small
from .ordered import first_n


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (classes * n of the class). The window runs over one row per class."""
    every = Window.partitionBy()
    return class_counts(df, label).withColumn(
        "weight", F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")))


def test_quotas(counts: DataFrame, label: str, test_share: float = 0.2) -> DataFrame:
    """Test rows per class: proportional shares of ceil(share * n), largest remainders rounded up."""
    every = Window.partitionBy()
    total = F.sum("n").over(every)
    # The share is turned into whole per mille first: 0.2 * 4115 must not become 823.0000000000001.
    wanted = F.ceil(F.lit(round(test_share * 1000)) * total / F.lit(1000))
    shares = counts.withColumns({"_t": wanted, "_total": total}).withColumns({
        "_floor": F.floor(F.col("_t") * F.col("n") / F.col("_total")),
        "_rest": (F.col("_t") * F.col("n")) % F.col("_total")})
    order = Window.partitionBy().orderBy(F.desc("_rest"), F.desc("n"), F.col(label))
    left = F.col("_t") - F.sum("_floor").over(every)
    return shares.withColumn(
        "test_rows",
        (F.col("_floor") + F.when(F.row_number().over(order) <= left, 1).otherwise(0))
        .cast("bigint")).select(label, "n", "test_rows")


def stratified_split(df: DataFrame, key: str, label: str, test_share: float = 0.2, seed: int = 42,
                     ) -> DataFrame:
    """Append `split` ('train' / 'test'): exact per-class sizes, whatever the partitioning.

    A class's test rows are those with the least seeded digests of their key. They are found by
    selection, so no class is ordered as a whole.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    quotas = small(
        test_quotas(class_counts(df, label), label, test_share).select(label, F.col("test_rows").alias("_quota")))
    # Fifteen hexadecimal digits are the 60 bits that the selection goes by; the whole digest decides among equal ones.
    hashed = df.withColumn("_digest", digest).withColumn(
        "_at", F.conv(F.substring("_digest", 1, 15), 16, 10).cast("bigint")).join(quotas, label)
    marked = first_n(hashed, [label], F.col("_at"), [F.col("_digest"), F.col(key)], F.col("_quota"), bits=60, mark="_test")
    return marked.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).select(*df.columns, "split")


def split_info(split: DataFrame, label: str) -> DataFrame:
    """Rows per split and class, with the totals."""
    return split.rollup("split", label).agg(F.count("*").alias("n"))
