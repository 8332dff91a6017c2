"""Pearson and Spearman correlations, guarded and without a global sort.

Scores have few distinct values, so both come from the contingency table of each pair of variables: counts shrink the
rows before any shuffle, ranks are running sums over the distinct values. Measures with as many values as rows are ranked over
range partitions instead (``spread``), so that no task holds a variable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markweave.functions.scores import pearson, rounded
from markweave.operators.ranking import running_before
from markweave.schema import OVERALL, TRAITS

PREDICTORS = (*TRAITS, "trait_mean", "trait_min", "trait_max", "trait_std")


def _ranked(cells: DataFrame, keys: list[str], c: str) -> DataFrame:
    """``cells`` with the average rank ``r`` + ``c`` of their value ``c``; only distinct values with their number are ranked."""
    values = running_before(cells.groupBy(*keys, c).agg(F.sum("n").alias("_n")), keys, [c], F.col("_n"), "_before")
    return cells.join(values.select(*keys, c, (F.col("_before") + (F.col("_n") + 1) / F.lit(2.0)).alias(f"r{c}")), [*keys, c])


def contingency(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y", spread: bool = False) -> DataFrame:
    """``keys``, ``x``, ``y``, ``n`` and the average ranks ``rx``, ``ry``: the distinct complete pairs with their number."""
    cells = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").alias("n"))
    if spread:
        return _ranked(_ranked(cells, keys, "x"), keys, "y")
    by = [F.col(k) for k in keys] or [F.lit(1)]
    before = lambda c: Window.partitionBy(*by).orderBy(c).rangeBetween(Window.unboundedPreceding, 0)
    rank = lambda c: F.sum("n").over(before(c)) - (F.sum("n").over(Window.partitionBy(*by, c)) - 1) / F.lit(2.0)
    return cells.withColumn("rx", rank("x")).withColumn("ry", rank("y"))


def weighted_sums(prefix: str, u, v) -> list:
    """The five sums over counted pairs that a correlation or kappa needs."""
    n = F.col("n")
    return [F.sum(c).cast("double").alias(f"{prefix}{k}") for k, c in (("a", n * u), ("b", n * v), ("aa", n * u * u), ("bb", n * v * v), ("ab", n * u * v))]


def from_sums(prefix: str, measure=pearson, total: str = "_n"):
    return rounded(measure(F.col(total), *(F.col(f"{prefix}{k}") for k in ("a", "b", "aa", "bb", "ab"))))


def correlations(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y", spread: bool = False) -> DataFrame:
    """``keys`` with ``count``, ``pearson_correlation`` and ``spearman_correlation`` of the complete pairs.

    Null under two pairs or where a side is constant.
    """
    total = contingency(pairs, keys, x, y, spread).groupBy(*keys).agg(F.sum("n").cast("double").alias("_n"), *weighted_sums("p", F.col("x"), F.col("y")), *weighted_sums("s", F.col("rx"), F.col("ry")))
    return total.select(*keys, F.col("_n").cast("long").alias("count"), from_sums("p").alias("pearson_correlation"), from_sums("s").alias("spearman_correlation"))


def predictor_pairs(valid: DataFrame, keys: list[str], predictors=PREDICTORS) -> DataFrame:
    """``keys``, ``predictor``, ``x`` (Overall) and ``y``; equal means are equal values, so that they tie in rank."""
    cols = [F.round(F.col(p).cast("double"), 9).alias(p) for p in predictors]
    return valid.select(*keys, F.col(OVERALL).cast("double").alias("x"), *cols).unpivot([*keys, "x"], list(predictors), "predictor", "y")


def overall_correlations(valid: DataFrame) -> DataFrame:
    return correlations(predictor_pairs(valid, []), ["predictor"])


def rater_correlations(valid: DataFrame) -> DataFrame:
    return correlations(predictor_pairs(valid.where("rater_id IS NOT NULL"), ["rater_id"], (*TRAITS, "trait_mean")), ["rater_id", "predictor"])


def correlation_ranges(by_rater: DataFrame) -> DataFrame:
    """Least, greatest and spread of the raters' correlations per predictor, the widest range first."""
    c = "pearson_correlation"
    out = by_rater.groupBy("predictor").agg(F.min(c).alias("min"), F.max(c).alias("max"), rounded(F.stddev_samp(c)).alias("std"))
    return out.withColumn("range", rounded(F.col("max") - F.col("min"))).orderBy(F.desc("range"), "predictor")


def strongest_predictor(overall: DataFrame) -> DataFrame:
    return overall.where(F.col("predictor").isin(*TRAITS)).orderBy(F.abs("pearson_correlation").desc_nulls_last(), "predictor").limit(1)
