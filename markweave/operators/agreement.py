"""Agreement of two scores and prediction metrics, in one pass over the pairs' contingency table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markweave.functions.scores import error_columns, quadratic_kappa, rounded
from markweave.operators.correlation import contingency, from_sums, weighted_sums


def agreement_metrics(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Rates, errors, correlations and both kappas of the complete pairs per ``keys``.

    Kappa categories are half points; the quadratic one weighs by the category's place among those present, as usual
    for categorical data. ``paired_count`` counts the pairs; a key without pairs is absent.
    """
    cells = contingency(pairs, keys, a, b)
    by = Window.partitionBy(*([F.col(k) for k in keys] or [F.lit(1)]))
    i, j = (F.rint(F.col(c) * 2).cast("int") for c in ("x", "y"))
    cells = cells.withColumn("i", i).withColumn("j", j)
    # A few categories per key, so they and the cells fit in an array.
    present = F.array_sort(F.array_union(F.collect_set("i").over(by), F.collect_set("j").over(by)))
    cells = cells.withColumn("present", present).withColumn("p", F.array_position("present", F.col("i"))).withColumn("q", F.array_position("present", F.col("j")))
    d, n = F.col("x") - F.col("y"), F.col("n")
    total = lambda c: F.sum(n * c.cast("double"))
    sums = {"e": d == 0, "w": F.abs(d) <= 1, "o": F.abs(d) == 1, "t": F.abs(d) >= 2, "d": d, "ad": F.abs(d), "dd": d * d, "same": F.col("i") == F.col("j")}
    one = cells.groupBy(*keys).agg(
        F.sum("n").cast("double").alias("_n"), *(total(c).alias(f"_{k}") for k, c in sums.items()), F.collect_list(F.struct("i", "j", "n")).alias("cells"),
        *weighted_sums("p", F.col("x"), F.col("y")), *weighted_sums("s", F.col("rx"), F.col("ry")), *weighted_sums("k", F.col("p"), F.col("q")),
    )
    column = lambda c: F.aggregate(F.filter("cells", lambda y: y["j"] == c), F.lit(0.0), lambda t, y: t + y["n"])
    chance = F.try_divide(F.aggregate("cells", F.lit(0.0), lambda t, c: t + c["n"] * column(c["i"])), F.col("_n") * F.col("_n"))
    share = lambda k: rounded(F.try_divide(f"_{k}", "_n"))
    return one.select(
        *keys, F.col("_n").cast("long").alias("paired_count"), share("e").alias("exact_agreement_rate"), share("w").alias("within_one_point_rate"), share("o").alias("one_point_difference_rate"), share("t").alias("two_or_more_point_rate"),
        share("d").alias("mean_signed_difference"), share("ad").alias("mean_absolute_difference"), rounded(F.sqrt(F.try_divide("_dd", "_n"))).alias("rmse"),
        from_sums("p").alias("pearson_correlation"), from_sums("s").alias("spearman_correlation"), rounded(F.try_divide(F.try_divide("_same", "_n") - chance, 1 - chance)).alias("cohen_kappa"), from_sums("k", quadratic_kappa).alias("quadratic_weighted_kappa"),
    )


def prediction_metrics(predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Number, accuracy, MAE, RMSE and quadratic weighted kappa (by score values) of the predictions that there are."""
    keys = keys or []
    g, p = F.col("gold_overall").cast("double"), F.col("predicted_overall").cast("double")
    rows = predictions.where("predicted_overall IS NOT NULL AND gold_overall IS NOT NULL").withColumns(error_columns())
    s = lambda c: F.sum(c)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), rounded(F.avg(F.col("exact_correct").cast("double"))).alias("exact_accuracy"), rounded(F.avg("absolute_error")).alias("mae"), rounded(F.sqrt(F.avg("squared_error"))).alias("rmse"),
        rounded(quadratic_kappa(F.count("*").cast("double"), s(g), s(p), s(g * g), s(p * p), s(g * p))).alias("qwk"),
    )
