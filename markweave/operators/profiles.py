"""Overall scores against the mean of the traits, and equal profiles with different Overall scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markweave.functions.scores import half_up, rounded
from markweave.operators.correlation import correlations
from markweave.schema import OVERALL, TRAITS

#: Stored and recomputed trait means may differ by so much.
TOLERANCE = 1e-12


def _trait_sum():
    # Scores of valid rows are whole, so the sum is exact and a safe key where a mean isn't.
    return sum((F.col(t) for t in TRAITS[1:]), F.col(TRAITS[0])).cast("int")


def differing_means(valid: DataFrame) -> DataFrame:
    """Trait sums that come with more than one Overall score."""
    return valid.groupBy(_trait_sum().alias("trait_sum")).agg(F.min(OVERALL).alias("least"), F.max(OVERALL).alias("most")).where("least < most").select("trait_sum")


def trait_mean_relation(valid: DataFrame) -> DataFrame:
    mean = F.col("trait_sum") / F.lit(6.0)
    gap = F.col(OVERALL) - mean
    rows = valid.select("source_row_id", "Filename", "text_id_kaggle", "rater_id", OVERALL, *TRAITS, _trait_sum().alias("trait_sum"))
    # At most 25 sums exist (6 to 30), so the flag side is broadcast whatever the data.
    flags = F.broadcast(differing_means(valid).withColumn("differs", F.lit(True)))
    return rows.join(flags, "trait_sum", "left").select(
        "source_row_id", "Filename", "text_id_kaggle", "rater_id", OVERALL, *TRAITS, rounded(mean).alias("trait_mean"), rounded(gap).alias("overall_minus_trait_mean"), rounded(F.abs(gap)).alias("absolute_overall_minus_trait_mean"),
        half_up(mean).alias("rounded_trait_mean_half_up"), (half_up(mean) == F.col(OVERALL)).alias("rounded_trait_mean_matches_overall"), F.coalesce("differs", F.lit(False)).alias("same_trait_mean_has_different_overall"),
    )


def same_profile_different_overall(valid: DataFrame) -> DataFrame:
    """Groups of equal trait profiles whose Overall scores differ."""
    values = F.array_join(F.transform(F.sort_array(F.collect_set(F.col(OVERALL).cast("int"))), lambda x: x.cast("string")), "|")
    groups = valid.groupBy(*TRAITS).agg(F.count(OVERALL).alias("sample_count"), F.countDistinct(OVERALL).alias("unique_overall_count"), values.alias("overall_values"), F.countDistinct("rater_id").alias("rater_count"), F.countDistinct("source_row_id").alias("essay_count"))
    return groups.where("unique_overall_count > 1")


def stored_mean_error(valid: DataFrame) -> DataFrame:
    return valid.agg(F.max(F.abs(_trait_sum() / F.lit(6.0) - F.col("trait_mean"))).alias("max_error"))


def check_stored_means(valid: DataFrame, tolerance: float = TOLERANCE) -> None:
    error = stored_mean_error(valid).first().max_error
    if error is not None and error > tolerance:
        raise ValueError(f"stored and recomputed trait means differ by {error}")


def trait_mean_metrics(valid: DataFrame) -> DataFrame:
    """(``metric``, ``value``) with eleven facts."""
    mean = F.col("trait_sum") / F.lit(6.0)
    rows = valid.select(F.col(OVERALL).alias("o"), _trait_sum().alias("trait_sum"), "trait_mean")
    rows = rows.join(F.broadcast(differing_means(valid).withColumn("differs", F.lit(True))), "trait_sum", "left")
    gap = F.col("o") - mean
    one = rows.agg(
        rounded(F.max(F.abs(mean - F.col("trait_mean")))).alias("trait_mean_validation_max_error"), rounded(F.avg(gap)).alias("mean_overall_minus_trait_mean"), rounded(F.median(gap)).alias("median_overall_minus_trait_mean"),
        rounded(F.avg(F.abs(gap))).alias("mean_absolute_overall_minus_trait_mean"), rounded(F.avg((half_up(mean) == F.col("o")).cast("double"))).alias("rounded_trait_mean_agreement_rate"),
        F.count_if(F.col("differs")).cast("double").alias("same_trait_mean_different_overall_sample_count"), F.countDistinct(F.when(F.col("differs"), F.col("trait_sum"))).cast("double").alias("same_trait_mean_different_overall_mean_value_count"),
    )
    r = correlations(valid.select(F.lit(1).alias("one"), F.col(OVERALL).alias("x"), _trait_sum().alias("y")), ["one"])
    r = r.agg(F.max("pearson_correlation").alias("pearson_overall_trait_mean"), F.max("spearman_correlation").alias("spearman_overall_trait_mean"))  # a row even without pairs
    g = same_profile_different_overall(valid).agg(F.count("*").cast("double").alias("same_profile_different_overall_group_count"), F.coalesce(F.sum("sample_count"), F.lit(0)).cast("double").alias("same_profile_different_overall_sample_count"))
    long = [df.unpivot([], df.columns, "metric", "value") for df in (one, r, g)]
    return long[0].unionByName(long[1]).unionByName(long[2])
