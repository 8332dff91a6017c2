"""Descriptive tables: samples, scores, traits, gaps and text lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markweave.functions import text as X
from markweave.functions.scores import all_valid, any_missing, half_up, is_valid, rater_prefix_key, rounded
from markweave.schema import LEVELS, OVERALL, SCORES, TRAITS


def valid_samples(wide: DataFrame) -> DataFrame:
    """Rows whose seven scores are all on the scale; plain memberships, which reach the scan (a null passes none)."""
    for name in SCORES:
        wide = wide.where(F.col(name).isin(*(float(k) for k in LEVELS)))
    return wide


def _statistics(c: Column) -> list[Column]:
    return [F.count(c).alias("count"), rounded(F.avg(c)).alias("mean"), rounded(F.median(c)).alias("median"), rounded(F.stddev_samp(c)).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")]


def melted(df: DataFrame, keys: list[str], names=SCORES, variable: str = "score_variable", value: str = "score") -> DataFrame:
    return df.select(*keys, *(F.col(n).cast("double").alias(n) for n in names)).unpivot(keys, list(names), variable, value)


def rater_sample_counts(wide: DataFrame) -> DataFrame:
    """Rows and essays per rater, all and valid, in one pass; raters without a valid row stay, and so does a missing rater."""
    ok = all_valid()
    return wide.groupBy("rater_id").agg(
        F.count("*").alias("total_sample_count"), F.countDistinct("source_row_id").alias("total_unique_essay_count"),
        F.count_if(ok).alias("valid_sample_count"), F.countDistinct(F.when(ok, F.col("source_row_id"))).alias("valid_unique_essay_count"), F.count_if(~ok).alias("excluded_sample_count"),
    )


def rater_sample_counts_ordered(wide: DataFrame) -> DataFrame:
    return rater_sample_counts(wide).orderBy(*rater_prefix_key(F.col("rater_id")))


def dataset_summary(wide: DataFrame) -> DataFrame:
    """(``metric``, ``value``) with sixteen facts about a table; values as text."""
    ok = all_valid()
    text = lambda c: c.cast("string")
    one = wide.agg(
        text(F.count("*")).alias("total_sample_count"), text(F.count_if(ok)).alias("valid_sample_count"), text(F.count_if(~ok)).alias("excluded_sample_count"),
        text(F.count_if(~is_valid(F.col(OVERALL)))).alias("invalid_overall_sample_count"), text(F.count_if(~all_valid(TRAITS))).alias("invalid_trait_profile_sample_count"),
        text(F.count_if(any_missing(SCORES))).alias("missing_required_score_sample_count"),
        text(F.countDistinct("source_row_id")).alias("total_unique_source_essay_count"), text(F.countDistinct(F.when(ok, F.col("source_row_id")))).alias("valid_unique_source_essay_count"),
        text(F.countDistinct("Filename")).alias("total_unique_filename_count"), text(F.countDistinct(F.when(ok, F.col("Filename")))).alias("valid_unique_filename_count"),
        text(F.countDistinct("rater_id")).alias("unique_rater_count"),
    )
    counts = rater_sample_counts(wide)
    # Raters are few beside rows, but their list is one value: it is built over the aggregated ids only.
    key = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(rater_prefix_key(F.col("rater_id")))))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("rater_id").isNotNull(), key))), lambda x: x["k2"]), "|")
    v = F.col("valid_sample_count")
    two = counts.agg(listed.alias("rater_ids"), text(F.min(v)).alias("valid_samples_per_rater_min"), text(rounded(F.median(v))).alias("valid_samples_per_rater_median"), text(rounded(F.avg(v))).alias("valid_samples_per_rater_mean"), text(F.max(v)).alias("valid_samples_per_rater_max"))
    return one.unpivot([], one.columns, "metric", "value").unionByName(two.unpivot([], two.columns, "metric", "value"))


def score_descriptive(valid: DataFrame) -> DataFrame:
    return melted(valid, []).groupBy("score_variable").agg(*_statistics(F.col("score")))


def rater_descriptive(valid: DataFrame) -> DataFrame:
    return melted(valid.where("rater_id IS NOT NULL"), ["rater_id"]).groupBy("rater_id", "score_variable").agg(*_statistics(F.col("score")))


def _distribution(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and shares of all five levels per variable; absent levels count 0. One pass, no join with the levels."""
    n = F.count("score")
    wide = melted(df, keys).groupBy(*keys, "score_variable").agg(n.alias("n"), *(F.count_if(F.col("score") == k).alias(f"c{k}") for k in LEVELS))
    levels = F.array(*(F.struct(F.lit(k).alias("score"), F.col(f"c{k}").alias("count"), rounded(F.try_divide(f"c{k}", "n")).alias("proportion")) for k in LEVELS))
    return wide.select(*keys, "score_variable", F.inline(levels))


def score_distribution(valid: DataFrame) -> DataFrame:
    return _distribution(valid, [])


def rater_distribution(valid: DataFrame) -> DataFrame:
    return _distribution(valid.where("rater_id IS NOT NULL"), ["rater_id"])


def rater_trait_profile(valid: DataFrame) -> DataFrame:
    rows = melted(valid.where("rater_id IS NOT NULL"), ["rater_id"], TRAITS, "trait", "score")
    return rows.groupBy("rater_id", "trait").agg(F.count("score").alias("count"), F.avg("score").alias("mean"))


def rater_trait_relative(valid: DataFrame) -> DataFrame:
    """The profile against the unweighted mean of the rater's trait means."""
    centre = F.avg("mean").over(Window.partitionBy("rater_id"))  # six rows per rater
    return rater_trait_profile(valid).select("rater_id", "trait", "count", rounded(F.col("mean")).alias("mean"), rounded(centre).alias("rater_six_trait_mean"), rounded(F.col("mean") - centre).alias("relative_trait_tendency"))


def rater_gap(valid: DataFrame) -> DataFrame:
    gap = F.col(OVERALL) - F.col("trait_mean")
    rows = valid.where("rater_id IS NOT NULL").select("rater_id", gap.alias("gap"))
    return rows.groupBy("rater_id").agg(F.count("gap").alias("count"), rounded(F.avg("gap")).alias("mean"), rounded(F.median("gap")).alias("median"), rounded(F.stddev_samp("gap")).alias("std"), rounded(F.min("gap")).alias("min"), rounded(F.max("gap")).alias("max"))


def overall_trait_mean_groups(valid: DataFrame) -> DataFrame:
    t = F.col("trait_mean")
    return valid.groupBy(OVERALL).agg(F.count(t).alias("count"), rounded(F.avg(t)).alias("mean"), rounded(F.median(t)).alias("median"), rounded(F.stddev_samp(t)).alias("std"), rounded(F.min(t)).alias("min"), rounded(F.max(t)).alias("max"))


def usage_share(valid: DataFrame) -> DataFrame:
    """Shares of the levels in a rater's Overall scores, and of the middle and both extremes."""
    n = F.count(OVERALL)
    share = lambda *ks: rounded(F.try_divide(F.count_if(F.col(OVERALL).isin(*(float(k) for k in ks))), n))
    return valid.where("rater_id IS NOT NULL").groupBy("rater_id").agg(*(share(k).alias(f"share_{k}") for k in LEVELS), share(3).alias("middle_share"), share(1, 5).alias("extreme_share"))


def bubble_counts(valid: DataFrame) -> DataFrame:
    return valid.groupBy(rounded(F.col("trait_mean")).alias("trait_mean"), OVERALL).agg(F.count("*").alias("count"))


def text_features(df: DataFrame, key: list[str], text: str = "Text") -> DataFrame:
    t = F.col(text)
    return df.select(*key, X.character_count(t).alias("character_count"), X.word_count(t).alias("word_count"), X.sentence_count(t).alias("estimated_sentence_count"))


def rater_text_summary(valid: DataFrame) -> DataFrame:
    rows = text_features(valid.where("rater_id IS NOT NULL"), ["rater_id"])
    return rows.groupBy("rater_id").agg(
        F.count("word_count").alias("sample_count"), rounded(F.avg("character_count")).alias("mean_character_count"), rounded(F.avg("word_count")).alias("mean_word_count"),
        rounded(F.median("word_count")).alias("median_word_count"), rounded(F.stddev_samp("word_count")).alias("std_word_count"), rounded(F.avg("estimated_sentence_count")).alias("mean_estimated_sentence_count"),
    )


def extremes(df: DataFrame, value: str, key: str, n: int = 3) -> DataFrame:
    """The ``n`` rows of the least and of the greatest value; ties by key."""
    low = df.where(F.col(value).isNotNull()).orderBy(F.col(value).asc(), F.col(key)).limit(n)
    high = df.where(F.col(value).isNotNull()).orderBy(F.col(value).desc(), F.col(key)).limit(n)
    return low.select(F.lit("low").alias("side"), key, value).unionByName(high.select(F.lit("high").alias("side"), key, value))


def strongest_tendencies(relative: DataFrame, n: int = 8) -> DataFrame:
    return relative.orderBy(F.abs("relative_trait_tendency").desc(), "rater_id", "trait").limit(n)


def usage_matrix(valid: DataFrame) -> DataFrame:
    """Rater by level: share of each level in the Overall scores."""
    return rater_distribution(valid).where(F.col("score_variable") == OVERALL).groupBy("rater_id").pivot("score", list(LEVELS)).agg(F.first("proportion"))


def profile_matrix(valid: DataFrame) -> DataFrame:
    return rater_trait_profile(valid).withColumn("mean", rounded(F.col("mean"))).groupBy("rater_id").pivot("trait", list(TRAITS)).agg(F.first("mean"))


def round_half_up_match(valid: DataFrame) -> Column:
    return half_up(F.col("trait_mean")) == F.col(OVERALL)
