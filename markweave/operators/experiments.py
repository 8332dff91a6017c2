"""Comparison of experiment settings over history sizes and seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markweave.functions.scores import quadratic_kappa, rounded
from markweave.operators.ranking import running_before


def _kappa(ok):
    g, p = (F.when(ok, F.col(c).cast("double")) for c in ("gold_overall", "predicted_overall"))
    return rounded(quadratic_kappa(F.count(g).cast("double"), F.sum(g), F.sum(p), F.sum(g * g), F.sum(p * p), F.sum(g * p)))


def k_summary(records: DataFrame) -> DataFrame:
    """Fourteen facts per history size: errors over parsed records, tokens and time over all. A size without a parsed record is absent."""
    ok = F.col("parse_success")
    on = lambda c: F.when(ok, c)
    t, s = F.col("prompt_tokens").cast("double"), F.col("inference_time_seconds")
    out = records.groupBy("K").agg(
        F.count_if(ok).alias("n"), rounded(F.avg(on(F.col("exact_correct").cast("double")))).alias("exact_accuracy"), rounded(F.avg(on(F.col("absolute_error")))).alias("mae"), rounded(F.sqrt(F.avg(on(F.col("squared_error"))))).alias("rmse"), _kappa(ok).alias("qwk"),
        rounded(F.try_divide(F.count_if(ok), F.count("*"))).alias("parse_success_rate"), rounded(F.avg(t)).alias("mean_prompt_tokens"), rounded(F.median(t)).alias("median_prompt_tokens"), rounded(F.percentile(t, F.lit(0.9))).alias("p90_prompt_tokens"),
        rounded(F.avg(s)).alias("mean_inference_time_seconds"), rounded(F.sum(s)).alias("total_inference_time_seconds"), F.count_if(~ok).alias("parse_errors"), F.count_if(~F.col("context_fit")).alias("context_overflows"),
    )
    return out.where("n > 0")


def _only(c: str):
    """The one value of a group; an error where there are several rows."""
    return F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("several records of one target and setting"))).otherwise(F.first(c))


def target_comparison(records: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """Absolute error per target and history size, missing ones null; a target may have one record per size."""
    return records.where("parse_success").groupBy("target_id").pivot("K", list(sizes)).agg(_only("absolute_error"))


def k_paired(records: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """From each size to the next: targets improved, unchanged, worsened; a positive difference is an improvement."""
    wide = target_comparison(records, sizes)
    steps = [F.struct(F.lit(a).alias("from_K"), F.lit(b).alias("to_K"), (F.col(str(a)) - F.col(str(b))).alias("delta")) for a, b in zip(sizes, sizes[1:])]
    d = F.col("delta")
    return wide.select(F.inline(F.array(*steps))).groupBy("from_K", "to_K").agg(F.count_if(d > 0).alias("improved_targets"), F.count_if(d == 0).alias("unchanged_targets"), F.count_if(d < 0).alias("worsened_targets"), rounded(F.avg(d)).alias("mean_ae_difference"), rounded(F.median(d)).alias("median_ae_difference"), F.count(d).alias("paired_targets"))


def k_rater(records: DataFrame) -> DataFrame:
    return records.where("parse_success AND rater_id IS NOT NULL").groupBy("K", "rater_id").agg(F.count("target_id").alias("count"), rounded(F.avg(F.col("exact_correct").cast("double"))).alias("accuracy"), rounded(F.avg("absolute_error")).alias("mae"))


def seed_summary(records: DataFrame, expected: int = 100) -> DataFrame:
    """Per seed and size, over parsed records; the success rate is against ``expected`` records."""
    ok = records.where("parse_success")
    return ok.groupBy("seed", "K").agg(
        F.count("*").alias("n"), rounded(F.avg(F.col("exact_correct").cast("double"))).alias("accuracy"), rounded(F.avg("absolute_error")).alias("mae"), rounded(F.sqrt(F.avg("squared_error"))).alias("rmse"), _kappa(F.lit(True)).alias("qwk"),
        rounded(F.count("*") / F.lit(float(expected))).alias("parse_success_rate"), rounded(F.avg("prompt_tokens")).alias("mean_prompt_tokens"), rounded(F.avg("inference_time_seconds")).alias("mean_inference_time_seconds"),
    )


def seed_paired(records: DataFrame, low: int = 3, high: int = 5) -> DataFrame:
    """Per seed: error at ``high`` less error at ``low``, so that a negative difference favours the longer history."""
    p = records.where("parse_success").groupBy("seed", "target_id").pivot("K", [low, high]).agg(_only("absolute_error"))
    d = F.col(str(high)) - F.col(str(low))
    return p.groupBy("seed").agg(F.count_if(d < 0).alias(f"improved_k{high}"), F.count_if(d == 0).alias("unchanged"), F.count_if(d > 0).alias(f"worsened_k{high}"), rounded(F.avg(d)).alias(f"mean_delta_ae_k{high}_minus_k{low}"), rounded(F.median(d)).alias(f"median_delta_ae_k{high}_minus_k{low}"), F.count(d).alias("paired_targets"))


def seed_aggregate(summary: DataFrame) -> DataFrame:
    both = lambda c: (rounded(F.avg(c)).alias(f"{c}_mean"), rounded(F.stddev_samp(c)).alias(f"{c}_std"))
    return summary.groupBy("K").agg(*both("accuracy"), *both("mae"), *both("qwk"), rounded(F.avg("mean_prompt_tokens")).alias("prompt_tokens_mean"), rounded(F.avg("mean_inference_time_seconds")).alias("inference_time_mean"))


def context_fit(detail: DataFrame, max_lengths: tuple[int, ...]) -> DataFrame:
    """Share of prompts that fit each context length, with token statistics, per phase and history size. One pass for all lengths."""
    t = F.col("prompt_tokens").cast("double")
    q = lambda p: rounded(F.percentile(t, F.lit(p)))
    fits = [F.count_if(F.col("prompt_tokens") + F.col("output_budget") <= m).alias(f"fit_{m}") for m in max_lengths]
    one = detail.groupBy("phase", "k").agg(F.count("*").alias("targets_total"), F.min("output_budget").alias("output_budget"), rounded(F.avg(t)).alias("prompt_tokens_mean"), q(0.5).alias("prompt_tokens_median"), q(0.9).alias("prompt_tokens_p90"), q(0.95).alias("prompt_tokens_p95"), F.max("prompt_tokens").alias("prompt_tokens_max"), *fits)
    grid = F.array(*(F.struct(F.lit(m).alias("max_model_len"), F.col(f"fit_{m}").alias("targets_fit"), rounded(F.try_divide(f"fit_{m}", "targets_total")).alias("fit_rate")) for m in max_lengths))
    return one.select("phase", "k", "targets_total", "output_budget", *(f"prompt_tokens_{x}" for x in ("mean", "median", "p90", "p95", "max")), F.inline(grid))


def placed(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``place`` from 0 in the order of columns, over range partitions."""
    return running_before(df, [], list(order), F.lit(1), "place")


def number_reasonings(references: DataFrame) -> DataFrame:
    """(``reasoning_no``, ``reasoning``): every different text of the references (``target_id``, ``reference_reasoning``) by its first target."""
    texts = references.groupBy("reference_reasoning").agg(F.min("target_id").alias("t"))
    return placed(texts, "t", "reference_reasoning").select(F.col("place").alias("reasoning_no"), F.col("reference_reasoning").alias("reasoning"))


def assign_round_robin(targets: DataFrame, reasonings: DataFrame, order: str = "target_id") -> DataFrame:
    """Each target with the reasoning whose place is the target's modulo their number, in order of ids."""
    n = reasonings.agg(F.count("*").alias("reasonings"))
    listed = reasonings.select("reasoning_no", "reasoning")
    counted = placed(targets, order).join(n, F.lit(True)).where("reasonings > 0")  # the other side is one row
    return counted.withColumn("reasoning_no", F.col("place") % F.col("reasonings")).drop("place", "reasonings").join(listed, "reasoning_no")


def remaining_work(wanted: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("seed", "K", "target_id")) -> DataFrame:
    """What a resumed run still has to do."""
    return wanted.join(done.select(*keys), list(keys), "left_anti")


def merge_runs(base: DataFrame, new: DataFrame, seed: int, sizes: tuple[int, ...] = (3, 5)) -> DataFrame:
    """Records of a base run under a seed's name, with the new ones."""
    reused = base.where(F.col("K").isin(*sizes)).withColumn("seed", F.lit(seed).cast("long")).withColumn("reused_from_base_pilot", F.lit(True))
    return reused.unionByName(new.withColumn("reused_from_base_pilot", F.lit(False)), allowMissingColumns=True)
