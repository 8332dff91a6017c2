"""The experiment's phases: generate, parse with retries, verify, compare rationales, and sum up.

A generator is any picklable object with ``generate(prompts, parameters, n) -> list of n answers per prompt``; it is
built once per task and fed micro-batches, and keys travel with their rows, so nothing is matched by position.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markweave.functions import text as X
from markweave.functions.parsing import parse_reasoning, parse_score, read_fields
from markweave.functions.scores import error_columns, rounded
from markweave.operators.correlation import correlations
from markweave.operators.prompts import token_estimate

# Fixed value: what the reasoning-quality table says of the two measures that aren't computed.
NOTE = "METEOR/BERTScore unavailable: optional dependencies not installed"
QUALITY = ("bleu_max", "rouge1_f1_max", "meteor_max", "bertscore_f1_max")


class Generator(Protocol):
    def generate(self, prompts: list[str], parameters: dict, n: int = 1) -> list[list[str]]: ...


def generate_answers(prompts: DataFrame, make: Callable[[], Generator], parameters: dict, n: int = 1, batch_size: int = 16) -> DataFrame:
    """``prompts`` (``target_id``, ``prompt``) exploded to ``candidate_id`` from 1 and ``raw_model_output``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generator = make()
        for frame in frames:
            for k in range(0, len(frame), batch_size):
                part = frame.iloc[k : k + batch_size]
                answers = generator.generate(part["prompt"].tolist(), parameters, n)
                rows = [(t, c, a) for t, own in zip(part["target_id"], answers) for c, a in enumerate(own, 1)]
                yield pd.DataFrame(rows, columns=["target_id", "candidate_id", "raw_model_output"])

    return prompts.select("target_id", "prompt").mapInPandas(run, "target_id string, candidate_id int, raw_model_output string")


_ANSWER = "target_id string, raw_model_output string, raw_model_output_attempts array<string>, parse_attempts int, predicted_overall int, reasoning string, parse_error string"


def predict(prompts: DataFrame, make: Callable[[], Generator], parameters: dict, max_retries: int = 1, max_model_len: int | None = None, output_budget: int = 0, batch_size: int = 16, tokens: Column | None = None, timed: bool = False) -> DataFrame:
    """Predictions with at most ``max_retries`` further rounds for answers that don't parse; prompts beyond the context aren't sent.

    Micro-batches of ``batch_size`` prompts go to the generator, and what has to be asked again goes as one batch, too. ``tokens``
    counts a prompt's tokens (by default a token for every four letters); with ``timed``, each answer has its share of its batch's
    seconds in ``inference_time_seconds``. Adds ``raw_model_output``,
    ``raw_model_output_attempts``, ``parse_attempts``, ``predicted_overall``, ``reasoning``, ``parse_error``.
    """

    def answered(generator: Generator, asked: list[str]) -> tuple[list[list[str]], list[dict]]:
        attempts: list[list[str]] = [[] for _ in asked]
        read: list[dict] = [{} for _ in asked]
        waiting = list(range(len(asked)))
        for _ in range(1 + max_retries):
            for i, answers in zip(waiting, generator.generate([asked[i] for i in waiting], parameters, 1)):
                attempts[i].append(answers[0])
                read[i] = read_fields(answers[0], ("predicted_overall", "reasoning"))
            waiting = [i for i in waiting if read[i]["error"]]
            if not waiting:
                break
        return attempts, read

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generator = make()
        for frame in frames:
            for k in range(0, len(frame), batch_size):
                part = frame.iloc[k : k + batch_size]
                began = time.perf_counter()
                attempts, read = answered(generator, part["prompt"].tolist())
                seconds = (time.perf_counter() - began) / max(1, len(part))
                out = pd.DataFrame({
                    "target_id": part["target_id"].tolist(), "raw_model_output": [x[-1] for x in attempts], "raw_model_output_attempts": attempts, "parse_attempts": [len(x) for x in attempts],
                    "predicted_overall": pd.array([r.get("predicted_overall") for r in read], dtype="Int32"), "reasoning": [r.get("reasoning") for r in read], "parse_error": [r["error"] for r in read],
                })
                yield out.assign(inference_time_seconds=seconds) if timed else out

    schema = _ANSWER + ", inference_time_seconds double" * timed
    if max_model_len is None:
        return prompts.select("target_id", "prompt").mapInPandas(run, schema)
    size = token_estimate(F.length("prompt"), 4.0) if tokens is None else tokens
    fits = F.coalesce(size + output_budget <= max_model_len, F.lit(False))
    none = {"raw_model_output": "string", "raw_model_output_attempts": "array<string>", "parse_attempts": "int", "predicted_overall": "int", "reasoning": "string"}
    kept_back = prompts.where(~fits).select("target_id", *((F.lit(0) if n == "parse_attempts" else F.lit(None).cast(t)).alias(n) for n, t in none.items()), F.lit("context overflow").alias("parse_error"))
    if timed:
        kept_back = kept_back.withColumn("inference_time_seconds", F.lit(0.0))
    return prompts.where(fits).select("target_id", "prompt").mapInPandas(run, schema).unionByName(kept_back)


def reconstruct_scores(prompts: DataFrame, make: Callable[[], Generator], parameters: dict) -> DataFrame:
    """(``target_id``, ``reconstructed_overall``, ``verification_parse_error``): one answer per prompt, parsed without a rationale."""
    answers = generate_answers(prompts, make, parameters).withColumn("p", parse_score("raw_model_output"))
    return answers.select("target_id", F.col("p.predicted_overall").alias("reconstructed_overall"), F.col("p.error").alias("verification_parse_error"))


def parse_candidates(answers: DataFrame) -> DataFrame:
    """Parsed candidates (``target_id``, ``candidate_id``, ``raw_model_output``, ``gold_overall``); one that names the gold score is rejected."""
    parsed = answers.withColumn("p", parse_reasoning("raw_model_output"))
    leak = X.leaks_score(F.col("p.reasoning"), F.col("gold_overall"))
    error = F.when(F.col("p.error").isNotNull(), F.col("p.error")).when(leak, F.lit("ValueError: gold score leaked in reasoning"))
    return parsed.select("target_id", "candidate_id", "gold_overall", F.when(error.isNull(), F.col("p.reasoning")).otherwise(F.lit("")).alias("reference_reasoning"), leak.alias("score_leak"), "raw_model_output", error.alias("parse_error"))


def reference_candidates(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """Generated answers (``target_id``, ``candidate_id``, ``raw_model_output``) as parsed candidates of their targets."""
    return parse_candidates(answers.join(gold.select("target_id", "gold_overall"), "target_id"))


def verify_candidates(candidates: DataFrame, reconstructed: DataFrame) -> DataFrame:
    """Candidates with ``reconstructed_overall`` and ``verified``; ``reconstructed`` has parsed scores by both ids. A missing one failed."""
    joined = candidates.join(reconstructed.select("target_id", "candidate_id", "reconstructed_overall", "verification_parse_error", F.lit(True).alias("tried")), ["target_id", "candidate_id"], "left")
    return joined.withColumn("verified", F.coalesce(F.col("reconstructed_overall") == F.col("gold_overall"), F.lit(False))).withColumn("verification_parse_error", F.when(F.col("tried"), F.col("verification_parse_error")).otherwise(F.lit("reference generation failed"))).drop("tried")


def verification_summary(candidates: DataFrame) -> DataFrame:
    """Seven facts; ratios are 0 without candidates."""
    t, v, n = F.countDistinct("target_id"), F.count_if("verified"), F.count("*")
    tv = F.countDistinct(F.when(F.col("verified"), F.col("target_id")))
    return candidates.agg(
        t.alias("targets_total"), tv.alias("targets_with_verified_reference"), (t - tv).alias("targets_without_verified_reference"), n.alias("candidate_total"), v.alias("verified_total"),
        F.coalesce(rounded(F.try_divide(v, n)), F.lit(0.0)).alias("verification_pass_rate"), F.coalesce(rounded(F.try_divide(v, t)), F.lit(0.0)).alias("mean_verified_references_per_target"),
    )


def reasoning_quality(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """Best and mean similarity of each prediction's rationale to its target's references; METEOR and BERTScore stay null."""
    own = predictions.where("reasoning IS NOT NULL AND reasoning <> ''").select("target_id", "rater_id", "reasoning")
    pairs = own.join(references.select("target_id", "reference_reasoning"), "target_id").select("target_id", "rater_id", X.similarity("reasoning", "reference_reasoning").alias("s"))
    scored = pairs.select("target_id", "rater_id", F.col("s.bleu").alias("b"), F.col("s.rouge1_f1").alias("g"))
    none = F.lit(None).cast("double")
    return scored.groupBy("target_id", "rater_id").agg(
        rounded(F.max("b")).alias("bleu_max"), rounded(F.avg("b")).alias("bleu_mean"), rounded(F.max("g")).alias("rouge1_f1_max"), rounded(F.avg("g")).alias("rouge1_f1_mean"), F.count("*").alias("num_verified_references")
    ).withColumns({n: none for n in ("meteor_max", "meteor_mean", "bertscore_f1_max", "bertscore_f1_mean")} | {"metric_note": F.lit(NOTE)})


def prediction_detail(predictions: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """Error columns per target, with the rationale's quality where there is one."""
    rows = predictions.where("predicted_overall IS NOT NULL AND predicted_overall <> 0").select("target_id", "rater_id", "gold_overall", "predicted_overall").withColumns(error_columns())
    return rows if quality is None else rows.join(quality, ["target_id", "rater_id"], "left")


def quality_by_correctness(detail: DataFrame, metrics: tuple[str, ...] = QUALITY) -> DataFrame:
    """Mean, median, deviation and number of each metric for right and wrong predictions; metrics without values stay, with count 0."""
    long = detail.select("exact_correct", *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(["exact_correct"], list(metrics), "metric", "value")
    return long.groupBy("exact_correct", "metric").agg(rounded(F.avg("value")).alias("mean"), rounded(F.median("value")).alias("median"), rounded(F.stddev_samp("value")).alias("std"), F.count("value").alias("count"))


def quality_error_correlations(detail: DataFrame, metrics: tuple[str, ...] = QUALITY) -> DataFrame:
    """Spearman's correlation of each metric with the absolute error; null and count 0 without values."""
    long = detail.select(F.col("absolute_error").alias("y"), *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(["y"], list(metrics), "metric", "x")
    counts = long.groupBy("metric").agg(F.count("x").alias("count"))
    return counts.join(correlations(long, ["metric"], spread=True).select("metric", F.col("spearman_correlation").alias("spearman_with_absolute_error")), "metric", "left")
