"""Runs over history sizes and seeds: a pilot, and a repetition with other draws that takes up where it stopped.

A run's records go to a store partitioned by seed and size; what has a record there is never asked again, so a run that was
interrupted, or lost executors, is simply started again. Every run writes when, from which commit and with which settings it
was made, and the result tables of ``operators.experiments``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markweave.functions.scores import error_columns
from markweave.operators import experiments, history, pipeline, prompts
from markweave.schema import K_RECORD, OVERALL, SEED_RECORD
from markweave.session import ship_library
from markweave.sources import sinks
from markweave.streaming import resume


def _letters_per_token(text: Column) -> Column:
    return prompts.token_estimate(F.length(text), 4.0)


def asked_targets(rows: DataFrame, targets: DataFrame, histories: DataFrame, size: int, tokens: Callable[[Column], Column]) -> DataFrame:
    """The prompt of each target with the first ``size`` rows of its history, and what a record keeps of it."""
    mine = histories.where(F.col("rn") <= size)
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("rn", c))), lambda x: x[c])
    kept = mine.groupBy("target_id").agg(ordered("history_id").alias("history_ids"), ordered("rater_id").alias("history_rater_ids"))
    chosen = rows.join(targets.select("target_id"), "target_id").select("target_id", "rater_id", "Text", F.col(OVERALL).cast("int").alias("gold_overall"))
    built = prompts.build_prompts(chosen, prompts.format_histories(mine, rows), prompts.TEMPLATES["prediction"]).drop("Text", "prompt_token_estimate")
    return built.join(kept, "target_id").withColumn("prompt_tokens", tokens(F.col("prompt")))


def records_of(asked: DataFrame, size: int, make: Callable[[], pipeline.Generator], parameters: dict, max_retries: int, max_model_len: int, output_budget: int, batch_size: int, tokens: Callable[[Column], Column]) -> DataFrame:
    """One record per asked target; a prompt beyond the context isn't sent and fails with ``context overflow``."""
    answers = pipeline.predict(asked, make, parameters, max_retries, max_model_len, output_budget, batch_size, tokens(F.col("prompt")), timed=True)
    rows = asked.join(answers, "target_id").withColumns(error_columns())
    said = F.col("raw_model_output").isNotNull()
    return rows.select(
        "target_id", F.split("target_id", ":")[0].try_cast("bigint").alias("source_row_id"), "rater_id", F.lit(size).alias("K"), "gold_overall", "predicted_overall", "exact_correct", "absolute_error", "squared_error",
        F.coalesce("reasoning", F.lit("")).alias("prediction_reasoning"), "history_ids", "history_rater_ids", "prompt_tokens", F.when(said, tokens(F.col("raw_model_output"))).otherwise(0).alias("output_tokens"),
        (F.coalesce("parse_error", F.lit("")) != "context overflow").alias("context_fit"), F.col("predicted_overall").isNotNull().alias("parse_success"), F.greatest(F.lit(0), F.col("parse_attempts") - 1).alias("retry_count"), "parse_error",
        "inference_time_seconds", F.coalesce("raw_model_output", F.lit("")).alias("raw_model_output"), F.coalesce("raw_model_output_attempts", F.array().cast("array<string>")).alias("raw_model_output_attempts"), "prompt",
    )


def _missing(asked: DataFrame, store: str, seed: int, size: int, schema) -> DataFrame:
    wanted = asked.withColumn("seed", F.lit(seed).cast("bigint")).withColumn("K", F.lit(size))
    return resume.resume(wanted, store, schema).drop("seed", "K")


_STORED = SEED_RECORD.fieldNames()


def _run_sizes(rows: DataFrame, targets: DataFrame, histories: DataFrame, sizes: tuple[int, ...], seed: int, store: str, tokens: Callable[[Column], Column], **how) -> None:
    for size in sizes:
        todo = _missing(asked_targets(rows, targets, histories, size, tokens), store, seed, size, SEED_RECORD)
        done = records_of(todo, size, tokens=tokens, **how)
        done = done.withColumn("seed", F.lit(seed).cast("bigint")).withColumn("reused_from_base_pilot", F.lit(False))
        resume.append_records(done, store)


def _how(make, parameters, max_retries, max_model_len, output_budget, batch_size) -> dict:
    return {"make": make, "parameters": parameters, "max_retries": max_retries, "max_model_len": max_model_len, "output_budget": output_budget, "batch_size": batch_size}


def run_pilot(
    wide: DataFrame, make: Callable[[], pipeline.Generator], output: str, sizes: tuple[int, ...] = (1, 3, 5), num_targets: int = 100, seed: int = 42, parameters: dict | None = None, max_retries: int = 1,
    max_model_len: int = 4096, output_budget: int = 384, batch_size: int = 16, tokens: Callable[[Column], Column] = _letters_per_token, config: dict | None = None,
) -> dict[str, DataFrame]:
    """The same targets with nested histories of every size: records, summary, target comparison, paired comparison, raters."""
    spark = wide.sparkSession
    ship_library(spark)
    rows = history.experiment_rows(wide, with_text=True)
    targets = history.sample_targets(rows.drop("Text"), num_targets, seed, max(sizes), strict=True)
    histories = history.sample_histories(rows.drop("Text"), max(sizes), seed, targets)
    for name, df in (("targets", targets.select("target_id")), ("histories", histories)):
        df.write.mode("overwrite").parquet(f"{output}/{name}")
    targets, histories = (spark.read.parquet(f"{output}/{name}") for name in ("targets", "histories"))
    sinks.write_json(sinks.experiment_metadata(config or {}) | {"seed": seed, "sizes": list(sizes), "num_targets": num_targets, "max_model_len": max_model_len, "sampling_parameters": parameters or {}}, f"{output}/experiment_metadata.json")
    store = f"{output}/records"
    _run_sizes(rows, targets, histories, sizes, seed, store, tokens, **_how(make, parameters or {}, max_retries, max_model_len, output_budget, batch_size))
    records = resume.completed(spark, store, _stored(K_RECORD))
    sinks.write_jsonl(records, f"{output}/predictions")
    tables = {"k_summary": experiments.k_summary(records).orderBy("K"), "k_target_comparison": experiments.target_comparison(records, sizes), "k_paired": experiments.k_paired(records, sizes), "k_rater": experiments.k_rater(records)}
    for name, df in tables.items():
        sinks.write_csv(df, f"{output}/{name}") if name == "k_target_comparison" else sinks.save_table(df, f"{output}/{name}.csv")
    return {"records": records} | tables


def _stored(schema):
    """A record's schema as it lies in the store, with the seed."""
    names = set(schema.fieldNames())
    return type(schema)([*schema.fields, *(f for f in SEED_RECORD.fields if f.name not in names)])


def run_robustness(
    wide: DataFrame, make: Callable[[], pipeline.Generator], output: str, base: str, seeds: tuple[int, ...], base_seed: int = 42, sizes: tuple[int, ...] = (3, 5), parameters: dict | None = None, max_model_len: int = 4096,
    output_budget: int = 384, batch_size: int = 16, tokens: Callable[[Column], Column] = _letters_per_token, config: dict | None = None,
) -> dict[str, DataFrame]:
    """The pilot's targets (from its folder ``base``) with histories of other seeds; the pilot's own records stand for ``base_seed``."""
    spark = wide.sparkSession
    ship_library(spark)
    rows = history.experiment_rows(wide, with_text=True)
    targets = spark.read.parquet(f"{base}/targets")
    store = f"{output}/records"
    for seed in (s for s in seeds if s != base_seed):
        histories = history.sample_histories(rows.drop("Text"), max(sizes), seed, targets)
        _run_sizes(rows, targets, histories, sizes, seed, store, tokens, **_how(make, parameters or {}, 0, max_model_len, output_budget, batch_size))
    new = resume.completed(spark, store, SEED_RECORD).drop("reused_from_base_pilot")
    records = experiments.merge_runs(resume.completed(spark, f"{base}/records", _stored(K_RECORD)).drop("seed", "reused_from_base_pilot"), new, base_seed, sizes).select(*_STORED)
    sinks.write_jsonl(records, f"{output}/predictions")
    sinks.write_json(sinks.experiment_metadata(config or {}) | {"history_seeds": list(seeds), "sizes": list(sizes)}, f"{output}/experiment_metadata.json")
    summary = experiments.seed_summary(records, targets.count())
    tables = {"seed_summary": summary.orderBy("seed", "K"), "seed_paired": experiments.seed_paired(records, min(sizes), max(sizes)), "seed_aggregate": experiments.seed_aggregate(summary)}
    for name, df in tables.items():
        sinks.save_table(df, f"{output}/{name}.csv")
    return {"records": records} | tables
