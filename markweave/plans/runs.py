"""Whole runs: analysis of a table, conversion of raw scores, and the experiment's phases.

Each returns its tables and writes them under an output folder once all of them are planned; result tables are aggregates
and go out as single files, records as JSON lines.

    python -m markweave.plans.runs analysis --input wide.parquet --output out
    python -m markweave.plans.runs conversion --input raw.csv --output out
    python -m markweave.plans.runs pilot --input wide.parquet --output out --generator package.module:factory
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markweave.functions.scores import rater_number_key, rater_prefix_key
from markweave.operators import agreement, correlation, descriptive, experiments, history, pipeline, profiles, prompts, reshape
from markweave.schema import LEVELS, OVERALL, TRAITS
from markweave.session import release_checkpoints, ship_library
from markweave.sources import figures, files, sinks


def analysis_tables(wide: DataFrame) -> dict[str, DataFrame]:
    """The result tables of one ratings table, by name."""
    valid = descriptive.valid_samples(wide)
    by_rater = correlation.rater_correlations(valid)
    return {
        "dataset_summary": descriptive.dataset_summary(wide),
        "rater_sample_counts": descriptive.rater_sample_counts_ordered(wide),
        "score_descriptive_statistics": descriptive.score_descriptive(valid).orderBy("score_variable"),
        "score_distribution": descriptive.score_distribution(valid).orderBy("score_variable", "score"),
        "rater_score_descriptive_statistics": descriptive.rater_descriptive(valid).orderBy("rater_id", "score_variable"),
        "rater_score_distribution": descriptive.rater_distribution(valid).orderBy("rater_id", "score_variable", "score"),
        "rater_trait_profile": descriptive.rater_trait_profile(valid).orderBy("rater_id", "trait"),
        "rater_trait_relative_profile": descriptive.rater_trait_relative(valid).orderBy("rater_id", "trait"),
        "overall_trait_correlations": correlation.overall_correlations(valid),
        "trait_mean_vs_overall": profiles.trait_mean_relation(valid),
        "trait_mean_metrics": profiles.trait_mean_metrics(valid),
        "same_trait_profile_different_overall": profiles.same_profile_different_overall(valid),
        "rater_overall_trait_correlations": by_rater.orderBy("rater_id", "predictor"),
        "rater_overall_minus_trait_mean": descriptive.rater_gap(valid).orderBy("rater_id"),
        "rater_text_length_summary": descriptive.rater_text_summary(valid).orderBy("rater_id"),
    }


#: Raters whose values a figure still shows one by one; with more, the table is the figure's data.
FIGURE_RATERS = 5_000


def save_figures(valid: DataFrame, tables: dict[str, DataFrame], folder: str) -> list[Path]:
    """The twelve figures of an analysis, from its result tables, in the natural order of raters."""
    pandas = lambda df: df.toPandas()
    by_level = pandas(tables["score_distribution"].groupBy("score").pivot("score_variable", [OVERALL, *TRAITS]).agg(F.first("proportion")).orderBy("score"))
    corr = pandas(tables["overall_trait_correlations"].where(F.col("predictor").isin(*TRAITS)))
    made = [
        figures.bars(by_level, "score", [OVERALL], "Overall score distribution", "Proportion", f"{folder}/overall_score_distribution.svg"),
        figures.bars(by_level, "score", list(TRAITS), "Trait score distributions", "Proportion", f"{folder}/trait_score_distributions.svg"),
        figures.bars(corr, "predictor", ["pearson_correlation", "spearman_correlation"], "Overall and trait correlations", "Correlation with Overall", f"{folder}/overall_trait_correlations.svg"),
        figures.bubbles(pandas(descriptive.bubble_counts(valid)), "trait_mean", OVERALL, "count", "Overall and mean of the traits", 1, 5, f"{folder}/overall_vs_trait_mean.svg"),
    ]
    natural = lambda df: df.where("rater_id IS NOT NULL").orderBy(*rater_prefix_key(F.col("rater_id")))
    if tables["rater_sample_counts"].limit(FIGURE_RATERS + 1).count() > FIGURE_RATERS:
        return made
    overall = tables["rater_score_descriptive_statistics"].where(F.col("score_variable") == OVERALL)
    matrix = tables["rater_overall_trait_correlations"].groupBy("rater_id").pivot("predictor", [*TRAITS, "trait_mean"]).agg(F.first("pearson_correlation"))
    for df, column, title, label, name in (
        (tables["rater_sample_counts"], "valid_sample_count", "Valid samples by rater", "Samples", "rater_sample_counts"), (overall, "mean", "Mean Overall by rater (unadjusted)", "Mean Overall", "rater_overall_mean"),
        (overall, "std", "Deviation of Overall by rater", "Standard deviation", "rater_overall_std"), (tables["rater_overall_minus_trait_mean"], "mean", "Overall less trait mean by rater (unadjusted)", "Gap", "rater_overall_minus_trait_mean"),
        (tables["rater_text_length_summary"], "mean_word_count", "Mean words of a rater's essays", "Words", "rater_mean_word_count"),
    ):
        made.append(figures.bars(pandas(natural(df.select("rater_id", column))), "rater_id", [column], title, label, f"{folder}/{name}.svg"))
    levels = [str(k) for k in LEVELS]
    made.append(figures.heat_map(pandas(natural(descriptive.usage_matrix(valid))), "rater_id", levels, "Use of the levels by rater", "Proportion", 0, 1, f"{folder}/rater_overall_usage.svg"))
    made.append(figures.heat_map(pandas(natural(descriptive.profile_matrix(valid))), "rater_id", list(TRAITS), "Mean trait scores by rater", "Mean score", 1, 5, f"{folder}/rater_trait_profile.svg"))
    made.append(figures.heat_map(pandas(natural(matrix)), "rater_id", [*TRAITS, "trait_mean"], "Correlation with Overall by rater", "Pearson", -1, 1, f"{folder}/rater_trait_correlations.svg", "two ways"))
    return made


def report_scalars(valid: DataFrame, tables: dict[str, DataFrame]) -> dict[str, object]:
    """The single facts of a report, by name; null where the table has no such row."""
    first = lambda df: r.asDict() if (r := df.first()) else {}
    facts = {r.metric: r.value for r in tables["dataset_summary"].collect()}
    out: dict[str, object] = {k: facts.get(k) for k in ("total_sample_count", "valid_sample_count", "excluded_sample_count", "unique_rater_count", "valid_samples_per_rater_min", "valid_samples_per_rater_median", "valid_samples_per_rater_mean", "valid_samples_per_rater_max")}
    overall = tables["rater_score_descriptive_statistics"].where(F.col("score_variable") == OVERALL)
    stats = first(tables["score_descriptive_statistics"].where(F.col("score_variable") == OVERALL))
    out |= {"overall_mean": stats.get("mean"), "overall_std": stats.get("std")}
    usage = descriptive.usage_share(valid)
    ends = {
        "std": (overall, "std"), "middle_share": (usage, "middle_share"), "extreme_share": (usage, "extreme_share"), "mean_word_count": (tables["rater_text_length_summary"], "mean_word_count"), "overall_mean": (overall, "mean"), "gap": (tables["rater_overall_minus_trait_mean"], "mean"),
    }
    for name, (df, column) in ends.items():
        rows = {r.side: r for r in descriptive.extremes(df, column, "rater_id", 1).collect()}
        for side, word in (("low", "lowest"), ("high", "highest")):
            out |= {f"{word}_{name}_rater": rows[side]["rater_id"] if side in rows else None, f"{word}_{name}": rows[side][column] if side in rows else None}
    best, widest = first(correlation.strongest_predictor(tables["overall_trait_correlations"])), first(correlation.correlation_ranges(tables["rater_overall_trait_correlations"]))
    out |= {"strongest_predictor": best.get("predictor"), "strongest_correlation": best.get("pearson_correlation"), "widest_range_predictor": widest.get("predictor"), "widest_range_min": widest.get("min"), "widest_range_max": widest.get("max")}
    return out | first(tables["trait_mean_metrics"])


def _sentences(s: dict[str, object]) -> str:
    n = lambda k: f"{v:.3f}" if isinstance(v := s.get(k), float) else str(v)
    return "\n".join(
        f"- {x}"
        for x in (
            f"Of {n('total_sample_count')} samples {n('valid_sample_count')} have seven valid scores; {n('excluded_sample_count')} are left out. {n('unique_rater_count')} raters have {n('valid_samples_per_rater_min')} to {n('valid_samples_per_rater_max')} valid samples (median {n('valid_samples_per_rater_median')}, mean {n('valid_samples_per_rater_mean')}).",
            f"Overall has mean {n('overall_mean')} and standard deviation {n('overall_std')}.",
            f"The lowest mean is {n('lowest_overall_mean')} ({n('lowest_overall_mean_rater')}), the highest {n('highest_overall_mean')} ({n('highest_overall_mean_rater')}); the essays behind them differ, so neither is severity as such.",
            f"Scores vary least for {n('lowest_std_rater')} ({n('lowest_std')}) and most for {n('highest_std_rater')} ({n('highest_std')}); {n('highest_middle_share_rater')} uses the middle level most ({n('highest_middle_share')}), {n('highest_extreme_share_rater')} the ends ({n('highest_extreme_share')}).",
            f"Of the traits, {n('strongest_predictor')} correlates most with Overall ({n('strongest_correlation')}); a correlation is no weight. By rater, {n('widest_range_predictor')} varies most ({n('widest_range_min')} to {n('widest_range_max')}).",
            f"Overall less the trait mean lies between {n('lowest_gap')} ({n('lowest_gap_rater')}) and {n('highest_gap')} ({n('highest_gap_rater')}) on average.",
            f"Essays have {n('lowest_mean_word_count')} ({n('lowest_mean_word_count_rater')}) to {n('highest_mean_word_count')} words ({n('highest_mean_word_count_rater')}) on average.",
        )
    )


def run_analysis(spark: SparkSession, source: str, output: str) -> dict[str, DataFrame]:
    """All result tables, twelve figures and a report. The table per row is written as part files, the others as single files.

    The columns that the tables read are kept for the run, so that the source is scanned once.
    """
    ship_library(spark)
    wide = files.load_processed_wide(spark, source)
    wide = wide.select([c for c in wide.columns if c != "Identifying_Info"]).persist(StorageLevel.MEMORY_AND_DISK)
    valid = descriptive.valid_samples(wide)
    profiles.check_stored_means(valid, 1e-6)  # a file may hold rounded means
    tables = analysis_tables(wide)
    for name, df in tables.items():
        if name == "trait_mean_vs_overall":
            sinks.write_csv(df, f"{output}/tables/{name}")
        else:
            sinks.save_table(df, f"{output}/tables/{name}.csv")
    scalars = report_scalars(valid, tables)
    sinks.write_json(scalars, f"{output}/report_scalars.json")
    overall = tables["rater_score_descriptive_statistics"].where(F.col("score_variable") == OVERALL)
    sections = [
        ("In short", _sentences(scalars)), ("Samples", tables["dataset_summary"]), ("Scores", tables["score_descriptive_statistics"]), ("Most severe and most lenient raters", descriptive.extremes(overall, "mean", "rater_id")),
        ("Strongest relative tendencies", descriptive.strongest_tendencies(tables["rater_trait_relative_profile"])), ("Overall against its predictors", tables["overall_trait_correlations"]), ("Strongest predictor", correlation.strongest_predictor(tables["overall_trait_correlations"])),
        ("Spread of the raters' correlations", correlation.correlation_ranges(tables["rater_overall_trait_correlations"])), ("Overall and the mean of the traits", tables["trait_mean_metrics"]), ("Trait means by Overall", descriptive.overall_trait_mean_groups(valid).orderBy(OVERALL)),
        ("Gaps", descriptive.extremes(tables["rater_overall_minus_trait_mean"], "mean", "rater_id")), ("Use of the levels", descriptive.extremes(descriptive.usage_share(valid), "extreme_share", "rater_id")), ("Text lengths", descriptive.extremes(tables["rater_text_length_summary"], "mean_word_count", "rater_id", 1)),
    ]
    sinks.write_report("Ratings", sections, f"{output}/report.md")
    save_figures(valid, tables, f"{output}/figures")
    return tables


def run_conversion(spark: SparkSession, source: str, output: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw scores to the wide form, checked before anything is written, as CSV and Parquet in the order of rows, with two summaries."""
    ship_library(spark)
    raw = files.load_raw_scores(spark, files.resolve_input_path(spark, source))
    wide = reshape.create_wide(raw)
    broken = {r.check: r.violations for r in reshape.conversion_violations(raw, wide).collect() if r.violations}
    if broken:
        raise ValueError(f"the conversion changed something: {broken}")
    summary, counts = reshape.conversion_summary(wide, raw), reshape.position_counts(wide).orderBy(*rater_number_key(F.col("rater_id")))
    wide.orderBy("source_row_id", "rater_position").write.mode("overwrite").parquet(f"{output}/rater_essay_wide.parquet")
    sinks.write_csv(spark.read.parquet(f"{output}/rater_essay_wide.parquet").orderBy("source_row_id", "rater_position"), f"{output}/rater_essay_wide_csv")
    sinks.save_table(summary, f"{output}/rater_essay_wide_summary.csv")
    sinks.save_table(counts, f"{output}/rater_essay_wide_rater_counts.csv")
    return wide, summary, counts


def run_inference_input(spark: SparkSession, source: str, output: str) -> tuple[str, str]:
    """The inference form of raw scores, as CSV and JSON lines."""
    ship_library(spark)
    return sinks.save_inference_input(reshape.inference_input(files.load_raw_scores(spark, files.resolve_input_path(spark, source))), output)


def run_phases(wide: DataFrame, make: Callable[[], pipeline.Generator], output: str, num_targets: int, history_size: int, seed: int, candidates: int = 3, max_retries: int = 1, max_model_len: int = 4096, reserved_output_tokens: int = 384, characters_per_token: float = 3.0) -> dict[str, DataFrame]:
    """Predict, explain, verify, compare and sum up. Every phase's records are written and read back by the next one.

    Each phase drops a target's last histories until its prompt fits the context, and raises if the target alone doesn't.
    """
    spark = wide.sparkSession
    ship_library(spark)

    def kept(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{output}/{name}")
        return spark.read.parquet(f"{output}/{name}")

    settings = {"num_targets": num_targets, "history_size": history_size, "seed": seed, "candidates": candidates, "max_retries": max_retries, "max_model_len": max_model_len, "reserved_output_tokens": reserved_output_tokens}
    sinks.write_json(sinks.experiment_metadata(settings), f"{output}/experiment_metadata.json")
    rows = history.experiment_rows(wide, with_text=True)
    targets = history.sample_targets(rows.drop("Text"), num_targets, seed, history_size, strict=True)
    histories = kept("histories", history.sample_histories(rows.drop("Text"), history_size, seed, targets))
    blocks = kept("blocks", prompts.format_histories(histories, rows))
    chosen = rows.join(targets.select("target_id"), "target_id").select("target_id", "rater_id", "Text", F.col(OVERALL).cast("int").alias("gold_overall"))
    context = (max_model_len - reserved_output_tokens, characters_per_token)
    asked = prompts.fit_prompts(chosen, blocks, prompts.TEMPLATES["prediction"], *context).drop("Text")
    predictions = kept("phase1_predictions", asked.join(pipeline.predict(asked, make, {}, max_retries), "target_id"))
    explain = prompts.fit_prompts(chosen, blocks, prompts.TEMPLATES["reference"], *context, gold_overall=F.col("gold_overall"))
    unverified = kept("reference_candidates_unverified", pipeline.reference_candidates(pipeline.generate_answers(explain, make, {}, candidates), chosen))
    usable = unverified.where("parse_error IS NULL").join(chosen.select("target_id", "rater_id", "Text"), "target_id").withColumn("key", F.concat_ws("#", "target_id", F.col("candidate_id").cast("string")))
    verify = prompts.fit_prompts(usable, blocks, prompts.TEMPLATES["verification"], *context, "key", reference_reasoning=F.col("reference_reasoning"))
    rebuilt = pipeline.reconstruct_scores(verify.select(F.col("key").alias("target_id"), "prompt"), make, {})
    key = F.split("target_id", "#")
    rebuilt = rebuilt.select(key[0].alias("target_id"), key[1].cast("int").alias("candidate_id"), "reconstructed_overall", "verification_parse_error")
    verified = kept("reference_candidates", pipeline.verify_candidates(unverified, rebuilt))
    quality = kept("reasoning_quality", pipeline.reasoning_quality(predictions, verified.where("verified")))
    detail = kept("prediction_per_target", pipeline.prediction_detail(predictions, quality))
    results = {"prediction_metrics": agreement.prediction_metrics(predictions), "verification_summary": pipeline.verification_summary(verified)}
    for name, df in results.items():
        sinks.write_json(df, f"{output}/{name}.json") if df.count() else None
    tables = {"reasoning_quality_by_correctness": pipeline.quality_by_correctness(detail), "reasoning_error_correlations": pipeline.quality_error_correlations(detail)}
    for name, df in tables.items():
        sinks.save_table(df, f"{output}/{name}.csv")
    return {"predictions": predictions, "candidates": verified, "reasoning_quality": quality, "detail": detail} | results | tables


def context_table(wide: DataFrame, sizes: tuple[int, ...], seed: int, budgets: dict[str, int], count: Callable[[DataFrame], DataFrame] | None = None, references: DataFrame | None = None) -> DataFrame:
    """Prompt sizes of every eligible target for each history size and phase, as ``experiments.context_fit`` takes them.

    ``count`` maps (``target_id``, ``phase``, ``k``, ``prompt``) to rows with ``prompt_tokens``; without it the estimate of four
    characters a token is used. The verification prompts hold the reasonings of ``references`` (``target_id``, ``reference_reasoning``)
    in turn; without it they hold none and are too short by that much.
    """
    rows = history.experiment_rows(wide, with_text=True)
    h = history.sample_histories(rows.drop("Text"), max(sizes), seed)
    asked = rows.select("target_id", "rater_id", "Text", OVERALL)
    if references is None:
        asked = asked.withColumn("reasoning", F.lit(""))
    else:
        asked = asked.join(experiments.assign_round_robin(rows.select("target_id"), experiments.number_reasonings(references)), "target_id")
    out: DataFrame | None = None
    for k in sizes:
        blocks = prompts.format_histories(h.where(F.col("rn") <= k), rows)
        for phase, budget in budgets.items():
            built = prompts.build_prompts(asked, blocks, prompts.TEMPLATES[phase], gold_overall=F.col(OVERALL).cast("int"), reference_reasoning=F.col("reasoning"))
            part = built.select("target_id", "rater_id", F.lit(phase).alias("phase"), F.lit(k).alias("k"), F.lit(budget).alias("output_budget"), F.col("prompt_token_estimate").alias("prompt_tokens"), "prompt")
            out = part if out is None else out.unionByName(part)
    return out.drop("prompt") if count is None else count(out.drop("prompt_tokens"))


__all__ = ["analysis_tables", "run_analysis", "run_conversion", "run_phases", "context_table", "experiments"]


def _generator(name: str) -> Callable[[], pipeline.Generator]:
    """``package.module:factory``, importable on the executors too."""
    module, _, factory = name.partition(":")
    return getattr(importlib.import_module(module), factory)


def run_context(spark: SparkSession, source: str, output: str, sizes: tuple[int, ...], seed: int, max_lengths: tuple[int, ...]) -> DataFrame:
    """Prompt sizes of every eligible target per phase and history size, and how many fit each context length."""
    ship_library(spark)
    context_table(files.load_processed_wide(spark, source), sizes, seed, {"prediction": 384, "reference": 384, "verification": 128}).write.mode("overwrite").parquet(f"{output}/context_detail.parquet")
    sinks.write_json(sinks.experiment_metadata({"sizes": list(sizes), "seed": seed, "max_lengths": list(max_lengths)}), f"{output}/experiment_metadata.json")
    fit = experiments.context_fit(spark.read.parquet(f"{output}/context_detail.parquet"), max_lengths)
    sinks.save_table(fit.orderBy("phase", "k", "max_model_len"), f"{output}/context_fit.csv")
    return fit


def main(argv: list[str] | None = None) -> None:
    """Commands: analysis, conversion, inference-input, phases, pilot, robustness, context."""
    from markweave.plans import trials

    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="run", required=True)
    numbers = lambda x: tuple(int(k) for k in x.split(","))
    for name in ("analysis", "conversion", "inference-input", "phases", "pilot", "robustness", "context"):
        c = commands.add_parser(name)
        c.add_argument("--input", required=True)
        c.add_argument("--output", required=True)
        if name in ("phases", "pilot", "robustness"):
            c.add_argument("--generator", required=True, help="package.module:factory of a generator")
            c.add_argument("--max-model-len", type=int, default=4096)
        if name in ("phases", "pilot"):
            c.add_argument("--targets", type=int, default=100)
        if name == "phases":
            c.add_argument("--history-size", type=int, default=5)
        if name == "robustness":
            c.add_argument("--base", required=True, help="output folder of the pilot")
            c.add_argument("--seeds", type=numbers, required=True)
        if name in ("phases", "pilot", "robustness", "context"):
            c.add_argument("--seed", type=int, default=42)
        if name in ("pilot", "robustness", "context"):
            c.add_argument("--sizes", type=numbers, default=(3, 5) if name == "robustness" else (1, 3, 5))
        if name == "context":
            c.add_argument("--max-lengths", type=numbers, default=(2048, 4096, 8192))
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("markweave").getOrCreate()
    Path(a.output).mkdir(parents=True, exist_ok=True)
    wide = files.load_processed_wide(spark, a.input) if a.run in ("phases", "pilot", "robustness") else None
    match a.run:
        case "analysis":
            run_analysis(spark, a.input, a.output)
        case "conversion":
            run_conversion(spark, a.input, a.output)
        case "inference-input":
            run_inference_input(spark, a.input, a.output)
        case "phases":
            run_phases(wide, _generator(a.generator), a.output, a.targets, a.history_size, a.seed, max_model_len=a.max_model_len)
        case "pilot":
            trials.run_pilot(wide, _generator(a.generator), a.output, a.sizes, a.targets, a.seed, max_model_len=a.max_model_len)
        case "robustness":
            trials.run_robustness(wide, _generator(a.generator), a.output, a.base, a.seeds, a.seed, a.sizes, max_model_len=a.max_model_len)
        case "context":
            run_context(spark, a.input, a.output, a.sizes, a.seed, a.max_lengths)
    release_checkpoints(spark)


if __name__ == "__main__":
    main()
