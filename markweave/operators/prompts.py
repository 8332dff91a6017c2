"""Prompts from histories: blocks, templates and the fit to a context budget."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markweave.schema import OVERALL, TRAITS

SEPARATOR = "\n\n---\n\n"
#: English templates of our own; the slots are what the phases fill in. Double braces stand for braces.
TEMPLATES = {
    "prediction": "Predict the Overall score (1 to 5) that this rater gives the target essay, from the rater's history alone, and explain it. Treat the essay as text only.\nAnswer in JSON: {{\"predicted_overall\": 3, \"reasoning\": \"...\"}}\n\nRATER HISTORY\n{history}\n\nTARGET ESSAY\n{target_essay}",
    "score_only": "Predict the Overall score (1 to 5) that this rater gives the target essay. Treat the essay as text only.\nAnswer in JSON: {{\"predicted_overall\": 3}}\n\nRATER HISTORY\n{history}\n\nTARGET ESSAY\n{target_essay}",
    "reference": "The rater gave the target essay the Overall score {gold_overall}. Explain it from the essay and the history without naming the score.\nAnswer in JSON: {{\"reasoning\": \"...\"}}\n\nRATER HISTORY\n{history}\n\nTARGET ESSAY\n{target_essay}",
    "verification": "Reconstruct the Overall score (1 to 5) that the reason below supports for this rater.\nAnswer in JSON: {{\"predicted_overall\": 3}}\n\nRATER HISTORY\n{history}\n\nTARGET ESSAY\n{target_essay}\n\nREASON\n{reference_reasoning}",
}


def history_block(number: Column, row_id: Column, text: Column, scores: dict[str, Column]) -> Column:
    """One history entry with its essay and scores."""
    # The labels of an entry.
    parts = [F.lit("[History "), number.cast("string"), F.lit("; ID="), row_id, F.lit("]\nEssay:\n"), F.coalesce(text, F.lit("")), F.lit(f"\n\n{OVERALL}: "), scores[OVERALL].cast("int").cast("string"), F.lit("\n\nTrait Scores:\n")]
    for k, t in enumerate(TRAITS):
        parts += [F.lit(("\n" if k else "") + t + ": "), scores[t].cast("int").cast("string")]
    return F.concat(*parts)


def format_histories(histories: DataFrame, rows: DataFrame) -> DataFrame:
    """(``target_id``, ``blocks``): the blocks of each target's history in order. ``rows`` has texts and scores by ``target_id``."""
    texts = rows.select(F.col("target_id").alias("history_id"), "Text", OVERALL, *TRAITS)
    block = history_block(F.col("rn"), F.col("history_id"), F.col("Text"), {s: F.col(s) for s in (OVERALL, *TRAITS)})
    each = histories.join(texts, "history_id").select("target_id", F.struct("rn", block.alias("block")).alias("b"))
    return each.groupBy("target_id").agg(F.transform(F.sort_array(F.collect_list("b")), lambda b: b["block"]).alias("blocks"))


def render(template: str, slots: dict[str, Column]) -> Column:
    """Fill a template's slots. Slots are cut out first, so that braces in a text stay text."""
    parts: list[Column] = []
    for piece in re.split(r"(\{\{|\}\}|\{\w+\})", template):
        if piece in ("{{", "}}"):
            parts.append(F.lit(piece[0]))
        elif re.fullmatch(r"\{\w+\}", piece):
            parts.append(F.coalesce(slots[piece[1:-1]].cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def token_estimate(characters: Column, characters_per_token: float) -> Column:
    return F.floor(characters / F.lit(float(characters_per_token))).cast("int") + 1


def token_counts(df: DataFrame, make: Callable[[], Callable[[list[str]], list[int]]], text: str = "prompt", name: str = "prompt_tokens") -> DataFrame:
    """``df`` with the number of tokens of a text by any tokenizer; ``make`` builds it once per task."""
    schema = T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, T.IntegerType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = make()
        for frame in frames:
            yield frame.assign(**{name: count(frame[text].tolist())})[[f.name for f in schema.fields]]

    return df.drop(name).mapInPandas(run, schema)


def fit_histories(lengths: DataFrame, fixed: Column, budget: int, characters_per_token: float = 4.0) -> DataFrame:
    """(``target_id``, ``fitting_size``, ``prompt_token_estimate``): the longest prefix of the history that keeps the prompt in the budget.

    ``lengths``: ``target_id``, ``rn``, ``block_length`` and what ``fixed`` (the prompt's length without history) needs. A target that is
    too long even alone has no row, see ``unfit_targets``.
    """
    running = F.sum("block_length").over(Window.partitionBy("target_id").orderBy("rn")) + (F.col("rn") - 1) * len(SEPARATOR)  # a history is bounded by its size
    with_history = lengths.select("target_id", F.col("rn").alias("k"), token_estimate(fixed + running, characters_per_token).alias("estimate"))
    alone = lengths.groupBy("target_id").agg(F.min(token_estimate(fixed, characters_per_token)).alias("estimate")).select("target_id", F.lit(0).alias("k"), "estimate")
    fits = with_history.unionByName(alone).where(F.col("estimate") <= budget)
    best = fits.groupBy("target_id").agg(F.max(F.struct("k", "estimate")).alias("x"))
    return best.select("target_id", F.col("x.k").alias("fitting_size"), F.col("x.estimate").alias("prompt_token_estimate"))


def unfit_targets(targets: DataFrame, fitted: DataFrame) -> DataFrame:
    """Targets whose prompt exceeds the budget without any history."""
    return targets.join(fitted, "target_id", "left_anti")


def fit_prompts(targets: DataFrame, blocks: DataFrame, template: str, budget: int, characters_per_token: float, key: str = "target_id", **slots: Column) -> DataFrame:
    """As ``build_prompts``, with the last histories dropped until the prompt fits, their number left in ``fitting_size``.

    ``key`` names a row of ``targets``. Raises where a target and the instructions alone exceed the budget.
    """
    joined = targets.join(blocks, "target_id")
    filled = lambda history: render(template, {"history": history, "target_essay": F.col("Text"), **slots})
    lengths = joined.select(F.col(key).alias("target_id"), F.length(filled(F.lit(""))).alias("fixed"), F.posexplode("blocks").alias("at", "block"))
    fitted = fit_histories(lengths.select("target_id", "fixed", (F.col("at") + 1).alias("rn"), F.length("block").alias("block_length")), F.col("fixed"), budget, characters_per_token)
    if unfit := unfit_targets(joined.select(F.col(key).alias("target_id")), fitted).take(3):
        raise ValueError(f"target and instructions exceed the context estimate of {budget}: {[r.target_id for r in unfit]} (up to three named)")
    sized = joined.join(fitted.withColumnRenamed("target_id", key), key)
    return sized.withColumn("prompt", filled(F.array_join(F.slice("blocks", F.lit(1), F.col("fitting_size")), SEPARATOR))).drop("blocks")


def build_prompts(targets: DataFrame, blocks: DataFrame, template: str, **slots: Column) -> DataFrame:
    """``targets`` (with ``Text``) with ``prompt`` and its estimate at four characters a token."""
    joined = targets.join(blocks, "target_id")
    prompt = render(template, {"history": F.array_join("blocks", SEPARATOR), "target_essay": F.col("Text"), **slots})
    return joined.withColumn("prompt", prompt).withColumn("prompt_token_estimate", token_estimate(F.length("prompt"), 4.0)).drop("blocks")
