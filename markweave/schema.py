"""Score domain and explicit schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# Names of the scores and the levels that count as valid.
OVERALL = "Overall"
TRAITS = ("Cohesion", "Syntax", "Vocabulary", "Phraseology", "Grammar", "Conventions")
SCORES = (OVERALL, *TRAITS)
LEVELS = (1, 2, 3, 4, 5)
SCORE_MIN, SCORE_MAX = LEVELS[0], LEVELS[-1]
POSITIONS = (1, 2)
SIDE_SCORES = (*SCORES, "Identifying_Info")


def raw_schema() -> T.StructType:
    """The raw two-rater form: one row per essay, scores of both positions side by side; everything is read as text and coerced."""
    names = ["Filename", "text_id_kaggle", "Text", *(f"Rater_{p}" for p in POSITIONS), *(f"{s}_{p}" for p in POSITIONS for s in SIDE_SCORES)]
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


SAMPLING = T.StructType([T.StructField("temperature", T.DoubleType()), T.StructField("top_p", T.DoubleType()), T.StructField("max_tokens", T.IntegerType())])

PREDICTION = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("experiment_id", "timestamp", "git_commit", "target_id", "rater_id")]
    + [T.StructField("gold_overall", T.IntegerType()), T.StructField("predicted_overall", T.IntegerType()), T.StructField("reasoning", T.StringType()), T.StructField("history_ids", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.IntegerType()) for n in ("requested_history_size", "history_size", "prompt_token_estimate")]
    + [T.StructField("prompt", T.StringType()), T.StructField("raw_model_output", T.StringType()), T.StructField("raw_model_output_attempts", T.ArrayType(T.StringType()))]
    + [T.StructField("parse_attempts", T.IntegerType()), T.StructField("parse_error", T.StringType()), T.StructField("model_id", T.StringType()), T.StructField("sampling_parameters", SAMPLING)]
)

_TEXT, _WHOLE, _FLAG = T.StringType(), T.IntegerType(), T.BooleanType()


def _record(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


CANDIDATE = _record(
    target_id=_TEXT, rater_id=_TEXT, candidate_id=_WHOLE, gold_overall=_WHOLE, reference_reasoning=_TEXT, score_leak=_FLAG, history_ids=T.ArrayType(_TEXT), history_size=_WHOLE, prompt_token_estimate=_WHOLE,
    prompt=_TEXT, raw_model_output=_TEXT, parse_error=_TEXT, sampling_parameters=SAMPLING, reconstructed_overall=_WHOLE, verified=_FLAG, verification_prompt=_TEXT, verification_raw_output=_TEXT,
    verification_parse_error=_TEXT, verification_prompt_token_estimate=_WHOLE,
)
K_RECORD = _record(
    target_id=_TEXT, source_row_id=T.LongType(), rater_id=_TEXT, K=_WHOLE, gold_overall=_WHOLE, predicted_overall=_WHOLE, exact_correct=_FLAG, absolute_error=_WHOLE, squared_error=_WHOLE, prediction_reasoning=_TEXT,
    history_ids=T.ArrayType(_TEXT), history_rater_ids=T.ArrayType(_TEXT), prompt_tokens=_WHOLE, output_tokens=_WHOLE, context_fit=_FLAG, parse_success=_FLAG, retry_count=_WHOLE, parse_error=_TEXT,
    inference_time_seconds=T.DoubleType(), raw_model_output=_TEXT, raw_model_output_attempts=T.ArrayType(_TEXT), prompt=_TEXT,
)
SEED_RECORD = T.StructType([T.StructField("seed", T.LongType()), T.StructField("reused_from_base_pilot", _FLAG), *(f for f in K_RECORD.fields if f.name not in ("history_rater_ids", "output_tokens", "context_fit", "raw_model_output_attempts"))])
CONTEXT_DETAIL = _record(target_id=_TEXT, rater_id=_TEXT, phase=_TEXT, k=_WHOLE, output_budget=_WHOLE, history_ids=_TEXT, target_in_history=_FLAG, prompt_tokens=_WHOLE)
