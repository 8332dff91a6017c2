"""From the two-rater form to one row per essay and rater, and its checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markweave.functions.scores import all_valid, is_valid, number, trait_statistics, validity_flags
from markweave.schema import OVERALL, POSITIONS, SCORES, SIDE_SCORES, TRAITS

_BLANKS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, _BLANKS, "")


def require(df: DataFrame, names) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def create_wide(raw: DataFrame) -> DataFrame:
    """One row per essay and position, from one scan; ``raw`` needs ``source_row_id``. Values stay as they are, flags are added."""
    require(raw, ["source_row_id", "Filename", "text_id_kaggle", "Text", *(f"Rater_{p}" for p in POSITIONS), *(f"{s}_{p}" for p in POSITIONS for s in SIDE_SCORES)])
    sides = [F.struct(F.lit(p).alias("rater_position"), trimmed(F.col(f"Rater_{p}").cast("string")).alias("rater_id"), *(number(F.col(f"{s}_{p}").cast("string")).alias(s) for s in SIDE_SCORES)) for p in POSITIONS]
    long = raw.select("source_row_id", "Filename", "text_id_kaggle", "Text", F.inline(F.array(*sides)))
    return long.withColumns(validity_flags()).withColumns(trait_statistics())


def trait_long(raw: DataFrame) -> DataFrame:
    """One row per essay, position and score, with the partner's score."""
    rows = []
    for p in POSITIONS:
        q = POSITIONS[1 - POSITIONS.index(p)]
        for s in SCORES:
            rows.append(F.struct(F.lit(p).alias("rater_position"), trimmed(F.col(f"Rater_{p}")).alias("rater_id"), F.lit(s).alias("trait"), number(F.col(f"{s}_{p}").cast("string")).alias("score"), trimmed(F.col(f"Rater_{q}")).alias("partner_rater_id"), number(F.col(f"{s}_{q}").cast("string")).alias("partner_score")))
    return raw.select("Filename", "text_id_kaggle", F.inline(F.array(*rows)))


def essay_long(raw: DataFrame) -> DataFrame:
    """One row per essay and position with rater, partner and scores."""
    sides = []
    for p in POSITIONS:
        q = POSITIONS[1 - POSITIONS.index(p)]
        sides.append(F.struct(F.lit(p).alias("rater_position"), trimmed(F.col(f"Rater_{p}")).alias("rater_id"), trimmed(F.col(f"Rater_{q}")).alias("partner_rater_id"), *(number(F.col(f"{s}_{p}").cast("string")).alias(s) for s in SCORES)))
    return raw.select("Filename", "text_id_kaggle", F.inline(F.array(*sides)))


def inference_input(raw: DataFrame) -> DataFrame:
    """The scores of both positions under an inference key."""
    return raw.select(F.col("text_id_kaggle").alias("inference_id"), "Filename", *(f"{s}_{p}" for p in POSITIONS for s in SCORES))


def _repeated_rows(df: DataFrame, *keys: str) -> DataFrame:
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("value"))


def conversion_summary(wide: DataFrame, raw_rows: DataFrame) -> DataFrame:
    """(``metric``, ``value``) of a conversion; ``raw_rows`` is counted."""
    one = wide.agg(
        F.count("*").alias("wide_row_count"), F.countDistinct("Filename").alias("unique_filename_count"), F.countDistinct("rater_id").alias("unique_rater_count"),
        F.count_if(is_valid(F.col(OVERALL))).alias("valid_overall_count"), F.count_if(all_valid(TRAITS)).alias("valid_trait_profile_count"),
        F.count_if(~is_valid(F.col(OVERALL))).alias("invalid_overall_count"), F.count_if(~all_valid(TRAITS)).alias("invalid_trait_profile_count"),
        F.count_if(F.col("has_any_invalid_score")).alias("any_invalid_score_count"), *(F.count_if(F.col("rater_position") == p).alias(f"rater_position_{p}_count") for p in POSITIONS),
    )
    long = one.unpivot([], one.columns, "metric", "value")
    extra = [("raw_row_count", raw_rows.agg(F.count("*").alias("value"))), ("duplicate_filename_position_rows", _repeated_rows(wide, "Filename", "rater_position")), ("duplicate_source_row_position_rows", _repeated_rows(wide, "source_row_id", "rater_position"))]
    for name, df in extra:
        long = long.unionByName(df.select(F.lit(name).alias("metric"), "value"))
    return long


def position_counts(wide: DataFrame) -> DataFrame:
    """Rows per rater (a missing one included) and position; positions without rows count 0."""
    return wide.groupBy("rater_id").agg(F.count("*").alias("sample_count"), *(F.count_if(F.col("rater_position") == p).alias(f"position_{p}_count") for p in POSITIONS))


def conversion_violations(raw: DataFrame, wide: DataFrame) -> DataFrame:
    """(``check``, ``violations``): what a conversion must not change; all 0 for a right one."""
    back = essay_long(raw)
    n_raw, n_wide = raw.agg(F.count("*").alias("n")), wide.agg(F.count("*").alias("n"))
    rows = n_raw.select(F.lit("row_count").alias("check"), F.col("n").alias("r")).join(n_wide.select(F.lit("row_count").alias("check"), F.col("n").alias("w")), "check").select("check", F.abs(F.col("r") * 2 - F.col("w")).alias("violations"))
    keys = wide.groupBy("source_row_id", "rater_position").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("violations")).select(F.lit("unique_key").alias("check"), "violations")
    places = wide.agg(F.count_if(~F.coalesce(F.col("rater_position").isin(*POSITIONS), F.lit(False))).alias("violations")).select(F.lit("positions").alias("check"), "violations")
    pairs = lambda df: df.groupBy("Filename", "rater_position").agg(F.count("*").alias("n"))
    a, b = pairs(back).alias("a"), pairs(wide).alias("b")
    same = (F.col("a.Filename").eqNullSafe(F.col("b.Filename"))) & (F.col("a.rater_position") == F.col("b.rater_position"))
    names = a.join(b, same, "full").agg(F.count_if(~F.col("a.n").eqNullSafe(F.col("b.n"))).alias("violations")).select(F.lit("filename_position_rows").alias("check"), "violations")
    return rows.unionByName(keys).unionByName(places).unionByName(names).unionByName(_value_violations(raw, wide))


def _value_violations(raw: DataFrame, wide: DataFrame) -> DataFrame:
    """Rows of either side whose key the other lacks, or whose identity, rater or a score differs."""
    names = ("Filename", "text_id_kaggle", "Text", "rater_id", *SIDE_SCORES)
    sides = [F.struct(F.lit(p).alias("rater_position"), trimmed(F.col(f"Rater_{p}").cast("string")).alias("rater_id"), *(number(F.col(f"{s}_{p}").cast("string")).alias(s) for s in SIDE_SCORES)) for p in POSITIONS]
    want = raw.select("source_row_id", *names[:3], F.inline(F.array(*sides))).withColumn("wanted", F.lit(True)).alias("a")
    got = wide.select("source_row_id", "rater_position", *names).withColumn("there", F.lit(True)).alias("b")
    differs = F.col("wanted").isNull() | F.col("there").isNull()
    for c in names:
        differs = differs | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return want.join(got, ["source_row_id", "rater_position"], "full").agg(F.count_if(differs).alias("violations")).select(F.lit("values").alias("check"), "violations")
