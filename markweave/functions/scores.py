"""Column expressions on scores; every one is a JVM expression."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from markweave.schema import LEVELS, OVERALL, SCORES, TRAITS


def number(c: Column) -> Column:
    """Text to a double; what is no number, and NaN, become null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def is_valid(c: Column) -> Column:
    """True only for a score of the scale; a missing one is invalid, not unknown."""
    return F.coalesce(c.isin(*(float(k) for k in LEVELS)), F.lit(False))


def all_valid(names: Iterable[str] = SCORES) -> Column:
    return reduce(lambda a, b: a & b, (is_valid(F.col(n)) for n in names))


def any_missing(names: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(n).isNull() for n in names))


def trait_statistics(names: tuple[str, ...] = TRAITS) -> dict[str, Column]:
    """Mean, least, greatest and population deviation over the traits of a row; null once any trait is."""
    cols = [F.col(n) for n in names]
    whole = ~any_missing(names)
    mean = sum(cols[1:], cols[0]) / F.lit(float(len(cols)))
    spread = sum(((c - mean) * (c - mean) for c in cols[1:]), (cols[0] - mean) * (cols[0] - mean)) / F.lit(float(len(cols)))
    return {"trait_mean": mean, "trait_min": F.when(whole, F.least(*cols)), "trait_max": F.when(whole, F.greatest(*cols)), "trait_std": F.sqrt(spread)}


def validity_flags() -> dict[str, Column]:
    bad_overall, bad_trait = ~is_valid(F.col(OVERALL)), ~all_valid(TRAITS)
    return {"has_invalid_overall": bad_overall, "has_invalid_trait": bad_trait, "has_any_invalid_score": bad_overall | bad_trait}


def half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5)).cast("int")


def target_id(row: str = "source_row_id", position: str = "rater_position") -> Column:
    return F.concat_ws(":", F.col(row).cast("long").cast("string"), F.col(position).cast("int").cast("string"))


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded in two steps, so that ties don't hang on the last bit, and never a negative zero."""
    return F.round(F.round(c, digits + 4), digits) + F.lit(0.0)


def error_columns(gold: str = "gold_overall", predicted: str = "predicted_overall") -> dict[str, Column]:
    """Exactness and errors of a prediction; null where there is none."""
    d = F.col(gold) - F.col(predicted)
    return {"exact_correct": d == 0, "absolute_error": F.abs(d), "squared_error": d * d}


def quadratic_kappa(n: Column, a: Column, b: Column, aa: Column, bb: Column, ab: Column) -> Column:
    """Quadratic weighted kappa from sums over the pairs; null where chance leaves no disagreement."""
    return 1 - F.try_divide(n * (aa + bb - 2 * ab), n * aa + n * bb - 2 * a * b)


def pearson(n: Column, a: Column, b: Column, aa: Column, bb: Column, ab: Column) -> Column:
    """Pearson's correlation from weighted sums; null under two pairs or without spread."""
    va, vb = n * aa - a * a, n * bb - b * b
    return F.when((n > 1) & (va > 1e-9) & (vb > 1e-9), F.try_divide(n * ab - a * b, F.sqrt(F.greatest(va, F.lit(0.0))) * F.sqrt(F.greatest(vb, F.lit(0.0)))))


def rater_prefix_key(c: Column) -> list[Column]:
    """Natural order: prefix, trailing number (-1 without one), whole id."""
    return [F.regexp_extract(c, r"^(.*?)(\d*)$", 1), F.coalesce(F.nullif(F.regexp_extract(c, r"^(.*?)(\d*)$", 2), F.lit("")).try_cast("bigint"), F.lit(-1)), c]


def rater_number_key(c: Column) -> list[Column]:
    """The other natural order: trailing number, whole id; ids without a number last."""
    return [F.nullif(F.regexp_extract(c, r"(\d+)$", 1), F.lit("")).try_cast("bigint").asc_nulls_last(), c]
