"""Deterministic target samples and leakage-free rater histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markweave.functions.scores import all_valid, target_id
from markweave.schema import OVERALL, SCORES, TRAITS

#: Ranks within a rater are counted in so many hash buckets, so that no task sorts a whole rater.
RANK_DIGITS = 2


def experiment_rows(wide: DataFrame, with_text: bool = False) -> DataFrame:
    """Valid rows by ``target_id``, one each: repeated ones resolve to the least (rater, scores)."""
    cols = ["rater_id", *SCORES, *(["Text"] if with_text else [])]
    rows = wide.where(all_valid() & F.col("rater_id").isNotNull()).withColumn("target_id", target_id())
    once = rows.groupBy("target_id").agg(F.min(F.struct("rater_id", *SCORES)).alias("x"), *([F.min("Text").alias("Text")] if with_text else []))
    return once.select("target_id", "x.*", *(["Text"] if with_text else [])).select("target_id", *cols)


def draw(seed: int, *parts: str | Column) -> Column:
    """A partition-independent random key: hash of seed and parts."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(F.col(p) if isinstance(p, str) else p for p in parts)), 256)


def stable_seed(seed: int, value: Column) -> Column:
    """The first eight bytes of the hash as an unsigned number."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), value), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def eligible_targets(rows: DataFrame, history_size: int, min_rater_samples: int = 0, raters: list[str] | None = None) -> DataFrame:
    """Targets of raters with enough other rows, optionally of listed raters only."""
    sizes = rows.groupBy("rater_id").agg(F.count("*").alias("n")).where((F.col("n") - 1 >= history_size) & (F.col("n") >= min_rater_samples)).select("rater_id")
    out = rows.join(sizes, "rater_id", "left_semi")
    return out.where(F.col("rater_id").isin(*raters)) if raters else out


def sample_targets(rows: DataFrame, n: int, seed: int, history_size: int, min_rater_samples: int = 0, raters: list[str] | None = None, strict: bool = False) -> DataFrame:
    """``n`` eligible targets by hash order. ``strict`` raises where there are fewer."""
    out = eligible_targets(rows, history_size, min_rater_samples, raters).withColumn("draw", draw(seed, "target_id")).orderBy("draw", "target_id").limit(n).drop("draw")
    if strict and (have := out.count()) < n:
        raise ValueError(f"only {have} eligible targets, {n} wanted")
    return out


def ranked_in_rater(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` with ``place`` (from 0, in hash order) and ``size`` within the rater.

    Two levels: places within a hash bucket, plus the sizes of the buckets before it, so that a rater with a third of all
    rows is spread over buckets.
    """
    keyed = rows.withColumn("draw", draw(seed, "target_id")).withColumn("bucket", F.substring("draw", 1, RANK_DIGITS))
    counts = keyed.groupBy("rater_id", "bucket").agg(F.count("*").alias("k"))
    w = Window.partitionBy("rater_id")
    starts = counts.select("rater_id", "bucket", (F.sum("k").over(w.orderBy("bucket")) - F.col("k")).alias("start"), F.sum("k").over(w).alias("size"))  # at most 16 ** RANK_DIGITS rows a rater
    inside = F.row_number().over(Window.partitionBy("rater_id", "bucket").orderBy("draw", "target_id"))
    return keyed.withColumn("inside", inside).join(starts, ["rater_id", "bucket"]).withColumn("place", F.col("start") + F.col("inside") - 1).drop("bucket", "start", "inside", "draw")


def _drawn(seed: int, size: int, others: Column) -> Column:
    """``size`` different numbers below ``others``, each an even draw from those not yet drawn; a shorter list is its beginning."""
    pick = lambda k: F.conv(F.substring(draw(seed, "target_id", k.cast("string")), 1, 12), 16, 10).cast("bigint") % (others - k + 1)
    free = lambda taken, r: F.aggregate(F.array_sort(taken), r, lambda x, c: F.when(c <= x, x + 1).otherwise(x))  # noqa: E731  # the r-th number that isn't taken
    return F.aggregate(F.sequence(F.lit(1), F.lit(size)), F.array().cast("array<bigint>"), lambda taken, k: F.concat(taken, F.array(free(taken, pick(k)))))


def sample_histories(rows: DataFrame, size: int, seed: int, targets: DataFrame | None = None) -> DataFrame:
    """(``target_id``, ``rater_id``, ``rn``, ``history_id``): ``size`` other rows of the target's rater, by seed.

    The rater's rows are numbered in hash order, and every target draws numbers of its own without repetition, counted from
    itself on. So draws of different targets are independent, those of different sizes are nested, no pair of rows is written
    out that isn't in the result, and targets of raters with too few rows have no history.
    """
    ring = ranked_in_rater(rows.select("target_id", "rater_id"), seed)
    own = ring if targets is None else ring.join(targets.select("target_id"), "target_id", "left_semi")
    drawn = own.where(F.col("size") - 1 >= size).select("target_id", "rater_id", "place", "size", F.posexplode(_drawn(seed, size, F.col("size") - 1)).alias("at", "number"))
    wanted = drawn.select("target_id", "rater_id", (F.col("at") + 1).alias("rn"), ((F.col("place") + 1 + F.col("number")) % F.col("size")).alias("place"))
    return wanted.join(ring.select("rater_id", "place", F.col("target_id").alias("history_id")), ["rater_id", "place"]).select("target_id", "rater_id", "rn", "history_id")


def history_prefixes(histories: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(``target_id``, ``rater_id``, ``K``, ``history_ids``): nested prefixes of one draw."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rn", "history_id"))), lambda x: x["history_id"])
    lists = histories.groupBy("target_id", "rater_id").agg(ordered.alias("ids"))
    return lists.select("target_id", "rater_id", "ids", F.explode(F.array(*(F.lit(k) for k in sizes))).alias("K")).where(F.col("K") <= F.size("ids")).select("target_id", "rater_id", "K", F.slice("ids", 1, F.col("K")).alias("history_ids"))


def history_violations(histories: DataFrame, rows: DataFrame) -> DataFrame:
    """(``check``, ``violations``): own rows, other raters' rows and repeated rows in histories; all 0 for right ones."""
    own = histories.agg(F.count_if(F.col("target_id") == F.col("history_id")).alias("violations")).select(F.lit("target_in_history").alias("check"), "violations")
    rater = histories.join(rows.select(F.col("target_id").alias("history_id"), F.col("rater_id").alias("r")), "history_id", "left").agg(F.count_if(~F.col("rater_id").eqNullSafe(F.col("r"))).alias("violations"))
    twice = histories.groupBy("target_id", "history_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("violations"))
    return own.unionByName(rater.select(F.lit("other_rater").alias("check"), "violations")).unionByName(twice.select(F.lit("repeated").alias("check"), "violations"))


__all__ = ["OVERALL", "TRAITS", "experiment_rows", "sample_targets", "sample_histories", "history_prefixes", "history_violations"]
