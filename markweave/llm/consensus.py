"""Consensus of annotators who disagree, with an agreement measure per item and a reliability per annotator.

Method: the triplet moment method. Scores are standardised per annotator; the agreement rate of two annotators, weighted
by squared distance and corrected for what chance gives (1 - sum (z_i - z_j)^2 / expected sum), is then the mean product of
their scores over shared items, c_ij = a_i a_j. Of any three annotators i, j, k the accuracy follows as
a_i^2 = c_ij c_ik / c_jk. Two annotators share few items, so j and k are panels: all annotators whose number leaves the same
rest by ``PANELS``. An annotator's agreement with each panel and the panels' agreement with each other come from sums per
item and panel, so that no pair of annotators is written out, whatever the size of an item's group; the triplets of all
pairs of panels are pooled by the number of comparisons behind them, and the sign is that of the agreement with all panels.
``PASSES`` passes then weigh the comparisons by the accuracy of the very annotators met (a_i = sum z_i a_j z_j / sum a_j^2,
averaged with the last estimate from the second pass on, which keeps the scale from swinging).
Votes are combined with log-odds weights log((1 + a) / (1 - a)); an annotator who runs against the others votes reversed.

Defined results: null ids, items and scores and scores outside the scale are left out; repeated rows of one
(row, position, annotator) count once, with the least score; an annotator whose scores never vary has accuracy 0 and weight
0, one without shared items accuracy null and weight 0; an item with one vote has agreement null; an empty table gives empty
results.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markweave.llm.names import essay_name, rater_no
from markweave.session import cut_lineage

SCALE = (1, 5)
PANELS = 4
PASSES = 2
LIMIT = 0.98
MIN_RATINGS = 20
#: Below this accuracy an annotator doesn't follow the quality the others see.
FAITHFUL = 0.3


def _item(wide: DataFrame) -> Column:
    return F.coalesce(essay_name(F.col("Filename")), F.concat(F.lit("row "), F.col("source_row_id").cast("string")))


def ratings(wide: DataFrame, score: str = "Overall") -> DataFrame:
    """(``item`` bigint key, ``rater_no``, ``score``, ``n``): valid scores, each (row, position, annotator) once, averaged per item and annotator. Written once."""
    number = F.col(score).cast("double")
    valid = wide.where(number.isin([float(k) for k in range(SCALE[0], SCALE[1] + 1)])).select("source_row_id", "rater_position", rater_no(F.col("rater_id")).alias("rater_no"), F.xxhash64(_item(wide)).alias("item"), number.alias("score"), _item(wide).alias("name"))
    valid = valid.where(F.col("rater_no").isNotNull() & F.col("name").isNotNull()).drop("name")
    once = valid.groupBy("source_row_id", "rater_position", "rater_no").agg(F.min("item").alias("item"), F.min("score").alias("score"))
    return cut_lineage(once.groupBy("item", "rater_no").agg(F.avg("score").alias("score"), F.count("*").alias("n")))


def item_names(wide: DataFrame) -> DataFrame:
    """(``item`` key, ``name``) of every item."""
    return wide.select(_item(wide).alias("name")).where("name IS NOT NULL").distinct().select(F.xxhash64("name").alias("item"), "name")


def _clipped(a: Column) -> Column:
    return F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), a))


def panel_triplets(z: DataFrame, panels: int = PANELS) -> DataFrame:
    """(``rater_no``, ``agreement``, ``a``): agreement with the others corrected for chance, and the accuracy that the pooled triplets give."""
    own = F.pmod("rater_no", F.lit(panels))
    mine = [F.when(own == g, F.col("z")).otherwise(0.0) for g in range(panels)]
    here = [F.when(own == g, 1).otherwise(0) for g in range(panels)]
    items = z.groupBy("item").agg(*(F.sum(mine[g]).alias(f"s{g}") for g in range(panels)), *(F.sum(here[g]).alias(f"n{g}") for g in range(panels)))
    pairs = list(combinations(range(panels), 2))
    between = items.agg(*(F.try_divide(F.sum(F.col(f"s{g}") * F.col(f"s{h}")), F.sum(F.col(f"n{g}") * F.col(f"n{h}"))).alias(f"c{g}{h}") for g, h in pairs)).first()
    met = z.join(items, "item").groupBy("rater_no").agg(
        *(F.sum(F.col("z") * (F.col(f"s{g}") - mine[g])).alias(f"u{g}") for g in range(panels)), *(F.sum(F.col(f"n{g}") - here[g]).alias(f"k{g}") for g in range(panels))
    )
    total = lambda c: sum((F.col(f"{c}{g}") for g in range(1, panels)), F.col(f"{c}0"))
    up = sum((F.col(f"u{g}") * F.col(f"u{h}") for g, h in pairs), F.lit(0.0))
    down = sum((F.col(f"k{g}") * F.col(f"k{h}") * F.lit(float(between[f"c{g}{h}"] or 0.0)) for g, h in pairs), F.lit(0.0))
    square = F.greatest(F.coalesce(F.try_divide(up, F.when(down > 0, down)), F.lit(0.0)), F.lit(0.0))
    return met.where(total("k") > 0).select("rater_no", F.try_divide(total("u"), total("k")).alias("agreement"), _clipped(F.signum(total("u")) * F.sqrt(square)).alias("a"))


def met_again(z: DataFrame, a: DataFrame, keep: float) -> DataFrame:
    """(``rater_no``, ``a``): accuracy from the annotators met, weighted by theirs; the share ``keep`` of the last estimate stays."""
    za = z.join(a, "rater_no")
    items = za.groupBy("item").agg(F.sum(F.col("a") * F.col("z")).alias("t"), F.sum(F.col("a") * F.col("a")).alias("q"))
    sums = za.join(items, "item").groupBy("rater_no", "a").agg(F.sum(F.col("z") * (F.col("t") - F.col("a") * F.col("z"))).alias("up"), F.sum(F.col("q") - F.col("a") * F.col("a")).alias("down"))
    new = F.when(F.col("down") > 1e-3, _clipped(F.try_divide("up", "down"))).otherwise(F.col("a"))
    return sums.select("rater_no", (F.lit(1.0 - keep) * new + F.lit(keep) * F.col("a")).alias("a"))


def accuracies(rated: DataFrame, passes: int = PASSES) -> DataFrame:
    """(``rater_no``, ``n_ratings``, ``mean_score``, ``sd_score``, ``agreement``, ``accuracy``) of every annotator; see the module's method."""
    norms = cut_lineage(rated.groupBy("rater_no").agg(F.sum("n").alias("n_ratings"), F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("sd_score")))
    z = cut_lineage(rated.join(norms.where("sd_score > 1e-9"), "rater_no").select("item", "rater_no", ((F.col("score") - F.col("mean_score")) / F.col("sd_score")).alias("z")))
    found = cut_lineage(panel_triplets(z))
    a = found.select("rater_no", "a")
    for k in range(passes):
        a = cut_lineage(met_again(z, a, 0.5 if k else 0.0))
    out = norms.join(found.select("rater_no", "agreement"), "rater_no", "left").join(a.withColumnRenamed("a", "accuracy"), "rater_no", "left")
    return out.withColumn("accuracy", F.when(F.col("sd_score") > 1e-9, F.col("accuracy")).otherwise(0.0))


def unfaithful(annotators: DataFrame, min_ratings: int = MIN_RATINGS, faithful: float = FAITHFUL) -> DataFrame:
    """Annotators with enough ratings whose scores don't follow the others' view of quality, or run against it.

    One whose scores never vary follows nothing and is a case; one without shared items is none.
    """
    return annotators.where((F.col("n_ratings") >= min_ratings) & (F.col("accuracy") < faithful))


def consensus(rated: DataFrame, annotators: DataFrame, names: DataFrame) -> DataFrame:
    """(``item``, ``votes``, ``consensus``, ``consensus_score``, ``agreement``) of every rated item, by its name.

    ``agreement`` is 1 less the weighted variance of the item's votes over the variance of all votes.
    """
    centre = rated.agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).first()
    weight = F.coalesce(F.log((1 + F.col("accuracy")) / (1 - F.col("accuracy"))), F.lit(0.0))
    votes = rated.join(annotators, "rater_no").withColumn("w", weight).withColumn("m", F.lit(centre.m).cast("double")).withColumn("s", F.lit(centre.s).cast("double"))
    z = F.coalesce(F.try_divide(F.col("score") - F.col("mean_score"), F.col("sd_score")), F.lit(0.0))
    votes = votes.select("item", F.abs("w").alias("w"), (F.col("m") + F.col("s") * z * F.when(F.col("w") < 0, -1.0).otherwise(1.0)).alias("v"), "s", "score")
    sums = votes.groupBy("item").agg(F.count("*").alias("votes"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("v")).alias("wv"), F.sum(F.col("w") * F.col("v") * F.col("v")).alias("wvv"), F.avg("score").alias("plain"), F.first("s").alias("s"))
    known = F.when(F.col("w") > 1e-9, F.col("w"))
    mean = F.round(F.coalesce(F.try_divide("wv", known), F.col("plain")), 6)
    spread = F.try_divide("wvv", known) - F.pow(F.try_divide("wv", known), 2)
    scored = sums.select(
        "item", "votes", mean.alias("consensus"), F.greatest(F.lit(SCALE[0]), F.least(F.lit(SCALE[1]), F.floor(mean + 0.5).cast("int"))).alias("consensus_score"),
        F.when(F.col("votes") > 1, F.round(1 - F.try_divide(spread, F.col("s") * F.col("s")), 6)).alias("agreement"),
    )
    return scored.join(names, "item").select(F.col("name").alias("item"), "votes", "consensus", "consensus_score", "agreement")
