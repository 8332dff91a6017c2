"""Queries of the training-data operators over the tables of a data folder, and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markweave.llm import answers, bpe, consensus, leakage, overlap, reading, residue, splits
from markweave.llm.names import essay_name
from markweave.llm.sql import oracle_sql  # noqa: F401
from markweave.session import ship_library, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.unfaithful(consensus.accuracies(consensus.ratings(table(spark, d, "rater_essay_wide")))).select("rater_no")


def p1_raters(spark: SparkSession, d: str) -> DataFrame:
    a = consensus.accuracies(consensus.ratings(table(spark, d, "rater_essay_wide")))
    return a.select("rater_no", "n_ratings", *(F.round(c, 6).alias(c) for c in ("mean_score", "sd_score", "agreement", "accuracy")))


def _consensus(spark: SparkSession, d: str, score: str) -> DataFrame:
    wide = table(spark, d, "rater_essay_wide")
    rated = consensus.ratings(wide, score)
    return consensus.consensus(rated, consensus.accuracies(rated), consensus.item_names(wide))


def p1_consensus(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d, "Overall")


def p1_consensus_cohesion(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d, "Cohesion")


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_overlaps(table(spark, d, "rater_essay_wide"), table(spark, d, "phase1_predictions"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_rows(_overlaps(spark, d))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping rows counted per split, and per source: whether the other row stands under the same name."""
    wide = table(spark, d, "rater_essay_wide")
    names = wide.groupBy(F.col("source_row_id").alias("row")).agg(F.min(essay_name(F.col("Filename"))).alias("name"))
    return overlap.overlap_report(*overlap.linked_classes(wide, table(spark, d, "phase1_predictions")), names)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.most_demanding(reading.reading_levels(table(spark, d, "rater_essay_wide"))).select("source_row_id").distinct()


def p3_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "rater_essay_wide"))


def p3_quality(spark: SparkSession, d: str) -> DataFrame:
    """How the fitted top level alone stands against the averages."""
    return reading.level_quality(reading.reading_levels(table(spark, d, "rater_essay_wide")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.group_of_rows(splits.tied_groups(table(spark, d, "rater_essay_wide")))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "rater_essay_wide").select("source_row_id", "Filename", "rater_id", "rater_position")
    return splits.label_rows(wide, splits.assign_splits(splits.tied_groups(wide)))


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    """The label of every row."""
    return _labelled(spark, d)


def p4_violations(spark: SparkSession, d: str) -> DataFrame:
    """What a labelling must keep: every row labelled, no tied rows parted, shares within the largest group."""
    return splits.split_violations(_labelled(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return answers.defective_answers(answers.answer_records(table(spark, d, "phase1_predictions"), table(spark, d, "reference_candidates_unverified")))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_passages"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where("verdict = 'leaked'").select("doc_id", "item_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Documents and mean run per held-out split and item, leaked and re-parameterised."""
    found = _leaks(spark, d).where("verdict <> 'touch'").groupBy("item_id", "verdict").agg(F.countDistinct("doc_id").alias("documents"), F.max("run").alias("longest_run"))
    return found.join(table(spark, d, "eval_passages").select("item_id", "split_name").distinct(), "item_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.template_residue(table(spark, d, "documents")).select("doc_id")


def p8_kinds(spark: SparkSession, d: str) -> DataFrame:
    return residue.template_residue(table(spark, d, "documents"))


_ALL = (p1_found, p1_raters, p1_consensus, p1_consensus_cohesion, p2_found, p2_report, p3_found, p3_levels, p3_quality, p4_found, p4_splits, p4_violations, p5_found, p6_ids, p7_found, p7_report, p8_found, p8_kinds)


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_library(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: _shipped(q) for q in _ALL}
