"""Queries on the ratings, each with the SQL it can be held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markweave.functions.scores import rounded
from markweave.operators import agreement, correlation, descriptive, profiles, reshape
from markweave.schema import LEVELS, OVERALL, POSITIONS, SCORES, SIDE_SCORES, TRAITS
from markweave.session import table


def ratings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rater_essay_wide")


def valid(spark: SparkSession, d: str) -> DataFrame:
    return descriptive.valid_samples(ratings(spark, d))


def raw_two_rater(spark: SparkSession, d: str) -> DataFrame:
    """The raw form of the ratings: both positions of a source row side by side; repeated rows resolve to the greatest value."""
    at = lambda c, p: F.max(F.when(F.col("rater_position") == p, F.col(c)))
    return ratings(spark, d).groupBy("source_row_id").agg(
        F.max("Filename").alias("Filename"), F.max("text_id_kaggle").alias("text_id_kaggle"), F.max("Text").alias("Text"),
        *(at("rater_id", p).alias(f"Rater_{p}") for p in POSITIONS), *(at(s, p).alias(f"{s}_{p}") for p in POSITIONS for s in SIDE_SCORES),
    )


_VALID = "valid AS (SELECT * FROM rater_essay_wide WHERE " + " AND ".join(f"{s} IN (1, 2, 3, 4, 5)" for s in SCORES) + ")"
_RAW = (
    "raw AS (SELECT source_row_id, max(Filename) AS Filename, max(text_id_kaggle) AS text_id_kaggle, max(Text) AS Text, "
    + ", ".join(f"max(rater_id) FILTER (WHERE rater_position = {p}) AS Rater_{p}" for p in POSITIONS)
    + ", "
    + ", ".join(f"max({s}) FILTER (WHERE rater_position = {p}) AS {s}_{p}" for p in POSITIONS for s in SIDE_SCORES)
    + " FROM rater_essay_wide GROUP BY source_row_id)"
)
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _melt(names=SCORES, keys: str = "", source: str = "valid", variable: str = "score_variable", value: str = "score") -> str:
    return " UNION ALL ".join(f"SELECT {keys}{', ' if keys else ''}'{n}' AS {variable}, CAST({n} AS DOUBLE) AS {value} FROM {source}" for n in names)


_STATS = "count({0}) AS \"count\", round(avg({0}), 6) AS mean, round(median({0}), 6) AS median, round(stddev_samp({0}), 6) AS std, {1}min({0}){2} AS min, {1}max({0}){2} AS max"
_SUM = "CAST(" + " + ".join(TRAITS) + " AS INTEGER)"


def _corr_sql(pairs: str, keys: str, lead: str = "") -> str:
    """``pairs``: a query with keys, x and y."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    tie = f"PARTITION BY {k}" if keys else "PARTITION BY "
    return f"""
        {lead} p AS (SELECT * FROM ({pairs}) WHERE x IS NOT NULL AND y IS NOT NULL),
        r AS (SELECT *, rank() OVER ({part}ORDER BY x) + (count(*) OVER ({tie}x) - 1) / 2.0 AS rx, rank() OVER ({part}ORDER BY y) + (count(*) OVER ({tie}y) - 1) / 2.0 AS ry FROM p),
        m AS (SELECT {k}count(*) AS n, avg(x) AS ax, avg(y) AS ay, avg(rx) AS arx, avg(ry) AS ary FROM r {'GROUP BY ' + keys if keys else ''}),
        s AS (SELECT {', '.join('r.' + x.strip() for x in keys.split(',')) + ', ' if keys else ''}any_value(n) AS n, sum((x - ax) * (y - ay)) AS sxy, sum((x - ax) ** 2) AS sxx, sum((y - ay) ** 2) AS syy,
              sum((rx - arx) * (ry - ary)) AS rxy, sum((rx - arx) ** 2) AS rxx, sum((ry - ary) ** 2) AS ryy FROM r {'JOIN m USING (' + keys + ')' if keys else 'CROSS JOIN m'} {'GROUP BY ' + ', '.join('r.' + x.strip() for x in keys.split(',')) if keys else ''})
        SELECT {k}CAST(n AS BIGINT) AS "count", CASE WHEN n > 1 AND sxx > 1e-9 AND syy > 1e-9 THEN round(sxy / sqrt(sxx) / sqrt(syy), 6) END AS pearson_correlation,
               CASE WHEN n > 1 AND sxx > 1e-9 AND syy > 1e-9 THEN round(rxy / sqrt(rxx) / sqrt(ryy), 6) END AS spearman_correlation FROM s"""


def _predictor_pairs(keys: str, predictors) -> str:
    k = f"{keys}, " if keys else ""
    return " UNION ALL ".join(f"SELECT {k}'{p}' AS predictor, CAST(Overall AS DOUBLE) AS x, round(CAST({p} AS DOUBLE), 9) AS y FROM valid{' WHERE rater_id IS NOT NULL' if keys else ''}" for p in predictors)


def _distribution_sql(keys: str) -> str:
    k = f"{keys}, " if keys else ""
    where = " WHERE rater_id IS NOT NULL" if keys else ""
    return f"""WITH {_VALID}, ok AS (SELECT * FROM valid{where}), m AS ({_melt(keys=keys, source='ok')}),
        g AS (SELECT {k}score_variable, count(*) AS n FROM m GROUP BY {k}score_variable), l AS (SELECT unnest([1, 2, 3, 4, 5]) AS level),
        c AS (SELECT {k}score_variable, CAST(score AS INTEGER) AS level, count(*) AS c FROM m GROUP BY {k}score_variable, level)
        SELECT {k}score_variable, level AS score, CAST(coalesce(c, 0) AS BIGINT) AS "count", round(coalesce(c, 0) / n, 6) AS proportion
        FROM g CROSS JOIN l LEFT JOIN c USING ({k}score_variable, level)"""


def queries() -> dict:
    v, w, raw = valid, ratings, raw_two_rater
    return {
        "rater_essay_wide": lambda s, d: reshape.create_wide(raw(s, d)).drop("Text").withColumns({c: rounded(F.col(c)) for c in ("trait_mean", "trait_std")}),
        "rater_trait_long": lambda s, d: reshape.trait_long(raw(s, d)),
        "essay_rater_long": lambda s, d: reshape.essay_long(raw(s, d)),
        "inference_input": lambda s, d: reshape.inference_input(raw(s, d)),
        "conversion_summary": lambda s, d: reshape.conversion_summary(w(s, d), raw(s, d)),
        "conversion_violations": lambda s, d: reshape.conversion_violations(raw(s, d), reshape.create_wide(raw(s, d))),
        # The delivered table itself, with its repeated rows, spellings and gaps, held against the raw form: counts that aren't 0.
        "conversion_violations_delivered": lambda s, d: reshape.conversion_violations(raw(s, d), w(s, d)),
        "rater_position_counts": lambda s, d: reshape.position_counts(w(s, d)),
        "dataset_summary": lambda s, d: descriptive.dataset_summary(w(s, d)),
        "rater_sample_counts": lambda s, d: descriptive.rater_sample_counts(w(s, d)),
        "score_descriptive": lambda s, d: descriptive.score_descriptive(v(s, d)),
        "score_distribution": lambda s, d: descriptive.score_distribution(v(s, d)),
        "rater_descriptive": lambda s, d: descriptive.rater_descriptive(v(s, d)),
        "rater_distribution": lambda s, d: descriptive.rater_distribution(v(s, d)),
        "rater_trait_profile": lambda s, d: descriptive.rater_trait_profile(v(s, d)).withColumn("mean", rounded(F.col("mean"))),
        "rater_trait_relative": lambda s, d: descriptive.rater_trait_relative(v(s, d)),
        "rater_gap": lambda s, d: descriptive.rater_gap(v(s, d)),
        "overall_trait_mean_groups": lambda s, d: descriptive.overall_trait_mean_groups(v(s, d)),
        "usage_share": lambda s, d: descriptive.usage_share(v(s, d)),
        "bubble_counts": lambda s, d: descriptive.bubble_counts(v(s, d)),
        "usage_matrix": lambda s, d: descriptive.usage_matrix(v(s, d)).withColumnsRenamed({str(k): f"share_{k}" for k in LEVELS}),
        "profile_matrix": lambda s, d: descriptive.profile_matrix(v(s, d)),
        "topk_raters": lambda s, d: descriptive.extremes(descriptive.rater_descriptive(v(s, d)).where(F.col("score_variable") == OVERALL), "mean", "rater_id"),
        "topk_gaps": lambda s, d: descriptive.extremes(descriptive.rater_gap(v(s, d)), "mean", "rater_id"),
        "strongest_tendencies": lambda s, d: descriptive.strongest_tendencies(descriptive.rater_trait_relative(v(s, d))).select("rater_id", "trait", "relative_trait_tendency"),
        "text_features": lambda s, d: descriptive.text_features(table(s, d, "documents"), ["doc_id"], "text"),
        "rater_text_summary": lambda s, d: descriptive.rater_text_summary(v(s, d)),
        "overall_correlations": lambda s, d: correlation.overall_correlations(v(s, d)),
        "rater_correlations": lambda s, d: correlation.rater_correlations(v(s, d)),
        "corr_range_widest": lambda s, d: correlation.correlation_ranges(correlation.rater_correlations(v(s, d))),
        "trait_mean_relation": lambda s, d: profiles.trait_mean_relation(v(s, d)),
        "trait_mean_metrics": lambda s, d: profiles.trait_mean_metrics(v(s, d)),
        "same_profile_diff_overall": lambda s, d: profiles.same_profile_different_overall(v(s, d)),
        "agreement_by_trait": lambda s, d: agreement.agreement_metrics(_pairs(s, d), ["trait"]),
        "lineitem_descriptive": _lineitem_descriptive,
        "lineitem_correlations": _lineitem_correlations,
    }


def _pairs(s: SparkSession, d: str) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(t).alias("trait"), F.col(f"{t}_1").alias("a"), F.col(f"{t}_2").alias("b")) for t in SCORES))
    return raw_two_rater(s, d).select(F.inline(rows))


def _lineitem(s: SparkSession, d: str) -> DataFrame:
    """A scale variant: suppliers as raters, whole-number scores from the line's keys."""
    return table(s, d, "lineitem").select(F.col("l_suppkey").alias("rater_id"), (1 + (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 5).cast("double").alias("x"), (1 + (F.col("l_orderkey") * 11 + F.col("l_partkey")) % 5).cast("double").alias("y"))


def _lineitem_descriptive(s: SparkSession, d: str) -> DataFrame:
    return _lineitem(s, d).groupBy("rater_id").agg(F.count("x").alias("count"), rounded(F.avg("x")).alias("mean"), rounded(F.median("x")).alias("median"), rounded(F.stddev_samp("x")).alias("std"))


def _lineitem_correlations(s: SparkSession, d: str) -> DataFrame:
    return correlation.correlations(_lineitem(s, d), ["rater_id"])


def oracle_sql() -> dict[str, str]:
    flags = {p: {"o": f"coalesce(Overall_{p} IN (1, 2, 3, 4, 5), false)", "t": " AND ".join(f"coalesce({t}_{p} IN (1, 2, 3, 4, 5), false)" for t in TRAITS)} for p in POSITIONS}
    wide = []
    for p in POSITIONS:
        ts = [f"{t}_{p}" for t in TRAITS]
        mean = f"(({' + '.join(ts)}) / 6.0)"
        none = " OR ".join(f"{t} IS NULL" for t in ts)
        wide.append(
            f"SELECT source_row_id, Filename, text_id_kaggle, {p} AS rater_position, {_TRIM.format(f'Rater_{p}')} AS rater_id, {', '.join(f'{s}_{p} AS {s}' for s in SIDE_SCORES)}, NOT ({flags[p]['o']}) AS has_invalid_overall, NOT ({flags[p]['t']}) AS has_invalid_trait, "
            f"NOT ({flags[p]['o']}) OR NOT ({flags[p]['t']}) AS has_any_invalid_score, round({mean}, 6) AS trait_mean, CASE WHEN NOT ({none}) THEN least({', '.join(ts)}) END AS trait_min, CASE WHEN NOT ({none}) THEN greatest({', '.join(ts)}) END AS trait_max, "
            f"round(sqrt(({' + '.join(f'({t} - {mean}) ** 2' for t in ts)}) / 6.0), 6) AS trait_std FROM raw"
        )
    long = " UNION ALL ".join(f"SELECT Filename, text_id_kaggle, {p} AS rater_position, {_TRIM.format(f'Rater_{p}')} AS rater_id, '{s}' AS trait, {s}_{p} AS score, {_TRIM.format(f'Rater_{3 - p}')} AS partner_rater_id, {s}_{3 - p} AS partner_score FROM raw" for p in POSITIONS for s in SCORES)
    essay = " UNION ALL ".join(f"SELECT Filename, text_id_kaggle, {p} AS rater_position, {_TRIM.format(f'Rater_{p}')} AS rater_id, {_TRIM.format(f'Rater_{3 - p}')} AS partner_rater_id, {', '.join(f'{s}_{p} AS {s}' for s in SCORES)} FROM raw" for p in POSITIONS)
    ok = " AND ".join(f"coalesce({s} IN (1, 2, 3, 4, 5), false)" for s in SCORES)
    ok_t = " AND ".join(f"coalesce({s} IN (1, 2, 3, 4, 5), false)" for s in TRAITS)
    ok_o = "coalesce(Overall IN (1, 2, 3, 4, 5), false)"
    metric = lambda rows, kind, source: " UNION ALL ".join(f"SELECT '{k}' AS metric, CAST(({x}) AS {kind}) AS value{' FROM ' + source if source else ''}" for k, x in rows.items())
    dup = lambda a: f"SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM rater_essay_wide GROUP BY {a}) WHERE n > 1"
    conversion = {
        "wide_row_count": "count(*)", "unique_filename_count": "count(DISTINCT Filename)", "unique_rater_count": "count(DISTINCT rater_id)", "valid_overall_count": f"count(*) FILTER (WHERE {ok_o})", "valid_trait_profile_count": f"count(*) FILTER (WHERE {ok_t})",
        "invalid_overall_count": f"count(*) FILTER (WHERE NOT {ok_o})", "invalid_trait_profile_count": f"count(*) FILTER (WHERE NOT ({ok_t}))", "any_invalid_score_count": "count(*) FILTER (WHERE has_any_invalid_score)",
        **{f"rater_position_{p}_count": f"count(*) FILTER (WHERE rater_position = {p})" for p in POSITIONS},
    }
    conversion_more = {"raw_row_count": "SELECT count(*) FROM raw", "duplicate_filename_position_rows": dup("Filename, rater_position"), "duplicate_source_row_position_rows": dup("source_row_id, rater_position")}
    counts = f"SELECT rater_id, count(*) AS total_sample_count, count(DISTINCT source_row_id) AS total_unique_essay_count, count(*) FILTER (WHERE {ok}) AS valid_sample_count, count(DISTINCT source_row_id) FILTER (WHERE {ok}) AS valid_unique_essay_count, count(*) FILTER (WHERE NOT ({ok})) AS excluded_sample_count FROM rater_essay_wide GROUP BY rater_id"
    facts = {
        "total_sample_count": "count(*)", "valid_sample_count": f"count(*) FILTER (WHERE {ok})", "excluded_sample_count": f"count(*) FILTER (WHERE NOT ({ok}))", "invalid_overall_sample_count": f"count(*) FILTER (WHERE NOT {ok_o})", "invalid_trait_profile_sample_count": f"count(*) FILTER (WHERE NOT ({ok_t}))",
        "missing_required_score_sample_count": f"count(*) FILTER (WHERE {' OR '.join(f'{s} IS NULL' for s in SCORES)})", "total_unique_source_essay_count": "count(DISTINCT source_row_id)", "valid_unique_source_essay_count": f"count(DISTINCT source_row_id) FILTER (WHERE {ok})",
        "total_unique_filename_count": "count(DISTINCT Filename)", "valid_unique_filename_count": f"count(DISTINCT Filename) FILTER (WHERE {ok})", "unique_rater_count": "count(DISTINCT rater_id)",
    }
    as_double = "replace(CAST(round(CAST({} AS DOUBLE), 6) AS VARCHAR), '.0000', '.0')"
    more_facts = {
        "rater_ids": r"string_agg(rater_id, '|' ORDER BY regexp_extract(rater_id, '^(.*?)(\d*)$', 1), coalesce(try_cast(nullif(regexp_extract(rater_id, '^(.*?)(\d*)$', 2), '') AS BIGINT), -1), rater_id)",
        "valid_samples_per_rater_min": "min(valid_sample_count)", "valid_samples_per_rater_median": as_double.format("median(valid_sample_count)"), "valid_samples_per_rater_mean": as_double.format("avg(valid_sample_count)"), "valid_samples_per_rater_max": "max(valid_sample_count)",
    }
    relative = f"""profile AS (SELECT rater_id, trait, count(score) AS n, avg(score) AS mean FROM ({_melt(TRAITS, 'rater_id', 'valid', 'trait')}) WHERE rater_id IS NOT NULL GROUP BY rater_id, trait),
        relative AS (SELECT rater_id, trait, n, mean, avg(mean) OVER (PARTITION BY rater_id) AS centre FROM profile)"""
    overall_mean = "om AS (SELECT rater_id, round(avg(Overall), 6) AS mean FROM valid WHERE rater_id IS NOT NULL GROUP BY rater_id)"
    gap_mean = "om AS (SELECT rater_id, round(avg(Overall - trait_mean), 6) AS mean FROM valid WHERE rater_id IS NOT NULL GROUP BY rater_id)"
    both_ends = "SELECT * FROM (SELECT 'low' AS side, rater_id, mean FROM om WHERE mean IS NOT NULL ORDER BY mean, rater_id LIMIT 3) UNION ALL SELECT * FROM (SELECT 'high' AS side, rater_id, mean FROM om WHERE mean IS NOT NULL ORDER BY mean DESC, rater_id LIMIT 3)"
    gap_stats = "count({0}) AS \"count\", round(avg({0}), 6) AS mean, round(median({0}), 6) AS median, round(stddev_samp({0}), 6) AS std, round(min({0}), 6) AS min, round(max({0}), 6) AS max"
    half = "CAST(floor(trait_sum / 6.0 + 0.5) AS INTEGER)"
    rel_base = f"t AS (SELECT *, {_SUM} AS trait_sum FROM valid), d AS (SELECT trait_sum FROM t GROUP BY trait_sum HAVING count(DISTINCT Overall) > 1)"
    groups = f"SELECT {', '.join(TRAITS)}, count(Overall) AS sample_count, count(DISTINCT Overall) AS unique_overall_count, string_agg(DISTINCT CAST(CAST(Overall AS INTEGER) AS VARCHAR), '|' ORDER BY CAST(CAST(Overall AS INTEGER) AS VARCHAR)) AS overall_values, count(DISTINCT rater_id) AS rater_count, count(DISTINCT source_row_id) AS essay_count FROM valid GROUP BY {', '.join(TRAITS)} HAVING count(DISTINCT Overall) > 1"
    mean_corr = _corr_sql(f"SELECT Overall AS x, CAST({_SUM} AS DOUBLE) AS y FROM valid", "", "").strip()
    word = r"[\p{L}\p{N}_]([\p{L}\p{N}_'']*[\p{L}\p{N}_])?"
    text = lambda c: f"length(coalesce({c}, '')) AS character_count, len(regexp_extract_all(coalesce({c}, ''), '{word}')) AS word_count, CASE WHEN len(regexp_extract_all(coalesce({c}, ''), '[.!?]+')) = 0 AND regexp_matches(coalesce({c}, ''), '[^\\s\\p{{Z}}]') THEN 1 ELSE len(regexp_extract_all(coalesce({c}, ''), '[.!?]+')) END AS estimated_sentence_count"
    ab = " UNION ALL ".join(f"SELECT '{t}' AS trait, {t}_1 AS a, {t}_2 AS b FROM raw" for t in SCORES)
    line = "line AS (SELECT l_suppkey AS rater_id, CAST(1 + (l_orderkey * 7 + l_linenumber) % 5 AS DOUBLE) AS x, CAST(1 + (l_orderkey * 11 + l_partkey) % 5 AS DOUBLE) AS y FROM lineitem)"
    rater_corr = _corr_sql(_predictor_pairs("rater_id", (*TRAITS, "trait_mean")), "rater_id, predictor", f"WITH {_VALID},")
    return {
        "rater_essay_wide": f"WITH {_RAW} {' UNION ALL '.join(wide)}",
        "rater_trait_long": f"WITH {_RAW} {long}",
        "essay_rater_long": f"WITH {_RAW} {essay}",
        "inference_input": f"WITH {_RAW} SELECT text_id_kaggle AS inference_id, Filename, {', '.join(f'{s}_{p}' for p in POSITIONS for s in SCORES)} FROM raw",
        "conversion_summary": f"WITH {_RAW} {metric(conversion, 'BIGINT', 'rater_essay_wide')} UNION ALL {metric(conversion_more, 'BIGINT', '')}",
        "conversion_violations": "SELECT unnest(['row_count', 'unique_key', 'positions', 'filename_position_rows', 'values']) AS \"check\", CAST(0 AS BIGINT) AS violations",
        "conversion_violations_delivered": f"""WITH {_RAW}, want AS ({' UNION ALL '.join(f"SELECT source_row_id, {p} AS rater_position, Filename, text_id_kaggle, Text, {_TRIM.format(f'Rater_{p}')} AS rater_id, {', '.join(f'{x}_{p} AS {x}' for x in SIDE_SCORES)} FROM raw" for p in POSITIONS)})
            SELECT 'row_count' AS "check", abs(2 * (SELECT count(*) FROM raw) - (SELECT count(*) FROM rater_essay_wide)) AS violations
            UNION ALL SELECT 'unique_key', count(*) FROM (SELECT 1 FROM rater_essay_wide GROUP BY source_row_id, rater_position HAVING count(*) > 1)
            UNION ALL SELECT 'positions', count(*) FROM rater_essay_wide WHERE rater_position IS NULL OR rater_position NOT IN (1, 2)
            UNION ALL SELECT 'filename_position_rows', count(*) FROM (SELECT Filename, rater_position, count(*) AS n FROM want GROUP BY 1, 2) a FULL JOIN (SELECT Filename, rater_position, count(*) AS n FROM rater_essay_wide GROUP BY 1, 2) b
                ON a.Filename IS NOT DISTINCT FROM b.Filename AND a.rater_position = b.rater_position WHERE a.n IS DISTINCT FROM b.n
            UNION ALL SELECT 'values', count(*) FROM want a FULL JOIN rater_essay_wide b ON a.source_row_id = b.source_row_id AND a.rater_position = b.rater_position
                WHERE a.rater_position IS NULL OR b.rater_position IS NULL OR {' OR '.join(f'a.{c} IS DISTINCT FROM b.{c}' for c in ('Filename', 'text_id_kaggle', 'Text', 'rater_id', *SIDE_SCORES))}""",
        "rater_position_counts": "SELECT rater_id, count(*) AS sample_count, " + ", ".join(f"count(*) FILTER (WHERE rater_position = {p}) AS position_{p}_count" for p in POSITIONS) + " FROM rater_essay_wide GROUP BY rater_id",
        "dataset_summary": f"WITH c AS ({counts}) {metric(facts, 'VARCHAR', 'rater_essay_wide')} UNION ALL {metric(more_facts, 'VARCHAR', 'c')}",
        "rater_sample_counts": counts,
        "score_descriptive": f"WITH {_VALID} SELECT score_variable, {_STATS.format('score', '', '')} FROM ({_melt()}) GROUP BY score_variable",
        "score_distribution": _distribution_sql(""),
        "rater_descriptive": f"WITH {_VALID} SELECT rater_id, score_variable, {_STATS.format('score', '', '')} FROM ({_melt(keys='rater_id')}) WHERE rater_id IS NOT NULL GROUP BY rater_id, score_variable",
        "rater_distribution": _distribution_sql("rater_id"),
        "rater_trait_profile": f"WITH {_VALID}, {relative} SELECT rater_id, trait, n AS \"count\", round(mean, 6) AS mean FROM profile",
        "rater_trait_relative": f"WITH {_VALID}, {relative} SELECT rater_id, trait, n AS \"count\", round(mean, 6) AS mean, round(centre, 6) AS rater_six_trait_mean, round(mean - centre, 6) AS relative_trait_tendency FROM relative",
        "rater_gap": f"WITH {_VALID} SELECT rater_id, {gap_stats.format('(Overall - trait_mean)')} FROM valid WHERE rater_id IS NOT NULL GROUP BY rater_id",
        "overall_trait_mean_groups": f"WITH {_VALID} SELECT Overall, {gap_stats.format('trait_mean')} FROM valid GROUP BY Overall",
        "usage_share": f"WITH {_VALID} SELECT rater_id, {', '.join(f'round(count(*) FILTER (WHERE Overall = {k}) / count(*), 6) AS share_{k}' for k in LEVELS)}, round(count(*) FILTER (WHERE Overall = 3) / count(*), 6) AS middle_share, round(count(*) FILTER (WHERE Overall IN (1, 5)) / count(*), 6) AS extreme_share FROM valid WHERE rater_id IS NOT NULL GROUP BY rater_id",
        "bubble_counts": f"WITH {_VALID} SELECT round(trait_mean, 6) AS trait_mean, Overall, count(*) AS \"count\" FROM valid GROUP BY round(trait_mean, 6), Overall",
        "usage_matrix": f"WITH {_VALID} SELECT rater_id, {', '.join(f'round(count(*) FILTER (WHERE Overall = {k}) / count(*), 6) AS share_{k}' for k in LEVELS)} FROM valid WHERE rater_id IS NOT NULL GROUP BY rater_id",
        "profile_matrix": f"WITH {_VALID} SELECT rater_id, {', '.join(f'round(avg({t}), 6) AS {t}' for t in TRAITS)} FROM valid WHERE rater_id IS NOT NULL GROUP BY rater_id",
        "topk_raters": f"WITH {_VALID}, {overall_mean} {both_ends}",
        "topk_gaps": f"WITH {_VALID}, {gap_mean} {both_ends}",
        "strongest_tendencies": f"WITH {_VALID}, {relative} SELECT rater_id, trait, round(mean - centre, 6) AS relative_trait_tendency FROM relative ORDER BY abs(round(mean - centre, 6)) DESC, rater_id, trait LIMIT 8",
        "text_features": f"SELECT doc_id, {text('text')} FROM documents",
        "rater_text_summary": f"WITH {_VALID}, f AS (SELECT rater_id, {text('Text')} FROM valid WHERE rater_id IS NOT NULL) SELECT rater_id, count(word_count) AS sample_count, round(avg(character_count), 6) AS mean_character_count, round(avg(word_count), 6) AS mean_word_count, round(median(word_count), 6) AS median_word_count, round(stddev_samp(word_count), 6) AS std_word_count, round(avg(estimated_sentence_count), 6) AS mean_estimated_sentence_count FROM f GROUP BY rater_id",
        "overall_correlations": _corr_sql(_predictor_pairs("", correlation.PREDICTORS), "predictor", f"WITH {_VALID},"),
        "rater_correlations": rater_corr,
        "corr_range_widest": f"SELECT predictor, min(pearson_correlation) AS min, max(pearson_correlation) AS max, round(stddev_samp(pearson_correlation), 6) AS std, round(max(pearson_correlation) - min(pearson_correlation), 6) AS \"range\" FROM ({rater_corr}) GROUP BY predictor",
        "trait_mean_relation": f"WITH {_VALID}, {rel_base} SELECT source_row_id, Filename, text_id_kaggle, rater_id, Overall, {', '.join(TRAITS)}, round(trait_sum / 6.0, 6) AS trait_mean, round(Overall - trait_sum / 6.0, 6) AS overall_minus_trait_mean, round(abs(Overall - trait_sum / 6.0), 6) AS absolute_overall_minus_trait_mean, {half} AS rounded_trait_mean_half_up, {half} = Overall AS rounded_trait_mean_matches_overall, trait_sum IN (SELECT trait_sum FROM d) AS same_trait_mean_has_different_overall FROM t",
        "trait_mean_metrics": f"WITH {_VALID}, {rel_base}, g AS ({groups}), c AS (WITH {mean_corr}) "
        + metric({
            "trait_mean_validation_max_error": "round(max(abs(trait_sum / 6.0 - trait_mean)), 6)", "mean_overall_minus_trait_mean": "round(avg(Overall - trait_sum / 6.0), 6)", "median_overall_minus_trait_mean": "round(median(Overall - trait_sum / 6.0), 6)",
            "mean_absolute_overall_minus_trait_mean": "round(avg(abs(Overall - trait_sum / 6.0)), 6)", "rounded_trait_mean_agreement_rate": f"round(avg(CASE WHEN {half} = Overall THEN 1.0 ELSE 0.0 END), 6)",
            "same_trait_mean_different_overall_sample_count": "count(*) FILTER (WHERE trait_sum IN (SELECT trait_sum FROM d))",
        }, "DOUBLE", "t") + " UNION ALL " + metric({"same_trait_mean_different_overall_mean_value_count": "count(*)"}, "DOUBLE", "d") + " UNION ALL " + metric({"pearson_overall_trait_mean": "pearson_correlation", "spearman_overall_trait_mean": "spearman_correlation"}, "DOUBLE", "c")
        + " UNION ALL " + metric({"same_profile_different_overall_group_count": "count(*)", "same_profile_different_overall_sample_count": "coalesce(sum(sample_count), 0)"}, "DOUBLE", "g"),
        "same_profile_diff_overall": f"WITH {_VALID} {groups}",
        "agreement_by_trait": f"""WITH {_RAW}, ab AS (SELECT * FROM ({ab}) WHERE a IS NOT NULL AND b IS NOT NULL), corr AS (WITH {_corr_sql("SELECT trait, a AS x, b AS y FROM ab", "trait", "").strip()}),
            cat AS (SELECT trait, a, b, CAST(round(2 * a) AS INTEGER) AS i, CAST(round(2 * b) AS INTEGER) AS j FROM ab),
            place AS (SELECT trait, c, row_number() OVER (PARTITION BY trait ORDER BY c) AS p FROM (SELECT trait, i AS c FROM cat UNION SELECT trait, j FROM cat)),
            o AS (SELECT cat.trait, x.p AS p, y.p AS q FROM cat JOIN place x ON x.trait = cat.trait AND x.c = i JOIN place y ON y.trait = cat.trait AND y.c = j),
            n AS (SELECT trait, count(*) AS n, count(*) FILTER (WHERE p = q) AS same, sum((p - q) ** 2) AS wo FROM o GROUP BY trait),
            r AS (SELECT trait, p, count(*) AS r FROM o GROUP BY trait, p), c AS (SELECT trait, q, count(*) AS c FROM o GROUP BY trait, q),
            e AS (SELECT r.trait, sum(r * c) FILTER (WHERE p = q) AS e, sum(r * c * (p - q) ** 2) AS we FROM r JOIN c USING (trait) GROUP BY r.trait)
            SELECT ab.trait, count(*) AS paired_count, round(avg(CAST(a = b AS INTEGER)), 6) AS exact_agreement_rate, round(avg(CAST(abs(a - b) <= 1 AS INTEGER)), 6) AS within_one_point_rate, round(avg(CAST(abs(a - b) = 1 AS INTEGER)), 6) AS one_point_difference_rate,
                round(avg(CAST(abs(a - b) >= 2 AS INTEGER)), 6) AS two_or_more_point_rate, round(avg(a - b), 6) AS mean_signed_difference, round(avg(abs(a - b)), 6) AS mean_absolute_difference, round(sqrt(avg((a - b) ** 2)), 6) AS rmse,
                any_value(pearson_correlation) AS pearson_correlation, any_value(spearman_correlation) AS spearman_correlation, round(any_value((same / n.n - coalesce(e, 0) / n.n / n.n) / nullif(1 - coalesce(e, 0) / n.n / n.n, 0)), 6) AS cohen_kappa, round(1 - any_value(wo * n.n / nullif(we, 0)), 6) AS quadratic_weighted_kappa
            FROM ab JOIN corr USING (trait) JOIN n USING (trait) JOIN e USING (trait) GROUP BY ab.trait""",
        "lineitem_descriptive": f"WITH {line} SELECT rater_id, count(x) AS \"count\", round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(stddev_samp(x), 6) AS std FROM line GROUP BY rater_id",
        "lineitem_correlations": _corr_sql("SELECT * FROM line", "rater_id", f"WITH {line},"),
    }
