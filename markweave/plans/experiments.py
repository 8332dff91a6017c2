"""Queries on histories, prompts, predictions and experiment settings, each with the SQL it can be held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markweave.functions import text as X
from markweave.functions.parsing import parse_prediction
from markweave.functions.scores import error_columns, rounded
from markweave.operators import agreement, experiments, history, pipeline, prompts
from markweave.schema import LEVELS, SCORES, TRAITS
from markweave.session import table

SEED, SIZES, HISTORY = 42, (1, 3, 5), 5
MAX_LENGTHS = (1024, 2048, 4096, 8192)
BUDGET, PER_TOKEN = 1500, 4.0
_GRID = (1, 3, 5, 7)


def rows(s: SparkSession, d: str, with_text: bool = False) -> DataFrame:
    return history.experiment_rows(table(s, d, "rater_essay_wide"), with_text)


def latest_predictions(s: SparkSession, d: str) -> DataFrame:
    """One prediction per target: the last delivered one."""
    cols = ("timestamp", "experiment_id", "rater_id", "gold_overall", "predicted_overall", "reasoning")
    return table(s, d, "phase1_predictions").groupBy("target_id").agg(F.max(F.struct(*cols)).alias("x")).select("target_id", "x.*")


def references(s: SparkSession, d: str) -> DataFrame:
    """Usable references: candidates without a parse error, each text of a target once."""
    return table(s, d, "reference_candidates_unverified").where("parse_error IS NULL AND reference_reasoning <> ''").select("target_id", "candidate_id", "reference_reasoning").distinct()


def k_records(s: SparkSession, d: str, seeds: tuple[int, ...] = (0,)) -> DataFrame:
    """Stub records over history sizes and seeds, by whole-number arithmetic on the targets of the predictions."""
    base = latest_predictions(s, d).select("target_id", "rater_id", "gold_overall", F.split("target_id", ":")[0].cast("bigint").alias("r"))
    grid = F.explode(F.array(*(F.struct(F.lit(k).alias("K"), F.lit(z).cast("long").alias("seed")) for k in _GRID for z in seeds))).alias("g")
    x = base.select("*", grid).select("target_id", "rater_id", "gold_overall", "r", "g.K", "g.seed")
    guess = F.greatest(F.lit(1), F.least(F.lit(5), (F.col("gold_overall") + (F.col("r") * 7 + F.col("K") * 3 + F.col("seed") * 5) % 3 - 1).cast("int")))
    ok = (F.col("r") + F.col("K") + F.col("seed")) % 17 != 0
    x = x.withColumn("parse_success", ok).withColumn("predicted_overall", F.when(ok, guess)).withColumn("prompt_tokens", (400 * F.col("K") + F.col("r") % 97).cast("int"))
    x = x.withColumn("inference_time_seconds", F.col("K") * 0.5 + (F.col("r") % 8) / F.lit(8.0)).withColumn("context_fit", F.col("prompt_tokens") <= 2850)
    return x.withColumns(error_columns()).drop("r")


def _history(s: SparkSession, d: str) -> DataFrame:
    return history.sample_histories(rows(s, d), HISTORY, SEED)


def _fit(s: SparkSession, d: str) -> DataFrame:
    r = rows(s, d, True)
    h = history.sample_histories(r.drop("Text"), HISTORY, SEED)
    block = prompts.history_block(F.col("rn"), F.col("history_id"), F.col("htext"), {k: F.col(k) for k in SCORES})
    lengths = h.join(r.select(F.col("target_id").alias("history_id"), F.col("Text").alias("htext"), *SCORES), "history_id").select("target_id", "rn", F.length(block).alias("block_length"))
    lengths = lengths.join(r.select("target_id", F.length(F.coalesce("Text", F.lit(""))).alias("own")), "target_id")
    return prompts.fit_histories(lengths, F.col("own") + 500, BUDGET, PER_TOKEN)


def _prompts(s: SparkSession, d: str) -> DataFrame:
    r = rows(s, d, True)
    chosen = history.eligible_targets(r.drop("Text"), HISTORY)
    h = history.sample_histories(r.drop("Text"), 3, SEED, chosen)
    built = prompts.build_prompts(r.join(chosen.select("target_id"), "target_id").select("target_id", "rater_id", "Text"), prompts.format_histories(h, r), prompts.TEMPLATES["prediction"])
    return built.select("target_id", "rater_id", F.length("prompt").alias("characters"), "prompt_token_estimate", F.sha2("prompt", 256).alias("digest"))


def _parsed(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "phase1_predictions").select("target_id", "timestamp", parse_prediction("raw_model_output").alias("p"))
    return t.select("target_id", "timestamp", "p.predicted_overall", F.col("p.error").alias("parse_error"))


def _parsed_references(s: SparkSession, d: str) -> DataFrame:
    """The candidates' answers parsed again; repeated ones once."""
    t = table(s, d, "reference_candidates_unverified").select("target_id", "candidate_id", "raw_model_output", "gold_overall").distinct()
    return pipeline.parse_candidates(t).select("target_id", "candidate_id", "reference_reasoning", "parse_error")


def _leaks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "reference_candidates_unverified").select("target_id", "candidate_id", X.leaks_score(F.col("reference_reasoning"), F.col("gold_overall")).alias("leak"))


def _rouge(s: SparkSession, d: str) -> DataFrame:
    q = pipeline.reasoning_quality(latest_predictions(s, d), references(s, d))
    return q.select("target_id", "rater_id", "rouge1_f1_max", "rouge1_f1_mean", "num_verified_references")


def _bleu(s: SparkSession, d: str) -> DataFrame:
    return pipeline.reasoning_quality(latest_predictions(s, d), references(s, d)).select("target_id", "rater_id", "bleu_max", "bleu_mean", "num_verified_references", "metric_note")


def _detail(s: SparkSession, d: str) -> DataFrame:
    quality = table(s, d, "reasoning_quality").dropDuplicates(["target_id", "rater_id"]).select("target_id", "rater_id", *pipeline.QUALITY)
    return pipeline.prediction_detail(latest_predictions(s, d), quality)


def _verification(s: SparkSession, d: str) -> DataFrame:
    """Stub reconstruction: right for five of seven source rows."""
    c = table(s, d, "reference_candidates_unverified").select("target_id", "candidate_id", "gold_overall", "parse_error").groupBy("target_id", "candidate_id").agg(F.max("gold_overall").alias("gold_overall"), F.max("parse_error").alias("parse_error"))
    r = F.split("target_id", ":")[0].cast("bigint")
    done = c.where("parse_error IS NULL").select("target_id", "candidate_id", F.when(r % 7 < 5, F.col("gold_overall")).otherwise(F.col("gold_overall") % 5 + 1).alias("reconstructed_overall"), F.lit(None).cast("string").alias("verification_parse_error"))
    return pipeline.verification_summary(pipeline.verify_candidates(c, done))


def _detail_context(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "context_detail")


def _context_violations(s: SparkSession, d: str) -> DataFrame:
    """Histories of the context table that hold their target, differ in size from ``k`` or name a row twice."""
    ids = F.split("history_ids", r"\|")
    return table(s, d, "context_detail").agg(F.count_if(F.array_contains(ids, F.col("target_id"))).alias("target_in_history"), F.count_if(F.size(ids) != F.col("k")).alias("wrong_size"), F.count_if(F.size(F.array_distinct(ids)) != F.size(ids)).alias("repeated"), F.count_if("target_in_history").alias("flagged"))


def _robin(s: SparkSession, d: str) -> DataFrame:
    return experiments.assign_round_robin(latest_predictions(s, d).select("target_id"), experiments.number_reasonings(references(s, d)))


def _delivered(s: SparkSession, d: str) -> DataFrame:
    """(``target_id``, ``rater_id``, ``history_id``) of every delivered prediction."""
    return table(s, d, "phase1_predictions").select("target_id", "rater_id", F.explode("history_ids").alias("history_id"))


def _resume(s: SparkSession, d: str) -> DataFrame:
    wanted = k_records(s, d, (1, 2)).select("seed", "K", "target_id")
    done = k_records(s, d, (1,)).where("K IN (3, 5) AND parse_success").select("seed", "K", "target_id")
    return experiments.remaining_work(wanted, done).groupBy("seed", "K").agg(F.count("*").alias("left"))


def queries() -> dict:
    seeds = (1, 2, 3)
    return {
        "sample_targets": lambda s, d: history.sample_targets(rows(s, d), 100, SEED, HISTORY),
        "eligible_targets": lambda s, d: history.eligible_targets(rows(s, d), HISTORY, 20).groupBy("rater_id").agg(F.count("*").alias("targets")),
        "stable_seed": lambda s, d: rows(s, d).select("target_id", history.stable_seed(SEED, F.col("target_id")).cast("string").alias("seed")),
        "history_sample": _history,
        "history_nested": lambda s, d: history.history_prefixes(_history(s, d), SIZES).select("target_id", "rater_id", "K", F.array_join("history_ids", "|").alias("history_ids")),
        # Histories as delivered, whose rows the ratings may lack or give to another spelling of the rater: counts that aren't 0.
        "history_violations_delivered": lambda s, d: history.history_violations(_delivered(s, d), rows(s, d)),
        "history_violations": lambda s, d: history.history_violations(_history(s, d), rows(s, d)),
        "fit_history": _fit,
        "prediction_prompts": _prompts,
        "parse_predictions": _parsed,
        "parse_references": _parsed_references,
        "leak_flags": _leaks,
        "rouge1": _rouge,
        "bleu4": _bleu,
        "prediction_metrics": lambda s, d: agreement.prediction_metrics(latest_predictions(s, d)),
        "prediction_detail": _detail,
        "quality_by_correctness": lambda s, d: pipeline.quality_by_correctness(_detail(s, d)),
        "quality_error_correlations": lambda s, d: pipeline.quality_error_correlations(_detail(s, d)),
        "verification_summary": _verification,
        "k_summary": lambda s, d: experiments.k_summary(k_records(s, d)),
        "k_paired": lambda s, d: experiments.k_paired(k_records(s, d), _GRID),
        "k_rater": lambda s, d: experiments.k_rater(k_records(s, d)),
        "k_target_comparison": lambda s, d: experiments.target_comparison(k_records(s, d), _GRID).withColumnsRenamed({str(k): f"k_{k}" for k in _GRID}),
        "seed_summary": lambda s, d: experiments.seed_summary(k_records(s, d, seeds)),
        "seed_paired": lambda s, d: experiments.seed_paired(k_records(s, d, seeds)),
        "seed_aggregate": lambda s, d: experiments.seed_aggregate(experiments.seed_summary(k_records(s, d, seeds))),
        "merged_runs": lambda s, d: experiments.merge_runs(k_records(s, d).drop("seed"), k_records(s, d, (1,)).where("K IN (3, 5)"), 7).groupBy("seed", "K", "reused_from_base_pilot").agg(F.count("*").alias("records")),
        "context_fit": lambda s, d: experiments.context_fit(_detail_context(s, d), MAX_LENGTHS),
        "context_violations": _context_violations,
        "round_robin": _robin,
        "resume_anti_join": _resume,
    }


# The SQL below restates the definitions independently: plain windows and self-joins where the operators avoid them.
_OK = " AND ".join(f"{s} IN (1, 2, 3, 4, 5)" for s in SCORES)
_ROWS = f"""base AS (SELECT CAST(source_row_id AS VARCHAR) || ':' || rater_position AS target_id, rater_id, {', '.join(SCORES)}, Text FROM rater_essay_wide WHERE rater_id IS NOT NULL AND {_OK}),
    r AS (SELECT target_id, rater_id, {', '.join(SCORES)} FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY rater_id, {', '.join(SCORES)}) AS k FROM base) WHERE k = 1),
    tx AS (SELECT target_id, min(Text) AS Text FROM base GROUP BY target_id)"""
_DRAW = f"sha256('{SEED}:' || target_id)"
_CHOSEN = f"chosen AS (SELECT * FROM r WHERE rater_id IN (SELECT rater_id FROM r GROUP BY rater_id HAVING count(*) - 1 >= {HISTORY}) ORDER BY {_DRAW}, target_id LIMIT {{}})"
_RING = f"""ring AS (SELECT target_id, rater_id, row_number() OVER (PARTITION BY rater_id ORDER BY {_DRAW}, target_id) - 1 AS place, count(*) OVER (PARTITION BY rater_id) AS size FROM r)"""


def _hist(size: int, of: str = "ring") -> str:
    """Draws one after the other, each from the list of the numbers that are left."""
    return f"""pick AS (SELECT target_id, rater_id, place, size, 0 AS k, CAST([] AS BIGINT[]) AS taken FROM {of} WHERE size - 1 >= {size}
        UNION ALL SELECT target_id, rater_id, place, size, k + 1, list_append(taken, list_filter(range(size - 1), lambda x: NOT list_contains(taken, x))[1 + CAST('0x' || substr(sha256('{SEED}:' || target_id || ':' || (k + 1)), 1, 12) AS BIGINT) % (size - 1 - k)])
        FROM pick WHERE k < {size}),
    hist AS (SELECT a.target_id, a.rater_id, CAST(a.k AS INTEGER) AS rn, b.target_id AS history_id FROM pick a JOIN ring b ON b.rater_id = a.rater_id AND b.place = (a.place + 1 + a.taken[a.k]) % a.size WHERE a.k > 0)"""


_LATEST = "latest AS (SELECT target_id, rater_id, gold_overall, predicted_overall, reasoning FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY timestamp DESC, experiment_id DESC, rater_id DESC, gold_overall DESC, predicted_overall DESC NULLS LAST, reasoning DESC NULLS LAST) AS k FROM phase1_predictions) WHERE k = 1)"
_REFS = "refs AS (SELECT DISTINCT target_id, candidate_id, reference_reasoning FROM reference_candidates_unverified WHERE parse_error IS NULL AND reference_reasoning <> '')"


def _records(seeds: tuple[int, ...]) -> str:
    return f"""{_LATEST}, stub AS (SELECT target_id, rater_id, gold_overall, CAST(split_part(target_id, ':', 1) AS BIGINT) AS r FROM latest),
        rec0 AS (SELECT *, (r + K + seed) % 17 <> 0 AS parse_success, CAST(400 * K + r % 97 AS INTEGER) AS prompt_tokens, K * 0.5 + (r % 8) / 8.0 AS secs FROM stub CROSS JOIN (SELECT unnest({list(_GRID)}) AS K) CROSS JOIN (SELECT CAST(unnest({list(seeds)}) AS BIGINT) AS seed)),
        rec AS (SELECT *, CASE WHEN parse_success THEN CAST(greatest(1, least(5, gold_overall + (r * 7 + K * 3 + seed * 5) % 3 - 1)) AS INTEGER) END AS p FROM rec0)"""


_QWK = "round(1 - sum(power(gold_overall - p, 2)) / nullif((count(p) * sum(power(gold_overall, 2)) FILTER (WHERE p IS NOT NULL) + count(p) * sum(power(p, 2)) - 2 * sum(gold_overall) FILTER (WHERE p IS NOT NULL) * sum(p)) / count(p), 0), 6)"
_ERRORS = "round(avg(CAST(gold_overall = p AS INTEGER)), 6) AS {0}, round(avg(abs(gold_overall - p)), 6) AS mae, round(sqrt(avg(power(gold_overall - p, 2))), 6) AS rmse, " + _QWK + " AS qwk"


def oracle_sql() -> dict[str, str]:
    seeds = (1, 2, 3)
    block = " || ".join(["'[History ' || rn || '; ID=' || history_id || ']' || chr(10) || 'Essay:' || chr(10) || coalesce(h.Text, '') || chr(10) || chr(10) || 'Overall: ' || CAST(hr.Overall AS INTEGER) || chr(10) || chr(10) || 'Trait Scores:' || chr(10)"] + [f"'{t}: ' || CAST(hr.{t} AS INTEGER)" + (" || chr(10)" if t != TRAITS[-1] else "") for t in TRAITS])
    template = prompts.TEMPLATES["prediction"]
    head, rest = template.replace("{{", "{").replace("}}", "}").split("{history}")
    middle = rest.split("{target_essay}")[0]
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    leak = " OR ".join(rf"(gold_overall = {s} AND regexp_matches(reference_reasoning, '(?i)((^|[^\p{{L}}\p{{N}}_]){s}($|[^\p{{L}}\p{{N}}_]))|({s}\s*点)|(score\s*[:=]?\s*{s})|(overall\s*[:=]?\s*{s})'))" for s in LEVELS)
    toks = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+')"
    detail = f"""{_LATEST}, q AS (SELECT DISTINCT target_id, rater_id, bleu_max, rouge1_f1_max, meteor_max, bertscore_f1_max FROM reasoning_quality),
        detail AS (SELECT l.target_id, l.rater_id, gold_overall, predicted_overall, gold_overall = predicted_overall AS exact_correct, abs(gold_overall - predicted_overall) AS absolute_error, power(gold_overall - predicted_overall, 2) AS squared_error, bleu_max, rouge1_f1_max, meteor_max, bertscore_f1_max
            FROM latest l LEFT JOIN q ON q.target_id = l.target_id AND q.rater_id = l.rater_id WHERE predicted_overall IS NOT NULL AND predicted_overall <> 0)"""
    metrics = " UNION ALL ".join(f"SELECT exact_correct, absolute_error, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM detail" for m in pipeline.QUALITY)
    delta = lambda a, b: f"SELECT {a} AS from_K, {b} AS to_K, x.e - y.e AS d FROM (SELECT DISTINCT target_id FROM ok) t LEFT JOIN (SELECT target_id, e FROM ok WHERE K = {a}) x USING (target_id) LEFT JOIN (SELECT target_id, e FROM ok WHERE K = {b}) y USING (target_id)"
    seed_sum = f"SELECT seed, K, count(*) AS n, {_ERRORS.format('accuracy')}, round(count(*) / 100.0, 6) AS parse_success_rate, round(avg(prompt_tokens), 6) AS mean_prompt_tokens, round(avg(secs), 6) AS mean_inference_time_seconds FROM rec WHERE parse_success GROUP BY seed, K"
    return {
        "sample_targets": f"WITH {_ROWS}, {_CHOSEN.format(100)} SELECT * FROM chosen",
        "eligible_targets": f"WITH {_ROWS} SELECT rater_id, count(*) AS targets FROM r GROUP BY rater_id HAVING count(*) >= 20 AND count(*) - 1 >= {HISTORY}",
        "stable_seed": f"WITH {_ROWS} SELECT target_id, CAST(CAST('0x' || substr({_DRAW}, 1, 16) AS UBIGINT) AS VARCHAR) AS seed FROM r",
        "history_sample": f"WITH RECURSIVE {_ROWS}, {_RING}, {_hist(HISTORY)} SELECT * FROM hist",
        "history_nested": f"WITH RECURSIVE {_ROWS}, {_RING}, {_hist(HISTORY)} SELECT target_id, rater_id, CAST(K AS INTEGER) AS K, string_agg(history_id, '|' ORDER BY rn) AS history_ids FROM hist CROSS JOIN (SELECT unnest({list(SIZES)}) AS K) WHERE rn <= K GROUP BY target_id, rater_id, K",
        "history_violations_delivered": f"""WITH {_ROWS}, h AS (SELECT target_id, rater_id, unnest(history_ids) AS history_id FROM phase1_predictions)
            SELECT 'target_in_history' AS "check", count(*) FILTER (WHERE target_id = history_id) AS violations FROM h
            UNION ALL SELECT 'other_rater', count(*) FILTER (WHERE h.rater_id IS DISTINCT FROM r.rater_id) FROM h LEFT JOIN r ON r.target_id = h.history_id
            UNION ALL SELECT 'repeated', count(*) FROM (SELECT 1 FROM h GROUP BY target_id, history_id HAVING count(*) > 1)""",
        "history_violations": "SELECT unnest(['target_in_history', 'other_rater', 'repeated']) AS \"check\", CAST(0 AS BIGINT) AS violations",
        "fit_history": f"""WITH RECURSIVE {_ROWS}, {_CHOSEN.format('ALL')}, {_RING}, own AS (SELECT * FROM ring WHERE target_id IN (SELECT target_id FROM chosen)), {_hist(HISTORY, 'own')},
            len0 AS (SELECT hist.target_id, rn, length({block}) AS n, length(coalesce(o.Text, '')) + 500 AS fixed FROM hist JOIN r hr ON hr.target_id = history_id JOIN tx h ON h.target_id = history_id JOIN tx o ON o.target_id = hist.target_id),
            est AS (SELECT target_id, rn AS k, CAST(floor((fixed + sum(n) OVER (PARTITION BY target_id ORDER BY rn) + (rn - 1) * 7) / 4.0) AS INTEGER) + 1 AS e FROM len0 UNION ALL SELECT DISTINCT target_id, 0, CAST(floor(fixed / 4.0) AS INTEGER) + 1 FROM len0)
            SELECT target_id, CAST(max(k) AS INTEGER) AS fitting_size, arg_max(e, k) AS prompt_token_estimate FROM est WHERE e <= {BUDGET} GROUP BY target_id""",
        "prediction_prompts": f"""WITH RECURSIVE {_ROWS}, {_CHOSEN.format('ALL')}, {_RING}, own AS (SELECT * FROM ring WHERE target_id IN (SELECT target_id FROM chosen)), {_hist(3, 'own')},
            blocks AS (SELECT hist.target_id, string_agg({block}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rn) AS b FROM hist JOIN r hr ON hr.target_id = history_id JOIN tx h ON h.target_id = history_id GROUP BY hist.target_id),
            p AS (SELECT target_id, rater_id, {quoted(head)} || b || {quoted(middle)} || coalesce(Text, '') AS prompt FROM chosen JOIN blocks USING (target_id) JOIN tx USING (target_id))
            SELECT target_id, rater_id, length(prompt) AS characters, CAST(floor(length(prompt) / 4.0) AS INTEGER) + 1 AS prompt_token_estimate, sha256(prompt) AS digest FROM p""",
        "parse_predictions": "SELECT target_id, timestamp, predicted_overall, parse_error FROM phase1_predictions",
        "parse_references": "SELECT target_id, candidate_id, any_value(reference_reasoning) AS reference_reasoning, any_value(parse_error) AS parse_error FROM reference_candidates_unverified GROUP BY target_id, candidate_id, raw_model_output, gold_overall",
        "leak_flags": f"SELECT target_id, candidate_id, coalesce({leak}, false) AS leak FROM reference_candidates_unverified",
        "rouge1": f"""WITH {_LATEST}, {_REFS}, pair AS (SELECT l.target_id, rater_id, candidate_id, reference_reasoning, {toks.format('reasoning')} AS h, {toks.format('reference_reasoning')} AS g FROM latest l JOIN refs USING (target_id) WHERE reasoning IS NOT NULL AND reasoning <> ''),
            th AS (SELECT target_id, candidate_id, reference_reasoning, t, count(*) AS n FROM (SELECT *, unnest(h) AS t FROM pair) GROUP BY ALL), tg AS (SELECT target_id, candidate_id, reference_reasoning, t, count(*) AS n FROM (SELECT *, unnest(g) AS t FROM pair) GROUP BY ALL),
            o AS (SELECT target_id, candidate_id, reference_reasoning, sum(least(th.n, tg.n)) AS o FROM th JOIN tg USING (target_id, candidate_id, reference_reasoning, t) GROUP BY ALL),
            f AS (SELECT target_id, rater_id, coalesce(2.0 * o / nullif(len(h) + len(g), 0), 0) AS f FROM pair LEFT JOIN o USING (target_id, candidate_id, reference_reasoning))
            SELECT target_id, rater_id, round(max(f), 6) AS rouge1_f1_max, round(avg(f), 6) AS rouge1_f1_mean, count(*) AS num_verified_references FROM f GROUP BY target_id, rater_id""",
        "bleu4": f"""WITH {_LATEST}, {_REFS}, pair AS (SELECT row_number() OVER () AS id, l.target_id, rater_id, {toks.format('reasoning')} AS h, {toks.format('reference_reasoning')} AS g FROM latest l JOIN refs USING (target_id) WHERE reasoning IS NOT NULL AND reasoning <> ''),
            gram AS (SELECT id, n, 'h' AS side, unnest(list_transform(range(1, len(h) - n + 2), lambda i: array_to_string(list_slice(h, i, i + n - 1), ' '))) AS t FROM pair CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS n)
                UNION ALL SELECT id, n, 'g', unnest(list_transform(range(1, len(g) - n + 2), lambda i: array_to_string(list_slice(g, i, i + n - 1), ' '))) FROM pair CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS n)),
            c AS (SELECT id, n, t, count(*) FILTER (WHERE side = 'h') AS a, count(*) FILTER (WHERE side = 'g') AS b FROM gram GROUP BY id, n, t), o AS (SELECT id, n, ln((sum(least(a, b)) + 1.0) / (sum(a) + 1.0)) AS l FROM c GROUP BY id, n),
            s AS (SELECT id, sum(l) / 4 AS l FROM o GROUP BY id),
            f AS (SELECT target_id, rater_id, CASE WHEN len(h) = 0 OR len(g) = 0 THEN 0.0 ELSE exp(l) * CASE WHEN len(h) > len(g) THEN 1.0 ELSE exp(1 - len(g) / len(h)) END END AS f FROM pair LEFT JOIN s USING (id))
            SELECT target_id, rater_id, round(max(f), 6) AS bleu_max, round(avg(f), 6) AS bleu_mean, count(*) AS num_verified_references, '{pipeline.NOTE}' AS metric_note FROM f GROUP BY target_id, rater_id""",
        "prediction_metrics": f"WITH {_LATEST}, x AS (SELECT gold_overall, predicted_overall AS p FROM latest WHERE predicted_overall IS NOT NULL) SELECT count(*) AS n, {_ERRORS.format('exact_accuracy')} FROM x",
        "prediction_detail": f"WITH {detail} SELECT target_id, rater_id, gold_overall, predicted_overall, exact_correct, absolute_error, CAST(squared_error AS INTEGER) AS squared_error, bleu_max, rouge1_f1_max, meteor_max, bertscore_f1_max FROM detail",
        "quality_by_correctness": f"WITH {detail} SELECT exact_correct, metric, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS std, count(value) AS \"count\" FROM ({metrics}) GROUP BY exact_correct, metric",
        "quality_error_correlations": f"""WITH {detail}, v AS (SELECT metric, value AS x, CAST(absolute_error AS DOUBLE) AS y FROM ({metrics})), k AS (SELECT metric, count(x) AS n FROM v GROUP BY metric),
            r AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY x) + (count(*) OVER (PARTITION BY metric, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY metric ORDER BY y) + (count(*) OVER (PARTITION BY metric, y) - 1) / 2.0 AS ry FROM v WHERE x IS NOT NULL AND y IS NOT NULL),
            m AS (SELECT metric, avg(rx) AS ax, avg(ry) AS ay FROM r GROUP BY metric), c AS (SELECT r.metric, sum((rx - ax) * (ry - ay)) / nullif(sqrt(sum((rx - ax) ** 2)) * sqrt(sum((ry - ay) ** 2)), 0) AS c FROM r JOIN m USING (metric) GROUP BY r.metric)
            SELECT metric, n AS "count", round(c, 6) AS spearman_with_absolute_error FROM k LEFT JOIN c USING (metric)""",
        "verification_summary": """WITH c AS (SELECT target_id, candidate_id, max(gold_overall) AS gold, max(parse_error) AS e FROM reference_candidates_unverified GROUP BY target_id, candidate_id),
            v AS (SELECT *, e IS NULL AND CAST(split_part(target_id, ':', 1) AS BIGINT) % 7 < 5 AS ok FROM c)
            SELECT count(DISTINCT target_id) AS targets_total, count(DISTINCT target_id) FILTER (WHERE ok) AS targets_with_verified_reference, count(DISTINCT target_id) - count(DISTINCT target_id) FILTER (WHERE ok) AS targets_without_verified_reference,
                count(*) AS candidate_total, count(*) FILTER (WHERE ok) AS verified_total, round(count(*) FILTER (WHERE ok) / count(*), 6) AS verification_pass_rate, round(count(*) FILTER (WHERE ok) / count(DISTINCT target_id), 6) AS mean_verified_references_per_target FROM v""",
        "k_summary": f"WITH {_records((0,))} SELECT K, count(*) FILTER (WHERE parse_success) AS n, {_ERRORS.format('exact_accuracy')}, round(count(*) FILTER (WHERE parse_success) / count(*), 6) AS parse_success_rate, round(avg(prompt_tokens), 6) AS mean_prompt_tokens, round(median(prompt_tokens), 6) AS median_prompt_tokens, round(quantile_cont(CAST(prompt_tokens AS DOUBLE), 0.9), 6) AS p90_prompt_tokens, round(avg(secs), 6) AS mean_inference_time_seconds, round(sum(secs), 6) AS total_inference_time_seconds, count(*) FILTER (WHERE NOT parse_success) AS parse_errors, count(*) FILTER (WHERE prompt_tokens > 2850) AS context_overflows FROM rec GROUP BY K HAVING n > 0",
        "k_paired": f"WITH {_records((0,))}, ok AS (SELECT target_id, K, abs(gold_overall - p) AS e FROM rec WHERE parse_success) SELECT CAST(from_K AS INTEGER) AS from_K, CAST(to_K AS INTEGER) AS to_K, count(*) FILTER (WHERE d > 0) AS improved_targets, count(*) FILTER (WHERE d = 0) AS unchanged_targets, count(*) FILTER (WHERE d < 0) AS worsened_targets, round(avg(d), 6) AS mean_ae_difference, round(median(d), 6) AS median_ae_difference, count(d) AS paired_targets FROM ({' UNION ALL '.join(delta(a, b) for a, b in zip(_GRID, _GRID[1:]))}) GROUP BY from_K, to_K",
        "k_rater": f"WITH {_records((0,))} SELECT K, rater_id, count(target_id) AS \"count\", round(avg(CAST(gold_overall = p AS INTEGER)), 6) AS accuracy, round(avg(abs(gold_overall - p)), 6) AS mae FROM rec WHERE parse_success AND rater_id IS NOT NULL GROUP BY K, rater_id",
        "k_target_comparison": f"WITH {_records((0,))} SELECT target_id, {', '.join(f'max(abs(gold_overall - p)) FILTER (WHERE K = {k}) AS k_{k}' for k in _GRID)} FROM rec WHERE parse_success GROUP BY target_id",
        "seed_summary": f"WITH {_records(seeds)} {seed_sum}",
        "seed_paired": f"WITH {_records(seeds)}, w AS (SELECT seed, target_id, max(abs(gold_overall - p)) FILTER (WHERE K = 5) - max(abs(gold_overall - p)) FILTER (WHERE K = 3) AS d FROM rec WHERE parse_success GROUP BY seed, target_id) SELECT seed, count(*) FILTER (WHERE d < 0) AS improved_k5, count(*) FILTER (WHERE d = 0) AS unchanged, count(*) FILTER (WHERE d > 0) AS worsened_k5, round(avg(d), 6) AS mean_delta_ae_k5_minus_k3, round(median(d), 6) AS median_delta_ae_k5_minus_k3, count(d) AS paired_targets FROM w GROUP BY seed",
        "seed_aggregate": f"WITH {_records(seeds)} SELECT K, {', '.join(f'round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std' for c in ('accuracy', 'mae', 'qwk'))}, round(avg(mean_prompt_tokens), 6) AS prompt_tokens_mean, round(avg(mean_inference_time_seconds), 6) AS inference_time_mean FROM ({seed_sum}) GROUP BY K",
        "merged_runs": f"WITH {_records((1,))} SELECT CAST(7 AS BIGINT) AS seed, K, true AS reused_from_base_pilot, count(*) AS records FROM rec WHERE K IN (3, 5) GROUP BY K UNION ALL SELECT seed, K, false, count(*) FROM rec WHERE K IN (3, 5) GROUP BY seed, K",
        "context_fit": "WITH g AS (SELECT * FROM context_detail CROSS JOIN (SELECT unnest(" + str(list(MAX_LENGTHS)) + ") AS max_model_len)) SELECT phase, k, CAST(max_model_len AS INTEGER) AS max_model_len, count(*) AS targets_total, count(*) FILTER (WHERE prompt_tokens + output_budget <= max_model_len) AS targets_fit, round(avg(CAST(prompt_tokens + output_budget <= max_model_len AS INTEGER)), 6) AS fit_rate, min(output_budget) AS output_budget, round(avg(prompt_tokens), 6) AS prompt_tokens_mean, round(quantile_cont(CAST(prompt_tokens AS DOUBLE), 0.5), 6) AS prompt_tokens_median, round(quantile_cont(CAST(prompt_tokens AS DOUBLE), 0.9), 6) AS prompt_tokens_p90, round(quantile_cont(CAST(prompt_tokens AS DOUBLE), 0.95), 6) AS prompt_tokens_p95, max(prompt_tokens) AS prompt_tokens_max FROM g GROUP BY phase, k, max_model_len",
        "context_violations": "WITH x AS (SELECT *, string_split(history_ids, '|') AS ids FROM context_detail) SELECT count(*) FILTER (WHERE list_contains(ids, target_id)) AS target_in_history, count(*) FILTER (WHERE len(ids) <> k) AS wrong_size, count(*) FILTER (WHERE len(list_distinct(ids)) <> len(ids)) AS repeated, count(*) FILTER (WHERE target_in_history) AS flagged FROM x",
        "round_robin": f"WITH {_LATEST}, {_REFS}, l AS (SELECT row_number() OVER (ORDER BY t, reference_reasoning) - 1 AS reasoning_no, reference_reasoning AS reasoning FROM (SELECT reference_reasoning, min(target_id) AS t FROM refs GROUP BY reference_reasoning)), p AS (SELECT target_id, (row_number() OVER (ORDER BY target_id) - 1) % (SELECT count(*) FROM l) AS reasoning_no FROM latest) SELECT target_id, reasoning_no, reasoning FROM p JOIN l USING (reasoning_no)",
        "resume_anti_join": f"WITH {_records((1, 2))} SELECT seed, K, count(*) AS \"left\" FROM rec WHERE NOT (seed = 1 AND K IN (3, 5) AND parse_success) GROUP BY seed, K",
    }


__all__ = ["queries", "oracle_sql", "rounded"]
