import pytest
from pyspark.sql import functions as F

from markweave.operators import experiments, history, pipeline, prompts
from markweave.schema import SCORES


def rows(spark, raters=(("r1", 7), ("r2", 2), ("r3", 30))):
    data = [(f"{r}{i}:1", r, *[float(1 + i % 5)] * 7, f"essay {i} {{history}}") for r, n in raters for i in range(n)]
    return spark.createDataFrame(data, "target_id string, rater_id string, " + ", ".join(f"{s} double" for s in SCORES) + ", Text string")


def test_histories_are_deterministic_nested_and_free_of_the_target(spark):
    df = rows(spark)
    h = history.sample_histories(df, 5, 7)
    a = sorted(map(tuple, h.collect()))
    assert a == sorted(map(tuple, history.sample_histories(df.repartition(16), 5, 7).collect()))
    assert {x[1] for x in a} == {"r1", "r3"} and len(a) == 37 * 5
    assert all(r.violations == 0 for r in history.history_violations(h, df).collect())
    small = sorted(map(tuple, history.sample_histories(df, 3, 7).collect()))
    assert small == [x for x in a if x[2] <= 3]
    assert a != sorted(map(tuple, history.sample_histories(df, 5, 8).collect()))
    full = history.sample_histories(df, 6, 7).where("rater_id = 'r1'").groupBy("target_id").agg(F.countDistinct("history_id").alias("n")).collect()
    assert len(full) == 7 and all(r.n == 6 for r in full)
    p = {(r.target_id, r.K): r.history_ids for r in history.history_prefixes(h, (1, 3, 5)).collect()}
    assert all(p[t, 3] == p[t, 5][:3] and p[t, 1] == p[t, 5][:1] for t, k in p if k == 5)


def test_draws_are_even_and_independent(spark):
    """Every other row is drawn about equally often, also given what else a target has drawn."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([StructField("target_id", StringType()), StructField("rater_id", StringType()), *(StructField(c, DoubleType()) for c in SCORES)])
    n = 400
    df = spark.createDataFrame([(f"{k}:1", "one", *[3.0] * len(SCORES)) for k in range(n)], schema)
    got = history.sample_histories(df, 3, 5).collect()
    lists = {}
    for r in sorted(got, key=lambda r: r.rn):
        lists.setdefault(r.target_id, []).append(r.history_id)
    assert len(lists) == n and all(len(set(x)) == 3 and t not in x for t, x in lists.items())
    times = {}
    for x in lists.values():
        for y in x:
            times[y] = times.get(y, 0) + 1
    assert len(times) > 0.9 * n and max(times.values()) < 15
    assert len({tuple(sorted(x)) for x in lists.values()}) == n  # no two targets share a history, as windows of one order would nearly


def test_target_samples(spark):
    df = rows(spark)
    a = history.sample_targets(df, 2, 7, 5).collect()
    assert a == history.sample_targets(df.repartition(7), 2, 7, 5).collect() and len(a) == 2 and {r.rater_id for r in a} <= {"r1", "r3"}
    assert {r.rater_id for r in history.sample_targets(df, 50, 7, 1, raters=["r2"]).collect()} == {"r2"}
    try:
        history.sample_targets(df, 1000, 7, 5, strict=True)
        raise AssertionError("too few targets went unnoticed")
    except ValueError:
        pass
    import hashlib

    t = df.limit(1).select("target_id", history.stable_seed(42, F.col("target_id")).alias("s")).first()
    assert int(t.s) == int.from_bytes(hashlib.sha256(f"42:{t.target_id}".encode()).digest()[:8], "big")


def test_prompts_keep_their_information_boundary(spark):
    df = rows(spark, (("r1", 4),))
    h = history.sample_histories(df, 2, 7)
    blocks = prompts.format_histories(h, df)
    target = df.where("target_id = 'r10:1'").select("target_id", "rater_id", "Text", F.lit(99).alias("gold"))
    text = {name: prompts.build_prompts(target, blocks, t, gold_overall=F.col("gold"), reference_reasoning=F.lit("because")).first().prompt for name, t in prompts.TEMPLATES.items()}
    assert "99" not in text["prediction"] and "99" in text["reference"] and "99" not in text["verification"] and "because" in text["verification"] and "because" not in text["prediction"]
    assert '{"predicted_overall": 3, "reasoning": "..."}' in text["prediction"] and "essay 0 {history}" in text["prediction"] and text["prediction"].count("[History ") == 2


def test_fit_drops_from_the_end(spark):
    lengths = spark.createDataFrame([("a", k, 100, 50) for k in (1, 2, 3)] + [("b", k, 10, 5000) for k in (1, 2)], "target_id string, rn int, block_length int, own int")
    fitted = prompts.fit_histories(lengths, F.col("own"), 70, 4.0)
    got = {r.target_id: (r.fitting_size, r.prompt_token_estimate) for r in fitted.collect()}
    assert got == {"a": (2, (50 + 207) // 4 + 1)}
    assert [r.target_id for r in prompts.unfit_targets(lengths.select("target_id").distinct(), fitted).collect()] == ["b"]


def stub():
    class Stub:
        """Answers badly once, then well; candidates are numbered."""

        def __init__(self):
            self.seen = set()

        def generate(self, prompts, parameters, n=1):
            out = []
            for p in prompts:
                if "never" in p or ("twice" in p and p not in self.seen):
                    self.seen.add(p)
                    out.append(["no json"] * n)
                else:
                    out.append([f'{{"predicted_overall": {1 + k % 5}, "reasoning": "because {"Overall 2" if k == 1 else "clear"}"}}' for k in range(n)])
            return out

    return Stub


def test_phases_with_a_stub(spark):
    Stub = stub()  # local, so that it is pickled with its code
    p = spark.createDataFrame([("1:1", "good"), ("2:1", "twice"), ("3:1", "never"), ("4:1", "long " * 100)], "target_id string, prompt string")
    got = {r.target_id: r for r in pipeline.predict(p, Stub, {}, max_retries=1, max_model_len=100, output_budget=20).collect()}
    assert got["1:1"].predicted_overall == 1 and got["1:1"].parse_attempts == 1
    assert got["2:1"].parse_attempts == 2 and got["2:1"].parse_error is None and len(got["2:1"].raw_model_output_attempts) == 2
    assert got["3:1"].predicted_overall is None and got["3:1"].parse_error == "ValueError: JSON object not found" and got["3:1"].parse_attempts == 2
    assert got["4:1"].parse_error == "context overflow"
    gold = spark.createDataFrame([("1:1", 2)], "target_id string, gold_overall int")
    c = pipeline.reference_candidates(pipeline.generate_answers(p.where("target_id = '1:1'"), Stub, {}, n=3), gold)
    rows_ = {r.candidate_id: r for r in c.collect()}
    assert rows_[1].parse_error is None and rows_[2].score_leak and rows_[2].reference_reasoning == "" and len(rows_) == 3
    tried = spark.createDataFrame([("1:1", 1, 2, None)], "target_id string, candidate_id int, reconstructed_overall int, verification_parse_error string")
    v = pipeline.verify_candidates(c, tried)
    s = pipeline.verification_summary(v).first()
    assert s.verified_total == 1 and s.candidate_total == 3 and s.targets_total == 1 and s.verification_pass_rate == round(1 / 3, 6)
    assert {r.candidate_id: r.verification_parse_error for r in v.collect()}[3] == "reference generation failed"
    assert pipeline.verification_summary(v.where("false")).first().verification_pass_rate == 0
    q = pipeline.reasoning_quality(spark.createDataFrame([("1:1", "r", "because clear"), ("9:1", "r", None)], "target_id string, rater_id string, reasoning string"), c.where("reference_reasoning <> ''")).collect()
    assert len(q) == 1 and q[0].rouge1_f1_max == 1 and q[0].num_verified_references == 2 and q[0].meteor_max is None


def test_experiment_tables(spark):
    rec = spark.createDataFrame([("a", "r", 3, 3, 1, True, 10, 1.0, True, 0), ("b", "r", 3, 1, 1, True, 20, 1.0, True, 0), ("a", "r", 3, 5, 3, True, 30, 2.0, True, 0), ("b", "r", 3, None, 3, False, 40, 2.0, False, 0)], "target_id string, rater_id string, gold_overall int, predicted_overall int, K int, parse_success boolean, prompt_tokens int, inference_time_seconds double, context_fit boolean, seed bigint")
    from markweave.functions.scores import error_columns

    rec = rec.withColumns(error_columns())
    s = {r.K: r for r in experiments.k_summary(rec).collect()}
    assert s[1].n == 2 and s[3].n == 1 and s[3].parse_errors == 1 and s[3].context_overflows == 1 and s[3].mean_prompt_tokens == 35
    p = experiments.k_paired(rec, (1, 3)).first()
    assert (p.improved_targets, p.worsened_targets, p.paired_targets, p.mean_ae_difference) == (0, 1, 1, -2.0)
    assert experiments.remaining_work(rec, rec.where("K = 1")).count() == 2
    t = spark.createDataFrame([(f"t{k}",) for k in range(5)], "target_id string")
    r = spark.createDataFrame([(0, "x"), (1, "y")], "reasoning_no bigint, reasoning string")
    assert [x.reasoning for x in experiments.assign_round_robin(t, r).orderBy("target_id").collect()] == ["x", "y", "x", "y", "x"]


def test_repeated_records_are_no_comparison(spark):
    from markweave.operators import experiments

    df = spark.createDataFrame([("a", 3, True, 1), ("a", 3, True, 2)], "target_id string, K int, parse_success boolean, absolute_error int")
    with pytest.raises(Exception, match="several records"):
        experiments.target_comparison(df, (3, 5)).collect()
    assert [tuple(r) for r in experiments.target_comparison(df.limit(1), (3, 5)).collect()] == [("a", 1, None)]
