import math

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from markweave.functions.scores import all_valid
from markweave.operators import agreement, correlation, descriptive, profiles
from markweave.schema import SCORES, TRAITS

COLS = "source_row_id bigint, Filename string, text_id_kaggle string, Text string, rater_id string, " + ", ".join(f"{s} double" for s in SCORES) + ", trait_mean double, trait_min double, trait_max double, trait_std double"


def rows(spark, data):
    out = []
    for k, (rater, overall, trait) in enumerate(data):
        out.append((k // 2, f"f{k // 2}", None, "a b. c", rater, overall, *[trait] * 6, trait, trait, trait, 0.0))
    return spark.createDataFrame(out, COLS)


def test_valid_sample_and_profiles(spark):
    df = rows(spark, [("r1", 3.0, 3.0), ("r2", 4.0, 3.0), ("r1", 0.0, 2.0), ("r1", None, 2.0)])
    assert [r.ok for r in df.select(all_valid().alias("ok")).collect()] == [True, True, False, False]
    valid = descriptive.valid_samples(df)
    g = profiles.same_profile_different_overall(valid).collect()
    assert len(g) == 1 and g[0].sample_count == 2 and g[0].overall_values == "3|4"
    assert all(r.same_trait_mean_has_different_overall for r in profiles.trait_mean_relation(valid).collect())
    assert profiles.stored_mean_error(valid).first().max_error == 0


def test_null_and_constant_groups(spark):
    df = rows(spark, [("c", 3.0, 3.0), ("c", 3.0, 4.0), ("one", 2.0, 2.0), (None, 5.0, 5.0), ("bad", 0.0, 1.0)])
    valid = descriptive.valid_samples(df)
    r = {x.rater_id: x for x in descriptive.rater_descriptive(valid).where("score_variable = 'Overall'").collect()}
    assert set(r) == {"c", "one"} and r["one"].std is None and r["c"].std == 0
    c = {(x.rater_id, x.predictor): x for x in correlation.rater_correlations(valid).collect()}
    assert c["c", "Syntax"].pearson_correlation is None and c["one", "Syntax"].spearman_correlation is None and c["one", "Syntax"]["count"] == 1
    counts = {x.rater_id: (x.total_sample_count, x.valid_sample_count) for x in descriptive.rater_sample_counts(df).collect()}
    assert counts == {"c": (2, 2), "one": (1, 1), None: (1, 1), "bad": (1, 0)}
    order = [x.rater_id for x in descriptive.rater_sample_counts_ordered(rows(spark, [("r10", 1.0, 1.0), ("r2", 1.0, 1.0), ("r", 1.0, 1.0)])).collect()]
    assert order == ["r", "r2", "r10"]


def test_empty_tables(spark):
    e = rows(spark, [("a", 1.0, 1.0)]).where("false")
    assert descriptive.score_descriptive(e).count() == 0 and descriptive.rater_distribution(e).count() == 0
    assert {r.metric: r.value for r in descriptive.dataset_summary(e).collect()}["total_sample_count"] == "0"
    assert correlation.overall_correlations(e).count() == 0
    assert agreement.agreement_metrics(spark.createDataFrame([], "k string, a double, b double"), ["k"]).count() == 0
    assert profiles.trait_mean_metrics(e).count() == 11


pairs_ = st.lists(st.tuples(st.integers(1, 5), st.integers(1, 5)), min_size=2, max_size=30)


@settings(max_examples=8, deadline=None)
@given(pairs_)
def test_correlations_and_kappas_against_pandas(spark, data):
    pdf = pd.DataFrame(data, columns=["a", "b"], dtype=float)
    df = spark.createDataFrame(pdf).withColumn("k", F.lit("x"))
    got = agreement.agreement_metrics(df, ["k"]).first()
    constant = pdf.a.nunique() < 2 or pdf.b.nunique() < 2
    if constant:
        assert got.pearson_correlation is None and got.spearman_correlation is None
    else:
        assert math.isclose(got.pearson_correlation, pdf.a.corr(pdf.b), abs_tol=2e-6)
        assert math.isclose(got.spearman_correlation, pdf.a.rank().corr(pdf.b.rank()), abs_tol=2e-6)
    labels = sorted(set(pdf.a) | set(pdf.b))
    o = np.zeros((len(labels), len(labels)))
    for a, b in data:
        o[labels.index(a), labels.index(b)] += 1
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    w = np.subtract.outer(range(len(labels)), range(len(labels))) ** 2
    for name, weight in (("cohen_kappa", (w > 0).astype(int)), ("quadratic_weighted_kappa", w)):
        bottom = (weight * e).sum()
        want = None if bottom == 0 else 1 - (weight * o).sum() / bottom
        assert (got[name] is None) == (want is None) and (want is None or math.isclose(got[name], want, abs_tol=2e-6))
    assert got.paired_count == len(data) and math.isclose(got.exact_agreement_rate, (pdf.a == pdf.b).mean(), abs_tol=1e-6)


def test_prediction_metrics(spark):
    df = spark.createDataFrame([(g, 3) for g in (2, 3, 3, 4, 3, 2, 3, 4, 2, 4)] + [(5, None)], "gold_overall int, predicted_overall int")
    m = agreement.prediction_metrics(df).first()
    assert m.n == 10 and m.exact_accuracy == 0.4 and m.mae == 0.6 and math.isclose(m.rmse, 0.774597, abs_tol=1e-6) and m.qwk == 0
    same = agreement.prediction_metrics(spark.createDataFrame([(3, 3), (3, 3)], "gold_overall int, predicted_overall int")).first()
    assert same.qwk is None


def test_distribution_sums_to_one(spark):
    df = rows(spark, [("a", 1.0, 2.0), ("a", 5.0, 2.0), ("b", 2.0, 2.0)])
    d = descriptive.rater_distribution(descriptive.valid_samples(df)).groupBy("rater_id", "score_variable").agg(F.sum("proportion").alias("s"), F.count("*").alias("n")).collect()
    assert len(d) == 2 * len(SCORES) and all(x.s == 1 and x.n == 5 for x in d)
    t = descriptive.rater_trait_relative(descriptive.valid_samples(df)).collect()
    assert len(t) == 2 * len(TRAITS) and all(x.relative_trait_tendency == 0 for x in t)
