import random

from markweave.llm import consensus as C

SCHEMA = "source_row_id bigint, rater_position int, rater_id string, Filename string, Overall double, Cohesion double, item string"


def world(spark, n=400):
    r = random.Random(1)
    rows = []
    for k in range(n):
        quality = r.randint(1, 5)
        for p, rater in enumerate(r.sample(range(1, 11), 3), 1):
            if rater == 3:
                score = 6 - quality
            elif rater == 7:
                score = r.randint(1, 5)
            else:
                score = quality + r.choice((-1, 0, 0, 0, 1)) - (1 if rater == 5 else 0)
            rows.append((k, p, r.choice(("rater_{}", "Rater {}", " rater-0{}")).format(rater), f"essay_{k}", float(min(5, max(1, score))), None, "x"))
    return rows, spark.createDataFrame(rows + rows[:50], SCHEMA)


def test_reversed_and_random_raters_are_found(spark):
    _, df = world(spark)
    rated = C.ratings(df)
    a = C.accuracies(rated)
    assert {r.rater_no for r in C.unfaithful(a).collect()} == {3, 7}
    by = {r.rater_no: r for r in a.collect()}
    assert by[3].accuracy < -0.5 and abs(by[7].accuracy) < 0.25 and all(by[k].accuracy > 0.7 for k in (1, 2, 4, 5, 6))
    assert sum(r.n_ratings for r in by.values()) == 1200  # repeated rows count once


def test_constant_raters_are_cases_and_cautious_ones_are_not(spark):
    r = random.Random(2)
    rows = []
    for k in range(300):
        quality = r.randint(1, 5)
        for p, rater in enumerate(r.sample(range(1, 9), 2), 1):
            score = {1: 4, 2: 3 + (quality > 3) - (quality < 2)}.get(rater, quality + r.choice((-1, 0, 0, 1)))  # one always gives 4, one avoids the ends of the scale
            rows.append((k, p, f"rater_{rater}", f"essay_{k}", float(min(5, max(1, score))), None, "x"))
        if k < 25:
            rows.append((1000 + k, 1, "rater_20", f"alone_{k}", float(quality), None, "x"))  # shares no item: nothing is known
        if k < 15:
            rows.append((k, 3, "rater_21", f"essay_{k}", 2.0, None, "x"))  # too few ratings
    a = C.accuracies(C.ratings(spark.createDataFrame(rows, SCHEMA)))
    by = {x.rater_no: x for x in a.collect()}
    assert {x.rater_no for x in C.unfaithful(a).collect()} == {1}
    assert by[1].accuracy == 0 and by[2].accuracy > 0.6 and by[20].accuracy is None and by[21].accuracy == 0


def test_scale_of_noisy_annotators(spark):
    """True accuracy 0.6 throughout: the estimates centre there, whatever the number of passes."""
    r = random.Random(5)
    rows = []
    for k in range(4000):
        quality = r.gauss(0, 1)
        for p, rater in enumerate(r.sample(range(100), 3), 1):
            x = 0.6 * quality + 0.8 * r.gauss(0, 1)
            rows.append((k, p, f"rater_{rater}", f"essay_{k}", float(1 + sum(x > t for t in (-1.2, -0.4, 0.4, 1.2))), None, "x"))
    rated = C.ratings(spark.createDataFrame(rows, SCHEMA))
    for passes in (0, 2, 3):
        mean = C.accuracies(rated, passes).agg({"accuracy": "avg"}).first()[0]
        assert 0.5 < mean < 0.65


def test_one_item_with_a_third_of_all_rows(spark):
    """A hot item gives the accuracies that all pairs of its raters would give."""
    r = random.Random(8)
    rows = [(0, k, f"rater_{k}", "hot", float(r.randint(1, 5)), None, "x") for k in range(150)]
    rows += [(1 + k, p, f"rater_{j}", f"essay_{k}", float(r.randint(1, 5)), None, "x") for k in range(150) for p, j in enumerate(r.sample(range(150), 2))]
    rated = C.ratings(spark.createDataFrame(rows, SCHEMA))
    z = {}
    all_rated = rated.collect()
    for x in all_rated:
        z.setdefault(x.rater_no, {})[x.item] = x.score
    for k, own in z.items():
        mean = sum(own.values()) / len(own)
        sd = (sum((v - mean) ** 2 for v in own.values()) / len(own)) ** 0.5
        z[k] = {i: (v - mean) / sd for i, v in own.items()} if sd else {}
    for x in C.accuracies(rated).collect():
        products = [z[x.rater_no][i] * z[j][i] for j in z if j != x.rater_no for i in z[x.rater_no] if i in z[j]]
        assert (x.agreement is None and not products) or abs(x.agreement - sum(products) / len(products)) < 1e-9


def test_consensus_is_near_the_true_quality(spark):
    rows, df = world(spark)
    rated = C.ratings(df)
    got = C.consensus(rated, C.accuracies(rated), C.item_names(df)).collect()
    assert len(got) == 400 and all(1 <= r.consensus_score <= 5 and r.votes == 3 for r in got)
    r = random.Random(1)
    truth = {}
    for k in range(400):  # the same draws as in world()
        truth[f"essay_{k}"] = r.randint(1, 5)
        for rater in r.sample(range(1, 11), 3):
            if rater == 7:
                r.randint(1, 5)
            elif rater != 3:
                r.choice((-1, 0, 0, 0, 1))
            r.choice(("a", "b", "c"))
    assert sum(abs(truth[x.item] - x.consensus_score) <= 1 for x in got) / 400 > 0.95


def test_edges(spark):
    rows = [(None, 1, "rater_1", "a", 3.0, None, "x"), (1, 1, None, "a", 3.0, None, "x"), (1, 2, "rater", "a", 3.0, None, "x"), (2, 1, "rater_1", None, 9.0, None, "x"), (3, 1, "rater_1", None, 3.0, None, "x"), (4, 1, "rater_2", "b", float("nan"), None, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    rated = C.ratings(df)
    assert rated.count() == 2  # a missing row id leaves the name as the item
    a = C.accuracies(rated)
    assert [(r.rater_no, r.accuracy) for r in a.collect()] == [(1, 0.0)]  # two equal scores never vary and C.unfaithful(a).count() == 0
    assert all(r.agreement is None for r in C.consensus(rated, a, C.item_names(df)).collect())
    empty = C.ratings(df.where("false"))
    assert C.accuracies(empty).count() == 0 and C.consensus(empty, C.accuracies(empty), C.item_names(df)).count() == 0
