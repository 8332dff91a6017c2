import random

from hypothesis import given
from hypothesis import strategies as st

from pyspark.sql import functions as F

from markweave.llm import splits as S

SCHEMA = "source_row_id bigint, Filename string, rater_id string, group string"


def brute(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for k, f, r in rows:
        keys = [("row", k)] * (k is not None) + [("name", f)] * (f is not None) + [("rater", r)] * (r is not None)
        for a, b in zip(keys, keys[1:]):
            parent[find(a)] = find(b)
        if keys:
            find(keys[0])
    least = {}
    for x in list(parent):
        if x[0] == "rater":
            least[find(x)] = min(least.get(find(x), 1 << 60), x[1])
    return {(x[1], least[find(x)]) for x in list(parent) if x[0] == "row" and find(x) in least}


def test_groups_against_union_find(spark):
    r = random.Random(2)
    for seed in range(3):
        rows = [(r.choice((None, *range(60))), r.choice((None, *range(40 * (seed + 1)))), r.choice((None, *range(1, 30 * (seed + 1))))) for _ in range(120)]
        spell = lambda f: None if f is None else r.choice(("essay_{}", " Essay {}.TXT", "ESSAY-{}  ", "essay_{}.txt")).format(f)
        df = spark.createDataFrame([(k, spell(f), None if q is None else r.choice(("rater_{}", "RATER 0{}")).format(q), "x") for k, f, q in rows], SCHEMA)
        assert {tuple(x) for x in S.group_of_rows(S.tied_groups(df)).collect()} == brute(rows)


def test_long_chain_and_hot_rater(spark):
    rows = [(k, f"f{k // 2}" if k % 2 else f"f{k // 2 - 1}x", f"rater_{k}") for k in range(200)] + [(k, None, f"rater_{k - 1}") for k in range(1, 200)] + [(1000 + k, None, "rater_500") for k in range(500)]
    df = spark.createDataFrame([(*x, "x") for x in rows], SCHEMA)
    got = dict(S.group_of_rows(S.tied_groups(df)).collect())
    assert {got[k] for k in range(200)} == {0} and {got[1000 + k] for k in range(500)} == {500}


def test_no_tied_rows_are_parted_and_proportions_hold(spark):
    rows = [(k, f"f{k // 4}", f"rater_{k // 4}", "x") for k in range(2000)] + [(None, None, None, "x")] * 400
    df = spark.createDataFrame(rows, SCHEMA)
    out = S.label_rows(df, S.assign_splits(S.tied_groups(df)))
    by = {}
    sizes = {}
    alone = {}
    for r in out.collect():
        sizes[r.split] = sizes.get(r.split, 0) + 1
        if r.group is None:
            alone[r.split] = alone.get(r.split, 0) + 1
        else:
            by.setdefault(r.group, set()).add(r.split)
    assert all(len(x) == 1 for x in by.values()) and sum(sizes.values()) == 2400 and set(out.columns) == {"source_row_id", "Filename", "rater_id", "group", "split"}
    assert abs(sizes["train"] / 2400 - 0.8) < 0.03 and abs(sizes["test"] / 2400 - 0.1) < 0.03
    assert sum(alone.values()) == 400 and len(alone) == 3  # rows without a key aren't pooled
    assert {r.check: r.value for r in S.split_violations(out).collect()} == {"rows": 2400, "unlabelled": 0, "off_balance": 0, "parted_rows": 0, "parted_names": 0, "parted_raters": 0}
    broken = out.withColumn("split", F.when(F.col("source_row_id") % 4 == 0, "test").otherwise("train"))
    found = {r.check: r.value for r in S.split_violations(broken).collect()}
    assert found["parted_names"] == found["parted_raters"] == 500 and found["parted_rows"] == 0 and found["off_balance"] == 1
    assert S.assign_splits(S.tied_groups(spark.createDataFrame(rows, SCHEMA).where("false"))).count() == 0


@given(st.lists(st.integers(0, 50), max_size=40), st.integers(2, 8))
def test_differencing_keeps_every_weight(weights, bins):
    packed = S.difference_bins(weights, bins)
    assert len(packed) == bins and sorted(i for b in packed for i in b) == list(range(len(weights)))
    sums = [sum(weights[i] for i in b) for b in packed]
    assert max(sums) - min(sums) <= max(weights, default=0)


def test_hot_centre_is_salted(spark):
    edges = [(0, k) for k in range(1, 300)] + [(1000 + k, 1001 + k) for k in range(50)] + [(299, 1050)]
    df = spark.createDataFrame(edges, "u bigint, v bigint").repartition(7)
    want = {k: 0 for k in [*range(300), *range(1000, 1051)]}
    for hot in (5, S.HOT):
        assert dict(S.components(df, hot=hot).collect()) == want
