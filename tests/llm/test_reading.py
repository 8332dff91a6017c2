import random
from collections import Counter

import numpy as np

from markweave.llm import reading as R

SCHEMA = "source_row_id bigint, Text string, Vocabulary double, Syntax double, level string"
EASY, HARD = "the dog cat ran big red fun boy girl hat sat on a mat".split(), "institutional legitimacy presupposes considerable methodological deliberation concerning unprecedented administrative consequences".split()


def world(spark, n=120):
    r = random.Random(3)
    rows = []
    for k in range(n):
        hard = k % 4 == 0
        long = k % 2 == 0
        words = HARD if hard else EASY
        text = " ".join(" ".join(r.choice(words) for _ in range(30 if long else 6)) + ". " for _ in range(5))
        g = 5.0 if hard and long else 3.0 if hard else 2.0
        rows += [(k, text, g, g, "x"), (k, text, min(5.0, g + 1), g, "x")]
    return rows + [(900, None, 3.0, 3.0, "x"), (901, "  ", 3.0, 3.0, "x"), (902, "!!!", 3.0, 3.0, "x"), (903, "Mr. Smith paid 3.5 dollars e.g. today. Ok?", None, 9.0, "x")]


def test_levels(spark):
    df = spark.createDataFrame(world(spark), SCHEMA)
    got = R.reading_levels(df)
    assert got.count() == 121
    found = {r.source_row_id for r in R.most_demanding(got).select("source_row_id").collect()}
    assert found == set(range(0, 120, 4))
    x = {r.source_row_id: r for r in got.collect()}
    assert x[903].words_per_sentence == 4.0 and x[903].difficulty is not None
    assert all(x[k].difficulty >= x[1].difficulty for k in found)


def test_edges(spark):
    df = spark.createDataFrame(world(spark), SCHEMA)
    assert R.reading_levels(df.where("false")).count() == 0
    ungraded = R.reading_levels(df.selectExpr("source_row_id", "Text", "cast(null as double) as Vocabulary", "Syntax")).collect()
    assert len(ungraded) == 121 and all(r.difficulty is None and r.level is None for r in ungraded)
    long = spark.createDataFrame([(1, "word " * 100_000, 3.0, 3.0, "x")], SCHEMA)
    assert R.reading_levels(long).first().words_per_sentence == 100_000


def test_isotonic_against_brute_force():
    r = random.Random(5)
    for _ in range(50):
        blocks = [(float(k), float(r.randint(1, 9)), 1.0) for k in range(r.randint(1, 9))]
        fit = R.isotonic(blocks)
        values = [y for _, y in fit]
        assert values == sorted(values)
        at = lambda x: [y for f, y in fit if f <= x][-1]
        n = len(blocks)
        for i in range(n):  # the min-max formula of isotonic regression
            want = max(min(sum(y for _, y, _ in blocks[a : b + 1]) / (b - a + 1) for b in range(i, n)) for a in range(i + 1))
            assert abs(at(float(i)) - want) < 1e-9


def test_models_hold_every_ngram_of_both_halves(spark):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(3000)]
    rows = [(k, " ".join(r.sample(words, 300)) + f" closing{k}.", 2.0, 2.0, "x") for k in range(60)]
    graded = R._graded(spark.createDataFrame(rows, SCHEMA), "source_row_id", "Text", ("Vocabulary", "Syntax"))
    want = [Counter(), Counter()]
    for _, text, *_ in rows:
        b = R.Batch([text], R._Codes())
        want[R._fold(text)].update(np.concatenate([b.uni, b.first, b.bi]).tolist())
    keys = np.array(sorted(want[0].keys() & want[1].keys()), dtype=np.uint64)
    assert len(np.unique(keys & np.uint64(R.CELLS - 1))) < len(keys) > 5000  # some share a cell
    models, others = R.train(graded)
    assert others is None and models.holds(keys).all()
    for fold in range(2):
        assert models.counts[fold * R.MODELS, models.of(keys)].tolist() == [want[fold][k] for k in keys.tolist()]


def test_joined_ngrams_give_what_held_ones_do(spark, sf):
    essays = spark.read.parquet(f"{sf}/rater_essay_wide.parquet")
    key = lambda df: sorted(map(str, df.collect()))
    want = key(R.reading_levels(essays))
    for held, block_words in ((0, R.BLOCK_WORDS), (500, 20_000)):
        assert key(R.reading_levels(essays, held=held, block_words=block_words)) == want
