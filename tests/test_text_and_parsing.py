import pandas as pd
from pyspark.sql import functions as F

from markweave.functions import parsing
from markweave.functions import text as X


def test_text_features(spark):
    texts = [(None, 0, 0, 0), ("", 0, 0, 0), ("  \n", 3, 0, 0), ("no stop", 7, 2, 1), ("x²", 2, 1, 1), ("don't stop. Now!?", 17, 3, 2), ("école naïve", 11, 2, 1), ("日本語。", 4, 1, 1), ("😀 ok.", 5, 1, 1)]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i int, t string, c int, w int, s int")
    for r in df.select("*", X.character_count(F.col("t")).alias("gc"), X.word_count(F.col("t")).alias("gw"), X.sentence_count(F.col("t")).alias("gs")).collect():
        assert (r.gc, r.gw, r.gs) == (r.c, r.w, r.s), r


def test_similarity():
    assert X.rouge1([], ["a"]) == 0 and X.bleu([], ["a"]) == 0 and X.rouge1(["a", "a", "b"], ["a", "b", "c"]) == 2 * 2 / 6
    assert X.bleu("a b c d e".split(), "a b c d e".split()) == 1
    assert 0 < X.bleu(["a"], ["a", "b"]) < 1
    assert len(X._similarities(pd.Series([None, "a"]), pd.Series(["b", "A."]))) == 2


def test_similarity_of_batches_against_a_plain_count():
    import math
    import random
    from collections import Counter

    def plain(h, r):
        if not h or not r:
            return 0.0, 0.0
        product = 1.0
        for n in range(1, 5):
            grams = [Counter(" ".join(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (h, r)]
            product *= (sum(min(c, grams[1][g]) for g, c in grams[0].items()) + 1) / (max(0, len(h) - n + 1) + 1)
        common = sum(min(h.count(w), r.count(w)) for w in set(h))
        return product**0.25 * (1 if len(h) > len(r) else math.exp(1 - len(r) / len(h))), 2 * common / (len(h) + len(r))

    r = random.Random(5)
    draw = lambda: [[r.choice("abcde") for _ in range(r.choice((0, 1, 2, 3, 7, 20)))] for _ in range(200)]
    left, right = draw(), draw()
    got = X.similarities(left, right)
    for k in range(200):
        assert abs(got[0][k] - plain(left[k], right[k])[0]) < 1e-12 and abs(got[1][k] - plain(left[k], right[k])[1]) < 1e-12
    assert [len(x) for x in X.similarities([], [])] == [0, 0]


def test_leaks(spark):
    cases = [("This rater settles on Overall 2 here.", 2, True), ("評価は5点です", 5, True), ("15点", 5, True), ("OVERALL41", 4, True), ("the score: 1 fits", 1, True), ("page 14 of 40", 4, False), (None, 2, False), ("a plain remark", 2, False), ("one of 5 essays", 4, False)]
    df = spark.createDataFrame(cases, "t string, s int, want boolean").withColumn("got", X.leaks_score(F.col("t"), F.col("s")))
    assert all(r.got == r.want for r in df.collect())


def test_parsing_rules(spark):
    cases = {
        'Answer below.\n```json\n{"predicted_overall": 2, "reasoning": " uneven "}\n``` Done.': (2, "uneven"), '{"reasoning":"y","predicted_overall": "5\\t"}': (5, "y"), '{"predicted_overall": true, "reasoning":"z"}': (1, "z"), '{"predicted_overall": 1, "reasoning": null}': (1, "None"),
        '{"predicted_overall": 5, "reasoning": {"a": 1}}': (5, "{'a': 1}"), '{bad} then {"predicted_overall": 3, "reasoning": "w"} and {"predicted_overall": 4, "reasoning": "v"}': (3, "w"),
        '{"predicted_overall": 0, "reasoning": "x"}': None, '{"predicted_overall": 2.0, "reasoning": "x"}': None, '{"predicted_overall": "2.0", "reasoning": "x"}': None, "[2]": None, "": None, '<< {"a":{"b":1}} >>': None, '{"predicted_overall": 2}': None, '{"predicted_overall": "²", "reasoning": "x"}': None, "}{": None, '{"predicted_overall": 2, "reasoning": "  "}': None,
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", parsing.parse_prediction("t").alias("p"), parsing.parse_score("t").alias("q"), parsing.parse_reasoning("t").alias("r"))
    rows = df.collect()
    for r in rows:
        want = cases.get(r.t)
        assert ((r.p.predicted_overall, r.p.reasoning) if r.p.error is None else None) == want, r
        assert (r.p.error is None) == (want is not None)
    got = {r.t: r for r in rows}
    assert got['{"predicted_overall": 2}'].q.predicted_overall == 2 and got['{"predicted_overall": 2}'].p.error == parsing.MISSING["reasoning"]
    assert got['{"predicted_overall": 0, "reasoning": "x"}'].r.reasoning == "x" and got['{"predicted_overall": 0, "reasoning": "x"}'].p.error == parsing.MISSING["predicted_overall"]
    assert got[None].r.error == got["[2]"].q.error == parsing.NO_OBJECT and got['{"predicted_overall": "²", "reasoning": "x"}'].q.error.startswith("ValueError: ")


def test_pieces_against_a_plain_scan():
    """The first object among the whole and the shortest braced parts, found letter by letter."""
    import json
    import random

    def plain(text):
        parts, start = [text.strip()], None
        for k, c in enumerate(text):
            if c == "{" and start is None:
                start = k
            elif c == "}" and start is not None:
                parts.append(text[start : k + 1])
                start = None
        for part in parts:
            try:
                if isinstance(value := json.loads(part), dict):
                    return value
            except ValueError:
                pass
        return None

    r = random.Random(3)
    for _ in range(3000):
        text = "".join(r.choice(['{', '}', '{"a":1}', '"a":2', " ", "x", '{"b":{', "[1]"]) for _ in range(r.randint(0, 7)))
        assert next(parsing._objects(text), None) == plain(text)
