import random

import numpy as np

from markweave.llm import leakage as L

PASSAGE = "Surveyors from Korvarmond counted 405 steps between the lighthouse and the green bag before giving up in 1647 because the council of Velmovik voted four to ten against moving the quarry near the old mill"
WORDS = PASSAGE.split()


def setting(spark):
    other = "Fishermen near Quindenbay still call the orchard by its empty name after Brabedale of Selkaer who sank there in 1744 with eight barrels of wax and one silver bell for the families of the harbor town"
    items = [(1, "Read the passage below.\n" + PASSAGE + "\nWhat changed?"), (2, "Read the passage below.\n" + other), (3, "Read the passage below."), (4, None), (5, "")]
    return spark.createDataFrame(items, "item_id bigint, text string")


def changed(step):
    return " ".join("zebra" if k % step == step - 1 else w for k, w in enumerate(WORDS))


def test_cases(spark):
    shuffled = WORDS[:]
    random.Random(1).shuffle(shuffled)
    docs = {
        1: PASSAGE, 2: "Intro text. " + PASSAGE.upper().replace(" ", "  ") + " outro", 3: " ".join(WORDS[5:26]), 4: "<p>" + "</p>\n<p>".join(" ".join(WORDS[k : k + 4]) for k in range(0, len(WORDS), 4)) + "</p>", 5: changed(11),
        10: " ".join(WORDS[:12]), 11: " ".join(shuffled), 12: None, 13: "", 14: "Read the passage below. " * 30, 15: changed(4), 16: PASSAGE.replace("Korvarmond", "Zelton").replace("405", "9").replace("1647", "1801").replace("Velmovik", "Ostra").replace("four", "six").replace("ten", "two"),
        17: "filler word " * 3000 + PASSAGE,
    }
    df = spark.createDataFrame([(k, t, "x") for k, t in docs.items()], "doc_id bigint, text string, item_id string")
    whole = None
    for block in (L.BLOCK_WORDS, 40, 1):  # blocks of passages don't change the result
        rows = sorted(tuple(r) for r in L.leaked_passages(df, setting(spark), block_words=block).collect())
        assert {(r[0], r[1]) for r in rows if r[-1] == "leaked"} == {(k, 1) for k in (1, 2, 3, 4, 5, 17)}
        assert {r[0] for r in rows if r[-1] == "reparameterised"} >= {16}
        assert whole in (None, rows)
        whole = rows


def test_words_beyond_the_vocabulary_are_told_apart(spark):
    df = spark.createDataFrame([(1, PASSAGE), (2, changed(11)), (3, " ".join(f"other{k}" for k in range(60))), (4, changed(4)), (5, " ".join(WORDS[:12]))], "doc_id bigint, text string")
    for block in (L.BLOCK_WORDS, 40):
        found = L.leaked_passages(df, setting(spark), block_words=block, vocabulary=5).where("verdict = 'leaked'")
        assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (2, 1)}


def test_empty_tables_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE)], "doc_id bigint, text string")
    assert L.leaked_passages(df, setting(spark)).where("verdict = 'leaked'").count() == 2
    assert L.leaked_passages(df.where("false"), setting(spark)).count() == 0
    assert L.leaked_passages(df, setting(spark).where("false")).count() == 0


def test_longest_against_brute_force():
    r = np.random.default_rng(2)
    for _ in range(300):
        e = r.random(40) < 0.8
        best = 0
        for a in range(40):
            for b in range(a + 1, 41):
                if e[a] and e[b - 1] and (~e[a:b]).sum() <= L.CHANGED * (b - a):
                    best = max(best, b - a)
        assert L.longest(e) == best


def test_passage_under_three_questions(spark):
    rows = [(k, "Read the passage below.\n" + PASSAGE + "\n" + q) for k, q in enumerate(("What changed?", "Who counted?", "Where did the council vote?"))] + [(k, "Read the passage below.\nAnother text of the set.") for k in (3, 4, 5)]
    docs = spark.createDataFrame([(1, PASSAGE)], "doc_id bigint, text string")
    found = L.leaked_passages(docs, spark.createDataFrame(rows, "item_id bigint, text string")).where("verdict = 'leaked'")
    assert {r.item_id for r in found.collect()} == {0, 1, 2}
    assert {r.line for r in L.shared_lines(spark.createDataFrame(rows[3:], "item_id bigint, text string")).collect()} == set()


def test_reparameterised_questions(spark):
    """Recall and precision over planted cases: all numbers and names replaced, against the item itself, parts of it and other texts."""
    r = random.Random(4)
    names = ["".join(r.choice("bdfklmnrst") + r.choice("aeiou") for _ in range(3)).capitalize() for _ in range(200)]
    verbs = [f"verb{chr(97 + k // 26)}{chr(97 + k % 26)}ed" for k in range(60)]
    nouns = [f"noun{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]

    def question(seed, values):
        q, v = random.Random(seed), random.Random(values)
        return " ".join(f"then {v.choice(names)} {q.choice(verbs)} {v.randint(2, 999)} {q.choice(nouns)} near the {q.choice(nouns)} with" for _ in range(5)) + " care"

    items = spark.createDataFrame([(k, question(k, k)) for k in range(30)], "item_id bigint, text string")
    docs = [(k, question(k, 1000 + k)) for k in range(30)] + [(100 + k, question(k, k)) for k in range(30)] + [(200 + k, question(500 + k, 2000 + k)) for k in range(30)] + [(300 + k, " ".join(question(k, k).split()[:12])) for k in range(30)]
    found = L.leaked_passages(spark.createDataFrame(docs, "doc_id bigint, text string"), items).collect()
    same = {(x.doc_id, x.item_id) for x in found if x.verdict == "reparameterised"}
    assert len({(k, k) for k in range(30)} & same) >= 29 and len({x for x in same if x[0] >= 30}) <= 1
    assert {(x.doc_id, x.item_id) for x in found if x.verdict == "leaked"} == {(100 + k, k) for k in range(30)}


def test_names_only_and_long_tags(spark):
    roll = " ".join(f"Name{chr(97 + k)}{chr(97 + k // 2)}" for k in range(26))
    items = spark.createDataFrame([(1, "the roll is " + roll)], "item_id bigint, text string")
    cut = " ".join(f"<a href='{'x y ' * 100}'>{w}</a>" for w in roll.split())
    docs = spark.createDataFrame([(1, roll.lower()), (2, cut)], "doc_id bigint, text string")
    assert {x.doc_id for x in L.leaked_passages(docs, items).where("verdict = 'leaked'").collect()} == {1, 2}
