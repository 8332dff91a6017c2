import pytest

from markweave.llm import answers as A

PROMPT = "You explain a score in English with JSON.\n\nTARGET ESSAY\nMy uncle finished a garden near the old mill and the children ran to the river because nobody watched the gate during the long storm of that summer."
GOOD = "The word choice stays mostly secure, while the comma use is uneven. The logical order shows steady growth."


def defect(raw, gold=3, candidate=True, prompt=PROMPT):
    return A.judge(raw, prompt, gold, candidate)[0]


@pytest.mark.parametrize("raw", [None, "", "  \n", "​\n\n", "```json\n```", "{}", '{"reasoning": ""}', '{"predicted_overall": 4, "reasoning": " "}', '{"reasoning": "..."}', '{"reasoning": "N/A"}', '{"reasoning": null}', "—"])
def test_empty(raw):
    assert defect(raw) == "empty"


@pytest.mark.parametrize("raw", ["I'm sorry, but I can't help with grading this essay.", '{"predicted_overall": null, "reasoning": "I apologize, however I must decline to evaluate this text. Please consult a qualified teacher instead."}', "This request is something I cannot assist with.", '{"error": "As a language model, I can\'t help with grading this essay."}', "Thank you for sharing this, but I won't provide a rating here; human assessment should be left to people."])
def test_refusal(raw):
    assert defect(raw) == "refusal"


@pytest.mark.parametrize("raw", [PROMPT, '{"reasoning": "my uncle finished a garden near the old mill and the children ran to the river because nobody watched the"}'])
def test_echo(raw):
    assert defect(raw) == "echo"


@pytest.mark.parametrize("raw", ["Ce texte organise un lexique plutôt pauvre, et les liens logiques aident la lecture.", '{"reasoning": "The comma use is uneven. El ensayo presenta un argumento sencillo, pero la conclusión llega tarde. El texto muestra los errores de concordancia."}', "この作文は具体例をはっきり示しており、語彙の幅がもう少し必要である。"])
def test_language(raw):
    assert defect(raw) == "language"


@pytest.mark.parametrize("raw", ['{"reasoning": "The word choice is secure. The logical order shows which', '{"reasoning": "The word choice is secure. The spelling, with a …"}', '{"reasoning": "The line “our town have started', '{"reasoning": "It is uneven, and the writer\'s"}'])
def test_truncated_without_the_corpus(raw):
    assert defect(raw) == "truncated"


def test_the_corpus_judges_open_ends():
    assert defect('{"predicted_overall": 3, "reas') == "truncated" and defect('{"reasoning": "It is fine. The comma use is uneven') == "truncated"
    assert A.judge('{"reasoning": "It is fine. The comma use is uneven"}', PROMPT, 3, True)[:2] == (None, "is uneven")
    assert A.judge('{"reasoning": "It is fine. The comma use is uneven.', PROMPT, 3, True)[:2] == (None, None)


@pytest.mark.parametrize("raw", ["Overall 3 is the natural result.", "It sits at level three.", "The essay earns three out of five.", "Gold Overall は3点です。", "That is why the rater gave it 3/5.", "This deserves a score of 3.", "A three overall seems right for this rater.", "score = 3", "Overall: 3."])
def test_score_leak(raw):
    assert defect(f'{{"reasoning": "{GOOD} {raw}"}}') == "score_leak"
    assert defect(f'{{"reasoning": "{GOOD} {raw}"}}', gold=4) is None and defect(f'{{"reasoning": "{GOOD} {raw}"}}', candidate=False) is None


@pytest.mark.parametrize("raw", [GOOD, f"predicted_overall: 3\nreasoning: {GOOD}", '{"predicted_overall": 9, "reasoning": "' + GOOD, "The phrase “más o menos” appears once, but the hedging shows care.", "I cannot place it in the top band because the spelling is uneven.", "Sorry spots such as the register do not hide the clear plan. The writer is unable to sustain the claim.", "Paragraph 3 is the clearest part. It lists 3 reasons. Only 3 of the sentences run on. There are three clear examples.", "The line “garden near the old mill and” is a good instance.", '{"reasoning": "' + GOOD + ' {topic focus}"}'])
def test_sound_answers(raw):
    assert defect(raw) is None


def test_tiling_against_brute_force():
    assert A.tiled_share("a b c d e f".split(), "x a b c d e f y".split()) == 1
    assert A.tiled_share("a b c d a b c d e".split(), "a b c d e".split()) == 5 / 9
    assert A.tiled_share([], ["a"]) == 0 and A.tiled_share(["a"], []) == 0


def tables(spark):
    p = [("1:1", PROMPT, '{"reasoning": "The comma use is uneven. It is uneven."}', 3, "x"), ("6:1", PROMPT, '{"reasoning": "The comma use is uneven."}', 3, "x"), ("2:1", PROMPT, '{"reasoning": "It is fine. The comma use is uneven"}', 3, "x"), ("3:1", PROMPT, '{"reasoning": "It is fine. The comma use is unev"}', 3, "x"), ("4:1", None, None, None, "x"), ("4:1", None, None, None, "x"), (None, None, "", 1, "x")]
    c = [("1:1", "cand_2", PROMPT, "score = 3", 3), ("1:1", "3", PROMPT, PROMPT, 3), ("5:1", "1", PROMPT, "word " * 30000 + "end.", 3)]
    return spark.createDataFrame(p, "target_id string, prompt string, raw_model_output string, gold_overall int, defect string"), spark.createDataFrame(c, "target_id string, candidate_id string, prompt string, raw_model_output string, gold_overall int")


def test_tables(spark):
    p, c = tables(spark)
    got = {tuple(r) for r in A.defective_answers(A.answer_records(p, c)).collect()}
    a, b = "phase1_predictions", "reference_candidates_unverified"
    assert got == {(a, "3:1", 0, "truncated"), (a, "4:1", 0, "empty"), (b, "1:1", 2, "score_leak"), (b, "1:1", 3, "echo")}
    assert A.defective_answers(A.answer_records(p.where("false"), c.where("false"))).count() == 0


def test_one_closing_use_does_not_clear_a_cut(spark):
    whole = ["The comma use of the writer is uneven.", "The plan of the writer works.", "The ideas of the writer grow slowly."] * 4 + ["It was the fault of the writer."]
    rows = [(f"{k}:1", PROMPT, f'{{"reasoning": "{x}"}}', 3) for k, x in enumerate([*whole, "It is fine. The comma use of the writer", "It is fine. The comma use is uneven", "The comma use is uneven."])]
    schema = "target_id string, prompt string, raw_model_output string, gold_overall int"
    c = spark.createDataFrame([], "target_id string, candidate_id string, prompt string, raw_model_output string, gold_overall int")
    for times in (1, 20):  # the same judgement at any size
        p = spark.createDataFrame(rows * times, schema)
        assert {tuple(r) for r in A.defective_answers(A.answer_records(p, c)).collect()} == {("phase1_predictions", "13:1", 0, "truncated")}


def test_what_stands_beside_an_object_is_read_at_any_length():
    assert defect('I am unable to grade this essay. {"reasoning": "ok"}') == "refusal"
    assert defect('{"reasoning": ""} I cannot assist with that.') == "refusal"
    assert defect('Sure! Here is the result: {"reasoning": ""}') == "empty"
    assert defect('{"predicted_overall": " 5 ", "reasoning": ""}') == "empty"
    assert defect('Based on the history: {"reasoning": "The comma use is uneven."}') is None


def test_one_answer_that_ends_so_settles_nothing(spark):
    c = spark.createDataFrame([], "target_id string, candidate_id string, prompt string, raw_model_output string, gold_overall int")
    rows = [("1:1", PROMPT, "The essay shows a clear structure and the writer", 3), ("2:1", PROMPT, "Much of this praise is for the writer.", 3)]
    schema = "target_id string, prompt string, raw_model_output string, gold_overall int"
    for n in (1, 2):
        found = A.defective_answers(A.answer_records(spark.createDataFrame(rows[:n], schema), c)).collect()
        assert [(r.target_id, r.defect) for r in found] == [("1:1", "truncated")]


@pytest.mark.parametrize("raw", ["<div><ul><li>The plan is clear.</li><li", "<ul><li>The plan holds and the ending works</li>", "The plan is clear.\n1. The opening is short.\n2.", "The writer quotes “a long day and no", "The plan works.\n\n- It is clear.\n- ", '{"reasoning": "The plan works and the ending holds'])
def test_the_stack_decides_truncation(raw):
    assert defect(raw) == "truncated"


@pytest.mark.parametrize("raw", ["<div><ul><li>The plan is clear.</li></ul></div>", "<p>The plan is clear.", "```\nThe plan is clear.", "1. The plan is clear.\n2. The ending works.", "The writer says “the old mill” and moves on.", '{"reasoning": "The plan works and the ending holds."'])
def test_closed_texts_are_whole(raw):
    assert defect(raw) is None


def test_left_open():
    assert A.left_open("<div>a <b>c</b> “d") == ["div", "“"]
    assert A.left_open("```x\n<b>") == ["fence", "b"] and A.left_open("```<b>```") == []
    assert A.left_open("</b> ” text") == [] and A.left_open("a < b and c") == []


def test_echo_bounds_skip_no_echo():
    import random

    r = random.Random(6)
    words = [f"w{k}" for k in range(12)]
    for _ in range(400):
        prompt = [r.choice(words) for _ in range(30)]
        at = r.randint(0, 20)
        answer = prompt[at : at + r.randint(3, 9)] + [r.choice(words + ["zz"]) for _ in range(r.randint(0, 8))]
        tiled = len(answer) >= A.TILE and A.tiled_share(answer, prompt) >= A.ECHO_SHARE
        assert A.echoes(" ".join(answer), " ".join(prompt)) == tiled


@pytest.mark.parametrize("text", ["Tämä essee on hyvin kirjoitettu ja sen rakenne on selkeä, mutta sanavarasto on suppea.", "Bài văn này có cấu trúc rõ ràng nhưng từ vựng còn hạn chế.", "Ez a dolgozat jól felépített, de a szókincse szegényes.", "Insha hii ina mpangilio mzuri lakini msamiati ni mdogo.", "Acest eseu este bine scris dar vocabularul este limitat."])
def test_any_other_language(text):
    assert A.mostly_foreign(text)


@pytest.mark.parametrize("text", ["Spelling drifts in places.", "Good structure, weak vocabulary.", "On comparable texts this rater marks down missing articles, so I expect a cautious judgement.", "Ok."])
def test_english_without_much_evidence(text):
    assert not A.mostly_foreign(text)
