"""Defective answers to prompts, each with the type of its defect.

Method: a pushdown parser reads fences, brackets, strings, quotations, lists and markup and keeps on its stack what is left
open at the end; greedy string tiling against the prompt finds echoes, script checks and a character n-gram profile of English
find other languages, refusal and score grammars find the rest. A text without a last stop breaks off where a string, a
quotation or an element is open, a list's last item or a tag has only begun, or the last word can't end a sentence; what is
left (a text that might lack its last stop only) is decided by how sentences end in all answers: by the share of the uses of
its last two words that closes a sentence, with ``CLOSING_PRIOR`` uses that don't added, so that it doesn't move with the size of
the data and a single answer that ends so settles nothing.

Defined results: a null, empty or blank answer is ``empty``; a null prompt is never echoed; exact repetitions and
repeated deliveries of a record count once, with the first defect in the order of ``DEFECTS`` that any of them has;
records with a null target id are left out; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markweave.session import cut_lineage, spread

DEFECTS = ("empty", "refusal", "echo", "language", "truncated", "score_leak")
#: Tiles of at least so many words count, and an answer is an echo from this share of tiled words on.
TILE, ECHO_SHARE = 5, 0.6
#: Two words may end a text without a last stop if so large a share of their uses, and of so many more, closes a sentence.
CLOSING_SHARE, CLOSING_PRIOR = 0.2, 5
#: Mean log-probability of a letter under the profile of English: from the first on a text is English as a whole, below the second a sentence is in another language.
ENGLISH, FOREIGN = -2.6, -3.3
#: Share of particles above which a sentence is English whatever its other words; words that a sentence without them has at least to be foreign by letters that could be English.
PARTICLES, LONG = 1 / 8, 7

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_FENCE = re.compile(r"```[a-zA-Z]*\s?|~~~[a-zA-Z]*\s?")
_STRING = re.compile(r'"((?:[^"\\]|\\.)*)("|\Z)', re.S)
_LABEL = re.compile(r"(?mi)^\s*[\"']?predicted_overall[\"']?\s*[:=]\s*[\"']?\s*-?\d*(?:\.\d+)?\s*[\"']?\s*,?\s*$|^\s*[\"']?(?:answer|result|reasoning|explanation|rationale|notes|error)[\"']?\s*[:=]\s*")
_SPOKEN = re.compile(r"[^\W_]")
_MARKS = frozenset(("n/a", "na", "none", "null", "nil", "nan", "tbd", "todo", "no answer", "no reasoning", "no response", "empty", "undefined"))
_INVISIBLE = re.compile("[­​-‏ -‮⁠﻿]")


_NUMBER = re.compile(r"\s*-?\d*(?:\.\d+)?\s*")


def _strings(value, out: list[str]) -> None:
    """All strings of a parsed value but bare numbers: a score says nothing."""
    if isinstance(value, str):
        if not _NUMBER.fullmatch(value):
            out.append(value)
    elif isinstance(value, dict):
        for v in value.values():
            _strings(v, out)
    elif isinstance(value, list):
        for v in value:
            _strings(v, out)


#: Elements that an author closes; others (li, p, br) often stay open in whole texts.
_CLOSED = frozenset("a b blockquote body code div em font form h1 h2 h3 h4 h5 h6 html i ol pre section small span strong table tbody td th tr u ul".split())
_QUOTES = {"“": "”", "«": "»", "„": "“", "「": "」"}
_PUSHDOWN = re.compile(r"(?P<fence>```|~~~)|<(?P<tag>/?[A-Za-z][A-Za-z0-9]*)\b[^<>]*(?P<end>>|\Z)|(?P<quote>[“”«»„「」])|(?P<item>^[ \t]*(?:[-*•+]|\d{1,3}[.)])[ \t]*\Z)", re.M)


def left_open(text: str) -> list[str]:
    """What a text leaves open at its end: fences, quotation marks, elements, and ``begun`` for a tag or list item of which only the start is there."""
    stack: list[str] = []
    for m in _PUSHDOWN.finditer(text):
        if m.group("fence"):
            if "fence" in stack:
                del stack[stack.index("fence") :]
            else:
                stack.append("fence")
        elif m.group("tag"):
            name = m.group("tag").lower()
            if m.group("end") != ">":
                stack.append("begun")
            elif name[0] == "/":
                if name[1:] in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(name[1:]) :]
            elif name in _CLOSED and not m.group().endswith("/>"):
                stack.append(name)
        elif m.group("quote"):
            mark = m.group("quote")
            at = next((k for k in range(len(stack) - 1, -1, -1) if _QUOTES.get(stack[k]) == mark), None)
            if at is not None:
                del stack[at]
            elif mark in _QUOTES:
                stack.append(mark)
        else:
            stack.append("begun")
    return stack


def parse(raw: str) -> tuple[str, list[str]]:
    """(what the answer says, what the pushdown parser finds open at its end: brackets, ``"`` for a string, and what ``left_open`` names)."""
    bare = _INVISIBLE.sub("", _FENCE.sub("", raw)).strip()
    first = min((k for k in (bare.find("{"), bare.find("[")) if k >= 0), default=-1)
    said, opened = None, []
    if first >= 0:
        last = max(bare.rfind("}"), bare.rfind("]"))
        if last > first:
            try:
                value = json.loads(bare[first : last + 1], strict=False)
                if isinstance(value, (dict, list)):
                    out: list[str] = []
                    _strings(value, out)
                    said = "\n".join([*out, *_beside(bare[:first], bare[last + 1 :])])
            except (ValueError, RecursionError):
                pass
        if said is None and re.match(r'[{\[]\s*(?:["}\]]|\Z)', bare[first:]):
            out, opened = _tolerant(bare[first:])
            said = "\n".join([*_beside(bare[:first], ""), *out])
    if said is None:
        said = _LABEL.sub("", bare)
    return said, opened + left_open(said)


_OPENER = re.compile(r"^(?:(?:sure|okay|ok|certainly|of course|absolutely|yes|thanks?|thank you)\b[,.!:; ]*)+", re.I)


def _beside(before: str, after: str) -> list[str]:
    """What is said beside an object; an announcement that ends in a colon and a bare courtesy say nothing."""
    before = _OPENER.sub("", _LABEL.sub("", before).strip())
    if before.endswith(":"):
        before = before[: max((before.rfind(x) for x in ".!?\n"), default=-1) + 1]
    return [x for x in (before.strip(), _LABEL.sub("", after).strip()) if _SPOKEN.search(x)]


def _tolerant(text: str) -> tuple[list[str], list[str]]:
    """Strings that are no keys, from JSON that doesn't parse; the stack of openers that nothing closed."""
    stack: list[str] = []
    out: list[str] = []
    at = 0
    for m in _STRING.finditer(text):
        for c in text[at : m.start()]:
            if c in "{[":
                stack.append(c)
            elif c in "}]" and stack:
                stack.pop()
        at = m.end()
        closed = m.group(2) == '"'
        if not closed:
            stack.append('"')
        if not re.match(r"\s*:", text[at:]) and not _NUMBER.fullmatch(m.group(1)):
            said = re.sub(r"\\u([0-9a-fA-F]{4})", lambda u: chr(int(u.group(1), 16)), m.group(1))
            out.append(re.sub(r'\\(["\\/])', r"\1", re.sub(r"\\[ntr]", "\n", said)))
    for c in text[at:]:
        if c in "{[":
            stack.append(c)
        elif c in "}]" and stack:
            stack.pop()
    return out, stack


# Refusals: an excuse or the model's own nature, inability in the first person, and the task that is declined.
_CANNOT = r"(?:can ?not|can['’]t|am not able to|['’]m not able to|am unable to|['’]m unable to|must decline|have to (?:pass|decline)|need to decline|won['’]t|will not|would rather not|do not feel comfortable|don['’]t feel comfortable|prefer not to)"
_TASK = r"(?:assist|help|grad(?:e|ing)|scor(?:e|ing)|rat(?:e|ing)|evaluat\w*|assess\w*|predict\w*|judg\w*|provide|comply|fulfil\w*|answer|complete|respond|review|comment|continue|discuss)"
_REFUSAL = re.compile(
    rf"\bI(?:['’]m| am)? ?{_CANNOT}\b[^.!?]{{0,40}}\b{_TASK}\b|\bis something I (?:can ?not|can['’]t|am unable to)\b|\bagainst my (?:guidelines|policy|policies|programming)\b|"
    r"\b(?:would ?n['’]t|would not|not) be appropriate for me\b|\bas an? (?:AI|language model|large language model|assistant)\b|\bthis request (?:goes|is) (?:against|outside)\b",
    re.I,
)
_EXCUSE = re.compile(r"^\W*(?:I['’]?m (?:very |really )?sorry|I am (?:very |really )?sorry|sorry\b(?! spots)|I apologi[sz]e|my apologies|unfortunately|regrettably|as an? (?:AI|language model|large language model))", re.I)
_COURTESY = re.compile(r"thank you for|please consult|is there (?:something|anything) else|human assessment should|happy to help|feel free to", re.I)

# Two public English passages; their letters, in threes, are the profile of English.
_ENGLISH = (
    "Four score and seven years ago our fathers brought forth on this continent, a new nation, conceived in Liberty, and dedicated to the proposition that all men are created equal. Now we are engaged in a "
    "great civil war, testing whether that nation, or any nation so conceived and so dedicated, can long endure. We are met on a great battle-field of that war. We have come to dedicate a portion of that "
    "field, as a final resting place for those who here gave their lives that that nation might live. It is altogether fitting and proper that we should do this. But, in a larger sense, we can not "
    "dedicate, we can not consecrate, we can not hallow this ground. The brave men, living and dead, who struggled here, have consecrated it, far above our poor power to add or detract. The world will "
    "little note, nor long remember what we say here, but it can never forget what they did here. It is for us the living, rather, to be dedicated here to the unfinished work which they who fought here have "
    "thus far so nobly advanced. It is rather for us to be here dedicated to the great task remaining before us, that from these honored dead we take increased devotion to that cause for which they gave the "
    "last full measure of devotion, that we here highly resolve that these dead shall not have died in vain, that this nation, under God, shall have a new birth of freedom, and that government of the people, "
    "by the people, for the people, shall not perish from the earth. "
    "When in the course of human events, it becomes necessary for one people to dissolve the political bands which have connected them with another, and to assume among the powers of the earth, the separate "
    "and equal station to which the laws of nature and of nature's God entitle them, a decent respect to the opinions of mankind requires that they should declare the causes which impel them to the separation. "
    "We hold these truths to be self-evident, that all men are created equal, that they are endowed by their Creator with certain unalienable rights, that among these are life, liberty and the pursuit of "
    "happiness. That to secure these rights, governments are instituted among men, deriving their just powers from the consent of the governed, that whenever any form of government becomes destructive of these "
    "ends, it is the right of the people to alter or to abolish it, and to institute new government, laying its foundation on such principles and organizing its powers in such form, as to them shall seem most "
    "likely to effect their safety and happiness. Prudence, indeed, will dictate that governments long established should not be changed for light and transient causes; and accordingly all experience hath shown, "
    "that mankind are more disposed to suffer, while evils are sufferable, than to right themselves by abolishing the forms to which they are accustomed."
)
_KINDS = 28  # blank, a to z, any other letter


def _letters(text: str) -> np.ndarray:
    """Letters as numbers, with one blank before, between and after words."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = np.where((c >= 97) & (c <= 122), c - 96, np.where((c >= 0xC0) & ~((c >= 0x2000) & (c <= 0x206F)) & ~((c >= 0x3000) & (c <= 0x303F)), _KINDS - 1, 0)).astype(np.int64)
    keep = kind > 0
    keep[1:] |= kind[:-1] > 0
    keep[0] = True
    return kind[keep]


def _profile() -> np.ndarray:
    """Log-probabilities of a letter after two others: interpolated shares of threes, twos and ones of the passage."""
    x = _letters(_ENGLISH)
    three = np.bincount((x[:-2] * _KINDS + x[1:-1]) * _KINDS + x[2:], minlength=_KINDS**3).reshape(_KINDS, _KINDS, _KINDS).astype(float)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 0.5) / (one.sum() + _KINDS)
    p2 = two / np.maximum(two.sum(axis=1, keepdims=True), 1)
    p3 = three / np.maximum(three.sum(axis=2, keepdims=True), 1)
    return np.log(0.5 * p3 + 0.35 * p2[None] + 0.15 * p1[None, None]).ravel()


_LOG_P = _profile()
# English particles, and those that other languages of this script write so too; the latter count half.
_PARTICLES = dict.fromkeys("the of and to that it with are this by from but not has had which while would should could yet though because their his her its they you your what when where who how than then there these those been being if into after before about".split(), 1.0)
_PARTICLES |= dict.fromkeys("a an as at be do for have i in is me my no on or so up was we he she".split(), 0.5)
_OTHER_SCRIPT = re.compile("[Ͱ-ϿЀ-ԯ֐-ۿऀ-෿฀-໿぀-ヿ㐀-鿿가-힯]")
_SENTENCE = re.compile(r"(?<=[.!?;。！？])\s*|\n+")


def english(text: str) -> float:
    """Mean log-probability of the text's letters under the profile of English; 0 for a text without letters."""
    x = _letters(text)
    return float(_LOG_P[(x[:-2] * _KINDS + x[1:-1]) * _KINDS + x[2:]].mean()) if len(x) > 3 else 0.0


def mostly_foreign(text: str) -> bool:
    """More of the text in another language than in English, by sentences; quotations inside a sentence don't decide.

    A sentence needs positive evidence to be English: enough of its words are English particles, or its letters fit the profile.
    A short one without it decides nothing, unless its letters are far from the profile.
    """
    if english(text) >= ENGLISH:
        return False
    own = foreign = 0.0
    for s in _SENTENCE.split(text):
        words = _WORD.findall(s.lower())
        if not words:
            continue
        other = len(_OTHER_SCRIPT.findall(s))
        if other > 0.3 * len(_SPOKEN.findall(s)):
            foreign += max(len(words), other / 2)
        elif sum(_PARTICLES.get(w, 0.0) for w in words) > PARTICLES * len(words) or (fit := english(s)) >= ENGLISH:
            own += len(words)
        elif len(words) >= LONG or (len(words) > 2 and fit < FOREIGN):
            foreign += len(words)
    return foreign > own


def tiled_share(answer: list[str], prompt: list[str], tile: int = TILE) -> float:
    """Greedy string tiling: the share of the answer's words in tiles of at least ``tile`` words that the prompt holds too."""
    places: dict[tuple[str, ...], list[int]] = {}
    for k in range(len(prompt) - tile + 1):
        places.setdefault(tuple(prompt[k : k + tile]), []).append(k)
    matches = []
    k = 0
    while k <= len(answer) - tile:
        best = 0
        for p in places.get(tuple(answer[k : k + tile]), ()):
            n = tile
            while k + n < len(answer) and p + n < len(prompt) and answer[k + n] == prompt[p + n]:
                n += 1
            if n > best:
                best, where = n, p
        if best:
            matches.append((best, k, where))
            k += max(1, best - tile + 1)
        else:
            k += 1
    tiled = 0
    free_a, free_p = [True] * len(answer), [True] * len(prompt)
    for n, a, p in sorted(matches, key=lambda m: (-m[0], m[1])):  # longest tiles first; what an earlier tile holds is cut off
        while n and not (free_a[a] and free_p[p]):
            a, p, n = a + 1, p + 1, n - 1
        m = 0
        while m < n and free_a[a + m] and free_p[p + m]:
            m += 1
        if m >= tile:
            free_a[a : a + m], free_p[p : p + m] = [False] * m, [False] * m
            tiled += m
    return tiled / max(1, len(answer))


def echoes(text: str, prompt: str | None) -> bool:
    if not prompt:
        return False
    words = [w.lower() for w in _WORD.findall(text)]
    if len(words) < TILE:
        return False
    # Two bounds that no tiling can exceed: words that stand in the prompt, and words of runs that stand in it.
    lower = prompt.lower()
    known = {w: w in lower for w in set(words)}
    if sum(known[w] for w in words) < ECHO_SHARE * len(words):
        return False
    theirs = _WORD.findall(lower)
    joined = f" {' '.join(theirs)} "
    bound = reach = 0
    for k in range(len(words) - TILE + 1):
        if all(known[w] for w in words[k : k + TILE]) and f" {' '.join(words[k : k + TILE])} " in joined:
            bound += k + TILE - max(reach, k)
            reach = k + TILE
    if bound < ECHO_SHARE * len(words):
        return False
    return tiled_share(words, theirs) >= ECHO_SHARE


def refuses(text: str) -> bool:
    """Most of the text declines; excuses and courtesies beside that count for neither side."""
    sentences = [s for s in re.split(r"(?<=[.!?;])\s+|\n+", text) if _SPOKEN.search(s)]
    declined = [s for s in sentences if _REFUSAL.search(s)]
    if not declined:
        return False
    rest = [s for s in sentences if s not in declined and not _COURTESY.search(s) and not _EXCUSE.search(s)]
    return sum(map(len, rest)) < sum(map(len, declined))


_FINAL = re.compile(r"([^\W_]+(?:['’\-/][^\W_]+)*)[\W_]{1,3}?([^\W_]+(?:['’\-/][^\W_]+)*)[\"”’)]*[.!?;]")
_JOINED = re.compile(r"[^\W_]+(?:['’\-/][^\W_]+)*")
_TAIL = re.compile(r"(?:([^\W_]+(?:['’\-/][^\W_]+)*)[\W_]{1,3}?)?([^\W_]+(?:['’\-/][^\W_]+)*)[\W_]*\Z")
_DANGLING = frozenset("a an the of in on at to for with from by and or but nor so if as than that which who whose when while because although though yet very my your his her its our their this these those is are was were be been has have had not no".split())


def tail_of(text: str, opened: list[str]) -> str | None:
    """How a text breaks off: its last two words for the corpus to judge, ``!`` where it is plain without the corpus, null where it ends."""
    text = text.rstrip()
    if not text:
        return "!" if opened else None
    spoken = re.sub(r"\s*\{[^{}\n]+\}\s*\Z", "", text)  # a stray tag in braces after the last sentence
    if "begun" in opened or any(x in _QUOTES for x in opened) or re.search(r"(?:…|\.\.\.)[\"”’)\]]*\Z", spoken):
        return "!"
    if re.search(r"[.!?。！？][\"”’)\]*_`]*(?:\s*</\w+>)*\Z", spoken):
        return None
    if '"' in opened or any(x in _CLOSED for x in opened):
        return "!"  # neither a last stop nor the end of the string or element: either alone would be no defect
    m = _TAIL.search(spoken)
    if not m:
        return None
    if m.group(2).lower() in _DANGLING or re.search(r"['’]s\Z", m.group(2)) or re.search(r"[,:(\-–—]\s*\Z", spoken):
        return "!"
    return f"{(m.group(1) or '').lower()} {m.group(2).lower()}"


def finals_of(text: str) -> list[str]:
    return [f"{a.lower()} {b.lower()}" for a, b in _FINAL.findall(text)]


def pairs_of(text: str, ends: bool) -> list[str]:
    """All neighbouring words of a text, in the form of ``finals_of``; the last two only where the text ends with them."""
    found = list(_JOINED.finditer(text))
    pairs = [f"{a.group().lower()} {b.group().lower()}" for a, b in zip(found, found[1:]) if b.start() - a.end() <= 3]
    return pairs if ends or not pairs or found[-1].start() - found[-2].end() > 3 else pairs[:-1]


# Words for the scores 1 to 5.
_SCORE_WORDS = {1: "one", 2: "two", 3: "three", 4: "four", 5: "five"}


def _leak_grammar(gold: int) -> re.Pattern:
    g = rf"(?:{gold}(?:\.0)?|{_SCORE_WORDS[gold]})"
    end = r"(?![\d/]|\.\d|\s*(?:of the|days|reasons|examples|sentences|paragraphs))"
    return re.compile(
        rf"\boverall\s*(?:score|rating|grade)?\s*(?:is|was|of|[:=])?\s*{g}\b{end}|\b(?:score|rating|grade|mark|level|band)\s*(?:is|was|of|at|[:=])?\s*{g}\b{end}|(?<!\d){g}\s*点|(?<![\d.])\b{g}\s*(?:/\s*5|out of (?:5|five))\b|"
        rf"\b(?:an?|the)\s+{g}\s+(?:overall|rating|score|grade)\b|\b(?:earns?|deserves?|merits?|receives?|gets?|gave it|given|rated|scored?|awarded)\s+(?:an?\s+)?(?:overall\s+)?{g}(?=\s*(?:[.,;!?\"]|\Z|overall|points?\b|stars?\b))|\b{g}\s+(?:points?|stars?)\b",
        re.I,
    )


_LEAKS = {g: _leak_grammar(g) for g in _SCORE_WORDS}


def leaks_gold(text: str, gold: int | None) -> bool:
    return leak_end(text, gold) is not None


def leak_end(text: str, gold: int | None) -> int | None:
    """Letters after the last statement of the gold score; null where there is none."""
    if gold not in _LEAKS:
        return None
    bare = re.sub(r"“[^”\n]*”", "“”", text)
    ends = [m.end() for m in _LEAKS[gold].finditer(bare)]
    return len(bare) - ends[-1] if ends else None


def judge(raw: str | None, prompt: str | None, gold: int | None, candidate: bool) -> tuple[str | None, str | None, list[str], list[str]]:
    """(defect or null, tail for the corpus to judge or null, final words of the closed sentences, all pairs of words)."""
    if raw is None:
        return "empty", None, [], []
    text, opened = parse(raw)
    text = _INVISIBLE.sub("", text).strip()
    if not _SPOKEN.search(text) or text.strip(" .!-–—*_\"'").lower() in _MARKS:
        return ("truncated" if ('"' in opened or "{" in opened) and _SPOKEN.search(raw) else "empty"), None, [], []
    if refuses(text):
        return "refusal", None, [], []
    if echoes(text, prompt):
        return "echo", None, [], []
    if mostly_foreign(text):
        return "language", None, [], []
    tail = tail_of(text, opened)
    pairs = pairs_of(text, tail is None)  # where a text breaks off says nothing about its last two words
    after = leak_end(text, gold) if candidate else None
    leak = after is not None
    if leak and after < 3:
        tail = None  # it ends with the score itself
    if tail == "!":
        return "truncated", None, finals_of(text), pairs
    return ("score_leak" if leak else None), tail, finals_of(text), pairs


def answer_records(predictions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Both tables as (``record_table``, ``target_id``, ``candidate_id``, ``prompt``, ``answer``, ``gold``)."""
    cols = lambda df, name, number: df.select(F.lit(name).alias("record_table"), F.col("target_id").cast("string").alias("target_id"), number.alias("candidate_id"), F.col("prompt").cast("string").alias("prompt"), F.col("raw_model_output").cast("string").alias("answer"), F.col("gold_overall").cast("int").alias("gold"))
    return cols(predictions, "phase1_predictions", F.lit(0)).unionByName(
        cols(candidates, "reference_candidates_unverified", F.coalesce(F.regexp_extract(F.col("candidate_id").cast("string"), r"(\d+)\D*$", 1).try_cast("int"), F.lit(-1)))
    ).where("target_id IS NOT NULL")


def defective_answers(records: DataFrame) -> DataFrame:
    """(``record_table``, ``target_id``, ``candidate_id``, ``defect``): each defective record once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables, _, numbers, prompts, answers, golds = (c.to_pylist() for c in batch.columns)
            found = [judge(a, p, g, t != "phase1_predictions") for t, p, a, g in zip(tables, prompts, answers, golds)]
            said = [pa.array([f[k] for f in found], pa.string()) for k in (0, 1)]
            none = pa.nulls(len(found), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *said, none, none], names=names)
            # The pairs of the batch, counted, as rows without a record.
            closed, used = Counter(x for f in found for x in f[2]), Counter(x for f in found for x in f[3])
            counts = [pa.array(list(x), t) for x, t in ((used, pa.string()), ([closed[k] for k in used], pa.int64()), (used.values(), pa.int64()))]
            empty = [pa.nulls(len(used), t) for t in (pa.string(), pa.string(), pa.int32(), pa.string())]
            yield pa.RecordBatch.from_arrays([*empty, *counts], names=names)

    names = ["record_table", "target_id", "candidate_id", "defect", "tail", "closed", "used"]
    judged = cut_lineage(spread(records).mapInArrow(run, "record_table string, target_id string, candidate_id int, defect string, tail string, closed bigint, used bigint"))
    known = judged.where("used IS NOT NULL").groupBy("tail").agg(F.sum("closed").alias("closed"), F.sum("used").alias("used")).where(F.col("closed") >= CLOSING_SHARE * (F.col("used") + CLOSING_PRIOR)).select("tail", F.lit(True).alias("known"))
    settled = judged.where("tail IS NULL AND defect IS NOT NULL").select("record_table", "target_id", "candidate_id", "defect")
    # Enough sentences of the corpus end like this one: only the last stop is missing.
    broken = judged.where("tail IS NOT NULL AND used IS NULL").join(known, "tail", "left")
    broken = broken.select("record_table", "target_id", "candidate_id", F.when(F.col("known"), F.col("defect")).otherwise(F.lit("truncated")).alias("defect")).where("defect IS NOT NULL")
    rank = F.array_position(F.array(*(F.lit(x) for x in DEFECTS)), F.col("defect"))
    first = settled.unionByName(broken).groupBy("record_table", "target_id", "candidate_id").agg(F.min(rank).alias("rank"))
    return first.select("record_table", "target_id", "candidate_id", F.element_at(F.array(*(F.lit(x) for x in DEFECTS)), F.col("rank").cast("int")).alias("defect"))
