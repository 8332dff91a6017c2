"""Evaluation passages that leak into a training corpus.

Method: both sides are canonicalised into templates (numbers, names and units become typed placeholders), template
windows are joined by hash, and the slots of joined templates are compared: documents whose slots agree hold the
item itself (``leaked``), documents whose wording agrees but whose slots do not hold a re-parameterised question
(``reparameterised``). An exact alignment of the words follows and measures the longest run of a passage that the
document holds with at most one changed word in ten. A window of almost nothing but placeholders is joined by its words.

The passages are the query side. What a word stands for is decided once, over all passages (the ``VOCABULARY`` most frequent
words of them; rarer ones and words of no passage count as names and stay different words), so results don't hang on how passages are grouped. Their
windows are built on the driver in blocks of ``BLOCK_WORDS`` words. Where one block holds all, the corpus is read once, against
it; where there are more, one pass with a sieve of all windows' hashes (2 MB at any size) writes out the documents that any
window may touch, and only these are read again for each block. Lines that several different passages share are instructions
and are taken out first, by a count over all passages; where they are most of a passage they are the passage itself and stay.

Defined results: null, empty and blank texts or passages match nothing; repeated documents and repeated passages are
reported one by one; ties (several runs of one item) give the longest run; extra columns are ignored. No caps.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markweave.session import cut_lineage, spread

#: Words in a row that make a case, and the share of them that may be changed.
MIN_RUN, CHANGED = 20, 0.1
#: Words of a template window; 20 words with 2 changed ones always hold an unchanged window of so many.
WINDOW = 6
#: A window with fewer plain words than this is too general as a template; it is joined by its words.
MIN_PLAIN = 2
#: A line that stands in so many passages is an instruction.
SHARED_LINE = 3
#: Words of the passages of one block; a worker holds some 40 bytes for each.
BLOCK_WORDS = 4_000_000
#: Words that are told apart, over all passages.
VOCABULARY = 1 << 20
#: Bits (as a power of two) of a sieve of window hashes.
SIEVE = 24

# Words that count as numbers or units.
NUMBER_WORDS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
UNIT_WORDS = (
    "millimeter millimeters millimetre millimetres centimeter centimeters centimetre centimetres meter meters metre metres kilometer kilometers kilometre kilometres inch inches foot feet yard yards mile miles "
    "milligram milligrams gram grams kilogram kilograms ton tons tonne tonnes ounce ounces pound pounds milliliter milliliters millilitre millilitres liter liters litre litres gallon gallons mm cm m km mg g kg ml l "
    "second seconds minute minutes hour hours day days week weeks month months year years degree degrees percent dollar dollars cent cents euro euros"
).split()
#: Template codes of the typed placeholders; plain words count from 4.
_NUM, _NAME, _UNIT, _PLAIN = 1, 2, 3, 4

_TAG = re.compile(r"<[!/?]?[A-Za-z][^<>]*>")
_HIDDEN = re.compile(r"[­​-‏⁠﻿]")
_BROKEN_LINE = re.compile(r"(?<=\w)-[ \t]*\r?\n[>\s]*(?=\w)")
_MARKS = re.compile(r"[̀-ͯ]")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Words apart from case, punctuation, markup and layout; a word broken at a line's end is one."""
    if "-" in text and "\n" in text:
        text = _BROKEN_LINE.sub("", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _HIDDEN.sub("", text)
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text.lower())


def shared_lines(passages: DataFrame, text_col: str = "text", least: int = SHARED_LINE) -> DataFrame:
    """(``line``, ``n``): lines that at least ``least`` different passages share."""
    lines = passages.select(text_col).distinct().select(F.explode(F.array_distinct(F.transform(F.split(F.col(text_col), r"\R"), lambda x: F.trim(F.lower(x))))).alias("line"))
    return lines.where("line <> ''").groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def without_instructions(text: str, shared: set[str]) -> str:
    """A passage less its instruction lines, unless these are most of it."""
    lines = re.split(r"\r\n|\r|\n", text)
    kept = "\n".join(x for x in lines if x.strip().lower() not in shared)
    return kept if 2 * len(words_of(kept)) >= len(words_of(text)) else "\n".join(lines)


def bare_passages(passages: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(``i``, ``t``): passages less the lines that they share."""
    rows = passages.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("i"), F.col(item_text).cast("string").alias("t"))
    lines = rows.select("t").distinct().select("t", F.explode(F.transform(F.split("t", r"\R"), lambda x: F.trim(F.lower(x)))).alias("line"))
    shared = lines.join(shared_lines(rows, "t"), "line").groupBy("t").agg(F.collect_set("line").alias("shared"))
    both = rows.join(shared, "t", "left").select("i", "t", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bare = [without_instructions(t, set(x or ())) for t, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bare, pa.string())], names=["i", "t"])

    return both.mapInArrow(run, f"i {rows.schema['i'].dataType.simpleString()}, t string")


def word_types(bare: DataFrame, most: int = VOCABULARY) -> dict[str, int]:
    """Type of each of the ``most`` frequent words of all passages: a placeholder's code, or ``_PLAIN``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text in batch.column(0).to_pylist():
                for w in words_of(text):
                    seen.setdefault(w, [0, 0, 0])[0] += 1
                for m in _WORD.finditer(text):
                    opens = text[: m.start()].rstrip(" “\"'(")[-1:] in ("", ".", "!", "?", ":", "\n", "\r")
                    x = seen.setdefault(m.group().lower(), [0, 0, 0])
                    x[1] += m.group()[0].isupper() and not opens
                    x[2] += not m.group()[0].isupper()
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([x[k] for x in seen.values()], pa.int64()) for k in range(3))], names=["word", "n", "upper", "lower"])

    counts = bare.select("t").mapInArrow(run, "word string, n bigint, upper bigint, lower bigint").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "upper", "lower"))).where("n > 0")
    types: dict[str, int] = {}
    for r in counts.orderBy(F.desc("n"), "word").limit(most).toLocalIterator():
        if r.word.isdigit() or r.word in _NUMBERS:
            types[r.word] = _NUM
        elif r.word in _UNITS:
            types[r.word] = _UNIT
        else:
            types[r.word] = _NAME if r.upper and not r.lower else _PLAIN
    return types


class Words:
    """Codes of the passages' words and the template code of each; code 0 is any other word, which stands for a name."""

    def __init__(self, types: dict[str, int]):
        self.codes = {w: k for k, w in enumerate(types, 1)}
        #: A plain word's template code is its own.
        self.template = np.array([_NAME, *(t if t < _PLAIN else _PLAIN + k for k, t in enumerate(types.values(), 1))], dtype=np.int64)

    def of(self, words: list[str]) -> list[int]:
        get = self.codes.get
        return [get(x, 0) for x in words]

    def extended(self, words: set[str]) -> Words:
        """With codes of its own for rarer words, which are names as well; so that a block's words are told apart however many there are."""
        rare = sorted(words - self.codes.keys())
        if not rare:
            return self
        out = Words({})
        out.codes = self.codes | {w: k for k, w in enumerate(rare, len(self.template))}
        out.template = np.concatenate([self.template, np.full(len(rare), _NAME, dtype=np.int64)])
        return out

    def windows(self, word: np.ndarray) -> np.ndarray:
        """64-bit hash of every window: of its template, or of its words where these are almost all placeholders."""
        t = self.template[word]
        plain = np.concatenate([[0], np.cumsum(t >= _PLAIN)])
        general = plain[WINDOW:] - plain[:-WINDOW] < MIN_PLAIN
        h = _window_hashes(t)
        if general.any():
            h = np.where(general, _window_hashes(word + (1 << 40)), h)
        return h


class Sieve:
    """One bit per hash prefix; rejects most windows of a corpus without a search."""

    def __init__(self) -> None:
        self.bits = np.zeros(1 << (SIEVE - 3), dtype=np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        at = hashes >> np.uint64(64 - SIEVE)
        np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - SIEVE)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class PassageIndex:
    """Windows of one block of passages."""

    def __init__(self, items: list[tuple[int, list[int]]], words: Words):
        self.words = words
        self.ids = [i for i, _ in items]
        self.passages = [np.array(p, dtype=np.int64) for _, p in items]
        self.template = words.template
        long = [(k, p) for k, p in enumerate(self.passages) if len(p) >= WINDOW]
        h = np.concatenate([words.windows(p) for _, p in long]) if long else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.owners = np.concatenate([np.full(len(p) - WINDOW + 1, k) for k, p in long])[order] if long else np.zeros(0, np.int64)
        self.places = np.concatenate([np.arange(len(p) - WINDOW + 1) for _, p in long])[order] if long else np.zeros(0, np.int64)
        self.sieve = Sieve()
        self.sieve.add(self.hashes)

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, float, int]]:
        """(row, item id, longest run, longest run of the template, share of agreeing slots) of each pair with a joined template."""
        word, ends = _coded(texts, self.words)
        if len(word) < WINDOW or not len(self.hashes):
            return
        h = self.words.windows(word)
        at = np.flatnonzero(self.sieve.passes(h))
        lo = np.searchsorted(self.hashes, h[at], "left")
        hi = np.searchsorted(self.hashes, h[at], "right")
        at, lo, hi = (x[hi > lo] for x in (at, lo, hi))
        ends_a = ends
        row = np.searchsorted(ends_a, at, "right") - 1
        inside = at + WINDOW <= ends_a[row + 1]
        at, lo, hi, row = (x[inside] for x in (at, lo, hi, row))
        if not len(at):
            return
        n = hi - lo
        hit = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        rows, where = np.repeat(row, n), np.repeat(at, n)
        owner, shift = self.owners[hit], where - self.places[hit]
        # (row, item) pairs with their alignments; shift = place in the document less place in the passage.
        order = np.lexsort((shift, owner, rows))
        rows, owner, shift = rows[order], owner[order], shift[order]
        new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (owner[1:] != owner[:-1])]))
        for a, b in zip(new, np.append(new[1:], len(rows))):
            r, k = int(rows[a]), int(owner[a])
            passage, document = self.passages[k], word[ends_a[r] : ends_a[r + 1]]
            yield r, self.ids[k], *best_run(passage, document, np.unique(shift[a:b]) - ends_a[r], self.template)


def _coded(texts: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray]:
    codes: list[int] = []
    ends = [0]
    for text in texts:
        if text:
            codes += words.of(words_of(text))
        ends.append(len(codes))
    return np.array(codes, dtype=np.int64), np.array(ends)


def touched(docs: DataFrame, words: Words, sieve: Sieve) -> DataFrame:
    """Documents (``doc_id``, ``text``) with a window that the sieve lets pass. One map-only pass."""
    shared = docs.sparkSession.sparkContext.broadcast((words, sieve))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bits = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                word, ends = _coded(part.column(1).to_pylist(), own)
                keep = np.zeros(part.num_rows, dtype=bool)
                if len(word) >= WINDOW:
                    at = np.flatnonzero(bits.passes(own.windows(word)))
                    row = np.searchsorted(ends, at, "right") - 1
                    keep[row[at + WINDOW <= ends[row + 1]]] = True
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def _window_hashes(t: np.ndarray) -> np.ndarray:
    """64-bit hash of every window of template codes."""
    x = (t.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    n = len(t) - WINDOW + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        h = h * np.uint64(0x94D049BB133111EB) + x[k : k + n]
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def best_run(passage: np.ndarray, document: np.ndarray, shifts: np.ndarray, template: np.ndarray) -> tuple[int, int, float]:
    """Longest run of passage words held in a row with at most ``CHANGED`` changed, the same for template codes, and the share of slots that agree.

    Alignments whose shifts differ by at most three are read together, so that a dropped or added word costs one change.
    """
    n, best, best_template, slots = len(passage), 0, 0, 0.0
    if not n:
        return 0, 0, 0.0
    place = np.arange(n)
    groups = np.split(shifts, np.flatnonzero(np.diff(shifts) > 3) + 1)
    for group in groups:
        equal = np.zeros(n, dtype=bool)
        aligned = np.zeros(n, dtype=bool)
        for s in group:
            at = place + s
            ok = (at >= 0) & (at < len(document))
            same = np.zeros(n, dtype=bool)
            same[ok] = document[at[ok]] == passage[ok]
            like = np.zeros(n, dtype=bool)
            like[ok] = template[document[at[ok]]] == template[passage[ok]]
            if len(group) > 1:  # a lone equal word of another alignment is chance
                same, like = same & _in_runs(same, 3), like & _in_runs(like, 3)
            equal |= same
            aligned |= like
        best, best_template = max(best, longest(equal)), max(best_template, longest(aligned))
        if (slot := aligned & (template[passage] < _PLAIN)).any():
            slots = max(slots, float((equal & slot).sum() / slot.sum()))
    return best, best_template, slots


def _in_runs(same: np.ndarray, least: int) -> np.ndarray:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
    out = np.zeros(len(same), dtype=bool)
    for a, b in zip(edges[::2], edges[1::2]):
        if b - a >= least:
            out[a:b] = True
    return out


def longest(equal: np.ndarray) -> int:
    """Longest stretch that begins and ends with an equal word and has at most one changed word in ten."""
    best = 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], equal.astype(np.int8), [0]])))
    starts, stops = edges[::2].tolist(), edges[1::2].tolist()
    for i, a in enumerate(starts):
        wrong = 0
        for j in range(i, len(stops)):
            if j > i:
                wrong += starts[j] - stops[j - 1]
            length = stops[j] - a
            if wrong <= CHANGED * length:
                best = max(best, length)
    return best


_NUMBERS, _UNITS = frozenset(NUMBER_WORDS), frozenset(UNIT_WORDS)


def _blocks(bare: DataFrame, block_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Passages as words, in blocks of at most ``block_words`` words (a single longer one is a block of its own)."""
    block: list[tuple[int, list[str]]] = []
    size = 0
    for r in bare.toLocalIterator():
        own = words_of(r.t)
        if block and size + len(own) > block_words:
            yield block
            block, size = [], 0
        block.append((r.i, own))
        size += len(own)
    yield block


def leaked_passages(
    documents: DataFrame,
    passages: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
    vocabulary: int = VOCABULARY,
) -> DataFrame:
    """(``doc_id``, ``item_id``, ``run`` int, ``template_run`` int, ``slot_share`` double, ``verdict`` string): pairs that share a template.

    ``verdict`` is ``leaked`` (a run of at least 20 words), ``reparameterised`` (such a run of the template, whose slots
    mostly disagree) or ``touch``. The corpus is read in one map-only pass; nothing of it is shuffled.
    """
    spark = documents.sparkSession
    docs = spread(documents.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).cast("string").alias("text")).where(F.col("text").isNotNull()))
    bare = cut_lineage(bare_passages(passages, item_id, item_text))
    words = Words(word_types(bare, vocabulary))
    kinds = docs.schema["doc_id"].dataType.simpleString(), bare.schema["i"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, run int, template_run int, slot_share double"
    item_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kinds[1]]

    def scan(texts: DataFrame, block: list[tuple[int, list[str]]]) -> DataFrame:
        own_words = words.extended({w for _, x in block for w in x})
        index = spark.sparkContext.broadcast(PassageIndex([(i, own_words.of(x)) for i, x in block], own_words))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = index.value
            for batch in batches:
                for k in range(0, batch.num_rows, 500):
                    part = batch.slice(k, 500)
                    found = list(own.search(part.column(1).to_pylist()))
                    cols = list(zip(*found)) if found else [[]] * 5
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], item_type), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.float64())],
                        names=["doc_id", "item_id", "run", "template_run", "slot_share"],
                    )

        return texts.mapInArrow(run, schema)

    blocks = _blocks(bare, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        out = scan(docs, first)
    else:
        sieve = Sieve()
        for block in chain([first, second], blocks):
            for _, x in block:
                if len(x) >= WINDOW:
                    sieve.add(words.windows(np.array(words.of(x), dtype=np.int64)))
        suspects = cut_lineage(touched(docs, words, sieve))
        out = None
        for block in _blocks(bare, block_words):
            part = cut_lineage(scan(suspects, block))
            out = part if out is None else out.unionByName(part)
    verdict = F.when(F.col("run") >= MIN_RUN, "leaked").when((F.col("template_run") >= MIN_RUN) & (F.col("slot_share") < 0.5), "reparameterised").otherwise("touch")
    return out.withColumn("verdict", verdict)
