"""Reading level of texts that are only roughly graded.

Method: interpolated n-gram models (word unigrams and bigrams) are trained on all texts, on those with low and on those
with high grades, in two halves of the texts, and every text is read with the models of the other half, so that no text
vouches for its own grade. A document's surprisal distribution follows, sentence by sentence: the bits of each sentence, and
how many bits fewer the high model needs than the low one, over at most ``SENTENCE`` words of a sentence. The median of the
latter over the document is mapped monotonically to the graded difficulty by isotonic regression (pool adjacent violators),
and the fitted grades give the level.

The models hold every n-gram that any text can look up: one that stands in one half only is unseen by the texts that hold it,
as they are read with the other half, so n-grams of both halves are all there is to keep. Up to ``HELD`` of them, the most
frequent, are broadcast. Where there are more, the rest go by join to blocks of texts that ask for them, so that no count is
left out at any size. Every task counts its own texts first; n-grams are then summed by key. The regression sees a histogram of
fixed bins, not rows. Texts are read twice (count, score), and shuffled, once, only where n-grams are joined.

Defined results: null and blank texts have no level; repeated rows of one text are scored once per row id and text;
grades outside 1..5 or missing train nothing but are scored; ties share a bin; with no grades at all the difficulty is
null; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markweave.session import cut_lineage, spread

#: N-grams that are broadcast at most, 56 bytes each; others are joined to the texts.
HELD = 1 << 20
#: Cells by which keys are found (a power of two), and words of a block of texts that n-grams are joined to.
CELLS, BLOCK_WORDS = 1 << 20, 2_000_000
#: N-grams that a task keeps before it hands them on.
TASK_NGRAMS = 1_000_000
#: Grades up to the first train the low model, from the second the high one.
LOW, HIGH = 2.5, 4.0
#: Shares of unigram and bigram estimates, and the pseudo-count of a unigram among so many words.
MIX, PSEUDO, VOCABULARY = (0.35, 0.65), 0.1, 1 << 17
#: Words of a sentence that its contrast is taken over at most: a text without stops doesn't gain by length.
SENTENCE = 30
#: Bits per histogram bin and the number of bins to either side.
BIN, BINS = 1.0, 2000
#: Rows that a fitted block needs at least; thin bins join their nearer neighbour first.
BLOCK_ROWS = 10
#: Fitted grades at which the levels 2, 3, 4 and 5 begin; the last is the grade from which texts train the high model.
LEVEL_EDGES = (2.5, 3.0, 3.5, HIGH)
#: The limits of the most demanding level: words per sentence and letters per word.
DEMANDING = (24.0, 6.5)
MODELS, FOLDS = 3, 2  # all, low, high; halves of the texts

ABBREVIATIONS = "Mr Mrs Ms Dr Prof Rev Gen Col St Jr Sr vs etc e.g i.e cf approx ca No Nr Vol pp Fig Inc Ltd Co U.S U.K a.m p.m".split()
_DOTTED = [f"{x}." for x in ABBREVIATIONS]
_ABBREVIATION = re.compile(rf"\b(?:{'|'.join(map(re.escape, ABBREVIATIONS))})\.(?=\s|,|$)")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+(?:[.,]\d+)*|[.!?。！？]+")
_STOPS = frozenset(".!?。！？")


class _Codes(dict):
    """Token -> 32-bit code; 0 for sentence ends."""

    def __missing__(self, token: str) -> int:
        code = self[token] = 0 if token[0] in _STOPS else zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) | 1
        return code


def _tokens(text: str) -> list[str]:
    if any(x in text for x in _DOTTED):
        text = _ABBREVIATION.sub(lambda m: m.group().replace(".", ""), text)
    return _TOKEN.findall(text)


class Batch:
    """Token codes of the distinct texts of a batch, side by side."""

    def __init__(self, texts: list[str], codes: _Codes):
        if len(codes) > 500_000:
            codes.clear()
        tokens: list[str] = []
        ends = [0]
        for text in texts:
            own = _tokens(text)
            tokens += own
            ends.append(len(tokens))
        self.codes = np.array([codes[x] for x in tokens], dtype=np.uint64)
        self.ends = np.array(ends)
        self.stop = self.codes == 0
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.ends))
        lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        lengths[self.stop] = 0
        n = len(texts)
        self.words = np.bincount(self.doc[~self.stop], minlength=n)
        self.letters = np.bincount(self.doc, weights=lengths, minlength=n)
        # A sentence is a stretch of words that a stop or the text's end closes.
        closes = np.zeros(len(self.codes), dtype=bool)
        if len(self.codes):
            last = np.append(self.doc[1:] != self.doc[:-1], True)
            after = np.append(self.stop[1:], True)
            closes = ~self.stop & (after | last)
        self.sentences = np.bincount(self.doc[closes], minlength=n)
        first = np.concatenate([[True], self.doc[1:] != self.doc[:-1]]) if len(self.codes) else np.zeros(0, bool)
        before = np.concatenate([[np.uint64(0)], self.codes[:-1]]) if len(self.codes) else self.codes
        before = np.where(first, np.uint64(0), before)
        word = ~self.stop
        self.word_doc = self.doc[word]
        #: Sentence of every word, its document, and the words of each sentence.
        edge = np.flatnonzero(closes[word])
        self.word_sentence = np.zeros(int(word.sum()), dtype=np.int64)
        self.word_sentence[edge[:-1] + 1] = 1
        self.word_sentence = np.cumsum(self.word_sentence)
        self.sentence_doc = self.word_doc[edge]
        self.sentence_words = np.diff(np.concatenate([[-1], edge]))
        codes, before = self.codes[word], before[word]
        #: Keys of the unigram, the bigram and the bigram's first word of every word.
        self.uni, self.first = _key(codes * _UNI), _key(before * _FIRST + np.uint64(1))
        self.bi = _key((before * _FIRST) ^ (codes * _SECOND))


_UNI, _FIRST, _SECOND = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _key(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _fold(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % FOLDS


def _graded(essays: DataFrame, row_col: str, text_col: str, grade_cols: tuple[str, ...]) -> DataFrame:
    parts = [F.col(c).cast("double") for c in grade_cols]
    valid = [F.when((c >= 1) & (c <= 5), c) for c in parts]
    grade = sum(valid[1:], valid[0]) / F.lit(float(len(valid)))
    text = F.col(text_col).cast("string")
    return essays.select(F.col(row_col).alias("row"), text.alias("text"), grade.alias("grade")).where(F.col("text").rlike(r"[\p{L}\p{N}]"))


class Models:
    """Counts of n-grams (``counts`` by fold and model, then n-gram) and the words each model has seen."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, words: np.ndarray):
        n = len(keys)
        #: One beyond the last n-gram is the unseen one.
        self.keys = np.append(keys.view(np.uint64), np.uint64(0))
        self.counts = np.append(counts, np.zeros((FOLDS * MODELS, 1)), axis=1)
        self.words = words
        #: The n-gram found at each cell, and those whose cell another has, in order.
        self.at = np.full(CELLS, n, dtype=np.int32)
        self.at[_cell(self.keys[:n])] = np.arange(n)
        rest = np.flatnonzero(self.at[_cell(self.keys[:n])] != np.arange(n))
        self.rest = rest[np.argsort(self.keys[rest])]
        self.rest_keys = self.keys[self.rest]

    def of(self, key: np.ndarray) -> np.ndarray:
        """The number of each key's n-gram; one beyond the last where the models don't have it."""
        at = self.at[_cell(key)]
        other = np.flatnonzero(self.keys[at] != key)
        at[other] = len(self.keys) - 1
        if len(self.rest):
            key = key[other]
            place = np.minimum(np.searchsorted(self.rest_keys, key), len(self.rest) - 1)
            same = self.rest_keys[place] == key
            at[other[same]] = self.rest[place[same]]
        return at

    def holds(self, key: np.ndarray) -> np.ndarray:
        return self.of(key) < len(self.keys) - 1

    def with_more(self, keys: np.ndarray, counts: np.ndarray) -> Models:
        return Models(np.concatenate([self.keys[:-1], keys.view(np.uint64)]), np.concatenate([self.counts[:, :-1], counts], axis=1), self.words)

    def bits(self, b: Batch, fold: np.ndarray) -> list[np.ndarray]:
        """Surprisal of every word under each interpolated model of the other half; ``fold`` is that of the word's text."""
        uni, first, bi = self.of(b.uni), self.of(b.first), self.of(b.bi)
        out = []
        for m in range(MODELS):
            row = ((fold + 1) % FOLDS) * MODELS + m
            n = lambda at: self.counts[row, at]  # noqa: E731, B023
            p1 = (n(uni) + PSEUDO) / (self.words[row] + PSEUDO * VOCABULARY)
            p2 = np.minimum(n(bi) / np.maximum(n(first), 1), 1)
            out.append(-np.log2(MIX[0] * p1 + MIX[1] * p2))
        return out


def _cell(key: np.ndarray) -> np.ndarray:
    return (key & np.uint64(CELLS - 1)).astype(np.int64)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.concatenate([c for _, c in parts], axis=1)
    return keys, np.stack([np.bincount(at, weights=c, minlength=len(keys)) for c in counts])


def train(graded: DataFrame, held: int = HELD) -> tuple[Models, DataFrame | None]:
    """The models of both halves with the ``held`` most frequent n-grams or somewhat fewer, and the table of all others, if any."""
    columns = [f"n{k}" for k in range(FOLDS * MODELS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, parts, held = _Codes(), [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            keys, counts = _summed(parts)
            for k in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100_000].view(np.int64)), *(pa.array(c[k : k + 100_000].astype(np.int64)) for c in counts)], names=["key", *columns])

        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                texts, grades = part.column(0).to_pylist(), part.column(1).to_pylist()
                own: dict[str, int] = {}
                weight: list[list[int]] = []
                for text, grade in zip(texts, grades):
                    i = own.setdefault(text, len(own))
                    if i == len(weight):
                        weight.append([0] * (FOLDS * MODELS))
                    at = _fold(text) * MODELS
                    weight[i][at] += 1
                    if grade is not None:
                        weight[i][at + 1] += grade <= LOW
                        weight[i][at + 2] += grade >= HIGH
                b = Batch(list(own), codes)
                times = np.array(weight, dtype=np.float64).T[:, b.word_doc]
                total = np.zeros(1, dtype=np.uint64), times.sum(axis=1)[:, None]  # key 0: the words of each model
                parts.append(_summed([(x, times) for x in (b.uni, b.first, b.bi)] + [total]))
                held += len(parts[-1][0])
                if held > TASK_NGRAMS:
                    parts = [_summed(parts)]
                    held = len(parts[0][0])
                    if held > TASK_NGRAMS // 2:
                        yield from emit()
                        parts, held = [], 0
        if parts:
            yield from emit()

    sums = graded.select("text", "grade").mapInArrow(run, "key bigint, " + ", ".join(f"{c} bigint" for c in columns)).groupBy("key").agg(*(F.sum(c).alias(c) for c in columns))
    often = [F.col(f"n{f * MODELS}") for f in range(FOLDS)]
    met = (F.col("key") == 0) | (F.least(*often) > 0)
    table = cut_lineage(sums.where(met).withColumn("often", F.floor(8 * F.log2(sum(often[1:], often[0]))).cast("int")))
    # N-grams by frequency in steps of an eighth of a doubling: from which step on are there no more than may be held?
    sizes = sorted(((r.often, r.n) for r in table.where("key <> 0").groupBy("often").agg(F.count("*").alias("n")).collect()), reverse=True)
    least, kept = 1 << 30, 0
    for step, n in sizes:
        kept += n
        if kept > held:
            break
        least = step
    mine = table.where((F.col("key") == 0) | (F.col("often") >= least)).drop("often").toArrow()  # at most ``held`` rows and the words' one
    keys = mine.column("key").to_numpy()
    counts = np.stack([mine.column(c).to_numpy() for c in columns]).astype(np.float64)
    others = table.where((F.col("key") != 0) & (F.col("often") < least)).drop("often") if kept > held else None
    return Models(keys[keys != 0], counts[:, keys != 0], counts[:, keys == 0].sum(axis=1)), others


def _quantile(values: np.ndarray, group: np.ndarray, q: float, groups: int) -> np.ndarray:
    """The value at share ``q`` of each group's values in order; 0 for a group without any."""
    order = np.lexsort((values, group))
    size = np.bincount(group, minlength=groups)
    at = np.cumsum(size) - size + np.floor(q * np.maximum(size - 1, 0)).astype(np.int64)
    return np.where(size > 0, np.append(values[order], 0.0)[np.minimum(at, len(values))], 0.0)


_MEASURES = ("contrast", "mean_bits", "sentence_bits_p10", "sentence_bits_p50", "sentence_bits_p90", "words_per_sentence", "letters_per_word")


def _measures(texts: list[str], models: Models, codes: _Codes) -> list[np.ndarray]:
    """The measures of each text; equal texts are read once."""
    own: dict[str, int] = {}
    at = np.array([own.setdefault(x, len(own)) for x in texts], dtype=np.int64)
    b = Batch(list(own), codes)
    docs = len(own)
    bits = models.bits(b, np.array([_fold(x) for x in own], dtype=np.int64)[b.word_doc])
    size = b.sentence_words
    sums = [np.bincount(b.word_sentence, weights=x, minlength=len(size)) for x in (bits[0], bits[1] - bits[2])]
    contrast = _quantile(sums[1] / size * np.minimum(size, SENTENCE), b.sentence_doc, 0.5, docs)
    mean = np.bincount(b.word_doc, weights=bits[0], minlength=docs) / np.maximum(b.words, 1)
    spread = [_quantile(sums[0], b.sentence_doc, q, docs) for q in (0.1, 0.5, 0.9)]
    return [v[at].astype(np.float64) for v in (contrast, mean, *spread, b.words / np.maximum(b.sentences, 1), b.letters / np.maximum(b.words, 1))]


def score(graded: DataFrame, models: Models, others: DataFrame | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per input row: surprisal and lengths. ``others``: the n-grams that ``models`` doesn't hold."""
    shared = graded.sparkSession.sparkContext.broadcast(models)
    schema = f"row {graded.schema['row'].dataType.simpleString()}, grade double, " + ", ".join(f"{x} double" for x in _MEASURES)

    def read(batch: pa.RecordBatch, own: Models, codes: _Codes) -> Iterator[pa.RecordBatch]:
        for k in range(0, batch.num_rows, 1000):
            part = batch.slice(k, 1000)
            values = _measures(part.column("text").to_pylist(), own, codes)
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("grade"), *map(pa.array, values)], names=["row", "grade", *_MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, own = _Codes(), shared.value
        for batch in batches:
            yield from read(batch, own, codes)

    if others is None:
        return graded.mapInArrow(run, schema)

    # Blocks of texts ask for the n-grams they hold, and are read with those that are found.
    blocks = int(models.words[::MODELS].sum()) // block_words + 1
    placed = graded.withColumn("block", F.pmod(F.xxhash64("row", "text"), F.lit(blocks)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held = _Codes(), shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                own = list(dict.fromkeys(zip(part.column(0).to_pylist(), part.column(1).to_pylist())))
                b = Batch([text for text, _ in own], codes)
                block = np.array([x for _, x in own], dtype=np.int64)[b.word_doc]
                keys, block = np.concatenate([b.uni, b.first, b.bi]), np.tile(block, 3)
                new = ~held.holds(keys)
                keys, block = keys[new], block[new]
                order = np.lexsort((keys, block))
                keys, block = keys[order], block[order]
                once = np.concatenate([[True], (keys[1:] != keys[:-1]) | (block[1:] != block[:-1])]) if len(keys) else new[:0]
                yield pa.RecordBatch.from_arrays([pa.array(block[once]), pa.array(keys[once].view(np.int64))], names=["block", "key"])

    found = placed.select("text", "block").mapInArrow(ask, "block bigint, key bigint").join(others, "key")

    def read_block(texts: pa.Table, ngrams: pa.Table) -> pa.Table:
        keys, first = np.unique(ngrams.column("key").to_numpy(), return_index=True)
        counts = np.stack([ngrams.column(f"n{k}").to_numpy()[first] for k in range(FOLDS * MODELS)]).astype(np.float64)
        own, codes = shared.value.with_more(keys, counts), _Codes()
        names = ["row", "grade", *_MEASURES]
        empty = pa.RecordBatch.from_arrays([pa.array([], texts.schema.field(x).type if x in ("row", "grade") else pa.float64()) for x in names], names=names)
        return pa.Table.from_batches([empty, *(x for batch in texts.to_batches() for x in read(batch, own, codes))])

    return placed.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(read_block, schema)


def isotonic(blocks: list[tuple[float, float, float]]) -> list[tuple[float, float]]:
    """Pool adjacent violators over (x, sum of y, weight) in order of x: (first x of the block, fitted y), y never falling."""
    pooled: list[list[float]] = []
    for x, y, w in blocks:
        pooled.append([x, y, w])
        while len(pooled) > 1 and pooled[-2][1] * pooled[-1][2] >= pooled[-1][1] * pooled[-2][2]:
            _, y1, w1 = pooled.pop()
            pooled[-1][1] += y1
            pooled[-1][2] += w1
    return [(x, y / w) for x, y, w in pooled]


def fit(scored: DataFrame, block_rows: int = BLOCK_ROWS) -> list[tuple[int, float]]:
    """(first bin, fitted grade) of each block; the bins' sums are all the driver sees."""
    bin_ = _bin(F.col("contrast"))
    sums = scored.where("grade IS NOT NULL").groupBy(bin_.alias("bin")).agg(F.sum("grade").alias("y"), F.count("*").alias("w")).orderBy("bin").collect()  # at most 2 * BINS + 1
    joined = [[r.bin, r.bin, r.y, r.w] for r in sums]
    while len(joined) > 1 and (thin := min(range(len(joined)), key=lambda k: joined[k][3])) is not None and joined[thin][3] < block_rows:
        # A thin block joins the neighbour that is nearer, so that blocks don't grow over gaps.
        left = joined[thin][0] - joined[thin - 1][1] if thin else float("inf")
        right = joined[thin + 1][0] - joined[thin][1] if thin + 1 < len(joined) else float("inf")
        k = thin - 1 if left <= right else thin
        x, y = joined[k], joined[k + 1]
        joined[k : k + 2] = [[x[0], y[1], x[2] + y[2], x[3] + y[3]]]
    return [(int(x), y) for x, y in isotonic([(x, y, w) for x, _, y, w in joined])]


def _bin(x):
    return F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(x / BIN).cast("int")))


def reading_levels(essays: DataFrame, row_col: str = "source_row_id", text_col: str = "Text", grade_cols: tuple[str, ...] = ("Vocabulary", "Syntax"), held: int = HELD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(``row_col``, surprisal measures, ``difficulty``, ``level``, ``words_per_sentence``, ``letters_per_word``), each row id and text once."""
    graded = spread(_graded(essays, row_col, text_col, grade_cols))
    scored = cut_lineage(score(graded, *train(graded, held), block_words))
    blocks = fit(scored)
    difficulty = F.lit(None).cast("double")
    if blocks:
        b = _bin(F.col("contrast"))
        starts, fitted = F.array(*(F.lit(x) for x, _ in blocks)), F.array(*(F.lit(y) for _, y in blocks))
        difficulty = F.element_at(fitted, F.greatest(F.lit(1), F.size(F.filter(starts, lambda s: s <= b))))
    level = F.lit(1)
    for edge in LEVEL_EDGES:
        level = level + F.when(F.col("difficulty") >= edge, 1).otherwise(0)
    once = scored.drop("grade").distinct().withColumn("difficulty", difficulty)
    return once.withColumn("level", F.when(F.col("difficulty").isNotNull(), level)).withColumnRenamed("row", row_col)


def most_demanding(levels: DataFrame) -> DataFrame:
    """Texts of the top level, with an exact check of the averages: sentences and words are both longer than the limits."""
    return levels.where((F.col("level") == len(LEVEL_EDGES) + 1) & (F.col("words_per_sentence") > DEMANDING[0]) & (F.col("letters_per_word") > DEMANDING[1]))


def level_quality(levels: DataFrame) -> DataFrame:
    """(``demanding``, ``top_level``, ``both``): texts beyond both limits, texts of the top level, and texts that are both; recall and precision of the level alone."""
    long = (F.col("words_per_sentence") > DEMANDING[0]) & (F.col("letters_per_word") > DEMANDING[1])
    top = F.coalesce(F.col("level") == len(LEVEL_EDGES) + 1, F.lit(False))
    return levels.agg(F.count_if(long).alias("demanding"), F.count_if(top).alias("top_level"), F.count_if(long & top).alias("both"))
