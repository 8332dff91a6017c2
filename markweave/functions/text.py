"""Text features as JVM expressions; similarity scores over Arrow batches, where nested array functions would cost the square of a text's length."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words as letters, digits, underscores and inner apostrophes, whatever the script.
WORD = r"[\p{L}\p{N}_]([\p{L}\p{N}_']*[\p{L}\p{N}_])?"
TOKEN = r"([\p{L}\p{N}_]+)"


def character_count(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit("")))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD))


def sentence_count(text: Column) -> Column:
    """Runs of stops; one for a text that has none but isn't blank."""
    t = F.coalesce(text, F.lit(""))
    n = F.regexp_count(t, F.lit(r"[.!?]+"))
    return F.when((n == 0) & t.rlike(r"[^\s\p{Z}]"), F.lit(1)).otherwise(n)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


def leaks_score(reasoning: Column, score: Column) -> Column:
    """Whether a rationale names a score: alone, before the counter for points, or after ``score`` or ``overall``."""
    hit = F.lit(False)
    for s in range(1, 6):
        grammar = rf"(?i)((^|[^\p{{L}}\p{{N}}_]){s}($|[^\p{{L}}\p{{N}}_]))|({s}\s*点)|(score\s*[:=]?\s*{s})|(overall\s*[:=]?\s*{s})"
        hit = F.when(score == s, reasoning.rlike(grammar)).otherwise(hit)
    return F.coalesce(hit, F.lit(False))


_TOKENS = re.compile(r"\w+")


def token_list(text: str | None) -> list[str]:
    return _TOKENS.findall((text or "").lower())


def _flat(lists: list[list[str]], ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of all lists side by side, and the list of each."""
    flat = np.fromiter((ids.setdefault(w, len(ids)) for words in lists for w in words), dtype=np.int64)
    return flat, np.repeat(np.arange(len(lists)), [len(x) for x in lists])


def _common(left: np.ndarray, right: np.ndarray, grams: int, rows: int) -> np.ndarray:
    """For each row, how many grams of one side the other has too, each as often as both have it. Keys are row * grams + gram."""
    (a, n), (b, m) = np.unique(left, return_counts=True), np.unique(right, return_counts=True)
    both, at, of = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return np.bincount(both // grams, weights=np.minimum(n[at], m[of]), minlength=rows)


def similarities(hypotheses: list[list[str]], references: list[list[str]], orders: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Sentence BLEU and unigram F1 of every pair of token lists, for the whole batch at once.

    BLEU is the geometric mean over orders of (common + 1) / (n-grams + 1), less what a hypothesis that isn't longer lacks in
    length; both are 0 where either side is empty, F1 also where nothing is common.
    """
    rows, ids = len(hypotheses), {}
    sides = [_flat(lists, ids) for lists in (hypotheses, references)]
    size = [np.bincount(row, minlength=rows) for _, row in sides]
    gram = [tokens for tokens, _ in sides]
    logs, first = np.zeros(rows), np.zeros(rows)
    for n in range(1, orders + 1):
        if n > 1:
            # A gram of this order is one of the order before and the token after it; both sides number them alike.
            longer = [g[: max(0, len(g) - 1)] * len(ids) + tokens[n - 1 :][: max(0, len(g) - 1)] for g, (tokens, _) in zip(gram, sides)]
            number = np.unique(np.concatenate(longer), return_inverse=True)[1]
            gram = [number[: len(longer[0])], number[len(longer[0]) :]]
        grams = 1 + max((int(g.max()) for g in gram if len(g)), default=0)
        whole = [row[: len(g)] == row[n - 1 :][: len(g)] for g, (_, row) in zip(gram, sides)]
        keys = [(row[: len(g)] * grams + g)[w] for g, w, (_, row) in zip(gram, whole, sides)]
        common = _common(*keys, grams, rows)
        logs += np.log((common + 1) / (np.maximum(size[0] - n + 1, 0) + 1))
        first = common if n == 1 else first
    said = (size[0] > 0) & (size[1] > 0)
    lacking = np.where(said & (size[0] <= size[1]), 1 - size[1] / np.maximum(size[0], 1), 0.0)
    return np.where(said, np.exp(logs / orders + lacking), 0.0), 2 * first / np.maximum(size[0] + size[1], 1)


def rouge1(hypothesis: list[str], reference: list[str]) -> float:
    return float(similarities([hypothesis], [reference])[1][0])


def bleu(hypothesis: list[str], reference: list[str], orders: int = 4) -> float:
    return float(similarities([hypothesis], [reference], orders)[0][0])


_SIMILARITY = T.StructType([T.StructField("bleu", T.DoubleType()), T.StructField("rouge1_f1", T.DoubleType())])


def _similarities(hypotheses: pd.Series, references: pd.Series) -> pd.DataFrame:
    scores = similarities([token_list(h) for h in hypotheses], [token_list(r) for r in references])
    return pd.DataFrame(dict(zip(("bleu", "rouge1_f1"), scores)), dtype=float)


def similarity(hypothesis: Column | str, reference: Column | str) -> Column:
    """Struct of ``bleu`` and ``rouge1_f1`` of two texts."""
    return F.pandas_udf(_similarities, _SIMILARITY)(hypothesis, reference)
