"""Quality rules by weak supervision.

Each rule votes good, bad or abstains on a document. Expectation-maximisation over the
counts of vote patterns of the whole corpus estimates how accurate each rule's votes are and the
share of good documents; the posterior probability of "good" then replaces all-must-pass
filtering.

Edge cases: null and empty texts have no words and fail the base check; an empty table
gives no rows; repeated rows are judged alike, once each; further columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import saved

#: Symbols that count (fixed values).
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_SYMBOL = np.isin(np.arange(256), SYMBOLS)
_END = np.isin(np.arange(256), np.frombuffer(b".!?:;\"')]", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 128)
_LEAD = (np.arange(256) & 0xC0) != 0x80

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_letter_words", "n_upper", "n_letters", "n_distinct_words"]
_SCHEMA = "doc_id long, " + ", ".join(f"{f} long" for f in FEATURES)


def _features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    n = len(offsets) - 1
    inside = ~K.SPACE[data]
    start, end, row = K.pieces(inside, offsets)
    sums = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    of_row = lambda mask: (s := sums(mask))[offsets[1:]] - s[offsets[:-1]]
    roll = K.Rolling(data)
    word = roll.spans(start, end)
    salt = row.astype(K.U64) * K.U64(0x9FB21C651E98DF25)
    repeat = np.zeros(len(word), bool)
    if len(word) >= 3:
        window, of = K.shingles(word, row, n, 3, whole=False)
        if len(window):
            at = np.flatnonzero(row[:-2] == row[2:])
            again = at[K.repeated(K.mix(window + of.astype(K.U64) * K.U64(0x9FB21C651E98DF25)))]
            for k in range(3):
                repeat[again + k] = True
    l_start, l_end, l_row = K.pieces(data != 10, offsets)
    full = sums(inside)
    has = full[l_end] > full[l_start]
    l_start, l_end, l_row = l_start[has], l_end[has], l_row[has]
    lines = K.per_row(None, l_row, n)
    kinds = np.unique(K.mix(roll.spans(l_start, l_end) + l_row.astype(K.U64) * K.U64(0x9FB21C651E98DF25)), return_index=True)[1]
    letters = sums(_LETTER[data])
    words_seen = np.unique(K.mix(word + salt), return_index=True)[1]
    return [
        K.per_row(None, row, n),
        of_row(inside & _LEAD[data]),
        of_row(_SYMBOL[data]),
        lines - K.per_row(None, l_row[kinds], n),
        K.per_row(repeat, row, n),
        lines,
        K.per_row(_END[data[l_end - 1]] if len(l_end) else None, l_row, n),
        K.per_row(letters[end] > letters[start], row, n),
        of_row(_UPPER[data]),
        of_row(_LETTER[data] & _LEAD[data]),
        K.per_row(None, row[words_seen], n),
    ]


def features(docs: DataFrame) -> DataFrame:
    """Counts for each document, one pass over bytes, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            for a, b in K.chunks(offsets):
                at = offsets[a : b + 1]
                cols = _features(data[at[0] : at[-1]], at - at[0])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], *(pa.array(c.astype(np.int64)) for c in cols)], ["doc_id", *FEATURES])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(K.lean(run), _SCHEMA)


def _ratio(a: str, b: str):
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def rules() -> dict[str, object]:
    """Votes by name: 1 good, -1 bad, 0 abstain. The thresholds are those of common web-text heuristics."""
    mean = _ratio("word_chars", "n_words")
    vote = lambda good, bad: F.when(bad, -1).when(good, 1).otherwise(0)
    return {
        "length": vote(F.col("n_words") >= 50, F.col("n_words") < 20),
        "word_length": vote((mean >= 3) & (mean <= 10), (mean < 2) | (mean > 14)),
        "symbols": vote(_ratio("n_symbols", "n_words") < 0.02, _ratio("n_symbols", "n_words") > 0.1),
        "symbol_flood": vote(_ratio("n_symbols", "n_words") < 0.05, _ratio("n_symbols", "n_words") > 0.3),
        "dup_lines": vote(_ratio("n_dup_lines", "n_lines") < 0.1, _ratio("n_dup_lines", "n_lines") > 0.3),
        "repeats": vote(_ratio("n_repeat_words", "n_words") < 0.1, _ratio("n_repeat_words", "n_words") > 0.3),
        "line_ends": vote(_ratio("n_ended_lines", "n_lines") >= 0.5, _ratio("n_ended_lines", "n_lines") < 0.1),
        "letters": vote(_ratio("n_letter_words", "n_words") >= 0.8, _ratio("n_letter_words", "n_words") < 0.6),
        "capitals": vote(_ratio("n_upper", "n_letters") < 0.2, _ratio("n_upper", "n_letters") > 0.5),
        "variety": vote(_ratio("n_distinct_words", "n_words") >= 0.2, (F.col("n_words") >= 50) & (_ratio("n_distinct_words", "n_words") < 0.1)),
    }


#: Where EM starts, and the weak prior that it keeps: probabilities of the votes -1, 0, 1 for a bad and a good document.
START = {"bad": (0.25, 0.1, 0.65), "good": (0.01, 0.04, 0.95)}
#: The prior's weight, as a share of each class.
PRIOR = 0.3


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> tuple[float, list[list[float]]]:
    """EM for the share of good documents and each rule's votes given the class.

    patterns: vote patterns with their counts, at most 3 ** rules of them. Returns the share and, for each rule, its
    log-odds of "good" after the votes -1, 0 and 1. A rule is taken to be better than chance (a vote for bad is
    never evidence of good, nor the other way round, and an abstention is no evidence), which fixes which class is "good".
    """
    if not patterns:
        return 0.9, []
    k = len(patterns[0][0])
    votes = np.array([p for p, _ in patterns], int).reshape(-1, k)
    counts = np.array([c for _, c in patterns], float)
    prior = np.array([START["bad"], START["good"]])
    share, table = 0.9, np.repeat(prior[:, None, :], k, 1)
    odds = _odds(table)
    for _ in range(rounds):
        logit = np.log(share / (1 - share)) + odds[np.arange(k), votes + 1].sum(1)
        good = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
        share = float(np.clip((counts @ good + 9) / (counts.sum() + 10), 0.05, 0.99))
        for c, weight in enumerate((counts * (1 - good), counts * good)):
            for v in range(3):
                table[c, :, v] = (weight @ (votes == v - 1) + (PRIOR * weight.sum() + 1) * prior[c, v]) / ((1 + PRIOR) * weight.sum() + 1)
        odds = _odds(table)
    return share, odds.tolist()


def _odds(table: np.ndarray) -> np.ndarray:
    odds = np.log(table[1] / table[0])
    return np.stack([np.minimum(odds[:, 0], 0), np.zeros(len(odds)), np.maximum(odds[:, 2], 0)], 1)


def judge(docs: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, quality (posterior in [0, 1]) and kept.

    The driver gets vote patterns with counts only: at most 3 ** 10 rows at any input size.
    """
    votes = rules()
    counted = saved(features(docs))  # read twice, and far smaller than the texts
    voted = counted.withColumn("votes", F.concat(*(F.lpad((v + 1).cast("string"), 1, "0") for v in votes.values())))
    seen = sorted((tuple(int(x) - 1 for x in r["votes"]), r["count"]) for r in voted.groupBy("votes").count().collect())
    share, odds = fit(seen)
    logit = F.lit(math.log(share / (1 - share)))
    for (bad, _, good), v in zip(odds, votes.values(), strict=False):
        logit = logit + F.when(v < 0, bad).when(v > 0, good).otherwise(0.0)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        counted.withColumn("base_failed", failed)
        .withColumn("quality", 1 / (1 + F.exp(-logit)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_at))
    )


def all_patterns(k: int) -> Iterator[tuple[int, ...]]:
    """Every vote pattern of k rules."""
    return itertools.product((-1, 0, 1), repeat=k)
