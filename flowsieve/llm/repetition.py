"""Quality rules by repetition coverage.

Words become numbers and n-grams rolling hashes of them, for several lengths at once.  A
document's share of characters inside n-grams and lines that it has shown before is held
against a limit per length.  Each row is judged by itself, in numpy, over its whole text.

Null and empty texts have no words and fail the base rules, an empty table gives no row, and whole texts are
read, however long.  Repeated rows get equal results.
Only ``text`` is read; the measures replace columns of the same names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"

# Fewest words, and the most per cent of them in repeated three-word windows.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BASE_LENGTH = 3

# Most characters, as a share of those in words, inside n-grams seen before; and inside lines seen before.
COVERAGE_LIMITS = {5: 0.30, 8: 0.25, 12: 0.22}
LINE_LIMIT = 0.30

_STEP = np.uint64(0x9E3779B97F4A7C15)
MEASURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "dup_line_share double, dup_gram_share array<double>"
)


def _mixed(numbers: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values, different for different numbers."""
    x = numbers.astype(np.uint64) * _STEP
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _seen(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose value occurs twice or more, and those among them that are not the first."""
    order = np.argsort(hashes, kind="stable")
    equal = hashes[order][1:] == hashes[order][:-1]
    again = order[1:][equal]
    return np.union1d(order[:-1][equal], again) if len(again) else again, again


def _covered(places: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``length`` words that starts at one of ``places``."""
    if not len(places):
        return np.zeros(n, bool)
    change = np.bincount(places, minlength=n + 1) - np.bincount(places + length, minlength=n + 1)
    return np.cumsum(change)[:n] > 0


def measure(text: str | None, lengths: tuple[int, ...]) -> tuple:
    """One document's ``MEASURES``."""
    text = text or ""
    words = text.encode().split()  # bytes split at ASCII white space only
    n = len(words)
    word_chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    known: set[str] = set()
    repeated = repeated_chars = 0
    for line in lines:
        if line in known:
            repeated += 1
            repeated_chars += len(line) - sum(map(line.count, BLANKS))
        known.add(line)
    numbers: dict[bytes, int] = {}
    ids = _mixed(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n) + 1)
    # Continuation bytes add no character.
    chars = np.fromiter((len(w) if w.isascii() else len(w.decode()) for w in words), np.int64, n)
    repeat_words, shares, rolling, length = 0, [], ids.copy(), 1
    for wanted in sorted({BASE_LENGTH, *lengths}):
        while length < wanted and length < n:
            rolling = rolling[:-1] * _STEP + ids[length:]
            length += 1
        if n < wanted:
            shares += [0.0] * (wanted in lengths)
            continue
        every, again = _seen(rolling)
        if wanted == BASE_LENGTH:
            repeat_words = int(_covered(every, wanted, n).sum())
        if wanted in lengths:
            shares.append(float(chars[_covered(again, wanted, n)].sum() / word_chars))
    return n, word_chars, symbols, repeated, repeat_words, repeated_chars / word_chars if word_chars else 0.0, shares


def with_rules(docs: DataFrame, *, limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """``docs`` with its measures, ``base_failed`` and ``kept``."""
    limits = dict(sorted((COVERAGE_LIMITS if limits is None else limits).items()))
    lengths = tuple(limits)

    @F.pandas_udf(MEASURES)
    def measures(texts: pd.Series) -> pd.DataFrame:
        names = [part.split()[0] for part in MEASURES.split(", ")]
        return pd.DataFrame([measure(t, lengths) for t in texts], columns=names)

    names = [part.split()[0] for part in MEASURES.split(", ")]
    others = [F.col(f"`{c}`") for c in docs.columns if c not in {*names, "base_failed", "kept"}]
    rows = docs.select(*others, measures(F.col("text")).alias("__measures")).select(*others, "__measures.*")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    over = F.col("dup_line_share") > line_limit
    for i, limit in enumerate(limits.values()):
        over = over | (F.col("dup_gram_share")[i] > limit)
    return rows.withColumn("base_failed", base).withColumn("kept", ~base & ~over)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that pass, in its columns."""
    marked = with_rules(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), "text"), **options)
    return marked.where("kept").select("d.*")
