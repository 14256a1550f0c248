"""Statistics of one text, for the quality operators."""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np

WINDOW = 5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: The columns that the base rules are made of.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the models see.
FEATURES = ("log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "mark_share", "capital_share", "digit_share", "distinct_share", "words_per_line", "short_share", "comma_share", "pipe_share", "same_next_share")


def base_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    return _measure(text or "")[0]


def _measure(text: str) -> tuple[tuple[int, int, int, int, int], list[bytes]]:
    words = text.encode("utf-8", "surrogatepass").split()
    word_chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (len(words), word_chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)), words


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a run of window words that the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    shifted = [words[i:] for i in range(window)]
    if len(set(zip(*shifted))) == n:
        return 0
    runs = Counter(zip(*shifted))
    twice = np.fromiter((runs[r] > 1 for r in zip(*shifted)), np.int64, n)
    return int(np.count_nonzero(np.convolve(twice, np.ones(window, np.int64))))


def statistics(text: str | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """The base statistics, and FEATURES; a text without words has features of 0."""
    text = text or ""
    base, words = _measure(text)
    n_words, word_chars, n_symbols, n_dup, n_repeat = base
    if not n_words:
        return base, [0.0] * len(FEATURES)
    lines = 1 + text.count("\n")
    distinct = set(words)
    per_char = 1.0 / max(1, word_chars)
    return base, [
        float(np.log1p(n_words)),
        word_chars / n_words,
        n_symbols * per_char,
        n_dup / lines,
        n_repeat / n_words,
        sum(map(text.count, "!?")) * per_char,
        sum(map(bytes.isupper, words)) / n_words,
        sum(map(text.count, "0123456789")) * per_char,
        len(distinct) / n_words ** 0.8,
        n_words / lines,
        sum(1 for w in words if len(w) < 4) / n_words,
        sum(map(text.count, ".,;:")) / n_words,
        text.count("|") / n_words,
        sum(map(eq, words, words[1:])) / n_words,
    ]
