"""Statistics of whole texts for the quality operators (3 and 5)."""

from __future__ import annotations

import numpy as np

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Names of the columns of ``statistics``; the first five are what the rules count.
NAMES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "symbols_per_word", "dup_line_share", "repeat_share", "word_length", "upper_share", "digit_share",
    "exclaim_per_word", "distinct_share", "words_per_line", "punctuation_share", "other_share", "log_words", "same_neighbour_share",
)


def counts(text: str) -> tuple[int, int, int, int, int, list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the words. bytes.split() knows the same white space."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, WHITE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            seen, twice = set(), set()
            for w in windows:
                (twice if w in seen else seen).add(w)
            hit = np.zeros(n, bool)
            at = np.array([k for k, w in enumerate(windows) if w in twice])
            for k in range(3):
                hit[at + k] = True
            repeat = int(hit.sum())
    return n, chars, symbols, dup, repeat, words


def statistics(text: str) -> tuple[list[float], np.ndarray]:
    """The values of ``NAMES``, and how often each byte occurs."""
    n, chars, symbols, dup, repeat, words = counts(text)
    bytes_ = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    upper, digit = int(bytes_[65:91].sum()), int(bytes_[48:58].sum())
    letters = upper + int(bytes_[97:123].sum())
    wide = int(bytes_[128:].sum())
    plain = int(bytes_[33:127].sum())
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = text.count("\n") + 1
    one = max(n, 1)
    return [
        n, chars, symbols, dup, repeat,
        symbols / one, dup / lines, repeat / one, chars / one, upper / max(letters, 1), digit / max(chars, 1),
        int(bytes_[33]) / one, len(set(words)) / one, n / lines, (plain - letters - digit) / max(plain, 1), wide / max(len(text), 1), float(np.log1p(n)), same / one,
    ], bytes_
