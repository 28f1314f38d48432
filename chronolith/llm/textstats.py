"""Counts of a whole text, shared by the quality rules and the quality classifier."""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import count

import numpy as np

#: Symbols that prose rarely has (fixed values).
SYMBOLS = b"#*$%&|<>"
#: Character classes: the columns of the class histogram.
CLASSES = ("lower", "upper", "digit", "blank", "newline", "stop", "mark", "symbol", "other", "beyond")
_class = np.full(256, 8)
_class[0x61:0x7B], _class[0x41:0x5B], _class[0x30:0x3A] = 0, 1, 2
_class[[0x20, 0x09, 0x0B, 0x0C, 0x0D]], _class[0x0A] = 3, 4
for _c in b".,;:":
    _class[_c] = 5
for _c in b"!?'\"()-":
    _class[_c] = 6
for _c in SYMBOLS:
    _class[_c] = 7
_class[0x80:] = 9
_into = np.zeros((256, len(CLASSES)), np.int64)
_into[np.arange(256), _class] = 1
_into[0x80:0xC0] = 0  # bytes that continue a code point are not counted
_white = np.zeros(256, bool)
_white[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def class_counts(text: bytes) -> np.ndarray:
    """Code points of each of CLASSES."""
    return np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _into


def numbered(words: list[bytes]) -> tuple[np.ndarray, dict[bytes, int]]:
    """The number of each word, by first occurrence."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words)), number


def repeated_words(ids: np.ndarray, distinct: int) -> tuple[int, int]:
    """Words in three-word windows that occur twice or more; words equal to the one before."""
    n = len(ids)
    twice = int((ids[1:] == ids[:-1]).sum())
    if n < 4:
        return 0, twice
    pair = ids[:-1] * distinct + ids[1:]
    if distinct > 2_000_000:  # three numbers would not fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * distinct + ids[2:]
    order = np.argsort(window)
    same = window[order[1:]] == window[order[:-1]]
    hit = np.zeros(n, bool)
    for at in (order[1:][same], order[:-1][same]):
        for k in range(3):
            hit[at + k] = True
    return int(hit.sum()), twice


def repeated_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line; lines with a word."""
    seen = Counter(line for line in text.split(b"\n") if line and not line.isspace())
    total = sum(seen.values())
    return total - len(seen), total


def base(text: bytes, words: list[bytes]) -> tuple[dict[str, int], np.ndarray, dict[bytes, int]]:
    """The base counts of the quality rules, the class histogram, and how often each word occurs."""
    classes = class_counts(text)
    ids, number = numbered(words)
    again, twice = repeated_words(ids, len(number))
    lines_again, lines = repeated_lines(text)
    return {
        "n_words": len(words),
        "word_chars": int(classes.sum() - classes[3] - classes[4]),
        "n_symbols": int(classes[7]),
        "n_dup_lines": lines_again,
        "n_repeat_words": again,
        "n_distinct": len(number),
        "n_twice": twice,
        "n_lines": lines,
    }, classes, dict(zip(number, np.bincount(ids, minlength=len(number)).tolist()))
