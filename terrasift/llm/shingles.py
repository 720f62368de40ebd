"""Word shingles of whole texts as 64-bit hashes, one sorted set a text."""

from __future__ import annotations

import numpy as np

from .flat import SegmentHash, lower_ascii, mix, word_bounds

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased) and per text the index of its first word."""
    low = lower_ascii(data)
    start, end, bound = word_bounds(low, offsets)
    return SegmentHash(low).of(start, end), bound


def runs(words: np.ndarray, bound: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words inside one text, and the index of its first word."""
    if len(words) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(bound) - 1), np.diff(bound))
    first = np.flatnonzero(text[width - 1 :] == text[: len(text) - width + 1])
    key = np.zeros(len(first), np.uint64)
    for k in range(width):
        key = mix(key + words[first + k] * _ODD[k % len(_ODD)])
    return key, first


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending, and their bounds. Fewer words make one shingle, no words none."""
    words, bound = word_hashes(data, offsets)
    key, first = runs(words, bound, width)
    row = np.searchsorted(bound, first, "right") - 1
    count = np.diff(bound)
    few = np.flatnonzero((count > 0) & (count < width))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        for k in range(width - 1):
            has = count[few] > k
            short[has] = mix(short[has] + words[bound[few[has]] + k] * _ODD[k % len(_ODD)])
        short = mix(short ^ (count[few].astype(np.uint64) * _ODD[-1]))
        key, row = np.r_[key, short], np.r_[row, few]
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    key, row = key[fresh], row[fresh]
    return key, np.searchsorted(row, np.arange(len(bound)))
