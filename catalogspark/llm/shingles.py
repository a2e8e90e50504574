"""Word shingle sets of texts as sorted arrays of 64-bit names."""

import numpy as np

from catalogspark.llm.byte_pairs import mixed, word_names

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block of texts, and the number of words before each text."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    ink = np.concatenate([~blank, [False]])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(ink & (edge | np.concatenate([[True], blank])))
    ends = np.flatnonzero(np.concatenate([[False], ink[:-1]]) & (edge | ~ink))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit names of words that shingles and counts go by."""
    return word_names(data, starts, ends, 11)


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Names of all runs of n words."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out = mixed(out + h[k : k + len(out)] + np.uint64(k + 1))
    return out


def few(h: np.ndarray) -> np.ndarray:
    """Name of a whole sequence that is shorter than a shingle."""
    x = np.zeros(1, np.uint64)
    for k in range(len(h)):
        x = mixed(x + h[k : k + 1] + np.uint64(1001 + k))
    return x


def sets(data: np.ndarray, offsets: np.ndarray, n: int, wide: bool = False) -> list:
    """For each text its distinct n-word shingles, A-Z lower-cased; the whole sequence if it has fewer words.

    With wide each set is a pair of arrays: the names in order, and a second, independent name of each.
    """
    data = LOWER[data]
    starts, ends, at = words(data, offsets)
    hashes = [word_hashes(data, starts, ends)] + [word_names(data, starts, ends, 12)] * wide
    runs = [rolled(h, n) for h in hashes]
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        own = [r[a : b - n + 1] for r in runs] if b - a >= n else [few(h[a:b]) if b > a else np.zeros(0, np.uint64) for h in hashes]
        if wide:
            one, first = np.unique(own[0], return_index=True)
            out.append((one, own[1][first]))
        else:
            out.append(np.unique(own[0]))
    return out
