"""Words as fixed 64-bit numbers, and hashes of runs of words, for the Python side of the operators on words."""

from __future__ import annotations

import numpy as np
import xxhash

STEP = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)


class WordNumbers(dict):
    """Numbers of words, remembered up to a bound. Words are bytes; the number is xxh3 of the bytes."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        number = self[word] = xxhash.xxh3_64_intdigest(word)
        return number


_numbers = WordNumbers()


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as bytes; none for null. Splitting bytes cuts at just these six bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def numbers_of(words: list[bytes]) -> np.ndarray:
    """One 64-bit number for each word."""
    return np.fromiter(map(_numbers.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * MIX_1
        values = (values ^ (values >> np.uint64(27))) * MIX_2
        return values ^ (values >> np.uint64(31))


def runs_of(numbers: np.ndarray, size: int, step: np.uint64 = STEP) -> np.ndarray:
    """Hash of each run of ``size`` consecutive numbers: a polynomial built by doubling, then scrambled."""
    if len(numbers) < size:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total, done, power, width, part = None, 0, step, 1, numbers
        bits = size
        while bits:
            if bits & 1:
                if total is None:
                    total, done = part, width
                else:
                    n = min(len(total), len(part) - done)
                    total = total[:n] * power + part[done : done + n]
                    done += width
            bits >>= 1
            if bits:
                part = part[: len(part) - width] * power + part[width:]
                power = power * power
                width *= 2
        return mixed(total[: len(numbers) - size + 1])
