"""Elias-Fano coding of a rising list of offsets, with select samples.

n + 1 offsets up to u take about n * (2 + log2(u / n)) bits: the low l bits of
each, packed, and a bit vector with a one at position (offset >> l) + i for
the i-th. select(i) starts from the sampled position of every SAMPLE-th one.
"""

from __future__ import annotations

import numpy as np

#: Ones between select samples, and offsets whose low bits are packed at once (a multiple of 8).
SAMPLE, AT_ONCE = 256, 1 << 14


def encode(offsets: np.ndarray) -> dict:
    """offsets: rising unsigned 64-bit values, at least one."""
    offsets = offsets.astype(np.uint64)
    n, top = len(offsets), int(offsets[-1])
    low_bits = max(0, ((top + 1) // n).bit_length() - 1)
    places = (offsets >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    upper = np.zeros((int(places[-1]) // 64 + 1) * 64, dtype=np.uint8)
    upper[places] = 1
    shifts = np.arange(low_bits, dtype=np.uint64)[None, :]
    low = [np.packbits(((offsets[i:i + AT_ONCE, None] >> shifts).astype(np.uint8) & 1).reshape(-1), bitorder="little") for i in range(0, n, AT_ONCE)]
    return {"n": n, "low_bits": low_bits, "upper": np.packbits(upper, bitorder="little").view("<u8"), "low": np.concatenate(low), "samples": places[::SAMPLE].astype("<u4" if places[-1] < 2**32 else "<u8")}


class Offsets:
    """Reads what encode() made."""

    def __init__(self, n: int, low_bits: int, upper: np.ndarray, low: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.upper, self.low, self.samples = n, low_bits, upper, low, samples

    def select(self, i: int, count: int = 1) -> np.ndarray:
        """Positions of the count ones from the i-th."""
        start = int(self.samples[i // SAMPLE])
        skip, word = i % SAMPLE, start // 64
        out, have = [], 0
        first = self.upper[word:word + 1] & ~np.uint64((1 << (start % 64)) - 1)
        while have < skip + count:
            chunk = first if first is not None else self.upper[word:word + 64]
            ones = np.flatnonzero(np.unpackbits(np.ascontiguousarray(chunk).view(np.uint8), bitorder="little")) + word * 64
            word, first = word + len(chunk), None
            out.append(ones)
            have += len(ones)
        return np.concatenate(out)[skip:skip + count]

    def get(self, i: int, count: int = 1) -> np.ndarray:
        """The count offsets from the i-th."""
        high = self.select(i, count) - np.arange(i, i + count)
        if not self.low_bits:
            return high
        a, z = i * self.low_bits, (i + count) * self.low_bits
        bits = np.unpackbits(self.low[a // 8:(z + 7) // 8], bitorder="little")[a % 8:a % 8 + z - a].reshape(count, self.low_bits)
        return (high << self.low_bits) | (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
