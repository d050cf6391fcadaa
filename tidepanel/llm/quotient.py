"""A counting quotient filter over 64-bit fingerprints, kept in sorted order.

A fingerprint is split into a quotient (its upper bits) and a remainder (the rest). Per
filter: one bit per quotient that occurs, one bit per remainder that ends the run of its
quotient, the remainders in order, and their counts. Nothing of the fingerprint is lost,
so filters merge without loss by merging their sorted remainders and adding the counts.
"""

from __future__ import annotations

import numpy as np


class CountingQuotientFilter:
    """``first`` is the block's lowest fingerprint, ``bits`` the bits left below it."""

    def __init__(self, bits: int, quotient_bits: int, values: np.ndarray, counts: np.ndarray):
        self.bits, self.quotient_bits = bits, min(quotient_bits, bits)
        self.remainder_bits = bits - self.quotient_bits
        quotients = values >> np.uint64(self.remainder_bits)
        ends = np.append(quotients[1:] != quotients[:-1], True)[: len(values)]
        self.occupied = np.zeros(1 << self.quotient_bits, bool)
        self.occupied[quotients.astype(np.int64)] = True
        self.run_ends = ends
        width = np.uint32 if self.remainder_bits <= 32 else np.uint64
        self.remainders = (values & np.uint64((1 << self.remainder_bits) - 1)).astype(width)
        self.counts = counts.astype(np.uint32 if counts.max(initial=0) < 1 << 32 else np.uint64)

    @classmethod
    def build(cls, values: np.ndarray, bits: int, quotient_bits: int) -> CountingQuotientFilter:
        """Of the lower ``bits`` of each fingerprint."""
        return cls(bits, quotient_bits, *np.unique(values, return_counts=True))

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints (lower bits) in order, and their counts."""
        quotients = np.flatnonzero(self.occupied).astype(np.uint64)
        runs = np.append(0, np.cumsum(self.run_ends))[:-1] if len(self.run_ends) else np.zeros(0, int)
        high = quotients[runs] << np.uint64(self.remainder_bits) if len(runs) else np.zeros(0, np.uint64)
        return high | self.remainders.astype(np.uint64), self.counts.astype(np.int64)

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Both filters' entries in one; equal remainders of a quotient add their counts."""
        (a, n), (b, m) = self.entries(), other.entries()
        both = np.concatenate([a, b])
        order = np.argsort(both, kind="stable")  # two sorted runs: a merge
        both, counts = both[order], np.concatenate([n, m])[order]
        starts = np.flatnonzero(np.append(True, both[1:] != both[:-1])[: len(both)])
        summed = np.add.reduceat(counts, starts) if len(starts) else counts
        return CountingQuotientFilter(self.bits, self.quotient_bits, both[starts], summed)

    def to_bytes(self) -> bytes:
        head = np.array([self.bits, self.quotient_bits, len(self.remainders), self.counts.itemsize], "<i8")
        return b"".join(
            [head.tobytes(), np.packbits(self.occupied).tobytes(), np.packbits(self.run_ends).tobytes(), self.remainders.tobytes(), self.counts.tobytes()]
        )

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        bits, quotient_bits, n, size = np.frombuffer(data, "<i8", 4).tolist()
        self = cls.__new__(cls)
        self.bits, self.quotient_bits, self.remainder_bits = bits, quotient_bits, bits - quotient_bits
        width, at = np.dtype(np.uint32 if self.remainder_bits <= 32 else np.uint64), 32
        slots = (1 << quotient_bits) + 7 >> 3
        self.occupied = np.unpackbits(np.frombuffer(data, np.uint8, slots, at), count=1 << quotient_bits).astype(bool)
        at += slots
        self.run_ends = np.unpackbits(np.frombuffer(data, np.uint8, n + 7 >> 3, at), count=n).astype(bool)
        at += n + 7 >> 3
        self.remainders = np.frombuffer(data, width, n, at)
        self.counts = np.frombuffer(data, f"<u{size}", n, at + n * width.itemsize)
        return self
