"""Wavelet matrices over whole arrays: ranks of symbols, and intervals by subtree."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """A sequence of numbers below 2**depth as one row of bits for each binary digit, the highest first.

    Each level holds the sequence sorted, stably, by the digits before it (the last of them
    counts most), so a node of the tree (numbers with the same leading digits) is an interval
    of a level, and elements of a node keep their order. ones[level, i]: set bits of the level before i.
    """

    def __init__(self, values: np.ndarray, depth: int, carry: np.ndarray | None = None):
        """carry: numbers that travel with the elements; ``carried[level]`` has them in the level's order."""
        self.n, self.depth = len(values), max(1, depth)
        self.ones = np.zeros((self.depth, self.n + 1), np.int32)
        self.zeros = np.zeros(self.depth, np.int64)
        self.carried = None if carry is None else np.empty((self.depth + 1, self.n), carry.dtype)
        for level in range(self.depth):
            if carry is not None:
                self.carried[level] = carry
            bit = (values >> (self.depth - 1 - level)) & 1
            np.cumsum(bit, out=self.ones[level, 1:])
            self.zeros[level] = self.n - self.ones[level, -1]
            down = bit == 0
            values = np.concatenate([values[down], values[~down]])
            if carry is not None:
                carry = np.concatenate([carry[down], carry[~down]])
        if carry is not None:
            self.carried[self.depth] = carry

    def child(self, level: np.ndarray | int, at: np.ndarray, bit: np.ndarray | int) -> np.ndarray:
        """Bounds of intervals in the next level, given theirs in a level and the digit to follow."""
        ones = self.ones[level, at]
        return np.where(bit, self.zeros[level] + ones, at - ones)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        first = np.zeros(len(symbol), np.int64)
        for level in range(self.depth):
            bit = (symbol >> (self.depth - 1 - level)) & 1
            first, at = self.child(level, first, bit), self.child(level, at, bit)
        return at - first

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at places."""
        out = np.zeros(len(at), np.int64)
        for level in range(self.depth):
            bit = self.ones[level, at + 1] - self.ones[level, at]
            out = out * 2 + bit
            at = self.child(level, at, bit)
        return out
