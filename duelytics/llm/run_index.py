"""A run-length index of many short strings: the Burrows-Wheeler transform as runs, with the
suffix positions at the beginnings and ends of runs as samples.

From the samples alone the matching statistics of the whole text stream in text order: at the
beginning of a run the longest match with the suffix that sorts before is measured, behind it the
match only gets shorter by one and its partner moves on by one. In a repetitive text there are few
runs, and so few measurements.
"""

from __future__ import annotations

import numpy as np

LIMIT = 1 << 21            # positions of one index; three ranks then fit 63 bits
FIRST = 7                  # symbols of 9 bits in the first sort key


class RunIndex:
    def __init__(self, strings: list[bytes]):
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        if lengths.sum() + len(strings) > LIMIT:
            raise ValueError("too long for one index")
        # Symbols: a byte plus one; 0 ends a string.
        joined = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        text = joined.astype(np.uint64) + np.uint64(1)
        ends = np.cumsum(lengths + 1) - 1
        text[ends] = 0
        self.text, self.n, self.starts = joined, len(text), ends - lengths
        self.left = np.repeat(ends, lengths + 1) - np.arange(self.n)     # bytes up to the string's end
        suffixes, self.ranks = self._sorted(text, int(lengths.max(initial=0)))

        before = text[suffixes - 1]                                      # the transform
        opening = np.zeros(self.n, bool)
        opening[self.starts] = True
        first = opening[suffixes]
        heads = np.ones(self.n, bool)
        heads[1:] = (before[1:] != before[:-1]) | first[1:] | first[:-1]
        rows = np.flatnonzero(heads)
        self.run_symbols = before[rows].astype(np.uint16)
        self.run_lengths = np.diff(np.append(rows, self.n))
        self.run_starts = suffixes[rows]                                 # sampled at the head of each run
        self.run_ends = suffixes[np.append(rows[1:], self.n) - 1]        # and at its end

    def _sorted(self, text: np.ndarray, longest: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Suffixes in order, equal ones by position; ranks by the first 7, 21, 63, ... symbols."""
        n, one = self.n, np.uint64(1)
        inside = self.left
        key = np.zeros(n, np.uint64)
        for k in range(FIRST):
            shifted = np.zeros(n, np.uint64)
            shifted[: max(0, n - k)] = text[k:]
            shifted[inside < k] = 0                                      # beyond the end
            key = (key << np.uint64(9)) | shifted
        ranks, width = [], FIRST
        while True:
            last = width > longest
            order = np.argsort(key, kind="stable" if last else None)
            found = key[order]
            rank = np.empty(n, np.uint64)
            rank[order] = np.cumsum(np.append(True, found[1:] != found[:-1]))
            ranks.append((width, rank.astype(np.int32)))
            if last:
                return order, ranks
            key = rank
            for k in (1, 2):
                ahead = np.zeros(n, np.uint64)
                ahead[: max(0, n - k * width)] = rank[k * width :]
                ahead[inside < k * width] = 0
                key = (key << np.uint64(21)) | (ahead - (ahead > 0) * one)
            width *= 3

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at a and b have in common."""
        out = np.zeros(len(a), np.int64)
        most = np.minimum(self.left[a], self.left[b])
        for width, rank in reversed(self.ranks):
            for _ in range(3):
                at = out < most
                same = np.zeros(len(a), bool)
                same[at] = rank[(a + out)[at]] == rank[(b + out)[at]]
                out += width * same
        rest = np.flatnonzero(out < most)
        # Fewer than seven equal bytes are left: one by one.
        text = self.text
        for _ in range(FIRST):
            rest = rest[text[a[rest] + out[rest]] == text[b[rest] + out[rest]]]
            out[rest] += 1
            rest = rest[out[rest] < most[rest]]
        return np.minimum(out, most)

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For every position: bytes of the longest match with the suffix sorted before it, and where
        that suffix is (-1 without a match)."""
        partner = np.append(-1, self.run_ends[:-1])
        length = np.zeros(len(partner), np.int64)
        length[1:] = self._common(self.run_starts[1:], partner[1:])
        known = np.zeros(self.n, np.int64)
        known[self.run_starts] = np.arange(1, len(partner) + 1)
        sampled = known > 0
        nearest = np.maximum.accumulate(np.where(sampled, np.arange(self.n), 0))
        run = known[nearest] - 1
        ahead = np.arange(self.n) - nearest
        match = length[run] - ahead
        return match, np.where(match > 0, partner[run] + ahead, -1)


def earliest(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For every string the starts (within it) of the `length`-byte pieces that also start at an
    earlier place: in an earlier string, or before in the same one."""
    if not strings:
        return []
    index = RunIndex(strings)
    match, partner = index.matching_statistics()
    # Suffixes that share `length` bytes are neighbours: follow the partners to the first of them.
    first = np.where(match >= length, partner, np.arange(index.n))
    while True:
        further = first[first]
        if np.array_equal(further, first):
            break
        first = further
    full = np.flatnonzero(index.left >= length)
    lowest = np.full(index.n, -1)
    lowest[first[full[::-1]]] = full[::-1]          # the smallest position is written last
    again = full[lowest[first[full]] < full]
    cuts = np.searchsorted(again, np.append(index.starts, index.n))
    return [again[a:b] - s for a, b, s in zip(cuts, cuts[1:], index.starts)]
