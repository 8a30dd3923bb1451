"""Words, lines and hashes of many texts at once, with numpy on UTF-8 bytes.

Texts are joined into blocks of about a megabyte, a line feed behind each, so that one array
operation covers many short texts and a long text gets a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BLOCK = 1 << 20
SPACES = b" \t\n\x0b\x0c\r"

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
# Letters, digits and everything beyond ASCII, after lower-casing.
_ALNUM = np.zeros(256, bool)
_ALNUM[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_ALNUM[128:] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.cumprod(np.full(1 << 16, _BASE, np.uint64))
_HIGH = [np.uint64(1)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(longest: int) -> np.ndarray:
    if longest <= len(_LOW):
        return _LOW[:longest]
    while len(_HIGH) * len(_LOW) < longest:
        _HIGH.append(_HIGH[-1] * _LOW[-1])
    return (np.array(_HIGH, np.uint64)[:, None] * _LOW[None, :]).ravel()[:longest]


class Block:
    """Consecutive texts: their bytes, and where each text begins in them."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.starts = np.concatenate([[0], np.cumsum(lengths)])  # one more than texts
        self.n = len(texts)

    def per_text(self, at: np.ndarray) -> np.ndarray:
        """Number of the ascending positions `at` in each text."""
        return np.diff(np.searchsorted(at, self.starts))

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def sums(self, flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.starts[1:]] - total[self.starts[:-1]]

    def runs(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the maximal runs of bytes that `member` marks."""
        inside = member[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate([[0], edge])
        return edge[::2], edge[1::2]  # the last byte is a line feed, so every run ends

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One 64-bit hash for each piece of bytes, equal for equal pieces; pieces are disjoint."""
        lengths = ends - starts
        full = lengths > 0
        out = np.zeros(len(starts), np.uint64)
        if full.any():
            length = lengths[full]
            first = np.concatenate([[0], np.cumsum(length)])[:-1]
            inner = np.arange(int(length.sum())) - np.repeat(first, length)
            value = self.data[np.repeat(starts[full], length) + inner].astype(np.uint64)
            value = (value + np.uint64(1)) * _powers(int(length.max()))[inner]
            out[full] = np.add.reduceat(value, first)
        return mix(out + lengths.astype(np.uint64))


def blocks(texts: Iterable[bytes], size: int = BLOCK) -> Iterator[Block]:
    held, total = [], 0
    for text in texts:
        held.append(text)
        total += len(text) + 1
        if total >= size:
            yield Block(held)
            held, total = [], 0
    if held:
        yield Block(held)


def utf8(texts: Iterable[str | None]) -> Iterator[bytes]:
    """Null counts as empty."""
    for text in texts:
        yield b"" if text is None else text.encode("utf-8", "surrogatepass")


def plain_words(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Runs of anything but ASCII white space."""
    return block.runs(~_SPACE)


def alnum_words(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters, digits and non-ASCII characters; the texts are lower-cased already."""
    return block.runs(_ALNUM)


def windows(hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and index of each `width` consecutive words that belong to one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[:n] == owner[width - 1 :])
    total = np.zeros(len(at), np.uint64)
    for k in range(width):
        total = mix(total * np.uint64(3) + hashes[at + k])
    return total, at
