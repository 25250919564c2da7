"""Words and word windows of many texts at once, as arrays, inside tasks.

Texts are joined into one buffer of bytes; word borders, word hashes and window
hashes then take a fixed number of array steps. Hashes have 64 bits. Buffers are
worked on in pieces of about ``PIECE`` bytes, so memory follows the words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

PIECE = 1 << 20
_SPACE = 32
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = pow(0x9E3779B97F4A7C15, 1, 1 << 64)
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def byte_table(is_word, lower: bool) -> bytes:
    """A translation table: bytes outside words become spaces, A-Z lower case."""
    table = bytearray(256)
    for b in range(256):
        c = b + 32 if lower and 0x41 <= b <= 0x5A else b
        table[b] = c if is_word(c) else _SPACE
    return bytes(table)


def not_blank(b: int) -> bool:
    return not (b == 0x20 or 0x09 <= b <= 0x0D)


def alphanumeric(b: int) -> bool:
    return 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the argument."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of a list of texts: byte positions, hashes, and where each text's begin."""

    _up = _powers(_BASE, 2 * PIECE + 2)
    _down = _powers(_BASE_INVERSE, 2 * PIECE + 2)

    def __init__(self, texts: Sequence[bytes | None], table: bytes):
        raw = b"\n" + b"\n".join([t or b"" for t in texts]) + b"\n"
        lengths = np.fromiter((len(t or b"") for t in texts), dtype=np.int64, count=len(texts))
        self.text_start = np.concatenate(([1], 1 + np.cumsum(lengths + 1)))
        self.bytes = raw.translate(table)
        self.array = np.frombuffer(self.bytes, dtype=np.uint8)
        inside = (self.array != _SPACE).view(np.int8)
        borders = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = borders[0::2], borders[1::2]
        self.first = np.searchsorted(self.start, self.text_start)  # of each text; one more at the end
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.count)

    def hashes(self) -> np.ndarray:
        """A hash per word, of its bytes."""
        out = np.empty(len(self.start), dtype=np.uint64)
        word = 0
        while word < len(self.start):
            begin = self.start[word]
            stop = max(int(np.searchsorted(self.end, begin + PIECE, side="right")), word + 1)
            finish = self.end[stop - 1]
            n = finish - begin
            if n <= 2 * PIECE:
                up, down = self._up, self._down
            else:  # a single very long word
                up, down = _powers(_BASE, n + 1), _powers(_BASE_INVERSE, n + 1)
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTE[self.array[begin:finish]] * up[:n], out=sums[1:])
            at, till = self.start[word:stop] - begin, self.end[word:stop] - begin
            out[word:stop] = mixed((sums[till] - sums[at]) * down[at] + (till - at).astype(np.uint64))
            word = stop
        return out

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (first words) and hashes of all windows that lie in one text."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        total = np.zeros(n, dtype=np.uint64)
        for i in range(size):
            total += hashes[i : i + n] * (_PLACE[i % 64] + np.uint64(2 * (i // 64)))
        at = np.flatnonzero(self.text[:n] == self.text[size - 1 :])
        return at, mixed(total[at])

    def window_bytes(self, position: int, size: int) -> bytes:
        """The words of a window, joined by single spaces."""
        return b" ".join(self.bytes[self.start[i] : self.end[i]] for i in range(position, position + size))


def in_pieces(texts: Sequence[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``PIECE`` bytes together, a long text on its own."""
    begin, total = 0, 0
    for i, text in enumerate(texts):
        n = len(text or b"")
        if i > begin and total + n > PIECE:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(texts):
        yield begin, len(texts)


def slices(batch, most: int = PIECE):
    """Slices of an Arrow batch with about ``most`` bytes of text together, a long text on its own."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield batch.slice(begin)


def utf8(column) -> list[bytes | None]:
    """An Arrow column of texts as bytes."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()
