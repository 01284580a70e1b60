"""64-bit hashes of the words of texts and of other stretches, as array operations.

A stretch is taken eight bytes at a time, each block through a non-linear step, so no
pattern of equal words under sums or polynomials makes hashes meet; stretches of more
than SHORT bytes, rare in texts, go through BLAKE2b. Callers that need equality of
the stretches themselves compare them: see `equal_stretches`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_U = np.uint64
PIECE = 1 << 20  # bytes that are cut into words at a time
SHORT = 64  # bytes


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


class _Blocks:
    """The bytes of an array, eight at a time from any place."""

    def __init__(self, units: np.ndarray):
        self.width = units.itemsize
        self.raw = np.concatenate([np.ascontiguousarray(units).view(np.uint8), np.zeros(8, dtype=np.uint8)])
        self.at = np.ndarray((len(self.raw) - 7,), "<u8", self.raw.data, strides=(1,))

    def block(self, begin: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Of each stretch that goes on at byte `begin` for `left` more, the next eight bytes, zeros behind its end."""
        gone = np.maximum(8 - left, 0).astype(_U) << _U(3)
        return self.at[begin] << gone >> gone


def stretch_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the (not empty) stretches from starts to ends of an array of bytes or of wider units."""
    blocks = _Blocks(units)
    begin, size = starts * blocks.width, (ends - starts) * blocks.width
    with np.errstate(over="ignore"):
        h = mix(size.astype(_U) * _U(0x9E3779B97F4A7C15))
        live, j = np.flatnonzero(size <= SHORT), 0
        while len(live):
            block = blocks.block(begin[live] + j, size[live] - j)
            h[live] = mix((h[live] ^ block) * _U(0x9FB21C651E98DF25) + (block >> _U(32)))
            j += 8
            live = live[size[live] > j]
    for i in np.flatnonzero(size > SHORT).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(blocks.raw[begin[i] : begin[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def stretch_blocks(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """The bytes of stretches of 8 n bytes at most, a row of n blocks each, zeros behind their ends."""
    blocks = _Blocks(units)
    begin, size = starts * blocks.width, (ends - starts) * blocks.width
    out = np.zeros((len(starts), n), dtype=_U)
    for j in range(n):
        live = np.flatnonzero(size > 8 * j)
        out[live, j] = blocks.block(begin[live] + 8 * j, size[live] - 8 * j)
    return out


def equal_stretches(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray) -> bool:
    """Whether each stretch equals that from its place in `others`, which is as long, on."""
    blocks = _Blocks(units)
    some = np.flatnonzero(starts != others)
    a, b, size = starts[some] * blocks.width, others[some] * blocks.width, (ends - starts)[some] * blocks.width
    if not all(np.array_equal(blocks.raw[a[i] : a[i] + size[i]], blocks.raw[b[i] : b[i] + size[i]]) for i in np.flatnonzero(size > SHORT).tolist()):
        return False
    live, j = np.flatnonzero(size <= SHORT), 0
    while len(live):
        left = size[live] - j
        if (blocks.block(a[live] + j, left) != blocks.block(b[live] + j, left)).any():
            return False
        j += 8
        live = live[size[live] > j]
    return True


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 text."""
    return hashed_words(data)[0]


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes() and the place of each word's first byte; in pieces that end before white space."""
    out, places, at = [np.empty(0, dtype=_U)], [np.empty(0, dtype=np.int64)], 0
    for piece in _pieces(data):
        raw = np.frombuffer(piece, dtype=np.uint8)
        inside = ~((raw == 0x20) | ((raw >= 9) & (raw <= 13)))
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        out.append(stretch_hashes(raw, starts, ends))
        places.append(starts + at)
        at += len(piece)
    return np.concatenate(out), np.concatenate(places)


def _pieces(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > PIECE:
        cut = max(data.rfind(b, at + 1, at + PIECE) for b in (b" ", b"\n", b"\t"))
        if cut < 0:
            cut = min((k for k in (data.find(b, at + PIECE) for b in (b" ", b"\n", b"\t")) if k >= 0), default=len(data))
        yield data[at:cut]
        at = cut
    yield data[at:]
