"""Small vectorised helpers over UTF-8 bytes, shared by the operators that read whole texts inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
PIECE = 1 << 20


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (wrap-around arithmetic)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_coefficients = np.zeros(0, np.uint64)


def coefficients(n: int) -> np.ndarray:
    """n odd 64-bit multipliers, one for each byte position of a word."""
    global _coefficients
    if len(_coefficients) < n:
        _coefficients = mix((np.arange(max(n, 256), dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _coefficients[:n]


def cut_at_space(buf: np.ndarray, piece: int = PIECE) -> Iterator[np.ndarray]:
    """Consecutive slices of about `piece` bytes that end at white space; a longer word stays whole."""
    at = 0
    while at < len(buf):
        end = min(len(buf), at + piece)
        while end < len(buf) and not SPACE[buf[end]]:
            step = np.flatnonzero(SPACE[buf[end : end + piece]])
            end = end + int(step[0]) if len(step) else min(len(buf), end + piece)
        yield buf[at:end]
        at = end


def word_hashes(data: bytes, piece: int = PIECE) -> np.ndarray:
    """A 64-bit hash for each maximal run of bytes other than 20 and 09-0D, A-Z lower-cased, in order.

    Multilinear over byte positions, then finalised; temporaries are bounded by the piece, not by the text.
    """
    out = []
    for part in cut_at_space(np.frombuffer(data.translate(LOWER), np.uint8), piece):
        solid = ~SPACE[part]
        if not solid.any():
            continue
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        chars = part[solid]
        begin = np.flatnonzero(first[solid])
        length = np.diff(np.append(begin, len(chars)))
        place = np.arange(len(chars)) - np.repeat(begin, length)
        value = (chars.astype(np.uint64) + np.uint64(1)) * coefficients(int(length.max()))[place]
        out.append(mix(np.add.reduceat(value, begin) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def groups(sizes: list[int], limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose sizes add up to about the limit; a larger row stands alone."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)
