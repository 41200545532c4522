"""MD5 of many short texts at once, for draws that are named by digests."""

from __future__ import annotations

import numpy as np

_SHIFTS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel().tolist()
_SINES = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_WORDS = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]


def slot_digests(prefix: str, first: int, last: int) -> np.ndarray:
    """First 32 bits of the MD5 of prefix and number, for all numbers from first (0 at least) to last, at most 55 bytes together."""
    parts = []
    while first <= last:
        digits = len(str(first))
        end = min(last, 10**digits - 1)
        parts.append(_same_length(prefix.encode(), first, end, digits))
        first = end + 1
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)


def _same_length(prefix: bytes, first: int, last: int, digits: int) -> np.ndarray:
    """As slot_digests, for numbers of one length: only the words that hold digits differ."""
    length = len(prefix) + digits
    if length > 55:
        raise ValueError("one block of MD5 holds 55 bytes")
    n = last - first + 1
    low, high = len(prefix) // 4, length // 4  # words with a digit or the closing bit
    held = np.zeros((n, 4 * (high - low + 1)), dtype=np.uint8)
    known = prefix[4 * low :]
    held[:, : len(known)] = np.frombuffer(known, dtype=np.uint8)
    rest = np.arange(first, last + 1, dtype=np.uint32 if last < 1 << 32 else np.uint64)
    for i in range(digits - 1, -1, -1):
        quotient = rest // 10
        held[:, len(known) + i] = rest - quotient * 10 + 48
        rest = quotient
    held[:, len(known) + digits] = 0x80
    words: list = [int.from_bytes(prefix[4 * i : 4 * i + 4], "little") for i in range(low)] + [0] * (16 - low)
    words[14] = 8 * length
    for i, column in enumerate(held.view("<u4").T):
        words[low + i] = np.ascontiguousarray(column) + np.uint32(words[low + i])
    a, b, c, d = (np.full(n, v, dtype=np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, turned = np.empty(n, dtype=np.uint32), np.empty(n, dtype=np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        word = words[_WORDS[i]]
        if isinstance(word, int):
            f += np.uint32((word + _SINES[i]) & 0xFFFFFFFF)
        else:
            f += word
            f += np.uint32(_SINES[i])
        np.left_shift(f, np.uint32(_SHIFTS[i]), out=turned)
        f >>= np.uint32(32 - _SHIFTS[i])
        f |= turned
        f += b
        a, d, c, b, f = d, c, b, f, a
    return (a + np.uint32(0x67452301)).byteswap()
