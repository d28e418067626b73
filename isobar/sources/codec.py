"""Lossless float codec of the record file: finite-context prediction of differences, the XOR with it, and its leading zero nibbles.

After the published method of Ratanaworabhan, Ke and Burtscher (Data Compression Conference 2006). For each value a context of the last three differences'
leading bits picks the last two differences seen there; the predicted difference is the last one, plus their change if both agree in their low bits. What is
stored is a nibble with the number of leading zero nibbles of the XOR, and its other nibbles, lowest first.
"""

from __future__ import annotations

import numpy as np

_CONTEXT = 20  # bits of a context


class _Model:
    def __init__(self, bits: int, lead: int):
        self.mask, self.lead, self.low = (1 << bits) - 1, bits - lead, (1 << (bits - 14)) - 1
        self.table: dict[int, tuple[int, int]] = {}
        self.context, self.ring, self.turn, self.oldest, self.previous = 0, [0, 0], 0, 0, 0

    def shift(self, value: int) -> None:
        """Moves the context on by the difference that value makes."""
        self.context ^= self.oldest << 10
        self.oldest = self.ring[self.turn]
        self.ring[self.turn] = ((value - self.previous) & self.mask) >> self.lead
        self.context = ((self.context << 5) ^ self.ring[self.turn]) & ((1 << _CONTEXT) - 1)
        self.turn ^= 1

    def predict(self, at: int) -> int:
        last, before = self.table.get(at, (0, 0))
        step = last + (last - before) if last & self.low == before & self.low else last
        return (self.previous + step) & self.mask

    def learn(self, at: int, value: int) -> None:
        self.table[at] = ((value - self.previous) & self.mask, self.table.get(at, (0, 0))[0])
        self.previous = value


def _shape(kind: str) -> tuple[int, int, int]:
    """Bits of a value, bits that lead a difference, and the largest count of zero nibbles."""
    return {"f4": (32, 11, 8), "f8": (64, 14, 15)}[kind]


def compress(values: np.ndarray) -> bytes:
    """The compressed bytes of float32 or float64 values."""
    kind = values.dtype.str[1:]
    bits, lead, most = _shape(kind)
    m, nibbles = _Model(bits, lead), []
    for v in values.ravel().view(f"<u{bits // 8}").tolist():
        at = m.context
        x = m.predict(at) ^ v
        m.shift(v)
        m.learn(at, v)
        zeros = most if not x else min(most, (bits - x.bit_length()) // 4)
        nibbles.append((zeros, x, bits // 4 - zeros))
    return _pack(nibbles)


def _pack(items: list[tuple[int, int, int]]) -> bytes:
    out, half = bytearray(), None
    for zeros, x, n in items:
        if half is None:
            half = zeros << 4
        else:
            out.append(half | zeros)
            half = None
        if half is not None and n:
            out.append(half | (x & 15))
            half, x, n = None, x >> 4, n - 1
        while n >= 2:
            out.append(x & 255)
            x, n = x >> 8, n - 2
        if n:
            half = (x & 15) << 4
    if half is not None:
        out.append(half)
    return bytes(out)


def inflate(data: bytes, count: int, kind: str) -> np.ndarray:
    """count values of kind f4 or f8."""
    bits, lead, _ = _shape(kind)
    m, out, at, half = _Model(bits, lead), [], 0, None
    for _ in range(count):
        if half is None:
            zeros, half = data[at] >> 4, data[at] & 15
            at += 1
        else:
            zeros, half = half, None
        n, x, shift = bits // 4 - zeros, 0, 0
        if n and half is not None:
            x, half, shift, n = half, None, 4, n - 1
        while n >= 2:
            x |= data[at] << shift
            at, shift, n = at + 1, shift + 8, n - 2
        if n:
            x |= (data[at] >> 4) << shift
            half = data[at] & 15
            at += 1
        c = m.context
        v = m.predict(c) ^ x
        m.shift(v)
        m.learn(c, v)
        out.append(v)
    return np.array(out, dtype=f"<u{bits // 8}").view(f"<{kind}")
