"""Variable-byte coding of ascending numbers as differences."""

from __future__ import annotations

from collections.abc import Iterable


def encode_deltas(values: Iterable[int]) -> bytes:
    """Differences in groups of 7 bits, low ones first; the top bit says that more follow."""
    out, last = bytearray(), 0
    for value in values:
        step, last = value - last, value
        if step < 0:
            raise ValueError("numbers must ascend")
        while step >= 128:
            out.append(step % 128 + 128)
            step //= 128
        out.append(step)
    return bytes(out)


def decode_deltas(data: bytes) -> list[int]:
    values: list[int] = []
    step = shift = last = 0
    for byte in data:
        step += (byte % 128) << shift
        shift += 7
        if byte < 128:
            last += step
            values.append(last)
            step = shift = 0
    if shift:
        raise ValueError("the data ends within a number")
    return values
