"""Z-order curve over two non-negative integers, as plain bit arithmetic on BIGINT columns.

The expressions look up a byte at a time in constant tables, so the code that Spark generates stays small enough for
the JVM to compile; a term for every bit does not.  They are given as SQL text over column names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BITS = 31


# What a byte's bits are on every second place, and what the bits on every second place of a byte are side by side.
_SPREAD = f"array({', '.join(f'{sum((n >> i & 1) << 2 * i for i in range(8))}L' for n in range(256))})"
_GATHER = f"array({', '.join(f'{sum((n >> 2 * i & 1) << i for i in range(4))}L' for n in range(256))})"


def _spread(name: str, bits: int) -> str:
    wide = f"CAST({name} AS BIGINT)"
    return " | ".join(
        f"shiftleft(get({_SPREAD}, CAST(shiftright({wide}, {i}) & {(1 << min(8, bits - i)) - 1} AS INT)), {2 * i})" for i in range(0, bits, 8)
    )


def _gather(name: str, bits: int, skip: int) -> str:
    return " | ".join(
        f"shiftleft(get({_GATHER}, CAST(shiftright({name}, {2 * i + skip}) & {(1 << 2 * min(4, bits - i)) - 1} AS INT)), {i})" for i in range(0, bits, 4)
    )


def z_encode(x: str, y: str, bits: int = MAX_BITS) -> Column:
    """Interleave: bits of ``x`` on even places, bits of ``y`` on odd places."""
    return F.expr(f"{_spread(x, bits)} | shiftleft({_spread(y, bits)}, 1)")


def z_decode_x(code: str, bits: int = MAX_BITS) -> Column:
    return F.expr(f"CAST({_gather(code, bits, 0)} AS INT)")


def z_decode_y(code: str, bits: int = MAX_BITS) -> Column:
    return F.expr(f"CAST({_gather(code, bits, 1)} AS INT)")


def z_ranges(bounds: tuple[int, int, int, int], most: int = 32) -> list[tuple[int, int]]:
    """Inclusive ranges of the curve, ``most`` at most, that hold every tile within inclusive bounds ``(c0, r0, c1, r1)``.

    Squares of the curve's quadtree are split, the largest first, where they reach over the border; what is inside is one
    range as it is.  With few ranges some hold tiles beyond the bounds too, never fewer.
    """
    c0, r0, c1, r1 = bounds
    if c0 > c1 or r0 > r1:
        return []
    bits = max(c1, r1, 1).bit_length()
    whole, border = [], [(bits, 0, 0)]
    while border:
        if len(whole) + len(border) + 3 > most:
            break
        bits, c, r = border.pop(0)
        for dr in (0, 1):
            for dc in (0, 1):
                half = bits - 1
                left, top = c + (dc << half), r + (dr << half)
                right, bottom = left + (1 << half) - 1, top + (1 << half) - 1
                if left > c1 or right < c0 or top > r1 or bottom < r0:
                    continue
                inside = c0 <= left and right <= c1 and r0 <= top and bottom <= r1
                (whole if inside else border).append((half, left, top))
    squares = sorted((z_number(c, r), b) for b, c, r in whole + border)
    out: list[tuple[int, int]] = []
    for start, b in squares:
        end = start + (1 << 2 * b) - 1
        if out and out[-1][1] + 1 == start:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def z_number(x: int, y: int) -> int:
    """The place of one pair of numbers on the curve."""
    return sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(MAX_BITS))
