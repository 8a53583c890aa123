"""Packed and interleaved coordinates as expressions over long columns (up to 63 bits)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def width(dim: int) -> int:
    """Bits for the indices below dim; none for a dimension of one."""
    return max(0, (dim - 1).bit_length())


def _fits(bits: int) -> None:
    if bits > 63:
        raise ValueError(f"{bits} bits don't fit in a long; keep the coordinates as columns")


def linearize(cols: Sequence[str], widths: Sequence[int]) -> Column:
    """One long; the first column takes the highest bits."""
    _fits(sum(widths))
    out, shift = F.lit(0).cast("long"), 0
    for c, w in reversed(list(zip(cols, widths, strict=True))):
        out = out.bitwiseOR(F.shiftleft(F.col(c), shift)) if w else out
        shift += w
    return out


def delinearize(key: str, widths: Sequence[int]) -> list[Column]:
    """The columns of a linearized key, in order."""
    out, shift = [], 0
    for w in reversed(widths):
        out.append(F.shiftrightunsigned(F.col(key), shift).bitwiseAND(F.lit((1 << w) - 1)))
        shift += w
    return out[::-1]


def place_bits(cols: Sequence[str], places: Sequence[tuple[int, int]]) -> Column:
    """Bit k of the result is the (column number, bit) of places[k]."""
    _fits(len(places))
    out = F.lit(0).cast("long")
    for k, (m, b) in enumerate(places):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(F.col(cols[m]), b).bitwiseAND(F.lit(1)), k))
    return out


def morton(cols: Sequence[str], widths: Sequence[int]) -> Column:
    """Z-order: bit b of column n at b times the number of columns plus n."""
    n = len(cols)
    _fits(max(widths) * n)
    out = F.lit(0).cast("long")
    for m, c in enumerate(cols):
        for b in range(widths[m]):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(F.col(c), b).bitwiseAND(F.lit(1)), b * n + m))
    return out


def alto_places(widths: Sequence[int]) -> list[tuple[int, int]]:
    """Interleaving from the lowest bit: each round takes a bit of every mode that has one left, short modes first."""
    order = sorted(range(len(widths)), key=lambda m: (widths[m], m))
    return [(m, b) for b in range(max(widths, default=0)) for m in order if b < widths[m]]


def alto(cols: Sequence[str], widths: Sequence[int]) -> Column:
    return place_bits(cols, alto_places(widths))
