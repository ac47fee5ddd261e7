"""Bit-level column expressions: packed flags, space-filling curves, alignment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (attribute, shift, bits) of packed flags: the one-byte form of point formats 0-5, the two-byte form of formats 6-10.
BASIC_FLAGS = (("ReturnNumber", 0, 3), ("NumberOfReturns", 3, 3), ("ScanDirectionFlag", 6, 1), ("EdgeOfFlightLine", 7, 1))
EXTENDED_FLAGS = (
    ("ReturnNumber", 0, 4), ("NumberOfReturns", 4, 4), ("ClassificationFlags", 8, 4), ("ScannerChannel", 12, 2), ("ScanDirectionFlag", 14, 1), ("EdgeOfFlightLine", 15, 1),
)


def unpack(flags: Column, parts: tuple[tuple[str, int, int], ...]) -> dict[str, Column]:
    """The attributes held in packed flags."""
    whole = flags.cast("int")
    return {name: F.shiftright(whole, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("short") for name, shift, bits in parts}


def pack(values: dict[str, Column], parts: tuple[tuple[str, int, int], ...]) -> Column:
    """Packed flags; each value is cut to its bits and missing ones are zero."""
    out = F.lit(0)
    for name, shift, bits in parts:
        if name in values:
            out = out.bitwiseOR(F.shiftleft(values[name].cast("int").bitwiseAND(F.lit((1 << bits) - 1)), shift))
    return out


def spread3(x: Column, width: int = 21) -> Column:
    """The lowest `width` bits (21 at most) with two zero bits after each: doubling gaps, masked at each step."""
    x = x.cast("long").bitwiseAND(F.lit((1 << width) - 1))
    for shift in (32, 16, 8, 4, 2):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(_gap_mask(shift // 2)))
    return x


def _gap_mask(run: int) -> int:
    """Runs of `run` one bits, each followed by twice as many zero bits, within 63 bits; the run of 16 is that of 21 bits' halves."""
    mask = 0
    for i in range(21):
        mask |= 1 << (i // run * run * 3 + i % run)
    return mask


def morton3(x: Column, y: Column, z: Column, width: int = 21) -> Column:
    """Interleaved bits of three cell numbers of `width` bits: nearby cells get nearby keys, for range clustering. Higher bits are left out."""
    return spread3(x, width).bitwiseOR(F.shiftleft(spread3(y, width), 1)).bitwiseOR(F.shiftleft(spread3(z, width), 2))


def reverse_bits(x: Column) -> Column:
    """The 64 bits of a long in reverse order: swap neighbours of 1, 2, 4, ... 32 bits."""
    x = x.cast("long")
    for run in (1, 2, 4, 8, 16):
        low = sum(((1 << run) - 1) << k for k in range(0, 64, 2 * run))
        low = low - (1 << 64) if low >> 63 else low
        x = F.shiftrightunsigned(x, run).bitwiseAND(F.lit(low)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(low)), run))
    return F.shiftrightunsigned(x, 32).bitwiseOR(F.shiftleft(x, 32))


def align_to(x: Column, step: int | Column) -> Column:
    """x rounded up to a multiple of step."""
    step = F.lit(step) if isinstance(step, int) else step
    return x + F.pmod(-x, step)
