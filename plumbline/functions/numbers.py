"""Numbers and times: Python's rounding, grids, run ids, hashes of many numbers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def python_round(x: Column, places: int) -> Column:
    """round(x, places) of Python, which rounds the exact binary value (2.675 to 2.67); Spark's own rounding goes by the
    shortest decimal form, so this takes an Arrow function."""

    @F.pandas_udf("double")
    def rounded(values: pd.Series) -> pd.Series:
        return values.map(lambda v: round(v, places) if v == v else v)

    return rounded(x.cast("double"))


def snapped(x: Column, steps: int = 2, least: float = 0.5) -> Column:
    """x on a grid of 1 / steps (a power of two, so that ties are exact), at least `least`; ties go to the even step."""
    return F.greatest(F.bround(x * steps) / steps, F.lit(least))


def run_id(at: Column) -> Column:
    """The time as in ids of runs; the session's time zone must be UTC."""
    return F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")


def iso(at: Column) -> Column:
    """The time in ISO 8601, to seconds; the session's time zone must be UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds, with fractions, from one ISO time to another."""
    return end.cast("timestamp").cast("double") - start.cast("timestamp").cast("double")


# Constants of md5 (RFC 1321) up to its 61st step, after which the first word of the digest doesn't change.
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(61)]
TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def md5_heads(prefix: bytes, low: int, high: int) -> np.ndarray:
    """The first 32 bits of md5(prefix + str(i)) for i from low to high - 1, which must have equally many digits.

    All numbers go through the steps of md5 together, a word of each at a time; the text must fit one block (55 bytes).
    """
    size, digits = len(prefix), len(str(low))
    end = size + digits
    if end > 55 or high > 10**digits:
        raise ValueError("texts of one length and at most 55 bytes")
    block = bytearray(prefix.ljust(64, b"\0"))
    block[end], block[56:] = 0x80, (8 * end).to_bytes(8, "little")
    words = [np.uint32(int.from_bytes(block[i : i + 4], "little")) for i in range(0, 64, 4)]
    rest = np.arange(low, high, dtype=np.uint64 if high > 2**32 else np.uint32)
    ten, zero = rest.dtype.type(10), rest.dtype.type(48)
    for at in range(end - 1, size - 1, -1):
        tens = rest // ten
        words[at // 4] = words[at // 4] + ((rest - tens * ten + zero).astype(np.uint32) << np.uint32(at % 4 * 8))
        rest = tens
    a, b, c, d = (np.full(high - low, x, np.uint32) for x in START)
    f, t = np.empty_like(a), np.empty_like(a)
    for i, sine in enumerate(SINES):
        kind = i // 16
        if kind < 2:  # a choice between two words by the bits of a third
            x, y, z = (b, c, d) if kind == 0 else (d, b, c)
            np.bitwise_xor(y, z, f)
            np.bitwise_and(f, x, f)
            np.bitwise_xor(f, z, f)
        elif kind == 2:
            np.bitwise_xor(b, c, f)
            np.bitwise_xor(f, d, f)
        else:
            np.invert(d, f)
            np.bitwise_or(f, b, f)
            np.bitwise_xor(f, c, f)
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16]
        if word.ndim:
            np.add(f, word, f)
        else:
            sine += int(word)
        np.add(a, np.uint32(sine % 2**32), a)
        np.add(f, a, f)
        turn = TURNS[kind][i % 4]
        np.right_shift(f, np.uint32(32 - turn), t)
        np.left_shift(f, np.uint32(turn), f)
        np.bitwise_or(f, t, f)
        np.add(f, b, f)
        a, b, c, d, f = d, f, b, c, a
    return (b + np.uint32(START[0])).byteswap()
