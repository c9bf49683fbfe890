"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once a row, however often body mentions it: else expressions grow by nesting."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fenced_blocks(text: Column) -> Column:
    """The contents of ``` or ```python fences, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?s)```(?:python)?[ \t]*\r?\n(.*?)```"), F.lit(1))


def longest(blocks: Column) -> Column:
    """The longest entry, the first of equals; null for none."""
    return F.aggregate(blocks, F.lit(None).cast("string"), lambda acc, x: F.when(acc.isNull() | (F.char_length(x) > F.char_length(acc)), x).otherwise(acc))


def dedent(text: Column) -> Column:
    """Without the leading blanks and tabs that all lines with content share; lines of blanks and tabs alone get empty."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"\A[ \t]+\z", ""))
    indents = F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.regexp_extract(x, r"\A[ \t]*", 0))
    low, high = F.array_min(indents), F.array_max(indents)  # what both begin with, all begin with
    shared = F.array_max(F.filter(F.sequence(F.lit(0), F.char_length(low)), lambda k: F.substring(low, F.lit(1), k) == F.substring(high, F.lit(1), k)))
    return F.array_join(F.transform(lines, lambda x: F.substring(x, F.coalesce(shared, F.lit(0)) + 1, F.char_length(x))), "\n")


#: What Python's str.strip() takes off.
STRIPPED = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def code_of(text: Column) -> Column:
    """The longest fenced block without its common indentation, else the text."""
    return F.regexp_replace(dedent(F.coalesce(longest(fenced_blocks(text)), text)), STRIPPED, "")


def clean_error(text: Column, most: int = 300) -> Column:
    """Characters that can't be printed, and separators, become blanks; at most `most` characters."""
    return F.substring(F.regexp_replace(text, r"[\p{C}\p{Z}]", " "), 1, most)


def error_core(text: Column) -> Column:
    """Without an 'Error:' prefix, at most 80 characters."""
    return F.substring(F.regexp_replace(text, r"(?U)^\w*(?:Error|Exception): ?", ""), 1, 80)


def number_after(text: Column, label: str) -> Column:
    """The number behind a label and up to three other characters; null if there's none."""
    return F.try_to_number(F.nullif(F.regexp_extract(text, label + r"[^0-9\-]{0,3}(-?[0-9]+(?:\.[0-9]+)?)", 1), F.lit("")), F.lit("S9999999999.999999")).cast("double")


def short_number(x: Column) -> Column:
    """A number as "%g" writes it: six significant digits, no trailing zeros, an exponent below 1e-4 and from 1e6 on.

    Ties are those of the shortest decimal form, rounded up, where C looks at the exact binary value.
    """

    def written(x: Column) -> Column:
        plain = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+(?=$|e)", "$1"), r"\.(?=$|e)", "")
        fixed = lambda power: F.coalesce(*(F.when(power == p, F.format_string(f"%.{5 - p}f", x)) for p in range(-4, 6)))
        # d.ddddde+xx, rounded as %g rounds
        of = lambda digits: let(F.regexp_extract(digits, r"e([+-]\d+)$", 1).try_cast("int"), lambda power: plain(F.coalesce(fixed(power), digits)))
        sign = F.when(x < 0, "-inf").otherwise("inf")
        return F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), sign).otherwise(let(F.format_string("%.5e", x), of))

    return let(x.cast("double"), written)


# Fixed values of the loop detector.
TAIL, LEAST, BLANK_SHARE, LINE_LENGTH, TIMES, PROBE, PROBE_SOLID = 1500, 200, 0.8, 6, 6, 24, 12


def degenerate(text: Column) -> Column:
    """Whether the end of a text loops: mostly blank, a line six times, or its last 24 characters six times."""
    tail = F.substring(text, -TAIL, TAIL)
    solid = F.regexp_replace(tail, r"\s", "")
    blank = F.char_length(solid) <= (1 - BLANK_SHARE) * F.char_length(tail)
    stripped = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    lines = F.filter(F.transform(F.split(tail, r"\r\n|\n|\r"), stripped), lambda x: F.char_length(x) >= LINE_LENGTH)
    ordered = F.array_sort(lines)  # a line that comes TIMES times stands TIMES - 1 places before itself
    pairs = F.greatest(F.size(ordered) - (TIMES - 1), F.lit(0))
    often = F.exists(F.zip_with(F.slice(ordered, F.lit(1), pairs), F.slice(ordered, F.lit(TIMES), pairs), lambda x, y: x == y), lambda same: same)
    probe = F.substring(F.regexp_replace(tail, r"\s+$", ""), -PROBE, PROBE)
    repeats = (F.char_length(tail) - F.char_length(F.replace(tail, probe, F.lit("")))) / F.nullif(F.char_length(probe), F.lit(0))
    loop = (F.char_length(F.regexp_replace(probe, r"\s", "")) >= PROBE_SOLID) & (repeats >= TIMES)
    return F.coalesce((F.char_length(tail) >= LEAST) & (blank | often | F.coalesce(loop, F.lit(False))), F.lit(False))


def first_match(rules: list[tuple[str, Column]], default: str) -> Column:
    """The label of the first condition that holds."""
    return F.coalesce(*(F.when(c, F.lit(label)) for label, c in rules), F.lit(default))


def stable_pick(key: Column, n: int) -> Column:
    """crc32 of a key, modulo n."""
    return F.crc32(key.cast("binary")) % n
