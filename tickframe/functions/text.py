"""Text functions beside those of ``scalars``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

contains = F.contains
startswith = F.startswith
endswith = F.endswith
length = F.length
lower = F.lower
upper = F.upper


def position(x: Column, part: str) -> Column:
    """Where ``part`` first stands, from 0; NULL if nowhere."""
    at = F.instr(x, part)
    return F.when(at > 0, at - 1)


def repeat(x: Column, times: int, separator: str = "") -> Column:
    return F.array_join(F.array_repeat(x, max(0, times)), separator)


def replace(x: Column, old: str, new: str, occurrence: int = 0) -> Column:
    """``x`` with one occurrence of ``old``, counted from 0, replaced; unchanged if there is none such."""
    parts = F.split(x, f"\\Q{old}\\E") if old else F.array(x)
    k = occurrence + 1
    if occurrence < 0:
        return x
    joined = F.concat(F.array_join(F.slice(parts, 1, k), old), F.lit(new), F.array_join(F.slice(parts, k + 1, F.size(parts)), old))
    return F.when(F.size(parts) > k, joined).otherwise(x)


def replace_all(x: Column, old: str, new: str) -> Column:
    return F.replace(x, F.lit(old), F.lit(new)) if old else x


def substring(x: Column, begin: int, end: int | None = None) -> Column:
    """Characters from ``begin`` up to, not with, ``end``; both from 0."""
    return F.substring(x, begin + 1, 2**31 - 1 if end is None else max(0, end - begin))


def to_number(x: Column) -> Column:
    """The number a text says, NULL if it says none."""
    return F.trim(x).try_cast("double")


def trim(x: Column) -> Column:
    """Without white space at its ends."""
    return F.regexp_replace(x, "^\\s+|\\s+$", "")
