"""Human-readable sizes."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit letters in order of magnitude and their long names, those of the standard and others in use.
LETTERS = "kmgtpe"
DECIMAL = ["kilo", "mega", "giga", "tera", "peta", "exa"]
BINARY = ["kibi", "mebi", "gibi", "tebi", "pebi", "exbi"]
OTHER_BINARY = ["kibi", "mibi", "gibi", "tibi", "pibi", "eibi"]
UNITS = ["B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB"]
ENDINGS = ["", "s", "byte", "bytes", "b"]


def _multipliers() -> dict[str, int]:
    out = {"": 1}
    for k, letter in enumerate(LETTERS):
        out |= {letter: 1000 ** (k + 1), DECIMAL[k]: 1000 ** (k + 1), letter + "i": 1024 ** (k + 1), BINARY[k]: 1024 ** (k + 1), OTHER_BINARY[k]: 1024 ** (k + 1)}
    return out


_MULTIPLIERS = _multipliers()


def parse_size(text: str) -> int:
    """Bytes: ``1K`` is 1000, ``1KiB`` 1024; blanks, ``_`` and ``,`` are passed over. Fractions are cut off."""
    bare = re.sub(r"[\s_,]", "", text.lower())
    found = re.fullmatch(r"\+?(\d+\.?\d*(?:e[+-]?\d+)?|\.\d+)([a-z]*)", bare)
    if not found:
        raise ValueError(f"not a size: {text!r}")
    number, suffix = found.groups()
    for ending in ENDINGS:
        if suffix.endswith(ending) and suffix.removesuffix(ending) in _MULTIPLIERS:
            value = float(number) * _MULTIPLIERS[suffix.removesuffix(ending)]
            if math.isinf(value) or value > 2**64:
                raise ValueError(f"size out of range: {text!r}")
            return int(value)
    raise ValueError(f"unknown unit in size: {text!r}")


def display_size(size: Column) -> Column:
    """``17 B``, ``1.12 KiB``: two decimals, halves to even."""
    out = F.format_string("%d B", size)
    for k, unit in enumerate(UNITS[1:], 1):
        shown = F.format_string(f"%.2f {unit}", F.bround(size / F.lit(float(1024**k)), 2))
        out = F.when(size >= F.lit(1024**k), shown).otherwise(out)
    return out
