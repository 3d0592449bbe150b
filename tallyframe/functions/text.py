"""Text expressions shared by the name rules and the question jobs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(col: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 one space."""
    return F.trim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", " "))


def words_of(name: str) -> list[str]:
    """The runs of letters and digits (a-z, 0-9) in a name, in lower case."""
    return re.findall("[a-z0-9]+", name.lower())


def normalise_name(text: str) -> str:
    """``normalise`` for a column name or a phrase known to the driver."""
    return " ".join(words_of(text))


def safe_name(name: str) -> str:
    """The words of a name with underscores between them; ``column`` if it has none."""
    return "_".join(words_of(name)) or "column"


SPACED = str.maketrans("_-", "  ")


def display_name(name: str) -> str:
    """Underscores and hyphens as spaces, each word with a capital."""
    return " ".join(name.translate(SPACED).split()).title()


def safe_names(names: list[str]) -> list[str]:
    """Safe names in order; a repeat gets _2, _3 and so on."""
    seen: dict[str, int] = {}
    result = []
    for name in names:
        base = safe_name(name)
        seen[base] = seen.get(base, 0) + 1
        result.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return result
