"""Rules about column names, each one pattern for driver and table alike."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of date parts.
DATE_PART_NAMES = ("year", "month", "day", "quarter", "week", "day_of_week")


@dataclass(frozen=True)
class NameRule:
    """Holds for names that are one of ``whole``, end in one of ``endings`` or have one of ``parts``.

    Capitals count as small letters.
    """

    whole: tuple[str, ...] = ()
    endings: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()

    @property
    def pattern(self) -> str:
        kinds = (("^({})$", self.whole), ("({})$", self.endings), ("({})", self.parts))
        return "|".join(frame.format("|".join(map(re.escape, words))) for frame, words in kinds if words)

    def __call__(self, name: str) -> bool:
        return re.search(self.pattern, name.lower()) is not None

    def column(self, name: Column) -> Column:
        return F.lower(name).rlike(self.pattern)


def suffixed(words: tuple[str, ...]) -> tuple[str, ...]:
    """The words as endings after an underscore."""
    return tuple(f"_{w}" for w in words)
