"""Case-insensitive message search."""

from __future__ import annotations

import re

from pyspark.sql import Column

from ..plans.errors import InvalidQuery


def search_pattern(term: str, mode: str = "pattern") -> str:
    """The LIKE pattern for a search term.

    ``pattern`` keeps ``%`` and ``_`` as wildcards and ``\\`` as the escape.
    ``substring`` looks for the term as written.
    """
    if mode == "substring":
        return "%" + re.sub(r"([\\%_])", r"\\\1", term) + "%"
    if mode != "pattern":
        raise InvalidQuery("Invalid search mode")
    # An escape before an ordinary character just means that character; Spark
    # refuses it, so drop it.  A closing backslash takes the final % with it.
    return re.sub(r"\\(.)", lambda m: m[0] if m[1] in "\\%_" else m[1], f"%{term}%", flags=re.S)


def message_matches(message: Column, term: str, mode: str = "pattern") -> Column:
    return message.ilike(search_pattern(term, mode))
