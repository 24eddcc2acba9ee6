"""Typed query and retention specifications, checked on the driver.

``parse`` takes parameters as they arrive: text values, or lists of text for
repeated parameters.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from ..functions.buckets import BUCKET_MICROS
from ..functions.isotime import parse_iso_micros
from ..schema import LEVELS
from .cursor import Cursor, decode_cursor
from .errors import InvalidQuery

DEFAULT_LIMIT = 100
MAX_LIMIT = 1000
GROUP_COLUMNS = ("service", "level")

_ATTRIBUTE_PREFIX = "attr."
SEARCH_MODES = ("pattern", "substring")


@dataclass(frozen=True)
class LogFilter:
    """The filters pages and aggregates share; all given ones must hold."""

    service: str | None = None
    level: str | None = None
    since: str | None = None
    until: str | None = None
    q: str | None = None
    attributes: tuple[tuple[str, str], ...] = ()
    search_mode: str = "pattern"

    def __post_init__(self) -> None:
        if self.level is not None and self.level not in LEVELS:
            raise InvalidQuery("Invalid level")
        if self.search_mode not in SEARCH_MODES:
            raise InvalidQuery("Invalid search mode")
        for name in ("since", "until"):
            text = getattr(self, name)
            if text is not None and parse_iso_micros(text) is None:
                raise InvalidQuery(f"Invalid {name}")
        if self.since is not None and self.until is not None:
            # The order check works on whole milliseconds.
            if self.until_micros // 1000 <= self.since_micros // 1000:
                raise InvalidQuery("until must be greater than since")

    @property
    def since_micros(self) -> int | None:
        return None if self.since is None else parse_iso_micros(self.since)

    @property
    def until_micros(self) -> int | None:
        return None if self.until is None else parse_iso_micros(self.until)


@dataclass(frozen=True)
class LogsQuery(LogFilter):
    """One page of records, newest first."""

    limit: int = DEFAULT_LIMIT
    cursor: Cursor | None = None

    def __post_init__(self) -> None:
        super().__post_init__()
        if not 1 <= self.limit <= MAX_LIMIT:
            raise InvalidQuery("Invalid limit")

    @classmethod
    def parse(cls, params: Mapping[str, str | list[str]]) -> LogsQuery:
        return cls(**_read(params, _PAGE))


@dataclass(frozen=True)
class AggregateQuery(LogFilter):
    """Record counts per time bucket, optionally per service or level."""

    bucket: str = field(default="1h")
    group_by: str | None = None

    def __post_init__(self) -> None:
        if self.bucket not in BUCKET_MICROS:
            raise InvalidQuery("Invalid bucket parameter")
        if self.group_by is not None and self.group_by not in GROUP_COLUMNS:
            raise InvalidQuery("Invalid group_by parameter")
        super().__post_init__()
        for name in ("since", "until"):
            if getattr(self, name) is None:
                raise InvalidQuery(f"Missing {name} parameter")

    @classmethod
    def parse(cls, params: Mapping[str, str | list[str]]) -> AggregateQuery:
        required = ("bucket", "group_by") if isinstance(params, Mapping) and "group_by" in params else ("bucket",)
        return cls(**_read(params, _AGGREGATE, required, early=True))


@dataclass(frozen=True)
class RetentionOptions:
    """Age limit and the most rows one run may delete."""

    days: int = 30
    batch_size: int = 1000
    max_batches_per_run: int = 100

    def __post_init__(self) -> None:
        for name, value in vars(self).items():
            if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
                raise ValueError(f"{name} must be a positive integer")

    @property
    def max_rows(self) -> int:
        return self.batch_size * self.max_batches_per_run


@dataclass(frozen=True)
class Parameter:
    """How one parameter is read: what its text means, and the error when it is not one text."""

    read: Callable[[str], object]
    not_one_text: str


def _one_of(values, error: str) -> Callable[[str], str]:
    def read(text: str) -> str:
        if text not in values:
            raise InvalidQuery(error)
        return text

    return read


def _instant(error: str) -> Callable[[str], str]:
    def read(text: str) -> str:
        if parse_iso_micros(text) is None:
            raise InvalidQuery(error)
        return text

    return read


def _limit(text: str) -> int:
    digits = text.lstrip("0")
    if not re.fullmatch(r"[0-9]+", text) or len(digits) > len(str(MAX_LIMIT)) or not 1 <= int(digits or 0) <= MAX_LIMIT:
        raise InvalidQuery("Invalid limit")
    return int(digits)


# Parameter names and the errors clients see.
_FILTERS = {
    "service": Parameter(str, "Invalid service parameter"),
    "level": Parameter(_one_of(LEVELS, "Invalid level"), "Invalid level parameter"),
    "since": Parameter(_instant("Invalid since"), "Invalid since parameter"),
    "until": Parameter(_instant("Invalid until"), "Invalid until parameter"),
    "q": Parameter(str, "Invalid q parameter"),
}
_PAGE = {
    **_FILTERS,
    "limit": Parameter(_limit, "Invalid limit parameter"),
    "cursor": Parameter(decode_cursor, "Invalid cursor parameter"),
}
_AGGREGATE = {
    "bucket": Parameter(
        _one_of(BUCKET_MICROS, "Invalid bucket parameter"), "Missing or invalid bucket parameter"),
    "group_by": Parameter(_one_of(GROUP_COLUMNS, "Invalid group_by parameter"), "Invalid group_by parameter"),
    **_FILTERS,
}
_UNKNOWN = "Invalid query parameter"
_BAD_ATTRIBUTE = "Invalid attribute filter"


def _texts(value: object, error: str, most: int | None = None) -> list[str]:
    """A text, or a list of at least one and at most ``most`` texts."""
    texts = list(value) if isinstance(value, (list, tuple)) else [value]
    if not texts or len(texts) > (most or len(texts)) or any(not isinstance(text, str) for text in texts):
        raise InvalidQuery(error)
    return texts


def _read(params: object, table: dict[str, Parameter], required: tuple[str, ...] = (), early: bool = False) -> dict:
    """Constructor arguments by the table; the first bad parameter is reported.

    ``required`` ones are read first, present or not; ``early`` reports unknown
    names before any value is looked at.
    """
    if not isinstance(params, Mapping):
        raise InvalidQuery("Invalid query parameters")
    given = {name: params.get(name) for name in required} | dict(params)
    attributes = {name: given.pop(name) for name in params if name.startswith(_ATTRIBUTE_PREFIX)}
    if early and not given.keys() <= table.keys():
        raise InvalidQuery(_UNKNOWN)
    found: dict = {"attributes": ()}
    for name in [*(n for n in table if n in required), *(n for n in params if n not in required)]:
        if name in attributes:
            key = name[len(_ATTRIBUTE_PREFIX):]
            texts = _texts(attributes[name] if key else None, _BAD_ATTRIBUTE)
            found["attributes"] += tuple((key, text) for text in texts)
            continue
        known = table.get(name, Parameter(_one_of((), _UNKNOWN), f"Invalid {name} parameter"))
        found[name] = known.read(*_texts(given[name], known.not_one_text, most=1))
    return found
