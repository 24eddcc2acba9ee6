"""Request parameters of a whole table, read as columns.

``LogsQuery.parse`` and ``AggregateQuery.parse`` read one request on the
driver.  Logged or queued requests come as a column of maps from names to
lists of texts; here the same rules, in the same order, are one built-in
expression per row, so that the first bad parameter is the one reported.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.buckets import BUCKET_MICROS
from ..functions.isotime import iso_timestamp
from ..schema import LEVELS
from . import specs
from .cursor import decoded_cursor

_PREFIX = specs._ATTRIBUTE_PREFIX


def page_parameters(params: Column) -> Column:
    """struct(error, query) of each map of parameters of a page.

    Either the error or the query is null.  A null map is no request; a null
    list, and a null text in one, are no text.  Names cannot repeat in a map.
    """
    return _bound(params, lambda given: _told(_first_of(given, _names_in_order(given, specs._PAGE)), F.struct(
        *_filters(given),
        F.coalesce(_limit(_text(given, "limit")), F.lit(specs.DEFAULT_LIMIT)).alias("limit"),
        decoded_cursor(_text(given, "cursor")).alias("cursor"),
        _attributes(given).alias("attributes"))))


def aggregate_parameters(params: Column) -> Column:
    """struct(error, query) of each map of parameters of an aggregate; as ``page_parameters``.

    Unknown names are reported before any value, then bucket and group_by.
    """
    def read(given: Column) -> Column:
        table = specs._AGGREGATE
        unknown = F.exists(F.map_keys(given), lambda name: ~name.startswith(_PREFIX) & ~name.isin(*table))
        early = F.when(unknown, specs._UNKNOWN)
        group = F.when(F.map_contains_key(given, "group_by"), _fault(given, "group_by", table))
        missing = [F.when(~F.map_contains_key(given, name), f"Missing {name} parameter") for name in ("since", "until")]
        error = _first_of(given, F.coalesce(
            early, _fault(given, "bucket", table), group, _names_in_order(given, table)), *missing)
        return _told(error, F.struct(
            *_filters(given),
            *(_text(given, name).alias(name) for name in ("bucket", "group_by")),
            _attributes(given).alias("attributes")))

    return _bound(params, read)


def _bound(params: Column, read: Callable[[Column], Column]) -> Column:
    """``read`` of a map that is computed once per row."""
    return F.transform(F.array(params), read)[0]


def _told(error: Column, query: Column) -> Column:
    return F.struct(error.alias("error"), F.when(error.isNull(), query).alias("query"))


def _first_of(given: Column, value_error: Column, *later: Column) -> Column:
    """Rules on single values come first, then the order of the bounds, then what is missing."""
    since, until = (F.unix_millis(iso_timestamp(_text(given, name))) for name in ("since", "until"))
    return F.coalesce(
        F.when(given.isNull(), "Invalid query parameters"), value_error,
        F.when(until <= since, "until must be greater than since"), *later)


def _names_in_order(given: Column, table: dict[str, specs.Parameter]) -> Column:
    """The error of the first bad parameter in the order they were sent."""
    def fault(name: Column) -> Column:
        found = F.when(name.startswith(_PREFIX), _attribute_fault(name, given[name]))
        for known in table:
            found = found.when(name == known, _fault(given, known, table))
        one = F.get(given[name], F.lit(0)).isNotNull() & (F.size(given[name]) == 1)
        return found.when(F.coalesce(one, F.lit(False)), specs._UNKNOWN).otherwise(
            F.concat(F.lit("Invalid "), name, F.lit(" parameter")))

    return F.get(F.filter(F.transform(F.map_keys(given), fault), lambda error: error.isNotNull()), F.lit(0))


def _fault(given: Column, name: str, table: dict[str, specs.Parameter]) -> Column:
    """What is wrong with one known parameter, or null."""
    text = _text(given, name)
    error = F.when(text.isNull(), table[name].not_one_text)
    if name in _ACCEPTED:
        accepted, refused = _ACCEPTED[name]
        error = error.when(~F.coalesce(accepted(text), F.lit(False)), refused)
    return error


def _attribute_fault(name: Column, texts: Column) -> Column:
    usable = (F.length(name) > len(_PREFIX)) & (F.size(texts) > 0) & F.forall(texts, lambda text: text.isNotNull())
    return F.when(~F.coalesce(usable, F.lit(False)), specs._BAD_ATTRIBUTE)


def _text(given: Column, name: str) -> Column:
    """The one text of a parameter; null when there is none, or more."""
    texts = F.try_element_at(given, F.lit(name))
    return F.when(F.size(texts) == 1, F.get(texts, F.lit(0)))


def _limit(text: Column) -> Column:
    digits = F.ltrim(text, F.lit("0"))
    return F.when(
        text.rlike(r"\A[0-9]+\z") & (F.length(digits) <= len(str(specs.MAX_LIMIT))), digits.try_cast("int"))


def _filters(given: Column) -> list[Column]:
    plain = [_text(given, name).alias(name) for name in ("service", "level", "q")]
    return plain + [iso_timestamp(_text(given, name)).alias(name) for name in ("since", "until")]


def _attributes(given: Column) -> Column:
    """Every (key, text) asked for, repeated keys one by one."""
    asked = F.filter(F.map_entries(given), lambda entry: entry["key"].startswith(_PREFIX))

    def pairs(entry: Column) -> Column:
        key = F.substring(entry["key"], len(_PREFIX) + 1, 2 ** 31 - 1)
        return F.transform(entry["value"], lambda text: F.struct(key.alias("key"), text.alias("text")))

    return F.flatten(F.transform(asked, pairs))


# What a text must be, and the error if it is not.  Any text is a service or a message pattern.
_ACCEPTED: dict[str, tuple[Callable[[Column], Column], str]] = {
    "level": (lambda text: text.isin(*LEVELS), "Invalid level"),
    "since": (lambda text: iso_timestamp(text).isNotNull(), "Invalid since"),
    "until": (lambda text: iso_timestamp(text).isNotNull(), "Invalid until"),
    "limit": (lambda text: _limit(text).between(1, specs.MAX_LIMIT), "Invalid limit"),
    "cursor": (lambda text: decoded_cursor(text).isNotNull(), "Invalid cursor"),
    "bucket": (lambda text: text.isin(*BUCKET_MICROS), "Invalid bucket parameter"),
    "group_by": (lambda text: text.isin(*specs.GROUP_COLUMNS), "Invalid group_by parameter"),
}
