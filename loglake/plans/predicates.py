"""Query specifications as Column predicates.

Time bounds, equality and the keyset position are written so that Parquet
filters can use them.  ``log_date`` bounds follow from time bounds and prune
partitions; they are added only for tables that have the column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.attributes import attribute_equals
from ..functions.isotime import micros_literal
from ..functions.patterns import message_matches
from .cursor import Cursor
from .specs import LogFilter, LogsQuery



def utc_day(micros: int) -> int:
    """Days since 1970-01-01 of an instant."""
    return micros // 86_400_000_000


def day_literal(day: int) -> Column:
    return F.date_from_unix_date(F.lit(day))


def from_instant(micros: int, partitioned: bool = False) -> Column:
    """At or after an instant."""
    bound = F.col("timestamp") >= micros_literal(micros)
    return bound & (F.col("log_date") >= day_literal(utc_day(micros))) if partitioned else bound


def before_instant(micros: int, partitioned: bool = False) -> Column:
    """Strictly before an instant."""
    bound = F.col("timestamp") < micros_literal(micros)
    return bound & (F.col("log_date") <= day_literal(utc_day(micros))) if partitioned else bound


def after_cursor(cursor: Cursor, partitioned: bool = False) -> Column:
    """Rows that follow the cursor in newest-first order."""
    edge, row_id = micros_literal(cursor.micros), F.lit(int(cursor.id))
    same = (F.col("timestamp") == edge) & (F.col("id") < row_id)
    position = (F.col("timestamp") <= edge) & ((F.col("timestamp") < edge) | same)
    if partitioned:
        position &= F.col("log_date") <= day_literal(utc_day(cursor.micros))
    return position


def filter_predicate(query: LogFilter, partitioned: bool = False) -> Column:
    """Every filter of a page or aggregate query, ANDed."""
    parts: list[Column] = []
    if query.service is not None:
        parts.append(F.col("service") == F.lit(query.service))
    if query.level is not None:
        parts.append(F.col("level") == F.lit(query.level))
    if query.since is not None:
        parts.append(from_instant(query.since_micros, partitioned))
    if query.until is not None:
        parts.append(before_instant(query.until_micros, partitioned))
    if query.q is not None:
        parts.append(message_matches(F.col("message"), query.q, query.search_mode))
    parts += [attribute_equals(F.col("attributes"), key, value) for key, value in query.attributes]
    if isinstance(query, LogsQuery) and query.cursor is not None:
        parts.append(after_cursor(query.cursor, partitioned))
    return reduce(lambda left, right: left & right, parts, F.lit(True))
