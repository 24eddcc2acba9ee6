"""Record validation: one pass that tells accepted from rejected records.

The first failing rule names the reason.  Everything is a Column expression.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import has_infinity, is_flat, is_plain, json_text, plain_text_map, text_map
from ..functions.isotime import iso_timestamp, micros_literal, micros_of
from ..functions.variants import as_members, as_text, kind, script_text
from ..schema import LEVELS, LOG_COLUMNS
from ..sources.envelopes import explode_items

# The reasons shown to clients and the clock skew allowed.
INVALID_BODY = "Invalid request body"
NOT_AN_OBJECT = "log must be an object"
BAD_TIMESTAMP = "timestamp must be a valid ISO datetime"
BAD_SERVICE = "service must be a non-empty string"
BAD_MESSAGE = "message must be a non-empty string"
BAD_ATTRIBUTES = "attributes must be a flat object with string, number, or boolean values"
MAX_FUTURE_SKEW_MS = 300_000


_OTHER_LEVEL = "level of another type"
_FIELDS = "struct<timestamp:variant,level:variant,service:variant,message:variant,attributes:variant>"


def _arrival(now: dt.datetime | Column | None) -> Column:
    if now is None:
        return F.col("received_at")
    return now if isinstance(now, Column) else micros_literal(micros_of(now))


def _text(field: str) -> str:
    return f"CASE WHEN {kind(f'_item.{field}')} = 'STRING' THEN {as_text(f'_item.{field}')} END"


def validate_items(items: DataFrame, now: dt.datetime | Column | None = None) -> DataFrame:
    """Add ``reason`` (NULL = accepted) and the typed record to exploded items.

    ``now`` is the arrival time that bounds future timestamps: one instant, a
    column, or by default the request's ``received_at``.
    """
    arrived = items.withColumn("_arrived", F.unix_millis(_arrival(now)))
    return _finish(_judge(arrived))


def _judge(items: DataFrame) -> DataFrame:
    """Judge all ordinary items in generated code.

    Only text leaves this part, never the parsed value, which carries its whole
    body's key dictionary.
    """
    texts = items.selectExpr(
        "request", "request_id", "index", "item", "_arrived",
        f"try_variant_get(item, '$', '{_FIELDS}') AS _item",
    ).selectExpr(
        "*",
        f"{_text('timestamp')} AS _timestamp",
        f"{_text('level')} AS level",
        f"nullif({_text('service')}, '') AS service",
        f"nullif({_text('message')}, '') AS message",
        f"{kind('_item.level')} AS _level_kind",
        f"{kind('_item.attributes')} AS _schema",
        "to_json(_item.attributes) AS _json",
    )
    levels = ", ".join(f"'{level}'" for level in LEVELS)
    shown_level = f"""CASE
        WHEN _level_kind IS NULL THEN 'undefined'
        WHEN _level_kind = 'VOID' THEN 'null'
        WHEN _level_kind IN ('STRING', 'BOOLEAN') THEN {as_text('_item.level')}
        WHEN _level_kind LIKE 'OBJECT<%' THEN '[object Object]' END"""
    reason = f"""CASE
        WHEN index IS NULL THEN '{INVALID_BODY}'
        WHEN _item IS NULL THEN '{NOT_AN_OBJECT}'
        WHEN timestamp IS NULL OR unix_millis(timestamp) - _arrived > {MAX_FUTURE_SKEW_MS}
            THEN '{BAD_TIMESTAMP}'
        WHEN NOT coalesce(level IN ({levels}), false)
            THEN coalesce({_level_reason(shown_level)}, '{_OTHER_LEVEL}')
        WHEN service IS NULL THEN '{BAD_SERVICE}'
        WHEN message IS NULL THEN '{BAD_MESSAGE}'
        WHEN _schema NOT LIKE 'OBJECT<%' THEN '{BAD_ATTRIBUTES}' END"""
    return texts.withColumn("timestamp", iso_timestamp(F.col("_timestamp"))).selectExpr(
        "*",
        f"{reason} AS _reason",
        f"_schema IS NULL OR ({is_plain('_schema', '_json')}) AS _plain",
    ).selectExpr(
        "request", "request_id", "index", "_reason", "timestamp", "level", "service", "message", "_plain",
        f"""CASE WHEN _schema IS NULL THEN cast(map() AS map<string,string>)
            WHEN _plain THEN {plain_text_map('_item.attributes')} END AS _map""",
        "coalesce(_json, '{}') AS _json",
        f"CASE WHEN _reason = '{_OTHER_LEVEL}' THEN to_json(_item.level) END AS _level_json",
        "CASE WHEN _reason IS NOT NULL OR NOT _plain THEN to_json(item) END AS raw",
        # Numbers beyond a double print as the text "Infinity".
        "CASE WHEN contains(_schema, 'DOUBLE') AND contains(_json, 'Infinity\"') THEN _item.attributes END AS _vast",
    )


def _finish(judged: DataFrame) -> DataFrame:
    """Look again at the few items that need higher-order functions.

    These are attributes that are not plain and levels that are a number or an
    array; for all other rows the columns added here stay NULL.
    """
    row = f"""named_struct(
        'request', request, 'request_id', request_id, 'index', index,
        'reason', CASE
            WHEN _reason = '{_OTHER_LEVEL}' THEN {_level_reason(script_text('_level'))}
            WHEN _reason IS NOT NULL OR _plain THEN _reason
            WHEN NOT {is_flat('_members')} OR {has_infinity('_vast')} THEN '{BAD_ATTRIBUTES}' END,
        'timestamp', timestamp, 'level', level, 'service', service, 'message', message,
        'attributes', attributes,
        'attributes_json', CASE WHEN _plain THEN _json ELSE {json_text('_members', 'attributes')} END,
        'raw', raw)"""
    # A filter on the reason is not moved below a generator, so it reads the
    # finished reason instead of repeating all of the above for every row.
    return judged.selectExpr(
        "*",
        "try_parse_json(_level_json) AS _level",
        f"""CASE WHEN _reason IS NULL AND NOT _plain
            THEN {as_members('try_parse_json(_json)')} END AS _members""",
    ).selectExpr(
        "*", f"CASE WHEN _plain THEN _map ELSE {text_map('_members')} END AS attributes"
    ).selectExpr(f"inline(array({row}))")


def _level_reason(text: str) -> str:
    return f"concat('invalid level: ', chr(39), {text}, chr(39))"


def validate(envelopes: DataFrame, now: dt.datetime | Column | None = None) -> DataFrame:
    """Judge every item of every request; an unusable body is one row without index."""
    return validate_items(explode_items(envelopes), now)


def accepted_logs(judged: DataFrame) -> DataFrame:
    """The valid records; unknown input fields are already gone."""
    return judged.filter(F.col("reason").isNull()).select("request_id", "index", *LOG_COLUMNS)


def rejects(judged: DataFrame) -> DataFrame:
    """The refused items with their position in the request."""
    return judged.filter(F.col("reason").isNotNull()).select("request_id", "index", "reason", "raw")


def summarize(judged: DataFrame) -> DataFrame:
    """Per request: accepted count, rejects in index order, and whether it succeeded.

    One request is one input row, whatever its id; so all its items sit in one
    task and the partial aggregate leaves a single row per request to shuffle.
    """
    refused = F.when(
        F.col("reason").isNotNull() & F.col("index").isNotNull(), F.struct("index", "reason")
    )
    summary = judged.groupBy("request").agg(
        F.first("request_id").alias("request_id"),
        F.count_if(F.col("reason").isNull()).alias("accepted"),
        F.array_sort(F.collect_list(refused)).alias("rejected"),
        F.max(F.when(F.col("index").isNull(), F.col("reason"))).alias("error"),
    )
    return summary.drop("request").withColumn("ok", F.col("accepted") > 0)
