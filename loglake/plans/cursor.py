"""Opaque page positions: unpadded base64url of a small JSON object."""

from __future__ import annotations

import base64
import json
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.isotime import iso_micros_text, iso_timestamp, parse_iso_micros
from .errors import InvalidQuery

_MAX_ID = 2 ** 63 - 1


@dataclass(frozen=True)
class Cursor:
    """The (timestamp, id) of the last row of a page."""

    timestamp: str
    id: str

    @property
    def micros(self) -> int:
        return parse_iso_micros(self.timestamp)


def encode_cursor(cursor: Cursor) -> str:
    payload = json.dumps(
        {"v": 1, "timestamp": cursor.timestamp, "id": cursor.id}, separators=(",", ":")
    )
    return _to_base64url(payload.encode())


def decode_cursor(text: str) -> Cursor:
    payload = _payload(text)
    version, timestamp, row_id = (payload.get(key) for key in ("v", "timestamp", "id"))
    acceptable = (
        isinstance(version, (int, float))
        and not isinstance(version, bool)
        and version == 1
        and isinstance(timestamp, str)
        and parse_iso_micros(timestamp) is not None
        and isinstance(row_id, str)
        and re.fullmatch(r"[1-9][0-9]{0,18}", row_id)
        and int(row_id) <= _MAX_ID
    )
    if not acceptable:
        raise InvalidQuery("Invalid cursor")
    return Cursor(timestamp, row_id)


def cursor_column(timestamp: Column, row_id: Column) -> Column:
    """The cursor of every row, for exports that hand out positions in bulk."""
    payload = F.concat(
        F.lit('{"v":1,"timestamp":"'),
        iso_micros_text(timestamp),
        F.lit('","id":"'),
        row_id.cast("string"),
        F.lit('"}'),
    )
    return F.rtrim(F.translate(F.base64(F.encode(payload, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def decoded_cursor(text: Column) -> Column:
    """struct(timestamp, id) of each cursor text, null for null and whatever ``decode_cursor`` refuses.

    The same checks as there, in built-in expressions: alphabet, canonical
    form, one JSON object and nothing behind it, version, time and id.
    """
    missing = F.repeat(F.lit("="), F.pmod(-F.length(text), F.lit(4)).cast("int"))
    raw = F.try_to_binary(F.concat(F.translate(text, "-_", "+/"), missing), F.lit("base64"))
    canonical = F.rtrim(F.translate(F.base64(raw), "+/\r\n", "-_"), F.lit("=")) == text
    return F.transform(
        F.array(F.when(text.rlike(r"\A[A-Za-z0-9_-]+\z") & canonical, F.make_valid_utf8(raw.cast("string")))),
        _position_of)[0]


def _position_of(payload: Column) -> Column:
    # Text behind a value is told by what it does inside brackets and braces.
    listed = F.try_parse_json(F.concat(F.lit("["), payload, F.lit("]")))
    alone = (listed.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
             & F.try_parse_json(F.concat(F.lit('{"w":'), payload, F.lit("}"))).isNotNull())
    value = F.try_parse_json(payload)

    def member(name: str, kind: str) -> Column:
        return F.try_variant_get(value, f"$.{name}", kind)

    def is_kind(name: str, pattern: str) -> Column:
        return F.coalesce(F.schema_of_variant(member(name, "variant")).rlike(pattern), F.lit(False))

    instant, row_id = iso_timestamp(member("timestamp", "string")), member("id", "string")
    number = row_id.try_cast("long")
    acceptable = (
        alone & F.schema_of_variant(value).startswith("OBJECT")
        & is_kind("v", r"\A(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (member("v", "double") == 1)
        & is_kind("timestamp", r"\ASTRING") & instant.isNotNull()
        & is_kind("id", r"\ASTRING") & row_id.rlike(r"\A[1-9][0-9]{0,18}\z") & number.isNotNull())
    return F.when(acceptable, F.struct(instant.alias("timestamp"), number.alias("id")))


def _to_base64url(raw: bytes) -> str:
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def _payload(text: str) -> dict:
    def no_constant(name: str):
        raise ValueError(name)

    try:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", text):
            raise ValueError("alphabet")
        raw = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
        if _to_base64url(raw) != text:
            raise ValueError("not canonical")
        payload = json.loads(raw.decode("utf-8", "replace"), parse_constant=no_constant)
    except (ValueError, RecursionError):
        raise InvalidQuery("Invalid cursor") from None
    if not isinstance(payload, dict):
        raise InvalidQuery("Invalid cursor")
    return payload
