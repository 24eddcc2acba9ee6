import base64
import json
import re

import pytest
from pyspark.sql import functions as F

from loglake import Cursor, InvalidQuery, decode_cursor, encode_cursor
from loglake.plans.cursor import cursor_column, decoded_cursor

AT = "2026-07-20T14:32:01.123Z"


def packed(payload) -> str:
    text = payload if isinstance(payload, str) else json.dumps(payload)
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def test_round_trip_beyond_double_precision():
    text = encode_cursor(Cursor(AT, "9007199254740993"))
    assert re.fullmatch(r"[A-Za-z0-9_-]+", text)
    assert decode_cursor(text) == Cursor(AT, "9007199254740993")


def test_version_may_be_written_as_a_float():
    assert decode_cursor(packed({"v": 1.0, "timestamp": AT, "id": "1"})) == Cursor(AT, "1")


@pytest.mark.parametrize("text", [
    "", "bad", "not+base64url", "a", "e30=", packed({}), packed([]), packed("null"), packed("5"),
    packed('{"v":1,'), packed("﻿{}"),
    packed({"v": 2, "timestamp": AT, "id": "1"}),
    packed({"v": True, "timestamp": AT, "id": "1"}),
    packed({"v": "1", "timestamp": AT, "id": "1"}),
    packed({"v": 1, "timestamp": "2026-02-30T00:00:00Z", "id": "1"}),
    packed({"v": 1, "timestamp": 5, "id": "1"}),
    packed({"v": 1, "timestamp": AT}),
    packed({"v": 1, "timestamp": AT, "id": 1}),
    packed({"v": 1, "timestamp": AT, "id": "0"}),
    packed({"v": 1, "timestamp": AT, "id": "01"}),
    packed({"v": 1, "timestamp": AT, "id": "-1"}),
    packed({"v": 1, "timestamp": AT, "id": "1\n"}),
    packed({"v": 1, "timestamp": AT, "id": str(2 ** 63)}),
    packed('{"v":1,"timestamp":"%s","id":"1","x":NaN}' % AT),
])
def test_bad_cursors(text):
    with pytest.raises(InvalidQuery, match="^Invalid cursor$"):
        decode_cursor(text)


def test_trailing_bits_must_be_zero():
    good = encode_cursor(Cursor(AT, "12"))
    changed = [good[:-1] + c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"]
    readable = 0
    for text in changed:
        try:
            decode_cursor(text)
            readable += 1
        except InvalidQuery:
            pass
    assert readable == 1


def test_column_and_driver_agree(spark, make_logs):
    rows = [(i, f"2024-03-0{i % 9 + 1}T10:00:00.{i:06d}Z") for i in range(1, 200, 7)]
    logs = make_logs(rows)
    shown = logs.select("id", cursor_column(F.col("timestamp"), F.col("id")).alias("c")).collect()
    expected = {row_id: encode_cursor(Cursor(at, str(row_id))) for row_id, at in rows}
    assert {row["id"]: row["c"] for row in shown} == expected


ODD_PAYLOADS = [
    '{"v":1,"timestamp":"2026-07-20T14:32:01.123Z","id":"9007199254740993"}',
    '{"v":1.0,"timestamp":"2026-07-20T14:32:01+05:30","id":"9223372036854775807","x":{"y":[]}}',
    '{"v":1,"timestamp":"2026-07-20T14:32:01Z","id":"9223372036854775808"}',
    '{"v":true,"timestamp":"2026-07-20T14:32:01Z","id":"1"}', '{"v":"1","timestamp":"2026-07-20T14:32:01Z","id":"1"}',
    '{"v":1,"timestamp":"2026-02-30T14:32:01Z","id":"1"}', '{"v":1,"timestamp":5,"id":"1"}',
    '{"v":1,"timestamp":"2026-07-20T14:32:01Z","id":"01"}', '{"v":1,"timestamp":"2026-07-20T14:32:01Z","id":"1\\n"}',
    '{"v":1,"timestamp":"2026-07-20T14:32:01Z","id":"1"} 5', '{"v":1,"timestamp":"2026-07-20T14:32:01Z","id":"1"},{}',
    '{"v":1,"timestamp":"2026-07-20T14:32:01Z","id":"1"},"z":{}', '{"v":1,"timestamp":"2026-07-20T14:32:01Z"}',
    '{"v":1,"id":"1"}', '{"v":null,"timestamp":null,"id":null}', "[]", "{}", "5", "null", '"x"', "{", "NaN", " ",
    '{"v":2,"v":1,"timestamp":"2026-07-20T14:32:01Z","id":"7"}', '  {"v":1,"timestamp":"2026-07-20T14:32:01Z","id":"8"}  ']


def test_column_decodes_what_the_function_does(spark):
    encoded = [base64.urlsafe_b64encode(p.encode()).decode().rstrip("=") for p in ODD_PAYLOADS]
    encoded += [base64.urlsafe_b64encode(b"\xff{}").decode().rstrip("="), "", "=", "A", "+A", "QQ==", "QR", "é", "a b",
                encoded[0] + "=", encoded[0] + "\n", encoded[0][:-1]]
    rows = spark.createDataFrame([(text,) for text in encoded] + [(None,)], "text string").select(
        "text", decoded_cursor(F.col("text")).alias("found")).select(
        "text", F.unix_micros("found.timestamp").alias("micros"), F.col("found.id").alias("id")).collect()
    for row in rows:
        try:
            cursor = decode_cursor(row.text) if row.text is not None else None
        except InvalidQuery:
            cursor = None
        assert (row.micros, row.id) == ((cursor.micros, int(cursor.id)) if cursor else (None, None)), row.text
    assert sum(row.id is not None for row in rows) >= 4
