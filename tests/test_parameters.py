"""Parameters read as columns against the same parameters read one by one."""

import pytest
from pyspark.sql import functions as F

from loglake import AggregateQuery, Cursor, InvalidQuery, LogsQuery, encode_cursor
from loglake.plans.cursor import decode_cursor
from loglake.plans.parameters import aggregate_parameters, page_parameters

HOUR = {"since": "2031-03-09T06:00:00.250Z", "until": "2031-03-09T07:30:00.250Z"}
CURSOR = encode_cursor(Cursor("2031-05-17T21:07:43.908Z", "1234567890123456789"))
COMMON = [
    {}, {"service": ""}, {"service": ["a", "b"]}, {"service": []}, {"service": None}, {"service": [None]},
    {"level": "warn"}, {"level": "WARN"}, {"level": "fatal", "since": "x"}, {"since": "x", "level": "fatal"},
    {"q": "100%"}, {"q": ["a", "b"]}, {"since": "2031-02-29T00:00:00Z"}, {"until": "2031-03-09"}, HOUR,
    {"since": HOUR["until"], "until": HOUR["since"]}, {"since": HOUR["since"], "until": HOUR["since"]},
    {"since": "2031-05-17T22:00:00.0001Z", "until": "2031-05-17T22:00:00.0009Z"},
    {"since": "2031-05-17T22:00:00+02:00", "until": "2031-05-17T20:30:00Z"},
    {"attr.k": "v"}, {"attr.k": ["v", "w"], "attr.l.m": ""}, {"attr.": "x"}, {"attr.k": []}, {"attr.k": ["v", None]},
    {"colour": "red"}, {"colour": ["a", "b"]}, {"colour": []}, {"": "x"},
    {"colour": "red", "level": "fatal"}, {"level": "fatal", "colour": "red"},
]
PAGES = COMMON + [
    {"limit": limit} for limit in (
        "1", "0100", "1000", "1001", "0", "-4", "7.25", "many", "", " 5", "5\n", "٣", "9" * 5000, "0" * 5000 + "77")
] + [{"cursor": cursor} for cursor in (CURSOR, CURSOR + "=", "", "c3Vycmlzc2U", [CURSOR, CURSOR])] + [
    {"bucket": "1m"}, {"limit": "0", "cursor": "x"}, {"cursor": "x", "limit": "0"}, None]
AGGREGATES = [{**more, "bucket": "5m"} for more in COMMON] + [{"bucket": "5m", **HOUR, **more} for more in COMMON] + [
    {**HOUR}, {**HOUR, "bucket": ["1m", "5m"]}, {**HOUR, "bucket": "2m"}, {**HOUR, "bucket": "1d", "group_by": "level"},
    {**HOUR, "bucket": "1d", "group_by": "message"}, {**HOUR, "bucket": "1d", "group_by": []},
    {**HOUR, "bucket": "1d", "limit": "5"}, {"level": "bad", "bucket": "2m"}, {"level": "bad", "limit": "5"},
    {"level": "bad", "group_by": "message", "bucket": "1h"}, {"since": HOUR["since"], "bucket": "1h"}, None]


def one_by_one(kind, params):
    try:
        return None, kind.parse(params)
    except InvalidQuery as error:
        return str(error), None


def as_list(value):
    return [value] if isinstance(value, str) else value


@pytest.mark.parametrize("kind, read, cases", [
    (LogsQuery, page_parameters, PAGES), (AggregateQuery, aggregate_parameters, AGGREGATES)])
def test_columns_read_what_the_driver_reads(spark, kind, read, cases):
    # A Python dict would lose its order on the way.
    rows = [(at, None if params is None else [(name, as_list(value)) for name, value in params.items()])
            for at, params in enumerate(cases)]
    table = spark.createDataFrame(rows, "at int, sent array<struct<name: string, texts: array<string>>>").select(
        "at", F.map_from_entries("sent").alias("params"))
    told = table.select("at", read(F.col("params")).alias("told")).select(
        "at", "told.*", F.unix_micros("told.query.since").alias("since"), F.unix_micros("told.query.until").alias("until"))
    for row in told.collect():
        error, query = one_by_one(kind, cases[row["at"]])
        assert row["error"] == error, cases[row["at"]]
        assert (row["query"] is None) == (query is None)
        if query is not None:
            read_back = row["query"].asDict(recursive=True)
            for name in ("service", "level", "q") + (("limit",) if kind is LogsQuery else ("bucket", "group_by")):
                assert read_back[name] == getattr(query, name)
            assert (row["since"], row["until"]) == (query.since_micros, query.until_micros)
            assert tuple((a["key"], a["text"]) for a in read_back["attributes"]) == query.attributes
            if kind is LogsQuery:
                cursor = read_back["cursor"]
                assert (cursor and str(cursor["id"])) == (query.cursor and query.cursor.id)


def test_the_position_of_a_cursor(spark):
    params = spark.createDataFrame([({"cursor": [CURSOR]},)], "params map<string, array<string>>")
    found = params.select(page_parameters(F.col("params"))["query"]["cursor"].alias("c")).select(
        F.unix_micros("c.timestamp").alias("micros"), "c.id").first()
    expected = decode_cursor(CURSOR)
    assert (found["micros"], str(found["id"])) == (expected.micros, expected.id)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "params map<string, array<string>>")
    assert empty.select(page_parameters(F.col("params"))).count() == 0
