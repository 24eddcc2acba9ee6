import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loglake.functions.attributes import attribute_equals, with_attributes
from loglake.functions.buckets import BUCKET_MICROS, bucket_start
from loglake.functions.isotime import day_number, day_text, iso_timestamp, micros_of, parse_iso_micros
from loglake.functions.numbers import plain_number_text, script_number_text
from loglake.functions.patterns import message_matches, search_pattern

UTC = dt.timezone.utc


def micros(*args, offset=0):
    return micros_of(dt.datetime(*args, tzinfo=UTC)) - offset * 60_000_000


# Texts and the instants they name, written out by hand.
TIMES = {
    "2026-07-20T14:32:01Z": micros(2026, 7, 20, 14, 32, 1),
    "2026-07-20T14:32:01.5Z": micros(2026, 7, 20, 14, 32, 1, 500000),
    "2026-07-20T14:32:01.123456789Z": micros(2026, 7, 20, 14, 32, 1, 123456),
    "2026-07-20T14:32:01+0530": micros(2026, 7, 20, 14, 32, 1, offset=330),
    "2026-07-20T14:32:01.9+05:30": micros(2026, 7, 20, 14, 32, 1, 900000, offset=330),
    "2026-07-20T14:32:01+23:00": micros(2026, 7, 20, 14, 32, 1, offset=23 * 60),
    "2026-07-20T14:32:01-18:30": micros(2026, 7, 20, 14, 32, 1, offset=-(18 * 60 + 30)),
    "2026-07-20T14:32:01-00:01": micros(2026, 7, 20, 14, 32, 1, offset=-1),
    "2024-02-29T00:00:00Z": micros(2024, 2, 29),
    "2000-01-01T00:00:00.123456Z": micros(2000, 1, 1, 0, 0, 0, 123456),
    "1969-12-31T23:59:59.9999999Z": -1,
    "0000-02-29T00:00:00Z": -62_162_121_600_000_000,
    "2023-02-29T00:00:00Z": None,
    "2026-02-30T00:00:00Z": None,
    "2026-04-31T00:00:00Z": None,
    "1900-02-29T00:00:00Z": None,
    "2026-13-01T00:00:00Z": None,
    "2026-00-10T00:00:00Z": None,
    "2026-01-00T00:00:00Z": None,
    "2026-01-01T24:00:00Z": None,
    "2026-01-01T00:60:00Z": None,
    "2026-01-01T00:00:60Z": None,
    "2026-01-01T00:00:00z": None,
    "2026-01-01t00:00:00Z": None,
    "2026-01-01 00:00:00Z": None,
    "2026-01-01T00:00:00": None,
    "2026-01-01T00:00Z": None,
    "2026-01-01T00:00:00.Z": None,
    "2026-01-01T00:00:00.1234567890Z": None,
    "2026-01-01T00:00:00+24:00": None,
    "2026-01-01T00:00:00+05:60": None,
    "2026-01-01T00:00:00+5:00": None,
    "2026-01-01T00:00:00Z\n": None,
    " 2026-01-01T00:00:00Z": None,
    "+2026-01-01T00:00:00Z": None,
    "٢٠٢٦-01-01T00:00:00Z": None,
    "not-a-date": None,
    "": None,
}


def test_timestamp_grammar_on_the_driver():
    assert {text: parse_iso_micros(text) for text in TIMES} == TIMES


def test_day_numbers(spark):
    days = [-800_000, -719_529, -719_528, -719_162, -1, 0, 19_787, 2_932_896]
    rows = spark.createDataFrame([(d,) for d in days], "d int")
    texts = dict(rows.selectExpr("d", "cast(date_from_unix_date(d) as string)").collect())
    assert {d: day_text(d) for d in days} == texts
    assert [day_number(texts[d]) for d in days] == days


def test_timestamp_grammar_as_a_column(spark):
    rows = spark.createDataFrame([(t,) for t in TIMES], "t string")
    got = rows.select("t", F.unix_micros(iso_timestamp(F.col("t")))).collect()
    assert dict(got) == TIMES


def test_session_zone_does_not_matter(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        test_timestamp_grammar_as_a_column(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


# number -> (plain text, script text)
NUMBERS = {
    0.0: ("0", "0"), -0.0: ("0", "0"), 1.0: ("1", "1"), 1.5: ("1.5", "1.5"), -2.25: ("-2.25", "-2.25"),
    0.1: ("0.1", "0.1"), 123456.0: ("123456", "123456"), 1e20: ("1" + "0" * 20, "1" + "0" * 20),
    1e21: ("1" + "0" * 21, "1e+21"), -1.25e25: ("-125" + "0" * 23, "-1.25e+25"),
    1e-6: ("0.000001", "0.000001"), 1e-7: ("0.0000001", "1e-7"), 1.5e-9: ("0.0000000015", "1.5e-9"),
    8.41e21: ("841" + "0" * 19, "8.41e+21"), 2.0 ** 53: ("9007199254740992", "9007199254740992"),
    0.1 + 0.2: ("0.30000000000000004", "0.30000000000000004"), 1e300: ("1" + "0" * 300, "1e+300"),
    1e-300: ("0." + "0" * 299 + "1", "1e-300"),
    float("inf"): (None, "Infinity"), float("-inf"): (None, "-Infinity"),
}


def test_number_texts(spark):
    rows = spark.createDataFrame([(n,) for n in NUMBERS], "n double")
    got = rows.selectExpr("n", plain_number_text("n"), script_number_text("n")).collect()
    assert {row[0]: (row[1], row[2]) for row in got} == {n + 0.0: v for n, v in NUMBERS.items()}


def significant(text):
    return len(Decimal(text).normalize().as_tuple().digits)


def test_number_texts_read_back(spark):
    import random
    import struct

    rng = random.Random(7)
    doubles = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)]
    doubles = [d for d in doubles if d == d and abs(d) != float("inf")]
    doubles += [round(rng.uniform(-1e6, 1e6), rng.randint(0, 6)) for _ in range(3000)]
    rows = spark.createDataFrame([(d,) for d in doubles], "n double")
    for n, plain, script in rows.selectExpr("n", plain_number_text("n"), script_number_text("n")).collect():
        assert float(plain) == n and float(script) == n
        assert "e" not in plain
        # the runtime's own shortest form may be one digit longer
        assert significant(script) <= significant(repr(n)) + 1


def attributes_of(spark, *objects):
    rows = spark.createDataFrame([(o,) for o in objects], "o string")
    return with_attributes(rows, F.try_parse_json("o"))


def test_attribute_texts(spark):
    objects = {
        "{}": {},
        '{"a":"x","b":2,"c":true,"d":1.50,"e":2.0}': {"a": "x", "b": "2", "c": "true", "d": "1.5", "e": "2"},
        '{"a":1e21,"b":1e-7,"c":-0,"d":1.5e3}': {"a": "1" + "0" * 21, "b": "0.0000001", "c": "0", "d": "1500"},
        '{"a":9007199254740993}': {"a": "9007199254740992"},
        '{"a":"DOUBLE","b: DOUBLE":"ARRAY<"}': {"a": "DOUBLE", "b: DOUBLE": "ARRAY<"},
        '{"a":0.30000000000000004}': {"a": "0.30000000000000004"},
        '{"a":1,"a":2}': {"a": "2"},
        '{"é \\"q\\".x":"\\u00fc\\n"}': {'é "q".x': "ü\n"},
        '{"a":"1e5","b":"12345678901234567890"}': {"a": "1e5", "b": "12345678901234567890"},
    }
    got = attributes_of(spark, *objects).collect()
    assert {row["o"]: row["attributes"] for row in got} == objects


def test_attribute_json_keeps_types(spark):
    import json

    objects = ['{"a":"3","b":3,"c":true,"d":"true"}', '{"x":1e21,"y":"1e21","z":false}', '{"k \\"":"v\\\\"}']
    for row in attributes_of(spark, *objects).collect():
        assert json.loads(row["attributes_json"]) == json.loads(row["o"])
        assert " " not in row["attributes_json"].replace("k ", "")


@pytest.mark.parametrize("key, value, expected", [
    ("n", "3", {1, 2, 3}), ("n", "3.0", {4}), ("n", "true", {5, 6}), ("n", "TRUE", set()),
    ("missing", "", set()), ("a b.c\"'", "x", {7}), ("empty", "", {8}),
])
def test_attribute_equality(spark, key, value, expected):
    rows = [
        (1, '{"n":3}'), (2, '{"n":"3"}'), (3, '{"n":3.0}'), (4, '{"n":"3.0"}'), (5, '{"n":true}'),
        (6, '{"n":"true"}'), (7, '{"a b.c\\"\'":"x"}'), (8, '{"empty":""}'),
    ]
    df = with_attributes(spark.createDataFrame(rows, "id int, o string"), F.try_parse_json("o"))
    hits = df.filter(attribute_equals(F.col("attributes"), key, value)).collect()
    assert {row["id"] for row in hits} == expected


MESSAGES = ["50% off", "500 off", "user_4x", "userX4x", "a\\b", "tail%", "line\nbreak", "Ünder", "ünder", "d", ""]


@pytest.mark.parametrize("term, expected", [
    ("50%", ["50% off", "500 off"]),
    ("50\\%", ["50% off"]),
    ("er_4", ["user_4x", "userX4x"]),
    ("er\\_4", ["user_4x"]),
    ("USER", ["user_4x", "userX4x"]),
    ("a\\\\b", ["a\\b"]),
    ("\\", ["tail%"]),
    ("\\d", ["Ünder", "ünder", "d"]),
    ("line_break", ["line\nbreak"]),
    ("ÜNDER", ["Ünder", "ünder"]),
    ("", MESSAGES),
])
def test_search_pattern(spark, term, expected):
    rows = spark.createDataFrame([(m,) for m in MESSAGES], "message string")
    hits = [row[0] for row in rows.filter(message_matches(F.col("message"), term)).collect()]
    assert sorted(hits) == sorted(expected)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab%_\\ ", max_size=6))
def test_substring_mode_finds_the_term_itself(term):
    pattern = search_pattern(term, "substring")
    plain = pattern[1:-1].replace("\\\\", "\0").replace("\\%", "%").replace("\\_", "_").replace("\0", "\\")
    assert plain == term


def test_unknown_search_mode():
    with pytest.raises(ValueError):
        search_pattern("x", "regex")


def test_buckets(spark):
    instants = [-1, 0, 1, 59_999_999, 60_000_000, 86_400_000_000 - 1, -86_400_000_000, micros(2024, 2, 29, 13, 7, 31)]
    rows = spark.createDataFrame([(m,) for m in instants], "m long").withColumn("t", F.timestamp_micros("m"))
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        for name, width in BUCKET_MICROS.items():
            got = rows.select("m", F.unix_micros(bucket_start(F.col("t"), name))).collect()
            assert dict(got) == {m: m // width * width for m in instants}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
