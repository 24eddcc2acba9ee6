import pytest

from loglake import AggregateQuery, Cursor, InvalidQuery, LogsQuery, RetentionOptions, encode_cursor

HOUR = {"since": "2031-03-09T06:00:00.250Z", "until": "2031-03-09T07:30:00.250Z"}


def test_page_query_reads_every_parameter():
    cursor = Cursor("2031-05-17T21:07:43.908Z", "1234567890123456789")
    query = LogsQuery.parse({
        "service": "ledger", "level": "error", "since": "2031-05-17T20:30:00Z",
        "until": "2031-05-17T22:00:00Z", "q": "refused by bank", "limit": "0100",
        "cursor": encode_cursor(cursor), "attr.place": "rack 7", "attr.shelf": "3",
    })
    assert (query.service, query.level, query.q, query.limit) == ("ledger", "error", "refused by bank", 100)
    assert query.cursor == cursor
    assert query.attributes == (("place", "rack 7"), ("shelf", "3"))


def test_page_query_defaults():
    query = LogsQuery.parse({})
    assert query.limit == 100 and query.cursor is None and query.attributes == ()


def test_repeated_attribute_values_are_all_kept():
    query = LogsQuery.parse({"attr.place": ["rack 7", "rack 9"]})
    assert query.attributes == (("place", "rack 7"), ("place", "rack 9"))


@pytest.mark.parametrize("params, message", [
    (None, "Invalid query parameters"),
    ([], "Invalid query parameters"),
    ({"limit": "0"}, "Invalid limit"),
    ({"limit": "2500"}, "Invalid limit"),
    ({"limit": "many"}, "Invalid limit"),
    ({"limit": "7.25"}, "Invalid limit"),
    ({"limit": "-40"}, "Invalid limit"),
    ({"limit": "٣"}, "Invalid limit"),
    ({"limit": "100000000000000000000100"}, "Invalid limit"),
    ({"limit": "9" * 5000}, "Invalid limit"),
    ({"level": "fatal"}, "Invalid level"),
    ({"level": "ERROR"}, "Invalid level"),
    ({"since": "yesterday"}, "Invalid since"),
    ({"until": "2031-04-31T00:00:00Z"}, "Invalid until"),
    ({"since": "2031-05-17T22:00:00Z", "until": "2031-05-17T20:30:00Z"}, "until must be greater than since"),
    ({"since": "2031-05-17T22:00:00Z", "until": "2031-05-17T22:00:00Z"}, "until must be greater than since"),
    ({"since": "2031-05-17T22:00:00.0001Z", "until": "2031-05-17T22:00:00.0009Z"},
     "until must be greater than since"),
    ({"cursor": "c3Vycmlzc2U"}, "Invalid cursor"),
    ({"attr.": "x"}, "Invalid attribute filter"),
    ({"attr.k": 5}, "Invalid attribute filter"),
    ({"attr.k": []}, "Invalid attribute filter"),
    ({"service": ["a", "b"]}, "Invalid service parameter"),
    ({"colour": ["a", "b"]}, "Invalid colour parameter"),
    ({"colour": "red"}, "Invalid query parameter"),
    ({"bucket": "1m"}, "Invalid query parameter"),
])
def test_bad_page_queries(params, message):
    with pytest.raises(InvalidQuery, match=f"^{message}$"):
        LogsQuery.parse(params)


def test_leading_zeros_do_not_count():
    assert LogsQuery.parse({"limit": "0" * 5000 + "77"}).limit == 77


def test_unknown_search_mode():
    with pytest.raises(InvalidQuery, match="^Invalid search mode$"):
        LogsQuery(q="x", search_mode="regex")


def test_offsets_count_when_bounds_are_compared():
    LogsQuery.parse({"since": "2031-05-17T22:00:00+02:00", "until": "2031-05-17T20:30:00Z"})


@pytest.mark.parametrize("bucket", ["1m", "5m", "1h", "1d"])
@pytest.mark.parametrize("group", [None, "service", "level"])
def test_aggregate_query(bucket, group):
    params = {**HOUR, "bucket": bucket, "attr.k": "v", "q": "x"}
    if group:
        params["group_by"] = group
    query = AggregateQuery.parse(params)
    assert (query.bucket, query.group_by, query.q) == (bucket, group, "x")
    assert query.attributes == (("k", "v"),)


@pytest.mark.parametrize("params, message", [
    ("text", "Invalid query parameters"),
    ({**HOUR}, "Missing or invalid bucket parameter"),
    ({**HOUR, "bucket": ["1m", "5m"]}, "Missing or invalid bucket parameter"),
    ({**HOUR, "bucket": "2m"}, "Invalid bucket parameter"),
    ({**HOUR, "bucket": "1m", "group_by": "message"}, "Invalid group_by parameter"),
    ({**HOUR, "bucket": "1m", "group_by": ["level", "service"]}, "Invalid group_by parameter"),
    ({"until": HOUR["until"], "bucket": "1m"}, "Missing since parameter"),
    ({"since": HOUR["since"], "bucket": "1m"}, "Missing until parameter"),
    ({**HOUR, "bucket": "1m", "limit": "10"}, "Invalid query parameter"),
    ({**HOUR, "bucket": "1m", "cursor": "x"}, "Invalid query parameter"),
    ({**HOUR, "bucket": "2m", "limit": "10"}, "Invalid query parameter"),
    ({**HOUR, "bucket": "2m", "level": "bad"}, "Invalid bucket parameter"),
    ({**HOUR, "bucket": "1m", "level": "bad"}, "Invalid level"),
])
def test_bad_aggregate_queries(params, message):
    with pytest.raises(InvalidQuery, match=f"^{message}$"):
        AggregateQuery.parse(params)


@pytest.mark.parametrize("name", ["days", "batch_size", "max_batches_per_run"])
@pytest.mark.parametrize("value", [0, -1, 1.5, True, "3", float("nan")])
def test_bad_retention_options(name, value):
    with pytest.raises(ValueError, match=f"^{name} must be a positive integer$"):
        RetentionOptions(**{name: value})


def test_retention_defaults():
    assert RetentionOptions().days == 30 and RetentionOptions().max_rows == 100_000
