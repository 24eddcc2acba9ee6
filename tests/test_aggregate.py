import datetime as dt
import itertools

import pytest

from loglake import AggregateQuery, aggregate_logs, aggregate_rollup, build_rollup
from loglake.functions.buckets import BUCKET_MICROS
from loglake.functions.isotime import parse_iso_micros
from loglake.operators.rollup import rollup_answers

ROWS = [
    (1, "2024-03-01T10:00:00Z", {"service": "b", "level": "error", "attributes": {"k": "1"}}),
    (2, "2024-03-01T10:00:59.999999Z", {"service": "a"}),
    (3, "2024-03-01T10:01:00Z", {"service": "b", "message": "50% Off"}),
    (4, "2024-03-01T10:07:30Z", {"service": "a", "attributes": {"k": "1"}}),
    (5, "2024-03-01T23:59:59Z", {"service": "é"}),
    (6, "1969-12-31T23:59:59.5Z", {"service": "a", "level": "warn"}),
]
WIDE = {"since": "1960-01-01T00:00:00Z", "until": "2030-01-01T00:00:00Z"}


def brute(rows, query):
    """Counts computed row by row."""
    counts = {}
    for row_id, at, extra in rows:
        extra = {"level": "info", "service": "api", "message": f"message {row_id}", "attributes": {}, **extra}
        moment = parse_iso_micros(at)
        if not query.since_micros <= moment < query.until_micros:
            continue
        if any(getattr(query, n) not in (None, extra[n]) for n in ("service", "level")):
            continue
        if query.q is not None and query.q.lower() not in extra["message"].lower():
            continue
        if any(extra["attributes"].get(k) != v for k, v in query.attributes):
            continue
        width = BUCKET_MICROS[query.bucket]
        start = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=moment // width * width)
        key = (start.isoformat(timespec="milliseconds") + "Z", extra[query.group_by] if query.group_by else None)
        counts[key] = counts.get(key, 0) + 1
    return [(*key, counts[key]) for key in sorted(counts, key=lambda k: (k[0], k[1] or ""))]


def shown(df):
    return [tuple(row) for row in df.collect()]


@pytest.mark.parametrize("bucket, group", list(itertools.product(BUCKET_MICROS, [None, "service", "level"])))
def test_against_row_by_row_counts(make_logs, bucket, group):
    params = {**WIDE, "bucket": bucket, **({"group_by": group} if group else {})}
    query = AggregateQuery.parse(params)
    logs = make_logs(ROWS, partitions=3)
    assert shown(aggregate_logs(logs, query)) == brute(ROWS, query)
    assert shown(aggregate_rollup(build_rollup(logs), query)) == brute(ROWS, query)


@pytest.mark.parametrize("extra", [
    {"service": "a"}, {"service": ""}, {"level": "error"}, {"q": "off"}, {"attr.k": "1"},
    {"attr.k": ["1", "2"]}, {"attr.k": "1", "service": "a", "level": "info", "q": "MESSAGE"},
])
def test_filters(make_logs, extra):
    query = AggregateQuery.parse({**WIDE, "bucket": "5m", "group_by": "service", **extra})
    assert shown(aggregate_logs(make_logs(ROWS), query)) == brute(ROWS, query)


def test_first_bucket_may_start_before_since(make_logs):
    query = AggregateQuery.parse({
        "since": "2024-03-01T10:00:30Z", "until": "2024-03-01T10:07:30Z", "bucket": "1h"})
    assert shown(aggregate_logs(make_logs(ROWS), query)) == [("2024-03-01T10:00:00.000Z", None, 2)]


def test_empty_result_has_the_same_columns(make_logs):
    query = AggregateQuery.parse({**WIDE, "bucket": "1d", "service": "none"})
    empty = aggregate_logs(make_logs(ROWS), query)
    assert shown(empty) == []
    assert empty.dtypes == [("start", "string"), ("group", "string"), ("count", "bigint")]


def test_rollup_refuses_what_it_cannot_answer(make_logs):
    rollup = build_rollup(make_logs(ROWS))
    for extra in ({"q": "x"}, {"attr.k": "1"}, {"since": "1960-01-01T00:00:30Z"}):
        query = AggregateQuery.parse({**WIDE, "bucket": "1m", **extra})
        assert not rollup_answers(query)
        with pytest.raises(ValueError):
            aggregate_rollup(rollup, query)


def test_one_shuffle_before_the_final_sort_and_partial_counts(make_logs):
    query = AggregateQuery.parse({**WIDE, "bucket": "1h", "group_by": "service"})
    plan = aggregate_logs(make_logs(ROWS), query)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "partial_count" in plan and "Python" not in plan
