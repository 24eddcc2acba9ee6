import random

import pytest

from loglake import Cursor, LogsQuery, all_pages, decode_cursor, encode_cursor, fetch_page, page_rows
from loglake.operators.page import time_windows

SAME = [(n, "2024-03-01T10:00:00.000Z") for n in random.Random(5).sample(range(1, 24), 23)]
CLOSE = [(n, f"2024-03-01T10:00:00.123{n}00Z") for n in range(1, 6)]


def walk(logs, limit, **extra):
    """Every page by cursor, as lists of ids."""
    pages, cursor = [], None
    while True:
        page = fetch_page(logs, LogsQuery(limit=limit, cursor=cursor, **extra))
        pages.append([int(log["id"]) for log in page.logs])
        if page.next_cursor is None:
            return pages
        cursor = decode_cursor(page.next_cursor)


def test_equal_timestamps_page_by_id(make_logs):
    pages = walk(make_logs(SAME, partitions=4), 9)
    assert pages == [list(range(23, 14, -1)), list(range(14, 5, -1)), list(range(5, 0, -1))]


def test_rows_within_one_millisecond_are_all_returned(make_logs):
    assert walk(make_logs(CLOSE, partitions=2), 2) == [[5, 4], [3, 2], [1]]


def test_cursor_only_when_more_rows_exist(make_logs):
    logs = make_logs(SAME)
    assert fetch_page(logs, LogsQuery(limit=23)).next_cursor is None
    page = fetch_page(logs, LogsQuery(limit=22))
    assert decode_cursor(page.next_cursor) == Cursor("2024-03-01T10:00:00.000000Z", "2")


def test_newer_rows_do_not_disturb_a_walk(make_logs):
    first = fetch_page(make_logs(SAME), LogsQuery(limit=10))
    more = make_logs([*SAME, (26, "2024-03-01T11:00:00Z")])
    second = fetch_page(more, LogsQuery.parse({"limit": "10", "cursor": first.next_cursor}))
    ids = [log["id"] for log in first.logs + second.logs]
    assert len(set(ids)) == 20 and "26" not in ids


def test_output_form(make_logs):
    page = fetch_page(make_logs([(7, "2024-03-01T10:00:00.999999Z")]), LogsQuery())
    assert page.logs == [{
        "id": "7", "timestamp": "2024-03-01T10:00:00.999Z", "level": "info", "service": "api",
        "message": "message 7", "attributes": {},
    }]


def test_empty(make_logs):
    page = fetch_page(make_logs(SAME), LogsQuery(service="none"))
    assert page.logs == [] and page.next_cursor is None


@pytest.mark.parametrize("limit", [1, 3, 7, 100])
def test_all_pages_agrees_with_a_walk(make_logs, limit):
    rng = random.Random(limit)
    rows = [(n, f"2024-03-0{rng.randint(1, 3)}T10:00:0{rng.randint(0, 3)}Z") for n in range(1, 61)]
    logs = make_logs(rows, partitions=5)
    expected = [
        (page, position, str(row_id))
        for page, ids in enumerate(walk(logs, limit) if limit > 1 else [[i] for p in walk(logs, 30) for i in p])
        for position, row_id in enumerate(ids)
    ]
    got = all_pages(logs, limit).orderBy("page", "position").collect()
    assert [(r["page"], r["position"], r["id"]) for r in got] == expected


def test_hostile_text_is_only_text(make_logs):
    rows = [(1, "2024-03-01T10:00:00Z", {"service": "pay'); DROP TABLE logs; --", "attributes": {"`k\"`=`k\"`": "%' or ''='"}}),
            (2, "2024-03-01T10:00:00Z")]
    logs = make_logs(rows)
    query = LogsQuery.parse({"service": "pay'); DROP TABLE logs; --", "attr.`k\"`=`k\"`": "%' or ''='"})
    assert [log["id"] for log in fetch_page(logs, query).logs] == ["1"]
    assert fetch_page(logs, LogsQuery(q="m' UNION SELECT 1 --")).logs == []


def test_bounds_are_inclusive_then_exclusive(make_logs):
    logs = make_logs([(n, f"2024-03-01T10:00:0{n}Z") for n in range(1, 6)])
    query = LogsQuery(since="2024-03-01T10:00:02Z", until="2024-03-01T12:00:04+02:00")
    assert [log["id"] for log in fetch_page(logs, query).logs] == ["3", "2"]


def test_top_rows_without_a_full_sort(make_logs):
    cursor = encode_cursor(Cursor("2024-03-01T10:00:00Z", "9"))
    query = LogsQuery.parse({"cursor": cursor, "service": "api", "q": "x"})
    plan = page_rows(make_logs(SAME), query)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan and "Python" not in plan


def test_windows_cover_the_range_once():
    windows = list(time_windows(-5, 10 ** 15))
    assert windows[0][1] == 10 ** 15 and windows[-1][0] == -5
    assert all(a[0] == b[1] for a, b in zip(windows, windows[1:])) and len(windows) < 12
    assert list(time_windows(5, 5)) == []
