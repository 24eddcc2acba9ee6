import datetime as dt
import random

import pytest

from loglake import RetentionOptions, build_rollup, expired, survivors
from loglake.operators.retention import cutoff_micros, nth_oldest

NOW = dt.datetime(2026, 1, 31, tzinfo=dt.timezone.utc)


def ids(df):
    return sorted(row["id"] for row in df.select("id").collect())


def test_row_exactly_at_the_cutoff_stays(make_logs):
    logs = make_logs([
        (1, "2025-12-31T23:59:59.999Z"), (2, "2026-01-01T00:00:00.000Z"), (3, "2026-01-01T00:00:00.001Z")])
    options = RetentionOptions(days=30, batch_size=2)
    assert ids(expired(logs, cutoff_micros(NOW, options))) == [1]
    assert ids(survivors(logs, NOW, options)) == [2, 3]
    assert ids(survivors(logs, NOW, options, bounded=False)) == [2, 3]


def test_nothing_expired(make_logs):
    logs = make_logs([(1, "2026-01-30T00:00:00Z")])
    assert ids(survivors(logs, NOW, RetentionOptions())) == [1]


@pytest.mark.parametrize("seed", range(2))
def test_bounded_run_deletes_the_oldest(make_logs, seed):
    """Many equal instants, so the bound falls inside a tie."""
    rng = random.Random(seed)
    rows = [
        (n, f"2025-1{rng.randint(0, 1)}-0{rng.randint(1, 2)}T00:00:0{rng.randint(0, 2)}.00000{rng.randint(0, 1)}Z")
        for n in rng.sample(range(1, 1000), 80)
    ] + [(5000 + n, "2026-01-20T00:00:00Z") for n in range(5)]
    logs = make_logs(rows, partitions=5)
    oldest_first = [row_id for row_id, _ in sorted(rows, key=lambda r: (r[1], r[0])) if row_id < 5000]
    for bound in (1, 17, 80, 81):
        left = ids(survivors(logs, NOW, RetentionOptions(batch_size=bound, max_batches_per_run=1)))
        assert left == sorted([*oldest_first[bound:], *range(5000, 5005)])


@pytest.mark.parametrize("one_task_rows", [10, 1000])
def test_one_instant_holding_everything_is_still_split(make_logs, monkeypatch, one_task_rows):
    monkeypatch.setattr("loglake.operators.retention._ONE_TASK_ROWS", one_task_rows)
    logs = make_logs([(n, "2025-10-01T00:00:00Z") for n in range(1, 301)], partitions=6)
    assert nth_oldest(logs, 123, build_rollup(logs))[1].id == 123
    assert nth_oldest(logs, 301, build_rollup(logs)) == (300, None)
