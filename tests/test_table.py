import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import loglake as L
from loglake.functions.isotime import parse_iso_micros
from loglake.operators.aggregate import aggregate_logs
from loglake.session import materialize

WIDE = {"since": "2020-01-01T00:00:00Z", "until": "2030-01-01T00:00:00Z"}
BATCH = 1 << 40
NOW = dt.datetime(2024, 3, 20, 12, 0, 30, tzinfo=dt.timezone.utc)


def some_rows(seed, count, first=1):
    rng = random.Random(seed)
    return [
        (
            first + n,
            f"2024-03-{rng.randint(1, 6):02d}T{rng.randint(9, 11):02d}:{rng.randint(0, 3):02d}:"
            f"{rng.randint(0, 59):02d}.{rng.randint(0, 3):06d}Z",
            {"service": rng.choice(["a", "b", "c"]), "level": rng.choice(["info", "error"]),
             "attributes": {"n": str(n % 3)}},
        )
        for n in range(count)
    ]


def stored(table):
    return {row["id"]: row["message"] for row in table.scan().select("id", "message").collect()}


def test_empty_table(table):
    assert table.scan().count() == 0
    assert table.page(L.LogsQuery()).logs == []
    assert table.aggregate(L.AggregateQuery.parse({**WIDE, "bucket": "1d"})).collect() == []
    assert table.retain(NOW) == 0
    table.truncate()
    assert table.scan().count() == 0


def test_empty_append_changes_nothing(table, make_logs):
    assert table.append(make_logs([]).drop("id")) == 0
    assert table.batches() == []


def test_ids_are_dense_unique_and_continue(table, make_logs):
    order = (F.asc("timestamp"), F.asc("message"))
    rows = some_rows(1, 200)
    assert table.append(make_logs(rows, 5), order_by=order) == 200
    expected = sorted(rows, key=lambda r: (r[1], f"message {r[0]}"))
    assert stored(table) == {n: f"message {row[0]}" for n, row in enumerate(expected, 1)}
    table.append(make_logs(some_rows(2, 50, first=1000), 3))
    assert sorted(stored(table)) == [*range(1, 201), *range(BATCH + 1, BATCH + 51)]


def test_order_inside_a_task_is_kept(table, make_logs):
    rows = [(n, "2024-03-01T00:00:00Z") for n in range(1, 41)]
    table.append(make_logs(rows).coalesce(1))
    assert stored(table) == {n: f"message {n}" for n in range(1, 41)}


def test_rows_come_back_unchanged(table, make_logs):
    rows = [(1, "2000-01-01T00:00:00.123456Z", {"message": "ünï\n\U0001f600", "attributes": {"k": "v", "e": ""}})]
    table.append(make_logs(rows))
    row = table.scan().withColumn("m", F.unix_micros("timestamp")).first()
    assert (row["m"], row["message"], row["attributes"]) == (
        946_684_800_123_456, "ünï\n\U0001f600", {"k": "v", "e": ""})
    assert str(row["log_date"]) == "2000-01-01"


def test_records_from_before_year_one(table, make_logs):
    old = make_logs([(1, "2024-03-01T00:00:00Z"), (2, "2024-03-01T00:00:00Z")]).withColumn(
        "timestamp", F.timestamp_micros(F.when(F.col("id") == 1, -62_167_305_540_000_000).otherwise(0)))
    table.append(old)
    query = L.AggregateQuery.parse({**WIDE, "since": "0000-01-01T00:00:00+23:59", "bucket": "1d"})
    assert table.aggregate(query).agg(F.sum("count")).first()[0] == 2
    assert [log["message"] for log in table.page(L.LogsQuery()).logs] == ["message 2", "message 1"]
    assert table.retain(NOW, L.RetentionOptions(batch_size=1, max_batches_per_run=1)) == 1
    assert list(stored(table).values()) == ["message 2"]


def test_pages_of_a_table(table, make_logs):
    rows = some_rows(5, 120)
    table.append(make_logs(rows[:70], 3))
    table.append(make_logs(rows[70:], 3))
    for extra in ({}, {"service": "a"}, {"attributes": (("n", "1"),), "q": "MESSAGE 1"},
                  {"since": "2024-03-02T10:01:00Z", "until": "2024-03-05T10:00:00Z"}):
        walked, cursor = [], None
        while True:
            page = table.page(L.LogsQuery(limit=41, cursor=cursor, **extra))
            walked += page.logs
            if page.next_cursor is None:
                break
            cursor = L.decode_cursor(page.next_cursor)
        everything = L.fetch_page(table.scan(), L.LogsQuery(limit=1000, **extra)).logs
        assert walked == everything


def check_rollup(table, since="2020-01-01T00:00:00Z", until="2030-01-01T00:00:00Z"):
    query = L.AggregateQuery.parse({"since": since, "until": until, "bucket": "1m", "group_by": "service"})
    assert table.aggregate(query).collect() == aggregate_logs(table.scan(), query).collect()


def test_rollup_agrees_with_the_records(table, make_logs):
    table.append(make_logs(some_rows(6, 90), 3))
    table.append(make_logs(some_rows(7, 90), 3))
    check_rollup(table)
    check_rollup(table, "2024-03-02T10:01:00Z", "2024-03-04T10:02:00Z")
    unaligned = L.AggregateQuery.parse({
        "since": "2024-03-02T10:01:30Z", "until": "2024-03-04T10:02:00Z", "bucket": "1m", "q": "message"})
    assert table.aggregate(unaligned).collect() == aggregate_logs(table.scan(), unaligned).collect()


@pytest.mark.parametrize("bound", [37, 100, None])
def test_retention_against_sorting(table, make_logs, bound):
    """Repeated runs, with late records arriving between them."""
    bounded = bound is not None
    options = L.RetentionOptions(days=15, batch_size=bound or 1, max_batches_per_run=1)
    cutoff = parse_iso_micros("2024-03-05T12:00:30Z")
    order = (F.asc("timestamp"), F.asc("message"))
    alive = {}
    for turn in range(3):
        table.append(make_logs(some_rows(10 + turn, 80, first=1000 * turn), 3), order_by=order)
        alive = {
            r["id"]: r["m"] for r in table.scan().select("id", F.unix_micros("timestamp").alias("m")).collect()}
        old = sorted((m, i) for i, m in alive.items() if m < cutoff)
        doomed = {i for _, i in (old[:bound] if bounded else old)}
        assert table.retain(NOW, options, bounded=bounded) == len(doomed)
        assert set(stored(table)) == set(alive) - doomed
        check_rollup(table)


def days_on_disk(table):
    return sorted(n for n in table._names(table.logs_path) if n.startswith("log_date"))


def test_longer_retention_does_not_bring_rows_back(table, make_logs):
    table.append(make_logs(some_rows(21, 60), 2))
    table.retain(NOW, L.RetentionOptions(days=15), bounded=False)
    left = stored(table)
    table.append(make_logs([(1, "2024-03-01T00:00:00Z"), (2, "2024-03-05T09:00:00Z")]))
    assert table.retain(NOW, L.RetentionOptions(days=17), bounded=False) == 1
    assert len(stored(table)) == len(left) + 1
    check_rollup(table)


def test_other_session_zone_is_refused(spark, table):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        with pytest.raises(RuntimeError, match="configure"):
            L.LogTable(spark, table.root)
    finally:
        L.configure(spark)


def test_cluster_without_a_shared_folder_is_refused(monkeypatch):
    from types import SimpleNamespace

    from loglake.session import shared_folder

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session)
    context.getCheckpointDir = lambda: "hdfs:///checkpoints/"
    assert shared_folder(session) == "hdfs:///checkpoints"


def test_reader_prunes_days_and_pushes_time(table, make_logs):
    table.append(make_logs(some_rows(23, 60), 2))
    query = L.AggregateQuery.parse({
        "since": "2024-03-02T10:00:30Z", "until": "2024-03-03T10:00:00Z", "bucket": "1h", "q": "message"})
    plan = table.aggregate(query)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp,2024-03-02 10:00:30.0)" in plan
    assert "(log_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "ReadSchema: struct<timestamp:timestamp,message:string>" in plan
    scanned = table.scan(query.since_micros, query.until_micros).inputFiles()
    assert {f.split("log_date=")[1][:10] for f in scanned} == {"2024-03-02", "2024-03-03"}


def test_hot_instant_is_written_by_several_tasks(spark, table, make_logs, monkeypatch):
    monkeypatch.setattr("loglake.sources.table._ROWS_PER_FILE", 50)
    table.append(make_logs([(n, "2024-03-01T00:00:00Z") for n in range(400)], 4))
    assert len(table.scan().inputFiles()) >= 6
    assert len(stored(table)) == 400


def test_rows_small_on_disk_but_large_in_memory_are_sorted_by_several_tasks(table, make_logs, monkeypatch):
    monkeypatch.setattr("loglake.sources.table._SORTED_BYTES_PER_FILE", 1 << 20)
    # 4 MB of messages, which Parquet stores in a few kilobytes.
    wide = [(n, "2024-03-01T20:00:00Z", {"message": "x" * 10_000}) for n in range(400)]
    table.append(make_logs([(900, "2024-03-01T00:00:00Z"), *wide], 4))
    assert len(table.scan().inputFiles()) >= 3 and len(stored(table)) == 401
    # The day that retention writes anew is split like a new one.
    assert table.retain(NOW, L.RetentionOptions(days=19), bounded=False) == 1
    assert len(table.scan().inputFiles()) >= 3 and set(stored(table).values()) == {"x" * 10_000}


def test_materialized_rows_live_in_the_shared_folder(spark, make_logs):
    _, path = materialize(make_logs([(1, "2024-03-01T00:00:00Z")]), "probe")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_repeated_source_replaces_itself(table, make_logs):
    logs = make_logs(some_rows(3, 30))
    assert table.append(logs, source="s-0") == 30
    before = stored(table)
    table.append(make_logs([(77, "2024-07-07T00:00:00Z")]), source="s-1")
    assert table.append(logs, source="s-0") == 30
    assert stored(table) == before | {BATCH + 1: "message 77"}
    # An earlier attempt that stored other days leaves nothing behind.
    assert table.append(make_logs([(78, "2024-07-08T00:00:00Z")]), source="s-1") == 1
    assert stored(table) == before | {BATCH + 1: "message 78"}
    check_rollup(table)


@pytest.mark.parametrize("broken", ["_write_rollup", "_write_logs"])
def test_failed_append_is_repeated(table, make_logs, monkeypatch, broken):
    table.append(make_logs(some_rows(4, 20)))
    before = stored(table)
    late = make_logs([(n, "2024-05-05T00:00:00Z") for n in range(9)])

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as patch:
        patch.setattr(table, broken, lost)
        with pytest.raises(RuntimeError, match="driver lost"):
            table.append(late, source="s-7")
    assert stored(table) == before
    assert table.append(late, source="s-7") == 9
    assert len(stored(table)) == 29
    check_rollup(table)


@pytest.mark.parametrize("rows", [10, 25, 26, 100])
def test_chunks_before_a_failure_stay(table, make_logs, rows):
    logs = make_logs([(n, f"2024-03-{1 + n % 5:02d}T00:00:00Z") for n in range(1, 51)], 4)
    order = (F.asc("message"),)
    names = sorted(f"message {n}" for n in range(1, 51))

    def fail(chunk):
        if chunk == 2:
            raise RuntimeError("store lost")

    if rows < 25:
        with pytest.raises(RuntimeError, match="store lost"):
            table.append(logs, order_by=order, source="s", chunk_rows=rows, before_chunk=fail)
        held = stored(table)
        assert [held[key] for key in sorted(held)] == names[:2 * rows]
        check_rollup(table)
    assert table.append(logs, order_by=order, source="s", chunk_rows=rows) == 50
    held = stored(table)
    assert [held[key] for key in sorted(held)] == names
    assert sorted(held) == [n // rows * BATCH + n % rows + 1 for n in range(50)]
    check_rollup(table)


def days_on_disk(table):
    return sorted(n for n in table._names(table.logs_path) if n.startswith("log_date"))


def test_whole_expired_days_are_dropped_and_one_day_written_anew(table, make_logs):
    table.append(make_logs(some_rows(20, 100), 3))
    table.append(make_logs([(1, "2024-03-05T00:00:00Z"), (2, "2024-03-01T00:00:00Z")]), source="old")
    untouched = {f for f in table.scan().inputFiles() if "2024-03-06" in f}
    table.retain(NOW, L.RetentionOptions(days=15), bounded=False)
    assert days_on_disk(table) == ["log_date=2024-03-05", "log_date=2024-03-06"]
    assert untouched <= set(table.scan().inputFiles())
    # A batch of that day without survivors is gone as well.
    assert (1, "old") not in table.batches()
    table.append(make_logs([(1, "2024-03-01T00:00:00Z", {"message": "late"})]))
    assert "late" in stored(table).values()
    check_rollup(table)


def test_retention_reads_one_day(spark, table, make_logs, monkeypatch):
    table.append(make_logs(some_rows(24, 100), 3))
    scans, scan = [], table.scan
    monkeypatch.setattr(table, "scan", lambda *a, **k: scans.append(a[:2]) or scan(*a, **k))
    table.retain(NOW, L.RetentionOptions(days=16), bounded=False)
    assert scans[-1][1] - scans[-1][0] == 86_400_000_000


def test_truncate_restarts_ids(table, make_logs):
    table.append(make_logs(some_rows(22, 30)))
    table.append(make_logs(some_rows(23, 30)))
    table.truncate()
    assert stored(table) == {} and days_on_disk(table) == [] and table.batches() == []
    check_rollup(table)
    table.append(make_logs([(9, "2024-03-01T00:00:00Z")]))
    assert list(stored(table)) == [1]


def test_a_walk_over_a_snapshot_shows_nothing_that_arrives_meanwhile(table, make_logs):
    assert table.snapshot() == -1
    table.append(make_logs(some_rows(5, 90), 3))
    begun, cursor, seen, late = table.snapshot(), None, [], 1000
    expected = [(r["timestamp"], r["id"]) for r in table.scan().orderBy(F.desc("timestamp"), F.desc("id")).collect()]
    while True:
        params = {"limit": "40"} if cursor is None else {"limit": "40", "cursor": cursor}
        page = table.page(L.LogsQuery.parse(params), begun)
        seen += [int(log["id"]) for log in page.logs]
        # Newer, older and equal times alike.
        table.append(make_logs(some_rows(6, 30, first=late) + [(late + 99, "2025-01-01T00:00:00Z")], 2))
        cursor, late = page.next_cursor, late + 100
        if cursor is None:
            break
    assert seen == [row_id for _, row_id in expected]
    assert table.scan(snapshot=begun).count() == 90 and table.scan().count() > 150
