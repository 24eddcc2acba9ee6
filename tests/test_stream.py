import json

import pytest

import loglake as L
from loglake.sources.samples import event_requests

from conftest import TESTDATA

NOW = "2024-02-01T00:00:00Z"
BATCH = 1 << 40


def snapshot(table):
    return sorted(tuple(row) for row in table.scan().select("id", "message", "timestamp").collect())


def bare(table):
    columns = ["timestamp", "level", "service", "message", "attributes_json"]
    return sorted(tuple(row) for row in table.scan().select(*columns).collect())


def land(spark, folder, rows):
    for row in rows:
        spark.createDataFrame([row], "request_id string, body string, received_at string").selectExpr(
            "request_id", "body", "to_timestamp(received_at) AS received_at"
        ).write.mode("append").parquet(folder)


def body(*messages):
    return json.dumps({"logs": [
        {"timestamp": "2024-01-31T10:00:00Z", "level": "info", "service": "s", "message": m} for m in messages]})


def run(spark, folder, table, checkpoint, **options):
    stream = L.stream_envelopes(spark, folder, maxFilesPerTrigger="1")
    L.stream_ingest(stream, table, checkpoint, **options).awaitTermination()


def test_stream_equals_batch_and_restart_adds_nothing(spark, tmp_path):
    landing = str(tmp_path / "landing")
    event_requests(spark, TESTDATA).repartition(3).write.parquet(landing)
    batch = L.LogTable(spark, str(tmp_path / "batch"))
    result = L.ingest_batch(L.read_envelopes(spark, landing), batch, rejects_path=str(tmp_path / "refused"))
    assert (result.accepted, result.rejected) == (840, 160)
    assert L.read_rejects(spark, str(tmp_path / "refused")).count() == 160

    streamed = L.LogTable(spark, str(tmp_path / "streamed"))
    rejects_path = str(tmp_path / "rejects")
    for _ in range(2):
        run(spark, landing, streamed, str(tmp_path / "checkpoint"), rejects_path=rejects_path)
        assert bare(streamed) == bare(batch)
        assert L.read_rejects(spark, rejects_path).count() == 160
    first = snapshot(streamed)
    assert len({row[0] for row in first}) == 840


def test_new_requests_continue_ids_and_keep_order(spark, tmp_path):
    landing, checkpoint = str(tmp_path / "landing"), str(tmp_path / "checkpoint")
    table = L.LogTable(spark, str(tmp_path / "table"))
    land(spark, landing, [("a", body("a0", "a1", "a2"), NOW)])
    run(spark, landing, table, checkpoint)
    land(spark, landing, [("b", body("b0", "b1"), NOW), ("bad", "{}", NOW)])
    run(spark, landing, table, checkpoint)
    assert [row[:2] for row in snapshot(table)] == [
        (1, "a0"), (2, "a1"), (3, "a2"), (BATCH + 1, "b0"), (BATCH + 2, "b1")]


def test_body_files(spark, tmp_path):
    folder = tmp_path / "bodies"
    folder.mkdir()
    (folder / "1.json").write_text(body("x", "y"))
    (folder / "2.json").write_text("{broken")
    table = L.LogTable(spark, str(tmp_path / "table"))
    result = L.ingest_batch(L.read_body_files(spark, str(folder)), table)
    assert (result.accepted, result.rejected) == (2, 1)
    stream = L.stream_body_files(spark, str(folder))
    other = L.LogTable(spark, str(tmp_path / "other"))
    L.stream_ingest(stream, other, str(tmp_path / "checkpoint")).awaitTermination()
    assert bare(other) == bare(table)


def test_late_records_are_kept(spark, tmp_path):
    old = json.dumps({"logs": [{"timestamp": "1999-01-01T00:00:00Z", "level": "warn", "service": "s", "message": "m"}]})
    landing = str(tmp_path / "landing")
    land(spark, landing, [("new", body("n"), NOW), ("old", old, NOW)])
    table = L.LogTable(spark, str(tmp_path / "table"))
    run(spark, landing, table, str(tmp_path / "checkpoint"))
    assert sorted(row[1] for row in snapshot(table)) == ["m", "n"]


def test_streams_one_after_the_other(spark, tmp_path):
    table, rejects_path = L.LogTable(spark, str(tmp_path / "table")), str(tmp_path / "rejects")
    for name in ("a", "b", "a"):
        if not (tmp_path / name).exists():
            land(spark, str(tmp_path / name), [(name, body(name, ""), NOW)])
        run(spark, str(tmp_path / name), table, str(tmp_path / f"checkpoint {name}"), rejects_path=rejects_path)
        assert table.rollup().agg({"count": "sum"}).first()[0] == len(snapshot(table))
    assert [row[:2] for row in snapshot(table)] == [(1, "a"), (BATCH + 1, "b")]
    refused = L.read_rejects(spark, rejects_path).collect()
    assert sorted((r["request_id"], r["index"]) for r in refused) == [("a", 1), ("b", 1)]
    assert {r["source"] for r in refused} == {source for _, source in table.batches()}


@pytest.mark.parametrize("chunk_rows", [None, 2])
def test_killed_batches_are_replayed(spark, tmp_path, monkeypatch, chunk_rows):
    """Each attempt dies at another place; in the end every record is there once, under one id."""
    landing, checkpoint = str(tmp_path / "landing"), str(tmp_path / "checkpoint")
    land(spark, landing, [("a", body("a1", "a2", "a3", ""), NOW), ("b", body("b1"), NOW), ("c", body("c1", "c2"), NOW)])
    table = L.LogTable(spark, str(tmp_path / "table"))
    write_logs, write_rollup = table._write_logs, table._write_rollup
    plan = iter(["before records", "after records", "after rollup", None, "after records"])

    def failing(write, place):
        def run(*args):
            now = next(plan, None) if place == "records" else None
            if now == "before records":
                raise RuntimeError("driver lost")
            write(*args)
            if now == "after records":
                raise RuntimeError("driver lost")
        return run

    monkeypatch.setattr(table, "_write_logs", failing(write_logs, "records"))
    monkeypatch.setattr(table, "_write_rollup", failing(write_rollup, "rollup"))
    for _ in range(8):
        try:
            run(spark, landing, table, checkpoint, rejects_path=str(tmp_path / "rejects"), chunk_rows=chunk_rows)
            break
        except Exception as error:
            assert "driver lost" in str(error)
    else:
        raise AssertionError("never ended")
    rows = snapshot(table)
    assert sorted(row[1] for row in rows) == ["a1", "a2", "a3", "b1", "c1", "c2"]
    assert len({row[0] for row in rows}) == 6
    assert table.rollup().agg({"count": "sum"}).first()[0] == 6
    assert L.read_rejects(spark, str(tmp_path / "rejects")).count() == 1
