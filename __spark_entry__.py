"""Registered queries and the SQL each must agree with.

``events`` are read as log records (id, timestamp, level, service, message,
attributes), ``documents`` as records with long messages, and request bodies
are packed from all events.  Every query runs over its whole table.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake import (
    AggregateQuery,
    Cursor,
    LogsQuery,
    LogTable,
    RetentionOptions,
    accepted_logs,
    aggregate_logs,
    aggregate_rollup,
    all_pages,
    build_rollup,
    configure,
    encode_cursor,
    expired,
    ingest_batch,
    page_rows,
    read_envelopes,
    rejects,
    stream_envelopes,
    stream_ingest,
    summarize,
    survivors,
    validate,
)
from loglake.functions.isotime import iso_millis_text
from loglake.operators.numbering import number_rows
from loglake.operators.page import LogsPage, present, row_cursors
from loglake.operators.retention import cutoff_micros
from loglake.plans.cursor import cursor_column, decoded_cursor
from loglake.plans.parameters import aggregate_parameters, page_parameters
from loglake.plans.predicates import filter_predicate
from loglake.plans.specs import LogFilter
from loglake.session import materialize, scratch_path
from loglake.sources.envelopes import explode_items
from loglake.sources.samples import document_logs, event_logs, event_requests, unnumbered

try:
    import corpus_pipeline
    from loglake.llm import queries as corpus
except ModuleNotFoundError as missing:
    # The corpus operators may be left out; anything else missing is an error.
    if missing.name not in ("corpus_pipeline", "loglake.llm"):
        raise
    corpus = None

Query = Callable[[SparkSession, str], DataFrame]

_MONTH = {"since": "2024-01-01T00:00:00Z", "until": "2024-02-01T00:00:00Z"}
# Documents lie 37 seconds apart, so this is behind several billions of them.
_END_OF_DOCUMENTS = "9999-01-01T00:00:00Z"
_NOW = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)
_FIFTEEN_DAYS = RetentionOptions(days=15)
_BOUNDED = RetentionOptions(days=15, batch_size=100, max_batches_per_run=3)
_CURSOR = Cursor("2024-01-15T12:00:00.000000Z", "5000")
_COMBINED = {
    "service": "svc-3", "level": "error",
    "since": "2024-01-03T06:00:00Z", "until": "2024-01-28T18:30:00+02:00", "q": "BY USER",
}
_LOG = ["timestamp", "level", "service", "message", "attributes"]


# Queries


def _page(params: dict, source=event_logs) -> Query:
    query = LogsQuery.parse(params)
    return lambda spark, folder: page_rows(source(configure(spark), folder), query)


def _matching(source=event_logs, **filters) -> Query:
    """Every record a filter lets through, without a page limit."""
    spec = LogFilter(**filters)

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return present(source(configure(spark), folder).filter(filter_predicate(spec)))

    return run


def _aggregate(params: dict, source=event_logs) -> Query:
    query = AggregateQuery.parse({**_MONTH, **params})
    return lambda spark, folder: aggregate_logs(source(configure(spark), folder), query)


def _from_rollup(spark: SparkSession, folder: str) -> DataFrame:
    query = AggregateQuery.parse({**_MONTH, "bucket": "1h", "group_by": "service"})
    return aggregate_rollup(build_rollup(event_logs(configure(spark), folder)), query)


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    return validate(event_requests(configure(spark), folder))


def _ingest_envelope(spark: SparkSession, folder: str) -> DataFrame:
    items = explode_items(event_requests(configure(spark), folder))
    return items.select("request_id", F.col("index").cast("long"), F.to_json("item").alias("item"))


def _validate_reasons(spark: SparkSession, folder: str) -> DataFrame:
    reason = F.coalesce("reason", F.lit("accepted")).alias("reason")
    return _judged(spark, folder).select("request_id", F.col("index").cast("long"), reason)


def _ingest_accepted(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(accepted_logs(_judged(spark, folder)), "request_id", F.col("index").cast("long"))


def _ingest_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return rejects(_judged(spark, folder)).withColumn("index", F.col("index").cast("long"))


def _ingest_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = summarize(_judged(spark, folder))
    return summary.select("request_id", "accepted", F.to_json("rejected").alias("rejected"), "ok")


def _assign_ids(spark: SparkSession, folder: str) -> DataFrame:
    kept = accepted_logs(_judged(spark, folder)).select(
        F.col("request_id").cast("long").alias("request"), F.col("index").cast("long").alias("index")
    )
    return number_rows(kept, "id", [F.asc("request"), F.asc("index")])


def _decoded_cursors(spark: SparkSession, folder: str) -> DataFrame:
    """Every event's cursor read back, of which most are damaged in some way first."""
    logs = event_logs(configure(spark), folder)
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    case = (F.col("id") - 1) % 12
    number = F.when(case == 4, "0").when(case == 10, "9223372036854775808").otherwise(F.col("id").cast("string"))
    plain = F.concat(
        F.lit('{"v":'), F.when(case == 3, "2").otherwise("1"), F.lit(',"timestamp":"'),
        F.when(case == 5, F.replace(stamp, F.lit("Z"), F.lit(""))).otherwise(stamp), F.lit('","id":'),
        F.when(case == 8, number).otherwise(F.concat(F.lit('"'), number, F.lit('"'))), F.lit("}"))
    other = F.concat(F.lit('{ "id": "'), number, F.lit('", "more": [1], "timestamp": "'), stamp, F.lit('", "v": 1.0 }'))
    payload = F.when(case == 6, F.concat(F.lit("["), plain, F.lit("]"))).when(
        case == 7, F.concat(plain, F.lit(" 5"))).when(case == 9, other).otherwise(plain)
    encoded = F.rtrim(F.translate(F.base64(F.encode(payload, "UTF-8")), "+/\r\n", "-_"), F.lit("="))
    sent = F.when(case == 1, F.concat(encoded, F.lit("="))).when(case == 2, F.concat(F.lit("+"), encoded)).when(
        case == 11, "").otherwise(encoded)
    told = logs.select("id", decoded_cursor(sent).alias("found"))
    return told.select(
        "id", F.date_format("found.timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.col("found.id").alias("row_id"), F.when(F.col("found").isNull(), "Invalid cursor").alias("error"))


_SENT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def _sent(case, usual: dict, changes: dict[int, dict], first: dict[int, str]):
    """A map of parameters: the usual ones but for a row's case; ``first`` names one that comes before the others."""
    names = list(dict.fromkeys([*usual, *(name for change in changes.values() for name in change)]))
    texts = {}
    for name in names:
        found = usual.get(name, F.lit(None))
        for number, change in changes.items():
            if name in change:
                found = F.when(case == number, change[name]).otherwise(found)
        texts[name] = found

    def entry(name: str, wanted):
        return F.when(wanted & texts[name].isNotNull(), F.struct(F.lit(name).alias("name"), texts[name].alias("texts")))

    leading = [entry(name, case == number) for number, name in first.items()]
    following = [
        entry(name, ~case.isin(*(n for n, f in first.items() if f == name)) if name in first.values() else F.lit(True))
        for name in names]
    return F.map_from_entries(F.filter(F.array(*leading, *following), lambda e: e.isNotNull()))


def _texts(*values):
    return F.array(*(F.lit(v) if isinstance(v, str) else v for v in values)).cast("array<string>")


def _asked(logs: DataFrame, told, *columns) -> DataFrame:
    """Error or reading of each request in comparable form."""
    read = logs.select("id", told.alias("told")).select("id", "told.error", "told.query.*")
    return read.select(
        "id", "error", "service", "level", "q", *columns,
        *(F.date_format(name, _SENT).alias(name) for name in ("since", "until")),
        F.to_json("attributes").alias("attributes"))


def _page_parameters(spark: SparkSession, folder: str) -> DataFrame:
    """One request for a page per event, most of them spoilt in one way or another."""
    logs = event_logs(configure(spark), folder)
    case, at = (F.col("id") - 1) % 21, F.col("timestamp")
    since, k = F.date_format(at, _SENT), F.col("attributes")["k"]
    later = F.timestamp_add("HOUR", F.lit(1), at)
    cursor = cursor_column(at, F.col("id"))
    usual = {
        "service": _texts(F.col("service")), "level": _texts(F.col("level")), "since": _texts(since),
        "until": _texts(F.date_format(later, _SENT)), "q": _texts("at 50%"),
        "limit": _texts(F.concat(F.lit("00"), (1 + F.col("id") % 1000).cast("string"))), "cursor": _texts(cursor),
        "attr.k": _texts(k, "x"),
    }
    ahead = F.replace(F.date_format(F.timestamp_add("HOUR", F.lit(3), at), _SENT), F.lit("Z"), F.lit("+02:00"))
    nothing = {name: F.lit(None) for name in usual}
    given = _sent(case, usual, {
        1: {"service": _texts("a", "b")}, 2: {"level": _texts("fatal")}, 3: {"level": F.array().cast("array<string>")},
        4: {"since": _texts("yesterday")}, 5: {"until": _texts(since)}, 6: {"limit": _texts("0")},
        7: {"limit": _texts("1001")}, 8: {"limit": _texts("7.25")},
        9: {"cursor": _texts(F.concat(cursor, F.lit("=")))}, 10: {"attr.": _texts("x")},
        11: {"attr.k": F.array().cast("array<string>")}, 12: {"colour": _texts("red")},
        13: {"colour": _texts("red", "blue")}, 14: {"until": _texts(ahead)},
        15: {"level": _texts("fatal"), "limit": _texts("0")}, 16: {"level": _texts("fatal"), "limit": _texts("0")},
        17: {"q": _texts(F.lit(None))}, 18: nothing, 20: {"until": _texts(since), "limit": _texts("0")},
    }, {16: "limit"})
    told = page_parameters(F.when(case != 19, given))
    return _asked(
        logs, told, "limit", F.date_format("cursor.timestamp", _SENT).alias("cursor_time"),
        F.col("cursor.id").alias("cursor_id"))


def _aggregate_parameters(spark: SparkSession, folder: str) -> DataFrame:
    """One request for counts per event, most of them spoilt in one way or another."""
    logs = event_logs(configure(spark), folder)
    case, since = (F.col("id") - 1) % 14, F.date_format("timestamp", _SENT)
    usual = {
        "level": _texts(F.col("level")), "since": _texts(since),
        "until": _texts(F.date_format(F.timestamp_add("HOUR", F.lit(1), F.col("timestamp")), _SENT)),
        "bucket": _texts("5m"), "group_by": _texts("service"), "attr.k": _texts(F.col("attributes")["k"]),
    }
    gone = F.lit(None)
    given = _sent(case, usual, {
        1: {"group_by": gone}, 2: {"bucket": gone}, 3: {"bucket": _texts("1m", "5m")}, 4: {"bucket": _texts("2m")},
        5: {"group_by": _texts("message")}, 6: {"bucket": _texts("2m"), "limit": _texts("10")}, 7: {"since": gone},
        8: {"until": gone}, 9: {"level": _texts("bad")}, 10: {"until": _texts(since)},
        11: {"level": _texts("bad"), "bucket": _texts("2m")}, 12: {"level": _texts("bad"), "group_by": _texts("message")},
        13: {"since": gone, "q": _texts("a", "b")},
    }, {})
    return _asked(logs, aggregate_parameters(given), "bucket", "group_by")


def _walk_while_writing(spark: SparkSession, folder: str) -> DataFrame:
    """A walk by pages of 500 over what was stored when it began, while as many records arrive.

    The first pages are read by cursor, with records of all times stored in
    between; the rest of the walk is numbered at once.
    """
    table = LogTable(configure(spark), scratch_path(spark, "table"))
    logs, odd = event_logs(spark, folder), F.col("id") % 2 == 1
    in_time = (F.asc("timestamp"), F.asc("message"))
    table.append(unnumbered(logs.filter(odd)), order_by=in_time)
    begun = table.snapshot()
    params, rows, cursor, read = {"limit": "500"}, [], None, 0
    for part in range(2):
        page = table.page(LogsQuery.parse(params if cursor is None else {**params, "cursor": cursor}), begun)
        rows += [(read, place, log["id"], log["timestamp"]) for place, log in enumerate(page.logs)]
        read, cursor = read + 1, page.next_cursor
        table.append(unnumbered(logs.filter(~odd & (F.floor(F.col("id") / 2) % 2 == part))), order_by=in_time)
        if cursor is None:
            break
    first = spark.createDataFrame(rows, "page long, position long, id string, timestamp string")
    if cursor is None:
        return first
    query = LogsQuery.parse({**params, "cursor": cursor})
    rest = table.scan(snapshot=begun).filter(filter_predicate(query))
    millis = F.concat(F.substring("timestamp", 1, 23), F.lit("Z")).alias("timestamp")
    return first.unionByName(all_pages(rest, query.limit).select(
        (F.col("page") + read).alias("page"), "position", "id", millis))


def _shown(logs: DataFrame, *extra) -> DataFrame:
    """Records in output form, with all digits of the time."""
    exact = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp")
    return logs.select(
        *extra, exact, "level", "service", "message", F.col("attributes_json").alias("attributes")
    )


def _bad_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Requests of which some bodies are unusable and some ids are missing or repeated."""
    number = F.col("request_id").cast("long")
    good = F.col("body")
    body = (
        F.when(number % 7 == 1, F.substring(good, 1, 40))
        .when(number % 7 == 2, "{}").when(number % 7 == 3, '{"logs":[]}')
        .when(number % 7 == 4, F.concat(good, F.lit(" 5"))).otherwise(good)
    )
    sent_id = F.when(number % 5 == 1, F.lit(None)).when(number % 5 == 2, "again").otherwise(F.col("request_id"))
    requests = event_requests(configure(spark), folder).select(
        sent_id.alias("request_id"), body.alias("body"), "received_at")
    return summarize(validate(requests)).withColumn("rejected", F.to_json("rejected"))


def _boundaries(spark: SparkSession, folder: str) -> DataFrame:
    """One request per event, its item at or just over a limit of the rules."""
    logs = event_logs(configure(spark), folder)
    millis = F.unix_millis("timestamp")
    case = (F.col("id") - 1) % 12
    ahead = F.when(case == 0, 300_000).when(case == 1, 300_001).otherwise(0)
    text = iso_millis_text(F.timestamp_millis(millis + ahead))
    stamp = F.when(case == 7, F.replace(text, F.lit("Z"), F.lit(""))).when(
        case == 8, "2023-02-29T00:00:00Z").otherwise(text)
    level = F.when(case == 3, "5").when(case == 4, "null").when(case == 5, '["warn"]').when(
        case == 6, "{}").otherwise('"info"')
    attributes = F.when(case == 9, "[]").when(case == 10, '{"a":1.5,"b":true,"c":"x"}').otherwise("{}")
    extra = F.when(case == 2, '"trace":{"deep":[1]},').otherwise("")
    message = F.when(case == 11, " ").otherwise("m")
    body = F.concat(
        F.lit('{"logs":[{'), extra, F.lit('"timestamp":"'), stamp, F.lit('","level":'), level,
        F.lit(',"service":"s","message":"'), message, F.lit('","attributes":'), attributes, F.lit("}]}"))
    requests = logs.select(
        F.col("id").cast("string").alias("request_id"), body.alias("body"),
        F.timestamp_millis(millis).alias("received_at"))
    return validate(requests).select(
        "request_id", F.coalesce("reason", F.lit("accepted")).alias("reason"),
        F.when(F.col("reason").isNull(), F.col("attributes_json")).alias("attributes"))


def _ingest_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Two ingests into one table: ids of each day are positive and never repeat."""
    table = LogTable(configure(spark), scratch_path(spark, "table"))
    envelopes = read_envelopes(spark, _landed(spark, folder))
    for _ in range(2):
        ingest_batch(envelopes, table)
    return table.scan().groupBy(F.col("log_date").cast("string").alias("day")).agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("ids"), (F.min("id") > 0).alias("positive"))


def _stored_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of a stored table, read by the first one's cursor."""
    table = _new_table(spark, folder)
    params = {"level": "warn", "limit": "150"}
    first = table.page(LogsQuery.parse(params))
    if first.next_cursor is None:
        second = LogsPage([], None)
    else:
        second = table.page(LogsQuery.parse({**params, "cursor": first.next_cursor}))
    rows = [
        (log["id"], log["timestamp"], log["service"], log["message"], json.dumps(log["attributes"]), second.next_cursor)
        for log in second.logs
    ]
    columns = "id string, timestamp string, service string, message string, attributes string, next_cursor string"
    return spark.createDataFrame(rows, columns)


def _new_table(spark: SparkSession, folder: str) -> LogTable:
    """A table in the shared folder holding all events, oldest id first."""
    table = LogTable(configure(spark), scratch_path(spark, "table"))
    logs = event_logs(spark, folder)
    table.append(unnumbered(logs), order_by=(F.asc("timestamp"), F.asc("message")))
    return table


def _logs_append(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_new_table(spark, folder).scan(), "id")


def _logs_truncate(spark: SparkSession, folder: str) -> DataFrame:
    """Truncated and filled again: ids start over at 1."""
    table = _new_table(spark, folder)
    table.truncate()
    errors = event_logs(spark, folder).filter(F.col("level") == "error")
    table.append(unnumbered(errors), order_by=(F.asc("timestamp"), F.asc("message")))
    return _shown(table.scan(), "id")


def _table_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    """The stored table's own answer, rollup included, after a retention run."""
    table = _new_table(spark, folder)
    table.retain(_NOW, _BOUNDED)
    return table.aggregate(AggregateQuery.parse({**_MONTH, "bucket": "5m", "group_by": "level"}))


def _indexed_search(source, params: dict) -> Query:
    """Counts by the stored table's own search, which skips the files that cannot match."""
    query = AggregateQuery.parse({**_MONTH, **params})

    def run(spark: SparkSession, folder: str) -> DataFrame:
        table = LogTable(configure(spark), scratch_path(spark, "table"))
        table.append(unnumbered(source(spark, folder)))
        table.index_search()
        return table.aggregate(query)

    return run


def _table_retention(spark: SparkSession, folder: str) -> DataFrame:
    table = _new_table(spark, folder)
    table.retain(_NOW, _FIFTEEN_DAYS, bounded=False)
    return _shown(table.scan())


def _ingest_table(spark: SparkSession, folder: str) -> DataFrame:
    table = LogTable(configure(spark), scratch_path(spark, "table"))
    ingest_batch(read_envelopes(spark, _landed(spark, folder)), table)
    return _shown(table.scan())


def _landed(spark: SparkSession, folder: str) -> str:
    """All request bodies as files a stream can pick up."""
    path = f"{scratch_path(spark, 'landing')}/requests"
    event_requests(spark, folder).write.parquet(path)
    return path


def _stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    landing, work = _landed(spark, folder), scratch_path(spark, "stream")
    table = LogTable(spark, f"{work}/table")
    stream = stream_envelopes(spark, landing, maxFilesPerTrigger="3")
    stream_ingest(stream, table, f"{work}/checkpoint").awaitTermination()
    return _shown(table.scan())


class _Interrupted(RuntimeError):
    """Thrown into the work of a query that shows what stays behind."""


def _ingest_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """All requests in three chunks, of which the second cannot be stored: the first stays."""
    table = LogTable(configure(spark), scratch_path(spark, "table"))
    envelopes = read_envelopes(spark, _landed(spark, folder))

    def stop(chunk: int) -> None:
        if chunk == 1:
            raise _Interrupted

    third = max(1, event_logs(spark, folder).count() // 3)
    try:
        ingest_batch(
            envelopes, table, order_by=(F.col("request_id").cast("long").asc(), F.asc("index")),
            chunk_rows=third, before_chunk=stop)
    except _Interrupted:
        pass
    return _shown(table.scan(), "id")


class _KilledOnce(LogTable):
    """Dies after its second batch is stored, before the stream hears of it."""

    stored = 0

    def append_slotted(self, *args, **kwargs) -> int:
        rows = super().append_slotted(*args, **kwargs)
        self.stored += 1
        if self.stored == 2:
            raise _Interrupted
        return rows


def _stream_replay(spark: SparkSession, folder: str) -> DataFrame:
    """A stream killed between storing a batch and committing it, then started again."""
    configure(spark)
    landing, work = _landed(spark, folder), scratch_path(spark, "stream")
    for table in (_KilledOnce(spark, f"{work}/table"), LogTable(spark, f"{work}/table")):
        stream = stream_envelopes(spark, landing, maxFilesPerTrigger="1")
        try:
            stream_ingest(stream, table, f"{work}/checkpoint").awaitTermination()
        except StreamingQueryException as error:
            if "_Interrupted" not in str(error):
                raise
    return _shown(table.scan())


def _retention_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Stored records after a run that its bound ends inside a day, then one that ends at the cutoff."""
    table = _new_table(spark, folder)
    table.retain(_NOW, _BOUNDED)
    bounded = _shown(table.scan(), F.lit("bounded").alias("run"))
    kept, _ = materialize(bounded, "bounded")
    table.retain(_NOW, _FIFTEEN_DAYS, bounded=False)
    return kept.unionByName(_shown(table.scan(), F.lit("all").alias("run")))


def _expired(spark: SparkSession, folder: str) -> DataFrame:
    cutoff = cutoff_micros(_NOW, _FIFTEEN_DAYS)
    return present(expired(event_logs(configure(spark), folder), cutoff)).select("id", "timestamp")


def _survivors(options: RetentionOptions, bounded: bool) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        logs = event_logs(configure(spark), folder)
        return present(survivors(logs, _NOW, options, bounded)).select("id", "timestamp")

    return run


def queries() -> dict[str, Query]:
    return _log_queries() | ({} if corpus is None else {**corpus.queries(), "pipeline": corpus_pipeline.run})


def _log_queries() -> dict[str, Query]:
    return {
        "logs_scan": lambda spark, folder: present(event_logs(configure(spark), folder)),
        "filter_service": _matching(service="svc-3"),
        "filter_level": _matching(level="warn"),
        "filter_time_range": _matching(since="2024-01-10T00:00:00Z", until="2024-01-20T12:30:00.5Z"),
        "filter_message_search": _matching(document_logs, q="PAR"),
        "filter_message_substring": _matching(q="BY USER_4 AT 50% {", search_mode="substring"),
        "filter_message_accents": _matching(document_logs, q="É"),
        "filter_message_wildcard": _matching(q="USER_1_ at 50\\% {\"k\": 4"),
        "filter_attribute": _matching(attributes=(("k", "42"),)),
        "filter_attribute_multi": _matching(document_logs, attributes=(("lang", "en"), ("n_chars", "416"))),
        "filter_attribute_language": _matching(document_logs, attributes=(("lang", "fr"),)),
        "filter_combined": _matching(**_COMBINED),
        "page_default": _page({}),
        "page_filtered": _page({**_COMBINED, "limit": "25"}),
        "page_after_cursor": _page({"cursor": encode_cursor(_CURSOR), "limit": "1000"}),
        "page_documents": _page({"attr.lang": "en", "q": "the", "limit": "50"}, document_logs),
        "page_cursor_column": lambda spark, folder: row_cursors(event_logs(configure(spark), folder)),
        "cursor_decode_column": _decoded_cursors,
        "params_page": _page_parameters,
        "params_aggregate": _aggregate_parameters,
        "page_walk_arrivals": _walk_while_writing,
        "page_walk_all": lambda spark, folder: all_pages(event_logs(configure(spark), folder), 1000),
        "agg_1m": _aggregate({"bucket": "1m"}),
        "agg_5m": _aggregate({"bucket": "5m"}),
        "agg_1h": _aggregate({"bucket": "1h"}),
        "agg_1d": _aggregate({"bucket": "1d"}),
        "agg_by_service": _aggregate({"bucket": "1h", "group_by": "service"}),
        "agg_by_level": _aggregate({"bucket": "1d", "group_by": "level"}),
        "agg_filtered": _aggregate({
            "bucket": "1h", "group_by": "level", "service": "svc-5",
            "since": "2024-01-04T10:20:30.123456Z", "until": "2024-01-19T23:59:59Z",
        }),
        "agg_message_search": _aggregate(
            {"bucket": "1h", "group_by": "service", "q": "the", "until": _END_OF_DOCUMENTS}, document_logs),
        "agg_attribute": _aggregate({"bucket": "1d", "attr.k": "42"}),
        "agg_empty": _aggregate({"bucket": "1h", "service": ""}),
        "agg_from_rollup": _from_rollup,
        "agg_stored_table": _table_aggregate,
        "agg_search_indexed": _indexed_search(
            document_logs, {"bucket": "1h", "group_by": "service", "q": "the", "until": _END_OF_DOCUMENTS}),
        "agg_attribute_indexed": _indexed_search(event_logs, {"bucket": "1d", "attr.k": "42"}),
        "ingest_envelope": _ingest_envelope,
        "validate_reasons": _validate_reasons,
        "ingest_accepted": _ingest_accepted,
        "ingest_rejects": _ingest_rejects,
        "ingest_summary": _ingest_summary,
        "ingest_table": _ingest_table,
        "ingest_bad_bodies": _bad_bodies,
        "ingest_ids": _ingest_ids,
        "ingest_chunks": _ingest_chunks,
        "validate_boundaries": _boundaries,
        "page_with_cursor": _stored_page,
        "assign_ids": _assign_ids,
        "logs_append": _logs_append,
        "logs_truncate": _logs_truncate,
        "stream_ingest": _stream_ingest,
        "stream_replay": _stream_replay,
        "retention_expired": _expired,
        "retention_survivors": _survivors(_FIFTEEN_DAYS, False),
        "retention_bounded": _survivors(_BOUNDED, True),
        "retention_table": _table_retention,
        "retention_both_bounds": _retention_bounds,
    }


def entry(spark: SparkSession) -> DataFrame:
    """Hourly record counts by service."""
    return queries()["agg_by_service"](spark, "/root/testdata/sf0.001")


# SQL

_MILLIS = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%gZ')"
_MICROS = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%fZ')"

_EVENT_LOGS = """
    SELECT event_id + 1 AS id, ts AS t,
           CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn'
                           WHEN 'view' THEN 'debug' ELSE 'info' END AS level,
           'svc-' || CAST(user_id % 8 AS VARCHAR) AS service,
           event_type || ' by user_' || CAST(user_id AS VARCHAR) || ' at 50% ' || props AS message,
           props->>'k' AS k,
           '{"k":' || (props->>'k') || '}' AS attributes
    FROM events
"""
_DOCUMENT_LOGS = """
    SELECT doc_id + 1 AS id, TIMESTAMP '2024-01-01' + to_seconds(doc_id * 37) AS t,
           'info' AS level, source AS service, text AS message, lang, CAST(n_chars AS VARCHAR) AS n,
           '{"lang":"' || lang || '","n_chars":' || CAST(n_chars AS VARCHAR) || '}' AS attributes
    FROM documents
"""
# What the damage done to each item should lead to.
_ITEMS = f"""
    SELECT CAST((id - 1) // 100 AS VARCHAR) AS request_id, (id - 1) % 100 AS "index", l.*,
           CASE (id - 1) % 50
               WHEN 3 THEN 'log must be an object'
               WHEN 7 THEN 'timestamp must be a valid ISO datetime'
               WHEN 11 THEN 'invalid level: ''critical'''
               WHEN 31 THEN 'invalid level: ''critical'''
               WHEN 13 THEN 'invalid level: ''undefined'''
               WHEN 17 THEN 'service must be a non-empty string'
               WHEN 19 THEN 'message must be a non-empty string'
               WHEN 23 THEN 'attributes must be a flat object with string, number, or boolean values'
           END AS reason,
           CASE WHEN (id - 1) % 50 = 3 THEN '5' ELSE '{{' || concat_ws(',',
               CASE (id - 1) % 50 WHEN 23 THEN '"attributes":{{"nested":{{}}}}' WHEN 29 THEN NULL
                                  ELSE '"attributes":' || attributes END,
               CASE WHEN (id - 1) % 50 IN (11, 31) THEN '"level":"critical"'
                    WHEN (id - 1) % 50 <> 13 THEN '"level":"' || level || '"' END,
               CASE (id - 1) % 50 WHEN 31 THEN '"message":""' WHEN 19 THEN '"message":5'
                                  ELSE '"message":' || CAST(to_json(message) AS VARCHAR) END,
               CASE (id - 1) % 50 WHEN 17 THEN '"service":""' ELSE '"service":"' || service || '"' END,
               CASE (id - 1) % 50 WHEN 7 THEN '"timestamp":"not-a-date"'
                                  ELSE '"timestamp":"' || {_MICROS.format('t')} || '"' END
           ) || '}}' END AS item
    FROM ({_EVENT_LOGS}) l
"""
_SENT_ATTRIBUTES = "CASE WHEN (id - 1) % 50 = 29 THEN '{}' ELSE attributes END AS attributes"


def _shown_sql(logs: str, where: str = "TRUE", tail: str = "") -> str:
    return f"""
        SELECT CAST(id AS VARCHAR) AS id, {_MILLIS.format('t')} AS "timestamp",
               level, service, message, attributes
        FROM ({logs}) l WHERE {where} {tail}
    """


def _exact_sql(logs: str, extra: str = "", where: str = "TRUE", attributes: str = "attributes") -> str:
    return f"""
        SELECT {extra} {_MICROS.format('t')} AS "timestamp", level, service, message, {attributes}
        FROM ({logs}) l WHERE {where}
    """


def _page_sql(logs: str, where: str, limit: int) -> str:
    return _shown_sql(logs, where, f"ORDER BY t DESC, l.id DESC LIMIT {limit}")


def _bucket_sql(logs: str, width: str, group: str | None = None, where: str = "TRUE") -> str:
    start = f"time_bucket(INTERVAL '{width}', t, TIMESTAMP '1970-01-01')"
    return f"""
        SELECT {_MILLIS.format('s')} AS "start", g AS "group", n AS "count" FROM (
            SELECT {start} AS s, {group or 'CAST(NULL AS VARCHAR)'} AS g, count(*) AS n
            FROM ({logs}) l WHERE {where} GROUP BY 1, 2
        ) ORDER BY s, g
    """


# Each request once, whatever id it was sent with.
_REQUESTS_SQL = f"""
    SELECT request_id, CAST(request_id AS BIGINT) AS r, count(*) FILTER (WHERE reason IS NULL) AS accepted,
           '[' || coalesce(string_agg('{{"index":' || CAST("index" AS VARCHAR) || ',"reason":"'
               || reason || '"}}', ',' ORDER BY "index") FILTER (WHERE reason IS NOT NULL), '') || ']' AS rejected
    FROM ({_ITEMS}) GROUP BY request_id
"""
_BOUNDARY_REASONS = """CASE (id - 1) % 12
    WHEN 1 THEN 'timestamp must be a valid ISO datetime' WHEN 7 THEN 'timestamp must be a valid ISO datetime'
    WHEN 8 THEN 'timestamp must be a valid ISO datetime' WHEN 3 THEN 'invalid level: ''5'''
    WHEN 4 THEN 'invalid level: ''null''' WHEN 5 THEN 'invalid level: ''warn'''
    WHEN 6 THEN 'invalid level: ''[object Object]'''
    WHEN 9 THEN 'attributes must be a flat object with string, number, or boolean values'
    ELSE 'accepted' END"""
_PAGE_ERRORS = """CASE (id - 1) % 21
    WHEN 1 THEN 'Invalid service parameter' WHEN 2 THEN 'Invalid level' WHEN 3 THEN 'Invalid level parameter'
    WHEN 4 THEN 'Invalid since' WHEN 5 THEN 'until must be greater than since' WHEN 6 THEN 'Invalid limit'
    WHEN 7 THEN 'Invalid limit' WHEN 8 THEN 'Invalid limit' WHEN 9 THEN 'Invalid cursor'
    WHEN 10 THEN 'Invalid attribute filter' WHEN 11 THEN 'Invalid attribute filter'
    WHEN 12 THEN 'Invalid query parameter' WHEN 13 THEN 'Invalid colour parameter' WHEN 15 THEN 'Invalid level'
    WHEN 16 THEN 'Invalid limit' WHEN 17 THEN 'Invalid q parameter' WHEN 19 THEN 'Invalid query parameters'
    WHEN 20 THEN 'Invalid limit' END"""
_AGGREGATE_ERRORS = """CASE (id - 1) % 14
    WHEN 2 THEN 'Missing or invalid bucket parameter' WHEN 3 THEN 'Missing or invalid bucket parameter'
    WHEN 4 THEN 'Invalid bucket parameter' WHEN 5 THEN 'Invalid group_by parameter'
    WHEN 6 THEN 'Invalid query parameter' WHEN 7 THEN 'Missing since parameter' WHEN 8 THEN 'Missing until parameter'
    WHEN 9 THEN 'Invalid level' WHEN 10 THEN 'until must be greater than since'
    WHEN 11 THEN 'Invalid bucket parameter' WHEN 12 THEN 'Invalid group_by parameter'
    WHEN 13 THEN 'Invalid q parameter' END"""
_COMBINED_SQL = """service = 'svc-3' AND level = 'error' AND t >= TIMESTAMP '2024-01-03 06:00:00'
    AND t < TIMESTAMP '2024-01-28 16:30:00' AND message ILIKE '%BY USER%' ESCAPE '\\'"""
_NUMBERED_SQL = "row_number() OVER (ORDER BY t, message) AS id,"
_OLDEST_300 = f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY t, id) AS age FROM ({_EVENT_LOGS}) e) WHERE age > 300"


def oracle_sql() -> dict[str, str]:
    return _log_sql() | ({} if corpus is None else corpus.oracle_sql())


def _log_sql() -> dict[str, str]:
    events, documents, items = _EVENT_LOGS, _DOCUMENT_LOGS, _ITEMS
    kept = "reason IS NULL"
    expiry = "TIMESTAMP '2024-01-16'"
    aged = f'SELECT CAST(id AS VARCHAR) AS id, {_MILLIS.format("t")} AS "timestamp" FROM'
    by_service = _bucket_sql(events, "1 hour", "service")
    return {
        "logs_scan": _shown_sql(events),
        "filter_service": _shown_sql(events, "service = 'svc-3'"),
        "filter_level": _shown_sql(events, "level = 'warn'"),
        "filter_time_range": _shown_sql(
            events, "t >= TIMESTAMP '2024-01-10' AND t < TIMESTAMP '2024-01-20 12:30:00.5'"),
        "filter_message_search": _shown_sql(documents, "message ILIKE '%PAR%'"),
        "filter_message_substring": _shown_sql(events, "contains(lower(message), 'by user_4 at 50% {')"),
        "filter_message_accents": _shown_sql(documents, "message ILIKE '%É%'"),
        "filter_message_wildcard": _shown_sql(
            events, "message ILIKE '%USER_1_ at 50\\% {\"k\": 4%' ESCAPE '\\'"),
        "filter_attribute": _shown_sql(events, "k = '42'"),
        "filter_attribute_multi": _shown_sql(documents, "lang = 'en' AND n = '416'"),
        "filter_attribute_language": _shown_sql(documents, "lang = 'fr'"),
        "filter_combined": _shown_sql(events, _COMBINED_SQL),
        "page_default": _page_sql(events, "TRUE", 100),
        "page_filtered": _page_sql(events, _COMBINED_SQL, 25),
        "page_after_cursor": _page_sql(
            events, "(t, l.id) < (TIMESTAMP '2024-01-15 12:00:00', 5000)", 1000),
        "page_documents": _page_sql(documents, "lang = 'en' AND message ILIKE '%the%'", 50),
        "page_cursor_column": f"""
            SELECT CAST(id AS VARCHAR) AS id,
                   rtrim(translate(base64(encode('{{"v":1,"timestamp":"' || {_MICROS.format('t')}
                       || '","id":"' || CAST(id AS VARCHAR) || '"}}')), '+/', '-_'), '=') AS "cursor"
            FROM ({events}) l""",
        "page_walk_all": f"""
            SELECT (r - 1) // 1000 AS page, (r - 1) % 1000 AS position,
                   CAST(id AS VARCHAR) AS id, {_MICROS.format('t')} AS "timestamp"
            FROM (SELECT *, row_number() OVER (ORDER BY t DESC, id DESC) AS r FROM ({events}) l)""",
        "agg_1m": _bucket_sql(events, "1 minute"),
        "agg_5m": _bucket_sql(events, "5 minutes"),
        "agg_1h": _bucket_sql(events, "1 hour"),
        "agg_1d": _bucket_sql(events, "1 day"),
        "agg_by_service": by_service,
        "agg_by_level": _bucket_sql(events, "1 day", "level"),
        "agg_filtered": _bucket_sql(events, "1 hour", "level", """service = 'svc-5'
            AND t >= TIMESTAMP '2024-01-04 10:20:30.123456' AND t < TIMESTAMP '2024-01-19 23:59:59'"""),
        "agg_message_search": _bucket_sql(documents, "1 hour", "service", """message ILIKE '%the%'
            AND t >= TIMESTAMP '2024-01-01' AND t < TIMESTAMP '9999-01-01'"""),
        "agg_attribute": _bucket_sql(events, "1 day", None, "k = '42'"),
        "agg_search_indexed": _bucket_sql(documents, "1 hour", "service", """message ILIKE '%the%'
            AND t >= TIMESTAMP '2024-01-01' AND t < TIMESTAMP '9999-01-01'"""),
        "agg_attribute_indexed": _bucket_sql(events, "1 day", None, "k = '42'"),
        "agg_empty": _bucket_sql(events, "1 hour", None, "service = ''"),
        "agg_from_rollup": by_service,
        "agg_stored_table": _bucket_sql(_OLDEST_300, "5 minutes", "level"),
        "ingest_envelope": f'SELECT request_id, "index", item FROM ({items})',
        "validate_reasons": f"""SELECT request_id, "index", coalesce(reason, 'accepted') AS reason
            FROM ({items})""",
        "ingest_accepted": _exact_sql(items, 'request_id, "index",', kept, _SENT_ATTRIBUTES),
        "ingest_rejects": f"""SELECT request_id, "index", reason, item AS raw
            FROM ({items}) WHERE reason IS NOT NULL""",
        "ingest_summary": f"""
            SELECT request_id, count(*) FILTER (WHERE reason IS NULL) AS accepted,
                   '[' || coalesce(string_agg('{{"index":' || CAST("index" AS VARCHAR) || ',"reason":"'
                       || reason || '"}}', ',' ORDER BY "index") FILTER (WHERE reason IS NOT NULL), '')
                       || ']' AS rejected,
                   count(*) FILTER (WHERE reason IS NULL) > 0 AS ok
            FROM ({items}) GROUP BY request_id""",
        "ingest_table": _exact_sql(items, "", kept, _SENT_ATTRIBUTES),
        "ingest_bad_bodies": f"""
            SELECT CASE WHEN r % 5 = 1 THEN NULL WHEN r % 5 = 2 THEN 'again' ELSE request_id END AS request_id,
                   CASE WHEN r % 7 IN (1, 2, 3, 4) THEN 0 ELSE accepted END AS accepted,
                   CASE WHEN r % 7 IN (1, 2, 3, 4) THEN '[]' ELSE rejected END AS rejected,
                   CASE WHEN r % 7 IN (1, 2, 3, 4) THEN 'Invalid request body' END AS error,
                   r % 7 NOT IN (1, 2, 3, 4) AND accepted > 0 AS ok
            FROM ({_REQUESTS_SQL})""",
        "ingest_ids": f"""
            SELECT strftime(t, '%Y-%m-%d') AS day, 2 * count(*) AS n, 2 * count(*) AS ids, TRUE AS positive
            FROM ({items}) WHERE {kept} GROUP BY 1""",
        "validate_boundaries": f"""
            SELECT CAST(id AS VARCHAR) AS request_id, {_BOUNDARY_REASONS} AS reason,
                   CASE WHEN (id - 1) % 12 = 10 THEN '{{"a":1.5,"b":true,"c":"x"}}'
                        WHEN (id - 1) % 12 IN (0, 2, 11) THEN '{{}}' END AS attributes
            FROM ({events}) l""",
        "page_with_cursor": f"""
            WITH numbered AS (
                SELECT row_number() OVER (ORDER BY t, message) AS n, l.* EXCLUDE (id) FROM ({events}) l),
            ranked AS (SELECT *, row_number() OVER (ORDER BY t DESC, n DESC) AS place
                       FROM numbered WHERE level = 'warn'),
            page AS (SELECT * FROM ranked WHERE place BETWEEN 151 AND 300)
            SELECT CAST(n AS VARCHAR) AS id, {_MILLIS.format('t')} AS "timestamp", service, message,
                   replace(attributes, ':', ': ') AS attributes,
                   (SELECT rtrim(translate(base64(encode('{{"v":1,"timestamp":"' || {_MICROS.format('t')}
                       || '","id":"' || CAST(n AS VARCHAR) || '"}}')), '+/', '-_'), '=')
                    FROM page WHERE place = 300 AND (SELECT count(*) FROM ranked) > 300) AS next_cursor
            FROM page""",
        "assign_ids": f"""
            SELECT row_number() OVER (ORDER BY CAST(request_id AS BIGINT), "index") AS id,
                   CAST(request_id AS BIGINT) AS request, "index"
            FROM ({items}) WHERE {kept}""",
        "logs_append": _exact_sql(events, _NUMBERED_SQL),
        "logs_truncate": _exact_sql(events, _NUMBERED_SQL, "level = 'error'"),
        "stream_ingest": _exact_sql(items, "", kept, _SENT_ATTRIBUTES),
        "retention_expired": f"{aged} ({events}) WHERE t < {expiry}",
        "retention_survivors": f"{aged} ({events}) WHERE t >= {expiry}",
        "retention_bounded": f"{aged} ({_OLDEST_300})",
        "retention_table": _exact_sql(events, "", f"t >= {expiry}"),
        "cursor_decode_column": f"""
            SELECT id, CASE WHEN (id - 1) % 12 IN (0, 9) THEN {_MICROS.format('t')} END AS "timestamp",
                   CASE WHEN (id - 1) % 12 IN (0, 9) THEN id END AS row_id,
                   CASE WHEN (id - 1) % 12 NOT IN (0, 9) THEN 'Invalid cursor' END AS error
            FROM ({events}) l""",
        "params_page": f"""
            SELECT id, e AS error, CASE WHEN full_row THEN service END AS service,
                   CASE WHEN full_row THEN level END AS level, CASE WHEN full_row THEN 'at 50%' END AS q,
                   CAST(CASE WHEN full_row THEN 1 + id % 1000 WHEN c = 18 THEN 100 END AS INTEGER) AS "limit",
                   CASE WHEN full_row THEN {_MICROS.format('t')} END AS cursor_time,
                   CASE WHEN full_row THEN id END AS cursor_id,
                   CASE WHEN full_row THEN {_MICROS.format('t')} END AS since,
                   CASE WHEN full_row THEN {_MICROS.format("t + INTERVAL '1 hour'")} END AS until,
                   CASE WHEN full_row THEN '[{{"key":"k","text":"' || k || '"}},{{"key":"k","text":"x"}}]'
                        WHEN c = 18 THEN '[]' END AS attributes
            FROM (SELECT *, (id - 1) % 21 AS c, (id - 1) % 21 IN (0, 14) AS full_row,
                         {_PAGE_ERRORS} AS e FROM ({events}) l)""",
        "params_aggregate": f"""
            SELECT id, e AS error, CAST(NULL AS VARCHAR) AS service, CASE WHEN c < 2 THEN level END AS level,
                   CAST(NULL AS VARCHAR) AS q, CASE WHEN c < 2 THEN '5m' END AS bucket,
                   CASE WHEN c = 0 THEN 'service' END AS group_by,
                   CASE WHEN c < 2 THEN {_MICROS.format('t')} END AS since,
                   CASE WHEN c < 2 THEN {_MICROS.format("t + INTERVAL '1 hour'")} END AS until,
                   CASE WHEN c < 2 THEN '[{{"key":"k","text":"' || k || '"}}]' END AS attributes
            FROM (SELECT *, (id - 1) % 14 AS c, {_AGGREGATE_ERRORS} AS e FROM ({events}) l)""",
        "page_walk_arrivals": f"""
            SELECT (r - 1) // 500 AS page, (r - 1) % 500 AS position, CAST(n AS VARCHAR) AS id,
                   {_MILLIS.format('t')} AS "timestamp"
            FROM (SELECT *, row_number() OVER (ORDER BY t DESC, n DESC) AS r
                  FROM (SELECT t, row_number() OVER (ORDER BY t, message) AS n
                        FROM ({events}) l WHERE id % 2 = 1))""",
        "retention_both_bounds": f"""
            {_exact_sql(_OLDEST_300, "'bounded' AS run,")} UNION ALL
            {_exact_sql(events, "'all' AS run,", f"t >= {expiry}")}""",
        "stream_replay": _exact_sql(items, "", kept, _SENT_ATTRIBUTES),
        "ingest_chunks": _exact_sql(
            f"""SELECT * EXCLUDE (id), row_number() OVER (ORDER BY CAST(request_id AS BIGINT), "index") AS id,
                       id AS sent FROM ({items}) WHERE {kept}""",
            "id,", "l.id <= greatest(1, (SELECT count(*) FROM events) // 3)",
            _SENT_ATTRIBUTES.replace("(id - 1)", "(sent - 1)")),
    }
