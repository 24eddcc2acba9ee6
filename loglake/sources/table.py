"""The stored log table: Parquet, partitioned by date and batch.

::

    <root>/logs/log_date=YYYY-MM-DD/batch_id=N/source=S/*.parquet     records
    <root>/rollup/log_date=YYYY-MM-DD/batch_id=N/source=S/*.parquet   minute counts
    <root>/search/log_date=YYYY-MM-DD/*.parquet                       bits that tell what a file may hold

The partitions are all there is to know.  A batch's ids start at its number
times 2^40, so ids are unique and grow with the batches without being looked
up.  Its source names where it came from: a stream's query and epoch, or one
append.  Writing is a dynamic partition overwrite, so a batch that is written
again, after a failure of any kind, replaces what it left behind.

There is one writer at a time, as there is one in the service this replaces;
several streams are united before they are written.  Readers see Parquet as it
is: partitions of a batch appear together when its job commits, and a reader
that a retention run overtakes starts again.
"""

from __future__ import annotations

import datetime as dt
import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.isotime import day_number, day_text, micros_literal, utc_date
from ..operators.aggregate import aggregate_logs
from ..operators.numbering import SLOT, number_slots, slot_task, slotted
from ..operators.page import LogsPage, fetch_recent_page
from ..operators.retention import Position, cutoff_micros, nth_oldest
from ..operators.rollup import MINUTE, aggregate_rollup, build_rollup, rollup_answers
from ..operators.search import BITS, file_bits, files_without, needed_spots
from ..plans.predicates import day_literal, utc_day
from ..plans.specs import AggregateQuery, LogFilter, LogsQuery, RetentionOptions
from ..schema import LOG_COLUMNS, ROLLUP, STORED
from ..session import delete_path, hadoop_path, materialize, require_utc, stored_bytes

_DAY_MICROS = 86_400_000_000
_ROWS_PER_FILE = 5_000_000
_BYTES_PER_FILE = 128 * 1024 * 1024
# A file's rows are sorted by one task, so their size in its memory counts too, not only that on disk.
_SORTED_BYTES_PER_FILE = 512 * 1024 * 1024
# Distinct services a file's bloom filter is sized for.
_SERVICES = 10_000
# Ids of one batch; 8 million batches fit in a long.
_IDS_PER_BATCH = 1 << 40
_MAX_LONG = 2 ** 63 - 1
_PARTITIONS = ["log_date", "batch_id", "source"]


def _sorted_bytes() -> Column:
    """About the bytes that all records take in a sort: fixed parts, texts, attributes as a map and as JSON."""
    texts = [F.coalesce(F.octet_length(name), F.lit(0)) for name in ("service", "message", "attributes_json")]
    entries = F.coalesce(F.size("attributes"), F.lit(0))
    return F.sum(sum(texts, F.lit(256)).cast("long") + texts[-1] + entries * 32)


class LogTable:
    """Append, scan, query, retain and truncate one stored table."""

    def __init__(self, spark: SparkSession, root: str):
        require_utc(spark)
        self.spark = spark
        self.root = root.rstrip("/")
        self.logs_path = f"{self.root}/logs"
        self.rollup_path = f"{self.root}/rollup"
        self.search_path = f"{self.root}/search"

    # Writing

    def append(
        self, logs: DataFrame, *, order_by: tuple[Column, ...] = (), source: str | None = None,
        chunk_rows: int | None = None, before_chunk: Callable[[int], None] = lambda chunk: None,
    ) -> int:
        """Store validated records and give them ids; returns how many.

        Ids follow the input order inside each task, so records of one request
        keep their order; ``order_by`` makes ids follow a global order instead.
        A ``source`` that is stored already is overwritten under its old
        number, so a repeated batch gets the same ids again.

        With ``chunk_rows`` the records are stored in chunks of so many, in
        order of their ids, each a batch of its own: those before a failure
        stay.  ``before_chunk`` is told the number of each chunk to come.
        """
        staged, path = materialize(slotted(logs.select(*LOG_COLUMNS), order_by), "append")
        try:
            return self.append_slotted(staged, path, source, chunk_rows, before_chunk)
        finally:
            delete_path(self.spark, path)

    def append_slotted(
        self, staged: DataFrame, path: str, source: str | None = None, chunk_rows: int | None = None,
        before_chunk: Callable[[int], None] = lambda chunk: None,
    ) -> int:
        """As ``append``, for rows already materialised with their slots at ``path``."""
        size = staged.groupBy(slot_task()).agg(F.count("*").alias("rows"), _sorted_bytes().alias("sorted")).agg(
            F.sum("rows").alias("rows"), F.sum("sorted").alias("sorted"), F.count("*").alias("tasks")).first()
        rows = size["rows"] or 0
        if not rows:
            return 0
        source = source or f"append-{uuid.uuid4().hex}"
        stored = {name: number for number, name in self.batches()}
        free = 1 + max(stored.values(), default=-1)
        if chunk_rows is None:
            numbered = number_slots(staged, "number", tasks=size["tasks"])
            before_chunk(0)
            self._write_batch(
                numbered, stored.get(source, free), source, rows, stored_bytes(self.spark, path), size["sorted"])
            return rows
        dense, dense_path = materialize(slotted(staged, (F.asc(SLOT),)), "chunks")
        try:
            numbered = number_slots(dense, "number")
            bytes_per_chunk, sorted_per_chunk = (
                held * chunk_rows // rows for held in (stored_bytes(self.spark, dense_path), size["sorted"]))
            for chunk in range(-(-rows // chunk_rows)):
                before_chunk(chunk)
                part = numbered.filter(F.col("number").between(chunk * chunk_rows + 1, (chunk + 1) * chunk_rows))
                name = f"{source}-{chunk:06d}"
                number = stored.get(name, free)
                free += number == free
                self._write_batch(
                    part.withColumn("number", F.col("number") - chunk * chunk_rows), number, name,
                    min(chunk_rows, rows - chunk * chunk_rows), bytes_per_chunk, sorted_per_chunk)
            return rows
        finally:
            delete_path(self.spark, dense_path)

    def batches(self) -> list[tuple[int, str]]:
        """(number, source) of all stored batches, told by the partitions' names."""
        fs, pattern = hadoop_path(self.spark, f"{self.logs_path}/log_date=*/batch_id=*/source=*")
        found = set()
        for status in fs.globStatus(pattern) or []:
            path = status.getPath()
            found.add((int(path.getParent().getName()[9:]), path.getName()[7:]))
        return sorted(found)

    def truncate(self) -> None:
        """Empty the table; the next batch is number 0 again, and ids start at 1."""
        for path, schema in ((self.rollup_path, ROLLUP), (self.logs_path, STORED)):
            empty = self.spark.createDataFrame([], schema)
            empty.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(
                *_PARTITIONS).parquet(path)

    def retain(
        self, now: dt.datetime, options: RetentionOptions = RetentionOptions(), bounded: bool = True
    ) -> int:
        """Delete expired records, oldest first; returns how many.

        Days wholly before the last record to go are dropped with their
        partitions.  Only that record's own day is written anew, from what
        survives; batches of it without survivors are dropped.  The minute
        counts say which day that is, so no other day is read.
        """
        cutoff = cutoff_micros(now, options)
        whole = cutoff - cutoff % MINUTE
        minutes = self._rollup_rows(None, whole).select("start_1m", "count").unionByName(
            build_rollup(self.scan(whole, cutoff)).select("start_1m", "count"))
        bound = options.max_rows if bounded else _MAX_LONG
        total, position = nth_oldest(self.scan(None, cutoff), bound, minutes)
        if not total:
            return 0
        position = position or Position(cutoff - 1)
        boundary = utc_day(position.micros)
        self._rewrite_day(boundary, position)
        for path in (self.search_path, self.rollup_path, self.logs_path):
            for day in self._days(path):
                if day < boundary:
                    delete_path(self.spark, self._day_path(path, day))
        return min(total, bound)

    def index_search(self, since: int | None = None, until: int | None = None) -> None:
        """Write down what the files of the days of [since, until) may hold.

        Searches then skip files that cannot match.  Files written later are
        read by every search until their day is indexed again.
        """
        whole = [None if bound is None else bound - bound % _DAY_MICROS for bound in (since, until)]
        if until is not None and whole[1] < until:
            whole[1] += _DAY_MICROS
        (
            file_bits(self.scan(*whole)).repartition("log_date", "file").sortWithinPartitions("log_date", "word")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("log_date").parquet(self.search_path)
        )

    def _rewrite_day(self, day: int, position: Position) -> None:
        """Keep what lies behind the position."""
        start = day * _DAY_MICROS
        rows = self.scan(start, start + _DAY_MICROS)
        if not rows.filter(position.covers()).limit(1).count():
            return
        kept, path = materialize(rows.filter(~position.covers()), "survivors")
        try:
            left = kept.groupBy("batch_id", "source").agg(
                F.count("*").alias("rows"), _sorted_bytes().alias("sorted")).collect()
            if left:
                self._write_logs(
                    kept, sum(row["rows"] for row in left), stored_bytes(self.spark, path),
                    sum(row["sorted"] for row in left))
                self._write_rollup(kept)
            living = {(row["batch_id"], row["source"]) for row in left}
            for top in (self.rollup_path, self.logs_path):
                folder = self._day_path(top, day)
                fs, pattern = hadoop_path(self.spark, f"{folder}/batch_id=*/source=*")
                for status in fs.globStatus(pattern) or []:
                    found = status.getPath()
                    if (int(found.getParent().getName()[9:]), found.getName()[7:]) not in living:
                        fs.delete(found, True)
        finally:
            delete_path(self.spark, path)

    # Reading

    def scan(
        self, since: int | None = None, until: int | None = None, days: list[int] | None = None,
        snapshot: int | None = None,
    ) -> DataFrame:
        """The records, optionally of [since, until) in microseconds.

        Only the date directories in range are listed and read; ``days`` are
        those on disk, if known already.  A ``snapshot`` leaves out the batches
        stored after it; as they are partitions, none of their files is read.
        """
        rows = self._read(self.logs_path, STORED, "timestamp", since, until, days)
        return rows if snapshot is None else rows.filter(F.col("batch_id") <= snapshot)

    def snapshot(self) -> int:
        """What is stored now, for reads that must not see records which arrive later; -1 for an empty table.

        Later batches have higher numbers.  Retention and truncation still
        take records away from a snapshot, and free the last batch's number
        once nothing of it is left.
        """
        return max((number for number, _ in self.batches()), default=-1)

    def _searcher(self, query: LogFilter, since: int | None, until: int | None) -> Callable[[DataFrame], DataFrame]:
        """Leaves out the files of that time which, by their bits, hold no match."""
        spots = needed_spots(self.spark, query) if self._days(self.search_path) else []
        if not spots:
            return lambda rows: rows
        days = [None if bound is None else utc_day(bound) for bound in (since, None if until is None else until - 1)]
        bits = self.spark.read.schema(BITS).parquet(self.search_path)
        if days[0] is not None:
            bits = bits.filter(F.col("log_date") >= day_literal(days[0]))
        if days[1] is not None:
            bits = bits.filter(F.col("log_date") <= day_literal(days[1]))
        empty = files_without(bits, spots)
        if not empty:
            return lambda rows: rows
        # Spark lists the files by this filter, so the others are not opened.
        return lambda rows: rows.filter(~F.col("_metadata.file_path").isin(empty)) if rows.inputFiles() else rows

    def page(self, query: LogsQuery, snapshot: int | None = None) -> LogsPage:
        """One page, newest first, reading no more of the past than it must.

        Cursors alone never show a record twice; with the ``snapshot`` taken
        before the first page, late records that arrive during a walk stay out
        of all its pages instead of showing in those not read yet.
        """
        days = self._days(self.logs_path)
        if not days:
            return LogsPage([], None)
        oldest, end = days[0] * _DAY_MICROS, (days[-1] + 1) * _DAY_MICROS
        if query.since is not None:
            oldest = max(oldest, query.since_micros)
        if query.until is not None:
            end = min(end, query.until_micros)
        if query.cursor is not None:
            end = min(end, query.cursor.micros + 1)
        narrowed = self._searcher(query, oldest, end)
        return fetch_recent_page(
            lambda since, until: narrowed(self.scan(since, until, days, snapshot)), query, oldest, end)

    def aggregate(self, query: AggregateQuery) -> DataFrame:
        """Bucket counts, from the rollup whenever it holds the answer."""
        since, until = query.since_micros, query.until_micros
        if rollup_answers(query):
            return aggregate_rollup(self._rollup_rows(since, until), query)
        rows = self._searcher(query, since, until)(self.scan(since, until))
        return aggregate_logs(rows, query, partitioned=True)

    def rollup(self) -> DataFrame:
        """Counts per minute, service and level."""
        return self._rollup_rows(None, None).groupBy("start_1m", "service", "level").agg(
            F.sum("count").alias("count"))

    def _rollup_rows(self, since: int | None, until: int | None) -> DataFrame:
        return self._read(self.rollup_path, ROLLUP, "start_1m", since, until)

    # Files

    def _write_batch(
        self, numbered: DataFrame, batch: int, source: str, rows: int, size: int, sorted_size: int
    ) -> None:
        """The rollup first: a batch counts as stored when its records are there."""
        placed = numbered.select(
            (F.col("number") + F.lit(batch * _IDS_PER_BATCH)).alias("id"), *LOG_COLUMNS,
            utc_date(F.col("timestamp")).alias("log_date"), F.lit(batch).cast("long").alias("batch_id"),
            F.lit(source).alias("source"))
        again = self._partitions_of(batch, source)
        self._write_rollup(placed)
        self._write_logs(placed, rows, size, sorted_size)
        if again:
            self._drop_stale(placed, again)

    def _partitions_of(self, batch: int, source: str) -> list[str]:
        paths = []
        for top in (self.rollup_path, self.logs_path):
            fs, pattern = hadoop_path(self.spark, f"{top}/log_date=*/batch_id={batch}/source={source}")
            paths += [status.getPath().toString() for status in fs.globStatus(pattern) or []]
        return paths

    def _drop_stale(self, placed: DataFrame, before: list[str]) -> None:
        """Delete those partitions of an earlier attempt whose days this one has no record of."""
        days = {f"log_date={row[0]}" for row in placed.select(F.col("log_date").cast("string")).distinct().collect()}
        for path in before:
            if path.split("/")[-3] not in days:
                delete_path(self.spark, path)

    def _write_logs(self, placed: DataFrame, rows: int, size: int, sorted_size: int) -> None:
        """Files of even size, sorted by time inside each date.

        Splitting by (date, timestamp, id) spreads a hot day, or a hot instant,
        over as many tasks as it has rows for.  Rows of few bytes on disk may
        take many in the memory of the task that sorts them: ``sorted_size``.
        """
        order = [*_PARTITIONS, "timestamp", "id"]
        files = max(
            1, math.ceil(rows / _ROWS_PER_FILE), math.ceil(size / _BYTES_PER_FILE),
            math.ceil(sorted_size / _SORTED_BYTES_PER_FILE))
        (
            placed.select(*STORED.fieldNames())
            .repartitionByRange(files, *order).sortWithinPartitions(*order)
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .option("parquet.bloom.filter.enabled#service", "true")
            .option("parquet.bloom.filter.expected.ndv#service", str(_SERVICES))
            .partitionBy(*_PARTITIONS).parquet(self.logs_path)
        )

    def _write_rollup(self, placed: DataFrame) -> None:
        """Rebalanced by date: small dates share a task, a large one is split."""
        (
            build_rollup(placed, *_PARTITIONS)
            .hint("rebalance", "log_date")
            .sortWithinPartitions(*_PARTITIONS, "start_1m", "service")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy(*_PARTITIONS).parquet(self.rollup_path)
        )

    def _read(
        self, path: str, schema, column: str, since: int | None, until: int | None, days: list[int] | None = None
    ) -> DataFrame:
        days = self._days(path) if days is None else days
        wanted = [
            day for day in days
            if (since is None or day >= utc_day(since)) and (until is None or day <= utc_day(until - 1))
        ]
        if not wanted:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema)
        if len(wanted) < len(days):
            rows = reader.option("basePath", path).parquet(*(self._day_path(path, d) for d in wanted))
        else:
            rows = reader.parquet(path)
        for bound in self._range(since, until, column):
            rows = rows.filter(bound)
        return rows

    def _range(self, since: int | None, until: int | None, column: str) -> list[Column]:
        bounds = []
        if since is not None:
            bounds.append(
                (F.col(column) >= micros_literal(since))
                & (F.col("log_date") >= day_literal(utc_day(since)))
            )
        if until is not None:
            bounds.append(
                (F.col(column) < micros_literal(until))
                & (F.col("log_date") <= day_literal(utc_day(until - 1)))
            )
        return bounds

    def _names(self, path: str) -> list[str]:
        fs, resolved = hadoop_path(self.spark, path)
        if not fs.exists(resolved):
            return []
        return [status.getPath().getName() for status in fs.listStatus(resolved)]

    def _days(self, path: str) -> list[int]:
        names = (name for name in self._names(path) if name.startswith("log_date="))
        return sorted(day_number(name[9:]) for name in names)

    def _day_path(self, path: str, day: int) -> str:
        return f"{path}/log_date={day_text(day)}"
