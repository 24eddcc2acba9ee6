"""Web archives of individually compressed records with a dictionary of their own.

Pages become WARC/1.1 records.  Of pages with the same payload one is stored as
a response and the others as revisits that refer to it.  Each archive is one
file of the shared folder::

    skippable frame 0x184D2A5D   the Zstandard dictionary, itself compressed
    frame                        warcinfo record
    frame                        one record, and so on

The dictionary is trained on the archive's own first records.  Records reach
an archive in the order of their payload's hash, so these are a sample of all
that it will hold.  An index tells where each record starts, and any one of
them can be read without the others.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import hadoop_path, scratch_path
from .steps import settled

#: Bytes of records a dictionary is trained on, at most; only the ratio of compression depends on it.
TRAINING_BYTES = 2 << 20
DICTIONARY_BYTES = 32 << 10
#: An archive is closed when its compressed records reach this size.
ARCHIVE_BYTES = 32 << 20
#: A payload that makes up this share of all pages, at least, is dealt out over all tasks.
HOT_SHARE = 1000

# Fixed values of the formats.
_SKIPPABLE = 0x184D2A5D
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LEVEL = 3
_SUFFIX = ".warc.zst"
_INDEX = "archive string, at long, length long, page_id string, record_type string"
_RECORD = (
    "record_id string, page_id string, record_type string, target_uri string, refers_to string, "
    "payload_digest string, payload_bytes long, payload binary")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page: str | None, slot: int) -> str:
    """A page's id, if it has one, and a number that tells rows of one id apart."""
    return f"<urn:page:{slot}:{'' if page is None else quote(page, safe='') or '%'}>"


def _page_of(record_id: str) -> str | None:
    told = record_id.strip("<>").split(":", 3)[3]
    return unquote(told) if told not in ("", "%") else ("" if told else None)


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{name}: {value}" for name, value in fields),
             f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def page_record(row: dict, captured: str) -> tuple[str, bytes]:
    """(type, bytes) of the record of one page."""
    payload = row["payload"] or b""
    kind = "response" if row["first_slot"] is None else "revisit"
    fields = [
        ("WARC-Record-ID", _record_id(row["page_id"], row["slot"])),
        ("WARC-Date", captured),
        ("WARC-Target-URI", quote(row["url"] or "", safe="%/:=&?~#+!$,;'@()*[]") or "about:blank"),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
    ]
    if kind == "revisit":
        fields += [("WARC-Refers-To", _record_id(row["first_page"], row["first_slot"])),
                   ("WARC-Profile", _REVISIT_PROFILE)]
    fields.append(("Content-Type", "application/http; msgtype=response"))
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    return kind, _record(kind, fields, head.encode() + (payload if kind == "response" else b""))


class _Archive:
    """One open file; it has its final name only when it is whole."""

    def __init__(self, folder: str, name: str, dictionary: bytes | None, captured: str):
        import pyarrow.fs
        import zstandard

        self.name = name
        self._fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        self._fs.create_dir(base, recursive=True)
        self._final = f"{base}/{name}"
        self._open = f"{base}/.{name}.{TaskContext.get().taskAttemptId()}"
        self._file = self._fs.open_output_stream(self._open)
        self.size = 0
        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        settings = {"level": _LEVEL, "write_checksum": True, "write_content_size": True}
        self._compress = zstandard.ZstdCompressor(dict_data=held, **settings).compress
        if dictionary:
            packed = zstandard.ZstdCompressor(**settings).compress(dictionary)
            self._put(struct.pack("<II", _SKIPPABLE, len(packed)) + packed)
        about = f"software: loglake\r\nformat: WARC File Format 1.1\r\nisPartOf: {name}\r\n".encode()
        self.add(_record("warcinfo", [
            ("WARC-Record-ID", f"<urn:archive:{quote(name)}>"), ("WARC-Date", captured), ("WARC-Filename", name),
            ("Content-Type", "application/warc-fields")], about))

    def _put(self, data: bytes) -> None:
        self._file.write(data)
        self.size += len(data)

    def add(self, record: bytes) -> tuple[int, int]:
        at = self.size
        self._put(self._compress(record))
        return at, self.size - at

    def close(self) -> None:
        self._file.close()
        self._fs.move(self._open, self._final)


def trained_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes | None:
    """A dictionary of at most ``size`` bytes, or None if the records are too few to train on."""
    import zstandard

    size = min(size, sum(map(len, records)) // 10)
    try:
        return zstandard.train_dictionary(size, records, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return None


def _writer(folder: str, captured: str, archive_bytes: int, training_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        waiting: list[tuple] = []
        held, serial, dictionary, archive = 0, 0, None, None

        def opened() -> _Archive:
            nonlocal serial
            serial += 1
            return _Archive(folder, f"pages-{task:06d}-{serial:03d}{_SUFFIX}", dictionary, captured)

        def put(entries: list[tuple]) -> list[tuple]:
            nonlocal archive
            index = []
            for page, kind, record in entries:
                if archive is None:
                    archive = opened()
                index.append((archive.name, *archive.add(record), page, kind))
                if archive.size >= archive_bytes:
                    archive.close()
                    archive = None
            return index

        def told(index: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = zip(*index)
            return pa.RecordBatch.from_arrays(
                [pa.array(list(values), kind) for values, kind in zip(columns, kinds)],
                ["archive", "at", "length", "page_id", "record_type"])

        trained = False
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                entries = []
                for row in batch.slice(at, 64).to_pylist():
                    kind, record = page_record(row, captured)
                    entries.append((row["page_id"], kind, record))
                if trained:
                    yield told(put(entries))
                    continue
                waiting += entries
                held += sum(len(record) for *_, record in entries)
                if held >= training_bytes:
                    dictionary, trained = trained_dictionary([record for *_, record in waiting]), True
                    yield told(put(waiting))
                    waiting = []
        if waiting:
            dictionary = trained_dictionary([record for *_, record in waiting])
            yield told(put(waiting))
        if archive is not None:
            archive.close()

    return run


def write_archives(
    pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", payload: str = "html",
    least_bytes: int = 0, captured: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES,
    training_bytes: int = TRAINING_BYTES,
) -> tuple[DataFrame, str]:
    """Write a record per row of ``pages``; returns the index of all records and the folder of the archives.

    ``folder`` must be one that all executors reach (by default a new one in
    the shared folder), as a path or a URI that pyarrow's file systems open.
    The payload is the text in UTF-8; null counts as empty.  Of rows with equal
    payloads of at least ``least_bytes`` bytes the one of smallest key is the
    response, of equal keys any one of them, and rows without a key come last.
    Empty and null URLs become about:blank.  Extra columns are not read.
    A task that runs again writes the same archives over its first ones.
    """
    spark = pages.sparkSession
    folder = (folder or scratch_path(spark, "archives")).rstrip("/")
    fs, resolved = hadoop_path(spark, folder)
    fs.mkdirs(resolved)
    data = F.coalesce(F.encode(F.col(payload).cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(
        F.monotonically_increasing_id().alias("slot"), F.col(key).alias("page_key"), F.col(url).alias("url"),
        data.alias("payload"))
    stored = settled(rows.select(
        "*", F.sha2("payload", 256).alias("hash"), F.octet_length("payload").alias("size")), "pages")
    order = F.struct(F.col("page_key").isNull(), "page_key", "slot")
    alike = stored.filter(F.col("size") >= least_bytes).groupBy("hash", "size").agg(
        F.min(order).alias("first"), F.count("*").alias("n")).filter(F.col("n") > 1)
    alike = settled(alike.select(
        F.col("hash").alias("alike"), F.col("first.page_key").alias("first_key"),
        F.col("first.slot").alias("first_slot"), "n"), "alike")
    # At most HOT_SHARE payloads have that share of all rows, so they are few enough to be sent everywhere.
    least_hot = max(2, -(-stored.count() // HOT_SHARE))
    hot = alike.filter(F.col("n") >= least_hot).select(
        "alike", F.col("first_key").alias("hot_key"), F.col("first_slot").alias("hot_slot"))
    known = stored.join(F.broadcast(hot), stored["hash"] == hot["alike"], "left").drop("alike")
    # Rows of hot payloads need no match any more and go wherever their own number sends them.
    known = known.withColumn("dealt", F.when(F.col("hot_slot").isNull(), F.col("hash")).otherwise(
        F.sha2(F.col("slot").cast("string"), 256)))
    joined = known.join(alike.filter(F.col("n") < least_hot), known["dealt"] == alike["alike"], "left")
    first_slot = F.coalesce("hot_slot", "first_slot")
    revisit = first_slot.isNotNull() & (first_slot != F.col("slot"))
    placed = joined.sortWithinPartitions("dealt").select(
        "slot", F.col("page_key").cast("string").alias("page_id"), "url", "payload",
        F.when(revisit, F.coalesce("hot_key", "first_key").cast("string")).alias("first_page"),
        F.when(revisit, first_slot).alias("first_slot"))
    index = placed.mapInArrow(_writer(folder, captured, archive_bytes, training_bytes), _INDEX)
    return settled(index, "archive-index"), folder


def _dictionary_of(data: memoryview) -> tuple[bytes | None, int]:
    """The dictionary in front of an archive, and where its records start."""
    import zstandard

    if len(data) < 8:
        return None, 0
    magic, length = struct.unpack("<II", data[:8])
    if magic != _SKIPPABLE:
        return None, 0
    return zstandard.ZstdDecompressor().decompress(data[8:8 + length]), 8 + length


def parse_record(head: bytes, block: bytes) -> dict:
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    kind = fields["WARC-Type"]
    if kind == "warcinfo":
        return {"record_id": fields["WARC-Record-ID"], "record_type": kind}
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or payload_digest(payload) != told):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is not what its record says")
    refers = fields.get("WARC-Refers-To")
    return {
        "record_id": fields["WARC-Record-ID"], "page_id": _page_of(fields["WARC-Record-ID"]), "record_type": kind,
        "target_uri": fields["WARC-Target-URI"], "refers_to": _page_of(refers) if refers else None,
        "payload_digest": told, "payload_bytes": size, "payload": payload if kind == "response" else None}


def records_of(archive: bytes) -> Iterator[dict]:
    """All records of one archive, in order; its compressed frames are read as a stream."""
    import io

    import zstandard

    data = memoryview(archive)
    dictionary, start = _dictionary_of(data)
    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    raw = zstandard.ZstdDecompressor(dict_data=held).stream_reader(data[start:], read_across_frames=True)
    stream = io.BufferedReader(raw, 1 << 20)
    while True:
        head = []
        for line in iter(stream.readline, b"\r\n"):
            if not line:
                break
            head.append(line)
        if not head:
            return
        text = b"".join(head).rstrip(b"\r\n")
        size = next(int(line.split(b":")[1]) for line in head if line.lower().startswith(b"content-length:"))
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record ends too early")
        yield parse_record(text, block)


def read_record(archive: bytes, at: int, length: int) -> dict:
    """One record by its place in the index."""
    import zstandard

    data = memoryview(archive)
    dictionary, _ = _dictionary_of(data)
    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    record = zstandard.ZstdDecompressor(dict_data=held).decompress(data[at:at + length])
    head, _, rest = record.partition(b"\r\n\r\n")
    return parse_record(head, rest[:-4])


_RECORD_TYPE = pa.schema([
    ("record_id", pa.string()), ("page_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
    ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
    ("payload", pa.binary())])


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all archives of a folder, without the warcinfo ones.

    Payloads of responses are checked against their digests; with ``payloads``
    False they are left out afterwards.  A folder without archives has none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                held, size = [], 0
                for record in records_of(content.as_buffer()):
                    if record["record_type"] == "warcinfo":
                        continue
                    if not payloads:
                        record["payload"] = None
                    held.append(record)
                    size += len(record["payload"] or b"") + 500
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, _RECORD_TYPE)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, _RECORD_TYPE)

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{_SUFFIX}").load(folder)
    return files.select("content").mapInArrow(run, _RECORD)

