import base64
import glob
import hashlib
import random
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from loglake.llm import warc


@pytest.fixture(scope="module")
def make_pages(spark):
    def build(rows, partitions=3):
        return spark.createDataFrame(
            [(*row, "x", 1) for row in rows], "page_id long, url string, html string, hash string, slot int"
        ).repartition(partitions)

    return build


def expected(rows, least=0):
    first = {}
    for page, _, html in rows:
        if len((html or "").encode()) >= least:
            key = (page is None, page or 0)
            first[html or ""] = min(first.get(html or "", key), key)
    told, used = [], set()
    for page, _, html in rows:
        data = (html or "").encode()
        chosen = first.get(html or "")
        response = chosen is None or (chosen == (page is None, page or 0) and html or "") and (html or "") not in used
        if chosen is not None:
            response = chosen == (page is None, page or 0) and (html or "") not in used
        if response and chosen is not None:
            used.add(html or "")
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        told.append((page, len(data), digest, "response" if response else "revisit",
                     None if response or chosen[0] else chosen[1]))
    return sorted(told, key=repr)


def read(spark, folder):
    rows = warc.read_archives(spark, folder).collect()
    number = lambda text: None if text is None else int(text)
    return rows, sorted(((number(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to))
                         for r in rows), key=repr)


ROWS = [
    (5, "http://a.example/", "<p>one</p>"), (3, "http://b.example/ä b\r\n", "<p>one</p>"), (3, None, "<p>one</p>"),
    (7, "", ""), (8, "u", None), (None, "u", None), (9, "u", "WARC/1.1\r\n\r\n\r\n"), (10, "u", "é" * 1000),
    (None, "u", "only without id"), (None, "u", "only without id"), (11, "u", "x" * 3_000_000)]


def test_round_trip(spark, make_pages):
    pages = make_pages(ROWS)
    index, folder = warc.write_archives(pages)
    rows, told = read(spark, folder)
    assert told == expected(ROWS)
    payloads = {r.payload_digest: bytes(r.payload) for r in rows if r.record_type == "response"}
    assert {r.payload_digest for r in rows} == set(payloads)
    assert sorted(payloads.values()) == sorted({(html or "").encode() for *_, html in ROWS})
    assert index.count() == len(ROWS)


def test_small_payloads_are_all_responses(spark, make_pages):
    _, folder = warc.write_archives(make_pages(ROWS), least_bytes=11)
    assert read(spark, folder)[1] == expected(ROWS, 11)


def test_hot_payloads_and_many_archives(spark, make_pages):
    rng = random.Random(1)
    words = [f"word{n}" for n in range(300)]
    rows = [(n % 1500, f"http://h/{n}", "hot page" if n % 3 else " ".join(rng.choice(words) for _ in range(200)))
            for n in range(3000)]
    index, folder = warc.write_archives(make_pages(rows), archive_bytes=100_000, training_bytes=200_000)
    assert read(spark, folder)[1] == expected(rows)
    files = glob.glob(f"{folder}/*.warc.zst")
    assert len(files) > 3 and not glob.glob(f"{folder}/.pages*[!c]")
    for row in index.orderBy(F.rand(1)).limit(20).collect():
        with open(f"{folder}/{row.archive}", "rb") as archive:
            data = archive.read()
        record = warc.read_record(data, row.at, row.length)
        assert (record["page_id"], record["record_type"]) == (row.page_id, row.record_type)
    magic, length = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    dictionary = zstandard.ZstdDecompressor().decompress(data[8:8 + length])
    assert struct.unpack("<I", dictionary[:4])[0] == 0xEC30A437
    # Every record is a frame of its own.
    frames = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    rest, n = data[8 + length:], 0
    while rest:
        one = frames.decompressobj()
        assert one.decompress(rest).startswith(b"WARC/1.1\r\nWARC-Type: ")
        rest, n = one.unused_data, n + 1
    assert n > 1


def test_empty_table(spark, make_pages):
    index, folder = warc.write_archives(make_pages(ROWS).filter("false"))
    assert index.count() == 0 and warc.read_archives(spark, folder).count() == 0


def test_damaged_payload_is_noticed():
    row = {"payload": b"abc", "page_id": "1", "slot": 0, "url": "u", "first_slot": None, "first_page": None}
    _, record = warc.page_record(row, "1970-01-01T00:00:00Z")
    head, _, block = record.partition(b"\r\n\r\n")
    assert warc.parse_record(head, block[:-4])["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse_record(head, block[:-4].replace(b"abc", b"abd"))
