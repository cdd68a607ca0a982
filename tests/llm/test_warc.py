import base64
import gzip
import hashlib
import io
import json
import zlib

import pytest

from quarry.llm import warc
from quarry.llm.warc import Records, archive_pages, inflate, open_folder, read_records, round_trip


def digest(payload):
    return base64.b32encode(hashlib.sha1((payload or "").encode()).digest()).decode()


def brute(rows, least=0):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        size = len((html or "").encode())
        lead = first.get(html or "")
        again = size >= least and lead is not None and i != lead
        out.append((str(i), size, digest(html), "revisit" if again else "response", str(lead) if again else "None"))
    return sorted(out)


ROWS = [(i, f"http://h{i}.org/ü?q={i}", f"<p>page {i % 7}</p>\r\n\r\nWARC/1.1\r\n\r\n") for i in range(40)]
ROWS += [(100, None, None), (101, "x\r\nWARC-Type: evil", ""), (102, "", "é" * 300_000), (103, "a", "é" * 300_000), (50, "dup", "same"), (50, "dup", "same"), (51, "dup", "same"), (None, "n", "same"), (None, "n", "null only")]


@pytest.mark.parametrize("least", [0, 10, 1000])
def test_round_trip(spark, monkeypatch, least):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 900)
    pages = spark.createDataFrame([(i, u, h, "x", 0) for i, u, h in ROWS], "page_id long, url string, html string, digest string, size int").repartition(3)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in round_trip(pages, least_revisit=least).collect())
    assert got == brute(ROWS, least)


def test_members_and_sidecar(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    index, folder = archive_pages(pages)
    system, path = open_folder(folder)
    for archive in {r.archive for r in index.collect()}:
        data = system.open_input_stream(f"{path}/{archive}", compression=None).read()
        whole = gzip.decompress(data)  # members in a row are one file still
        side = [json.loads(line) for line in system.open_input_stream(f"{path}/{archive}.idx", compression=None).read().splitlines()]
        at = 0
        for line in side:
            member = zlib.decompress(data[line["offset"] : line["offset"] + line["length"]], 31)
            assert whole[at : at + len(member)] == member and member.startswith(b"WARC/1.1\r\n")
            at += len(member)
        assert at == len(whole)
    texts = {r.id: bytes(r.payload).decode() for r in read_records(index, folder).collect() if r.type == "response" and r.id}
    assert texts["102"] == "é" * 300_000 and texts["3"] == ROWS[3][2]


def test_damage_is_told(spark):
    cut = gzip.compress(warc.record("response", "1", "u", 3, "D", b"abc", None))
    with pytest.raises(ValueError, match="gzip stream is cut"):
        list(inflate(io.BytesIO(cut[:-20]), "a"))
    reader = Records("a")
    list(reader.feed(gzip.decompress(cut)[:-9]))
    with pytest.raises(ValueError, match="last record is cut"):
        reader.close()
    with pytest.raises(ValueError, match="no WARC record"):
        list(Records("a").feed(b"HTTP/1.1 200 OK\r\n\r\n"))


def test_empty(spark):
    assert round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
