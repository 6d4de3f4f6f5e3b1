import base64
import hashlib
import json
import zlib

import pytest

from chronica import session
from chronica.llm import files, warc

SCHEMA = "page_id bigint, url string, html string, payload string, first bigint, salt int, path string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA).repartition(3)


ROWS = [
    (5, "https://a.example/ä b\r\nX: y", "<p>same</p>"),
    (3, "https://b.example", "<p>same</p>"),
    (9, None, "<p>same</p>"),
    (3, "https://b.example", "<p>same</p>"),
    (None, "https://c.example", "<p>same</p>"),
    (None, "u", "alone \r\n\r\n WARC/1.0"),
    (1, "u", None),
    (2, "u", ""),
    (7, "u", "é中\U0001f600" * 70000),
    (8, "u", "x"),
    (10, "u", "x"),
]


def expected(rows, least):
    bodies = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, body in bodies:
        ids = [j for j, other in bodies if other == body and j is not None]
        first = min(ids) if ids and len(body) >= least else None
        again = first is not None and first != i
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((i, len(body), digest, "revisit" if again else "response", first if again else None, True))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,roll", [(0, 64 << 20), (2, 100)])
def test_round_trip(spark, least, roll):
    back = warc.round_trip(spark, pages(spark, ROWS), least, keep_payload=True, roll=roll)
    rows = back.collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.intact) for r in rows]
    assert sorted(got, key=str) == expected(ROWS, least)
    bodies = {(h or "").encode() for _, _, h in ROWS}
    assert {bytes(r.payload) for r in rows if r.record_type == "response"} == bodies


def test_members_and_index(spark):
    folder = session.scratch_path(spark, "warc-test")
    raw = session.materialised(warc.write(pages(spark, ROWS).coalesce(1), f"{folder}/raw"))
    whole = session.materialised(warc.normalise(raw, f"{folder}/members"))
    (before,), (after,) = raw.collect(), whole.collect()
    mono = open(files.at(before.path)[1], "rb").read()
    stream = zlib.decompressobj(warc.GZIP)
    plain = stream.decompress(mono)
    assert stream.eof and not stream.unused_data  # one stream
    body = open(files.at(after.path)[1], "rb").read()
    upto, joined = 0, b""
    for line in open(files.at(after["index"])[1]):
        e = json.loads(line)
        assert e["offset"] == upto
        upto += e["length"]
        joined += zlib.decompress(body[e["offset"] : upto], warc.GZIP)
    assert upto == len(body) and joined == plain and after.records == len(ROWS)


def test_cut_archive_is_an_error():
    body = warc.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), "response", None)
    assert len(list(warc.split_records(iter([body[:50], body[50:], body])))) == 2
    with pytest.raises(ValueError):
        list(warc.split_records(iter([body[:-1]])))


def test_empty_table(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], SCHEMA)).collect() == []
