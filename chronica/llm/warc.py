"""WARC archives: deduplicating writer, normaliser of monolithic gzip, indexed reader.

A crawler that compresses a whole archive as one gzip stream makes it impossible
to read one record without all before it. The normaliser inflates such a stream
once, from front to back, writes every record as a gzip member of its own and
notes offset and length of each member in a sidecar index. It holds one record
and one buffer at a time. An archive is the unit of work: writers roll over to a
new archive at ``ROLL_BYTES``, so no task grows with the corpus, and a task that
is lost writes its archive again under the same name.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronica import session
from chronica.llm import files

ROLL_BYTES = 64 << 20
READ_BYTES = 1 << 20
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
# Parts into which the rows of one payload are dealt when they meet its first page.
SALTS = 32
GZIP = 31  # window bits of zlib that mean a gzip member


def roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """Columns payload, sha1, record_type and refers_to beside page_id and url.

    Of rows with equal payloads of at least ``least`` bytes the smallest page_id is
    the response and the others revisit it; smaller payloads are all responses. Rows
    that repeat the smallest page_id are responses too; a row without page_id
    revisits the smallest one there is, and is a response where there is none. A
    null html is an empty payload.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("payload")).withColumn("sha1", F.sha1("payload"))
    first = (
        rows.where(F.octet_length("payload") >= least)
        .groupBy("sha1")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        .drop("n")
    )
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return (
        salted.join(first, ["sha1", "salt"], "left")
        .withColumn("record_type", F.when(again, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(again, F.col("first")))
        .drop("first", "salt")
    )


def _clean(text: str) -> str:
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8")) for c in text)


def record(page_id, url, payload: bytes, sha1: str, kind: str, refers_to) -> bytes:
    """One WARC record; a revisit keeps the HTTP head and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if kind == "response" else b"")
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}"]
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the first line is the version."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def write(pages: DataFrame, folder: str, least: int = 0, roll: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages`` as archives that are one gzip stream each; one row per archive."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, token = TaskContext.get().partitionId(), uuid.uuid4().hex
        out, packer, made, raw, done = None, None, 0, 0, []

        def finish():
            out.write(packer.flush())
            out.close()
            done.append((f"{folder}/{part:06d}-{len(done):04d}.warc.gz", made, out.size))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "record_type", "refers_to"))):
                if out is None:
                    out = files.Written(f"{folder}/{part:06d}-{len(done):04d}.warc.gz", token)
                    packer, made, raw = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), 0, 0
                body = record(*row)
                out.write(packer.compress(body))
                made += 1
                raw += len(body)
                if raw >= roll:
                    finish()
                    out = None
        if out is not None:
            finish()
        columns = list(zip(*done)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
            names=["path", "records", "bytes"],
        )

    return roles(pages, least).mapInArrow(put, "path string, records bigint, bytes bigint")


def inflated(path: str) -> Iterator[bytes]:
    """Decompressed bytes of a gzip file of one or many members, in order."""
    store, name = files.at(path)
    with store.open_input_stream(name, compression=None) as source:
        stream = zlib.decompressobj(GZIP)
        while body := source.read(READ_BYTES):
            while body:
                yield stream.decompress(body)
                body = stream.unused_data
                if stream.eof:
                    stream = zlib.decompressobj(GZIP)


def split_records(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and whole bytes of every record of a stream; holds one record at a time."""
    held, need, head = bytearray(), 0, None
    for part in parts:
        held += part
        while True:
            if head is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                head = parse_head(bytes(held[:end]))
                need = end + 4 + int(head["content-length"]) + 4
            if len(held) < need:
                break
            yield head, bytes(held[:need])
            del held[:need]
            head = None
    if held:
        raise ValueError("archive ends inside a record")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive with a member per record beside a sidecar index.

    Takes a column ``path``; returns source, path, index, records and bytes. Index
    lines are JSON with offset, length, type and id in the archive's order. An
    archive without records gives an empty file and an empty index.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = uuid.uuid4().hex
        for batch in batches:
            done = []
            for source in batch.column("path").to_pylist():
                name = f"{folder}/{source.rsplit('/', 1)[-1]}"
                out, lines = files.Written(name, token), []
                for head, body in split_records(inflated(source)):
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                    member = packer.compress(body) + packer.flush()
                    entry = {"offset": out.size, "length": len(member), "type": head["warc-type"], "id": head["warc-record-id"]}
                    lines.append(json.dumps(entry))
                    out.write(member)
                out.close()
                index = files.Written(f"{name}.idx", token)
                index.write("".join(f"{x}\n" for x in lines).encode())
                index.close()
                done.append((source, name, f"{name}.idx", len(lines), out.size))
            columns = list(zip(*done)) or [()] * 5
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["source", "path", "index", "records", "bytes"]
            )

    return archives.select("path").mapInArrow(rewrite, "source string, path string, index string, records bigint, bytes bigint")


def _number(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail else None


RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, intact boolean"


def records(archives: DataFrame, keep_payload: bool = False) -> DataFrame:
    """Records of normalised archives, each read by itself at its indexed place.

    ``intact`` says that the stored payload has the digest in the record's header
    (for a revisit, which stores none, that it names its response).
    """
    schema = RECORD + (", payload binary" if keep_payload else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist()):
                store, name = files.at(index)
                with store.open_input_stream(name, compression=None) as lines:
                    entries = [json.loads(x) for x in lines.read().decode().splitlines()]
                store, name = files.at(path)
                with store.open_input_file(name) as source:
                    for k in range(0, len(entries), 500):
                        rows = []
                        for e in entries[k : k + 500]:
                            source.seek(e["offset"])
                            rows.append(_parse(zlib.decompress(source.read(e["length"]), GZIP), keep_payload))
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=_arrow(keep_payload))

    return archives.select("path", "index").mapInArrow(read, schema)


def _arrow(keep_payload: bool) -> pa.Schema:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]
    names = [c.split()[0] for c in RECORD.split(", ")] + ["payload"]
    return pa.schema(list(zip(names, kinds))[: 8 if keep_payload else 7])


def _parse(body: bytes, keep_payload: bool) -> tuple:
    end = body.index(b"\r\n\r\n") + 4
    head = parse_head(body[: end - 4])
    block = body[end : end + int(head["content-length"])]
    cut = block.index(b"\r\n\r\n") + 4
    size = int(parse_head(block[: cut - 4])["content-length"])
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    kind, payload = head["warc-type"], block[cut:]
    if kind == "response":
        intact = len(payload) == size and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
    else:
        intact = "warc-refers-to" in head
    row = (_number(head["warc-record-id"]), head.get("warc-target-uri"), size, digest, kind, _number(head.get("warc-refers-to")), intact)
    return (*row, payload if kind == "response" else None) if keep_payload else row


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0, keep_payload: bool = False, roll: int = ROLL_BYTES) -> DataFrame:
    """Write monolithic archives of ``pages``, normalise them and read them back.

    One row per row of ``pages``, with repeated rows kept and no row for an empty
    table. Only page_id, url and html are read.
    """
    folder = session.scratch_path(spark, "warc")
    raw = session.materialised(write(pages, f"{folder}/raw", least, roll), "archives")
    even = spread(raw)
    whole = session.materialised(normalise(even, f"{folder}/members"), "normalised")
    return records(spread(whole), keep_payload)


def spread(archives: DataFrame) -> DataFrame:
    """One task per archive, or nearly: the list is short, its files are not."""
    n = archives.count()
    return archives.repartition(max(1, n), F.col("path")) if n else archives
