"""WARC archives with a shared Zstandard dictionary.

Each archive is a ``.warc.zst`` file: a skippable frame (magic 0x184D2A5D) that holds the dictionary,
then one Zstandard frame for each record, so that any record can be read alone. The dictionary is
trained on a bounded sample of the records to be archived and is the same for all archives of a run.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, sample_by_hash, scratch
from .files import new_file, random_file

SKIPPABLE = 0x184D2A5D
#: The dictionary is trained on at most so many records, of each at most so many leading bytes.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 16 << 10, 64 << 10
#: Payloads from this size on that equal another's are written as revisits of it.
REVISIT_BYTES = 1000


def train_dictionary(pages: DataFrame, payload_col: str, size: int = DICTIONARY_BYTES, records: int = SAMPLE_RECORDS) -> bytes:
    """A dictionary from a sample of ``records`` records picked by the hash of their content; b"" where there are too few."""
    head = F.substring(F.col(payload_col).cast("binary"), 1, SAMPLE_BYTES)
    sample = sample_by_hash(pages.select(head.alias("head")).where(F.length("head") > 0), F.xxhash64("head"), records)
    samples = sorted(bytes(r[0]) for r in sample.collect())
    if len(samples) < 16 or sum(map(len, samples)) < 8 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 4), samples).as_bytes()
    except zstandard.ZstdError:  # the library's answer to samples it can't use, such as all alike
        return b""


def record_roles(pages: DataFrame, id_col: str, payload_col: str, least: int = REVISIT_BYTES) -> DataFrame:
    """The pages with payload, digest, bytes, record_type and refers_to.

    Among equal payloads of at least ``least`` bytes the largest id is the response (each of
    several rows with that id), all others revisit it. A null id counts as smaller than any. Only digests are grouped; a digest
    shared by very many pages is then spread again by Spark's skew join.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    large = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(large, "payload_digest", "left")
    revisit = (F.col("payload_bytes") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"),
    )


def _record(row: dict) -> bytes:
    """One WARC/1.1 record; a revisit keeps the headers and leaves the payload out."""
    revisit = row["record_type"] == "revisit"
    body = b"" if revisit else row["payload"]
    ident = lambda k: f"<urn:page:{'' if k is None else k}>"
    lines = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {ident(row['page_id'])}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {ident(row['refers_to'])}"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _parsed(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    number = lambda x: int(v) if (v := x.removeprefix("<urn:page:").rstrip(">")) else None
    return {
        "page_id": number(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"], "body": body,
        "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "length": int(fields["X-Payload-Length"]),
        "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
    }


def write_archives(roles: DataFrame, folder: str, dictionary: bytes, level: int = 3) -> DataFrame:
    """Write the rows of :func:`record_roles`, an archive for each partition; returns (path, records)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = None, 0
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=True)
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
                    out = new_file(path)
                    if dictionary:
                        out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
                out.write(packer.compress(_record(row)))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})

    return materialise(roles.mapInArrow(write, "path string, records long"), "archives")


def read_records(path: str, piece: int = 1 << 16) -> Iterator[dict]:
    """The records of one archive, read piece by piece; the dictionary comes from the archive itself."""
    file = random_file(path)
    data, shared = file.read(8), None
    if len(data) == 8 and struct.unpack("<II", data)[0] == SKIPPABLE:
        shared, data = zstandard.ZstdCompressionDict(file.read(struct.unpack("<II", data)[1])), b""
    reader = zstandard.ZstdDecompressor(dict_data=shared)
    frame, record = reader.decompressobj(), []
    data += file.read(piece)
    while data:
        record.append(frame.decompress(data))
        if frame.eof:
            yield _parsed(b"".join(record))
            data, frame, record = frame.unused_data, reader.decompressobj(), []
            data = data or file.read(piece)
        else:
            data = file.read(piece)
    if any(record):
        raise ValueError(f"{path} ends within a record")


def read_archives(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record in the archives.

    A response's length and digest are those of the payload as read; a revisit's are from its header.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                rows, n = [], 0
                for r in read_records(path):
                    full = r["record_type"] == "response"
                    rows.append((r["page_id"], len(r["body"]) if full else r["length"], hashlib.sha1(r["body"]).hexdigest() if full else r["digest"], r["record_type"], r["refers_to"]))
                    n += 1
                    if len(rows) == 4096:
                        yield _batch(rows)
                        rows = []
                if n != records:
                    raise ValueError(f"{path}: {n} records, {records} were written")
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return manifest.repartition(max(1, manifest.count())).mapInArrow(read, schema)


def archive(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", payload_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """Write every page to archives under ``folder``, read them back, one row for each record.

    A null payload is archived as an empty one, null and repeated ids each have a record of their own.
    An empty table makes no archive and no row.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    dictionary = train_dictionary(pages, payload_col)
    roles = record_roles(pages, id_col, payload_col, least)
    return read_archives(write_archives(roles, folder, dictionary)).withColumnRenamed("page_id", id_col)
