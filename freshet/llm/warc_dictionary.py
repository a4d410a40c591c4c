"""WARC files with a Zstandard dictionary of their own.

A file starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, built from the
first TRAIN_RECORDS records of the file (at most TRAIN_BYTES of them); every record after it is a frame
of its own. Of records with equal payloads of at least `least_bytes`, those with the largest page id
are response records; the others are revisit records that name the response and keep only the HTTP
head. Payload length and digest of every record are those of the full payload.

Spark finds the largest page id per digest (partial aggregates, then a join that carries payloads only
where the digests that repeat are too many to broadcast). Each task writes one file in the shared
folder under a name of its own; only files named by committed rows are read, so that lost executors
and repeated tasks do no harm.

Defined cases: a null payload is empty; a null page id stays null and is never the largest; rows with
equal ids and payloads are all responses; line breaks in a URL are percent-encoded; an empty table
writes no file; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm import common
from freshet.llm.pfor_tokens import file_system
from freshet.session import cut, shared_dir

SKIPPABLE = 0x184D2A5D
DICTIONARY_BYTES, TRAIN_RECORDS, TRAIN_BYTES, LEVEL = 64 << 10, 256, 4 << 20, 3
READ_BYTES = 64 << 10
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a page that refers to another is a revisit without payload."""
    name = lambda i: f"<urn:x-page:{'' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


class Writer:
    def __init__(self, out: BinaryIO) -> None:
        self.out, self.held, self.n_held, self.compressor = out, [], 0, None

    def add(self, data: bytes) -> None:
        if self.compressor is None:
            self.held.append(data)
            self.n_held += len(data)
            if len(self.held) >= TRAIN_RECORDS or self.n_held >= TRAIN_BYTES:
                self._begin()
        else:
            self.out.write(self.compressor.compress(data))

    def _begin(self) -> None:
        import zstandard

        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, self.held, k=256, d=8, f=18, accel=4, level=LEVEL)
        except zstandard.ZstdError:  # too few records: their own bytes serve as dictionary
            trained = zstandard.ZstdCompressionDict(b"".join(self.held)[:DICTIONARY_BYTES].ljust(8, b"\n"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data = trained.as_bytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(data)) + data)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=True)
        for x in self.held:
            self.out.write(self.compressor.compress(x))
        self.held = []

    def close(self) -> None:
        if self.compressor is None:
            self._begin()
        self.out.close()


def records_of(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record of a file."""
    import zstandard

    magic, size = struct.unpack("<II", source.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    data = source.read(size)
    kind = zstandard.DICT_TYPE_AUTO if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=kind))
    rest = source.read(READ_BYTES)
    while rest:
        frame, parts = reader.decompressobj(), []
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data or source.read(READ_BYTES)
                break
            rest = source.read(READ_BYTES)
            if not rest:
                raise ValueError("the last record is cut off")
        head, _, body = b"".join(parts).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        fields = {k.lower(): v for k, v in fields.items()}
        yield fields, body[: int(fields["content-length"])]


def _page(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def write(df: DataFrame, date: str, least_bytes: int = 0, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Archive every row; one row per file: folder, file, n (records)."""
    spark = common.lean(df).sparkSession
    folder = f"{shared_dir(spark)}/freshet-warc/{uuid.uuid4().hex}"
    rows = df.select(
        F.col(f"`{key}`").cast("long").alias("_key"), F.col(f"`{url}`").cast("string").alias("_url"),
        F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b"")).alias("_payload"),
    ).withColumn("_digest", F.sha1("_payload"))
    repeated = (
        rows.filter(F.octet_length("_payload") >= least_bytes).groupBy("_digest")
        .agg(F.max("_key").alias("_response"), F.count("*").alias("_n")).filter((F.col("_n") > 1) & F.col("_response").isNotNull())
        .select("_digest", "_response")
    )
    refers = F.when(~F.col("_key").eqNullSafe(F.col("_response")), F.col("_response"))
    dealt = rows.join(repeated, "_digest", "left").select("_key", "_url", refers.alias("_refers"), "_payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        name, writer, n = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst", None, 0
        for (keys, urls, refer), data in common.chunks(batches):
            if writer is None:
                system.create_dir(path, recursive=True)
                writer = Writer(system.open_output_stream(f"{path}/{name}"))
            for k, u, r, x in zip(keys.to_pylist(), urls.to_pylist(), refer.to_pylist(), data):
                writer.add(record(k, u, x, r, date))
            n += len(data)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([folder]), pa.array([name]), pa.array([n], pa.int64())], ["folder", "file", "n"])

    return cut(dealt.mapInArrow(run, "folder string, file string, n long"))


def read(files: DataFrame) -> DataFrame:
    """Read files back, each in a task: page_id, payload_bytes, payload_digest, record_type, refers_to, url, intact.

    intact: whether a response's payload has the digest that its record states (null for revisits).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "intact"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
        for batch in batches:
            for folder, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, path = file_system(folder)
                rows = []
                with system.open_input_stream(f"{path}/{name}") as source:
                    for fields, block in records_of(source):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = int(next(x for x in head.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        response = fields["warc-type"] == "response"
                        rows.append((
                            _page(fields["warc-record-id"]), length, digest, fields["warc-type"], _page(fields.get("warc-refers-to")),
                            fields["warc-target-uri"], digest_of(payload) == digest if response else None,
                        ))
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    n = max(files.count(), 1)
    return files.select("folder", "file").repartition(n, "file").mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, intact boolean"
    )
