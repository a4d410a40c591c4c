import base64
import hashlib
import io

import pyarrow as pa
import zstandard

from freshet.llm import warc_dictionary as wd
from tests.llm.helpers import LONG

DATE = "2024-01-01T00:00:00Z"
PAGES = [(1, "http://a", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://c\r\nX: y", None), (4, "u", ""), (5, "u", LONG), (6, "u", "é🙂\r\n\r\nWARC/1.1"), (7, "u", LONG), (None, "u", "<p>one</p>")]
SCHEMA = "page_id long, url string, html string"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(pages, least=0):
    out = {}
    for page, _, html in pages:
        size = len((html or "").encode())
        same = [p for p, _, h in pages if digest(h) == digest(html) and p is not None]
        first = max(same) if same and size >= least else page
        out[page] = (size, digest(html), "response" if first == page else "revisit", None if first == page else first)
    return out


def found(files):
    return {r[0]: tuple(r[1:5]) for r in wd.read(files).collect()}


def test_round_trip(spark):
    rows = spark.createDataFrame(PAGES, SCHEMA).withColumnRenamed("nothing", "_digest").selectExpr("*", "1 AS _payload", "2 AS _response")
    files = wd.write(rows, DATE)
    assert found(files) == expected(PAGES)
    assert all(r["intact"] is not False for r in wd.read(files).collect())
    assert found(wd.write(rows, DATE, least_bytes=20)) == expected(PAGES, 20)


def test_repeated_rows_and_empty(spark):
    rows = spark.createDataFrame([(1, "u", "x")] * 3, SCHEMA)
    assert [tuple(r[:5]) for r in wd.read(wd.write(rows, DATE)).collect()] == [(1, 1, digest("x"), "response", None)] * 3
    assert wd.read(wd.write(rows.limit(0), DATE)).count() == 0


def test_file_format():
    out = io.BytesIO()
    out.close, closed = lambda: None, out.close
    writer = wd.Writer(out)
    bodies = [(f"<html>page {i} " + "shared words of every page " * 20 + "</html>").encode() for i in range(600)]
    for i, body in enumerate(bodies):
        writer.add(wd.record(i, "u", body, None, DATE))
    writer.close()
    data = out.getvalue()
    closed()
    size = int.from_bytes(data[4:8], "little")
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
    dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    first = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
    assert first.decompress(data[8 + size :]).startswith(b"WARC/1.1\r\nWARC-Type: response") and first.eof
    records = list(wd.records_of(pa.BufferReader(data)))
    assert [b.partition(b"\r\n\r\n")[2] for _, b in records] == bodies
    plain = sum(len(zstandard.compress(wd.record(i, "u", b, None, DATE), 3)) for i, b in enumerate(bodies))
    assert len(data) < plain  # the dictionary pays
