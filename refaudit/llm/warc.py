"""WARC records in seekable Zstandard bundles (operator 8)."""
from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refaudit.llm.common import filesystem, shared_folder, table
from refaudit.session import stage_table

#: Uncompressed bytes gathered in a frame; a larger record has a frame of its own.
FRAME_BYTES = 1 << 18
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the seekable Zstandard format: skippable frame number 0xE and the footer of its seek table.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}')}>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit that names the response and carries none."""
    block = HTTP if refers_to is not None else HTTP + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
             "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}", f"X-Payload-Length: {len(payload)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(frame: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers in lower case, block) of each record of a frame."""
    at = 0
    while at < len(frame):
        stop = frame.index(b"\r\n\r\n", at)
        first, *rest = frame[at:stop].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in rest)}
        size = int(headers["content-length"])
        yield at, headers, frame[stop + 4:stop + 4 + size]
        at = stop + 8 + size


class Bundle:
    """Writes independent frames and, at the end, the seek table as a skippable frame."""

    def __init__(self, target: str, level: int = LEVEL):
        files, path = filesystem(target)
        files.create_dir(os.path.dirname(path), recursive=True)
        self.sink, self.packer, self.frames = files.open_output_stream(path, compression=None), zstandard.ZstdCompressor(level=level), []

    def add_frame(self, data: bytes) -> int:
        packed = self.packer.compress(data)
        self.sink.write(packed)
        self.frames.append((len(packed), len(data)))
        return len(self.frames) - 1

    def close(self) -> None:
        entries = b"".join(struct.pack("<II", *x) for x in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.sink.close()


class BundleReader:
    """Reads single frames by the seek table at the file's end."""

    def __init__(self, target: str):
        files, path = filesystem(target)
        self.source = files.open_input_file(path)
        size = self.source.size()
        count, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        sizes = struct.unpack(f"<{2 * count}I", self._at(size - 9 - 8 * count, 8 * count))
        self.sizes = list(zip(sizes[::2], sizes[1::2], strict=True))
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def _at(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        return self.source.read(n)

    def frame(self, i: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self._at(self.starts[i], self.sizes[i][0]), max_output_size=self.sizes[i][1])

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        _, headers, block = next(parse_records(self.frame(frame)[offset:]))
        return headers, block

    def close(self) -> None:
        self.source.close()


def _writer(folder: str, frame_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"  # a retried task writes another file
        bundle, held, waiting, size = None, [], [], 0
        places = []

        def flush():
            nonlocal held, waiting, size
            if held:
                number = bundle.add_frame(b"".join(held))
                places.extend((*w, number) for w in waiting)
                held, waiting, size = [], [], 0

        for rows in batches:
            for page_id, url, html, refers in zip(rows["page_id"], rows["url"], rows["html"], rows["refers_to"], strict=True):
                page_id, refers = (None if pd.isna(x) else int(x) for x in (page_id, refers))
                data = record(page_id, None if pd.isna(url) else url, b"" if html is None else html.encode(), refers)
                bundle = bundle or Bundle(f"{folder}/{name}")
                if size and size + len(data) > frame_bytes:
                    flush()
                waiting.append((record_id(page_id), size, len(data)))
                held.append(data)
                size += len(data)
            yield pd.DataFrame(places, columns=["record_id", "offset", "length", "frame"]).assign(file=name)
            places.clear()
        if bundle:
            flush()
            bundle.close()
            yield pd.DataFrame(places, columns=["record_id", "offset", "length", "frame"]).assign(file=name)
    return run


def first_copies(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, refers_to``: the smallest page id of equal payloads, NULL for that page itself.

    Payloads are equal when their length and SHA-256 are. The smallest id per payload is found by partial sums in each task;
    only payloads that occur more than once are looked up again.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", "html", F.unhex(F.sha2(payload, 256)).alias("_sum"), F.octet_length(payload).alias("_n"))
    repeated = keyed.filter(F.col("_n") >= min_bytes).groupBy("_sum", "_n").agg(F.min("page_id").alias("_first"), F.count("*").alias("_rows")).filter("_rows > 1").drop("_rows")
    repeated = stage_table(repeated, "warc-repeated")
    other = ~F.col("page_id").eqNullSafe(F.col("_first"))
    return keyed.join(repeated, ["_sum", "_n"], "left").select("page_id", "url", "html", F.when(other, F.col("_first")).alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str, min_bytes: int = 0, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write a WARC record per row of ``pages(page_id, url, html)``; returns the index of records.

    Index: ``record_id, offset, length, frame, file``; a record is found by decompressing one frame. Equal payloads of at least
    ``min_bytes`` are stored once: the smallest page id has the response, the others a revisit. Each task writes one file under
    a new name and the index is written by Spark's committed output, so files of lost attempts are never read.

    NULL html is an empty payload; NULL urls leave the header out. Rows that repeat the smallest id and its payload are all
    responses; NULL page ids revisit any page with an id. An empty table gives an empty index. Other columns are not read.
    """
    rows = first_copies(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), min_bytes)
    return stage_table(rows.mapInPandas(_writer(folder, frame_bytes), "record_id string, offset long, length long, frame int, file string"), "warc-index")


def _reader(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for name in rows["file"]:
                bundle = BundleReader(f"{folder}/{name}")
                for i in range(len(bundle.sizes)):
                    out = []
                    for offset, headers, block in parse_records(bundle.frame(i)):
                        payload = block[len(HTTP):]
                        stored = headers["warc-payload-digest"].removeprefix("sha1:")
                        response = headers["warc-type"] == "response"
                        if response and payload_digest(payload) != stored:
                            raise ValueError(f"payload of {headers['warc-record-id']} is damaged")
                        page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                        out.append((headers["warc-record-id"], name, i, offset, page and int(page), headers.get("warc-target-uri"), headers["warc-type"], refers and int(refers),
                                    len(payload) if response else int(headers["x-payload-length"]), stored))
                    frame = pd.DataFrame(out, columns=["record_id", "file", "frame", "offset", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"])
                    yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})
                bundle.close()
    return run


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """All records of the indexed files, frame by frame, one task per file; response payloads are checked against their digests."""
    files = index.select("file").distinct()
    files = files.repartition(max(1, files.count()))
    return files.mapInPandas(_reader(folder), "record_id string, file string, frame int, offset long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    index = write_bundles(table(spark, sf_dir, "pages"), folder)
    return read_bundles(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first FROM p),
g AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(h, CAST(5 * i + 1 AS BIGINT), 5))::BIGINT) AS v FROM f)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(v, lambda x: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> s) & 31 AS BIGINT) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""

QUERIES = {"op8_warc": op8_warc}
ORACLES = {"op8_warc": SQL}
