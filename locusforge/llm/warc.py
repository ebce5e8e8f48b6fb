"""Web archives: a WARC writer with revisit records, and a reader that splits archives by byte ranges.

Files go to the shared folder through Arrow's file systems, named by URI.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusforge.llm.frames import mapped, settle
from locusforge.session import scratch_path

#: Payloads of at least so many bytes are written once.
LEAST_BYTES = 0
RANGE_BYTES = 8 << 20
MOST_TASKS = 20_000
READ_BYTES = 1 << 18
MAGIC = b"\x1f\x8b\x08"
HEADER_END = b"\r\n\r\n"
FIRST = b"WARC/"
#: Decoded bytes in which a record's header is looked for at a time.
HEADER_BYTES = 1 << 16


def _clean(text: str) -> str:
    """A header value on one line: control characters are percent-encoded, outer blanks too."""
    text = re.sub(r"[\x00-\x1f\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text)
    return re.sub(r"^\s+|\s+$", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One gzip member with one record; a revisit has no payload but its length and digest."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http += b"\r\n" if is_revisit else f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    fields = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}')}>"),
        ("WARC-Page-ID", page_id),
        ("WARC-Target-URI", None if url is None else _clean(url)),
        # a url that can't stand in a header as it is, exactly
        ("WARC-Page-URL", None if url is None or _clean(url) == url else base64.b64encode(url.encode()).decode()),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Payload-Length", len(payload)),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if is_revisit else None),
        ("WARC-Refers-To-Page", refers_to),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(http)),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + http + b"\r\n\r\n") + packer.flush()


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """One archive per task attempt; the rows that Spark commits name the archives that count."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    path, out, size, n = f"{root}/part-{uuid.uuid4().hex}.warc.gz", None, 0, 0
    for batch in batches:
        for row in batch.to_pylist():
            out = out or store.open_output_stream(path, compression=None)
            member = record(row["page_id"], row["url"], (row["html"] or "").encode(), row["refers_to"], row["is_revisit"])
            out.write(member)
            size += len(member)
            n += 1
    if out:
        out.close()
        yield pa.RecordBatch.from_pydict({"path": [path], "length": [size], "n_records": [n]})


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write (page_id, url, html) rows below ``folder`` and return (path, length, n_records) of the archives.

    Of equal payloads of at least ``least_bytes`` bytes the row with the largest
    page_id has the payload, the others refer to it. A null html is an empty
    payload. Rows that share the largest page_id all have the payload; a null
    page_id is smaller than any, and all rows are written if there are only
    null ones. An empty table gives no archive. Other columns are not written.
    """
    digest = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", digest.alias("digest"))
    large = F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes
    groups = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    groups = settle(groups.where("n > 1 and last is not null").select("digest", "last"), "payloads")
    again = F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("page_id"))
    typed = rows.join(groups, "digest", "left").select(
        "page_id", "url", "html", F.when(again, F.col("last")).alias("refers_to"), again.alias("is_revisit")
    )
    return settle(mapped(typed, partial(_write, folder=folder), "path string, length long, n_records long"), "archives")


class _Window:
    """Bytes of a file from a place on, read as they are needed and dropped when passed."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data = file, at, b""
        file.seek(at)

    def fill(self, n: int) -> bool:
        """At least ``n`` bytes in hand, unless the file ends before."""
        while len(self.data) < n:
            more = self.file.read(max(READ_BYTES, n - len(self.data)))
            if not more:
                return False
            self.data += more
        return True

    def skip(self, n: int) -> None:
        self.data = self.data[n:]
        self.at += n


def _decoded(window: _Window, whole: bool) -> tuple[bytes, int] | None:
    """What the gzip member at the window's start holds and its length; unless ``whole``, to its header's end if it is a record.

    None if it can't be decoded. The window is read on but not moved.
    """
    unpacker, out, given, have = zlib.decompressobj(31), [], 0, 0
    while not unpacker.eof:
        if not unpacker.unconsumed_tail and given == len(window.data) and not window.fill(given + 1):
            return None
        try:
            # what the limit left over goes first
            piece = unpacker.unconsumed_tail or window.data[given : given + READ_BYTES]
            given += 0 if unpacker.unconsumed_tail else len(piece)
            out.append(unpacker.decompress(piece, 0 if whole else HEADER_BYTES))
        except zlib.error:
            return None
        have += len(out[-1])
        if not whole and have >= len(FIRST):
            start = b"".join(out)
            if HEADER_END in start or not start.startswith(FIRST):
                break
            out = [start]
    return b"".join(out), given - len(unpacker.unused_data)


def _fields(head: bytes) -> dict[str, str] | None:
    """Header fields by lowered name; None if it is no record."""
    text, end, _ = head.partition(HEADER_END)
    lines = text.split(b"\r\n")
    if not end or not re.fullmatch(rb"WARC/\d+\.\d+", lines[0]):
        return None
    try:
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines[1:])}
    except UnicodeDecodeError:
        return None
    return fields if fields.get("content-length", "").isdigit() and "warc-type" in fields else None


def range_records(file, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of the records whose first byte lies in the range.

    Places with the gzip magic are tried; one counts if its member decodes to
    the header of a record. After a record the next member follows directly.
    """
    window = _Window(file, start)
    while window.at < end:
        if not window.fill(len(MAGIC)):
            return
        place = window.data.find(MAGIC)
        if place < 0:
            window.skip(max(1, len(window.data) - len(MAGIC) + 1))
            continue
        window.skip(place)
        if window.at >= end:
            return
        head = _decoded(window, False)
        fields = head and _fields(head[0])
        member = _decoded(window, True) if fields else None
        if not member:
            window.skip(1)
            continue
        block = member[0].partition(HEADER_END)[2][: int(fields["content-length"])]
        yield fields, block
        window.skip(member[1])


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    for batch in batches:
        for row in batch.to_pylist():
            store, path = fs.FileSystem.from_uri(row["path"])
            rows, held = [], 0
            with store.open_input_file(path) as file:
                for fields, block in range_records(file, row["start"], row["end"]):
                    payload = block.partition(HEADER_END)[2]
                    stated = fields["warc-payload-digest"].removeprefix("sha1:")
                    intact = fields["warc-type"] == "revisit" or (
                        base64.b32encode(hashlib.sha1(payload).digest()).decode() == stated
                        and len(payload) == int(fields["warc-payload-length"])
                    )
                    page, refers = fields.get("warc-page-id"), fields.get("warc-refers-to-page")
                    length = int(fields["warc-payload-length"])
                    if not intact:
                        length, stated = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    rows.append((
                        page and int(page), _url(fields), length, stated, fields["warc-type"], refers and int(refers), intact,
                        payload if with_payload and fields["warc-type"] == "response" else None,
                    ))
                    held += len(payload) if with_payload else 200
                    if held > 1 << 22:
                        yield _batch(rows, names)
                        rows, held = [], 0
            if rows:
                yield _batch(rows, names)


def _url(fields: dict[str, str]) -> str | None:
    exact = fields.get("warc-page-url")
    return fields.get("warc-target-uri") if exact is None else base64.b64decode(exact).decode()


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, names=[*names, "payload"])


def read_archives(archives: DataFrame, range_bytes: int = RANGE_BYTES, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives in (path, length) rows.

    Columns: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, intact (the payload has the stated digest and length; true for
    revisits, whose figures are the stated ones) and payload (null for revisits,
    and without ``with_payload``). Figures of a response are those of the payload
    that was read. A url comes back as it was, whatever its length and characters.
    Bytes between records that are no record are passed over.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    ranges = archives.where("length > 0").select("path", starts.alias("start"), "length")
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, "length").alias("end"))
    schema = (
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "intact boolean, payload binary"
    )
    # a number of tasks is given, for Spark would put the few bytes that name the ranges into one
    n_ranges = F.sum(F.ceil(F.col("length") / range_bytes)).alias("n")
    tasks = max(1, min(MOST_TASKS, int(archives.agg(n_ranges).first()["n"] or 1)))
    return mapped(ranges.repartition(tasks, "path", "start"), partial(_read, with_payload=with_payload), schema)


def archive_round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES, with_payload: bool = False) -> DataFrame:
    """Pages written to archives in the shared folder and read back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, least_bytes), with_payload=with_payload)
