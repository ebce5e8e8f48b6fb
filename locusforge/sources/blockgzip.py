"""Gzip text in tasks of byte ranges, whatever the size of a file.

Block-gzip members say how long they are, so a task can start at the first one
of its range: a header in the bytes is believed if its block inflates. Each
line belongs to the range in which it starts, as with plain text: a range but
the first leaves out what comes before its first line end, and goes on to the
end of its last line. Plain gzip has no such marks; it is read by the task of
its first byte, as a stream.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusforge.session import ship_package
from locusforge.sources.listing import list_objects

#: Bytes of compressed text that a task owns.
RANGE_BYTES = 64 << 20
#: Bytes of text in one row, about, before it is cut into lines.
PIECE_BYTES = 8 << 20
# fixed values: start of a gzip member with an extra field, its first part's length, and the longest block
MAGIC = b"\x1f\x8b\x08\x04"
HEAD = 12
LONGEST_BLOCK = 1 << 16


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a path as Spark lists it, and the path there; blanks and percent signs stand for themselves."""
    return fs.FileSystem.from_uri(path if path.startswith("/") else quote(path, safe="/:@"))


def _block_length(head: bytes) -> int | None:
    """Length of the block whose first bytes are given, or none if it isn't a block."""
    if len(head) < HEAD or head[:4] != MAGIC:
        return None
    extra = head[HEAD : HEAD + struct.unpack_from("<H", head, 10)[0]]
    at = 0
    while at + 4 <= len(extra):
        name, size = extra[at : at + 2], struct.unpack_from("<H", extra, at + 2)[0]
        if name == b"BC" and size == 2 and at + 6 <= len(extra):
            return struct.unpack_from("<H", extra, at + 4)[0] + 1
        at += 4 + size
    return None


class _Bytes:
    """A file's bytes by place, read some at a time."""

    def __init__(self, file, length: int, ahead: int = 1 << 20):
        self.file, self.length, self.ahead = file, length, ahead
        self.start, self.held = 0, b""

    def at(self, place: int, size: int) -> bytes:
        size = max(min(size, self.length - place), 0)
        if not self.start <= place <= place + size <= self.start + len(self.held):
            self.file.seek(place)
            self.start, self.held = place, self.file.read(min(max(size, self.ahead), self.length - place))
        return self.held[place - self.start : place - self.start + size]


def _inflate(block: bytes) -> bytes:
    """The text of one whole block; its checksum is compared."""
    stream = zlib.decompressobj(wbits=31)
    text = stream.decompress(block)
    if not stream.eof or stream.unused_data:
        raise ValueError("damaged block")
    return text


def _first_block(data: _Bytes, start: int, stop: int) -> int | None:
    """Place of the first block that starts in the range."""
    place = start
    while place < stop:
        part = data.at(place, LONGEST_BLOCK)
        hit = part.find(MAGIC)
        if hit < 0:
            place += max(len(part) - len(MAGIC) + 1, 1)
            continue
        place += hit
        if place >= stop:
            return None
        head = data.at(place, LONGEST_BLOCK)
        length = _block_length(head)
        if length is not None:
            try:
                _inflate(data.at(place, length))
                return place
            except (ValueError, zlib.error):
                pass
        place += 1
    return None


def _texts(data: _Bytes, start: int, stop: int) -> Iterator[tuple[bytes, bool]]:
    """Texts of the blocks from the range's first one on, and whether each starts in the range; to the end of the file."""
    place = 0 if start == 0 else _first_block(data, start, stop)
    while place is not None and place < data.length:
        length = _block_length(data.at(place, LONGEST_BLOCK))
        if length is None:
            raise ValueError(f"no block at byte {place}")
        yield _inflate(data.at(place, length)), place < stop
        place += length


def _streamed(data: _Bytes) -> Iterator[tuple[bytes, bool]]:
    """Text of plain gzip, member after member."""
    place, stream = 0, None
    while place < data.length:
        part = data.at(place, 1 << 20)
        place += len(part)
        while part:
            if stream is None:
                part = part.lstrip(b"\0")
                if not part:
                    break
                stream = zlib.decompressobj(wbits=31)
            yield stream.decompress(part), True
            part = stream.unused_data
            if stream.eof:
                stream = None
    if stream is not None:
        raise EOFError("truncated gzip stream")


def _lines(data: _Bytes, start: int, stop: int) -> Iterator[bytes]:
    """Whole lines of a range in pieces of about ``PIECE_BYTES``, each without its last line end."""
    blocks = _block_length(data.at(0, LONGEST_BLOCK)) is not None
    if not blocks and start > 0:
        return
    held, owned = b"", start == 0
    for text, inside in _texts(data, start, stop) if blocks else _streamed(data):
        if not owned:
            # the line that is open at the start of the range belongs to the one before
            if not inside:
                return
            cut = text.find(b"\n")
            if cut < 0:
                continue
            text, owned = text[cut + 1 :], True
        if not inside:
            cut = text.find(b"\n")
            if cut >= 0:
                yield held + text[:cut]
                return
        held += text
        if len(held) >= PIECE_BYTES:
            cut = held.rfind(b"\n")
            if cut >= 0:
                yield held[:cut]
                held = held[cut + 1 :]
    if held:
        yield held[:-1] if held.endswith(b"\n") else held


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "start", "line", "text", "error"]
    for batch in batches:
        for path, length, start, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "start", "stop"))):
            number = 0
            try:
                store, place = store_of(path)
                with store.open_input_file(place) as file:
                    for piece in _lines(_Bytes(file, length), start, stop):
                        row = [[path], [start], [number], [piece.decode("utf-8")], [None]]
                        yield pa.RecordBatch.from_arrays(_columns(row), names=names)
                        number += piece.count(b"\n") + 1
            except Exception as problem:  # noqa: BLE001  a broken file is a row of the result
                yield pa.RecordBatch.from_arrays(_columns([[path], [start], [number], [None], [str(problem)]]), names=names)


def _columns(row: list[list]) -> list[pa.Array]:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return [pa.array(values, kind) for values, kind in zip(row, kinds)]


def block_ranges(spark: SparkSession, prefix: str, glob: str = "*", size: int = RANGE_BYTES) -> DataFrame:
    """(path, length, start, stop) of the byte ranges of the files below a prefix."""
    files = list_objects(spark, prefix, glob).where("length > 0").select("path", "length")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start")
    ranges = files.select("path", "length", starts)
    return ranges.withColumn("stop", F.least(F.col("start") + size, F.col("length")))


def read_gzip_lines(
    spark: SparkSession, prefix: str, glob: str = "*", size: int = RANGE_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(path, start, pos, line) of gzip files below a prefix, and (path, start, error) of ranges that failed.

    ``start`` and ``pos`` order the lines of a file. A range that fails names
    its file and gives the lines before the damage; join the failures on the
    path to leave such files out. Files of any size are read; those of
    block-gzip by many tasks.
    """
    ship_package(spark)
    ranges = block_ranges(spark, prefix, glob, size)
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = ranges.repartition(tasks, "path", "start").mapInArrow(
        _read, "path string, start long, line long, text string, error string"
    )
    failures = rows.where(F.col("error").isNotNull()).select("path", "start", "error")
    lines = rows.where(F.col("error").isNull()).select(
        "path", "start", "line", F.posexplode(F.split("text", "\n")).alias("place", "value")
    )
    return lines.select("path", "start", (F.col("line") + F.col("place")).alias("pos"), F.col("value").alias("line")), failures
