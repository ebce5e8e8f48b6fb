"""A filter of fixed size over 64-bit hashes, built by Spark and sent to tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2^25 bits are 4 MiB, whatever the number of hashes.
FILTER_BITS = 25


def bit_filter(rows: DataFrame, column: str) -> np.ndarray:
    """The filter of a column of hashes; more hashes let more others through, none is lost."""
    bits = rows.select(F.shiftrightunsigned(column, 64 - FILTER_BITS).alias("bit")).select(
        F.bitmap_bucket_number("bit").alias("bucket"), F.bitmap_bit_position("bit").alias("position")
    )
    held = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    # 4 KiB for each of the filter's parts, as many as its fixed size has
    for bucket, part in bits.groupBy("bucket").agg(F.bitmap_construct_agg("position")).collect():
        # the parts are numbered from 1, and bit 0 is in part 0, position 0
        _place(held, bucket, part)
    return held


def _place(held: np.ndarray, bucket: int, part: bytes) -> None:
    """Put one bitmap part into the filter; part ``k`` has the bits from ``32768 * (k - 1) + 1`` on."""
    found = np.flatnonzero(np.unpackbits(np.frombuffer(part, np.uint8), bitorder="little")).astype(np.int64)
    bits = found + 32768 * (bucket - 1) + 1 if bucket > 0 else -found
    np.bitwise_or.at(held, bits >> 3, (1 << (bits & 7)).astype(np.uint8))


def may_hold(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be one of the filter's."""
    bit = hashes >> np.uint64(64 - FILTER_BITS)
    return (held[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
