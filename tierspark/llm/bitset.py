"""A bitset of bounded size that every task gets, to tell rows that need a closer look from the many that do not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bits per hash, and the most bitmaps of 4 KB, 2^15 bits each, however many hashes there are: 32 MB.
BITS_EACH, MOST_BITMAPS = 32, 1 << 13


def mark_held(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """``rows`` with ``_held``: whether their ``fp`` may be among the distinct ``fp`` of ``hashes``.

    None that is among them is missed; with more of them than the bitset has room for, more others pass as well.
    ``hashes`` is read twice.
    """
    most = hashes.count() * BITS_EACH >> 15
    bits = min(MOST_BITMAPS, 1 << most.bit_length()) << 15
    place = F.col("fp").bitwiseAND(F.lit(bits - 1))
    placed = F.shiftright(place, 15).alias("_map"), place.bitwiseAND(F.lit((1 << 15) - 1)).alias("_bit")
    bitmaps = hashes.select(*placed).groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = "CAST(conv(hex(substr(_bits, CAST(_bit >> 3 AS int) + 1, 1)), 16, 10) AS int)"
    held = F.expr(f"coalesce(({byte} >> CAST(_bit & 7 AS int)) & 1 = 1, false)")
    met = rows.select("*", *placed).join(F.broadcast(bitmaps), "_map", "left")
    return met.select(*rows.columns, held.alias("_held"))
