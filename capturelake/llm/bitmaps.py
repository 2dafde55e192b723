"""Bitmaps of hashed keys: a bounded table that tells most rows apart without a shuffle.

A key that was put in is always hit; others are hit by chance, the more the
fuller the bitmap, so what is hit must be compared exactly afterwards.  Wrong
hits only cost time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of 32768 bits; together 8 MB.
BITMAP_BUCKETS = 2048


def _bit(key: Column) -> tuple[Column, Column]:
    """Bucket and place of a key's bit in a bitmap of BITMAP_BUCKETS x 32768 bits."""
    return F.pmod(F.shiftrightunsigned(key, 15), F.lit(BITMAP_BUCKETS)).cast("int"), key.bitwiseAND(F.lit(32767))


def bitmap_of(keys: DataFrame) -> DataFrame:
    """Bitmap of a column of hashes named key: bucket, bits; at most BITMAP_BUCKETS rows of 4 kB, whatever the number of keys."""
    bucket, place = _bit(F.col("key"))
    return keys.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(place).alias("bits"))


def flag_by(rows: DataFrame, key: Column, bitmap: DataFrame, name: str) -> DataFrame:
    """Rows with a flag that is true for every key in the bitmap, and for a few others."""
    met = rows.withColumn("_key", key).join(
        F.broadcast(bitmap.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))),
        _bit(F.col("_key"))[0] == F.col("_bucket"), "left",
    )
    place = _bit(F.col("_key"))[1]
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, place.bitwiseAND(F.lit(7)).cast("int")) == 1
    return met.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_key", "_bucket", "_bits")
