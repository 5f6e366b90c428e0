"""Joins of wide rows with a part of their keys: a bitmap of a fixed size tells which rows need not move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# A filter on hashes of keys has 2**25 bits: 1,024 pages of 32,768 bits, 4 MB in all, whatever the input.
PAGES = 1024


def _bit(key: Column) -> Column:
    """Place of a key in the bitmap, counted from 1."""
    return F.pmod(F.xxhash64(key), F.lit(PAGES * 32768)) + 1


def key_bitmap(keys: DataFrame, key: str) -> DataFrame:
    """Bitmap of the hashes of a key column: at most ``PAGES`` rows of 4 KB."""
    place = _bit(F.col(key))
    return keys.groupBy(F.bitmap_bucket_number(place).alias("_page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits")
    )


def marked(rows: DataFrame, key: str, bitmap: DataFrame) -> DataFrame:
    """``rows`` with ``_maybe``: true where the key is in the bitmap, and by chance for a few others.

    The broadcast is bounded by 4 MB and nothing is shuffled; when a very large key set fills the
    bitmap, all rows are marked.
    """
    bit = F.bitmap_bit_position(_bit(F.col(key))).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    paged = rows.withColumn("_page", F.bitmap_bucket_number(_bit(F.col(key)))).join(F.broadcast(bitmap), "_page", "left")
    is_set = F.call_function("getbit", F.coalesce(byte, F.lit(0)), F.pmod(bit, F.lit(8))) == 1
    return paged.withColumn("_maybe", is_set).drop("_page", "_bits")


def maybe_in(rows: DataFrame, key: str, bitmap: DataFrame) -> DataFrame:
    """Rows whose key may be in the bitmap: all that are, and a few others."""
    return marked(rows, key, bitmap).where("_maybe").drop("_maybe")


def join_few(rows: DataFrame, few: DataFrame, key: str, how: str) -> DataFrame:
    """``rows`` joined (``left`` or ``left_anti``) with a table of a part of their keys.

    Wide rows without a partner are told by the bitmap and are not shuffled; the others always go
    through a merge join, so that the work grows with the input and does not change its kind.
    """
    both = marked(rows, key, key_bitmap(few, key))
    near = both.where("_maybe").drop("_maybe").join(few.hint("merge"), key, how)
    far = both.where("NOT _maybe").drop("_maybe")
    return near.unionByName(far, allowMissingColumns=True)
