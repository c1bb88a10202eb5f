"""Which original molecules still occur, as bitmaps of their ordinals.

A molecule's pieces and copies keep its ordinal, its place in its packet. A bitmap holds 32,768 of them; tasks make theirs for the packets that they meet, and only
those (4 KB each) are shuffled and merged, however many pieces there are. Counts, occurring and missing ids follow from
the merged bitmaps.

Edge cases: ordinals are counted from 0 and null ones take no part; an empty table has no bitmaps; rows that repeat an ordinal set one bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["sample_id", "packet_id", "bucket"]
#: Bitmaps up to so many are sent to all executors, so that molecules needn't move; beyond, both sides are shuffled.
BROADCAST_MAPS = 5_000


def placed(df: DataFrame) -> DataFrame:
    """df with bucket and bit of the ordinal."""
    known = df.filter("ordinal is not null")
    return known.withColumns({"bucket": F.floor(F.col("ordinal") / F.lit(32768)).cast("bigint"), "bit": F.pmod("ordinal", F.lit(32768)).cast("bigint")})


def ordinals(df: DataFrame) -> DataFrame:
    """sample_id, packet_id, bucket, bitmap of the ordinals in df."""
    return placed(df).groupBy(*KEYS).agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def merged(*maps: DataFrame) -> DataFrame:
    """The union of bitmaps, of packets that were met in different runs too."""
    every = maps[0]
    for m in maps[1:]:
        every = every.unionByName(m)
    return every.groupBy(*KEYS).agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def counted(maps: DataFrame, *by: str) -> DataFrame:
    return maps.groupBy(*by).agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


def is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))


def occurring(original: DataFrame, maps: DataFrame, there: bool = True) -> DataFrame:
    """The rows of original whose ordinal is in the bitmaps; not there: those whose ordinal isn't."""
    small = F.broadcast(maps) if maps.limit(BROADCAST_MAPS + 1).count() <= BROADCAST_MAPS else maps
    found = placed(original).join(small, KEYS, "left")
    hit = F.coalesce(is_set(F.col("bitmap"), F.col("bit")), F.lit(False))
    return found.filter(hit if there else ~hit).select(*original.columns)


def step_summary(df: DataFrame, original: DataFrame) -> DataFrame:
    """analytics.step_summary from one pass over each table: counts and bitmaps are made together, and no id is shuffled."""
    n = F.length("sequence")
    band = lambda a, b: F.count_if((n >= a) & (n < b))
    counts = [F.count("*").alias("molecules"), band(0, 100).alias("under_100"), band(100, 500).alias("under_500"), band(500, 1000).alias("under_1000"), F.count_if(n >= 1000).alias("longer")]
    each = placed(df).groupBy(*KEYS).agg(*counts, F.bitmap_construct_agg("bit").alias("bitmap"))
    names = ["molecules", "under_100", "under_500", "under_1000", "longer"]
    now = each.groupBy("sample_id").agg(*[F.sum(c).alias(c) for c in names], F.sum(F.bitmap_count("bitmap")).alias("seen"))
    total = counted(ordinals(original), "sample_id").withColumnRenamed("n", "total")
    out = now.join(total, "sample_id", "left")
    return out.select("sample_id", "molecules", F.round(F.col("seen") / F.col("total"), 9).alias("represented"), *names[1:])
