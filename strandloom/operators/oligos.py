"""Where oligos align well enough, by an index of their pieces.

Of an oligo cut into one piece more than it may have mismatches, some piece aligns without any. Pieces are hash-joined with the windows of the
molecules of the same length, and only what meets is compared base by base. All of it is expressions and joins; the work grows with the windows and with
what meets, not with windows times oligos.

Edge cases: as in alignment_scores, shorter oligos are taken as long as the longest, with places at their end that every base of
ACGT matches; other letters of a molecule match nothing; molecules shorter than the longest oligo and empty libraries have no places; a bound so low that
a piece would be empty is an error, as it rules nothing out. Rows are told apart by their key columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pieces up to so many (some 60 bytes each) are sent to all executors, so that windows needn't move; beyond, both sides are shuffled.
BROADCAST_PIECES = 500_000


def pieces(oligos: DataFrame, size: int, least: int) -> DataFrame:
    """turned, at, piece: pieces of the reverse complements (turned) and their places (from 0), one more each than a match may have mismatches."""
    n = size - least + 1
    cut = lambda i: F.floor(i * F.length("turned") / n).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(cut(i).alias("at"), F.substring("turned", cut(i) + 1, cut(i + 1) - cut(i)).alias("piece")))
    return oligos.select("turned", F.explode(each).alias("x")).select("turned", "x.at", "x.piece")


def matching(sequence: Column, site: Column, turned: Column, size: int) -> Column:
    """How many of the places of an oligo match, the molecule's window from site (from 0) on."""
    window = F.substring(sequence, site + 1, F.length(turned))
    same = F.size(F.filter(F.arrays_zip(F.split(window, "").alias("a"), F.split(turned, "").alias("b")), lambda x: (x["a"] == x["b"]) & (x["a"] != "")))
    rest = F.substring(sequence, site + 1 + F.length(turned), size - F.length(turned))
    return same + F.length(F.regexp_replace(rest, "[^ACGT]", ""))


def sites_above(df: DataFrame, oligos: list[str] | DataFrame, least: int, keys: tuple[str, ...] = ("row_key",)) -> DataFrame:
    """keys, site (from 0), score: the places where some oligo matches in at least so many places, with the best score there.

    oligos: a list, or a table (oligo) of any size. Equal to the places of alignment_scores with that score or a higher one.
    """
    spark = df.sparkSession
    table = spark.createDataFrame([(o,) for o in oligos], "oligo string") if isinstance(oligos, list) else oligos
    turned = table.filter("oligo is not null").select(F.reverse(F.translate("oligo", "ACGT", "TGCA")).alias("turned")).distinct()
    shortest, size = turned.agg(F.min(F.length("turned")), F.max(F.length("turned"))).first()
    if size is None:
        return df.select(*keys, F.lit(0).alias("site"), F.lit(0).alias("score")).limit(0)
    if size - least + 1 > shortest:
        raise ValueError(f"with {size - least} mismatches some pieces of an oligo of {shortest} bases would be empty")
    index = pieces(turned, size, min(least, size))
    lengths = [r[0] for r in index.select(F.length("piece")).distinct().collect()]  # no more than there are lengths of oligos
    few = index.limit(BROADCAST_PIECES + 1).count() <= BROADCAST_PIECES
    end = F.length("sequence")

    def of_length(k: int) -> Column:
        each = F.transform(F.sequence(F.lit(0), end - k), lambda i: F.struct(i.alias("pos"), F.substring("sequence", i + 1, F.lit(k)).alias("piece")))
        return F.when(end >= k, each).otherwise(F.array().cast("array<struct<pos:int,piece:string>>"))

    windows = F.flatten(F.array(*map(of_length, lengths)))
    long = df.filter(end >= size)
    met = long.select(*keys, "sequence", F.explode(windows).alias("x")).select(*keys, "sequence", "x.pos", "x.piece").join(F.broadcast(index) if few else index, "piece")
    site = F.col("pos") - F.col("at")
    met = met.withColumn("site", site).filter((site >= 0) & (site <= end - size))
    scored = met.withColumn("score", matching(F.col("sequence"), F.col("site"), F.col("turned"), size)).filter(F.col("score") >= least)
    return scored.groupBy(*keys, "site").agg(F.max("score").alias("score"))
