"""A mix of all sources in given proportions, by pivotal rounding of how often each document is taken.

A source's target over its size is how often each of its documents should be taken: a whole number of times, and a fraction.
The fractions are rounded in pairs: words are moved at random from one document to the other, without changing what the two come to
or what either comes to on average, until one of them is taken a whole number of times. What is left of a pair meets the
next document. Documents are dealt into groups of bounded size, each of which ends with at most one document of a source that is still
a fraction; those meet in a tree of groups, level by level. The one left at the root is cut, so that its source
comes to its target but for less than a word.

Targets: sources in order of code points, null last, have the WEIGHTS in turn. Places are counted over ranges of sources, and the
level at which sources reach their limit is found by rounds of aggregates; neither brings the sources together.

Random numbers follow from the source and the place in the tree, so reruns agree whatever the partitions.

Edge cases: null and empty texts have size 0 and nothing is taken of them; rows that agree in source, doc_id and size are
counted together before they meet others (so very many of them are no group) and come out as that many rows; null ids and sources are kept; an
empty table gives no rows. Extra columns don't take part.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, ship, table

#: Weights of sources in turn; words of the mix, and of one source at most, as fractions of what there is.
WEIGHTS, SHARE, MOST = (3, 1, 2), (3, 2), 2
#: Rows that meet in one group; groups of one source that meet in one of the next level; sources in one range; copies of a row made at once.
GROUP_ROWS, FAN, RANGE, STEP = 50_000, 32, 100_000, 100_000
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """(source, doc_id, size, c): how many rows agree in these."""
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    plain = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"))
    return plain.groupBy("source", "doc_id", "size").agg(F.count("*").alias("c"))


def targets(rows: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of rows (source, size, c)."""
    spark = rows.sparkSession
    each, _ = scratch.keep(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("c")).alias("source_size")))
    n = each.count()
    in_order = each.repartitionByRange(1 + n // RANGE, F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    # rows keep their order from here to the write, and an id's lower 33 bits count them within their range
    placed, _ = scratch.keep(in_order.withColumn("at", F.monotonically_increasing_id()))
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    begin, before = 0, []
    for row in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row for each range
        before.append((row["part"], begin))
        begin += row["count"]
    begins = spark.createDataFrame(before, "part long, before long")
    turn = F.pmod(F.col("before") + within, F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1).cast("long")
    weighed, _ = scratch.keep(placed.withColumn("part", part).join(F.broadcast(begins), "part").select("source", "source_size", weight.alias("w")))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    up, down = share
    # a source is at its limit if weight * room / (down * free) > most * size; both sides are whole numbers
    room, free, full = up * total, 0, F.lit(False)
    while True:
        row = weighed.agg(F.sum(F.when(full, F.col("source_size")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("w")))).first()
        now = (up * total - most * down * (row[0] or 0), row[1] or 0)
        if now == (room, free):
            break
        room, free = now
        big = lambda x: F.lit(str(x)).cast("decimal(38,0)")
        full = (F.col("w").cast("decimal(5,0)") * big(room) > F.col("source_size").cast("decimal(19,0)") * big(most * down * free)) if free else F.lit(True)
    at = F.when(full, (most * F.col("source_size")).cast("double")).otherwise(F.col("w") * F.lit(float(room)) / F.lit(float(down * max(free, 1))))
    return weighed.select("source", "source_size", at.alias("target"))


LEFT = "source string, doc_id long, size long, times long, p double, node long"
NAMES = ["source", "doc_id", "size", "times", "p", "node"]


def pivot(size: list[int], p: list[float], draws: np.ndarray) -> tuple[list[float], int | None]:
    """Rounds fractions of documents of one source, one after another; returns them and which one is left, if any."""
    out, held = list(p), None
    for j in range(len(out)):
        if not 0 < out[j] < 1:
            continue
        if held is None:
            held = j
            continue
        i = held
        a, b = size[i] * out[i], size[j] * out[j]  # words that either takes
        give, get = min(a, size[j] - b), min(b, size[i] - a)  # most that i can give to j, and get from it
        if draws[j] * (give + get) < get:
            if give >= a:
                out[i] = 0.0
            else:
                out[i] -= give / size[i]
            out[j] = 1.0 if give < a or give >= size[j] - b else out[j] + give / size[j]
        else:
            if get >= b:
                out[j] = 0.0
            else:
                out[j] -= get / size[j]
            out[i] = 1.0 if get < b or get >= size[i] - a else out[i] + get / size[i]
        held = next((k for k in (i, j) if 0 < out[k] < 1), None)
    return out, held


def level(rows: DataFrame, parts: int) -> DataFrame:
    """One level of the tree: of each source and node at most one row stays a fraction."""

    def run(group: pa.Table) -> pa.Table:
        of = {n: group[n].to_pylist() for n in NAMES}
        source, node, size, ids, p = (of[n] for n in ("source", "node", "size", "doc_id", "p"))
        known = {s: "" if s is None else "s" + s for s in set(source)}
        # sources apart, then in an order that only depends on the documents
        order = sorted(range(len(p)), key=lambda i: (known[source[i]], node[i], xxhash.xxh64_intdigest(f"{ids[i]}:{size[i]}"), size[i], p[i]))
        begin = 0
        while begin < len(order):
            key = (source[order[begin]], node[order[begin]])
            end = begin
            while end < len(order) and (source[order[end]], node[order[end]]) == key:
                end += 1
            picked = order[begin:end]
            draws = np.random.Generator(np.random.PCG64(xxhash.xxh64_intdigest(f"{known[key[0]]}:{key[1]}:{len(picked)}", 13))).random(len(picked))
            for i, x in zip(picked, pivot([size[i] for i in picked], [p[i] for i in picked], draws)[0], strict=True):
                p[i] = x
            begin = end
        return group.select(NAMES[:4]).append_column("p", pa.array(p, pa.float64())).append_column("node", group["node"])

    return rows.groupBy(F.pmod(F.xxhash64("source", "node"), F.lit(parts)).alias("group")).applyInArrow(run, LEFT)


def rounded(rows: DataFrame, scratch: Scratch, group_rows: int = GROUP_ROWS, fan: int = FAN) -> DataFrame:
    """(source, doc_id, size, times, p): rows whose fraction p is 0 or 1, but for one of each source at most. rows: the same, p anything."""
    begun = rows.filter("p > 0 and p < 1")
    nodes = 1 + begun.count() // group_rows
    done = [rows.filter("not (p > 0 and p < 1)").select(*NAMES[:5])]
    # every document by its hash: a source of any size is spread evenly
    left, parts = begun.withColumn("node", F.pmod(F.xxhash64("doc_id", "size"), F.lit(nodes))), nodes
    while True:
        now, _ = scratch.keep(level(left, parts))
        if nodes == 1:
            return reduce(DataFrame.unionByName, [*done, now.select(*NAMES[:5])])
        done.append(now.filter("not (p > 0 and p < 1)").select(*NAMES[:5]))
        nodes = math.ceil(nodes / fan)
        left = now.filter("p > 0 and p < 1").withColumn("node", F.floor(F.col("node") / fan))
        parts = 1 + left.count() // group_rows


def mix(docs: DataFrame) -> DataFrame:
    """One row a document: its size, its source's size and target, and the words that the mix takes of it."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "mixing")
    rows, _ = scratch.keep(sizes(docs))
    aims, _ = scratch.keep(targets(rows, scratch))
    aimed = rows.join(aims.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.col("target") / F.greatest(F.col("source_size"), F.lit(1))
    times = F.when(F.col("size") > 0, F.floor(rate)).otherwise(F.lit(0).cast("long"))
    p = F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(F.lit(0.0))
    # c rows that agree: so many of them once more, one of them a fraction, the others as they are
    aimed = aimed.withColumn("times", times).withColumn("whole", F.floor(F.col("c") * p)).withColumn("p", F.col("c") * p - F.floor(F.col("c") * p))
    kinds = F.array(
        F.struct(F.col("whole").alias("rows"), F.lit(1.0).alias("share")),
        F.struct((F.col("c") - F.col("whole") - 1).alias("rows"), F.lit(0.0).alias("share")),
        F.struct(F.lit(1).cast("long").alias("rows"), F.col("p").alias("share")),
    )
    split, _ = scratch.keep(aimed.select("source", "doc_id", "size", "source_size", "target", "times", F.explode(kinds).alias("x")).filter("x.rows > 0"))
    kept = ["source", "doc_id", "size", "source_size", "target"]
    many = split.filter("x.share in (0.0, 1.0)").select(*kept, (F.col("times") + F.col("x.share").cast("long")).alias("times"), F.lit(0.0).alias("p"), "x.rows")
    single = rounded(split.filter("x.share not in (0.0, 1.0)").select("source", "doc_id", "size", "times", F.col("x.share").alias("p")), scratch)
    single = single.join(aims.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).select(*kept, "times", "p", F.lit(1).cast("long").alias("rows"))
    # each row as often as it stands, STEP at a time, so that no array is longer
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / STEP)))
    every = many.unionByName(single).withColumn("block", blocks)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(STEP).cast("long"), F.col("rows") - F.col("block") * STEP)))
    taken = F.col("times") * F.col("size") + F.round(F.col("p") * F.col("size")).cast("long")
    return every.withColumn("each", each).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    return mix(table(spark, sf_dir, "documents"))
