"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosine verification, components.

Vectors that are equal are one class with a size. Each class gets the signs of its products with random hyperplanes, in
``tables`` groups of ``bits``; classes that agree on all signs of a table share a bucket. ``bits`` grows with the logarithm of
the number of classes, so buckets keep their size, and ``tables`` is then chosen so that a pair right at the bound is missed with
a chance of at most MISS.

1. A class sends, for each table, its bucket, its number and a sketch (the first SKETCH signs). Vectors stay where they are.
2. Within a bucket rows are joined to groups by pairs whose sketches differ in at most APART signs and that didn't meet in an
   earlier table that the sketch covers. So a pair goes on in one table, mostly, and what is like nothing ends here.
3. Vectors are joined to the rows that went on. All cosines of a group's rows are taken in double precision. A pair counts in
   the first table in which it meets; signs are taken anew for that, as products of whole numbers, which are exact whatever
   the order. Counts and a spanning forest of the links are returned, never the pairs.

Buckets of more than UNIT rows, and groups of more than BLOCK_BYTES of vectors, are cut into blocks, of which every pair is one unit of work,
so memory is bounded whatever the size of a bucket. A group of S vectors that are all alike does need all its S * S / 2
cosines, as links are counted exactly; its vectors are sent once as long as they fit a block, and else once for each pair of blocks.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
different lengths; a repeated row counts as another vector of the same id, also if the vectors of that id differ; rows with a null id stay, with null component,
and are kept; ties don't arise, as the component is the smallest id; an empty table gives no rows. Other columns don't take part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import Scratch, components, ship, table

COSINE = 0.9
MISS = 1e-3
BUCKET = 4096
SKETCH = 128
#: Signs of a sketch in which a pair at the bound differs are 18 in the mean, with a deviation of 4; more than these have a chance of 2e-6.
APART = 38
#: Rows of keys, and bytes of vectors in double precision, in one unit of work.
UNIT, BLOCK_BYTES = 16384, 16 << 20
#: Rows, and bytes, of the units that a worker takes at once.
GROUP_ROWS, GROUP_BYTES = 60_000, 8 << 20
SEED = 17
TABLE_BITS = 44


def shape_of(classes: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """bits and tables for so many classes; a single table without bits, where all meet, for few."""
    bits = max(0, min(TABLE_BITS, round(math.log2(max(1, classes) / BUCKET))))
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - together))) if bits else 1


def planes(dim: int, count: int) -> np.ndarray:
    """Hyperplanes with whole coordinates under 2 ** 11."""
    return np.clip(np.rint(np.random.default_rng([SEED, dim]).standard_normal((count, dim)) * 256), -2047, 2047).T


def signs(x: np.ndarray, count: int) -> np.ndarray:
    """Signs of the products with the hyperplanes. Vectors are taken as whole numbers up to 2 ** 20, so that the products are exact for up to 2 ** 22 components."""
    whole = np.rint(x * ((1 << 20) / np.abs(x).max(1))[:, None])
    return (whole @ planes(x.shape[1], count)) >= 0


def codes(bit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The bucket of each row in each table."""
    weights = (1 << np.arange(bits)).astype(np.int64)
    return (bit[:, : bits * tables].reshape(len(bit), tables, bits) * weights).sum(2)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


KEYED = "dim int, k long, node long, a long, b long"


def keyed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """One row for each class and table: the bucket with its table, the class, and the sketch in two numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column(2).to_numpy()
            for dim in sorted(set(lengths.tolist())):
                at = np.flatnonzero(lengths == dim)
                bit = signs(matrix(b.column(1).take(pa.array(at))), max(bits * tables, SKETCH))
                code = codes(bit, bits, tables)
                sketch = np.packbits(bit[:, :SKETCH], axis=1).view(np.int64)
                node = b.column(0).take(pa.array(at))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), dim, np.int32)), pa.array(code[:, t] | t << TABLE_BITS), node, pa.array(sketch[:, 0].copy()), pa.array(sketch[:, 1].copy())], ["dim", "k", "node", "a", "b"])

    return classes.mapInArrow(run, KEYED)


def joined(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the sets of u and v, pair by pair; parent[x] is always the first row of the set of x."""
    while len(u):
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def steps(rows: int, cells: int = 1 << 22) -> Iterator[np.ndarray]:
    """Row numbers in slices, so that a slice times all rows has a bounded number of cells."""
    step = max(1, cells // max(1, rows))
    for begin in range(0, rows, step):
        yield np.arange(begin, min(rows, begin + step))


def likely(sketch: np.ndarray, table_no: int, bits: int, side: np.ndarray | None) -> np.ndarray:
    """For each row of a bucket the first one of its group. Groups are joined by pairs (of different sides) with sketches
    near each other that no earlier table within the sketch brought together; a row without any is a group of its own."""
    bit = np.unpackbits(sketch.view(np.uint8).reshape(len(sketch), -1), axis=1)
    plus = bit.astype(np.float32) * 2 - 1
    code = codes(bit, bits, min(table_no, SKETCH // bits)) if bits and table_no else np.zeros((len(bit), 0), np.int64)
    parent = np.arange(len(bit))
    for at in steps(len(bit)):
        near = (plus[at] @ plus.T) >= SKETCH - 2 * APART
        near[np.arange(len(at)), at] = False
        if side is not None:
            near &= side[at][:, None] != side[None, :]
        some = np.flatnonzero(near.any(1))
        if len(some):
            near = near[some]
            for c in code.T:
                near &= c[at[some]][:, None] != c[None, :]
            near &= parent[at[some]][:, None] != parent[None, :]
            u, v = np.nonzero(near)
            joined(parent, at[some][u], v)
    return parent


def parts(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Rows with equal values in all columns, group by group."""
    order = np.lexsort(columns)
    if not len(order):
        return []
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    return np.split(order, np.flatnonzero(new))


def blocked(rows: DataFrame, sizes: DataFrame, key: list[str], most: Column) -> DataFrame:
    """rows with their block (as part) of their group, once for each pair of blocks p <= q that has it; groups without a size are one block."""
    out = rows.join(sizes, key, "left").withColumn("blocks", F.coalesce(F.ceil(F.col("rows") / most * 2).cast("int"), F.lit(1))).drop("rows")
    out = out.withColumn("part", F.pmod(F.xxhash64("node", "k"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return out.withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")}).drop("blocks", "other")


def going_on(keys: DataFrame, bits: int, scratch: Scratch) -> DataFrame:
    """dim, k, p, q, side, node, c of the rows of buckets that may have partners there: those of one c are to be compared, within p = q all, else those of unlike sides."""
    large, _ = scratch.keep(keys.groupBy("dim", "k").agg(F.count("*").alias("rows")).filter(F.col("rows") > UNIT))
    units = blocked(keys, large, ["dim", "k"], F.lit(UNIT))
    total = keys.count() + (large.agg(F.sum(F.col("rows") * F.ceil(F.col("rows") * 2 / F.lit(UNIT)))).first()[0] or 0)
    groups = max(1, int(total) // GROUP_ROWS)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        dim, k, node, a, b, side, p, q = (t.column(c).to_numpy() for c in ("dim", "k", "node", "a", "b", "part", "p", "q"))
        sketch, kept, roots = np.stack([a, b], 1), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in parts([q, p, k, dim]):
            if len(at) > 1:
                first = likely(sketch[at], int(k[at[0]]) >> TABLE_BITS, bits, side[at] if p[at[0]] != q[at[0]] else None)
                several = np.flatnonzero(np.bincount(first, minlength=len(at))[first] > 1)
                kept.append(at[several])
                roots.append(node[at[first[several]]])
        at = np.concatenate(kept)
        return pa.table({"dim": dim[at], "k": k[at], "u": p[at], "w": q[at], "side": side[at], "node": node[at], "c": np.concatenate(roots)})

    return units.withColumn("g", F.pmod(F.xxhash64("dim", "k", "p", "q"), F.lit(groups))).groupBy("g").applyInArrow(run, "dim int, k long, u int, w int, side int, node long, c long")


OUT = "node long, n long, root long"


def compared(x: np.ndarray, node: np.ndarray, size: np.ndarray, sides: list[np.ndarray], table_no: int, bits: int, cosine: float) -> tuple[list[int], list[int], list[int]]:
    """For one unit: (node, links counted, itself), and (node, 0, root) of a spanning forest. Pairs on one of the given sides are other units'."""
    code = codes(signs(x, bits * table_no), bits, table_no) if table_no else np.zeros((len(x), 0), np.int64)
    x = x / np.abs(x).max(1)[:, None]
    x /= np.sqrt((x * x).sum(1))[:, None]
    n, parent = np.zeros(len(x), np.int64), np.arange(len(x))
    for at in steps(len(x)):
        link = (x[at] @ x.T) >= cosine
        link &= at[:, None] < np.arange(len(x))[None, :]  # each pair once
        for s in sides:
            link &= s[at][:, None] != s[None, :]
        some = np.flatnonzero(link.any(1))
        if len(some):
            link, rows = link[some], at[some]
            for c in code.T:
                link &= c[rows][:, None] != c[None, :]
            n[rows] += link @ size
            n += link.T @ size[rows]
            link &= parent[rows][:, None] != parent[None, :]
            u, v = np.nonzero(link)
            joined(parent, rows[u], v)
    moved, some = np.flatnonzero(parent != np.arange(len(x))), np.flatnonzero(n)
    return [*node[some], *node[moved]], [*n[some], *[0] * len(moved)], [*node[some], *node[parent[moved]]]


def linked(on: DataFrame, reps: DataFrame, bits: int, cosine: float, scratch: Scratch) -> DataFrame:
    """node, n, root: links counted in parts, and edges to other nodes, of the rows that went on."""
    key = ["dim", "k", "u", "w", "c"]
    most = F.lit(BLOCK_BYTES) / (F.col("dim") * 8)
    sizes, _ = scratch.keep(on.groupBy(*key).agg(F.count("*").alias("rows")))
    large, _ = scratch.keep(sizes.filter(F.col("rows") > most))
    units = blocked(on, large, key, most)
    total = sizes.agg(F.sum(F.col("rows") * F.ceil(F.col("rows") / most * 2) * F.col("dim") * 8)).first()[0] or 0
    groups = max(1, int(total) // GROUP_BYTES)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        dim, k, u, w, c, node, size, side, part, p, q = (t.column(x).to_numpy() for x in ("dim", "k", "u", "w", "c", "node", "size", "side", "part", "p", "q"))
        vector = t.column("vector").combine_chunks()
        out: tuple[list, list, list] = ([], [], [])
        for at in parts([q, p, c, w, u, k, dim]):
            if len(at) > 1:
                one = at[0]
                sides = [s[at] for s, cut in ((side, u[one] != w[one]), (part, p[one] != q[one])) if cut]
                found = compared(matrix(vector.take(pa.array(at))), node[at], size[at], sides, int(k[one]) >> TABLE_BITS, bits, cosine)
                for o, f in zip(out, found, strict=True):
                    o += f
        return pa.table({x: pa.array(o, pa.int64()) for x, o in zip(("node", "n", "root"), out, strict=True)})

    rows = units.withColumn("g", F.pmod(F.xxhash64(*key, "p", "q"), F.lit(groups))).join(reps.select("node", "size", "vector"), "node")
    return rows.groupBy("g").applyInArrow(run, OUT)


def links_of(vectors: DataFrame, cosine: float = COSINE, tables: int | None = None, bits: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding)."""
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "embeddings")
    kind = vectors.schema["embedding"].dataType
    own = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{own}>").alias("embedding"))
    sound = F.expr("vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    digest = {f"d{i}": F.when(F.coalesce(sound, F.lit(False)), F.xxhash64(F.lit(i), F.col("embedding"))) for i in (1, 2)}  # 128 bits
    marked = rows.withColumns(digest)
    classes = marked.filter("d1 is not null").groupBy("d1", "d2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))
    classes, _ = scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()))
    if bits is None or tables is None:
        bits, tables = shape_of(classes.count(), cosine)
    # one vector of each class: that of its smallest id (equal rows hold equal vectors)
    same = F.expr("m.d1 = c.d1 and m.d2 = c.d2 and m.vec_id = c.rep")
    reps = marked.alias("m").join(classes.alias("c"), same).groupBy("c.node").agg(F.first("m.embedding").alias("vector"), F.first("c.size").alias("size"))
    reps, _ = scratch.keep(reps.select("node", "vector", F.size("vector").alias("dim"), "size"))
    keys, path = scratch.keep(keyed(reps.select("node", "vector", "dim"), bits, tables))
    on, _ = scratch.keep(going_on(keys, bits, scratch))
    scratch.drop(path)
    seen, _ = scratch.keep(linked(on, reps, bits, cosine, scratch))
    n = seen.filter("n > 0").groupBy("node").agg(F.sum("n").alias("linked"))
    roots, _ = scratch.keep(components(seen.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")), scratch))
    least, _ = scratch.keep(roots.join(classes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("low")))  # numbers of classes don't follow ids
    sizes = classes.join(n, "node", "left").join(roots.join(least, "root").select("node", "low"), "node", "left")
    sizes = sizes.select("d1", "d2", (F.coalesce("linked", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("low", "rep").alias("component_id"))
    out = marked.select("vec_id", "d1", "d2").join(sizes, ["d1", "d2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return links_of(table(spark, sf_dir, "embeddings"))
