"""Most similar vectors for every vector by cross-polytope hashing.

Unit vectors go through three rounds of random signs and fast Hadamard transforms; the nearest signed axis is the hash.
Axes are concatenated until buckets hold about ``BUCKET`` points (a last axis may come from fewer dimensions). In each
of ``tables`` tables a point is stored in its own bucket and a query looks into its ``probes`` nearest ones. Inside a bucket
queries are compared with points by matrix products of 8-bit copies; what is left over all tables is ranked by exact
cosines. Buckets of more than ``BLOCK`` points or queries are cut into blocks that meet pairwise in different tasks, so
a hot bucket is neither cut short nor held by one task. Every comparison keeps the best few of a query only.

Equal vectors enter the tables once: a class of copies is looked up by its smallest id and handed to all of its members,
so a vector that a third of all rows share costs no more than one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.sized import sized
from marlstone.session import materialize

K, TABLES, PROBES = 10, 3, 4
#: Share of pairs just at the least cosine that are to be found; the tables needed for it are counted on random pairs.
RECALL, TRIALS = 0.98, 2000
BUCKET, BLOCK = 96, 4096
#: For plain top-k, where neighbours may be far: one axis, and three sixteenths of its buckets in each of four tables.
WIDE = {"bits": 7, "tables": 4, "probes": 24}
#: Room for the error of 8-bit copies when a least cosine is asked for; candidates kept for each place of the result.
SLACK, SPARE = 0.02, 3


def valid(vector: Column, dim: int) -> Column:
    """Whether a vector takes part: not null, ``dim`` finite numbers, not all zero."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & finite & F.exists(x, lambda v: v != 0)


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x * np.float32(1 / math.sqrt(d))


def _axes(y: np.ndarray, bits: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the nearest signed axes of the first 2^(bits-1) dimensions, and the cost of each."""
    if bits == 1:
        first = (y[:, :1] < 0).astype(np.int64)
        return np.hstack([first, 1 - first])[:, :probes], np.hstack([np.zeros_like(y[:, :1]), 4 * y[:, :1] ** 2])[:, :probes]
    y = y[:, : 2 ** (bits - 1)]
    size = np.abs(y)
    probes = min(probes, y.shape[1])
    order = np.argsort(-size, axis=1, kind="stable")[:, :probes]
    near = np.take_along_axis(size, order, 1)
    return order * 2 + (np.take_along_axis(y, order, 1) < 0), (near[:, :1] - near) ** 2


def hash_codes(unit: np.ndarray, bits: int, tables: int, probes: int, seed: int = 7) -> list[np.ndarray]:
    """For every table the codes of the nearest buckets, nearest first."""
    n, dim = unit.shape
    d = 1 << (dim - 1).bit_length()
    padded = np.zeros((n, d), np.float32)
    padded[:, :dim] = unit
    full = d.bit_length()
    parts = [full] * (bits // full) + ([bits % full] if bits % full else [])
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(tables):
        code, cost = np.zeros((n, 1), np.int64), np.zeros((n, 1), np.float32)
        for b in parts:
            y = padded
            for _ in range(3):
                y = _hadamard(y * rng.choice(np.array([-1, 1], np.float32), d))
            c, k = _axes(y, b, probes)
            code = (code[:, :, None] * (1 << b) + c[:, None, :]).reshape(n, -1)
            cost = (cost[:, :, None] + k[:, None, :]).reshape(n, -1)
            order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            code, cost = np.take_along_axis(code, order, 1), np.take_along_axis(cost, order, 1)
        out.append(code)
    return out


def tables_for(least: float, dim: int, bits: int, probes: int) -> int:
    """Tables in which a query finds a share of ``RECALL`` of the points at a cosine of ``least``, at least ``TABLES``."""
    if least >= 1 or dim < 2:
        return TABLES
    rng = np.random.default_rng(11)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.standard_normal((2, TRIALS, dim)))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = least * a + math.sqrt(1 - least * least) * b
    asked, stored = hash_codes(a.astype(np.float32), bits, TABLES, probes), hash_codes(b.astype(np.float32), bits, TABLES, 1)
    missed = np.mean([(x != y).all(1).mean() for x, y in zip(asked, stored)])
    missed = min(max(missed, 1 / TRIALS), 1 - 1 / TRIALS)
    return max(TABLES, math.ceil(math.log(1 - RECALL) / math.log(missed)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _bytes(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _hashed(vectors: DataFrame, dim: int, bits: int, tables: int, probes: int) -> DataFrame:
    """(id, v, own, near), written once: the 8-bit copy of every vector, its own bucket in each table, and the ``probes`` - 1 next ones."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            x = _matrix(part.column(1), dim)
            x /= np.abs(x).max(1, keepdims=True)  # before squaring, so that tiny and huge numbers keep their direction
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            small = np.rint(x * (127 / np.abs(x).max(1, keepdims=True))).astype(np.int8)
            codes = [c * tables + t for t, c in enumerate(hash_codes(x.astype(np.float32), bits, tables, probes))]
            lists = []
            for rows in (np.hstack([c[:, :1] for c in codes]), np.hstack([c[:, 1:] for c in codes])):
                lists.append(pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel())))
            yield pa.RecordBatch.from_arrays([part.column(0), _bytes(small), *lists], names=["id", "v", "own", "near"])

    return materialize(vectors.select("id", "vector").mapInArrow(batches, "id long, v binary, own array<long>, near array<long>"), "hashed")


def _entries(hashed: DataFrame, role: str) -> DataFrame:
    """Bucket entries (bucket, id, role, v). Role bits: 1 stored here, 2 looking here. ``role`` is point, query or both."""
    flagged = lambda codes, flag: F.transform(codes, lambda c: F.struct(c.alias("bucket"), F.lit(flag).alias("role")))
    own = flagged("own", {"point": 1, "query": 2, "both": 3}[role])
    places = own if role == "point" else F.concat(own, flagged("near", 2))
    return hashed.select("id", "v", F.explode(places).alias("e")).select("e.bucket", "id", "e.role", "v")


def _blocks(entries: DataFrame, hot: DataFrame) -> DataFrame:
    """Entries with the blocks they meet in: (0, 0) but in hot buckets."""
    own = F.pmod(F.xxhash64("id"), F.col("pb"))
    ask = F.pmod(F.xxhash64("id", F.lit(1)), F.col("qb"))
    rows, columns = F.sequence(F.lit(0).cast("long"), F.col("pb") - 1), F.sequence(F.lit(0).cast("long"), F.col("qb") - 1)
    stored = F.transform(columns, lambda c: F.struct(own.alias("x"), c.alias("y"), F.lit(1).alias("r")))
    looking = F.transform(rows, lambda r: F.struct(r.alias("x"), ask.alias("y"), F.lit(2).alias("r")))
    none = F.slice(stored, 1, 0)
    places = F.concat(F.when(F.col("role").bitwiseAND(1) > 0, stored).otherwise(none), F.when(F.col("role").bitwiseAND(2) > 0, looking).otherwise(none))
    plain = F.array(F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.col("role").alias("r")))
    joined = entries.join(hot, "bucket", "left")
    placed = joined.withColumn("place", F.explode(F.when(F.col("pb").isNull(), plain).otherwise(places)))
    return placed.select("bucket", F.col("place.x").alias("x"), F.col("place.y").alias("y"), "id", F.col("place.r").alias("role"), "v")


def _compare(k: int, least: float | None, distinct: bool, dim: int):
    schema = pa.schema([("query", pa.int64()), ("point", pa.int64()), ("about", pa.float32())])

    def compare(group: pa.Table) -> pa.Table:
        role = group.column("role").to_numpy()
        ids = group.column("id").to_numpy()
        v = np.frombuffer(b"".join(group.column("v").to_pylist()), np.int8).reshape(-1, dim).astype(np.float32)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        has, asks = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        has = has[np.argsort(ids[has], kind="stable")]  # among equals smaller ids come first
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(asks), 1024):
            q = asks[at : at + 1024]
            if not len(has):
                break
            s = v[q] @ v[has].T
            if distinct:
                s[ids[q][:, None] == ids[has][None, :]] = -2
            floor = -1.5 if least is None else least - SLACK
            m = k * SPARE
            if len(has) > m:  # the best m of each query and what equals the last of them
                floor = np.maximum(np.partition(s, len(has) - m, axis=1)[:, len(has) - m], floor)[:, None]
            a, b = np.nonzero(s >= floor)
            order = np.lexsort((b, -s[a, b], a))
            a, b = a[order], b[order]
            first = np.searchsorted(a, np.arange(len(q)))
            kept = np.arange(len(a)) - first[a] < m
            a, b = a[kept], b[kept]
            found.append((ids[q[a]], ids[has[b]], s[a, b]))
        if not found:
            return schema.empty_table()
        return pa.table([np.concatenate(c) for c in zip(*found)], schema=schema)

    return compare


def _prepared(rows: DataFrame, dim: int) -> DataFrame:
    return rows.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).filter(valid(F.col("vector"), dim))


class Points:
    """Points hashed into tables, for one or more calls of ``nearest``. ``asking`` if they will ask too.

    Of every class of equal vectors only the smallest id is hashed. Classes go by two hashes of the vector, 96 bits together.
    Without ``bits`` and ``tables`` their numbers follow from the number of points and from ``least``.
    """

    def __init__(self, points: DataFrame, least: float | None = None, dim: int = 64, tables: int | None = None, probes: int = PROBES, bits: int | None = None, asking: bool = True):
        points = _prepared(points, dim)
        keyed = points.select("id", F.xxhash64("vector").alias("h"), F.hash("vector").alias("g"))
        several = sized(keyed.groupBy("h", "g").agg(F.min("id").alias("rep"), F.count("*").alias("n")).filter("n > 1").drop("n"), "copies")
        #: (id, rep) of the members of classes of more than one
        self.members = None if several.isEmpty() else sized(keyed.join(several, ["h", "g"]).select("id", "rep"), "members")
        if self.members is not None:
            points = points.join(self.members.filter("id <> rep").select("id"), "id", "left_anti")
        self.rows, self.count, self.dim, self.probes = points, points.count(), dim, probes
        self.bits = bits or max(1, math.ceil(math.log2(max(2.0, self.count / BUCKET))))
        self.tables = tables or (TABLES if least is None else tables_for(least, dim, self.bits, probes))
        self.codes = self.hashed(points, probes if asking else 1)

    def hashed(self, vectors: DataFrame, probes: int) -> DataFrame:
        return _hashed(vectors, self.dim, self.bits, self.tables, probes)

    def some_members(self, k: int) -> DataFrame:
        """(point, member): of a class no query needs more than the first k + 1 members, itself among them."""
        place = F.row_number().over(Window.partitionBy("rep").orderBy("id"))
        return sized(self.members.withColumn("place", place).filter(F.col("place") <= k + 1).select(F.col("rep").alias("point"), F.col("id").alias("member")), "some")


def nearest(points: DataFrame | Points, queries: DataFrame | None = None, k: int = K, least: float | None = None, dim: int = 64, **settings) -> DataFrame:
    """(query, point, cosine, rank): the ``k`` points most similar to every query, by cosine, then by smaller id.

    ``points`` and ``queries`` are (id, vector) with one row per id; without ``queries`` every point asks, and is no
    neighbour of itself. ``least`` leaves out points of a smaller cosine and with that most of the work. Vectors that
    are null, of another length, all zero or not finite take no part, on either side; equal vectors are neighbours
    with cosine 1. Other columns are ignored. An empty side gives no row. Neighbours whose bucket no probe reaches
    in any table are missed; the share is measured in the tests. Without ``tables`` their number grows with the buckets, so
    that the share found at ``least`` stays at ``RECALL``. Among vectors that differ by less than 8-bit copies show, more than
    ``SPARE`` * ``k`` near one query, some of the best may be missed; copies are not concerned. ``settings`` are those of
    ``Points``, which may be given instead of the table where several calls share it.
    """
    both = queries is None
    if isinstance(points, DataFrame):
        points = Points(points, least, dim, asking=both, **settings)
    dim = points.dim
    asking = points.rows if both else _prepared(queries, dim)
    if both:
        entries = _entries(points.codes, "both")
    else:
        entries = _entries(points.codes, "point").unionByName(_entries(points.hashed(asking, points.probes), "query"))
    groups = ["bucket"]
    if points.count > BLOCK or not both and asking.count() > BLOCK:  # fewer fill no block
        sizes = entries.groupBy("bucket").agg(F.count_if(F.col("role").bitwiseAND(1) > 0).alias("p"), F.count_if(F.col("role").bitwiseAND(2) > 0).alias("q"))
        hot = sizes.filter((F.col("p") > BLOCK) | (F.col("q") > BLOCK)).select("bucket", F.ceil(F.greatest("p", F.lit(1)) / BLOCK).alias("pb"), F.ceil(F.greatest("q", F.lit(1)) / BLOCK).alias("qb"))
        hot = sized(hot, "hot")
        if not hot.isEmpty():
            entries, groups = _blocks(entries, hot), ["bucket", "x", "y"]
    pairs = entries.groupBy(*groups).applyInArrow(_compare(k, least, both, dim), "query long, point long, about float")
    pairs = pairs.groupBy("query", "point").agg(F.max("about").alias("about"))
    pairs = pairs.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("about"), "point"))).filter(F.col("r") <= k * SPARE).drop("r")
    pairs = materialize(pairs.drop("about"), "neighbours")

    @F.arrow_udf("double")
    def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
        if not len(a):
            return pa.array([], pa.float64())
        x, y = _matrix(a, dim), _matrix(b, dim)
        x /= np.abs(x).max(1, keepdims=True)
        y /= np.abs(y).max(1, keepdims=True)
        return pa.array(np.einsum("ij,ij->i", x, y) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1))

    used = sized(pairs.select(F.col("point").alias("id")).union(pairs.select("query")).distinct(), "used")
    p = points.rows.join(used, "id", "left_semi").select(F.col("id").alias("point"), F.col("vector").cast("array<float>").alias("pv"))
    q = asking.join(used, "id", "left_semi").select(F.col("id").alias("query"), F.col("vector").cast("array<float>").alias("qv"))
    ranked = pairs.join(p, "point").join(q, "query").select("query", "point", cosine("qv", "pv").alias("cosine"))
    if least is not None:
        ranked = ranked.filter(F.col("cosine") >= least)
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), "point")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    if points.members is None:
        return ranked
    some = points.some_members(k)
    found = ranked.join(some, "point", "left").select("query", F.coalesce("member", "point").alias("point"), "cosine")
    if both:  # a class asks once; every member gets the answer and its fellows
        fellows = some.select(F.col("point").alias("query"), F.col("member").alias("point"), F.lit(1.0).alias("cosine"))
        found = found.unionByName(fellows).join(points.members.select(F.col("rep").alias("query"), F.col("id").alias("own")), "query", "left")
        found = found.select(F.coalesce("own", "query").alias("query"), "point", "cosine").filter("query <> point")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
