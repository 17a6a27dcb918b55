"""Operator 8: near-duplicate vectors by cross-polytope hashing.

Equal vectors are one row with a weight from the start, so a group of copies of any size
costs one row. Each distinct vector is rotated by three rounds of random signs and a fast
Hadamard transform; the hash is the signed axis it then lies closest to, ``K`` of these make
the bucket of a table. Besides its own bucket a vector probes the ``PROBES`` next best ones.
``K`` grows with the logarithm of the number of vectors (buckets stay small), and the number
of tables is set so that a pair exactly at the threshold is met with probability ``RECALL``
(measured on simulated pairs of that dimension).

A bucket is compared in cells of at most about ``BLOCK`` x ``BLOCK`` vectors, spread over tasks, so
a crowded bucket is split and no row or pair of it is dropped. A cell verifies all of its pairs by
cosine in double precision and returns sums of links and a spanning forest, not pairs. A pair that meets in several buckets
counts in the first one only: both vectors carry all their buckets, so each cell can tell.

Defined cases: a vector that is null, empty, zero or holds null, NaN or infinite components
links with nothing, is its own component and kept; vectors of different lengths never link; a null vec_id
links with nothing and has a null component and kept = true; a repeated vec_id counts
as a further vector; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.llm.common import connected_components, ship, staged

THRESHOLD = 0.9
RECALL = 0.99
PROBES = 4
BLOCK = 2048
BUCKET = 24
SEED = 20240229


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (length a power of two), orthonormal."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h) if x.ndim == 2 else x
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


class Hasher:
    """Buckets of vectors of one dimension: ``tables`` tables of ``k`` hashes each."""

    def __init__(self, dim: int, k: int, tables: int):
        self.dim, self.k, self.tables = dim, k, tables
        self.width = 1 << max(1, math.ceil(math.log2(max(dim, 2))))
        self.signs = np.random.default_rng([SEED, dim]).choice([-1.0, 1.0], size=(tables, k, 3, self.width))

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(n, tables, 1 + PROBES) bucket numbers; the own bucket is first."""
        n = len(x)
        padded = np.zeros((n, self.width))
        padded[:, : self.dim] = x
        out = np.empty((n, self.tables, 1 + PROBES), dtype=np.int64)
        top = min(3, self.width)
        rows = np.arange(n)[:, None]
        for t in range(self.tables):
            axes = np.empty((n, self.k, top), dtype=np.int64)
            loss = np.empty((n, self.k, top))
            for j in range(self.k):
                y = padded
                for r in range(3):
                    y = hadamard(y * self.signs[t, j, r])
                size = np.abs(y)
                best = np.argsort(-size, axis=1, kind="stable")[:, :top]
                axes[:, j] = 2 * best + (y[rows, best] < 0)
                loss[:, j] = size[rows, best[:, :1]] - size[rows, best]
            # Candidates: the own bucket, one or two hashes moved to a next best axis.
            moves = [()] + [((j, a),) for j in range(self.k) for a in range(1, top)]
            moves += [((i, 1), (j, 1)) for i in range(self.k) for j in range(i)]
            cost = np.stack([sum((loss[:, j, a] for j, a in m), np.zeros(n)) for m in moves], axis=1)
            order = np.argsort(cost[:, 1:], axis=1, kind="stable")[:, :PROBES] + 1
            bucket = np.empty((n, len(moves)), dtype=np.int64)
            for i, m in enumerate(moves):
                code = np.zeros(n, dtype=np.int64)
                for j in range(self.k):
                    code = code * (2 * self.width) + axes[:, j, dict(m).get(j, 0)]
                bucket[:, i] = code
            out[:, t, 0] = bucket[:, 0]
            out[:, t, 1:] = bucket[rows, order] if order.shape[1] == PROBES else np.pad(
                bucket[rows, order], ((0, 0), (0, PROBES - order.shape[1])), constant_values=-1)
        return out


def met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(pairs, tables): whether two vectors with these codes share a bucket that is the own one of either."""
    own_a, own_b = a[:, :, :1], b[:, :, :1]
    return (a == own_b).any(axis=2) | (b == own_a).any(axis=2)


def plan(n: int, dim: int, threshold: float) -> tuple[int, int]:
    """(hashes a table, tables) for n vectors."""
    width = 1 << max(1, math.ceil(math.log2(max(dim, 2))))
    k = max(1, math.ceil(math.log(max(2.0, n * (1 + PROBES) / BUCKET)) / math.log(2 * width)))
    rng = np.random.default_rng([SEED, dim, 1])
    x, z = rng.standard_normal((2, 500, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    y = threshold * x + math.sqrt(1 - threshold**2) * z
    h = Hasher(dim, k, 4)
    p = float(met(h.codes(x), h.codes(y)).mean())
    return k, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - min(max(p, 1e-3), 0.999999))))


def _cells(batches, tables):
    """Rows of consecutive equal (t, b, i, j), gathered across batches as numpy columns."""
    held = None
    for batch in batches:
        part = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        keys = np.stack([part[c].to_numpy() for c in ("t", "b", "i", "j")], axis=1)
        cols = [keys, part["block"].to_numpy(), part["rid"].to_numpy(), part["weight"].to_numpy(),
                np.array([np.frombuffer(v, "<f8") for v in part["vec"].to_pylist()] + [None], dtype=object)[:-1],
                np.array([np.frombuffer(v, "<i8").reshape(tables, -1) for v in part["codes"].to_pylist()] + [None], dtype=object)[:-1]]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            keys = cols[0]
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        starts = np.concatenate([[0], cuts])
        for a, e in zip(starts[:-1], starts[1:]):
            if e - a > 1:
                yield keys[a], [c[a:e] for c in cols[1:]]
        held = [c[starts[-1]:] for c in cols]
    if held is not None and len(held[0]) > 1:
        yield held[0][0], held[1:]


def _compare(key, cols, threshold):
    """Degrees and a spanning forest of the verified pairs that belong to this cell."""
    t, bucket, i, j = (int(v) for v in key)
    block, rid, weight, vec, codes = cols
    x, c = np.stack(vec), np.stack(codes)
    own = c[:, t, 0] == bucket
    parent = list(range(len(rid)))

    def root(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    degree = np.zeros(len(rid), dtype=np.int64)
    forest = []
    for a in range(0, len(rid), 512):
        close = x[a : a + 512] @ x.T >= threshold
        left, right = np.nonzero(close)
        left += a
        keep = (left < right) & (own[left] | own[right])
        if i != j:
            keep &= block[left] != block[right]
        left, right = left[keep], right[keep]
        if not len(left):
            continue
        p, q = c[left], c[right]
        seen = met(p, q)
        keep = ~seen[:, :t].any(axis=1)
        # Within the table: the smaller of the buckets in which the two meet.
        mine, theirs = p[:, t, 0], q[:, t, 0]
        far = np.iinfo(np.int64).max
        first = np.minimum(np.where((q[:, t] == mine[:, None]).any(axis=1), mine, far),
                           np.where((p[:, t] == theirs[:, None]).any(axis=1), theirs, far))
        keep &= first == bucket
        left, right = left[keep], right[keep]
        np.add.at(degree, left, weight[right])
        np.add.at(degree, right, weight[left])
        for u, v in zip(left.tolist(), right.tolist()):
            ru, rv = root(u), root(v)
            if ru != rv:
                parent[ru] = rv
                forest.append((int(rid[u]), int(rid[v])))
    linked = np.flatnonzero(degree)
    return [(int(rid[u]), None, int(degree[u])) for u in linked] + [(u, v, 0) for u, v in forest]


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, vec (unit vector as bytes, null if it links with nothing), dim."""
    def run(batches):
        for batch in batches:
            out, dims = [], []
            for v in batch.column(1).to_pylist():
                x = np.array([np.nan if e is None else e for e in v or []], dtype="<f8")
                largest = np.abs(x).max() if len(x) else 0.0
                if len(x) and np.isfinite(largest) and largest > 0:
                    x = x / largest
                    out.append((x / math.sqrt(float(x @ x))).astype("<f8").tobytes())
                else:
                    out.append(None)
                dims.append(len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(dims, pa.int32())], names=["vec_id", "vec", "dim"])

    return vectors.selectExpr("cast(vec_id as long) vec_id", "cast(embedding as array<double>) embedding").mapInArrow(
        run, "vec_id long, vec binary, dim int")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors(vec_id, embedding)``."""
    spark = vectors.sparkSession
    ship(spark)
    rows = staged(unit_vectors(vectors).withColumn("key", F.when(F.col("vec_id").isNotNull(), F.md5("vec"))), "vectors")
    distinct = rows.where("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("low"), F.count("*").alias("weight"), F.first("vec").alias("vec"), F.first("dim").alias("dim"))
    # Each distinct vector has a number of its own (a vec_id may stand for several), in the order of its smallest vec_id.
    distinct = staged(distinct.repartitionByRange("low", "key").sortWithinPartitions("low", "key")
                      .withColumn("rid", F.monotonically_increasing_id()), "vectors-distinct")
    shape = distinct.groupBy("dim").agg(F.count("*").alias("n")).collect()  # one row per vector length
    plans = {r["dim"]: plan(r["n"], r["dim"], threshold) for r in shape if r["n"] > 1}
    found = None
    for dim, (k, tables) in sorted(plans.items()):
        part = _links(distinct.where(F.col("dim") == dim), dim, k, tables, threshold)
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "a long, b long, links long")
    found = staged(found, "vectors-links")
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("b is not null").select("a", "b"), "vectors-cc")
    lowest = components.join(distinct.select(F.col("rid").alias("component"), F.col("low").alias("least")), "component").select("node", "least")
    reps = (distinct.select("key", "rid", "low", "weight").join(links, F.col("rid") == F.col("a"), "left")
            .join(lowest, F.col("rid") == F.col("node"), "left")
            .select("key", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("__links"), F.coalesce("least", "low").alias("__component")))
    out = rows.select("vec_id", "key").join(reps, "key", "left")
    component = F.coalesce("__component", "vec_id")
    return out.select("vec_id", F.coalesce("__links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _links(distinct: DataFrame, dim: int, k: int, tables: int, threshold: float) -> DataFrame:
    """a, b, links: sums of links (b null) and forest edges of distinct vectors."""
    def hashed(batches):
        h = Hasher(dim, k, tables)
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<f8").reshape(-1, dim)
            codes = np.concatenate([h.codes(x[a : a + 1024]) for a in range(0, len(x), 1024)]) if len(x) else np.empty((0, tables, 1 + PROBES), np.int64)
            flat = pa.array(codes.reshape(-1))
            size = tables * (1 + PROBES)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * size, pa.int32()), flat)],
                names=["rid", "weight", "vec", "codes", "buckets"])

    base = staged(distinct.select("rid", "weight", "vec").mapInArrow(
        hashed, "rid long, weight long, vec binary, codes binary, buckets array<long>"), "vectors-codes")
    rows = (base.select("rid", F.posexplode("buckets").alias("at", "b")).where("b >= 0")
            .select("rid", F.expr(f"cast(at div {1 + PROBES} as long) t"), "b", (F.col("at") % (1 + PROBES) == 0).alias("own")))
    sizes = rows.groupBy("t", "b").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("long")).alias("owners")).where("n > 1 and owners > 0")
    cells = (rows.join(sizes, ["t", "b"]).withColumn("g", F.expr(f"cast(ceil(n / {BLOCK}) as long)"))
             .withColumn("block", F.expr("pmod(xxhash64(rid, 3), g)")).withColumn("other", F.expr("explode(sequence(0L, g - 1))"))
             .select("rid", "t", "b", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
    keyed = cells.join(base.select("rid", "weight", "vec", "codes"), "rid").select("t", "b", "i", "j", "block", "rid", "weight", "vec", "codes")

    def compare(batches):
        out = []
        for key, cols in _cells(batches, tables):
            out += _compare(key, cols, threshold)
            if len(out) > 20_000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    order = ["t", "b", "i", "j"]
    return keyed.repartition(*order).sortWithinPartitions(*order).mapInArrow(compare, "a long, b long, links long")


def _rows(out):
    a, b, links = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64())], names=["a", "b", "links"])
