"""Small reusable plan fragments."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Salt buckets for per-group top-k: each group is split over this many tasks first.
TOPK_SALT = 64


def top_k_per_group(
    df: DataFrame, group: list[str], order: list[Column], k: int, tie_cols: list[str], salt: int = TOPK_SALT
) -> DataFrame:
    """Exact top ``k`` rows per group without sorting a whole (possibly huge) group in one
    task: rank inside (group, hash bucket) first, keep <= k per bucket, then rank the
    survivors (<= salt * k rows per group). Adds an int ``rank`` column (1 = best)."""
    bucket = F.pmod(F.xxhash64(*[F.col(c) for c in tie_cols]), F.lit(salt))
    staged = df.withColumn("_bucket", bucket)
    w1 = Window.partitionBy(*group, "_bucket").orderBy(*order)
    staged = staged.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k)
    w2 = Window.partitionBy(*group).orderBy(*order) if group else Window.orderBy(*order)
    out = staged.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k)
    return out.drop("_bucket", "_r1")


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most ``max_rows`` rows (counted first, so hand
    in what is cheap to count: a checkpointed or written frame of narrow rows); else unchanged."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


# Hash-order ranks are computed through this many buckets per group (high hash bits).
RANK_BUCKET_BITS = 16


def hash_rank(df: DataFrame, group: list[str], key: str, seed: int, h: Column | None = None) -> DataFrame:
    """Exact 1-based rank of each row inside its group by (seeded hash of ``key``, key),
    plus the group size, without sorting a whole group in one task. ``h`` replaces the
    hash: any evenly spread signed 64-bit column.

    The hash's high bits split every group into 2**16 ordered buckets; a bucket's
    offset is the number of rows in the group's earlier buckets (a running sum over at
    most 2**16 small rows per group); a row's rank is offset + its rank inside its
    bucket, where each bucket holds ~1/65536 of the group."""
    h = F.xxhash64(F.col(key), F.lit(seed)) if h is None else h
    bucket = F.shiftright(h, 64 - RANK_BUCKET_BITS) + F.lit(1 << (RANK_BUCKET_BITS - 1))
    rows = df.withColumn("_h", h).withColumn("_bkt", bucket)
    sizes = rows.groupBy(*group, "_bkt").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*group).orderBy("_bkt")
    sizes = sizes.select(
        *group,
        "_bkt",
        (F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_offset"),
        F.sum("_c").over(Window.partitionBy(*group)).alias("_n"),
    )
    inner = Window.partitionBy(*group, "_bkt").orderBy("_h", key)
    rows = rows.withColumn("_r", F.row_number().over(inner))
    out = rows.join(sizes, [*group, "_bkt"])
    return out.withColumn("_rank", F.col("_offset") + F.col("_r")).drop("_h", "_bkt", "_r", "_offset")


def rank_pieces(df: DataFrame, group: list[str], key: str, h: Column, piece: Callable[[Column, Column], Column]) -> DataFrame:
    """``df`` with an int ``_piece``: ``piece(rank, size)`` of ``hash_rank`` by (``h``, key), a whole number that
    never falls as the rank rises (few values a group).

    Only groups and keys are ranked and shuffled. The last (h, key) of each piece, a few for a group, tell every
    row its piece where it stands, so ``df`` may hold whole texts. Rows of one key that fall into two pieces
    are the exception: they alone are numbered, in an order that depends on their content."""
    rows = df.withColumn("_o", h)
    at = F.struct(F.col("_o"), F.col(key).alias("_k"))
    keys = rows.select(*(F.col(g) for g in group), F.col(key).alias("_k"), "_o")
    ranked = hash_rank(keys, group, "_k", 0, F.col("_o")).withColumn("_piece", piece(F.col("_rank"), F.col("_n")).cast("int"))
    ends = ranked.groupBy(*group, "_piece").agg(
        F.min(F.struct("_o", "_k")).alias("_from"), F.max(F.struct("_o", "_k")).alias("_to")
    ).checkpoint()  # a row for each piece of a group
    edges = ends.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_piece", "_to"))).alias("_ends")).checkpoint()
    placed = rows.join(F.broadcast(edges), group)
    placed = placed.withColumn("_piece", F.get(F.filter("_ends", lambda e: at <= e["_to"]), F.lit(0))["_piece"])
    columns = [*df.columns, "_piece"]
    again = [f"_g{i}" for i in range(len(group))]
    later = ends.select(*group, F.col("_from").alias("_at"), F.col("_piece").alias("_later"))
    shared = ends.withColumn("_at", F.col("_to")).join(later, [*group, "_at"]).filter("_piece < _later")
    shared = shared.select(*(F.col(g).alias(a) for g, a in zip(group, again)), F.col("_at._o").alias("_o2"), F.col("_at._k").alias("_k2")).distinct().checkpoint()
    if shared.isEmpty():
        return placed.select(*columns)

    def same(k: str) -> Column:
        return reduce(and_, (F.col(g) == F.col(a) for g, a in zip(group, again)), (F.col("_o") == F.col("_o2")) & F.col(k).eqNullSafe(F.col("_k2")))

    shared = ranked.join(F.broadcast(shared), same("_k")).groupBy(*again, "_o2", "_k2").agg((F.min("_rank") - 1).alias("_before"), F.max("_n").alias("_n"))
    told = placed.join(F.broadcast(shared.checkpoint()), same(key), "left")
    w = Window.partitionBy(*group, "_o", key).orderBy(F.xxhash64(*(F.col(c) for c in df.columns)))
    tied = told.filter("_before IS NOT NULL").withColumn("_r", F.col("_before") + F.row_number().over(w))
    tied = tied.withColumn("_piece", piece(F.col("_r"), F.col("_n")).cast("int"))
    return told.filter("_before IS NULL").select(*columns).unionByName(tied.select(*columns))


def ntile_of_rank(rank, n, k: int):
    """Bucket 1..k of a 1-based rank among n rows, with the same sizes as SQL ntile(k)."""
    q = F.floor(n / k)
    rem = n % k
    big = rem * (q + 1)
    return F.when(rank <= big, F.floor((rank - 1) / (q + 1)) + 1).otherwise(
        rem + F.floor((rank - big - 1) / q) + 1
    ).cast("int")
