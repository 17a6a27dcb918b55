"""Operator 11: Merkle manifest of a dataset, with a proof for every row.

A row is a leaf. The leaves of a source ascend by doc_id and are joined sixteen at a time, level
by level, to the source's subroot; the subroots, ordered by source, are joined likewise to the
root. Every node is labelled by the interval of leaf ranks ``[lo, hi)`` that it covers:

1. *Ranks.* The leaves (digests and keys, no texts) are range-partitioned by (source, doc_id), so
   a hot source is spread over many tasks; a leaf's rank is its place in its partition plus the
   rows of the partitions before it. It is joined on by (partition, source), so no key holds more
   than a partition.
2. *Levels.* The runs of a level are grouped into nodes; a node that covers its whole source is the
   subroot. Each level has a sixteenth of the rows of the one below it.
3. *Ancestors.* From the top down, a level's nodes meet the nodes of the level above by a
   containment join: intervals of level ``k`` are at most ``16^k`` ranks long, so a parent lies in at
   most two buckets of that width and a child's ``lo`` in one; equal buckets are joined and the
   containment of the intervals decides. A node hands its own path down, so no join has more
   than sixteen rows a key, whatever the size of the source.
4. *Siblings.* Within the parent's interval, the children's intervals other than the one that holds
   the rank are the siblings: those below it go to its left in the hash, those above to its right.
5. *Verification.* The root is folded anew from the leaf, or from the tampered leaf, and these
   siblings, and compared with the root.

Defined cases: a null column is ``-`` in the leaf; a null source is a source of its own, the first;
rows with one doc_id are ordered by their leaf (rows equal in all five columns are interchangeable),
null doc_id first; a source with one row has its leaf as subroot, and a single source's subroot is
the root; without any sibling the proof is the hash of the empty string; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicflow.llm.common import staged

FANOUT = 16
TAMPER = 5
PLACE_BITS = 33  # of monotonically_increasing_id, below the partition
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PATH = "array<struct<left:string,right:string>>"


def framed(value: Column) -> Column:
    """``-`` for null, else byte count, ``:``, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def _ranked(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """``rows(tree, ...)`` with ``lo``, their place in ``order`` over the whole table, and the bounds
    ``[first, last)`` of their tree; and the length of the longest tree."""
    placed = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("place", F.monotonically_increasing_id()), name)
    part, place = F.shiftright("place", PLACE_BITS).alias("part"), F.col("place").bitwiseAND((1 << PLACE_BITS) - 1)
    spans = placed.groupBy(part, F.col("tree").alias("of")).agg(F.count("*").alias("n"), F.min(place).alias("at"))
    before = (spans.groupBy("part").agg(F.sum("n").alias("rows"))  # a row a partition
              .select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before")))
    spans = spans.join(before, "part")
    trees = spans.groupBy(F.col("of").alias("tree")).agg(F.min(F.col("before") + F.col("at")).alias("first"), F.sum("n").alias("size"))
    spans = staged(spans.join(trees, F.col("of").eqNullSafe(F.col("tree")))
                   .select("part", "of", "before", "first", (F.col("first") + F.col("size")).alias("last")), f"{name}-spans")
    ranked = (placed.withColumn("in", part).join(spans, F.col("in").eqNullSafe(F.col("part")) & F.col("tree").eqNullSafe(F.col("of")))
              .withColumn("lo", F.col("before") + place).drop("in", "part", "of", "before", "place"))
    return ranked, spans.agg(F.max(F.col("last") - F.col("first"))).first()[0] or 0


def _levels(leaves: DataFrame, longest: int, name: str) -> list[DataFrame]:
    """Level 1 and above over ``leaves(tree, first, last, lo, hash, doc)``, each level staged:
    (tree, first, last, lo, hi, hash, runs), ``runs`` being the children in order. A tree of
    one leaf has one node that takes over its hash."""
    out, below, width, child = [], leaves.withColumn("hi", F.col("lo") + 1), 1, ["lo", "hi", "hash", "doc"]
    while not out or width < longest:
        width *= FANOUT
        below = staged(
            below.groupBy("tree", "first", "last", F.expr(f"(lo - first) div {width}").alias("run"))
            .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sort_array(F.collect_list(F.struct(*child))).alias("runs"))
            .withColumn("hash", F.when(F.col("last") - F.col("first") == 1, F.col("runs")[0]["hash"])
                        .otherwise(digest(F.concat_ws("", F.col("runs")["hash"])))).drop("run"), f"{name}-{len(out) + 1}")
        out.append(below)
        below, child = below.where(~_is_root()), ["lo", "hi", "hash"]
    return out


def _is_root() -> Column:
    """A node over all of its tree."""
    return (F.col("lo") == F.col("first")) & (F.col("hi") == F.col("last"))


def siblings(runs: Column, lo: Column) -> Column:
    """The interval difference: children other than the one at ``lo``, as hashes (left, right)."""
    def joined(part):
        return F.concat_ws("", F.transform(F.filter(runs, part), lambda c: c["hash"]))

    return F.struct(joined(lambda c: c["hi"] <= lo).alias("left"), joined(lambda c: c["lo"] > lo).alias("right"))


def _attach(below: DataFrame, above: DataFrame, width: int, given: list[str]) -> DataFrame:
    """Level-bucketed containment join: each node of ``below`` with the node of ``above`` that covers
    it (intervals of at most ``width`` ranks), the path from there to the top and the ``given`` columns."""
    upper = above.select(
        *given, F.col("lo").alias("above_lo"), F.col("hi").alias("above_hi"), F.col("runs").alias("above_runs"), F.col("path").alias("above_path"),
        F.explode(F.expr(f"array_distinct(array(lo div {width}, (hi - 1) div {width}))")).alias("bucket"))
    return (below.withColumn("bucket", F.expr(f"lo div {width}")).join(upper, "bucket").where("above_lo <= lo AND hi <= above_hi")
            .withColumn("path", F.concat(F.array(siblings(F.col("above_runs"), F.col("lo"))), F.col("above_path")))
            .drop("bucket", "above_lo", "above_hi", "above_runs", "above_path"))


def _paths(levels: list[DataFrame], ends: DataFrame | None = None) -> DataFrame:
    """Level 1 with ``path``, the siblings on the way to the end, and the root of its tree, ``subroot``.

    ``ends(of, root, path)`` is the way on from the root of each tree; without it, ways end there."""
    above, given = None, ["subroot"] if ends is None else ["subroot", "root"]
    for k in range(len(levels), 0, -1):
        own = levels[k - 1]
        level = own.where(_is_root()).withColumn("subroot", F.col("hash"))
        if ends is None:
            level = level.withColumn("path", F.expr(f"cast(array() as {PATH})"))
        else:
            level = level.join(ends, F.col("tree").eqNullSafe(F.col("of"))).drop("of")
        if above is not None:
            level = level.unionByName(_attach(own.where(~_is_root()), above, FANOUT ** (k + 1), given))
        above = level
    return above


def _unfolded(nodes: DataFrame, *columns) -> DataFrame:
    """A row per leaf of level 1, ``one``: its ``path`` from the lowest level up, and the columns."""
    rows = nodes.select("*", F.explode("runs").alias("one"))
    alone = F.col("last") - F.col("first") == 1
    return rows.select(*columns, F.when(alone, F.col("path")).otherwise(
        F.concat(F.array(siblings(F.col("runs"), F.col("one.lo"))), F.col("path"))).alias("path"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way up give."""
    return F.aggregate(path, leaf, lambda h, step: digest(F.concat(step["left"], h, step["right"])))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified (module docstring); and
    n_siblings, the hashes in the proof."""
    text = F.col("text").cast("string")
    altered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % TAMPER == 0, F.lit(False))
    head = F.concat(*(framed(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")))
    leaves = staged(docs.select(
        "doc_id", F.col("source").cast("string").alias("tree"), digest(F.concat(head, framed(text))).alias("hash"),
        F.when(altered, digest(F.concat(head, framed(F.translate(text, LETTERS, LETTERS.lower()))))).alias("tampered")), "manifest-leaves")
    ranked, longest = _ranked(leaves, ["tree", "doc_id", "hash"], "manifest-ranked")
    levels = _levels(ranked.withColumn("doc", F.struct("doc_id", "tampered")).drop("doc_id", "tampered"), longest, "manifest-level")

    subroots = reduce(DataFrame.union, (level.where(_is_root()).select("tree", "hash") for level in levels))
    sources, n = _ranked(subroots.select(F.lit(0).alias("tree"), F.struct("tree").alias("doc"), "hash"), ["doc"], "manifest-subroots")
    top = _paths(_levels(sources, n, "manifest-top"))
    ends = staged(_unfolded(top, F.col("subroot").alias("root"), F.col("one.doc.tree").alias("of")), "manifest-ends")

    rows = _unfolded(_paths(levels, ends), "subroot", "root", F.col("one.hash").alias("leaf"), "one.doc.doc_id", "one.doc.tampered")
    proof = F.concat_ws("", F.transform("path", lambda s: F.concat(s["left"], s["right"])))
    return (rows.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
            .select("doc_id", "leaf", "subroot", "root", digest(proof).alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified"), (F.length(proof) / 64).cast("int").alias("n_siblings")))


def _sql_forest(name: str, leaves: str, levels: int) -> str:
    """CTEs: nodes and siblings of every level over ``leaves(tree, r, n, hash)``, one level a CTE."""
    out = [f"{name}_0 AS (SELECT tree, r AS i, n, hash FROM {leaves})"]
    for k in range(levels):
        width = FANOUT ** k
        out.append(f"""{name}_{k + 1} AS (
  SELECT tree, i // {FANOUT} AS i, n, CASE WHEN n <= {width} THEN min(hash) ELSE sha256(string_agg(hash, '' ORDER BY i)) END AS hash
  FROM {name}_{k} GROUP BY tree, i // {FANOUT}, n)""")
        out.append(f"""{name}_s{k} AS (
  SELECT a.tree, a.i, coalesce(string_agg(b.hash, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l,
         coalesce(string_agg(b.hash, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r
  FROM {name}_{k} a JOIN {name}_{k} b ON a.tree = b.tree AND a.i // {FANOUT} = b.i // {FANOUT} GROUP BY a.tree, a.i)""")
    return ",\n".join(out)


def _sql_walk(name: str, source: str, levels: int, start: str) -> str:
    """CTEs that carry each row of ``source(tree, r, n, proof, h)`` up the levels of a forest."""
    out = []
    for k in range(levels):
        to = f"{name}_w{k}"
        out.append(f"""{to} AS (
  SELECT w.* REPLACE (CASE WHEN n <= {FANOUT ** k} THEN proof ELSE proof || l || s.r END AS proof,
                      CASE WHEN n <= {FANOUT ** k} THEN h ELSE sha256(l || h || s.r) END AS h)
  FROM {source} w JOIN {name}_s{k} s ON w.tree = s.tree AND w.r // {FANOUT ** k} = s.i)""")
        source = to
    return ",\n".join(out)


def _sql_framed(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


SQL_LEVELS = 6  # up to 16^6 rows a source, and sources
_HEAD = " || ".join(_sql_framed(c) for c in ("doc_id", "source", "lang", "n_chars"))
_CRC_STEP = "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
#: The manifest level by level, without intervals; crc32 from its polynomial.
SQL = f"""
WITH crc AS (SELECT list(list_reduce(range(8), {_CRC_STEP}, b) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b)),
docs AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS tree, sha256({_HEAD} || {_sql_framed('text')}) AS leaf,
         sha256({_HEAD} || {_sql_framed(f"translate(text, '{LETTERS}', '{LETTERS.lower()}')")}) AS other,
         xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
             lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) AS crc
  FROM documents, crc),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY tree) AS n, leaf AS hash
  FROM docs),
{_sql_forest("a", "leaves", SQL_LEVELS)},
sources AS (SELECT 0 AS tree, tree AS of, row_number() OVER (ORDER BY tree) - 1 AS r, count(*) OVER () AS n, hash FROM a_{SQL_LEVELS}),
{_sql_forest("b", "sources", SQL_LEVELS)},
start AS (SELECT doc_id, leaf, tree, r, n, '' AS proof, CASE WHEN crc % {TAMPER} = 0 THEN other ELSE leaf END AS h FROM leaves),
{_sql_walk("a", "start", SQL_LEVELS, "h")},
middle AS (
  SELECT w.doc_id, w.leaf, s.hash AS subroot, s.tree, s.r, s.n, w.proof, w.h FROM a_w{SQL_LEVELS - 1} w JOIN sources s ON w.tree = s.of),
{_sql_walk("b", "middle", SQL_LEVELS, "h")}
SELECT doc_id, leaf, subroot, root.hash AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = root.hash AS verified,
       CAST(length(proof) / 64 AS INTEGER) AS n_siblings
FROM b_w{SQL_LEVELS - 1}, b_{SQL_LEVELS} root
"""
