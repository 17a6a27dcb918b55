"""Operator 13: how five document filters interact, in every order.

Each document fails some of the filters A to E: a mask of five bits. The corpus is reduced to
one row per part with a count in each of the 32 mask cells, in three tallies (documents, good
ones, toxic ones). A subset of filters lets a cell through if it shares no bit with the mask.
The 32 subsets are walked in Gray-code order, so that each step toggles one filter: the cells
that fail it move their counter of active failures by one, and a cell that leaves or reaches
zero leaves or joins the running survivors. The 32 survivor counts are stored; what a filter
removes at a step of an order is the difference of the two states around it, so none of the 120
orders is run over documents, nor over cells.

Filters (words: maximal runs other than ASCII white space, case-sensitive): A under 50 words; B
distinct words under 65 % of the words; C more than 5 % of the code points in A-Z; D holds one of
``#$%&*|``; E has the text of a smaller doc_id, anywhere in the table.

E needs no join on the text: documents with one text share the bits A to D, so they are counted by
(sha-256 of the text, part, labels) with the smallest doc_id of each count, and only these counts
meet per text. A text that a third of the rows hold is summed before it is shuffled.

Defined cases: null text is the empty text (fails A alone, and E if a smaller doc_id is empty or
null); null source is the part ''; a row counts as a document, repeated rows too (they do not fail
E by each other); a null doc_id fails no E, makes none fail and has no label; with several label
rows for a doc_id, one with a 1 suffices; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.llm.common import ship

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
MIN_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 50, 65, 5
ROWS = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
        "good_lost long, toxic_lost long, shapley long")


def failures(text):
    """The bits A to D that a text column fails, as one integer column of a frame with ``words``."""
    words, size = F.size("words"), F.length(text)
    capitals = size - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    bits = (words < MIN_WORDS,
            F.lit(100) * F.size(F.array_distinct("words")) < DISTINCT_PERCENT * words,
            F.lit(100) * capitals.cast("long") > CAPITALS_PERCENT * size,
            text.rlike("[#$%&*|]"))
    return sum(((bit.cast("int") * (1 << k)) for k, bit in enumerate(bits)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters they fail."""
    text = F.col("text")
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
            .withColumn("words", F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), ""))
            .select("doc_id", "part", F.unhex(F.sha2(F.encode(text, "utf-8"), 256)).alias("digest"), failures(text).alias("mask")))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    key = ["digest", "part", "mask", "good", "toxic"]
    marked = (rows.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
              .groupBy("doc_id", *key).agg(F.count("*").alias("n")))
    texts = marked.groupBy(*key).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"))
    lowest = texts.groupBy("digest").agg(F.min("first.doc_id").alias("lowest"))
    own = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("lowest"), F.col("first.n")).otherwise(0)
    later = 1 << FILTERS.index("E")
    return (texts.join(lowest, "digest").withColumn("own", own)
            .select("part", "good", "toxic", F.explode(F.array(
                F.struct("mask", F.col("own").alias("n")),
                F.struct((F.col("mask") + later).alias("mask"), (F.col("n") - F.col("own")).alias("n")))).alias("cell"))
            .groupBy("part", F.col("cell.mask").alias("mask"))
            .agg(F.sum("cell.n").alias("n"), F.sum(F.col("cell.n") * F.col("good")).alias("good"),
                 F.sum(F.col("cell.n") * F.col("toxic")).alias("toxic"))
            .where("n > 0"))


def gray_walk(counts: np.ndarray) -> np.ndarray:
    """``counts[..., 32]`` by mask -> survivors ``[..., 32]`` by subset of active filters."""
    masks = np.arange(CELLS)
    failing = np.zeros(CELLS, dtype=np.int64)  # active filters that each cell fails
    running = counts.sum(axis=-1)
    states = np.empty_like(counts)
    active = 0
    states[..., active] = running
    for step in range(1, CELLS):
        bit = step & -step  # the filter that the Gray code toggles here
        hit = masks & bit != 0
        if active & bit:
            failing[hit] -= 1
            running = running + counts[..., hit & (failing == 0)].sum(axis=-1)
        else:
            running = running - counts[..., hit & (failing == 0)].sum(axis=-1)
            failing[hit] += 1
        active ^= bit
        states[..., active] = running
    return states


def _orders(kept: np.ndarray, good: np.ndarray, toxic: np.ndarray):
    """(order, step, columns) of one part from its three arrays of 32 states."""
    everything = CELLS - 1
    bits = [1 << k for k in range(len(FILTERS))]
    fails = [int(kept[0] - kept[b]) for b in bits]
    unique = [int(kept[everything ^ b] - kept[everything]) for b in bits]
    orders = [[FILTERS.index(f) for f in order] for order in permutations(FILTERS)]
    shapley = [0] * len(FILTERS)
    for order in orders:
        active = 0
        for k in order:
            shapley[k] += int(kept[active] - kept[active | bits[k]])
            active |= bits[k]
    for order in orders:
        active, name = 0, "".join(FILTERS[k] for k in order)
        for step, k in enumerate(order, 1):
            after = active | bits[k]
            removed = int(kept[active] - kept[after])
            yield (name, step, int(kept[after]), removed, fails[k] - removed, unique[k],
                   int(good[active] - good[after]), int(toxic[active] - toxic[after]), shapley[k])
            active = after


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step (module docstring)."""
    ship(docs.sparkSession)
    parts = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()),
                        *((c, pa.int64()) for c in "kept removed redundant unique_fails good_lost toxic_lost shapley".split())])

    def run(batches):
        for batch in batches:
            for part, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.zeros((3, CELLS), dtype=np.int64)
                for cell in found:
                    counts[:, cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
                rows = list(_orders(*gray_walk(counts)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(rows), pa.string()), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:]))], schema=schema)

    return parts.mapInArrow(run, ROWS)


#: The audit stated over documents: every order is applied to every cell.
SQL = """
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
first AS (SELECT text, min(doc_id) AS lowest FROM t GROUP BY text),
m AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
d AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         concat(CASE WHEN len(words) < 50 THEN 'A' ELSE '' END,
                CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END,
                CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END,
                CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
                CASE WHEN t.doc_id > lowest THEN 'E' ELSE '' END) AS fails
  FROM t JOIN first USING (text) LEFT JOIN m ON t.doc_id = m.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order
  FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
  SELECT part, filter_order, step, x,
         sum(CASE WHEN fails = '' OR NOT regexp_matches(fails, '[' || before || x || ']') THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN contains(fails, x) AND (before = '' OR NOT regexp_matches(fails, '[' || before || '_]')) THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN contains(fails, x) AND before <> '' AND regexp_matches(fails, '[' || before || '_]') THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = x THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN contains(fails, x) AND (before = '' OR NOT regexp_matches(fails, '[' || before || '_]')) THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN contains(fails, x) AND (before = '' OR NOT regexp_matches(fails, '[' || before || '_]')) THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, x)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM r
"""
