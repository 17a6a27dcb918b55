"""The corpus pipeline: stages over ``documents``, each one of the training-data operators.

1. ``toxicity`` (operator 2): documents that the passage score rejects go.
2. ``lines`` (operator 4): repeated lines are taken out of the texts; every document stays.
3. ``jaccard`` (operator 5): of each group of near-duplicates (five words, 0.8) the smallest doc_id stays.
4. ``decontaminate`` (operator 3): documents that hold a benchmark item go.
5. ``bpe`` (operator 7): the rest is encoded; one row of digests per document.

Each stage's rows are written as Parquet and read back before the next, so a lost executor
costs a re-read. Stages 1 to 4 return the columns of their input, whatever their names; the rows
with null or empty texts that they meet stay, so does a document that the line stage leaves without text,
which links with nothing and is encoded as no tokens; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from civicflow.llm import bpe, decontaminate, jaccard, lines, toxicity
from civicflow.llm.common import read, staged, without_clash


def drop_toxic(spark, docs, sf_dir):
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def drop_repeated_lines(spark, docs, sf_dir):
    def work(rows):
        kept = lines.drop_repeated_lines(rows)
        if "n_chars" in rows.columns:  # stays the length of the text
            length = F.length("text").cast(rows.schema["n_chars"].dataType)
            kept = kept.withColumn("n_chars", F.when(F.col("__n_removed") > 0, length).otherwise(F.col("n_chars")))
        return kept.select(*rows.columns)

    return without_clash(docs, work)


def keep_one_of_similar(spark, docs, sf_dir):
    return jaccard.keep_one(docs, words=5, percent=80)


def drop_contaminated(spark, docs, sf_dir):
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encode(spark, docs, sf_dir):
    return bpe.encode_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("lines", drop_repeated_lines),
    ("jaccard", keep_one_of_similar),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
