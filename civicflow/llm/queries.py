"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from civicflow.llm import (bpe, dataset_manifest, decontaminate, edit_counts, filter_audit, jaccard, licenses, lines,
                           ngram_lm, substrings, token_files, toxicity, vectors)
from civicflow.llm.common import read


def op1_substring_dedup(spark, sf_dir):
    return substrings.dedup_substrings(read(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_benchmark_decontamination(spark, sf_dir):
    return decontaminate.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark, sf_dir):
    return lines.dedup_lines(read(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark, sf_dir):
    return jaccard.components(read(spark, sf_dir, "documents"))


def op6_token_files(spark, sf_dir):
    return token_files.token_files_digest(read(spark, sf_dir, "documents"))


def op7_bpe(spark, sf_dir):
    return bpe.encode_digests(read(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark, sf_dir):
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings"))


def op9_license_scan(spark, sf_dir):
    return licenses.scan(read(spark, sf_dir, "documents"))


def op10_edit_counts(spark, sf_dir):
    return edit_counts.recount(edit_counts.revision_edits(read(spark, sf_dir, "documents")))


def op11_dataset_manifest(spark, sf_dir):
    return dataset_manifest.manifest(read(spark, sf_dir, "documents"))


def op12_lm_scoring(spark, sf_dir):
    return ngram_lm.score_documents(read(spark, sf_dir, "documents"))


def op13_filter_audit(spark, sf_dir):
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_toxicity, op3_benchmark_decontamination, op4_line_dedup, op5_ngram_jaccard, op6_token_files,
    op7_bpe, op8_embedding_near_dedup, op9_license_scan, op10_edit_counts,
    op11_dataset_manifest, op12_lm_scoring, op13_filter_audit)}
ORACLE_SQL: dict[str, str] = {"op4_line_dedup": lines.SQL, "op11_dataset_manifest": dataset_manifest.SQL, "op13_filter_audit": filter_audit.SQL}
