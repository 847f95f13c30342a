"""The corpus queries, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import decontaminate, erasure, fingerprints, jaccard_join, line_dedup, packing, pii, secrets_scan, spelling, token_binary, token_counts, topk_search, toxicity
from .common import table

PIECES, WORDS, BYTES = "piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op2_token_binary(spark, sf_dir):
    return token_binary.token_binary(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))


def op3_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op5_secrets(spark, sf_dir):
    return secrets_scan.secrets(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark, sf_dir):
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"), words=4, num=85)


def op8_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTES))


def op9_decontaminate(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op11_topk_search(spark, sf_dir):
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op12_erasure(spark, sf_dir):
    return erasure.erase_clients(*[table(spark, sf_dir, name) for name in erasure.AMOUNTS])


def op13_spelling(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_token_binary, op3_toxicity, op4_pii, op5_secrets, op6_line_dedup, op7_jaccard_join, op8_packing, op9_decontaminate, op10_fingerprints, op11_topk_search, op12_erasure, op13_spelling)}
SQL: dict[str, str] = {"op6_line_dedup": line_dedup.ORACLE, "op11_topk_search": topk_search.ORACLE}
