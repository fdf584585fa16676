"""The registered queries of this package, each over whole tables, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tapewright.llm import bloom_lm, decontaminate, hard_negatives, html_template, importance, line_dedup, minmax, packing, pii, secret_scan, sharding, spotsigs, whitening
from tapewright.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_template": lambda spark, d: html_template.extract(table(spark, d, "pages")),
    "op2_best_fit_packing": lambda spark, d: packing.digest(table(spark, d, "documents")),
    "op3_line_dedup": lambda spark, d: line_dedup.digest(table(spark, d, "documents")),
    "op4_spotsigs": lambda spark, d: spotsigs.digest(table(spark, d, "documents")),
    "op5_decontaminate": lambda spark, d: decontaminate.report(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op6_pii": lambda spark, d: pii.digest(table(spark, d, "documents")),
    "op7_bloom_lm": lambda spark, d: bloom_lm.score(table(spark, d, "documents")),
    "op8_importance_resampling": lambda spark, d: importance.digest(table(spark, d, "documents"), table(spark, d, "labels")),
    "op9_minmax": lambda spark, d: minmax.digest(table(spark, d, "documents")),
    "op10_secret_scan": lambda spark, d: secret_scan.digest(table(spark, d, "documents")),
    "op11_inverted_multi_index": lambda spark, d: hard_negatives.mine(table(spark, d, "embeddings")),
    "op12_incremental_whitening": lambda spark, d: whitening.digest(table(spark, d, "embeddings")),
    "op13_jump_hash": lambda spark, d: sharding.digest(table(spark, d, "documents")),
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": line_dedup.DIGEST_SQL,
    "op5_decontaminate": decontaminate.REPORT_SQL,
    "op9_minmax": minmax.DIGEST_SQL,
    "op11_inverted_multi_index": hard_negatives.MINE_SQL,
    "op13_jump_hash": sharding.DIGEST_SQL,
}
