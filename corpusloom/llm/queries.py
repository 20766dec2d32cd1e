"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import block_naming, chunk_bpe, cutting_stock, gru_lm, line_dedup, merge_on_read, near_dedup, source_mix, substring_dedup, token_files, topk_search, toxicity, vector_codes

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    word, byte = public_tokenizers.path(WORD_BPE), public_tokenizers.path(BYTE_BPE)
    return {
        "op1_line_dedup": lambda s, d: line_dedup.op1(table(s, d, "documents")),
        "op2_token_files": lambda s, d: token_files.op2(table(s, d, "documents"), word),
        "op3_chunk_bpe": lambda s, d: chunk_bpe.digests(table(s, d, "documents"), byte),
        "op4_exact_dedup": lambda s, d: block_naming.op4(table(s, d, "documents")),
        "op5_packing": lambda s, d: cutting_stock.pack(table(s, d, "documents"), word),
        "op6_topk_search": lambda s, d: topk_search.op6(table(s, d, "embeddings")),
        "op7_toxicity": lambda s, d: toxicity.op7(table(s, d, "documents"), table(s, d, "labels")),
        "op8_substring_dedup": lambda s, d: substring_dedup.op8(table(s, d, "documents")),
        "op9_gru_lm": lambda s, d: gru_lm.op9(table(s, d, "documents")),
        "op10_near_dedup": lambda s, d: near_dedup.op10(table(s, d, "documents")),
        "op11_source_mix": lambda s, d: source_mix.op11(table(s, d, "documents")),
        "op12_merge_on_read": lambda s, d: merge_on_read.op12(table(s, d, "clients"), table(s, d, "client_changes")),
        "op13_vector_codes": lambda s, d: vector_codes.op13(table(s, d, "embeddings")),
        "pipeline": pipeline,
    }
