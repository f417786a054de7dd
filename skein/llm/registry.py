"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from skein.llm import brown_lm, chat_format, decontaminate, fill_middle, kd_search, ngram_join, packing, prefix_trie, substring_dedup, token_counts, token_files, toxicity, vector_packing


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_kd_search": kd_search.op1_kd_search,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_decontamination": decontaminate.op3_decontamination,
        "op4_packing": packing.op4_packing,
        "op5_token_files": token_files.op5_token_files,
        "op6_brown_lm": brown_lm.op6_brown_lm,
        "op7_ngram_jaccard_join": ngram_join.op7_ngram_jaccard_join,
        "op7_ngram_jaccard_links": ngram_join.op7_ngram_jaccard_links,
        "op8_chat_format": chat_format.op8_chat_format,
        "op9_substring_dedup": substring_dedup.op9_substring_dedup,
        "op10_token_counts": token_counts.op10_token_counts,
        "op11_vector_packing": vector_packing.op11_vector_packing,
        "op12_fill_middle": fill_middle.op12_fill_middle,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_kd_search": kd_search.OP1_SQL,
        "op3_decontamination": decontaminate.OP3_SQL,
        "op7_ngram_jaccard_join": ngram_join.OP7_SQL,
        "op7_ngram_jaccard_links": ngram_join.OP7_LINKS_SQL,
        "op8_chat_format": chat_format.OP8_SQL,
        "op9_substring_dedup": substring_dedup.OP9_SQL,
        "op12_fill_middle": fill_middle.OP12_SQL,
        "op13_prefix_trie": prefix_trie.OP13_SQL,
    }
