"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quillgrid.llm import bpe, divergence, dualtree, minhash, mixing, neighbours, pii, prefix_trie, quality, substring, token_counts, toxicity, wrappers


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_wrappers": wrappers.query,
        "op2_dualtree": dualtree.query,
        "op3_substring": substring.query,
        "op4_pii": pii.query,
        "op5_bpe": bpe.query,
        "op6_token_counts": token_counts.query,
        "op7_minhash": minhash.query,
        "op8_quality": quality.query,
        "op9_toxicity": toxicity.query,
        "op10_mixing": mixing.query,
        "op11_divergence": divergence.query,
        "op12_neighbours": neighbours.query,
        "op13_prefix_trie": prefix_trie.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """The others are tested against brute force in tests/llm."""
    return {
        "op2_dualtree": dualtree.ORACLE,
        "op3_substring": substring.ORACLE,
        "op4_pii": pii.oracle(),
        "op10_mixing": mixing.oracle(),
        "op11_divergence": divergence.ORACLE,
        "op13_prefix_trie": prefix_trie.ORACLE,
    }
