"""Queries of the operators of this subpackage, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import codes, decontaminate, exact, licences, lines, minhash, mixing, quality, secrets, sharding, shards, substring, trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_shards": shards.query,
    "op2_substring_dedup": substring.query,
    "op3_secret_scan": secrets.query,
    "op4_license_scan": licences.query,
    "op5_quality_rules": quality.query,
    "op6_sharding": sharding.query,
    "op7_benchmark_decontamination": decontaminate.query,
    "op8_line_dedup": lines.query,
    "op9_mixing": mixing.query,
    "op10_minhash_near_dedup": minhash.query,
    "op11_vector_codes": codes.query,
    "op12_exact_dedup": exact.query,
    "op13_prefix_trie": trie.query,
}

ORACLES: dict[str, str] = {
    "op2_substring_dedup": substring.ORACLE,
    "op4_license_scan": licences.ORACLE,
    "op5_quality_rules": quality.ORACLE,
    "op7_benchmark_decontamination": decontaminate.ORACLE,
    "op8_line_dedup": lines.ORACLE,
    "op10_minhash_near_dedup": minhash.ORACLE,
    "op11_vector_codes": codes.ORACLE,
    "op12_exact_dedup": exact.ORACLE,
    "op13_prefix_trie": trie.ORACLE,
}
