"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (
    best_fit,
    block_knn,
    centroids,
    html_extract,
    jaccard_join,
    lattice_dedup,
    mixing,
    packing,
    sharding,
    spelling,
    suffix_dedup,
    toxicity,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_bundles": warc.query,
    "op2_lattice_dedup": lattice_dedup.query,
    "op3_packing": packing.query,
    "op4_toxicity": toxicity.query,
    "op5_mixing": mixing.query,
    "op6_html_extract": html_extract.query,
    "op7_block_knn": block_knn.query,
    "op8_sharding": sharding.query,
    "op9_suffix_dedup": suffix_dedup.query,
    "op10_jaccard_join": jaccard_join.query,
    "op11_centroids": centroids.query,
    "op12_spelling": spelling.query,
    "op13_best_fit": best_fit.query,
}
ORACLES: dict[str, str] = {
    "op1_warc_bundles": warc.ORACLE,
    "op2_lattice_dedup": lattice_dedup.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op7_block_knn": block_knn.ORACLE,
    "op8_sharding": sharding.ORACLE,
    "op9_suffix_dedup": suffix_dedup.ORACLE,
    "op10_jaccard_join": jaccard_join.ORACLE,
    "op11_centroids": centroids.ORACLE,
    "op12_spelling": spelling.ORACLE,
}
