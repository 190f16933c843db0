"""The queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import alignment, decontaminate, importance, jaccard_join, lattice, licenses, packing, pii, ranking, token_store, top_k, url_filter, warc

_BY_NAME = {
    "op1_decontaminate": decontaminate,
    "op2_jaccard_join": jaccard_join,
    "op3_length_packing": packing,
    "op4_lattice_score": lattice,
    "op5_pii_spans": pii,
    "op6_importance_sample": importance,
    "op7_exact_top_k": top_k,
    "op8_token_store": token_store,
    "op9_warc_archives": warc,
    "op10_url_filter": url_filter,
    "op11_token_alignment": alignment,
    "op12_ranked_search": ranking,
    "op13_license_scan": licenses,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in _BY_NAME.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, module in _BY_NAME.items() if (sql := getattr(module, "ORACLE_SQL", None))}
