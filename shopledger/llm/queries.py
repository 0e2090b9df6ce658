"""The registered queries of this subpackage, and SQL with the same results where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shopledger.llm import (
    bpe,
    chat,
    fingerprints,
    html_extract,
    jaccard,
    license_scan,
    mixing,
    pii,
    quality,
    ranked_search,
    secret_scan,
    toxicity,
    turn_repair,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.op1,
    "op2_mixing": mixing.op2,
    "op3_chat_formatting": chat.op3,
    "op4_quality_rules": quality.op4,
    "op5_bpe": bpe.op5,
    "op6_html_extraction": html_extract.op6,
    "op7_fingerprints": fingerprints.op7,
    "op8_jaccard_join": jaccard.op8,
    "op9_secret_scans": secret_scan.op9,
    "op10_toxicity": toxicity.op10,
    "op11_turn_repair": turn_repair.op11,
    "op12_license_scan": license_scan.op12,
    "op13_ranked_search": ranked_search.op13,
}

ORACLES: dict[str, str] = {
    "op2_mixing": mixing.oracle(),
    "op3_chat_formatting": chat.ORACLE,
    "op4_quality_rules": quality.ORACLE,
    "op8_jaccard_join": jaccard.ORACLE,
    "op9_secret_scans": secret_scan.ORACLE,
    "op11_turn_repair": turn_repair.ORACLE,
    "op12_license_scan": license_scan.ORACLE,
    "op13_ranked_search": ranked_search.ORACLE,
}
