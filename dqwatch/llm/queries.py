"""Registered queries of this subpackage; each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dqwatch.llm import (
    bpe,
    class_lm,
    decontamination,
    fill_middle,
    html_text,
    periodic_runs,
    secrets,
    sharding,
    simhash,
    topk,
    toxicity,
    training_order,
    url_rules,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secrets.query,
    "op2_decontamination": decontamination.query,
    "op3_training_order": training_order.query,
    "op4_bpe": bpe.query,
    "op5_sharding": sharding.query,
    "op6_class_lm": class_lm.query,
    "op7_simhash": simhash.query,
    "op8_topk": topk.query,
    "op9_html_text": html_text.query,
    "op10_toxicity": toxicity.query,
    "op11_periodic_runs": periodic_runs.query,
    "op12_url_rules": url_rules.query,
    "op13_fill_middle": fill_middle.query,
}

#: DuckDB SQL by query name, where SQL can express the operator.
ORACLES: dict[str, str] = {"op8_topk": topk.ORACLE, "op12_url_rules": url_rules.ORACLE}
