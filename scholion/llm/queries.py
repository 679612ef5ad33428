"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scholion.llm.chat import OP6_SQL, op6_chat
from scholion.llm.decontaminate import OP5_SQL, op5_decontaminate
from scholion.llm.fingerprint import op2_order_minhash
from scholion.llm.licenses import OP1_SQL, op1_licenses
from scholion.llm.minhash import op13_minhash
from scholion.llm.negatives import OP11_SQL, op11_hard_negatives
from scholion.llm.packing import op4_packing
from scholion.llm.phrases import OP12_SQL, op12_phrases
from scholion.llm.pii import op10_pii
from scholion.llm.quality import op9_quality
from scholion.llm.secrets import op7_secrets
from scholion.llm.simhash import op3_simhash
from scholion.llm.toxicity import op8_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licenses": op1_licenses,
        "op2_order_minhash": op2_order_minhash,
        "op3_simhash": op3_simhash,
        "op4_packing": op4_packing,
        "op5_decontaminate": op5_decontaminate,
        "op6_chat": op6_chat,
        "op7_secrets": op7_secrets,
        "op8_toxicity": op8_toxicity,
        "op9_quality": op9_quality,
        "op10_pii": op10_pii,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_phrases": op12_phrases,
        "op13_minhash": op13_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_licenses": OP1_SQL,
        "op5_decontaminate": OP5_SQL,
        "op6_chat": OP6_SQL,
        "op11_hard_negatives": OP11_SQL,
        "op12_phrases": OP12_SQL,
    }
