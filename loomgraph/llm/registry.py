"""The queries of this subpackage and the SQL that says what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, exact, lm, packing, quality, secrets, simhash, spans, suffixes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": bpe.op1_bpe,
    "op2_quality": quality.op2_quality,
    "op3_suffix_array": suffixes.op3_suffix_array,
    "op4_chat": chat.op4_chat,
    "op5_exact": exact.op5_exact,
    "op6_simhash": simhash.op6_simhash,
    "op7_lm": lm.op7_lm,
    "op8_sentence_spans": spans.op8_sentence_spans,
    "op8_texts": spans.op8_texts,
    "op9_secrets": secrets.op9_secrets,
    "op10_packing": packing.op10_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op3_suffix_array": suffixes.OP3_SQL,
    "op4_chat": chat.OP4_SQL,
    "op5_exact": exact.OP5_SQL,
    "op8_sentence_spans": spans.OP8_SQL,
    "op8_texts": spans.OP8_TEXTS_SQL,
}
