"""The queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heddle.llm.conversation_repair import op12_conversation_repair
from heddle.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from heddle.llm.fill_in_middle import OP11_SQL, op11_fill_in_middle
from heddle.llm.html_extract import op6_html_extract
from heddle.llm.line_dedup import op3_line_dedup
from heddle.llm.mixing import op8_mixing
from heddle.llm.packing import op2_packing, pack_conversations
from heddle.llm.quality_crf import op7_quality_classifier
from heddle.llm.quality_rules import OP10_SQL, op10_quality_rules
from heddle.llm.secrets import op5_secrets
from heddle.llm.simhash import op1_simhash
from heddle.llm.substring_dedup import op9_substring_dedup
from heddle.llm.vector_search import OP13_SQL, op13_vector_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_packing": op2_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_secrets": op5_secrets,
    "op6_html_extract": op6_html_extract,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_mixing": op8_mixing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_vector_search": op13_vector_search,
    "pack_conversations": pack_conversations,
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": OP4_SQL,
    "op10_quality_rules": OP10_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op13_vector_search": OP13_SQL,
}
