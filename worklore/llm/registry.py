"""The corpus operators' queries, by name, and DuckDB SQL for those that SQL can express."""

from worklore.llm.chat_format import op10_chat_format
from worklore.llm.decontaminate import op7_decontaminate
from worklore.llm.jaccard_join import op3_jaccard_join
from worklore.llm.language_id import op8_language_id
from worklore.llm.oracles import ORACLE_SQL
from worklore.llm.packing import op1_packing
from worklore.llm.pii import op2_pii
from worklore.llm.quality_rules import op9_quality_rules
from worklore.llm.secrets import op4_secrets
from worklore.llm.suffix_dedup import op6_suffix_dedup
from worklore.llm.url_filter import op5_url_filter

QUERIES = {f.__name__: f for f in (op1_packing, op2_pii, op3_jaccard_join, op4_secrets, op5_url_filter, op6_suffix_dedup, op7_decontaminate, op8_language_id, op9_quality_rules, op10_chat_format)}

__all__ = ["ORACLE_SQL", "QUERIES"]
