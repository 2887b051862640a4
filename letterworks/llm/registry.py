"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from letterworks.llm.chat_format import OP10_SQL, op10_chat_format
from letterworks.llm.decontamination import op6_decontamination
from letterworks.llm.importance import OP13_SQL, op13_importance_resampling
from letterworks.llm.language_id import op2_language_id
from letterworks.llm.line_dedup import OP7_SQL, op7_line_dedup
from letterworks.llm.lm_scoring import op8_lm_scoring
from letterworks.llm.mixing import op9_mixing
from letterworks.llm.near_dedup import op5_near_dedup
from letterworks.llm.phrases import OP12_SQL, op12_phrases
from letterworks.llm.quality_rules import OP4_SQL, op4_quality_rules
from letterworks.llm.secrets import op3_secret_scan
from letterworks.llm.substring_dedup import OP11_SQL, op11_substring_dedup
from letterworks.llm.warc import OP1_SQL, op1_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_warc,
        op2_language_id,
        op3_secret_scan,
        op4_quality_rules,
        op5_near_dedup,
        op6_decontamination,
        op7_line_dedup,
        op8_lm_scoring,
        op9_mixing,
        op10_chat_format,
        op11_substring_dedup,
        op12_phrases,
        op13_importance_resampling,
    )
}

ORACLES = {
    "op1_warc": OP1_SQL,
    "op4_quality_rules": OP4_SQL,
    "op7_line_dedup": OP7_SQL,
    "op10_chat_format": OP10_SQL,
    "op11_substring_dedup": OP11_SQL,
    "op12_phrases": OP12_SQL,
    "op13_importance_resampling": OP13_SQL,
}
