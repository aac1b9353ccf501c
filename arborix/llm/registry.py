"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from arborix.llm.conversation_repair import OP12_SQL, op12_conversation_repair
from arborix.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from arborix.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from arborix.llm.kneser_ney import op5_lm_scoring
from arborix.llm.language import op4_language_id
from arborix.llm.media import op2_media_columns
from arborix.llm.mixing import op8_mixing
from arborix.llm.near_dedup import op7_near_dedup
from arborix.llm.packing import op3_packing
from arborix.llm.quality import op10_quality
from arborix.llm.secrets import op13_secrets
from arborix.llm.token_counts import op9_token_counts
from arborix.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_media_columns": op2_media_columns,
    "op3_packing": op3_packing,
    "op4_language_id": op4_language_id,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_mixing": op8_mixing,
    "op9_token_counts": op9_token_counts,
    "op10_quality": op10_quality,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_secrets": op13_secrets,
}
SQL = {"op6_exact_dedup": OP6_SQL, "op11_hard_negatives": OP11_SQL, "op12_conversation_repair": OP12_SQL}
