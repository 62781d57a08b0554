"""The registered queries of this subpackage."""

from __future__ import annotations

from hoopline.llm.context_mixing import op1_lm_scores
from hoopline.llm.conversations import op12_conversations
from hoopline.llm.decontaminate import op9_decontamination
from hoopline.llm.exact_dedup import op4_exact_dedup
from hoopline.llm.html_text import op7_html_text
from hoopline.llm.imatch import op11_imatch
from hoopline.llm.near_dedup import op2_near_dedup
from hoopline.llm.packing import op5_packing
from hoopline.llm.quality_cnn import op8_quality
from hoopline.llm.secrets import op10_secrets
from hoopline.llm.sharding import op3_sharding
from hoopline.llm.variants import op13_variants
from hoopline.llm.warc import op6_warc

QUERIES = {
    "op1_lm_scores": op1_lm_scores,
    "op2_near_dedup": op2_near_dedup,
    "op3_sharding": op3_sharding,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_packing": op5_packing,
    "op6_warc": op6_warc,
    "op7_html_text": op7_html_text,
    "op8_quality": op8_quality,
    "op9_decontamination": op9_decontamination,
    "op10_secrets": op10_secrets,
    "op11_imatch": op11_imatch,
    "op12_conversations": op12_conversations,
    "op13_variants": op13_variants,
}
