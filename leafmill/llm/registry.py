"""The numbered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from leafmill.llm.bpe import op9_bpe
from leafmill.llm.conversation_repair import op11_conversation_repair
from leafmill.llm.dac import op10_token_files
from leafmill.llm.html_text import op5_html_text
from leafmill.llm.jaccard_join import op4_jaccard_join
from leafmill.llm.mixing import op3_mixing
from leafmill.llm.pu_toxicity import op6_pu_toxicity
from leafmill.llm.quality_rules import op7_quality_rules
from leafmill.llm.rule_ensemble import op2_rule_ensemble
from leafmill.llm.secret_scan import op8_secret_scan
from leafmill.llm.sql import SQL  # noqa: F401
from leafmill.llm.token_align import op12_token_align
from leafmill.llm.topk_search import op1_topk_search
from leafmill.llm.url_filter import op13_url_filter

QUERIES = {
    "op1_topk_search": op1_topk_search,
    "op2_rule_ensemble": op2_rule_ensemble,
    "op3_mixing": op3_mixing,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_html_text": op5_html_text,
    "op6_pu_toxicity": op6_pu_toxicity,
    "op7_quality_rules": op7_quality_rules,
    "op8_secret_scan": op8_secret_scan,
    "op9_bpe": op9_bpe,
    "op10_token_files": op10_token_files,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_token_align": op12_token_align,
    "op13_url_filter": op13_url_filter,
}
