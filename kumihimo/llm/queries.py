"""The queries of the ten operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .chat import op5_chat_format
from .decontaminate import OP6_SQL, op6_decontaminate
from .divergence import OP12_SQL, op12_source_divergence
from .html_extract import OP1_SQL, op1_html_extract
from .jaccard_join import op4_jaccard_join
from .line_dedup import op3_line_dedup
from .minhash import OP11_SQL, op11_minmax_dedup
from .pieces import op10_sentencepiece
from .pii import op8_pii
from .quality import op2_quality_rules
from .token_counts import op7_token_counts
from .toxicity import op9_toxicity
from .trie import OP13_SQL, op13_prefix_trie

QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_quality_rules": op2_quality_rules,
    "op3_line_dedup": op3_line_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_chat_format": op5_chat_format,
    "op6_decontaminate": op6_decontaminate,
    "op7_token_counts": op7_token_counts,
    "op8_pii": op8_pii,
    "op9_toxicity": op9_toxicity,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_minmax_dedup": op11_minmax_dedup,
    "op12_source_divergence": op12_source_divergence,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES: dict[str, str] = {"op1_html_extract": OP1_SQL, "op6_decontaminate": OP6_SQL, "op11_minmax_dedup": OP11_SQL, "op12_source_divergence": OP12_SQL, "op13_prefix_trie": OP13_SQL}
