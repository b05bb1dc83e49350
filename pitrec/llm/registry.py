"""The corpus operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from .changes import OP13_SQL, op13_change_applier
from .embedding_dedup import OP9_SQL, op9_embedding_near_dedup
from .language_id import op2_language_id
from .mixing import OP1_SQL, op1_mix_sources
from .packing import op12_best_fit_packing
from .pieces import op4_sentencepiece
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .quality_rules import OP5_SQL, op5_quality_rules
from .simhash import op6_simhash_near_dedup
from .suffix_dedup import op7_suffix_dedup
from .token_counts import op10_token_counts
from .toxicity import op3_toxicity
from .warc import OP8_SQL, op8_warc

QUERIES = {
    f.__name__: f
    for f in (op1_mix_sources, op2_language_id, op3_toxicity, op4_sentencepiece, op5_quality_rules, op6_simhash_near_dedup, op7_suffix_dedup, op8_warc, op9_embedding_near_dedup, op10_token_counts, op11_prefix_trie, op12_best_fit_packing, op13_change_applier)
}
ORACLES = {"op1_mix_sources": OP1_SQL, "op5_quality_rules": OP5_SQL, "op8_warc": OP8_SQL, "op9_embedding_near_dedup": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op13_change_applier": OP13_SQL}
