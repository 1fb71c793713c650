"""The queries of this subpackage, one per operator, and the SQL that states some of them."""

from __future__ import annotations

from lodestrata.llm.bpe import op9_bpe
from lodestrata.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from lodestrata.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from lodestrata.llm.html_extract import op4_html_extract
from lodestrata.llm.langid import op5_language
from lodestrata.llm.mixing import op8_mixing
from lodestrata.llm.ngram_join import OP10_SQL, op10_ngram_join
from lodestrata.llm.quality import op12_quality
from lodestrata.llm.runs import OP13_SQL, op13_runs
from lodestrata.llm.sharding import OP6_SQL, op6_sharding
from lodestrata.llm.substring import op1_substring_dedup
from lodestrata.llm.topk import OP7_SQL, op7_top_k
from lodestrata.llm.toxicity import op3_toxicity
from lodestrata.shipping import shipped

QUERIES = {
    q.__name__: shipped(q)
    for q in (op1_substring_dedup, op2_exact_dedup, op3_toxicity, op4_html_extract, op5_language, op6_sharding, op7_top_k, op8_mixing, op9_bpe, op10_ngram_join, op11_hard_negatives, op12_quality, op13_runs)
}

ORACLE_SQL = {"op2_exact_dedup": OP2_SQL, "op6_sharding": OP6_SQL, "op7_top_k": OP7_SQL, "op10_ngram_join": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op13_runs": OP13_SQL}
