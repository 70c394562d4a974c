"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from passagemill.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from passagemill.llm.language import op10_language_id
from passagemill.llm.line_dedup import OP7_SQL, op7_line_dedup
from passagemill.llm.mixing import op1_mix_sources
from passagemill.llm.ngram_join import OP6_SQL, op6_ngram_jaccard_join
from passagemill.llm.packing import op9_best_fit_packing
from passagemill.llm.pii import op2_personal_data
from passagemill.llm.quality import op5_quality_rules
from passagemill.llm.sharding import op4_shard_documents
from passagemill.llm.toxicity import op3_toxicity

QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_personal_data, op3_toxicity, op4_shard_documents, op5_quality_rules, op6_ngram_jaccard_join, op7_line_dedup, op8_exact_dedup, op9_best_fit_packing, op10_language_id)}
ORACLE_SQL = {"op6_ngram_jaccard_join": OP6_SQL, "op7_line_dedup": OP7_SQL, "op8_exact_dedup": OP8_SQL}
