"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from meander.llm.embedding_dedup import op6_embedding_dedup
from meander.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from meander.llm.jaccard_join import op2_jaccard_join
from meander.llm.license_scan import op9_license_scan
from meander.llm.lm_scoring import op10_lm_scoring
from meander.llm.merkle_manifest import OP11_SQL, op11_merkle_manifest
from meander.llm.mixing import OP1_SQL, op1_mixing
from meander.llm.packing import op8_packing
from meander.llm.periodic_runs import op13_periodic_runs
from meander.llm.quality import op12_quality
from meander.llm.sharding import op5_sharding
from meander.llm.substring_dedup import OP7_SQL, op7_substring_dedup
from meander.llm.toxicity import op3_toxicity

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_toxicity": op3_toxicity,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_sharding": op5_sharding,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_packing": op8_packing,
    "op9_license_scan": op9_license_scan,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_quality": op12_quality,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES = {
    "op1_mixing": OP1_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op11_merkle_manifest": OP11_SQL,
}
