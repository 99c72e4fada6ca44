"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from .collocations import SQL as COLLOCATIONS_SQL
from .collocations import op12_collocations
from .decontamination import op10_decontamination
from .filter_audit import SQL as FILTER_AUDIT_SQL
from .filter_audit import op13_filter_audit
from .language import op8_language
from .language_model import op5_language_model
from .mixing import op6_pfair_mixture
from .near_duplicates import SQL as NEAR_DUPLICATES_SQL
from .near_duplicates import op3_near_duplicates
from .pii import op2_sanitised
from .quality_rules import op7_quality_rules
from .sharding import SQL as SHARDING_SQL
from .sharding import op1_jump_sharding
from .suffix_dedup import SQL as SUFFIX_DEDUP_SQL
from .suffix_dedup import op11_suffix_dedup
from .token_counts import op4_token_counts
from .warc import op9_warc_derivatives

QUERIES = {f.__name__: f for f in (op1_jump_sharding, op2_sanitised, op3_near_duplicates, op4_token_counts, op5_language_model, op6_pfair_mixture, op7_quality_rules, op8_language, op9_warc_derivatives, op10_decontamination, op11_suffix_dedup, op12_collocations, op13_filter_audit)}
SQL = {"op1_jump_sharding": SHARDING_SQL, "op3_near_duplicates": NEAR_DUPLICATES_SQL, "op11_suffix_dedup": SUFFIX_DEDUP_SQL, "op12_collocations": COLLOCATIONS_SQL, "op13_filter_audit": FILTER_AUDIT_SQL}
