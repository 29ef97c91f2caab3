"""The queries of this subpackage and their SQL."""

from .decontaminate import SQL as DECONTAMINATION_SQL
from .decontaminate import op1_decontamination
from .jaccard_join import SQL as JACCARD_JOIN_SQL
from .jaccard_join import op4_ngram_jaccard_join
from .language_id import op8_language_id
from .line_dedup import SQL as LINE_DEDUP_SQL
from .line_dedup import op2_line_dedup
from .packing import op6_best_fit_packing
from .quality import op7_quality_rules
from .substring_dedup import op9_substring_dedup
from .surrogates import op3_pii_surrogates
from .token_counts import op5_edit_aware_counts
from .toxicity import op10_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_line_dedup, op3_pii_surrogates, op4_ngram_jaccard_join, op5_edit_aware_counts,
        op6_best_fit_packing, op7_quality_rules, op8_language_id, op9_substring_dedup, op10_toxicity,
    )
}
ORACLES = {"op1_decontamination": DECONTAMINATION_SQL, "op2_line_dedup": LINE_DEDUP_SQL, "op4_ngram_jaccard_join": JACCARD_JOIN_SQL}
