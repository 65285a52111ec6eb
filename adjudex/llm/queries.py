"""The operators' queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontaminate import OP3_SQL, op3_decontaminate
from .html_extract import op4_html_extraction
from .lm_score import op10_lm_score
from .mixing import OP9_SQL, op9_mix_sources
from .near_dedup import OP6_SQL, op6_minhash_near_dedup
from .packing import op11_packing
from .periodic_runs import op12_periodic_runs
from .pii import op5_pii_surrogates
from .quality_classifier import op7_quality_classifier
from .quality_rules import OP8_SQL, op8_quality_rules
from .ranked_search import OP13_SQL, op13_ranked_search
from .token_count import op2_token_counts
from .url_filter import OP1_SQL, op1_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_token_counts, op3_decontaminate, op4_html_extraction, op5_pii_surrogates,
        op6_minhash_near_dedup, op7_quality_classifier, op8_quality_rules, op9_mix_sources, op10_lm_score,
        op11_packing, op12_periodic_runs, op13_ranked_search,
    )
}
SQL = {"op1_url_filter": OP1_SQL, "op3_decontaminate": OP3_SQL, "op6_minhash_near_dedup": OP6_SQL, "op8_quality_rules": OP8_SQL, "op9_mix_sources": OP9_SQL, "op13_ranked_search": OP13_SQL}
